"""Candidate results as a stream: a running search drops JSON files, and a registry of the latest result per candidate follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scoring import latest_per_candidate

SCHEMA = "candidate_id string, family string, sequence long, finished timestamp, silhouette double, ari_seed double, accepted boolean"


def follow(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The folder's result files, each read once, as they come."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def finished_per_window(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Results and accepted ones per family and window of finishing time; what is later than the watermark is left out."""
    timed = stream.withWatermark("finished", late)
    return timed.groupBy(F.window("finished", width), "family").agg(F.count("*").alias("results"), F.count_if("accepted").alias("accepted"))


def keep_registry(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that merges every batch into a registry at path/v<batch>. A batch that runs again after a failure reads the version
    before its own and writes its own once more, so its effect is the same. Versions that no batch can read again are deleted; a version
    is a row per candidate, however many results there were."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(SCHEMA).parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], SCHEMA)
        latest_per_candidate(before.unionByName(batch), "sequence").write.mode("overwrite").parquet(f"{path}/v{number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
