"""Table sources and sinks: files by suffix, profiles, fingerprints, stable ids, deterministic row positions."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV (header, inferred types, empty fields and the tokens for missing values null) or Parquet, by suffix; NaN counts as missing."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".csv":
        df = _read_csv(spark, path)
    elif suffix in (".parquet", ".pq"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported table format: {suffix or path}")
    return nan_to_null(df)


# Fields of a CSV file that mean that there is no value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Types are inferred with the missing tokens out of the way: as whole numbers, numbers or truth values where all values are, else text.

    One pass over the text tells which kinds each column allows; values are cast when they are read."""
    text = spark.read.csv(path, header=True)
    text = text.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in text.columns])
    kinds = {"bigint": r"^\s*[+-]?\d{1,18}\s*$", "double": r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^\s*[+-]?inf(inity)?\s*$", "boolean": r"(?i)^(true|false)$"}
    checks = [F.count_if(F.col(f"`{c}`").isNotNull() & ~F.col(f"`{c}`").rlike(r)).alias(f"{i}_{k}") for i, c in enumerate(text.columns) for k, r in kinds.items()]
    odd = text.agg(*checks).first() if checks else {}
    types = [next((k for k in kinds if odd[f"{i}_{k}"] == 0), "string") for i in range(len(text.columns))]
    return text.select(*[(F.trim(F.col(f"`{c}`")) if t != "string" else F.col(f"`{c}`")).cast(t).alias(c) for c, t in zip(text.columns, types, strict=True)])


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one of the schema where nothing is there yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return load_table(spark, path) if there else spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str) -> None:
    """A folder of CSV or Parquet part files, written in parallel, by suffix."""
    suffix = Path(path).suffix.lower()
    if suffix == ".csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif suffix in (".parquet", ".pq"):
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unsupported table format: {suffix or path}")


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for tables of report size: through the driver, row by row."""
    import csv
    import io

    out = io.StringIO()
    rows = csv.writer(out, lineterminator="\n")
    rows.writerow(df.columns)
    for r in df.toLocalIterator():
        rows.writerow(["" if v is None else v for v in r])
    write_text(out.getvalue(), path)


def _hadoop(path: str):
    """The file system that holds path and path itself, or neither where no session runs: then files are local."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None, None
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    fs, p = _hadoop(path)
    return fs.exists(p) if fs else Path(path).exists()


def write_text(text: str, path: str) -> None:
    """A small file in whatever file system Spark reads the path from."""
    fs, p = _hadoop(path)
    if fs is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)
        return
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(path: str) -> str:
    fs, p = _hadoop(path)
    if fs is None:
        return Path(path).read_text()
    utils = SparkSession.getActiveSession().sparkContext._jvm.org.apache.commons.io.IOUtils
    stream = fs.open(p)
    try:
        return utils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_json(value, path: str) -> None:
    write_text(json.dumps(value, indent=2, sort_keys=True, default=str), path)


def read_yaml(path: str) -> dict:
    import yaml

    value = yaml.safe_load(read_text(path))
    if not isinstance(value, dict):
        raise ValueError("a configuration file must hold a mapping")
    return value


def write_yaml(value: dict, path: str) -> None:
    import yaml

    write_text(yaml.safe_dump(value, sort_keys=False), path)


def table_profile(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_null), one pass over the table whatever its width."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_null")) for i, c in enumerate(df.columns)])
    return counts.select(F.col("n").alias("n_rows"), F.explode(pairs).alias("p")).select("p.column_name", "n_rows", "p.n_null")


def with_row_idx(df: DataFrame, columns: list[str]) -> DataFrame:
    """A dense position 0 .. n - 1 that depends on the rows alone: ranked by the hash of these columns, bucket by bucket, so that no
    task sorts the table."""
    from tessera.operators.sampling import hashed_rank

    keyed = df.withColumn("_all", F.to_json(F.struct(*columns)))
    ranked = hashed_rank(keyed.withColumn("_md5", F.md5("_all")), F.col("_md5"), "_all", name="row_idx")
    return ranked.withColumn("row_idx", (F.col("row_idx") - 1).cast("long")).drop("_all", "_md5")


def row_identity(df: DataFrame, id_columns: list[str]) -> DataFrame:
    """row_id is the first id as text; all ids are kept as text."""
    return df.select(F.col(id_columns[0]).cast("string").alias("row_id"), *[F.col(c).cast("string").alias(c) for c in id_columns])


def require_columns(df: DataFrame, wanted: list[str]) -> None:
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def stable_id(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:16]


def file_fingerprint(path: str) -> dict:
    s = os.stat(path)
    return {"path": str(path), "size": s.st_size, "mtime_ns": s.st_mtime_ns}


def mark_stage(folder: str, stage: str, **details) -> None:
    from datetime import UTC, datetime

    write_json({"stage": stage, "updated_at": datetime.now(UTC).isoformat(), **details}, f"{folder}/state/{stage}.json")


def read_stage(folder: str, stage: str) -> dict | None:
    path = f"{folder}/state/{stage}.json"
    return json.loads(read_text(path)) if exists(path) else None


def fingerprint(df: DataFrame, path: str | None = None) -> dict:
    """What names a table's content, whatever the order of its rows: counts, columns and an order-free sum of row hashes; with path, the
    file's size and time too."""
    got = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("h")).first()
    out = {"rows": got.n, "columns": df.dtypes, "content": stable_id(str(got.h))}
    return out | ({"file": file_fingerprint(path)} if path and os.path.exists(path) else {})
