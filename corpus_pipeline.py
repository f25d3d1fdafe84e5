"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, contaminated documents go, personal
data is redacted, and what is left is mixed to the sources' weights. Each stage is written as Parquet and read again.

No ORACLE_SQL: the classifier, the tagger and the mix are trained or drawn, which SQL can't express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import pii
from tessera.llm.common import discard, materialize, table
from tessera.llm.decontaminate import remove_contaminated
from tessera.llm.mixing import mixed_texts
from tessera.llm.ngram_join import keep_one
from tessera.llm.toxicity import fit, keep_ordinary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the compression-distance classifier, trained on the labelled rows that are not held out, accepts."""
    return keep_ordinary(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts whose 5-word shingle sets are at least 0.8 similar: that of the smallest doc_id, null last.

    Documents without words are linked with nothing and stay; equal rows are of one class, whatever their ids.
    """
    return keep_one(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover less than the threshold of every benchmark item."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in the text replaced by its kind."""
    return pii.redact(docs, pii.fit(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws from, with the words it takes of each and the pieces in which its shards get them, in the
    shuffled order that each piece's rank tells."""
    return mixed_texts(docs, weights=[5.0, 2.0, 1.0], most=3.0)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        done = materialize(stage(spark, docs, sf_dir), name)
        if i:
            discard(docs)  # the input of the stage, which no later one reads
        docs = done
    return docs
