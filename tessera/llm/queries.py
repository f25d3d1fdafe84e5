"""The registered corpus queries: one per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language_id, pii, quality
from .common import table
from .decontaminate import contaminated_pairs
from .mixing import mix_digest
from .ngram_join import jaccard_classes
from .substring_dedup import remove_repeats
from .tiff import tiff_digest
from .toxicity import fit, score
from .warc import archive_round_trip


def op1_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), least=100)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op3_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit(docs))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"), weights=[5.0, 2.0, 1.0], most=3.0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=100)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), language_id.fit(table(spark, sf_dir, "documents")))


def op7_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_reassembly": op1_warc_reassembly,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_pii_tagger": op3_pii_tagger,
    "op4_source_mixing": op4_source_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_quality_cotraining": op7_quality_cotraining,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_tiff_media": op10_tiff_media,
}

ORACLES: dict[str, str] = {
    "op1_warc_reassembly": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
             f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
               CASE WHEN f.first IS NOT NULL AND f.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first <> page_id THEN f.first END AS refers_to, true AS verified
        FROM p LEFT JOIN f ON p.h = f.h""",
}
