"""Exact-size sampling by hashed order: the same seed picks the same rows on any cluster."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, run: int | Column, key: Column) -> Column:
    """Hex text that orders rows at random."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (run if isinstance(run, Column) else F.lit(run)).cast("string"), F.lit(":"), key.cast("string")))


def hashed_rank(df: DataFrame, drawn: Column, key: str, by: list[str] = (), name: str = "_rank") -> DataFrame:
    """Rank from 1 in hashed order, overall or per group, without a sort of the table or of a large group in one task.

    The first three hex digits of a hash cut every group into 4096 even buckets: rows are ranked inside theirs, and running sums of the
    bucket sizes, at most 4096 a group, give where each bucket starts.
    """
    out = df.withColumn("_d", drawn).withColumn("_b", F.substring("_d", 1, 3))
    sizes = out.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_b").alias("_g__b"), "_start")
    on = F.col("_b") == F.col("_g__b")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_d", key))
    ranked = out.withColumn("_place", place).join(starts, on)
    return ranked.withColumn(name, F.col("_place") + F.col("_start")).drop("_d", "_b", "_place", "_start", "_g__b", *[f"_g_{c}" for c in by])


def take_exact(df: DataFrame, key: str, size: int, seed: int, run: int = 0) -> DataFrame:
    """size rows without replacement, those of the smallest hash."""
    return hashed_rank(df, draw(seed, run, F.col(key)), key).where(F.col("_rank") <= size).drop("_rank")


def whole_share(n: int, fraction: float) -> int:
    """Whole rows in a share of n, the fraction as it is written: 0.35 of 360 is 126, though the product of doubles is less."""
    return int(n * Fraction(str(fraction)))


def pilot_size(n: int, fraction: float, least: int) -> int:
    return n if n <= least else min(n, max(least, whole_share(n, fraction)))


def pilot_sample(df: DataFrame, key: str, fraction: float = 0.35, least: int = 250, seed: int = 2026) -> DataFrame:
    n = df.count()
    return df if n <= least else take_exact(df, key, pilot_size(n, fraction, least), seed)


def subsample(df: DataFrame, key: str, seed: int, run: int, share: float = 0.8) -> DataFrame:
    return take_exact(df, key, max(2, whole_share(df.count(), share)), seed, run)


def bootstrap_draws(df: DataFrame, n: int, seed: int, run: int) -> DataFrame:
    """(draw_idx, row_idx): n draws with replacement of positions 0 .. n - 1."""
    hashed = draw(seed, run, F.col("draw_idx"))
    return df.sparkSession.range(n).withColumnRenamed("id", "draw_idx").withColumn("row_idx", F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long"), F.lit(n)))


def folds(df: DataFrame, key: str, label: str, k: int, seed: int, repeat: int = 0) -> DataFrame:
    """Stratified folds: rows of a label are dealt round in hashed order."""
    ranked = hashed_rank(df, draw(seed, repeat, F.col(key)), key, [label])
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = 0, label: str | None = None) -> DataFrame:
    """is_test for a share of all rows, or of each label's."""
    by = [label] if label else []
    ranked = hashed_rank(df, draw(seed, 0, F.col(key)), key, by)
    if not label:
        return ranked.withColumn("is_test", F.col("_rank") <= F.ceil(F.lit(df.count()) * test)).drop("_rank")
    totals = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_t"))
    return ranked.join(totals, F.col(label).eqNullSafe(F.col("_l"))).withColumn("is_test", F.col("_rank") <= F.ceil(F.col("_t") * test)).drop("_rank", "_l", "_t")
