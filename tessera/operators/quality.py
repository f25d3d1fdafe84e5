"""Internal quality of clusterings of points(row_idx, features array, label); noise (label < 0) is left out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points that one block of the query side of silhouette holds.
BLOCK = 4096


def _dims(points: DataFrame) -> int:
    r = points.select(F.size("features")).first()
    return r[0] if r else 0


def centroids(points: DataFrame) -> DataFrame:
    """(label, n, center): one pre-aggregating pass, a sum per dimension."""
    d = _dims(points)
    real = points.where("label >= 0")
    return real.groupBy("label").agg(F.count("*").alias("n"), F.array(*[F.avg(F.element_at("features", i + 1)) for i in range(d)]).alias("center"))


def _distance(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _with_center(points: DataFrame) -> DataFrame:
    return points.where("label >= 0").join(centroids(points), "label")


def silhouette(points: DataFrame) -> DataFrame:
    """Mean Euclidean silhouette; -1 with fewer than two clusters or as many clusters as rows; a row alone in its cluster counts 0.

    The query points are dealt to tasks in blocks. Each block meets all points in blocks again and keeps only sums of distances by
    (row, cluster), so memory is a block's square and nothing of the size of all pairs is ever shuffled.
    """
    real = points.where("label >= 0")
    n, k = real.agg(F.count("*"), F.count_distinct("label")).first()
    spark = points.sparkSession
    if k < 2 or k >= n:
        return spark.createDataFrame([(-1.0,)], "silhouette double")
    blocks = -(-n // BLOCK)
    dealt = real.select("row_idx", "label", "features", F.pmod(F.xxhash64("row_idx"), F.lit(blocks)).cast("int").alias("block"))
    packed = dealt.groupBy("block").agg(F.collect_list(F.struct("row_idx", "label", "features")).alias("rows"))
    pairs = packed.crossJoin(packed.select(F.col("block").alias("other"), F.col("rows").alias("there")))

    def sums(frames):
        for f in frames:
            for rows, there in zip(f.rows, f.there, strict=True):
                x, y = (np.array([r["features"] for r in side], float) for side in (rows, there))
                lab = np.array([r["label"] for r in there])
                d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T))
                ids, mine = (np.array([r[c] for r in rows]) for c in ("row_idx", "label"))
                other = np.array([r["row_idx"] for r in there])
                d[ids[:, None] == other[None]] = 0
                for l in np.unique(lab):
                    yield pd.DataFrame({"row_idx": ids, "label": mine, "cluster": int(l), "total": d[:, lab == l].sum(1), "m": int((lab == l).sum())})

    found = pairs.mapInPandas(sums, "row_idx long, label int, cluster int, total double, m long").groupBy("row_idx", "label", "cluster").agg(F.sum("total").alias("total"), F.sum("m").alias("m"))
    per = found.groupBy("row_idx").agg(F.max(F.when(F.col("cluster") == F.col("label"), F.col("m"))).alias("own"), F.sum(F.when(F.col("cluster") == F.col("label"), F.col("total"))).alias("a"), F.min(F.when(F.col("cluster") != F.col("label"), F.col("total") / F.col("m"))).alias("b"))
    a = F.col("a") / F.greatest(F.col("own") - 1, F.lit(1))
    s = F.when(F.col("own") == 1, 0.0).otherwise((F.col("b") - a) / F.greatest(a, F.col("b")))
    return per.agg(F.avg(s).alias("silhouette"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    """Mean over clusters of the worst ratio of spreads to center distance; infinite where it isn't defined."""
    spread = _with_center(points).withColumn("d", _distance("features", "center")).groupBy("label").agg(F.avg("d").alias("s"), F.first("center").alias("c"), F.count("*").alias("n"))
    # clusters squared, never rows: the clusters meet in one list, so that the statistics are planned once
    every = spread.groupBy().agg(F.collect_list(F.struct("label", "s", "c", "n")).alias("l")).select(F.col("l"), F.explode("l").alias("x"))
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v))
    others = F.transform(F.filter("l", lambda y: y["label"] != F.col("x.label")), lambda y: F.coalesce((F.col("x.s") + y["s"]) / F.nullif(gap(F.col("x.c"), y["c"]), F.lit(0.0)), F.lit(0.0)))  # equal centers don't count
    worst = every.select(F.col("x.n").alias("na"), F.array_max(others).alias("w"))
    return worst.agg(F.when((F.count("*") < 2) | (F.count("*") >= F.coalesce(F.sum("na"), F.lit(0))), float("inf")).otherwise(F.avg("w")).alias("davies_bouldin"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """Between over within dispersion, each over its degrees of freedom; 0 where it isn't defined."""
    d = _dims(points)
    real = points.where("label >= 0")
    overall = real.agg(F.array(*[F.avg(F.element_at("features", i + 1)) for i in range(d)]).alias("mean"))
    within = _with_center(points).agg(F.sum(F.pow(_distance("features", "center"), 2)).alias("w"))
    between = centroids(points).crossJoin(F.broadcast(overall)).agg(F.sum(F.col("n") * F.pow(_distance("center", "mean"), 2)).alias("b"), F.count("*").alias("k"), F.sum("n").alias("n"))
    j = within.crossJoin(between)
    ok = (F.col("k") >= 2) & (F.col("k") < F.col("n"))
    return j.select(F.when(ok & (F.col("w") > 0), (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).when(ok, 1.0).otherwise(0.0).alias("calinski_harabasz"))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_a, feature_b, r) of all pairs, in one aggregation; undefined is 0."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = df.agg(*[F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return got.select(F.explode(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def correlation_groups(df: DataFrame, columns: list[str], threshold: float = 0.85) -> list[list[str]]:
    """Features connected by |r| of at least the threshold, in feature order."""
    up = {c: c for c in columns}

    def root(c: str) -> str:
        while up[c] != c:
            c = up[c]
        return c

    for r in correlation_pairs(df, columns).where(F.abs("r") >= threshold).collect():
        a, b = sorted((root(r.feature_a), root(r.feature_b)), key=columns.index)
        up[b] = a
    return [[c for c in columns if root(c) == h] for h in columns if root(h) == h]


def pca(points: DataFrame, k: int, whiten: bool = False) -> DataFrame:
    """(row_idx, scores array): covariance by one aggregation of the upper triangle, eigenvectors of that d x d matrix on the driver."""
    d = _dims(points)
    x = [F.element_at("features", i + 1) for i in range(d)]
    means = points.agg(*[F.avg(c) for c in x]).first()
    c = [v - m for v, m in zip(x, means, strict=True)]
    got = points.agg(F.count("*"), *[F.sum(c[i] * c[j]) for i in range(d) for j in range(i, d)]).first()
    cov, it = np.zeros((d, d)), iter(got[1:])
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = next(it) / max(1, got[0] - 1)
    value, vector = np.linalg.eigh(cov)
    top = np.argsort(-value)[:k]
    value, vector = value[top], vector[:, top]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(len(top))])
    if whiten:
        vector = vector / np.sqrt(np.maximum(value, 1e-12))

    def project(frames):
        for f in frames:
            s = (np.array(f.features.tolist(), float).reshape(-1, d) - np.array(means, float)) @ vector
            yield pd.DataFrame({"row_idx": f.row_idx, "scores": s.tolist()})

    return points.select("row_idx", "features").mapInPandas(project, "row_idx long, scores array<double>")
