"""Partition metrics over label_runs(run_id, row_idx, label); label -1 is noise.

All pairwise metrics come from contingency counts, built by one equi-join of the runs on row_idx and pre-aggregated."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def structure_summary(runs: DataFrame, tiny_below: float = 0.03) -> DataFrame:
    """Per run: clusters, share of noise, share of the largest, share of clusters under tiny_below of all rows."""
    sizes = runs.groupBy("run_id", "label").agg(F.count("*").alias("n"))
    total = F.sum("n")
    real = F.col("label") >= 0
    with_total = sizes.withColumn("total", total.over(Window.partitionBy("run_id")))
    return with_total.groupBy("run_id").agg(
        F.count_if(real).alias("n_clusters"),
        (F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)) / F.sum("n")).alias("noise_fraction"),
        F.coalesce(F.max(F.when(real, F.col("n") / F.col("total"))), F.lit(0.0)).alias("dominant_cluster_fraction"),
        F.coalesce(F.avg(F.when(real, (F.col("n") / F.col("total") < tiny_below).cast("double"))), F.lit(0.0)).alias("tiny_cluster_fraction"),
    )


def min_fraction(runs: DataFrame) -> DataFrame:
    """Smallest cluster over all rows; a gap in the label ids counts as an empty cluster, and no cluster as 0."""
    sizes = runs.groupBy("run_id", "label").agg(F.count("*").alias("n"))
    real = F.col("label") >= 0
    gap = F.max(F.when(real, F.col("label"))) + 1 > F.count_if(real)
    return sizes.groupBy("run_id").agg(F.when(gap | (F.count_if(real) == 0), 0.0).otherwise(F.min(F.when(real, F.col("n"))) / F.sum("n")).alias("min_cluster_fraction"))


def cluster_balance(runs: DataFrame) -> DataFrame:
    """Entropy of cluster sizes over its maximum, noise apart; one cluster 1, none 0."""
    sizes = runs.where("label >= 0").groupBy("run_id", "label").agg(F.count("*").alias("n"))
    p = sizes.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("run_id")))
    got = p.groupBy("run_id").agg(F.count("*").alias("k"), (-F.sum(F.col("p") * F.log(F.col("p") + 1e-12))).alias("h"))
    got = got.select("run_id", F.when(F.col("k") == 1, 1.0).otherwise(F.col("h") / F.log("k")).alias("cluster_balance"))
    return runs.select("run_id").distinct().join(got, "run_id", "left").select("run_id", F.coalesce("cluster_balance", F.lit(0.0)).alias("cluster_balance"))


def contingency(runs: DataFrame) -> DataFrame:
    """(run_a, run_b, la, lb, n) for run_a < run_b."""
    a = runs.select(F.col("run_id").alias("run_a"), F.col("row_idx"), F.col("label").alias("la"))
    b = runs.select(F.col("run_id").alias("run_b"), F.col("row_idx"), F.col("label").alias("lb"))
    return a.join(b, "row_idx").where("run_a < run_b").groupBy("run_a", "run_b", "la", "lb").agg(F.count("*").alias("n"))


def _pairs(x: Column) -> Column:
    return x * (x - 1) / 2


def ari_nmi(cells: DataFrame) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of every pair of runs; noise is a class."""
    rows = cells.groupBy("run_a", "run_b", "la").agg(F.sum("n").alias("m")).groupBy("run_a", "run_b").agg(F.sum(_pairs(F.col("m"))).alias("sa"), F.sum(F.col("m") * F.log("m")).alias("ea"), F.sum("m").alias("t"))
    cols = cells.groupBy("run_a", "run_b", "lb").agg(F.sum("n").alias("m")).groupBy("run_a", "run_b").agg(F.sum(_pairs(F.col("m"))).alias("sb"), F.sum(F.col("m") * F.log("m")).alias("eb"))
    both = cells.groupBy("run_a", "run_b").agg(F.sum(_pairs(F.col("n"))).alias("sab"), F.sum(F.col("n") * F.log("n")).alias("eab"))
    j = rows.join(cols, ["run_a", "run_b"]).join(both, ["run_a", "run_b"])
    expected = F.when(F.col("t") < 2, 0.0).otherwise(F.col("sa") * F.col("sb") / _pairs(F.col("t")))
    top = (F.col("sa") + F.col("sb")) / 2 - expected
    h = lambda e: F.log("t") - F.col(e) / F.col("t")
    mutual = h("ea") + h("eb") - h("eab")
    mean = (h("ea") + h("eb")) / 2
    return j.select("run_a", "run_b", F.when(F.abs(top) < 1e-12, 1.0).otherwise((F.col("sab") - expected) / top).alias("ari"), F.when(mean < 1e-12, 1.0).otherwise(mutual / mean).alias("nmi"))


def jaccard_cells(cells: DataFrame) -> DataFrame:
    """Jaccard index of every pair of clusters that share a row, noise apart. Sizes count the rows that both runs have."""
    size = lambda c: F.sum("n").over(Window.partitionBy("run_a", "run_b", c))
    sized = cells.withColumn("na", size("la")).withColumn("nb", size("lb")).where("la >= 0 and lb >= 0")
    return sized.select("run_a", "run_b", "la", "lb", "na", "nb", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))


def jaccard_one_sided(cells: DataFrame) -> DataFrame:
    """Per cluster of run_a the best match in run_b."""
    best = jaccard_cells(cells).groupBy("run_a", "run_b", "la").agg(F.max("jaccard").alias("best"))
    every = cells.where("la >= 0").select("run_a", "run_b", "la").distinct()
    return every.join(best, ["run_a", "run_b", "la"], "left").select("run_a", "run_b", "la", F.coalesce("best", F.lit(0.0)).alias("best"))


def assign(gain: np.ndarray) -> float:
    """Largest total of a one-to-one matching, by shortest augmenting paths with potentials."""
    n = max(gain.shape)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : gain.shape[0] + 1, 1 : gain.shape[1] + 1] = -gain
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while match[j0]:
            used[j0] = True
            free = np.flatnonzero(~used)
            slack = cost[match[j0], free] - u[match[j0]] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], j0
            j1 = free[least[free].argmin()]
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return float(-sum(cost[match[j], j] for j in range(1, n + 1)))


def jaccard_symmetric(cells: DataFrame) -> DataFrame:
    """Total Jaccard index of the best one-to-one matching over the larger number of clusters; 0 if a run has none.

    A task gets the Jaccard table of one pair of runs: clusters squared, whatever the number of rows."""
    import pandas as pd

    counts = cells.groupBy("run_a", "run_b").agg(F.count_distinct(F.when(F.col("la") >= 0, F.col("la"))).alias("ka"), F.count_distinct(F.when(F.col("lb") >= 0, F.col("lb"))).alias("kb"))
    table = counts.join(jaccard_cells(cells), ["run_a", "run_b"], "left").select("run_a", "run_b", "ka", "kb", "la", "lb", "jaccard")

    def match(t: pd.DataFrame) -> pd.DataFrame:
        ka, kb, known = int(t.ka.iloc[0]), int(t.kb.iloc[0]), t.dropna(subset=["jaccard"])
        value = 0.0
        if ka and kb and len(known):
            ia, ib = (pd.factorize(known[c])[0] for c in ("la", "lb"))
            gain = np.zeros((ka, kb))
            gain[ia, ib] = known.jaccard
            value = assign(gain) / max(ka, kb)
        return pd.DataFrame([(t.run_a.iloc[0], t.run_b.iloc[0], value)], columns=["run_a", "run_b", "jaccard"])

    kind = dict(cells.dtypes)["run_a"]
    return table.groupBy("run_a", "run_b").applyInPandas(match, f"run_a {kind}, run_b {kind}, jaccard double")


def align_perturbation(draws: DataFrame) -> DataFrame:
    """First draw of every row of a run: (run_id, draw_idx, row_idx, label) -> (run_id, row_idx, label)."""
    return draws.groupBy("run_id", "row_idx").agg(F.min_by("label", "draw_idx").alias("label"))


def representative_run(pairs: DataFrame) -> DataFrame:
    """The run with the highest mean ARI to the others; the first on ties."""
    both = pairs.select(F.col("run_a").alias("run_id"), "ari").union(pairs.select(F.col("run_b").alias("run_id"), "ari"))
    mean = both.groupBy("run_id").agg(F.round(F.avg("ari"), 12).alias("mean_ari"))
    return mean.orderBy(F.desc("mean_ari"), "run_id").limit(1)


def seed_summary(values: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Median, mean and spread (ddof 1, one value 0) of the finite values; of all if none is finite."""
    out = []
    for m in metrics:
        x = F.col(m)
        finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        pick = lambda f: F.coalesce(f(finite), f(x))
        out += [pick(lambda c: F.percentile(c, 0.5)).alias(f"{m}_median"), pick(F.avg).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(finite), F.lit(0.0)).alias(f"{m}_sd")]
    return values.groupBy(*by).agg(*out)
