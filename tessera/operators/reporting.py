"""Report tables and figure data, synthetic input, and small derived measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def membership(labels: DataFrame, label: str = "consensus_label") -> DataFrame:
    """Rows by clusters, 1 where the row is a member; noise is all zero. Clusters are the columns c_<label>."""
    known = [r[0] for r in labels.where(F.col(label) >= 0).select(label).distinct().orderBy(label).collect()]
    return labels.select("row_idx", *[(F.col(label) == k).cast("int").alias(f"c_{k}") for k in known])


def penalties(n_clusters: str, rows: int, features: int) -> dict[str, F.Column]:
    """Parsimony ln(1 + k) / ln(1 + n) with one cluster at least, features a row, and the runtime penalty, which is constant."""
    return {"parsimony_penalty": F.log1p(F.greatest(F.col(n_clusters).cast("double"), F.lit(1.0))) / float(np.log1p(rows)), "feature_dimensionality_penalty": F.lit(features / max(1, rows)), "runtime_penalty": F.lit(0.0)}


def metadata_means(runs: DataFrame) -> DataFrame:
    """(candidate_id, metadata map<string,double>) per run -> mean of every number over the runs that have it."""
    return runs.select("candidate_id", F.explode("metadata").alias("name", "value")).groupBy("candidate_id", "name").agg(F.avg("value").alias("value"))


def size_and_confidence(certain: DataFrame, summary: DataFrame) -> DataFrame:
    """Per cluster size, support and ambiguity of its rows, beside the cluster summary; the summary's columns are prefixed."""
    rows = certain.groupBy("consensus_label").agg(F.count("*").alias("rows"), F.avg("top1").alias("mean_support"), F.avg("gap").alias("mean_gap"), F.avg(F.col("ambiguous").cast("double")).alias("ambiguous_share"))
    other = summary.select("consensus_label", *[F.col(c).alias(f"summary_{c}") for c in summary.columns if c != "consensus_label"])
    return rows.join(other, "consensus_label", "left")


def profile_heatmap(profiles: DataFrame, clusters: list) -> DataFrame:
    """feature x cluster of the numeric profile values."""
    return profiles.where("value_num is not null").groupBy("feature").pivot("cluster", clusters).agg(F.avg("value_num"))


def still_to_do(candidates: DataFrame, completed: DataFrame) -> DataFrame:
    return candidates.join(completed.select("candidate_id").distinct(), "candidate_id", "left_anti")


def already_done(candidates: DataFrame, completed: DataFrame) -> DataFrame:
    return candidates.join(completed.select("candidate_id").distinct(), "candidate_id", "left_semi")


def top_features(importance: DataFrame, by: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("importance_mean"), "feature")
    return importance.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def family_comparison(summary: DataFrame, base: str = "classical", other: str = "deep") -> DataFrame:
    """Ratio of mean runtimes of two families, and their accepted counts, in one row."""
    pick = lambda f, c: F.max(F.when(F.col("family") == f, F.col(c)))
    return summary.agg((pick(other, "runtime_mean") / pick(base, "runtime_mean")).alias("runtime_ratio"), pick(base, "accepted").alias(f"{base}_accepted"), pick(other, "accepted").alias(f"{other}_accepted"))


def data_driven_k(cuts: DataFrame, agreement: DataFrame) -> DataFrame:
    """(k, silhouette) of consensus cuts (k, sig_id, n, label) over distances 1 - c of agreement (i, j, c): weighted by row counts."""
    a, b = cuts.select("k", F.col("sig_id").alias("i"), F.col("n").alias("ni"), F.col("label").alias("la")), cuts.select("k", F.col("sig_id").alias("j"), F.col("n").alias("nj"), F.col("label").alias("lb"))
    pairs = a.join(agreement.select("i", "j", "c"), "i").join(b, ["k", "j"])
    same = F.col("la") == F.col("lb")
    weight = F.when(F.col("i") == F.col("j"), F.col("nj") - 1).otherwise(F.col("nj"))
    sums = pairs.groupBy("k", "i", "ni", "la", "lb").agg(F.sum((1 - F.col("c")) * weight).alias("t"), F.sum(weight).alias("m"), F.first(same).alias("own"))
    each = sums.groupBy("k", "i", "ni").agg(F.max(F.when(F.col("own") & (F.col("m") > 0), F.col("t") / F.col("m"))).alias("a"), F.max(F.when(F.col("own"), F.col("m"))).alias("am"), F.min(F.when(~F.col("own"), F.col("t") / F.col("m"))).alias("b"))
    s = F.when((F.col("am") == 0) | F.col("b").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return each.groupBy("k").agg((F.sum(s * F.col("ni")) / F.sum("ni")).alias("silhouette"))


def shapley(points: DataFrame, predict, background: np.ndarray, names: list[str], permutations: int = 20, seed: int = 0, most: int = 500) -> DataFrame:
    """(feature, mean_abs_shapley) over a bounded sample: Monte-Carlo Shapley values of predict(matrix) -> values or class probabilities.

    Each sampled row walks random feature orders from a background row to itself; a feature's value is the mean change it makes, with its
    sign. Only the finished values' sizes are averaged, over classes and rows."""
    from .sampling import take_exact

    def walk(frames):
        for f in frames:
            for key, row in zip(f.row_idx, f.features, strict=True):
                r, x = np.random.default_rng([seed, int(key)]), np.array(row, float)
                total = np.zeros((len(names), predict(x[None]).reshape(1, -1).shape[1]))
                for _ in range(permutations):
                    order, z = r.permutation(len(names)), background[r.integers(len(background))].copy()
                    path = [z.copy()]
                    for j in order:
                        z[j] = x[j]
                        path.append(z.copy())
                    total[order] += np.diff(predict(np.array(path)).reshape(len(path), -1), axis=0)
                yield pd.DataFrame({"feature": names, "value": np.abs(total / permutations).mean(1)})

    sample = take_exact(points, "row_idx", most, seed)
    return sample.select("row_idx", "features").mapInPandas(walk, "feature string, value double").groupBy("feature").agg(F.avg("value").alias("mean_abs_shapley"))


def synthetic_table(spark: SparkSession, per_group: int = 48, seed: int = 2026) -> DataFrame:
    """Three groups of patients with numbers, flags and categories, and gaps in three columns, by hash: any size, no driver data."""
    u = lambda name: (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "i"), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    normal = lambda name: F.sqrt(-2 * F.log(u(name))) * F.cos(u(name + "'") * 6.283185307179586)
    g = (F.col("i") / per_group).cast("int")
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), g + 1)
    t = spark.range(3 * per_group).withColumnRenamed("id", "i")
    gap = lambda name: F.pmod(F.xxhash64(F.lit(name), "i"), F.lit(18)) == 0
    return t.select(
        F.format_string("P%06d", "i").alias("patient_id"), (at([45.0, 60.0, 72.0]) + 5 * normal("age")).alias("age"), F.when(~gap("bmi"), at([23.0, 29.0, 34.0]) + 2 * normal("bmi")).alias("bmi"), F.when(~gap("glucose"), at([90.0, 125.0, 165.0]) + 9 * normal("glucose")).alias("glucose"), (at([112.0, 130.0, 150.0]) + 7 * normal("sbp")).alias("sbp"),
        (u("sex") < 0.5).cast("int").alias("sex_male"), (u("smoker") < at([0.1, 0.3, 0.5])).cast("int").alias("smoker"), F.when(~gap("race"), F.element_at(F.array(*map(F.lit, ["A", "B", "C"])), (u("race") * 3).cast("int") + 1)).alias("race"), F.element_at(F.array(*map(F.lit, ["north", "south"])), (u("site") * 2).cast("int") + 1).alias("site"), g.alias("true_group"),
    )
