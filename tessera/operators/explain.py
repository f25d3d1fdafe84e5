"""What clusters are made of: profiles, pairwise contrasts with effect sizes, surrogate models and permutation importance."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import draw, folds, hashed_rank


def profiles(df: DataFrame, label: str, continuous: list[str] = (), binary: list[str] = (), categorical: list[str] = ()) -> DataFrame:
    """(cluster, feature, kind, value, value_num): means, prevalences, and modes (smallest on ties, 'unknown' if all are null)."""
    aggs, parts = [], []
    for kind, cols in (("mean", continuous), ("prevalence", binary)):
        for c in cols:
            aggs.append(F.avg(F.col(c).cast("double")).alias(f"v_{c}"))
            parts.append(F.struct(F.lit(c).alias("feature"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("value"), F.col(f"v_{c}").alias("value_num")))
    for c in categorical:
        aggs.append(F.coalesce(F.mode(F.col(c).cast("string"), True), F.lit("unknown")).alias(f"v_{c}"))
        parts.append(F.struct(F.lit(c).alias("feature"), F.lit("mode").alias("kind"), F.col(f"v_{c}").alias("value"), F.lit(None).cast("double").alias("value_num")))
    got = df.groupBy(F.col(label).alias("cluster")).agg(*aggs)
    return got.select("cluster", F.explode(F.array(*parts)).alias("p")).select("cluster", "p.*")


def cohens_h(p1: Column, p2: Column) -> Column:
    angle = lambda p: 2 * F.asin(F.sqrt(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))))
    return F.when(p1.isNotNull() & p2.isNotNull(), angle(p1) - angle(p2))


def contrasts(df: DataFrame, label: str, continuous: list[str] = (), binary: list[str] = (), categorical: list[str] = ()) -> DataFrame:
    """(cluster_a, cluster_b, feature, difference, effect_size, comparison): Cohen's d with spread pooled over all rows of both clusters,
    nulls counted, 0 where the spread is 0; Cohen's h for shares; for categories the modes as 'a vs b' and 0 where they are equal, else 1.

    The clusters' statistics are one aggregation; pairs of clusters meet, never rows."""
    aggs = [F.count("*").alias("n")]
    for c in continuous:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}")]
    aggs += [F.avg(F.col(c).cast("double")).alias(f"p_{c}") for c in binary]
    aggs += [F.coalesce(F.mode(F.col(c).cast("string"), True), F.lit("unknown")).alias(f"t_{c}") for c in categorical]
    g = df.groupBy(F.col(label).alias("cluster")).agg(*aggs)
    a, b = (g.select(*[F.col(c).alias(f"{c}_{s}") for c in g.columns]) for s in "ab")
    j = a.join(b, F.col("cluster_a") < F.col("cluster_b"))
    no = F.lit(None).cast("string").alias("comparison")
    parts = []
    for c in continuous:
        diff = F.col(f"m_{c}_a") - F.col(f"m_{c}_b")
        var = lambda s: (F.col(f"n_{s}") - 1) * F.pow(F.col(f"s_{c}_{s}"), 2)  # noqa: E731, B023
        pooled = F.sqrt((var("a") + var("b")) / F.nullif(F.col("n_a") + F.col("n_b") - 2, F.lit(0)))
        parts.append(F.struct(F.lit(c).alias("feature"), diff.alias("difference"), F.when(pooled == 0, 0.0).otherwise(diff / F.nullif(pooled, F.lit(0.0))).alias("effect_size"), no))
    for c in binary:
        x, y = F.col(f"p_{c}_a"), F.col(f"p_{c}_b")
        parts.append(F.struct(F.lit(c).alias("feature"), (x - y).alias("difference"), cohens_h(x, y).alias("effect_size"), no))
    for c in categorical:
        x, y = F.col(f"t_{c}_a"), F.col(f"t_{c}_b")
        apart = F.when(x == y, 0.0).otherwise(1.0)
        parts.append(F.struct(F.lit(c).alias("feature"), apart.alias("difference"), apart.alias("effect_size"), F.concat_ws(" vs ", x, y).alias("comparison")))
    return j.select("cluster_a", "cluster_b", F.explode(F.array(*parts)).alias("p")).select("cluster_a", "cluster_b", "p.*")


def fold_metrics(cells: DataFrame) -> DataFrame:
    """(fold, actual, predicted, n) -> accuracy, macro F1 and balanced accuracy per fold."""
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    act = cells.groupBy("fold", F.col("actual").alias("c")).agg(F.sum("n").alias("na"), right.alias("tp"))
    pred = cells.groupBy("fold", F.col("predicted").alias("c")).agg(F.sum("n").alias("np"))
    j = act.join(pred, ["fold", "c"], "full").fillna(0, ["na", "tp", "np"])
    f1 = F.when(F.col("na") + F.col("np") > 0, 2 * F.col("tp") / (F.col("na") + F.col("np")))
    return j.groupBy("fold").agg((F.sum("tp") / F.sum("na")).alias("accuracy"), F.avg(f1).alias("macro_f1"), F.avg(F.when(F.col("na") > 0, F.col("tp") / F.col("na"))).alias("balanced_accuracy"))


def _vectors(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_v", array_to_vector("features"))


def _surrogate(kind: str, trees: int, seed: int):
    """A balanced classifier of the clusters: a random forest, or boosted trees, one ensemble a cluster."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier

    if kind == "xgboost":
        boosted = GBTClassifier(featuresCol="_v", labelCol="label", maxIter=max(5, trees // 5), maxDepth=4, stepSize=0.2, seed=seed)
        return OneVsRest(classifier=boosted, featuresCol="_v", labelCol="label", predictionCol="predicted", rawPredictionCol="_p", weightCol="_w")
    return RandomForestClassifier(featuresCol="_v", labelCol="label", predictionCol="predicted", probabilityCol="_p", numTrees=trees, maxDepth=12, seed=seed, weightCol="_w")


def _weighted(df: DataFrame) -> DataFrame:
    counts = df.groupBy("label").agg(F.count("*").alias("_c"))
    total = df.count()
    k = counts.count()
    return df.join(F.broadcast(counts), "label").withColumn("_w", F.lit(total) / (F.lit(k) * F.col("_c"))).drop("_c")


def surrogate_cv(df: DataFrame, key: str, k: int = 5, repeats: int = 1, trees: int = 50, seed: int = 0, kind: str = "random_forest") -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions of a balanced surrogate over (key, features, label): fold metrics and pooled confusion.

    Fewer folds where a class is small; with fewer than two, which a warning tells, one row of NaN stands for the folds."""
    least = df.groupBy("label").count().agg(F.min("count")).first()[0] or 0
    k = min(k, least)
    if k < 2:
        warnings.warn("a class has too few rows for two folds; the surrogate is not evaluated", stacklevel=2)
        none = [(-1, float("nan"), float("nan"), float("nan"))]
        return df.sparkSession.createDataFrame(none, "fold int, accuracy double, macro_f1 double, balanced_accuracy double"), df.sparkSession.createDataFrame([], "actual int, predicted int, n long")
    cells = None
    for r in range(repeats):
        dealt = _vectors(folds(df, key, "label", k, seed, r)).persist()
        for f in range(k):
            model = _surrogate(kind, trees, seed + r * k + f).fit(_weighted(dealt.where(F.col("fold") != f)))
            got = model.transform(dealt.where(F.col("fold") == f)).groupBy(F.col("label").alias("actual"), F.col("predicted").cast("int").alias("predicted")).agg(F.count("*").alias("n")).withColumn("fold", F.lit(r * k + f))
            cells = got if cells is None else cells.union(got)
    return fold_metrics(cells), cells.groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


def permute(df: DataFrame, key: str, features: list[int], seed: int, repeat: int) -> DataFrame:
    """features with these places taken from another row: rows are matched by their ranks in two hashed orders."""
    a = hashed_rank(df, draw(seed, -1, F.col(key)), key, name="_r")
    b = hashed_rank(df, draw(seed, repeat, F.col(key)), key, name="_r").select("_r", F.col("features").alias("_other"))
    mixed = F.transform("features", lambda x, i: F.when(i.isin(features), F.get("_other", i)).otherwise(x))
    return a.join(b, "_r").withColumn("features", mixed).drop("_r", "_other")


def permutation_importance(df: DataFrame, key: str, groups: dict[str, list[int]], trees: int = 50, repeats: int = 3, seed: int = 0, kind: str = "random_forest") -> DataFrame:
    """(feature, importance_mean, importance_sd): loss of accuracy when a feature, or a group of them jointly, is permuted."""
    model = _surrogate(kind, trees, seed).fit(_weighted(_vectors(df)))
    right = lambda x: model.transform(_vectors(x)).agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("acc"))
    base = right(df).first()[0]
    rows = None
    for name, places in groups.items():
        for r in range(repeats):
            got = right(permute(df, key, places, seed, r)).select(F.lit(name).alias("feature"), (F.lit(base) - F.col("acc")).alias("drop"))
            rows = got if rows is None else rows.union(got)
    return rows.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_sd"))


def heldout_importance(df: DataFrame, key: str, names: list[str], k: int = 5, repeats: int = 1, trees: int = 50, draws: int = 3, seed: int = 0, kind: str = "random_forest") -> DataFrame:
    """(feature, importance_mean, importance_sd, fold_count): loss of accuracy on the rows that a fold's surrogate has not seen, when a
    feature is permuted among them; the spread is over folds (ddof 1, a single fold 0). Too few rows of a class for two folds give zeros."""
    least = df.groupBy("label").count().agg(F.min("count")).first()[0] or 0
    k = min(k, least)
    if k < 2:
        return df.sparkSession.createDataFrame([(n, 0.0, 0.0, 0) for n in names], "feature string, importance_mean double, importance_sd double, fold_count int")
    rows = None
    for r in range(repeats):
        dealt = folds(df, key, "label", k, seed, r)
        for f in range(k):
            at = seed + r * k + f
            model = _surrogate(kind, trees, at).fit(_weighted(_vectors(dealt.where(F.col("fold") != f))))
            unseen = dealt.where(F.col("fold") == f).drop("fold").persist()
            # all features' permutations of a fold are scored in one pass
            mixed = unseen.withColumn("feature", F.lit("")).withColumn("draw", F.lit(0))
            for i, name in enumerate(names):
                for d in range(draws):
                    mixed = mixed.unionByName(permute(unseen, key, [i], at, d).withColumn("feature", F.lit(name)).withColumn("draw", F.lit(d)).select(mixed.columns))
            acc = model.transform(_vectors(mixed)).groupBy("feature").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("acc"))
            got = {x.feature: x.acc for x in acc.collect()}
            unseen.unpersist()
            part = [(n, float(got[""] - got[n]), r * k + f) for n in names]
            rows = part if rows is None else rows + part
    table = df.sparkSession.createDataFrame(rows, "feature string, drop double, fold int")
    return table.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.coalesce(F.stddev_samp("drop"), F.lit(0.0)).alias("importance_sd"), F.count("*").cast("int").alias("fold_count"))


def surrogate_shapley(df: DataFrame, names: list[str], trees: int = 50, seed: int = 0, kind: str = "random_forest", permutations: int = 5, most: int = 200) -> DataFrame:
    """(feature, mean_abs_shapley): Monte-Carlo Shapley values of the surrogate's scores for the clusters, over `most` rows.

    A sampled row walks random orders of the features from another sampled row to itself; the steps are scored by the model as rows of
    a table, and a feature's value is the mean change of its steps, with its sign. Sizes are averaged over clusters and rows at last."""
    from pyspark.ml.functions import vector_to_array

    from .sampling import take_exact

    model = _surrogate(kind, trees, seed).fit(_weighted(_vectors(df)))
    sample = take_exact(df.select("row_idx", "features"), "row_idx", most, seed)
    background = np.array([r.features for r in sample.orderBy("row_idx").select("features").collect()])

    def walk(frames):
        for frame in frames:
            for key, x in zip(frame.row_idx, frame.features, strict=True):
                rng = np.random.default_rng([seed, int(key)])
                for p in range(permutations):
                    order, z = rng.permutation(len(names)), background[rng.integers(len(background))].copy()
                    steps = [z.copy()]
                    for j in order:
                        z[j] = x[j]
                        steps.append(z.copy())
                    yield pd.DataFrame({"row_idx": key, "walk": p, "step": np.arange(len(steps)), "feature": ["", *[names[j] for j in order]], "features": [list(map(float, s)) for s in steps]})

    path = sample.mapInPandas(walk, "row_idx long, walk int, step int, feature string, features array<double>")
    scored = model.transform(_vectors(path)).select("row_idx", "walk", "step", "feature", vector_to_array("_p").alias("p"))
    before = F.lag("p").over(Window.partitionBy("row_idx", "walk").orderBy("step"))
    change = scored.withColumn("change", F.zip_with("p", before, lambda a, b: a - b)).where("step > 0")
    values = change.select("row_idx", "feature", F.posexplode("change").alias("cluster", "v")).groupBy("row_idx", "feature", "cluster").agg(F.avg("v").alias("v"))
    return values.groupBy("feature").agg(F.avg(F.abs("v")).alias("mean_abs_shapley"))
