"""Weighted consensus of label runs.

Rows with the same labels in all runs behave alike, so everything is computed over distinct label vectors (signatures) and their
counts: pairs of signatures instead of pairs of rows. Rows that are noise in every run have one signature too: nothing tells them apart,
and a cut puts them together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signatures(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sig_id, labels, n, first_row) and (row_idx, sig_id); sig_id is the hash of the vector, labels are in run order."""
    vectors = runs.groupBy("row_idx").agg(F.sort_array(F.collect_list(F.struct("run_id", "label"))).alias("v")).select("row_idx", F.col("v.label").alias("labels"))
    vectors = vectors.withColumn("sig_id", F.xxhash64("labels"))
    return vectors.groupBy("sig_id").agg(F.first("labels").alias("labels"), F.count("*").alias("n"), F.min("row_idx").alias("first_row")), vectors.select("row_idx", "sig_id")


def _weights(weights: list[float]):
    return F.array(*[F.lit(float(w)) for w in weights])


def _agreement(a: str, b: str, weights: list[float]):
    """Weight of runs where both are in the same cluster over the weight of runs where both are in one; 0 if there is none."""
    return _agreement_with(F.col(a), F.col(b), weights)


def _agreement_with(a: Column, b: Column, weights: list[float]) -> Column:
    z = F.zip_with(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), _weights(weights), lambda x, w: F.struct(x["a"].alias("a"), x["b"].alias("b"), w.alias("w")))
    both = lambda x: (x["a"] >= 0) & (x["b"] >= 0)
    same = F.aggregate(z, F.lit(0.0), lambda s, x: s + F.when(both(x) & (x["a"] == x["b"]), x["w"]).otherwise(0.0))
    seen = F.aggregate(z, F.lit(0.0), lambda s, x: s + F.when(both(x), x["w"]).otherwise(0.0))
    return F.when(seen > 0, same / seen).otherwise(0.0)


def signature_agreement(sigs: DataFrame, weights: list[float]) -> DataFrame:
    """(i, j, ni, nj, c) over all pairs of signatures. Their number depends on the runs' clusters, not on the rows: a cut takes `MOST_SIGNATURES`."""
    a = sigs.select(F.col("sig_id").alias("i"), F.col("labels").alias("_a"), F.col("n").alias("ni"))
    b = sigs.select(F.col("sig_id").alias("j"), F.col("labels").alias("_b"), F.col("n").alias("nj"))
    return a.crossJoin(b).select("i", "j", "ni", "nj", _agreement("_a", "_b", weights).alias("c"))


#: Pairs of rows that a task of coassociation() writes, about.
PAIRS = 10_000_000


def coassociation(runs: DataFrame, weights: list[float], digits: int | None = None) -> DataFrame:
    """(i, j, c) for pairs of rows i < j, c rounded to digits if given; for export, as its size is the square of the rows.

    Each row carries its signature's agreement with all signatures, worked out once a signature, and meets every later row, which says where in that list
    it stands: a pair costs a comparison and a look-up. The later rows, two numbers each, are sent to every task."""
    sigs, rows = signatures(runs)
    spark = runs.sparkSession
    every = sigs.agg(F.sort_array(F.collect_list(F.struct("sig_id", "labels"))).alias("every"))
    lists = sigs.select("sig_id", F.col("labels").alias("_a")).crossJoin(F.broadcast(every))
    c = F.transform("every", lambda x: _agreement_with(F.col("_a"), x["labels"], weights))
    if digits is not None:
        c = F.transform(c, lambda x: F.round(x, digits) + 0.0)
    places = every.select(F.posexplode("every").alias("at", "s")).select("at", F.col("s.sig_id").alias("sig_id"))
    n = rows.count()
    tasks = max(1, min(10_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * n // 2 // PAIRS))))
    first = rows.join(lists.select("sig_id", c.alias("cs")), "sig_id").select(F.col("row_idx").alias("i"), "cs").repartition(tasks, "i")
    later = rows.join(places, "sig_id").select(F.col("row_idx").alias("j"), "at")
    return first.join(F.broadcast(later), F.col("i") < F.col("j")).select("i", "j", F.col("cs")[F.col("at")].alias("c"))


def uncertainty(runs: DataFrame, weights: list[float], labels: DataFrame, gap_below: float = 0.1, entropy_quantile: float = 0.9, eps: float = 1e-12) -> DataFrame:
    """Per row: support of its clusters, entropy, top two and their gap, and whether it is ambiguous.

    labels: (row_idx, consensus_label). Support of a cluster is the mean agreement with its members, itself included (1), over all
    clusters' sum. It depends on the signature and the own label alone: all is computed for these kinds of rows, the quantile is
    weighted by their counts, and the rows are joined to the result once.
    """
    sigs, rows = signatures(runs)
    placed = rows.join(labels, "row_idx")
    kinds = placed.groupBy("sig_id", "consensus_label").agg(F.count("*").alias("m"))
    sizes = kinds.groupBy("consensus_label").agg(F.sum("m").alias("size"))
    k = sizes.count()
    pairs = signature_agreement(sigs, weights).select("i", "j", "c")
    sums = pairs.join(kinds, F.col("j") == F.col("sig_id")).groupBy("i", "consensus_label").agg(F.sum(F.col("c") * F.col("m")).alias("total")).join(sizes, "consensus_label")
    totals = sums.groupBy("i").agg(F.collect_list(F.struct(F.col("consensus_label").alias("cluster"), "total", "size")).alias("sums"))
    # a row agrees with itself fully, which its signature may not say
    self_c = sigs.select("sig_id", _agreement("labels", "labels", weights).alias("self"))
    each = kinds.join(self_c, "sig_id").join(totals, F.col("sig_id") == F.col("i"))
    support = F.transform("sums", lambda x: (x["total"] + F.when(x["cluster"] == F.col("consensus_label"), 1 - F.col("self")).otherwise(0.0)) / x["size"])
    each = each.withColumn("s", support).withColumn("t", F.aggregate("s", F.lit(0.0), lambda a, x: a + x))
    each = each.withColumn("ps", F.sort_array(F.transform("s", lambda x: F.when(F.col("t") > 0, x / F.col("t")).otherwise(1.0 / k)), asc=False))
    entropy = F.greatest(-F.aggregate("ps", F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log(p)).otherwise(0.0)), F.lit(0.0))
    out = each.select("sig_id", "consensus_label", "m", entropy.alias("entropy"), (entropy / (np.log(k) if k > 1 else 1.0)).alias("normalized_entropy"), F.col("ps")[0].alias("top1"), F.coalesce(F.get("ps", F.lit(1)), F.lit(0.0)).alias("top2"))
    out = out.withColumn("gap", F.col("top1") - F.col("top2") if k > 1 else F.lit(1.0))
    limit = out.agg(F.percentile("entropy", entropy_quantile, F.col("m")).alias("_q"))
    judged = out.crossJoin(limit).withColumn("ambiguous", (F.col("gap") < gap_below) | ((F.col("entropy") > eps) & (F.col("entropy") >= F.col("_q") - 1e-12))).drop("_q", "m")
    return placed.join(judged, ["sig_id", "consensus_label"]).select("row_idx", "consensus_label", "entropy", "normalized_entropy", "top1", "top2", "gap", "ambiguous")


def cluster_summary(runs: DataFrame, weights: list[float], labels: DataFrame, certain: DataFrame) -> DataFrame:
    """Per consensus cluster: size, mean agreement of its pairs (a single row 1), entropy and share of ambiguous rows."""
    sigs, rows = signatures(runs)
    m = rows.join(labels, "row_idx").groupBy("consensus_label", "sig_id").agg(F.count("*").alias("m"))
    a = m.select("consensus_label", F.col("sig_id").alias("i"), F.col("m").alias("ma"))
    b = m.select("consensus_label", F.col("sig_id").alias("j"), F.col("m").alias("mb"))
    pairs = signature_agreement(sigs, weights).select("i", "j", "c")
    both = a.join(b, "consensus_label").join(pairs, ["i", "j"])
    # of a signature with itself only distinct rows count
    count = F.col("ma") * F.col("mb") - F.when(F.col("i") == F.col("j"), F.col("ma")).otherwise(0)
    within = both.groupBy("consensus_label").agg(F.sum(count).alias("n"), F.sum(F.col("c") * count).alias("s")).select("consensus_label", F.when(F.col("n") == 0, 1.0).otherwise(F.col("s") / F.col("n")).alias("mean_within"))
    stats = certain.groupBy("consensus_label").agg(F.count("*").alias("size"), F.percentile("entropy", 0.5).alias("median_entropy"), F.avg("entropy").alias("mean_entropy"), F.avg(F.col("ambiguous").cast("double")).alias("ambiguous_fraction"))
    return stats.join(within, "consensus_label")


def average_linkage_cut(distance: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Labels 0 .. k - 1 of a weighted average-linkage tree cut at k clusters."""
    n = len(size)
    d, weight, alive = distance.astype(float).copy(), size.astype(float).copy(), np.ones(n, bool)
    np.fill_diagonal(d, np.inf)
    member = np.arange(n)
    for _ in range(n - min(k, n)):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = (d[i] * weight[i] + d[j] * weight[j]) / (weight[i] + weight[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        weight[i] += weight[j]
        alive[j] = False
        member[member == j] = i
    return np.unique(member, return_inverse=True)[1]


#: Signatures that a cut takes: its matrices of doubles are their square.
MOST_SIGNATURES = 10_000


def _signature_list(runs: DataFrame, most: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(row_idx, sig_id), and of all signatures in the order of their first rows: ids, label vectors, row counts."""
    sigs, rows = signatures(runs)
    n = sigs.count()
    if n > most:
        raise RuntimeError(f"{n} distinct label vectors; a cut takes {most} at most")
    order = sigs.orderBy("first_row").select("sig_id", "labels", "n").collect()
    return rows, np.array([r.sig_id for r in order], np.int64), np.array([r.labels for r in order]).reshape(len(order), -1), np.array([r.n for r in order])


def agreement_matrix(labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Agreement of all pairs of signatures, run by run: two matrices of doubles, whatever the number of runs."""
    n = len(labels)
    same, seen = np.zeros((n, n)), np.zeros((n, n))
    for run, w in zip(labels.T, weights, strict=True):
        real = np.flatnonzero(run >= 0)
        seen[np.ix_(real, real)] += w
        for label in np.unique(run[real]):
            own = np.flatnonzero(run == label)
            same[np.ix_(own, own)] += w
    np.divide(same, seen, out=same, where=seen > 0)
    np.fill_diagonal(same, 1)
    return same


def cut_signatures(agreement: np.ndarray, size: np.ndarray, k: int, method: str = "hierarchical") -> np.ndarray:
    if method.startswith("spectral"):
        from tessera.functions.kernels import spectral_cut

        return spectral_cut(agreement, k, size)
    return average_linkage_cut(1 - agreement, size, k)


def consensus_labels(runs: DataFrame, weights: list[float], k: int, method: str = "hierarchical", most: int = MOST_SIGNATURES) -> DataFrame:
    """(row_idx, consensus_label): average linkage or spectral cut of the signatures' agreement."""
    rows, ids, lab, size = _signature_list(runs, most)
    cut = cut_signatures(agreement_matrix(lab, np.array(weights, float)), size, k, method)
    names = runs.sparkSession.createDataFrame(pd.DataFrame({"sig_id": ids, "consensus_label": cut.astype(np.int32)}), "sig_id long, consensus_label int")
    return rows.join(F.broadcast(names), "sig_id").select("row_idx", "consensus_label")


def weighted_silhouette(distance: np.ndarray, size: np.ndarray, cut: np.ndarray) -> float:
    """Mean silhouette over the rows that signatures stand for; a row alone in its cluster counts 0."""
    known = np.unique(cut)
    mass = np.stack([distance[:, cut == c] @ size[cut == c] for c in known], axis=1)
    count = np.array([size[cut == c].sum() for c in known])
    own = np.searchsorted(known, cut)
    row = np.arange(len(cut))
    a = mass[row, own] / np.maximum(1, count[own] - 1)
    away = mass / count
    away[row, own] = np.inf
    b = away.min(1)
    top = np.maximum(a, b)
    s = np.where((count[own] == 1) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1, top))
    return float((s * size).sum() / size.sum())


def data_driven_k(runs: DataFrame, weights: list[float], counts: list[int], method: str = "hierarchical", most: int = MOST_SIGNATURES) -> tuple[int, dict[int, float]]:
    """The number of clusters, of those that runs have, whose cut has the best silhouette over distances 1 - agreement; the smallest on
    ties. Also the silhouette of each."""
    ks = sorted({int(k) for k in counts if int(k) >= 2})
    if len(ks) == 1:
        return ks[0], {}
    _, _, lab, size = _signature_list(runs, most)
    c = agreement_matrix(lab, np.array(weights, float))
    scores = {}
    for k in ks:
        cut = cut_signatures(c, size, k, method)
        if len(np.unique(cut)) > 1:
            scores[k] = weighted_silhouette(1 - c, size, cut)
    best = max(scores, key=lambda k: (round(scores[k], 12), -k)) if scores else ks[0]
    return best, scores


def run_bootstrap(runs: DataFrame, weights: list[float], k: int, repeats: int = 25, seed: int = 0, method: str = "hierarchical", most: int = MOST_SIGNATURES) -> DataFrame:
    """Per consensus cluster the best-match Jaccard index over refits with resampled runs: mean, spread (ddof 0), repeats.

    Without repeats every cluster has a row with a mean and spread of 0. The label vectors, bounded by `most`, go to the refits."""
    _, _, lab, size = _signature_list(runs, most)
    spark, given = runs.sparkSession, np.array(weights, float)
    reference = cut_signatures(agreement_matrix(lab, given), size, k, method)
    known = spark.createDataFrame([(int(c),) for c in np.unique(reference)], "consensus_label int")

    def refit(frames):
        for f in frames:
            for r in f.id:
                rng = np.random.default_rng([seed, int(r)])
                drawn = np.bincount(rng.integers(0, len(given), len(given)), minlength=len(given)) * given
                other = cut_signatures(agreement_matrix(lab, drawn / max(1e-12, drawn.sum())), size, k, method)
                both = np.zeros((reference.max() + 1, other.max() + 1))
                np.add.at(both, (reference, other), size)
                union = both.sum(1)[:, None] + both.sum(0)[None] - both
                best = (both / np.maximum(union, 1)).max(1)
                yield pd.DataFrame({"consensus_label": np.arange(len(best), dtype=np.int32), "jaccard": best})

    if not repeats:
        return known.select("consensus_label", F.lit(0.0).alias("jaccard_mean"), F.lit(0.0).alias("jaccard_sd"), F.lit(0).cast("long").alias("repeats"))
    refits = spark.range(repeats).repartition(min(repeats, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(refit, "consensus_label int, jaccard double")
    return refits.groupBy("consensus_label").agg(F.avg("jaccard").alias("jaccard_mean"), F.stddev_pop("jaccard").alias("jaccard_sd"), F.count("*").alias("repeats"))
