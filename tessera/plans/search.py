"""Candidate search: grids, pilot and full runs of many (candidate, seed) fits as one Spark job each, metrics, registry."""

from __future__ import annotations

import itertools
import json
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.kernels import fit_predict, internal_quality, represent
from tessera.operators import labels as L
from tessera.operators import sampling as S
from tessera.sources.tables import stable_id

#: Values of a feature matrix that is sent along to the fits (8 bytes each); larger tables use kmeans_distributed.
MOST_VALUES = 20_000_000


def expand(params: dict) -> list[dict]:
    """Lists are axes, other values are fixed."""
    keys = list(params)
    return [dict(zip(keys, v, strict=True)) for v in itertools.product(*[params[k] if isinstance(params[k], list) else [params[k]] for k in keys])]


def candidate_grid(transforms: list[str], encodings: list[str], representations: list[dict], clusterers: list[dict], dataset: dict | None = None) -> list[dict]:
    """Every combination, in order; the id names the combination and, if given, the dataset. The family is the clusterer."""
    out = []
    for t, e, r, c in itertools.product(transforms, encodings, representations, clusterers):
        for rp, cp in itertools.product(expand(r.get("params", {})), expand(c.get("params", {}))):
            spec = {"transform": t, "encoding": e, "representation": r["name"], "representation_params": rp, "clusterer": c["name"], "clusterer_params": cp}
            out.append(spec | {"candidate_id": stable_id([spec, dataset]), "family": c["name"]})
    return out


REGISTRY = "candidate_id string, family string, continuous_transform string, categorical_encoding string, representation_name string, representation_params_json string, clustering_name string, clustering_params_json string"


def registry(spark: SparkSession, candidates: list[dict]) -> DataFrame:
    rows = [(c["candidate_id"], c["family"], c["transform"], c["encoding"], c["representation"], json.dumps(c["representation_params"], sort_keys=True), c["clusterer"], json.dumps(c["clusterer_params"], sort_keys=True)) for c in candidates]
    return spark.createDataFrame(rows, REGISTRY)


INTERNAL = ("silhouette", "davies_bouldin", "calinski_harabasz")


def fit_table(points: DataFrame, candidates: DataFrame, seeds: list[int], quality: bool = False) -> DataFrame:
    """(candidate_id, run_id, row_idx, label, facts): every candidate with every seed, a task a fit.

    A fit's facts (seconds, what the method tells of itself and, with quality, the internal metrics in the space that was clustered and
    in that of the points) stand on one row with row_idx -1. The matrix is sent to every executor: `MOST_VALUES` bounds it."""
    spark = points.sparkSession
    rows, wide = points.agg(F.count("*"), F.max(F.size("features"))).first()
    if rows * (wide or 0) > MOST_VALUES:
        raise ValueError(f"a matrix of {rows} x {wide} is too large to send to every fit; use kmeans_distributed or a pilot sample")
    values, rows_idx = _matrix(points, rows, wide or 0)
    x, ids = spark.sparkContext.broadcast(values), spark.sparkContext.broadcast(rows_idx)
    del values, rows_idx
    jobs = candidates.select("candidate_id", "representation_name", "representation_params_json", "clustering_name", "clustering_params_json").crossJoin(spark.createDataFrame([(s,) for s in seeds], "run_id int"))
    count = candidates.count() * len(seeds)

    def fit(batches):
        for r in (r for b in batches for r in b.to_pylist()):
            began, data = time.perf_counter(), x.value
            z = represent(r["representation_name"], data, json.loads(r["representation_params_json"]), r["run_id"])
            lab, meta = fit_predict(r["clustering_name"], z, json.loads(r["clustering_params_json"]), r["run_id"])
            facts = {"runtime_seconds": time.perf_counter() - began}
            space = meta.pop("space", z)
            facts |= {k: float(v) for k, v in meta.items() if isinstance(v, int | float)}
            if quality:
                own = internal_quality(data, lab)
                inside = own if space is data else internal_quality(space, lab)
                facts |= {f"{k}_original_space": v for k, v in own.items()} | {f"{k}_cluster_space": v for k, v in inside.items()} | inside
            yield _fitted(r, np.array([-1]), np.zeros(1), pa.array([facts], FACTS))
            for at in range(0, len(lab), ROWS):
                part = ids.value[at : at + ROWS]
                yield _fitted(r, part, lab[at : at + ROWS], pa.nulls(len(part), FACTS))

    return jobs.repartition(max(1, min(count, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(fit, "candidate_id string, run_id int, row_idx long, label int, facts map<string,double>")


#: Rows of a fit's result that are handed to Spark at a time.
ROWS = 1 << 16
FACTS = pa.map_(pa.string(), pa.float64())


def _fitted(job: dict, rows: np.ndarray, labels: np.ndarray, facts: pa.Array) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(job["candidate_id"]), n), pa.repeat(pa.scalar(job["run_id"], pa.int32()), n), pa.array(rows, pa.int64()), pa.array(labels.astype(np.int32)), facts], names=["candidate_id", "run_id", "row_idx", "label", "facts"])


def _matrix(points: DataFrame, rows: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The features by row_idx, and row_idx: the driver gets them as blocks of doubles, partition by partition, and never as rows."""

    def pack(batches):
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                features = part.column(1)
                if features.null_count or len(features.flatten()) != len(features) * wide:
                    raise ValueError(f"every row needs {wide} features")
                x = features.flatten().to_numpy(zero_copy_only=False).astype(float)
                yield pa.record_batch([pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()]), pa.array([x.tobytes()])], names=["ids", "x"])

    x, ids, at = np.empty((rows, wide)), np.empty(rows, np.int64), 0
    blocks = points.select(F.col("row_idx").cast("long").alias("row_idx"), F.col("features").cast("array<double>").alias("features")).orderBy("row_idx").mapInArrow(pack, "ids binary, x binary")
    for r in blocks.toLocalIterator():
        part = np.frombuffer(r.ids, np.int64)
        ids[at : at + len(part)] = part
        x[at : at + len(part)] = np.frombuffer(r.x).reshape(len(part), wide)
        at += len(part)
    if at != rows:
        raise RuntimeError(f"{rows} rows were counted and {at} read: the table changed meanwhile")
    return x, ids


def run_fits(points: DataFrame, candidates: DataFrame, seeds: list[int]) -> DataFrame:
    """(candidate_id, run_id, row_idx, label) of every candidate with every seed."""
    return fit_table(points, candidates, seeds).where("row_idx >= 0").drop("facts")


def fit_facts(fits: DataFrame) -> DataFrame:
    return fits.where("row_idx < 0").select("candidate_id", "run_id", "facts")


def pair_agreement(runs: DataFrame) -> DataFrame:
    """(candidate_id, run_a, run_b, ari, nmi) of every two runs of a candidate."""
    # the rows are met once: of each candidate the distinct label vectors are counted, and their pairs of runs are taken apart
    vectors = runs.groupBy("candidate_id", "row_idx").agg(F.sort_array(F.collect_list(F.struct("run_id", "label"))).alias("v")).groupBy("candidate_id", "v").agg(F.count("*").alias("m"))
    two = lambda a: F.transform(F.filter("v", lambda b: b["run_id"] > a["run_id"]), lambda b: F.struct(a["run_id"].alias("a"), b["run_id"].alias("b"), a["label"].alias("la"), b["label"].alias("lb")))
    pairs = vectors.select("candidate_id", "m", F.explode(F.flatten(F.transform("v", two))).alias("p")).select("candidate_id", "m", "p.*")
    name = lambda c: F.concat_ws("/", "candidate_id", c)
    cells = pairs.groupBy(name("a").alias("run_a"), name("b").alias("run_b"), "la", "lb").agg(F.sum("m").alias("n"))
    part = lambda c, i: F.element_at(F.split(c, "/"), i)
    return L.ari_nmi(cells).select(part("run_a", 1).alias("candidate_id"), part("run_a", 2).cast("int").alias("run_a"), part("run_b", 2).cast("int").alias("run_b"), "ari", "nmi")


def stability(runs: DataFrame) -> DataFrame:
    """Mean ARI and NMI over the seed pairs of each candidate."""
    return pair_agreement(runs).groupBy("candidate_id").agg(F.avg("ari").alias("ari_seed"), F.avg("nmi").alias("nmi_seed"))


def representative_seeds(runs: DataFrame, seeds: list[int]) -> DataFrame:
    """(candidate_id, representative_seed, representative_seed_mean_ari_to_others): the seed whose labels agree best with the others', the
    first in the given order on ties; a single seed agrees fully."""
    pairs = pair_agreement(runs)
    both = pairs.select("candidate_id", F.col("run_a").alias("run_id"), "ari").union(pairs.select("candidate_id", F.col("run_b").alias("run_id"), "ari"))
    mean = runs.select("candidate_id", "run_id").distinct().join(both.groupBy("candidate_id", "run_id").agg(F.avg("ari").alias("mean")), ["candidate_id", "run_id"], "left")
    place = F.array_position(F.array(*map(F.lit, seeds)), F.col("run_id"))
    best = F.max(F.struct(F.round(F.coalesce("mean", F.lit(1.0)), 12).alias("mean"), (-place).alias("place"), "run_id")).alias("r")
    return mean.groupBy("candidate_id").agg(best).select("candidate_id", F.col("r.run_id").alias("representative_seed"), F.col("r.mean").alias("representative_seed_mean_ari_to_others"))


def perturbation_draws(rows: DataFrame, kind: str, seed: int, run: int) -> DataFrame:
    """(draw_idx, row_idx): n draws with replacement, repeats included, or four fifths of the rows once each."""
    n = rows.count()
    if kind == "bootstrap":
        return S.bootstrap_draws(rows, n, seed, run)
    some = S.subsample(rows.select("row_idx"), "row_idx", seed, run)
    return some.select(F.col("row_idx").alias("draw_idx"), "row_idx")


def perturbation_agreement(reference: DataFrame, drawn: DataFrame) -> DataFrame:
    """(candidate_id, mean_cluster_jaccard, mean_cluster_jaccard_symmetric, perturbation_rows_compared_mean).

    reference (candidate_id, row_idx, label); drawn (candidate_id, run_id, draw_idx, row_idx, label), of which a row's first draw counts. Both
    means are of the symmetric index, as a one-sided one would hide clusters that were merged."""
    key = F.concat_ws("/", "candidate_id", "run_id")
    first = L.align_perturbation(drawn.select(key.alias("run_id"), "draw_idx", "row_idx", "label")).select(F.element_at(F.split("run_id", "/"), 1).alias("candidate_id"), F.col("run_id").alias("run_b"), "row_idx", F.col("label").alias("lb"))
    cells = reference.select("candidate_id", "row_idx", F.col("label").alias("la")).join(first, ["candidate_id", "row_idx"]).groupBy(F.col("candidate_id").alias("run_a"), "run_b", "la", "lb").agg(F.count("*").alias("n"))
    compared = cells.groupBy("run_a", "run_b").agg(F.sum("n").alias("rows"))
    got = L.jaccard_symmetric(cells).join(compared, ["run_a", "run_b"])
    return got.groupBy(F.col("run_a").alias("candidate_id")).agg(F.avg("jaccard").alias("mean_cluster_jaccard"), F.avg("jaccard").alias("mean_cluster_jaccard_symmetric"), F.avg("rows").alias("perturbation_rows_compared_mean"))


def seed_metrics(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """A row per candidate: of every metric in both spaces and of the structure the median over the seeds under its own name, and
    _median, _mean and _sd; runtime_seconds over all seeds; means of what else the fits tell, as metadata."""
    named = runs.select(F.concat_ws("/", "candidate_id", "run_id").alias("run_id"), "row_idx", "label")
    split = F.split("run_id", "/")
    structure = L.structure_summary(named).join(L.min_fraction(named), "run_id").join(L.cluster_balance(named), "run_id").withColumn("candidate_id", F.element_at(split, 1)).withColumn("run_id", F.element_at(split, 2).cast("int"))
    inner = [f"{m}{space}" for m in INTERNAL for space in ("", "_cluster_space", "_original_space")]
    shape = [c for c in structure.columns if c not in ("candidate_id", "run_id")]
    per_run = structure.join(facts, ["candidate_id", "run_id"]).select("candidate_id", *[F.col(c).cast("double").alias(c) for c in shape], *[F.col("facts")[m].alias(m) for m in inner])
    summary = L.seed_summary(per_run, [*shape, *inner], ["candidate_id"])
    summary = summary.withColumns({m: F.col(f"{m}_median") for m in [*shape, *inner]})
    told = facts.select("candidate_id", F.explode("facts").alias("name", "value")).where(~F.col("name").isin("runtime_seconds", *inner))
    means = told.groupBy("candidate_id", "name").agg(F.avg("value").alias("value")).groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("metadata"))
    seconds = facts.groupBy("candidate_id").agg(F.sum(F.col("facts")["runtime_seconds"]).alias("runtime_seconds"), F.count("*").cast("double").alias("seed_runs"))
    out = summary.join(seconds, "candidate_id").join(means, "candidate_id", "left")
    return out.withColumns({m: F.col("metadata")[m] for m in ("average_confidence", "assignment_entropy", "reconstruction_loss")})


def kmeans_distributed(points: DataFrame, k: int, seed: int, rounds: int = 20) -> DataFrame:
    """(row_idx, label) by Spark's own k-means, for tables of any size."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = points.select("row_idx", array_to_vector("features").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=rounds).fit(v).transform(v).select("row_idx", F.col("prediction").alias("label"))


def ask_tell(space: dict[str, list], trials: int, evaluate, seed: int = 0, startup: int = 5) -> list[dict]:
    """A study over categorical choices: random at first, then choices that the better half favours; a batch is one evaluate() call.

    evaluate: list of parameter dicts -> list of scores (None: pruned)."""
    r, done = np.random.default_rng(seed), []
    while len(done) < trials:
        batch = []
        for _ in range(min(startup, trials - len(done))):
            scored = sorted((d for d in done if d["score"] is not None), key=lambda d: -d["score"])
            good, p = scored[: max(1, len(scored) // 2)], {}
            for name, values in space.items():
                weight = np.ones(len(values))
                if len(scored) >= startup:
                    for d in good:
                        weight[values.index(d["params"][name])] += 1
                p[name] = values[r.choice(len(values), p=weight / weight.sum())]
            batch.append(p)
        scores = evaluate(batch)
        seen = [d["score"] for d in done if d["score"] is not None]
        median = float(np.median(seen)) if seen else None
        for p, s in zip(batch, scores, strict=True):
            done.append({"trial": len(done), "params": p, "score": s, "below_median": bool(s is not None and median is not None and s < median)})
    return done
