"""The clustering operators: DuckDB as the oracle, brute force in numpy, and hand-made cases."""

import itertools
import tracemalloc
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.config import ExperimentConfig, deep_merge, load_config
from tessera.functions import kernels as K
from tessera.functions import neighbours as N
from tessera.operators import consensus as C
from tessera.operators import explain as E
from tessera.operators import labels as L
from tessera.operators import preprocess as P
from tessera.operators import quality as Q
from tessera.operators import sampling as S
from tessera.operators import scoring as R
from tessera.plans import catalogue, search
from tessera.plans.experiment import Experiment
from tessera.sources import tables as T

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "-"
        return round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert str(plain(got)).replace("True", "1.0") == str(plain(want)).replace("True", "1.0")


def brute_matching(gain):
    """The best matching by trying all."""
    small, large = (gain, gain.T) if gain.shape[0] <= gain.shape[1] else (gain.T, gain)
    return max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))


def runs(spark, *labels):
    return spark.createDataFrame([(r, i, int(x)) for r, lab in enumerate(labels) for i, x in enumerate(lab)], "run_id int, row_idx long, label int")


def test_partition_metrics_by_hand(spark):
    same = L.ari_nmi(L.contingency(runs(spark, [0, 0, 1, 1], [1, 1, 0, 0]))).first()
    assert same.ari == pytest.approx(1) and same.nmi == pytest.approx(1)
    far = L.ari_nmi(L.contingency(runs(spark, [0, 0, 1, 1], [0, 1, 0, 1]))).first()
    assert far.ari == pytest.approx(-0.5) and far.nmi == pytest.approx(0, abs=1e-9)
    cells = L.contingency(runs(spark, [0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 1, 1, 2, 2, 2, 2]))
    assert L.jaccard_symmetric(cells).first().jaccard == pytest.approx((0.5 + 1) / 3)
    noise = L.jaccard_symmetric(L.contingency(runs(spark, [0, 0, 1], [-1, -1, -1]))).first()
    assert noise.jaccard == 0
    draws = spark.createDataFrame([(0, i, r, lab) for i, (r, lab) in enumerate(zip([0, 0, 1, 3, 3, 5], [10, 10, 10, 11, 11, 12], strict=True))], "run_id int, draw_idx long, row_idx long, label int")
    assert sorted((r.row_idx, r.label) for r in L.align_perturbation(draws).collect()) == [(0, 10), (1, 10), (3, 11), (5, 12)]
    pairs = L.ari_nmi(L.contingency(runs(spark, [0, 1, 0, 1], [0, 0, 1, 1], [0, 0, 1, 1])))
    assert L.representative_run(pairs).first().run_id == 1
    gap = L.min_fraction(runs(spark, [0, 0, 2, 2], [0, 1, -1, -1], [-1] * 4)).orderBy("run_id").collect()
    assert [r.min_cluster_fraction for r in gap] == [0, 0.25, 0]


def test_assignment_matches_brute_force():
    r = np.random.default_rng(0)
    for _ in range(40):
        gain = r.random(r.integers(1, 6, 2))
        assert L.assign(gain) == pytest.approx(brute_matching(gain))


def test_silhouette_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    x, lab = r.normal(size=(40, 3)) + np.repeat([[0], [3], [6], [9]], 10, 0), np.r_[np.repeat([0, 1, 2], 10), np.full(9, -1), 3]
    points = spark.createDataFrame([(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, lab, strict=True))], "row_idx long, features array<double>, label int")
    keep = lab >= 0
    d, l = np.linalg.norm(x[keep][:, None] - x[keep][None], axis=2), lab[keep]
    s = []
    for i in range(len(l)):
        own = (l == l[i]).sum()
        a = d[i, l == l[i]].sum() / max(1, own - 1)
        b = min(d[i, l == o].mean() for o in set(l) - {l[i]})
        s.append(0 if own == 1 else (b - a) / max(a, b))
    monkeypatch.setattr(Q, "BLOCK", 7)
    assert Q.silhouette(points).first()[0] == pytest.approx(np.mean(s))
    one = points.where("label = 0")
    assert (Q.silhouette(one).first()[0], Q.davies_bouldin(one).first()[0], Q.calinski_harabasz(one).first()[0]) == (-1, float("inf"), 0)


def test_pca_agrees_with_svd(spark):
    x = np.random.default_rng(2).normal(size=(50, 4)) @ np.diag([5, 2, 1, 0.1])
    got = Q.pca(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx long, features array<double>"), 2).orderBy("row_idx").collect()
    assert np.abs(np.array([r.scores for r in got])) == pytest.approx(np.abs(K.represent("pca", x, {"n_components": 2}, 0)), abs=1e-8)


@pytest.mark.parametrize(("ranges", "gathered"), [(1024, 20_000), (4, 3), (7, 1)])
def test_quantiles_by_counts_are_exact(spark, monkeypatch, ranges, gathered):
    monkeypatch.setattr(P, "RANGES", ranges)
    monkeypatch.setattr(P, "GATHERED", gathered)
    r = np.random.default_rng(5)
    cols = {"a": r.normal(size=101), "b": np.repeat([1.0, 2.0, 3.0], [50, 1, 50]), "c": np.exp(r.normal(0, 6, 101)), "d": np.full(101, 7.0), "e": r.integers(0, 5, 101).astype(float)}
    rows = [tuple(None if (i + j) % 9 == 0 else float(v[i]) for j, v in enumerate(cols.values())) + (None,) for i in range(101)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*cols, "gone"]))
    got = P.exact_quantiles(df, [*cols, "gone"], [0.0, 0.25, 0.5, 0.9, 1.0])
    assert got.pop("gone") == [None] * 5
    for j, c in enumerate(cols):
        assert got[c] == pytest.approx(np.quantile([x[j] for x in rows if x[j] is not None], [0, 0.25, 0.5, 0.9, 1]).tolist(), rel=1e-12)


def test_encodings_and_imputers(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None), (4, 8.0, "a")], "id long, x double, c string")
    assert [r.x for r in P.median_impute(df, "x").orderBy("id").collect()] == [1, 3, 3, 8]
    assert [r.c for r in P.mode_impute(df, "c").orderBy("id").collect()] == ["a", "b", "a", "a"]
    site = spark.createDataFrame([(v,) for v in ["common"] * 7 + ["p", "q", "r"]], "site string")
    assert {r.site for r in P.rare_collapse(site, "site", 3).collect()} == {"common", "__RARE__"}
    assert [r.v for r in P.ordinal(spark.createDataFrame([(v,) for v in (1, 2, 10, 7, None)], "v int"), "v", [1, 2, 10]).collect()] == [0, 1, 2, -1, -1]
    with pytest.raises(ValueError):
        P.log1p_scale(spark.createDataFrame([(-1.0,)], "x double"), "x")
    features, names = P.preprocess(df.withColumn("z", P.F.lit(2.0)), P.Roles(continuous=["x", "z"], categorical=["c"]), "id", variance=0.0)
    assert names == ["continuous__x", "continuous__x__missing", "categorical__c_a", "categorical__c_b", "categorical__c__missing"]
    assert all(len(r.features) == len(names) and None not in r.features for r in features.collect())


def test_neighbour_imputation_matches_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(30, 3))
    x[r.random(x.shape) < 0.2] = np.nan
    x[0] = [0.1, 0.2, 0.3]
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], "id long, a double, b double, c double")
    for weights in ("uniform", "distance"):
        want = x.copy()
        for i, j in zip(*np.nonzero(np.isnan(x)), strict=True):
            cand = []
            for o in np.flatnonzero(~np.isnan(x[:, j])):
                both = ~np.isnan(x[i]) & ~np.isnan(x[o])
                if both.any():
                    cand.append((np.sqrt(((x[i] - x[o])[both] ** 2).sum() * 3 / both.sum()), o))
            top = sorted(cand)[:4]
            w = np.array([1.0 if weights == "uniform" else 1 / d for d, _ in top])
            want[i, j] = (w @ x[[o for _, o in top], j]) / w.sum() if top else np.nanmean(x[:, j])
        got = P.knn_impute(df, "id", ["a", "b", "c"], 4, weights).orderBy("id").toPandas()[["a", "b", "c"]].to_numpy()
        assert got == pytest.approx(want)


def test_regression_imputation_finds_a_linear_rule(spark):
    rows = [(i, float(i), None if i % 7 == 0 else 2.0 * i + 1) for i in range(60)]
    got = P.iterative_impute(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"], 3, ridge=1e-9).orderBy("id").collect()
    assert [r.y for r in got] == pytest.approx([2.0 * i + 1 for i in range(60)], abs=1e-3)


def test_sampling_is_exact_and_repeats(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = ({r.k for r in S.take_exact(df.repartition(n), "k", 137, 5).collect()} for n in (1, 7))
    assert a == b and len(a) == 137
    assert 0.6 < S.bootstrap_draws(df, 1000, 1, 1).select("row_idx").distinct().count() / 1000 < 0.67


@pytest.mark.parametrize(("n", "fraction", "size"), [(100, 0.35, 100), (360, 0.35, 126), (740, 0.35, 259), (90_000, 0.35, 31_500), (90_001, 0.35, 31_500), (1000, 0.29, 290), (1000, 1.0, 1000)])
def test_a_share_of_the_rows_is_exact(n, fraction, size):
    assert S.pilot_size(n, fraction, 100) == size


def test_pilot_sample_has_as_many_rows_as_its_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE TABLE customer AS SELECT range AS c_custkey FROM range(720)")
    want = {x for (x,) in c.execute(catalogue.ORACLES["pilot_sample"]).fetchall()}
    assert {r.k for r in S.pilot_sample(spark.range(720).withColumnRenamed("id", "k"), "k").collect()} == want and len(want) == 252


def test_acceptance_twice_changes_nothing(spark):
    rows = [("a", "f", 0.9, True, ""), ("b", "f", 0.7, True, ""), ("c", "f", 0.1, True, ""), ("d", "f", None, True, ""), ("e", "f", 0.8, False, "dominant_cluster")]
    df = spark.createDataFrame(rows, "candidate_id string, family string, final_weighted_score double, hard_filter_passed boolean, rejection_reasons string")
    once = R.acceptance(df, 0.5)
    twice = R.acceptance(once.drop("accepted"), 0.5)
    want = {"a": (True, ""), "b": (True, ""), "c": (False, R.OUTSIDE), "d": (False, ""), "e": (False, "dominant_cluster")}
    for got in (once, twice):
        assert {r.candidate_id: (r.accepted, r.rejection_reasons) for r in got.collect()} == want
    assert not R.acceptance(df, 0.0).where("accepted").count()


def test_gates_on_missing_and_nan(spark):
    df = spark.createDataFrame([(3.9, 0.5, 0.0, 0.2, None), (3.0, 0.5, 0.0, 0.2, float("nan")), (1.0, 0.9, 0.5, 0.0, 0.9)], "n_clusters double, dominant_cluster_fraction double, noise_fraction double, min_cluster_fraction double, silhouette double")
    got = [r.hard_rejection_reasons for r in R.hard_gates(df, {"silhouette_min": 0.1}).collect()]
    assert got == ["silhouette_below_threshold", "", "cluster_count_out_of_range;dominant_cluster_too_large;noise_fraction_too_large;cluster_too_small"]
    assert [r.hard_rejection_reasons for r in R.hard_gates(df.select("n_clusters"), {}).collect()] == ["", "", "cluster_count_out_of_range"]
    scored = R.gate_where_unknown(df, {}, {"silhouette": 0.5, "runtime": 0.5})
    assert [r.hard_rejection_reasons.split(";")[-1] for r in scored.collect()] == ["\"Metric 'silhouette' required for weighted scoring is missing.\""] * 2 + ["\"Metric 'runtime_seconds' required for weighted scoring is missing.\""]


def test_consensus_of_signatures_equals_rows(spark):
    r = np.random.default_rng(4)
    lab = np.stack([r.integers(-1, 3, 25) for _ in range(4)])
    w = [0.4, 0.3, 0.2, 0.1]
    got = {(x.i, x.j): x.c for x in C.coassociation(runs(spark, *lab), w).collect()}
    for i, j in itertools.combinations(range(25), 2):
        both = (lab[:, i] >= 0) & (lab[:, j] >= 0)
        seen = (np.array(w) * both).sum()
        assert got[i, j] == pytest.approx((np.array(w) * (both & (lab[:, i] == lab[:, j]))).sum() / seen if seen else 0)


def test_pairs_of_one_signature_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "PAIRS", 100)
    lab = [[0] * 60, [1] * 57 + [-1, -1, 2], [-1] * 59 + [2]]
    got = C.coassociation(runs(spark, *lab), [0.5, 0.3, 0.1], digits=3)
    dealt = got.rdd.glom().map(len).collect()
    assert sum(dealt) == 60 * 59 // 2 and len(dealt) >= 17 and max(dealt) < 600
    c = {(x.i, x.j): x.c for x in got.collect()}
    assert c[0, 1] == c[0, 57] == c[57, 58] == 1 and c[0, 59] == 0.625 and len(c) == 1770
    noise = C.coassociation(runs(spark, [-1, -1, 0]), [1.0]).collect()
    assert [(x.i, x.j, x.c) for x in sorted(noise)] == [(0, 1, 0), (0, 2, 0), (1, 2, 0)]


def test_certain_and_ambiguous_rows(spark):
    sure = C.uncertainty(runs(spark, [0, 0, 1, 1], [1, 1, 0, 0]), [0.7, 0.3], spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "row_idx long, consensus_label int")).collect()
    assert all(r.entropy == pytest.approx(0) and r.gap > 0.9 and not r.ambiguous for r in sure)
    torn = C.uncertainty(runs(spark, [0, 0], [0, 1]), [0.95, 0.05], spark.createDataFrame([(0, 0), (1, 1)], "row_idx long, consensus_label int")).collect()
    assert all(r.ambiguous for r in torn)


def test_consensus_cut_and_bootstrap(spark):
    three = runs(spark, *[[0, 0, 1, 1, 2, 2]] * 3)
    for method in ("hierarchical", "spectral"):
        got = {r.row_idx: r.consensus_label for r in C.consensus_labels(three, [0.5, 0.3, 0.2], 3, method).collect()}
        assert len(set(got.values())) == 3 and all(got[i] == got[i + 1] for i in (0, 2, 4))
    assert [r.jaccard_mean for r in C.run_bootstrap(three, [0.5, 0.3, 0.2], 3, 3).collect()] == [1, 1, 1]


def test_effect_sizes(spark):
    df = spark.createDataFrame([(0, 50.0, 0), (0, 52.0, 1), (1, 70.0, 1), (1, 72.0, 1)], "g int, age double, flag int")
    got = {r.feature: r for r in E.contrasts(df, "g", ["age"], ["flag"]).collect()}
    assert got["age"].difference == -20 and got["age"].effect_size == pytest.approx(-20 / np.sqrt(2))
    assert got["flag"].effect_size == pytest.approx(2 * np.arcsin(np.sqrt(0.5)) - np.pi)
    nothing = spark.createDataFrame([(0, None), (1, None)], "g int, c string")
    assert {r.value for r in E.profiles(nothing, "g", categorical=["c"]).collect()} == {"unknown"}


BLOBS = np.concatenate([np.random.default_rng(5).normal(c, 0.4, (20, 2)) for c in ((0, 0), (5, 5), (0, 8))])
TRUTH = np.repeat([0, 1, 2], 20)


def agree(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("name", sorted(K.CLUSTERERS))
def test_clusterers_find_blobs(name):
    params = {"hdbscan": {"min_cluster_size": 5}, "optics": {"min_samples": 5}, "spectral": {"n_clusters": 3, "gamma": 0.5}}.get(name, {"n_clusters": 3})
    x, deep = BLOBS, name.startswith(("ae_", "vae_"))
    if deep:
        params |= {"latent_dim": 2, "hidden": (16,), "epochs": 300}
        x = (x - x.mean(0)) / x.std(0)
    lab, meta = K.fit_predict(name, x, params, 3)
    assert len(lab) == 60 and isinstance(meta, dict)
    if deep:  # what training finds may differ a little from the blobs
        assert sum(np.bincount(TRUTH[lab == c]).max() for c in set(lab)) / 60 > (0.6 if name == "vae_gmm" else 0.85)
        return
    real = lab >= 0
    assert real.mean() > 0.8 and agree(lab[real], TRUTH[real])


@pytest.mark.parametrize("seed", range(4))
def test_fits_of_many_rows_equal_those_by_matrix(seed, monkeypatch):
    r = np.random.default_rng(seed)
    p = (2, 3, 5, 2)[seed]
    x = np.concatenate([r.normal(r.normal(0, 3, p), r.uniform(0.2, 1), (r.integers(50, 120), p)) for _ in range(5)])
    if seed == 3:
        x = np.concatenate([x, x[:60]])
    core = np.sort(K._metric(x, "euclidean"), 1)[:, 6]
    assert N.core_distances(x, 7) == pytest.approx(core, abs=1e-7)
    reach = np.maximum(K._metric(x, "euclidean"), np.maximum(core[:, None], core[None]))
    assert [w for w, *_ in N.reachability_tree(x, core)] == pytest.approx([w for w, *_ in K._spanning_edges(reach)])
    # copies have equal distances, which leave open which of the lightest trees hdbscan cuts
    fits = [("hdbscan", {"min_cluster_size": 8})] * (seed < 3) + [("spectral", {"n_clusters": 4, "gamma": 0.3})] + [("agglomerative", {"n_clusters": k, "linkage": "average"}) for k in (1, 2, 5, 40, 200)]
    want = [K.fit_predict(name, x, params, 1)[0] for name, params in fits]
    monkeypatch.setattr(K, "MOST_DENSE", 10)
    for (name, params), lab in zip(fits, want, strict=True):
        assert agree(K.fit_predict(name, x, params, 1)[0].tolist(), lab.tolist()), (name, params)


def test_linkage_tells_near_ties_apart_without_all_pairs(monkeypatch):
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal((i % 6 * 3, i // 6 * 3), 0.6, (30, 2)) for i in range(24)])
    want = [K.agglomerative(x, k, linkage="average")[0] for k in (2, 4, 9, 30)]
    monkeypatch.setattr(K, "MOST_DENSE", 10)
    for most in (1 << 20, 50):  # few pieces at a time: the rest is summed row by row
        monkeypatch.setattr(N.AverageLinkage, "MOST", most)
        for k, lab in zip((2, 4, 9, 30), want, strict=True):
            assert agree(K.agglomerative(x, k, linkage="average")[0].tolist(), lab.tolist())


@pytest.mark.parametrize("name", sorted(catalogue._FINDERS))
def test_clusterers_hold_no_matrix_of_all_pairs(name):
    r = np.random.default_rng(2)
    truth = r.integers(0, 3, 12_000)
    x = np.array([[0, 0, 0], [4, 4, 0], [8, 0, 0]])[truth] + r.uniform(-0.5, 0.5, (12_000, 3))
    params = {a: 3 if v is None else v for a, v in catalogue._FINDERS[name].items()}
    tracemalloc.start()
    lab = K.fit_predict(name, x, params, 101)[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    if name == "spectral":  # its factor is reserved as a whole, and written as far as the rank goes
        most = N.gaussian_factor(x, 1.0).size * 8
    assert most < 200e6  # a matrix of doubles has 1152 MB
    assert (np.array([np.bincount(truth[lab == c]).max() for c in set(lab.tolist())]).sum() / 12_000) > 0.99


def test_other_fits():
    for cov in ("full", "tied", "diag", "spherical"):
        assert agree(K.gmm(BLOBS, 3, 1, cov)[0], TRUTH)
    for link in ("average", "complete", "single"):
        assert agree(K.agglomerative(BLOBS, 3, linkage=link)[0], TRUTH)
    for y in (K.umap(BLOBS, 1, epochs=60), K.tsne(BLOBS)):
        own = np.stack([y[TRUTH == c].mean(0) for c in range(3)])
        assert y.shape == (60, 2) and (K._sq(y, own).argmin(1) == TRUTH).mean() > 0.9
    with pytest.warns(DeprecationWarning):
        K.fit_predict("vade", BLOBS, {"n_clusters": 3, "latent_dim": 2, "epochs": 2}, 0)
    with pytest.raises(ValueError):
        K.fit_predict("nothing", BLOBS, {}, 0)


def test_study_improves():
    got = search.ask_tell({"a": [0, 1, 2, 3], "b": [0, 1]}, 30, lambda ps: [p["a"] - p["b"] for p in ps], seed=1)
    assert len(got) == 30 and np.mean([d["score"] for d in got[20:]]) > np.mean([d["score"] for d in got[:10]])


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id int, x double")
    for name in ("t.parquet", "t.csv"):
        T.write_table(df, str(tmp_path / name))
        assert T.load_table(spark, str(tmp_path / name)).count() == 2
    assert T.load_table(spark, str(tmp_path / "t.parquet")).where("x is null").count() == 1
    assert T.read_optional(spark, str(tmp_path / "none.parquet"), "id int").count() == 0
    with pytest.raises(ValueError):
        T.load_table(spark, "x.json")
    T.mark_stage(str(tmp_path), "s", n=1)
    assert T.read_stage(str(tmp_path), "s")["n"] == 1 and T.read_stage(str(tmp_path), "t") is None
    assert T.stable_id({"a": 1, "b": 2}) == T.stable_id({"b": 2, "a": 1})


BASE = {"data": {"path": "x.csv", "id_column": "id", "column_schema": {"continuous": ["x"]}}, "clustering": {"methods": [{"name": "kmeans", "params": {"n_clusters": [2, 3]}}]}}


@pytest.mark.parametrize("wrong", [{"data": {"target_columns": ["x"]}}, {"data": {"id_column": "x"}}, {"clustering": {"methods": [{"name": "magic"}]}}, {"clustering": {"methods": []}}, {"search": {"stability_mode": "none"}}, {"unknown": 1}, {"data": {"ordinal_maps": {"x": [1]}}}, {"data": {"column_schema": {"binary": ["x"]}}}])
def test_configuration_errors(wrong):
    ExperimentConfig.model_validate(BASE)
    with pytest.raises(ValueError):
        ExperimentConfig.model_validate(deep_merge(BASE, wrong))


FILE = """
experiment: {name: keys, output_dir: ./out, random_seed: 42, n_jobs: 1, use_ray: false, use_mlflow: false, use_gpu_if_available: false}
data:
  path: ./t.csv
  id_column: id
  target_columns: [truth]
  column_schema: {continuous: [a, b], binary: [flag], categorical: [site], ordinal: [grade]}
  ordinal_maps: {grade: [mild, moderate, severe]}
  missingness: {continuous_imputer: iterative, categorical_imputer: most_frequent, add_missing_indicators: true, knn: {n_neighbors: 3, weights: distance}, iterative: {max_iter: 4, initial_strategy: mean, sample_posterior: false, random_state: null, estimator: bayesian_ridge}}
search: {pilot_sample_fraction: 0.4, pilot_min_rows: 150, seeds_pilot: [101], seeds_full: [101, 102], perturbations_full: 2, perturbation_type: bootstrap, stability_mode: processed_matrix, optuna: {enabled: false, sampler: TPESampler, pruner: MedianPruner, n_trials_per_family: 3}}
preprocessing: {continuous_transforms: [standard, robust], categorical_encoding: [onehot], rare_category_collapse: {enabled: true, min_frequency: 2, replacement: other}, variance_threshold: {enabled: true, threshold: 0.0}}
representation: {methods: [{name: none}, {name: pca, params: {n_components: [2], whiten: [false, true]}}]}
clustering: {methods: [{name: kmeans, params: {n_clusters: [2, 3]}}, {name: vade, params: {n_clusters: 2}}]}
evaluation:
  internal_metrics: [silhouette]
  structure_constraints: {min_clusters: 2, max_clusters: 8, min_cluster_fraction: 0.03, max_noise_fraction: 0.35, dominant_cluster_cap: 0.85}
  acceptance: {hard_thresholds: {silhouette_min: 0.0}, weighted_score: {silhouette: 0.5, mean_cluster_jaccard: 0.5}, accept_top_fraction_if_above: 0.5}
consensus: {include_only_accepted: true, run_weighting: {source: final_weighted_score, normalize: true, floor: 0.01}, consensus_method: spectral_on_coassociation, final_k_strategy: data_driven, coassociation_storage: auto, max_dense_n: 500, uncertainty: {bootstrap_repeats: 3, ambiguous_top2_gap_threshold: 0.2, ambiguous_entropy_quantile: 0.8}}
interpretation: {surrogate_model: random_forest, feature_space: best_candidate_preprocessing, continuous_transform: standard, categorical_encoding: onehot, cross_validation_folds: 3, repeated_cv_repeats: 1, use_shap: false, use_permutation_importance: false, top_n_features: 10, grouped_correlation_threshold: 0.85}
reporting: {generate_figures: false, generate_tables: true, manuscript_bundle: true}
"""


def test_every_key_of_a_file_is_read(tmp_path):
    (tmp_path / "e.yaml").write_text(FILE)
    c = load_config(str(tmp_path / "e.yaml"))
    assert c.data.path == str(tmp_path / "t.csv") and c.evaluation.structure_constraints.dominant_cluster_cap == 0.85 and c.consensus.uncertainty.bootstrap_repeats == 3
    (tmp_path / "short.yaml").write_text("experiment: {name: s, output_dir: o}\ndata: {path: t.csv, column_schema: {continuous: [a]}}\n")
    short = load_config(str(tmp_path / "short.yaml"))
    assert short.search.perturbation_type == "subsample" and short.search.stability_mode == "full_pipeline" and [m.name for m in short.clustering.methods] == ["kmeans"]
    assert short.evaluation.acceptance.weighted_score["mean_cluster_jaccard"] == 0.25 and short.evaluation.acceptance.hard_thresholds["silhouette_min"] == -1.0
    for line in ("unknown: 1", "search: {trials: 3}", "evaluation: {structure: {}}"):
        (tmp_path / "bad.yaml").write_text((tmp_path / "short.yaml").read_text() + line + "\n")
        with pytest.raises(ValueError):
            load_config(str(tmp_path / "bad.yaml"))


def test_missing_tokens_of_csv_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,n,x,flag,s\np1,1,1.5,True,a\np2,NA,NaN,,n/a\np3,3,-2e3,False,NULL\np4,NULL,,True,x y\n")
    t = T.load_table(spark, str(tmp_path / "t.csv"))
    assert dict(t.dtypes) == {"id": "string", "n": "bigint", "x": "double", "flag": "boolean", "s": "string"}
    assert {r.id: (r.n, r.x, r.flag, r.s) for r in t.collect()} == {"p1": (1, 1.5, True, "a"), "p2": (None, None, None, None), "p3": (3, -2000.0, False, None), "p4": (None, None, True, "x y")}


def blob_table(spark, tmp_path, n=60):
    r = np.random.default_rng(6)
    rows = []
    for i in range(n):
        g = i // (n // 3)
        rows.append((f"p{i:02d}", None if i == 7 else float(r.normal(g * 6, 0.7)), float(r.normal(-g * 5, 0.7)), g == 1, ["north", "south", "east"][g] if i != 31 else None, g))
    table = str(tmp_path / "in.parquet")
    spark.createDataFrame([(a, b, c, int(d), e, g) for a, b, c, d, e, g in rows], "id string, a double, b double, flag int, site string, truth int").write.parquet(table)
    return table


def blob_config(table, tmp_path, **over):
    return ExperimentConfig.model_validate(deep_merge({
        "experiment": {"name": "e", "output_dir": str(tmp_path)}, "data": {"path": table, "id_column": "id", "target_columns": ["truth"], "column_schema": {"continuous": ["a", "b"], "binary": ["flag"], "categorical": ["site"]}},
        "search": {"seeds_full": [1, 2], "seeds_pilot": [1], "perturbations_full": 1}, "clustering": {"methods": [{"name": "kmeans", "params": {"n_clusters": [3, 99]}}, {"name": "agglomerative", "params": {"n_clusters": 3}}]},
        "evaluation": {"acceptance": {"weighted_score": {"silhouette": 0.5, "mean_cluster_jaccard": 0.3, "runtime": 0.1, "parsimony": 0.1}}},
        "consensus": {"uncertainty": {"bootstrap_repeats": 2}}, "interpretation": {"surrogate_model": "random_forest", "cross_validation_folds": 2, "repeated_cv_repeats": 1, "use_permutation_importance": False, "use_shap": False},
    }, over))


def test_experiment_end_to_end(spark, tmp_path):
    table = blob_table(spark, tmp_path)
    e = Experiment(spark, blob_config(table, tmp_path))
    assert e.validate()["candidates"] == 3
    reg = e.run()
    assert reg.where("accepted").count() == 2 and reg.where("search_stage = 'compatibility_rejected'").first().rejection_reasons == "cluster_count_too_large_for_rows"
    one = reg.where("accepted and clustering_name = 'kmeans'").first()
    assert one.silhouette == one.silhouette_cluster_space == one.silhouette_original_space and one.silhouette_sd >= 0 and one.seed_runs == 2 and one.representative_seed == 1
    assert one.mean_cluster_jaccard > 0.95 and one.perturbation_rows_compared_mean < 60 and one.parsimony_penalty == pytest.approx(np.log1p(3) / np.log1p(60)) and one.metadata["inertia"] > 0
    times = [r.runtime_seconds for r in reg.where("accepted").collect()]
    assert min(times) > 0 and len(set(times)) == 2
    labels = spark.read.parquet(e._path("consensus/labels")).join(spark.read.parquet(table).select("id", "truth"), "id").toPandas()
    assert agree(labels.consensus_label, labels.truth)
    again = Experiment.from_output_dir(spark, str(e.folder)).resume()
    assert again.count() == 3 and e.status()["report"]
    tables = Path(e.export_manuscript_bundle()) / "tables"
    assert {"search_flow.csv", "candidate_registry.csv", "cluster_size_confidence.csv", "embedding.csv", "pairwise_cluster_contrasts.csv"} <= {p.name for p in tables.iterdir()}
    assert (tables / "search_flow.csv").read_text().splitlines()[:2] == ["stage,count", "generated_total,3"]


def test_interrupted_search_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    from tessera.plans import experiment

    monkeypatch.setattr(experiment, "BATCH", 1)
    config = blob_config(blob_table(spark, tmp_path), tmp_path, search={"perturbations_full": 0})
    e, real, fitted = Experiment(spark, config), search.fit_table, []

    def counted(points, table, seeds, quality=False):
        fitted.extend(r.candidate_id for r in table.select("candidate_id").collect())
        if len(set(fitted)) == 2:
            raise KeyboardInterrupt
        return real(points, table, seeds, quality)

    monkeypatch.setattr(search, "fit_table", counted)
    with pytest.raises(KeyboardInterrupt):
        e.search()
    kept = {r.candidate_id for r in e._kept("results").collect()}
    assert len(kept) == 2 and e.status()["search"] is None  # one fitted, one incompatible
    fitted.clear()
    monkeypatch.setattr(search, "fit_table", lambda p, t, s, quality=False: (fitted.extend(r.candidate_id for r in t.select("candidate_id").collect()), real(p, t, s, quality))[1])
    assert e.search().count() == 3 and len(set(fitted)) == 1 and not set(fitted) & kept


def test_study_is_kept_with_its_trials(spark, tmp_path):
    config = blob_config(blob_table(spark, tmp_path), tmp_path, search={"perturbations_full": 0, "optuna": {"enabled": True, "n_trials_per_family": 4}}, clustering={"methods": [{"name": "kmeans", "params": {"n_clusters": [2, 3, 99]}}]})
    e = Experiment(spark, config)
    reg = e.search()
    trials = e._table("optuna/kmeans_trials")
    assert trials.count() == 4 and {r.status for r in trials.collect()} <= {"completed", "pruned", "invalid"} and reg.count() == trials.select("candidate_id").distinct().count()
    best = T.read_yaml(f"{e.folder}/optuna/kmeans_study_summary.json")
    done = [r.final_weighted_score for r in trials.where("status = 'completed'").collect()]
    assert best["best_value"] == (pytest.approx(max(done)) if done else None)


def test_draws_keep_their_repeats_and_the_pipeline_is_fitted_on_them(spark, tmp_path):
    rows = spark.range(200).withColumnRenamed("id", "row_idx")
    draws = search.perturbation_draws(rows, "bootstrap", 3, 0).toPandas()
    assert len(draws) == 200 and 100 < draws.row_idx.nunique() < 150
    some = search.perturbation_draws(rows, "subsample", 3, 0).toPandas()
    assert len(some) == some.row_idx.nunique() == 160
    reference = spark.createDataFrame([("c", i, i // 2) for i in range(6)], "candidate_id string, row_idx long, label int")
    drawn = spark.createDataFrame([("c", 0, d, r, l) for d, (r, l) in enumerate([(0, 10), (0, 11), (1, 10), (3, 11), (3, 11), (5, 12)])], "candidate_id string, run_id int, draw_idx long, row_idx long, label int")
    got = search.perturbation_agreement(reference, drawn).first()
    assert got.mean_cluster_jaccard == pytest.approx(1.0) and got.perturbation_rows_compared_mean == 4
    config = blob_config(blob_table(spark, tmp_path), tmp_path, search={"perturbation_type": "bootstrap"})
    e, seen = Experiment(spark, config), []
    real = e.features
    e.features = lambda rows, *v: (seen.append(rows.count()), real(rows, *v))[1]
    e.search()
    assert seen == [60, 60]  # the table, and the one draw with its repeats


def test_the_driver_gets_the_matrix_as_blocks(spark, monkeypatch):
    rows = [(7 * i % 500, [float(7 * i % 500), 0.5, None if i == 3 else -1.0]) for i in range(500)]
    points = spark.createDataFrame(rows, "row_idx int, features array<float>").repartition(5)

    def refuse(*_):
        raise AssertionError("rows reached the driver")

    monkeypatch.setattr(search, "ROWS", 64)
    monkeypatch.setattr(type(points), "toPandas", refuse)
    x, ids = search._matrix(points, 500, 3)
    assert ids.tolist() == list(range(500)) and x[:, 0].tolist() == ids.tolist() and np.isnan(x[21, 2]) and (x[22:, 2] == -1).all()
    grid = search.candidate_grid(["none"], ["onehot"], [{"name": "none"}], [{"name": "kmeans", "params": {"n_clusters": 2}}])
    got = search.run_fits(points.where("row_idx <> 21"), search.registry(spark, grid), [1, 2]).collect()
    assert sorted((r.run_id, r.row_idx) for r in got) == [(s, i) for s in (1, 2) for i in range(500) if i != 21]
    assert len({(r.run_id, r.label) for r in got if r.row_idx < 200}) == 2
    with pytest.raises(Exception, match="every row needs 3 features"):
        search._matrix(spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0])], "row_idx long, features array<double>"), 2, 3)


def test_agreement_of_seeds_equals_that_of_joined_runs(spark):
    r = np.random.default_rng(9)
    lab = [r.integers(-1, 3, 60) for _ in range(3)]
    both = spark.createDataFrame([(c, s, i, int(x)) for c in "ab" for s, v in enumerate(lab) for i, x in enumerate(v) if c == "a" or i % 2], "candidate_id string, run_id int, row_idx long, label int")
    got = {(x.candidate_id, x.run_a, x.run_b): (x.ari, x.nmi) for x in search.pair_agreement(both).collect()}
    for c in "ab":
        for x in L.ari_nmi(L.contingency(both.where(f"candidate_id = '{c}'").drop("candidate_id"))).collect():
            assert got.pop((c, x.run_a, x.run_b)) == pytest.approx((x.ari, x.nmi))
    assert not got and not search.pair_agreement(both.where("run_id = 1")).count()


def test_seeds_are_summarised_and_the_most_typical_one_stands_for_all(spark):
    lab = {1: [0, 1, 0, 1], 2: [0, 0, 1, 1], 3: [0, 0, 1, 1]}
    runs_ = spark.createDataFrame([("c", s, i, v) for s, l in lab.items() for i, v in enumerate(l)], "candidate_id string, run_id int, row_idx long, label int")
    got = search.representative_seeds(runs_, [1, 2, 3]).first()
    assert got.representative_seed == 2
    assert search.representative_seeds(runs_.where("run_id = 3"), [3]).first().representative_seed_mean_ari_to_others == 1.0
    x = np.random.default_rng(2).normal(size=(40, 3)) + np.repeat([[0, 0, 0], [6, 0, 0]], 20, 0)
    lab = np.repeat([0, 1], 20)
    points = spark.createDataFrame([(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, lab, strict=True))], "row_idx long, features array<double>, label int")
    got = K.internal_quality(x, lab, 7)
    assert got["silhouette"] == pytest.approx(Q.silhouette(points).first()[0]) and got["davies_bouldin"] == pytest.approx(Q.davies_bouldin(points).first()[0]) and got["calinski_harabasz"] == pytest.approx(Q.calinski_harabasz(points).first()[0])
    assert K.internal_quality(x, np.zeros(40, int)) == {"silhouette": -1.0, "davies_bouldin": float("inf"), "calinski_harabasz": 0.0}


def test_surrogates_tell_which_features_matter(spark):
    r = np.random.default_rng(4)
    lab = np.repeat([0, 1, 2], 30)
    x = np.column_stack([lab * 4 + r.normal(size=90), r.normal(size=90), (lab == 1) * 2 + r.normal(size=90)])
    data = spark.createDataFrame([(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, lab, strict=True))], "row_idx long, features array<double>, label int")
    held = {h.feature: h for h in E.heldout_importance(data, "row_idx", ["a", "b", "c"], 3, 1, 10, 1).collect()}
    assert held["a"].importance_mean > 0.2 > abs(held["b"].importance_mean) and held["a"].fold_count == 3
    few = E.heldout_importance(data.where("row_idx < 31"), "row_idx", ["a", "b", "c"], 3)
    assert {(r.importance_mean, r.fold_count) for r in few.collect()} == {(0.0, 0)}
    with pytest.warns(UserWarning):
        folds, cells = E.surrogate_cv(data.where("row_idx < 31"), "row_idx", 3)
    assert np.isnan(folds.first().accuracy) and cells.count() == 0
    values = {v.feature: v.mean_abs_shapley for v in E.surrogate_shapley(data, ["a", "b", "c"], 10, permutations=3, most=30).collect()}
    assert values["a"] > values["c"] > 0 and values["a"] > 3 * values["b"]


def test_noise_has_no_shapley_value(spark):
    from tessera.operators import reporting as X

    r = np.random.default_rng(11)
    x = r.normal(size=(40, 2))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx long, features array<double>")

    def predict(z):  # the second feature moves the score up or down by what the first one is: over many orders its own share is small
        p = 0.5 + 0.4 * np.tanh(z[:, 0]) + 0.1 * np.sign(z[:, 0]) * np.sin(40 * z[:, 1])
        return np.column_stack([p, 1 - p])

    got = {v.feature: v.mean_abs_shapley for v in X.shapley(points, predict, x, ["a", "b"], 200).collect()}
    assert got["a"] > 5 * got["b"]


def test_categorical_contrasts(spark):
    df = spark.createDataFrame([(0, "x", None), (0, "x", None), (1, "y", None), (1, "x", None), (1, "y", None)], "label int, site string, gone string")
    got = {r.feature: (r.comparison, r.effect_size) for r in E.contrasts(df, "label", categorical=["site", "gone"]).collect()}
    assert got == {"site": ("x vs y", 1.0), "gone": ("unknown vs unknown", 0.0)}


def test_data_driven_k_equals_row_level_silhouette(spark):
    from tessera.operators import reporting as X

    r = np.random.default_rng(7)
    lab = np.stack([r.integers(0, 3, 30) for _ in range(3)])
    w = [0.5, 0.3, 0.2]
    rows = runs(spark, *lab)
    sigs = C.signatures(rows)[0]
    cuts = sigs.select(P.F.lit(3).alias("k"), "sig_id", "n", P.F.get("labels", P.F.lit(0)).alias("label"))
    d = 1 - sum(wi * (a[:, None] == a[None]) for wi, a in zip(w, lab, strict=True))
    cut, s = lab[0], []
    for i in range(30):
        own = [d[i, j] for j in range(30) if j != i and cut[j] == cut[i]]
        b = min(np.mean(d[i, cut == o]) for o in set(cut) - {cut[i]})
        a = np.mean(own) if own else 0
        s.append((b - a) / max(a, b) if own and max(a, b) else 0)
    assert X.data_driven_k(cuts, C.signature_agreement(sigs, w)).first().silhouette == pytest.approx(np.mean(s))


def test_shapley_ranks_the_features_that_matter(spark):
    from tessera.operators import reporting as X

    x = np.random.default_rng(8).normal(size=(40, 3))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx long, features array<double>")
    got = {r.feature: r.mean_abs_shapley for r in X.shapley(points, lambda z: 3 * z[:, 0] + z[:, 1], x, ["a", "b", "c"], 10).collect()}
    assert got["a"] > got["b"] > got["c"] == pytest.approx(0)


def test_synthetic_source_repeats(spark):
    from tessera.operators import reporting as X

    a, b = (X.synthetic_table(spark, 48).orderBy("patient_id").collect() for _ in range(2))
    assert a == b and len(a) == 144 and any(r.bmi is None for r in a)


def test_hashed_rank_is_the_order_of_hashes(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(500)], "k long, g int").repartition(4)
    drawn = S.draw(1, 0, P.F.col("k"))
    want = [r.k for r in df.orderBy(drawn).collect()]
    assert [r.k for r in S.hashed_rank(df, drawn, "k").orderBy("_rank").collect()] == want
    by = S.hashed_rank(df, drawn, "k", ["g"]).collect()
    for g in (None, 0, 1, 2):
        own = {r.k: r["_rank"] for r in by if r.g == g}
        assert [k for k in want if k in own] == sorted(own, key=own.get) and sorted(own.values()) == list(range(1, len(own) + 1))
    idx = [r.row_idx for r in T.with_row_idx(df, ["k", "g"]).collect()]
    assert sorted(idx) == list(range(500))
