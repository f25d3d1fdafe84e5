"""The registered queries of the clustering operators and their SQL.

The tables carry no gaps and no labels, so both are made by rule: customer's balance is null where its key divides by 17 and its
segment where it divides by 23; three label runs of supplier come from its columns; a candidate registry has a row per part.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import consensus as C
from tessera.operators import explain as E
from tessera.operators import labels as L
from tessera.operators import preprocess as P
from tessera.operators import quality as Q
from tessera.operators import reporting as X
from tessera.operators import sampling as S
from tessera.operators import scoring as R
from tessera.plans import search
from tessera.sources.tables import row_identity, table_profile

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WEIGHTS = [0.5, 0.3, 0.2]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def gappy(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 17 != 0, F.col("c_acctbal")).alias("bal"), F.when(F.col("c_custkey") % 23 != 0, F.col("c_mktsegment")).alias("seg"))


GAPPY = "g AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 23 <> 0 THEN c_mktsegment END AS seg FROM customer)"


def label_runs(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    by = [F.col("s_nationkey") % 3, F.floor((F.col("s_acctbal") + 1000) / 4000), F.when(F.col("s_suppkey") % 11 == 0, -1).otherwise(F.col("s_suppkey") % 4)]
    runs = F.array(*[F.struct(F.lit(i).alias("run_id"), e.cast("int").alias("label")) for i, e in enumerate(by)])
    return s.select(F.col("s_suppkey").alias("row_idx"), F.explode(runs).alias("r")).select("r.run_id", "row_idx", "r.label")


RUNS = """lr AS (SELECT 0 AS run_id, s_suppkey AS row_idx, CAST(s_nationkey % 3 AS INTEGER) AS label FROM supplier UNION ALL
  SELECT 1, s_suppkey, CAST(floor((s_acctbal + 1000) / 4000) AS INTEGER) FROM supplier UNION ALL
  SELECT 2, s_suppkey, CAST(CASE WHEN s_suppkey % 11 = 0 THEN -1 ELSE s_suppkey % 4 END AS INTEGER) FROM supplier)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    k, z = F.col("p_partkey"), F.col("p_size")
    at = lambda names, m: F.element_at(F.array(*map(F.lit, names)), (k % m + 1).cast("int"))
    share = lambda m, n: (k % m) / float(n)
    return p.select(
        F.col("p_partkey").cast("string").alias("candidate_id"), F.when(k % 4 == 0, "deep").otherwise("classical").alias("family"),
        F.when(k % 20 == 0, "pilot_pruned").when(k % 33 == 0, "compatibility_rejected").otherwise("full_evaluated").alias("search_stage"),
        at(["standard", "robust"], 2).alias("continuous_transform"), at(["onehot", "ordinal", "onehot"], 3).alias("categorical_encoding"), at(["none", "pca", "umap"], 3).alias("representation_name"), at(["kmeans", "gmm"], 2).alias("clustering_name"),
        ((z - 25) / 20.0).alias("silhouette"), (z / 20.0).alias("davies_bouldin"), (z * 7.5).alias("calinski_harabasz"), ((k % 97) / 50.0 - 0.9).alias("ari_seed"), (share(95, 90) - 0.01).alias("nmi_seed"), F.when(k % 29 != 0, share(89, 89)).alias("mean_cluster_jaccard"), share(83, 80).alias("mean_cluster_jaccard_symmetric"),
        share(79, 75).alias("cluster_balance"), share(73, 72).alias("average_confidence"), (share(71, 30) - 0.1).alias("assignment_entropy"), share(67, 10).alias("reconstruction_loss"), share(61, 60).alias("parsimony_penalty"), share(59, 40).alias("feature_dimensionality_penalty"),
        (2 + z % 12).cast("int").alias("n_clusters"), share(50, 100).alias("noise_fraction"), ((30 + k % 61) / 100.0).alias("dominant_cluster_fraction"), share(11, 100).alias("min_cluster_fraction"), share(7, 10).alias("tiny_cluster_fraction"), (k % 400).cast("double").alias("runtime_seconds"),
    )


REGISTRY = """rg AS (SELECT CAST(p_partkey AS VARCHAR) AS candidate_id, CASE WHEN p_partkey % 4 = 0 THEN 'deep' ELSE 'classical' END AS family,
  CASE WHEN p_partkey % 20 = 0 THEN 'pilot_pruned' WHEN p_partkey % 33 = 0 THEN 'compatibility_rejected' ELSE 'full_evaluated' END AS search_stage,
  ['standard', 'robust'][p_partkey % 2 + 1] AS continuous_transform, ['onehot', 'ordinal', 'onehot'][p_partkey % 3 + 1] AS categorical_encoding, ['none', 'pca', 'umap'][p_partkey % 3 + 1] AS representation_name, ['kmeans', 'gmm'][p_partkey % 2 + 1] AS clustering_name,
  (p_size - 25) / 20.0::DOUBLE AS silhouette, p_size / 20.0::DOUBLE AS davies_bouldin, p_size * 7.5::DOUBLE AS calinski_harabasz, (p_partkey % 97) / 50.0::DOUBLE - 0.9::DOUBLE AS ari_seed, (p_partkey % 95) / 90.0::DOUBLE - 0.01::DOUBLE AS nmi_seed, CASE WHEN p_partkey % 29 <> 0 THEN (p_partkey % 89) / 89.0::DOUBLE END AS mean_cluster_jaccard, (p_partkey % 83) / 80.0::DOUBLE AS mean_cluster_jaccard_symmetric,
  (p_partkey % 79) / 75.0::DOUBLE AS cluster_balance, (p_partkey % 73) / 72.0::DOUBLE AS average_confidence, (p_partkey % 71) / 30.0::DOUBLE - 0.1::DOUBLE AS assignment_entropy, (p_partkey % 67) / 10.0::DOUBLE AS reconstruction_loss, (p_partkey % 61) / 60.0::DOUBLE AS parsimony_penalty, (p_partkey % 59) / 40.0::DOUBLE AS feature_dimensionality_penalty,
  CAST(2 + p_size % 12 AS INTEGER) AS n_clusters, (p_partkey % 50) / 100.0::DOUBLE AS noise_fraction, (30 + p_partkey % 61) / 100.0::DOUBLE AS dominant_cluster_fraction, (p_partkey % 11) / 100.0::DOUBLE AS min_cluster_fraction, (p_partkey % 7) / 10.0::DOUBLE AS tiny_cluster_fraction, CAST(p_partkey % 400 AS DOUBLE) AS runtime_seconds FROM part)"""
SCORE = {"silhouette": 0.2, "ari_seed": 0.2, "nmi_seed": 0.1, "mean_cluster_jaccard": 0.1, "mean_cluster_jaccard_symmetric": 0.1, "cluster_balance": 0.05, "average_confidence": 0.05, "calinski_harabasz": 0.02, "davies_bouldin": 0.05, "assignment_entropy": 0.03, "reconstruction_loss": 0.03, "runtime": 0.03, "parsimony": 0.02, "feature_dimensionality_penalty": 0.02}
UTILITY_NAMES = [k for k in SCORE]
_FALLS = lambda x: f"1 / (1 + ln(1 + greatest({x}, 0)))"
_CLIPS = lambda x: f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, 0), 1) END"
_UTILITY = {n: f"(least(greatest({n}, -1), 1) + 1) / 2" for n in ("silhouette", "ari_seed")}
_UTILITY |= {n: _CLIPS(n) for n in ("nmi_seed", "mean_cluster_jaccard", "mean_cluster_jaccard_symmetric", "cluster_balance", "average_confidence")}
_UTILITY |= {"calinski_harabasz": "ln(1 + greatest(calinski_harabasz, 0))"} | {n: _FALLS(n) for n in ("davies_bouldin", "assignment_entropy", "reconstruction_loss", "feature_dimensionality_penalty")}
_UTILITY |= {"runtime": _FALLS("runtime_seconds"), "parsimony": _FALLS("parsimony_penalty")}
SCORED = f"""{REGISTRY}, sc AS (SELECT *, {', '.join(f'{_UTILITY[n]} AS utility_{n}' for n in SCORE)} FROM rg),
  fs AS (SELECT *, {' + '.join(f'utility_{n} * {w}::DOUBLE' for n, w in SCORE.items())} AS final_weighted_score FROM sc)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats to a fixed number of digits, and never minus zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rr(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


# ---------------------------------------------------------------------------------------------- tables and features


@query("""SELECT 'c_custkey' AS column_name, count(*) AS n_rows, count_if(c_custkey IS NULL)::BIGINT AS n_null FROM customer UNION ALL SELECT 'c_name', count(*), count_if(c_name IS NULL)::BIGINT FROM customer UNION ALL SELECT 'c_nationkey', count(*), count_if(c_nationkey IS NULL)::BIGINT FROM customer
  UNION ALL SELECT 'c_acctbal', count(*), count_if(c_acctbal IS NULL)::BIGINT FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count_if(c_mktsegment IS NULL)::BIGINT FROM customer""")
def table_profiles(spark, d):
    return table_profile(read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS row_id, CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def row_ids(spark, d):
    return row_identity(read(spark, d, "customer"), ["c_custkey", "c_nationkey"])


@query(f"WITH {GAPPY} SELECT c_custkey, {rr('coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM g))', 'bal')} FROM g")
def median_impute(spark, d):
    return rounded(P.median_impute(gappy(spark, d), "bal").select("c_custkey", "bal"))


@query(f"WITH {GAPPY}, m AS (SELECT seg FROM g WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1) SELECT c_custkey, coalesce(seg, (SELECT seg FROM m)) AS seg FROM g")
def mode_impute(spark, d):
    return P.mode_impute(gappy(spark, d), "seg").select("c_custkey", "seg")


@query(f"WITH {GAPPY} SELECT c_custkey, CAST(bal IS NULL AS INTEGER)::DOUBLE AS continuous__bal__missing, CAST(seg IS NULL AS INTEGER)::DOUBLE AS categorical__seg__missing FROM g")
def missing_indicators(spark, d):
    return P.missing_indicator(P.missing_indicator(gappy(spark, d), "bal", "continuous"), "seg", "categorical").select("c_custkey", "continuous__bal__missing", "categorical__seg__missing")


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS a, s_nationkey::DOUBLE AS n FROM supplier),
  d AS (SELECT q.s_suppkey, r.a AS v, row_number() OVER (PARTITION BY q.s_suppkey ORDER BY sqrt(2 * (q.n - r.n) * (q.n - r.n)), r.s_suppkey) AS k FROM s q JOIN s r ON q.a IS NULL AND r.a IS NOT NULL),
  m AS (SELECT s_suppkey, avg(v) AS v FROM d WHERE k <= 5 GROUP BY s_suppkey)
  SELECT s.s_suppkey, round(coalesce(a, v), 6) + 0.0 AS a, n FROM s LEFT JOIN m ON s.s_suppkey = m.s_suppkey""")
def knn_impute(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("a"), F.col("s_nationkey").cast("double").alias("n"))
    return rounded(P.knn_impute(s, "s_suppkey", ["a", "n"], 5))


@query()
def iterative_impute(spark, d):
    s = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice")).alias("price"), F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 1000).cast("double").alias("k"))
    return rounded(P.iterative_impute(s, ["price", "size", "k"], 3), 4)


@query(f"SELECT l_orderkey, l_linenumber, {rr('(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem)', 'l_quantity')} FROM lineitem")
def standard_scale(spark, d):
    return rounded(P.standard_scale(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity"))


@query(f"WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem) SELECT l_orderkey, l_linenumber, {rr('(l_extendedprice - q[2]) / (q[3] - q[1])', 'l_extendedprice')} FROM lineitem, q")
def robust_scale(spark, d):
    return rounded(P.robust_scale(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice"))


@query(f"WITH t AS (SELECT l_orderkey, l_linenumber, ln(1 + l_extendedprice) AS x FROM lineitem) SELECT l_orderkey, l_linenumber, {rr('(x - (SELECT avg(x) FROM t)) / (SELECT stddev_pop(x) FROM t)', 'l_extendedprice')} FROM t")
def log1p_scale(spark, d):
    return rounded(P.log1p_scale(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice"))


@query()
def power_scale(spark, d):
    return rounded(P.power_scale(read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal"))


@query("WITH t AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), k AS (SELECT p_brand FROM t WHERE n >= greatest(1, ceil((SELECT count(*) FROM part) * 0.04))) SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM k) THEN p_brand ELSE '__RARE__' END AS p_brand FROM part")
def rare_collapse(spark, d):
    return P.rare_collapse(read(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 0.04)


@query("SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{v}' AS INTEGER)::DOUBLE AS categorical__o_orderstatus_{v}" for v in "FOP") + " FROM orders")
def onehot(spark, d):
    return P.one_hot(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "categorical", list("FOP")).drop("o_orderstatus")


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS o_orderpriority FROM orders")
def ordinal_auto(spark, d):
    return P.ordinal(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE -1 END::DOUBLE AS o_orderstatus FROM orders")
def ordinal_explicit(spark, d):
    return P.ordinal(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["P", "O"])


@query("SELECT p_partkey, p_size::DOUBLE AS size FROM part")
def variance_filter(spark, d):
    return P.variance_filter(read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.lit(1.0).alias("constant")), ["size", "constant"], 0.0)


_FILLED = f"""WITH {GAPPY}, fi AS (SELECT (SELECT quantile_cont(bal, 0.5) FROM g) AS med, (SELECT seg FROM g WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1) AS top, (SELECT list_sort(list(DISTINCT seg)) FROM g WHERE seg IS NOT NULL) AS levels),
  x AS (SELECT c_custkey, coalesce(bal, med) AS b, bal IS NULL AS b0, coalesce(seg, top) AS s, seg IS NULL AS s0, levels FROM g, fi), z AS (SELECT avg(b) AS m, stddev_pop(b) AS sd FROM x)"""


@query(f"{_FILLED} SELECT c_custkey, {rr('(b - m) / sd', 'f0')}, CAST(b0 AS DOUBLE) AS f1, {', '.join(f'CAST(s = levels[{i}] AS DOUBLE) AS f{i + 1}' for i in range(1, 6))}, CAST(s0 AS DOUBLE) AS f7 FROM x, z")
def preprocess_pipeline(spark, d):
    """Gaps filled, flagged, scaled and encoded: one column of the matrix after the other."""
    features, names = P.preprocess(gappy(spark, d), P.Roles(continuous=["bal"], categorical=["seg"]), "c_custkey")
    return rounded(features.select("c_custkey", *[F.col("features")[i].alias(f"f{i}") for i in range(len(names))]))


# -------------------------------------------------------------------------------------------------------- sampling


def _md5(seed: int, run: int, key: str) -> str:
    return f"md5('{seed}:{run}:' || CAST({key} AS VARCHAR))"


@query(f"SELECT c_custkey FROM customer QUALIFY row_number() OVER (ORDER BY {_md5(2026, 0, 'c_custkey')}) <= (SELECT CASE WHEN count(*) <= 250 THEN count(*) ELSE least(count(*), greatest(250, CAST(floor(count(*) * 0.35) AS BIGINT))) END FROM customer)")
def pilot_sample(spark, d):
    return S.pilot_sample(read(spark, d, "customer").select("c_custkey"), "c_custkey")


@query(f"SELECT c_custkey FROM customer QUALIFY row_number() OVER (ORDER BY {_md5(7, 3, 'c_custkey')}) <= (SELECT greatest(2, CAST(floor(count(*) * 0.8) AS BIGINT)) FROM customer)")
def subsample(spark, d):
    return S.subsample(read(spark, d, "customer").select("c_custkey"), "c_custkey", 7, 3)


@query(f"SELECT range AS draw_idx, CAST(('0x' || substr({_md5(7, 1, 'range')}, 1, 8)) AS BIGINT) % (SELECT count(*) FROM customer) AS row_idx FROM range((SELECT count(*) FROM customer))")
def bootstrap_draws(spark, d):
    c = read(spark, d, "customer")
    return S.bootstrap_draws(c, c.count(), 7, 1)


@query(f"SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_md5(5, 0, 'c_custkey')}) - 1) % 5 AS INTEGER) AS fold FROM customer")
def stratified_folds(spark, d):
    return S.folds(read(spark, d, "customer"), "c_custkey", "c_mktsegment", 5, 5).select("c_custkey", "fold")


@query(f"SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_md5(5, 0, 'c_custkey')}) <= ceil(count(*) OVER (PARTITION BY c_mktsegment) * 0.2) AS is_test FROM customer")
def stratified_split(spark, d):
    return S.split(read(spark, d, "customer"), "c_custkey", 0.2, 5, "c_mktsegment").select("c_custkey", "is_test")


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {_md5(5, 0, 'c_custkey')}) <= ceil(count(*) OVER () * 0.2) AS is_test FROM customer")
def train_test_split(spark, d):
    return S.split(read(spark, d, "customer"), "c_custkey", 0.2, 5).select("c_custkey", "is_test")


# ----------------------------------------------------------------------------------------------- partition metrics

_SIZES = f"{RUNS}, z AS (SELECT run_id, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY run_id) AS t FROM lr GROUP BY run_id, label)"


@query(f"WITH {_SIZES} SELECT run_id, count_if(label >= 0)::BIGINT AS n_clusters, {rr('coalesce(sum(n) FILTER (label < 0), 0) / sum(n)', 'noise_fraction')}, {rr('coalesce(max(n / t) FILTER (label >= 0), 0)', 'dominant_cluster_fraction')}, {rr('coalesce(avg(CASE WHEN n / t < 0.03 THEN 1.0 ELSE 0.0 END) FILTER (label >= 0), 0)', 'tiny_cluster_fraction')} FROM z GROUP BY run_id")
def structure_summary(spark, d):
    return rounded(L.structure_summary(label_runs(spark, d)))


@query(f"WITH {_SIZES} SELECT run_id, {rr('CASE WHEN max(label) FILTER (label >= 0) + 1 > count_if(label >= 0) OR count_if(label >= 0) = 0 THEN 0 ELSE min(n) FILTER (label >= 0) / sum(n) END', 'min_cluster_fraction')} FROM z GROUP BY run_id")
def min_fraction(spark, d):
    return rounded(L.min_fraction(label_runs(spark, d)))


@query(f"WITH {RUNS}, z AS (SELECT run_id, count(*) / sum(count(*)) OVER (PARTITION BY run_id) AS p FROM lr WHERE label >= 0 GROUP BY run_id, label) SELECT run_id, {rr('CASE WHEN count(*) = 1 THEN 1 ELSE -sum(p * ln(p + 1e-12)) / ln(count(*)) END', 'cluster_balance')} FROM z GROUP BY run_id")
def cluster_balance(spark, d):
    return rounded(L.cluster_balance(label_runs(spark, d)))


_CELLS = f"{RUNS}, c AS (SELECT a.run_id AS run_a, b.run_id AS run_b, a.label AS la, b.label AS lb, count(*) AS n FROM lr a JOIN lr b ON a.row_idx = b.row_idx AND a.run_id < b.run_id GROUP BY ALL)"
_SIDES = "ra AS (SELECT run_a, run_b, sum(m * (m - 1) / 2.0) AS sa, sum(m * ln(m)) AS ea, sum(m) AS t FROM (SELECT run_a, run_b, sum(n)::DOUBLE AS m FROM c GROUP BY run_a, run_b, la) GROUP BY ALL), rb AS (SELECT run_a, run_b, sum(m * (m - 1) / 2.0) AS sb, sum(m * ln(m)) AS eb FROM (SELECT run_a, run_b, sum(n)::DOUBLE AS m FROM c GROUP BY run_a, run_b, lb) GROUP BY ALL), rc AS (SELECT run_a, run_b, sum(n * (n - 1) / 2.0) AS sab, sum(n * ln(n)) AS eab FROM c GROUP BY ALL)"


@query(f"WITH {_CELLS}, {_SIDES}, e AS (SELECT *, sa * sb / (t * (t - 1) / 2) AS x, ln(t) - ea / t AS ha, ln(t) - eb / t AS hb, ln(t) - eab / t AS hab FROM ra JOIN rb USING (run_a, run_b) JOIN rc USING (run_a, run_b)) SELECT run_a, run_b, {rr('(sab - x) / ((sa + sb) / 2 - x)', 'ari')}, {rr('(ha + hb - hab) / ((ha + hb) / 2)', 'nmi')} FROM e")
def ari_nmi(spark, d):
    return rounded(L.ari_nmi(L.contingency(label_runs(spark, d))))


_JACCARD = f"{_CELLS}, j AS (SELECT *, sum(n) OVER (PARTITION BY run_a, run_b, la) AS na, sum(n) OVER (PARTITION BY run_a, run_b, lb) AS nb FROM c), jj AS (SELECT run_a, run_b, la, lb, n / (na + nb - n) AS jac FROM j WHERE la >= 0 AND lb >= 0)"


@query(f"WITH {_JACCARD} SELECT run_a, run_b, la, {rr('max(jac)', 'best')} FROM jj GROUP BY run_a, run_b, la")
def jaccard_one_sided(spark, d):
    return rounded(L.jaccard_one_sided(L.contingency(label_runs(spark, d))))


# clusters are at most four a run here, so the best matching is the best of all assignments of run_a's clusters
@query(f"""WITH RECURSIVE {_JACCARD}, ids AS (SELECT run_a, run_b, la, dense_rank() OVER (PARTITION BY run_a, run_b ORDER BY la) AS p FROM (SELECT DISTINCT run_a, run_b, la FROM j WHERE la >= 0)),
  k AS (SELECT run_a, run_b, count(DISTINCT la) FILTER (la >= 0) AS ka, count(DISTINCT lb) FILTER (lb >= 0) AS kb FROM c GROUP BY ALL),
  w(run_a, run_b, p, used, total) AS (SELECT DISTINCT run_a, run_b, 0::BIGINT, []::INTEGER[], 0.0::DOUBLE FROM c UNION ALL
    SELECT w.run_a, w.run_b, w.p + 1, CASE WHEN b.lb IS NULL THEN w.used ELSE list_append(w.used, b.lb) END, w.total + coalesce(b.jac, 0) FROM w JOIN ids i ON i.run_a = w.run_a AND i.run_b = w.run_b AND i.p = w.p + 1
    JOIN (SELECT run_a, run_b, la, lb, jac FROM jj UNION ALL SELECT run_a, run_b, la, NULL, 0 FROM ids) b ON b.run_a = w.run_a AND b.run_b = w.run_b AND b.la = i.la AND (b.lb IS NULL OR NOT list_contains(w.used, b.lb)))
  SELECT w.run_a, w.run_b, {rr('max(total) / greatest(any_value(ka), any_value(kb))', 'jaccard')} FROM w JOIN k USING (run_a, run_b) GROUP BY w.run_a, w.run_b""")
def jaccard_symmetric(spark, d):
    return rounded(L.jaccard_symmetric(L.contingency(label_runs(spark, d))))


@query(f"WITH {RUNS}, n AS (SELECT count(*) AS n FROM supplier), w AS (SELECT range AS draw_idx, CAST(('0x' || substr(md5('9:0:' || range), 1, 8)) AS BIGINT) % n.n + 1 AS row_idx FROM range((SELECT n FROM n)), n) SELECT run_id, row_idx, label FROM lr WHERE row_idx IN (SELECT row_idx FROM w)")
def perturbation_align(spark, d):
    runs = label_runs(spark, d)
    draws = S.bootstrap_draws(runs, read(spark, d, "supplier").count(), 9, 0).withColumn("row_idx", F.col("row_idx") + 1)
    return L.align_perturbation(draws.join(runs, "row_idx").select("run_id", "draw_idx", "row_idx", "label"))


@query(f"WITH {_CELLS}, {_SIDES}, e AS (SELECT run_a, run_b, (sab - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)) AS ari FROM ra JOIN rb USING (run_a, run_b) JOIN rc USING (run_a, run_b)), m AS (SELECT run_a AS run_id, ari FROM e UNION ALL SELECT run_b, ari FROM e) SELECT run_id, {rr('avg(ari)', 'mean_ari')} FROM m GROUP BY run_id ORDER BY round(avg(ari), 12) DESC, run_id LIMIT 1")
def representative_seed(spark, d):
    return rounded(L.representative_run(L.ari_nmi(L.contingency(label_runs(spark, d)))))


@query(f"WITH {REGISTRY} SELECT family, {rr('quantile_cont(silhouette, 0.5)', 'silhouette_median')}, {rr('avg(silhouette)', 'silhouette_mean')}, {rr('coalesce(stddev_samp(silhouette), 0)', 'silhouette_sd')}, {rr('quantile_cont(mean_cluster_jaccard, 0.5)', 'mean_cluster_jaccard_median')}, {rr('avg(mean_cluster_jaccard)', 'mean_cluster_jaccard_mean')}, {rr('coalesce(stddev_samp(mean_cluster_jaccard), 0)', 'mean_cluster_jaccard_sd')} FROM rg GROUP BY family")
def seed_summary(spark, d):
    return rounded(L.seed_summary(candidates(spark, d), ["silhouette", "mean_cluster_jaccard"], ["family"]))


# --------------------------------------------------------------------------------------------------------- quality


def points(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), F.col("label").cast("int").alias("label"))


_POINTS = "e AS (SELECT vec_id AS i, embedding::DOUBLE[] AS x, label AS l FROM embeddings)"
_CENTERS = "u AS (SELECT i, l, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS k FROM e), cm AS (SELECT l, k, avg(v) AS m FROM u GROUP BY l, k), ce AS (SELECT l, list(m ORDER BY k) AS c FROM cm GROUP BY l)"


@query(f"WITH {_POINTS}, s AS (SELECT a.i, a.l AS la, b.l AS lb, sum(list_distance(a.x, b.x)) AS t, count(*) AS n FROM e a JOIN e b ON a.i <> b.i GROUP BY a.i, a.l, b.l), r AS (SELECT i, max(t / n) FILTER (la = lb) AS a, min(t / n) FILTER (la <> lb) AS b FROM s GROUP BY i) SELECT {rr('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)', 'silhouette')} FROM r")
def silhouette(spark, d):
    return rounded(Q.silhouette(points(spark, d)))


@query(f"WITH {_POINTS}, {_CENTERS}, s AS (SELECT e.l, avg(list_distance(x, c)) AS s, any_value(c) AS c FROM e JOIN ce ON e.l = ce.l GROUP BY e.l), w AS (SELECT a.l, max((a.s + b.s) / list_distance(a.c, b.c)) AS w FROM s a JOIN s b ON a.l <> b.l GROUP BY a.l) SELECT {rr('avg(w)', 'davies_bouldin')} FROM w")
def davies_bouldin(spark, d):
    return rounded(Q.davies_bouldin(points(spark, d)))


@query(f"WITH {_POINTS}, {_CENTERS}, g AS (SELECT list(m ORDER BY k) AS g FROM (SELECT k, avg(v) AS m FROM u GROUP BY k)), w AS (SELECT sum(list_distance(x, c) ** 2) AS w, count(*) AS n FROM e JOIN ce ON e.l = ce.l), b AS (SELECT sum(n * list_distance(c, g) ** 2) AS b, count(*) AS k FROM ce JOIN (SELECT l, count(*) AS n FROM e GROUP BY l) s ON ce.l = s.l, g) SELECT {rr('(b / (k - 1)) / (w / (n - k))', 'calinski_harabasz')} FROM w, b")
def calinski_harabasz(spark, d):
    return rounded(Q.calinski_harabasz(points(spark, d)))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {rr(f'corr({a}, {b})', 'r')} FROM lineitem" for a, b in combinations(_NUM, 2)))
def correlation_pairs(spark, d):
    return rounded(Q.correlation_pairs(read(spark, d, "lineitem"), _NUM))


@query()
def pca_scores(spark, d):
    return Q.pca(points(spark, d), 2).select("row_idx", F.round(F.col("scores")[0], 6).alias("pc1"), F.round(F.col("scores")[1], 6).alias("pc2"))


@query(f"WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m FROM e GROUP BY i) SELECT vec_id AS row_idx, {rr('sum((x - m) ** 2)', 'energy')} FROM e JOIN m USING (i) GROUP BY vec_id")
def pca_energy(spark, d):
    """Squared length of all scores of a row: what no rotation and no sign changes, the squared distance from the mean."""
    p = points(spark, d)
    full = Q.pca(p, p.select(F.size("features")).first()[0])
    return rounded(full.select("row_idx", F.aggregate("scores", F.lit(0.0), lambda a, x: a + x * x).alias("energy")))


# --------------------------------------------------------------------------------------------------------- scoring


@query(f"""WITH {REGISTRY} SELECT candidate_id, concat_ws(';', CASE WHEN n_clusters <= 1 THEN 'single_cluster' END, CASE WHEN tiny_cluster_fraction > 0.5 THEN 'too_many_tiny_clusters' END, CASE WHEN silhouette < -0.05 THEN 'silhouette_too_low' END, CASE WHEN ari_seed < 0 THEN 'seed_stability_too_low' END, CASE WHEN noise_fraction > 0.5 THEN 'noise_fraction_excessive' END, CASE WHEN runtime_seconds > 300 THEN 'runtime_cap_exceeded' END) AS prune_reasons FROM rg""")
def prune(spark, d):
    c = candidates(spark, d)
    return c.select("candidate_id", R.prune_reasons(c).alias("prune_reasons"))


_GATES = {"silhouette_min": -0.5, "mean_cluster_jaccard_min": 0.2}
_GATED = """gt AS (SELECT *, concat_ws(';', CASE WHEN n_clusters < 2 OR n_clusters > 10 THEN 'cluster_count_out_of_range' END, CASE WHEN dominant_cluster_fraction > 0.85 THEN 'dominant_cluster_too_large' END, CASE WHEN noise_fraction > 0.35 THEN 'noise_fraction_too_large' END, CASE WHEN min_cluster_fraction < 0.03 THEN 'cluster_too_small' END,
  CASE WHEN silhouette < -0.5 THEN 'silhouette_below_threshold' END, CASE WHEN coalesce(mean_cluster_jaccard, -1) < 0.2 THEN 'mean_cluster_jaccard_below_threshold' END) AS hard_rejection_reasons FROM fs)"""


@query(f"WITH {SCORED}, {_GATED} SELECT candidate_id, hard_rejection_reasons, hard_rejection_reasons = '' AS hard_filter_passed FROM gt")
def hard_gates(spark, d):
    return R.hard_gates(candidates(spark, d), _GATES).select("candidate_id", "hard_rejection_reasons", "hard_filter_passed")


# a third of the verdicts are given (and may differ from what the gates would say), the others are made, the missing metric included
_MISSING = "CASE WHEN mean_cluster_jaccard IS NULL THEN '\"Metric ''mean_cluster_jaccard'' required for weighted scoring is missing.\"' END"


@query(f"""WITH {SCORED}, {_GATED}, kn AS (SELECT *, CASE CAST(candidate_id AS INTEGER) % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS kept FROM gt)
  SELECT candidate_id, coalesce(kept, concat_ws(';', nullif(hard_rejection_reasons, ''), {_MISSING}) = '') AS hard_filter_passed, CASE WHEN kept IS NULL THEN concat_ws(';', nullif(hard_rejection_reasons, ''), {_MISSING}) WHEN kept THEN '' ELSE 'given' END AS hard_rejection_reasons FROM kn""")
def score_gates(spark, d):
    turn = F.col("candidate_id").cast("int") % 3
    given = candidates(spark, d).withColumn("hard_filter_passed", F.when(turn == 1, True).when(turn == 2, False)).withColumn("hard_rejection_reasons", F.when(turn == 2, "given"))
    return R.gate_where_unknown(given, _GATES, SCORE).select("candidate_id", "hard_filter_passed", "hard_rejection_reasons")


@query(f"WITH {SCORED} SELECT candidate_id, {', '.join(rr(f'utility_{k}', f'utility_{k}') for k in SCORE)}, {rr('final_weighted_score', 'final_weighted_score')}, CASE WHEN mean_cluster_jaccard IS NULL THEN 'mean_cluster_jaccard' ELSE '' END AS missing_score_metrics FROM fs")
def utility_score(spark, d):
    return rounded(R.with_utilities(candidates(spark, d), SCORE).select("candidate_id", *[R.utility_column(k) for k in SCORE], "final_weighted_score", "missing_score_metrics"))


_PILOT = {"silhouette": 0.5, "runtime_seconds": 0.3, "nmi_seed": 0.2}


@query(f"WITH {SCORED} SELECT candidate_id, {rr('utility_silhouette * 0.5 + utility_runtime * 0.3', 'pilot_score')} FROM fs")
def pilot_score(spark, d):
    return rounded(R.pilot_score(candidates(spark, d).drop("nmi_seed"), _PILOT).select("candidate_id", "pilot_score"))


def accepted_registry(spark, d):
    return R.acceptance(R.hard_gates(R.with_utilities(candidates(spark, d), SCORE), _GATES), 0.5)


_ACCEPTED = f"""{SCORED}, {_GATED}, ab AS (SELECT *, hard_rejection_reasons = '' AND final_weighted_score IS NOT NULL AS able FROM gt), ra2 AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY final_weighted_score DESC NULLS LAST, candidate_id) AS pos, count(*) OVER (PARTITION BY able) AS nn FROM ab),
  ac AS (SELECT *, able AND pos <= greatest(1, ceil(nn * 0.5)) AS accepted, CASE WHEN able AND pos > greatest(1, ceil(nn * 0.5)) THEN 'outside_top_fraction_policy' ELSE hard_rejection_reasons END AS rejection_reasons FROM ra2)"""


@query(f"WITH {_ACCEPTED} SELECT candidate_id, able AS accepted_before_top_fraction, accepted, rejection_reasons FROM ac")
def acceptance_top_fraction(spark, d):
    return accepted_registry(spark, d).select("candidate_id", "accepted_before_top_fraction", "accepted", "rejection_reasons")


@query(f"WITH {SCORED} SELECT candidate_id, CAST(row_number() OVER (ORDER BY final_weighted_score DESC NULLS LAST, family, continuous_transform, categorical_encoding, representation_name, clustering_name, candidate_id) AS INTEGER) AS rank FROM (SELECT * REPLACE (floor(final_weighted_score * 50) / 50 AS final_weighted_score) FROM fs)")
def rank(spark, d):
    scored = R.with_utilities(candidates(spark, d), SCORE).withColumn("final_weighted_score", F.floor(F.col("final_weighted_score") * 50) / 50)
    return R.rank(scored).select("candidate_id", "rank")


@query(f"WITH {_ACCEPTED}, w AS (SELECT candidate_id, greatest(coalesce(final_weighted_score, 0), 0.01) AS w FROM ac WHERE accepted) SELECT candidate_id, {rr('w / (SELECT sum(w) FROM w)', 'weight', 9)} FROM w")
def run_weights(spark, d):
    return rounded(R.run_weights(accepted_registry(spark, d).where("accepted")).select("candidate_id", "weight"), 9)


@query(f"WITH {_ACCEPTED} SELECT n_clusters AS k, {rr('sum(final_weighted_score)', 'score_sum')} FROM ac WHERE accepted GROUP BY n_clusters ORDER BY round(sum(final_weighted_score), 9) DESC, n_clusters LIMIT 1")
def target_k(spark, d):
    return rounded(R.target_k(accepted_registry(spark, d).where("accepted")))


_WENT = "rejection_reasons LIKE '%outside_top_fraction_policy%'"


@query(f"""WITH {_ACCEPTED} SELECT unnest(['generated_total', 'compatibility_rejected', 'pilot_pruned', 'full_evaluated', 'hard_rejected', 'accepted_before_top_fraction', 'accepted_final', 'top_fraction_rejected', 'consensus_used']) AS stage,
  unnest([count(*), count_if(search_stage = 'compatibility_rejected'), count_if(search_stage = 'pilot_pruned' OR CAST(candidate_id AS INTEGER) % 41 = 0), count_if(search_stage = 'full_evaluated'), count_if(search_stage = 'full_evaluated' AND NOT able AND NOT {_WENT}), count_if(able), count_if(accepted), count_if({_WENT}), count_if(accepted)])::BIGINT AS count FROM ac""")
def search_flow(spark, d):
    study = F.when(F.col("candidate_id").cast("int") % 41 == 0, "optuna_pruned")
    return R.search_flow(accepted_registry(spark, d).withColumn("final_rejection_reasons", F.concat_ws(";", "final_rejection_reasons", study)))


@query(f"WITH {_ACCEPTED} SELECT family, {rr('avg(runtime_seconds)', 'runtime_mean')}, count_if(accepted)::BIGINT AS accepted, count(*) AS candidates FROM ac GROUP BY family")
def family_summary(spark, d):
    return rounded(R.family_summary(accepted_registry(spark, d)))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS candidate_id, concat_ws(';', CASE WHEN c = 'agglomerative' AND l = 'ward' AND m <> 'euclidean' THEN 'ward_requires_euclidean' END, CASE WHEN c = 'gmm' AND v = 'full' AND p > greatest(5, n // 10) THEN 'gmm_full_high_dimensionality' END, CASE WHEN c = 'hdbscan' AND r = 'umap' AND n < 25 THEN 'hdbscan_umap_requires_more_rows' END, CASE WHEN c = 'spectral' AND n > 5000 THEN 'spectral_impractical_for_dataset_size' END,
  CASE WHEN r = 'autoencoder' AND p < 2 THEN 'autoencoder_requires_multiple_features' END, CASE WHEN c = 'ae_gmm' AND p < 2 THEN 'deep_clusterer_requires_multiple_features' END, CASE WHEN c = 'ae_gmm' AND r <> 'none' THEN 'deep_clusterer_requires_raw_processed_features' END, CASE WHEN c = 'ae_gmm' AND 8 > greatest(2, n // 5) THEN 'ae_gmm_latent_dim_too_large' END, CASE WHEN c <> 'hdbscan' AND k < 2 THEN 'cluster_count_less_than_two' END, CASE WHEN c <> 'hdbscan' AND k >= 2 AND k >= n THEN 'cluster_count_too_large_for_rows' END) AS reasons
  FROM (SELECT p_partkey, ['agglomerative', 'gmm', 'hdbscan', 'spectral', 'ae_gmm'][p_partkey % 5 + 1] AS c, ['none', 'umap', 'autoencoder'][p_partkey % 3 + 1] AS r, CASE WHEN p_partkey % 2 = 0 THEN 'ward' ELSE 'average' END AS l, CASE WHEN p_partkey % 7 = 0 THEN 'manhattan' ELSE 'euclidean' END AS m, CASE WHEN p_partkey % 11 = 0 THEN 'diag' ELSE 'full' END AS v, p_size % 12 AS k, CASE WHEN p_partkey % 13 = 0 THEN 6000 ELSE p_size END AS n, p_partkey % 9 AS p FROM part)""")
def compatibility(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    at = lambda names, m: F.element_at(F.array(*map(F.lit, names)), (k % m + 1).cast("int"))
    t = p.select(k.cast("string").alias("candidate_id"), at(["agglomerative", "gmm", "hdbscan", "spectral", "ae_gmm"], 5).alias("clusterer"), at(["none", "umap", "autoencoder"], 3).alias("representation"), F.when(k % 2 == 0, "ward").otherwise("average").alias("linkage"), F.when(k % 7 == 0, "manhattan").otherwise("euclidean").alias("metric"), F.when(k % 11 == 0, "diag").otherwise("full").alias("covariance_type"), (F.col("p_size") % 12).alias("k"), F.when(k % 13 == 0, 6000).otherwise(F.col("p_size")).alias("n"), (k % 9).alias("p"), F.lit(8).alias("latent_dim"))
    return t.select("candidate_id", R.compatibility_reasons().alias("reasons"))


@query("SELECT t AS transform, c AS clusterer, k AS n_clusters FROM (SELECT unnest(['standard', 'robust']) AS t), (SELECT unnest(['kmeans', 'gmm']) AS c), (SELECT unnest([2, 3, 4])::INTEGER AS k)")
def candidate_grid(spark, d):
    grid = search.candidate_grid(["standard", "robust"], ["onehot"], [{"name": "none"}], [{"name": "kmeans", "params": {"n_clusters": [2, 3, 4]}}, {"name": "gmm", "params": {"n_clusters": [2, 3, 4]}}])
    return search.registry(spark, grid).select(F.col("continuous_transform").alias("transform"), F.col("clustering_name").alias("clusterer"), F.get_json_object("clustering_params_json", "$.n_clusters").cast("int").alias("n_clusters"))


# ------------------------------------------------------------------------------------------------------- consensus

_VECTORS = f"{RUNS}, v AS (SELECT row_idx, max(label) FILTER (run_id = 0) AS a, max(label) FILTER (run_id = 1) AS b, max(label) FILTER (run_id = 2) AS c FROM lr GROUP BY row_idx)"
_W = lambda x, y: f"(CASE WHEN {x}.a >= 0 AND {y}.a >= 0 THEN 0.5 ELSE 0 END + CASE WHEN {x}.b >= 0 AND {y}.b >= 0 THEN 0.3 ELSE 0 END + CASE WHEN {x}.c >= 0 AND {y}.c >= 0 THEN 0.2 ELSE 0 END)::DOUBLE"
_SAME = lambda x, y: f"(CASE WHEN {x}.a >= 0 AND {x}.a = {y}.a THEN 0.5 ELSE 0 END + CASE WHEN {x}.b >= 0 AND {x}.b = {y}.b THEN 0.3 ELSE 0 END + CASE WHEN {x}.c >= 0 AND {x}.c = {y}.c THEN 0.2 ELSE 0 END)::DOUBLE"
_PAIRS = f"{_VECTORS}, co AS (SELECT x.row_idx AS i, y.row_idx AS j, CASE WHEN x.row_idx = y.row_idx THEN 1.0 WHEN {_W('x', 'y')} > 0 THEN {_SAME('x', 'y')} / {_W('x', 'y')} ELSE 0 END AS c, y.a AS cl, x.a AS own FROM v x, v y)"


@query(f"WITH {_VECTORS} SELECT array_to_string([a, b, c], ',') AS labels, count(*) AS n, min(row_idx) AS first_row FROM v GROUP BY a, b, c")
def signature_table(spark, d):
    return C.signatures(label_runs(spark, d))[0].select(F.array_join("labels", ",").alias("labels"), "n", "first_row")


@query(f"WITH {_PAIRS} SELECT i, j, {rr('c', 'c')} FROM co WHERE i < j")
def coassociation(spark, d):
    return C.coassociation(label_runs(spark, d), WEIGHTS, digits=6)


def given_labels(spark, d):
    return label_runs(spark, d).where("run_id = 0").select("row_idx", F.col("label").alias("consensus_label"))


_CERTAIN = f"""{_PAIRS}, s AS (SELECT i, own, cl, avg(c) AS s FROM co GROUP BY i, own, cl), p AS (SELECT i, own, s / sum(s) OVER (PARTITION BY i) AS p FROM s),
  un AS (SELECT i AS row_idx, own AS consensus_label, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS entropy, list(p ORDER BY p DESC) AS ps FROM p GROUP BY i, own), kk AS (SELECT count(DISTINCT a) AS k FROM v),
  ux AS (SELECT *, entropy / ln(k) AS normalized_entropy, ps[1] AS top1, ps[2] AS top2, ps[1] - ps[2] AS gap, quantile_cont(entropy, 0.9) OVER () AS q FROM un, kk),
  uz AS (SELECT *, gap < 0.1 OR (entropy > 1e-12 AND entropy >= q - 1e-12) AS ambiguous FROM ux)"""


@query(f"WITH {_CERTAIN} SELECT row_idx, consensus_label, {', '.join(rr(x, x) for x in ('entropy', 'normalized_entropy', 'top1', 'top2', 'gap'))}, ambiguous FROM uz")
def uncertainty(spark, d):
    return rounded(C.uncertainty(label_runs(spark, d), WEIGHTS, given_labels(spark, d)))


@query(f"WITH {_CERTAIN}, wi AS (SELECT own AS consensus_label, avg(c) FILTER (i <> j) AS mean_within FROM co WHERE own = cl GROUP BY own) SELECT consensus_label, count(*) AS size, {rr('quantile_cont(entropy, 0.5)', 'median_entropy')}, {rr('avg(entropy)', 'mean_entropy')}, {rr('avg(ambiguous::INTEGER)', 'ambiguous_fraction')}, {rr('any_value(coalesce(mean_within, 1))', 'mean_within')} FROM uz JOIN wi USING (consensus_label) GROUP BY consensus_label")
def consensus_summary(spark, d):
    runs, given = label_runs(spark, d), given_labels(spark, d)
    return rounded(C.cluster_summary(runs, WEIGHTS, given, C.uncertainty(runs, WEIGHTS, given)))


@query()
def consensus_hierarchical(spark, d):
    return C.consensus_labels(label_runs(spark, d), WEIGHTS, 3)


@query()
def consensus_spectral(spark, d):
    return C.consensus_labels(label_runs(spark, d), WEIGHTS, 3, "spectral")


@query()
def consensus_bootstrap(spark, d):
    return C.run_bootstrap(label_runs(spark, d), WEIGHTS, 3, 10)


# ----------------------------------------------------------------------------------------------------- explanation

_CUST = "cu AS (SELECT c_custkey, c_nationkey % 3 AS cluster, c_acctbal AS bal, CAST(c_acctbal > 5000 AS INTEGER) AS rich, c_mktsegment AS seg FROM customer)"


def clustered(spark, d):
    return read(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("cluster"), F.col("c_acctbal").alias("bal"), (F.col("c_acctbal") > 5000).cast("int").alias("rich"), F.col("c_mktsegment").alias("seg"))


@query(f"WITH {_CUST}, m AS (SELECT cluster, seg FROM cu GROUP BY cluster, seg QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, seg) = 1) SELECT cluster, 'bal' AS feature, 'mean' AS kind, NULL::VARCHAR AS value, {rr('avg(bal)', 'value_num', 4)} FROM cu GROUP BY cluster UNION ALL SELECT cluster, 'rich', 'prevalence', NULL, round(avg(rich), 4) + 0.0 FROM cu GROUP BY cluster UNION ALL SELECT cluster, 'seg', 'mode', seg, NULL FROM m")
def cluster_profiles(spark, d):
    return rounded(E.profiles(clustered(spark, d), "cluster", ["bal"], ["rich"], ["seg"]), 4)


@query(f"WITH {_CUST}, g AS (SELECT cluster, count(*) AS n, avg(bal) AS m, stddev_samp(bal) AS s, avg(rich) AS p FROM cu GROUP BY cluster), j AS (SELECT a.cluster AS cluster_a, b.cluster AS cluster_b, a.m - b.m AS dm, sqrt(((a.n - 1) * a.s ** 2 + (b.n - 1) * b.s ** 2) / (a.n + b.n - 2)) AS sp, a.p - b.p AS dp, 2 * asin(sqrt(a.p)) - 2 * asin(sqrt(b.p)) AS h FROM g a JOIN g b ON a.cluster < b.cluster) SELECT cluster_a, cluster_b, 'bal' AS feature, {rr('dm', 'difference', 4)}, {rr('dm / sp', 'effect_size')} FROM j UNION ALL SELECT cluster_a, cluster_b, 'rich', round(dp, 4) + 0.0, round(h, 6) + 0.0 FROM j")
def pairwise_contrasts(spark, d):
    c = E.contrasts(clustered(spark, d), "cluster", ["bal"], ["rich"])
    return c.select("cluster_a", "cluster_b", "feature", (F.round("difference", 4) + 0.0).alias("difference"), (F.round("effect_size", 6) + 0.0).alias("effect_size"))


def blobs(spark, d):
    """Customers as points with structure: segments' centers and a spread from the balance."""
    c = read(spark, d, "customer")
    seg = F.pmod(F.crc32(F.col("c_mktsegment").cast("binary")), F.lit(3)).cast("int")
    u = (F.pmod(F.xxhash64("c_custkey"), F.lit(1000)) / 1000.0) - 0.5
    return c.select(F.col("c_custkey").alias("row_idx"), F.array(seg * 4.0 + u, (seg % 2) * 4.0 + F.col("c_acctbal") / 10000.0, u * 0.5).alias("features"), seg.alias("label"))


@query()
def kmeans_consensus(spark, d):
    """k-means and a mixture with three seeds each, their consensus, and how certain it is."""
    grid = search.candidate_grid(["none"], ["onehot"], [{"name": "none"}], [{"name": "kmeans", "params": {"n_clusters": 3}}, {"name": "gmm", "params": {"n_clusters": 3, "covariance_type": "diag"}}])
    fits = search.run_fits(blobs(spark, d), search.registry(spark, grid), [101, 102, 103])
    runs = fits.select(F.concat_ws("/", "candidate_id", "run_id").alias("run_id"), "row_idx", "label")
    w = [1 / 6] * 6
    return rounded(C.uncertainty(runs, w, C.consensus_labels(runs, w, 3)))


@query()
def seed_stability(spark, d):
    grid = search.candidate_grid(["none"], ["onehot"], [{"name": "none"}, {"name": "pca", "params": {"n_components": 2}}], [{"name": "kmeans", "params": {"n_clusters": [2, 3]}}, {"name": "minibatch_kmeans", "params": {"n_clusters": 3}}])
    return rounded(search.stability(search.run_fits(blobs(spark, d), search.registry(spark, grid), [101, 102, 103])))


_FINDERS = {"kmeans": {"n_clusters": None}, "minibatch_kmeans": {"n_clusters": None}, "gmm": {"n_components": None, "covariance_type": "diag"}, "agglomerative": {"n_clusters": None, "linkage": "average"}, "spectral": {"n_clusters": None}, "birch": {"n_clusters": None}, "hdbscan": {"min_cluster_size": 10}}


@query(" UNION ALL ".join(f"SELECT '{n}' AS clusterer, true AS found" for n in _FINDERS))
def clusterers_find_groups(spark, d):
    """Whether each clusterer, told how many groups were planted, agrees with them: an adjusted Rand index above 0.9."""
    planted = blobs(spark, d)
    k = planted.select("label").distinct().count()
    grid = search.candidate_grid(["none"], ["onehot"], [{"name": "none"}], [{"name": n, "params": {a: k if v is None else v for a, v in p.items()}} for n, p in _FINDERS.items()])
    named = search.registry(spark, grid).select("candidate_id", F.col("clustering_name").alias("run_b"))
    found = search.run_fits(planted, search.registry(spark, grid), [101]).join(named, "candidate_id").select("run_b", "row_idx", F.col("label").alias("lb"))
    # each clusterer against what was planted, and not with one another
    cells = planted.select("row_idx", F.col("label").alias("la")).join(found, "row_idx").groupBy(F.lit("planted").alias("run_a"), "run_b", "la", "lb").agg(F.count("*").alias("n"))
    return L.ari_nmi(cells).select(F.col("run_b").alias("clusterer"), (F.col("ari") > 0.9).alias("found"))


@query()
def kmeans_at_scale(spark, d):
    return search.kmeans_distributed(blobs(spark, d), 3, 7)


@query()
def surrogate_cv(spark, d):
    return rounded(E.surrogate_cv(blobs(spark, d), "row_idx", 3, 1, 10)[0])


@query()
def permutation_importance(spark, d):
    return rounded(E.permutation_importance(blobs(spark, d), "row_idx", {"x": [0], "y": [1], "x+y": [0, 1], "u": [2]}, 10, 2))


# ------------------------------------------------------------------------------------------------------- reporting


@query("SELECT s_suppkey AS row_idx, " + ", ".join(f"CAST(s_nationkey % 3 = {k} AS INTEGER) AS c_{k}" for k in range(3)) + " FROM supplier")
def onehot_membership(spark, d):
    return X.membership(given_labels(spark, d))


@query(f"WITH {REGISTRY} SELECT candidate_id, {rr('ln(1 + n_clusters) / ln(1001)', 'parsimony_penalty')}, {rr('12 / 1000.0::DOUBLE', 'feature_dimensionality_penalty')}, 0.0::DOUBLE AS runtime_penalty FROM rg")
def penalties(spark, d):
    return rounded(candidates(spark, d).select("candidate_id", *[e.alias(k) for k, e in X.penalties("n_clusters", 1000, 12).items()]))


@query(f"WITH {REGISTRY} SELECT family AS candidate_id, 'inertia' AS name, {rr('avg(silhouette)', 'value')} FROM rg GROUP BY family UNION ALL SELECT family, 'bic', round(avg(mean_cluster_jaccard), 6) + 0.0 FROM rg WHERE mean_cluster_jaccard IS NOT NULL GROUP BY family")
def metadata_means(spark, d):
    runs = candidates(spark, d).select(F.col("family").alias("candidate_id"), F.map_filter(F.create_map(F.lit("inertia"), "silhouette", F.lit("bic"), "mean_cluster_jaccard"), lambda k, v: v.isNotNull()).alias("metadata"))
    return rounded(X.metadata_means(runs))


@query(f"WITH {_CERTAIN} SELECT consensus_label, count(*) AS rows, {rr('avg(top1)', 'mean_support')}, {rr('avg(gap)', 'mean_gap')}, {rr('avg(ambiguous::INTEGER)', 'ambiguous_share')}, count(*) AS summary_size FROM uz GROUP BY consensus_label")
def size_and_confidence(spark, d):
    runs, given = label_runs(spark, d), given_labels(spark, d)
    sure = C.uncertainty(runs, WEIGHTS, given)
    return rounded(X.size_and_confidence(sure, sure.groupBy("consensus_label").agg(F.count("*").alias("size"))))


@query(f"WITH {_CUST} SELECT 'bal' AS feature, " + ", ".join(f"round(avg(bal) FILTER (cluster = {k}), 4) + 0.0 AS \"{k}\"" for k in range(3)) + " FROM cu UNION ALL SELECT 'rich', " + ", ".join(f"round(avg(rich) FILTER (cluster = {k}), 4) + 0.0" for k in range(3)) + " FROM cu")
def profile_heatmap(spark, d):
    return rounded(X.profile_heatmap(E.profiles(clustered(spark, d), "cluster", ["bal"], ["rich"], ["seg"]), [0, 1, 2]), 4)


@query(f"WITH {REGISTRY} SELECT candidate_id FROM rg WHERE search_stage <> 'full_evaluated'")
def candidates_to_do(spark, d):
    c = candidates(spark, d)
    return X.still_to_do(c.select("candidate_id"), c.where("search_stage = 'full_evaluated'"))


@query(f"WITH {REGISTRY} SELECT candidate_id FROM rg WHERE search_stage = 'full_evaluated'")
def candidates_done(spark, d):
    c = candidates(spark, d)
    return X.already_done(c.select("candidate_id"), c.where("search_stage = 'full_evaluated'"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS candidate_id, max(o_orderkey) AS sequence FROM orders GROUP BY o_custkey")
def latest_per_candidate(spark, d):
    return R.latest_per_candidate(read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("candidate_id"), F.col("o_orderkey").alias("sequence")), "sequence")


@query("SELECT p_brand, p_name AS feature, p_retailprice AS importance_mean FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name) <= 3")
def top_features(spark, d):
    return X.top_features(read(spark, d, "part").select("p_brand", F.col("p_name").alias("feature"), F.col("p_retailprice").alias("importance_mean")), ["p_brand"], 3)


@query(f"WITH {_ACCEPTED}, f AS (SELECT family, avg(runtime_seconds) AS r, count_if(accepted)::BIGINT AS a FROM ac GROUP BY family) SELECT {rr('max(r) FILTER (family = $$deep$$) / max(r) FILTER (family = $$classical$$)', 'runtime_ratio')}, max(a) FILTER (family = 'classical') AS classical_accepted, max(a) FILTER (family = 'deep') AS deep_accepted FROM f")
def family_comparison(spark, d):
    return rounded(X.family_comparison(R.family_summary(accepted_registry(spark, d))))


_CUT = f"""{_PAIRS}, cuts AS (SELECT 0 AS k, co.i, co.j, 1 - co.c AS d, x.a AS li, y.a AS lj FROM co JOIN v x ON x.row_idx = co.i JOIN v y ON y.row_idx = co.j UNION ALL SELECT 1, co.i, co.j, 1 - co.c, x.b, y.b FROM co JOIN v x ON x.row_idx = co.i JOIN v y ON y.row_idx = co.j),
  per AS (SELECT k, i, li = lj AS own, lj, sum(d) FILTER (i <> j) AS t, count(*) FILTER (i <> j) AS m FROM cuts GROUP BY k, i, li, lj),
  ea AS (SELECT k, i, max(t / m) FILTER (own AND m > 0) AS a, max(m) FILTER (own) AS am, min(t / m) FILTER (NOT own) AS b FROM per GROUP BY k, i)"""


@query(f"WITH {_CUT} SELECT k, {rr('avg(CASE WHEN am = 0 OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END)', 'silhouette')} FROM ea GROUP BY k")
def data_driven_k(spark, d):
    """Silhouettes of two given cuts, those of the first two runs, over the runs' agreement."""
    sigs = C.signatures(label_runs(spark, d))[0]
    cut = lambda i: sigs.select(F.lit(i).alias("k"), "sig_id", "n", F.get("labels", F.lit(i)).alias("label"))
    return rounded(X.data_driven_k(cut(0).union(cut(1)), C.signature_agreement(sigs, WEIGHTS)))


@query()
def synthetic_source(spark, d):
    return X.synthetic_table(spark)
