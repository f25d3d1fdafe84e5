"""Imputation, encoding and scaling: each fit is one aggregation, each transform one projection, so a pipeline is two passes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RARE, MISSING = "__RARE__", "__MISSING__"


def _one(df: DataFrame, exprs: dict[str, Column]) -> dict:
    return df.agg(*[e.alias(k) for k, e in exprs.items()]).first().asDict() if exprs else {}


def _broadcast_fit(df: DataFrame, **exprs: Column) -> DataFrame:
    """Every row with the aggregates beside it: one row, so always small enough to send along."""
    return df.crossJoin(F.broadcast(df.agg(*[e.alias(k) for k, e in exprs.items()])))


#: Ranges that one pass of exact_quantiles counts a column in, and values of one range that are brought together at last.
RANGES, GATHERED = 1024, 20_000


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of every column, null for a column without values; no value is held per distinct value.

    Values are counted in ranges of equal width; the range that holds a wanted rank is counted again in narrower ones until it holds few
    values, which are sorted. A pass ships a few counts a column and task; rounds depend on the spread of the values, not on the rows."""
    if not columns:
        return {}
    x = {i: F.col(f"`{c}`").cast("double") for i, c in enumerate(columns)}
    x = {i: F.when(~F.isnan(v), v) for i, v in x.items()}
    ends = df.agg(*[e for i, v in x.items() for e in (F.count(v).alias(f"n{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"z{i}"))]).first()
    endless = [i for i in x if ends[f"n{i}"] and math.isinf(ends[f"z{i}"] - ends[f"a{i}"])]
    if endless:  # no ranges of equal width
        rest = exact_quantiles(df, [c for i, c in enumerate(columns) if i not in endless], shares)
        got = df.agg(*[F.percentile(x[i], F.array(*map(F.lit, shares))).alias(f"q{i}") for i in endless]).first()
        return {c: got[f"q{i}"] if i in endless else rest[c] for i, c in enumerate(columns)}
    wanted: dict[tuple[int, int], float | None] = {}
    for i in x:
        n = ends[f"n{i}"]
        for q in shares if n else []:
            wanted |= dict.fromkeys([(i, math.floor(q * (n - 1))), (i, math.ceil(q * (n - 1)))])
    # ranges still open: column -> {(from, to, rows before it, rows in it): ranks}
    open_ = {(i, ends[f"a{i}"], ends[f"z{i}"], 0, ends[f"n{i}"]): [k for j, k in wanted if j == i] for i in x if ends[f"n{i}"]}
    while open_:
        few = {r: ks for r, ks in open_.items() if r[1] == r[2] or r[4] <= GATHERED}
        many = {r: ks for r, ks in open_.items() if r not in few}
        for (i, lo, hi, before, n), ks in few.items():
            if lo == hi:
                wanted |= {(i, k): lo for k in ks}
                continue
            values = sorted(r[0] for r in df.select(x[i].alias("v")).where((F.col("v") >= lo) & (F.col("v") <= hi)).collect())
            wanted |= {(i, k): values[k - before] for k in ks}
        if not many:
            break
        cells = []
        for i, lo, hi, *_ in many:
            inside = x[i].isNotNull() & (x[i] >= lo) & (x[i] <= hi)
            cell = F.least(F.floor((x[i] - lo) / (hi - lo) * RANGES), F.lit(RANGES - 1)).cast("int")
            cells.append(F.when(inside, F.struct(F.lit(len(cells)).alias("r"), cell.alias("cell"), x[i].alias("v"))))
        flat = df.select(F.explode(F.array(*cells)).alias("c")).where("c is not null")
        counts: dict[int, list] = {}
        for r in flat.groupBy("c.r", "c.cell").agg(F.count("*").alias("n"), F.min("c.v").alias("a"), F.max("c.v").alias("z")).orderBy("r", "cell").collect():
            counts.setdefault(r.r, []).append(r)
        open_ = {}
        for at, ((i, _, _, before, _), ks) in enumerate(many.items()):
            seen = before
            for r in counts[at]:
                own = [k for k in ks if seen <= k < seen + r.n]
                if own:
                    open_[i, r.a, r.z, seen, r.n] = own
                seen += r.n
    out = {}
    for i, c in enumerate(columns):
        n, got = ends[f"n{i}"], []
        for q in shares if n else []:
            r = q * (n - 1)
            low, high = wanted[i, math.floor(r)], wanted[i, math.ceil(r)]
            got.append(low if low == high else low + (high - low) * (r - math.floor(r)))
        out[c] = got or [None] * len(shares)
    return out


def median_impute(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(exact_quantiles(df, [column], [0.5])[column][0]).cast("double")))


def mode_impute(df: DataFrame, column: str) -> DataFrame:
    """Ties go to the smallest value."""
    return _broadcast_fit(df, _m=F.mode(column, True)).withColumn(column, F.coalesce(column, "_m")).drop("_m")


def missing_indicator(df: DataFrame, column: str, block: str) -> DataFrame:
    return df.withColumn(f"{block}__{column}__missing", F.col(column).isNull().cast("double"))


def knn_impute(df: DataFrame, key: str, columns: list[str], k: int = 5, weights: str = "uniform", most_missing: int = 100_000) -> DataFrame:
    """Mean of the k nearest rows that have the column, by distance over the columns both have, scaled up to all of them.

    The rows with a gap are the query set: they are sent along in blocks, and every other row keeps only its best k per query and
    partition before anything is shuffled.
    """
    import pandas as pd

    base = df.select(key, *columns)
    gaps = base.where(" or ".join(f"`{c}` is null" for c in columns))
    n = gaps.count()
    if n == 0:
        return df
    means = _one(base, {c: F.avg(c) for c in columns})
    out = None
    schema = f"q long, c int, d double, v double, r {dict(df.dtypes)[key]}"
    for b in range(-(-n // most_missing)):
        rows = gaps.where(F.pmod(F.xxhash64(key), F.lit(-(-n // most_missing))) == b).toPandas()
        q = rows[columns].to_numpy(float)

        def nearest(frames, q=q):
            best: list[list] = [[] for _ in range(len(q) * len(columns))]
            for f in frames:
                x, ids = f[columns].to_numpy(float), f[key].to_numpy()
                for i, row in enumerate(q):
                    both = ~np.isnan(x) & ~np.isnan(row)
                    seen = both.sum(1)
                    d = np.sqrt(np.where(both, (x - row) ** 2, 0).sum(1) * len(columns) / np.maximum(seen, 1))
                    for c in np.flatnonzero(np.isnan(row)):
                        ok = np.flatnonzero(~np.isnan(x[:, c]) & (seen > 0))
                        top = ok[np.lexsort((ids[ok], d[ok]))[:k]]
                        here = best[i * len(columns) + c] + [(d[j], ids[j], x[j, c]) for j in top]
                        best[i * len(columns) + c] = sorted(here)[:k]
            rows = [(i // len(columns), i % len(columns), d, v, r) for i, own in enumerate(best) for d, r, v in own]
            yield pd.DataFrame(rows, columns=["q", "c", "d", "v", "r"])

        found = base.mapInPandas(nearest, schema)
        top = found.withColumn("n", F.row_number().over(Window.partitionBy("q", "c").orderBy("d", "r"))).where(F.col("n") <= k)
        if weights == "distance":
            zero = F.max((F.col("d") == 0).cast("int")).over(Window.partitionBy("q", "c")) == 1
            top = top.withColumn("w", F.when(zero, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d")))
        else:
            top = top.withColumn("w", F.lit(1.0))
        filled = top.groupBy("q", "c").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
        names = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(rows[key].tolist())], f"q long, `{key}` {dict(df.dtypes)[key]}")
        wide = names.join(filled, "q").groupBy(key).agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(f"_f{i}") for i in range(len(columns))])
        out = wide if out is None else out.union(wide)
    joined = df.join(out, key, "left")
    return joined.select(*[F.coalesce(c, f"_f{columns.index(c)}", F.lit(means[c])).alias(c) if c in columns else F.col(c) for c in df.columns])


def iterative_impute(df: DataFrame, columns: list[str], rounds: int = 10, ridge: float = 1e-3, initial: str = "mean") -> DataFrame:
    """Round-robin ridge regressions of each column on the others. Every step fits from Gram sums, one aggregation each."""
    start = _one(df, {c: F.avg(c) for c in columns}) if initial == "mean" else {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}
    holes = [c for c in columns if df.where(F.col(c).isNull()).limit(1).count()]
    models: dict[str, tuple[float, dict[str, float]]] = {c: (start[c] if start[c] is not None else 0.0, {}) for c in columns}

    def filled(c: str, level: int) -> DataFrame:
        return _apply_models(df, columns, models, level)

    for _ in range(rounds):
        for c in holes:
            x = [o for o in columns if o != c]
            rows = filled(c, 2).where(F.col(c).isNotNull())
            g = _one(rows, {"n": F.count("*"), **{f"s{i}": F.sum(f"_x_{o}") for i, o in enumerate(x)}, **{f"p{i}_{j}": F.sum(F.col(f"_x_{a}") * F.col(f"_x_{b}")) for i, a in enumerate(x) for j, b in enumerate(x) if i <= j}, "y": F.sum(c), **{f"y{i}": F.sum(F.col(f"_x_{o}") * F.col(c)) for i, o in enumerate(x)}})
            n = g["n"] or 1
            s = np.array([g[f"s{i}"] for i in range(len(x))], float)
            gram = np.array([[g[f"p{min(i, j)}_{max(i, j)}"] for j in range(len(x))] for i in range(len(x))], float) - np.outer(s, s) / n
            right = np.array([g[f"y{i}"] for i in range(len(x))], float) - s * g["y"] / n
            w = np.linalg.solve(gram + ridge * max(1e-12, np.trace(gram) / max(1, len(x))) * np.eye(len(x)), right)
            models[c] = (float(g["y"] / n - s @ w / n), dict(zip(x, w.tolist(), strict=True)))
    return _apply_models(df, columns, models, 2).select(*[F.col(f"_x_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def _apply_models(df: DataFrame, columns: list[str], models, level: int) -> DataFrame:
    """Columns _x_<c>: the value, or its model on first fills of the others."""
    first = df.withColumns({f"_0_{c}": F.coalesce(c, F.lit(models[c][0] if not models[c][1] else None).cast("double")) for c in columns})
    means = {c: models[c][0] for c in columns}
    fill = {c: F.coalesce(f"_0_{c}", F.lit(means[c])) for c in columns}
    second = first.withColumns({f"_1_{c}": F.coalesce(F.col(c).cast("double"), _linear(models[c], {o: fill[o] for o in columns})) for c in columns})
    return second.withColumns({f"_x_{c}": F.coalesce(F.col(c).cast("double"), _linear(models[c], {o: F.col(f"_1_{o}") for o in columns})) for c in columns})


def _linear(model: tuple[float, dict[str, float]], values: dict[str, Column]) -> Column:
    out = F.lit(model[0])
    for o, w in model[1].items():
        out = out + values[o] * w
    return out


def rare_collapse(df: DataFrame, column: str, threshold: float | int, token: str = RARE) -> DataFrame:
    """Levels below the threshold become one. A float up to 1.0 is a share of the rows (rounded up), an int a count."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    if isinstance(threshold, float) and threshold <= 1.0:
        least = F.greatest(F.lit(1), F.ceil(F.sum("_n").over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * threshold))
    else:
        least = F.lit(max(1, int(threshold)))
    keep = counts.select(F.col(column).alias("_v"), (F.col("_n") >= least).alias("_keep"))
    out = df.join(keep, F.col(column).eqNullSafe(F.col("_v")), "left").withColumn(column, F.when(F.col("_keep"), F.col(column).cast("string")).otherwise(F.lit(token)))
    return out.drop("_v", "_keep")


def as_level(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def levels(df: DataFrame, column: str) -> list[str]:
    return sorted(r[0] for r in df.select(as_level(column).alias("v")).distinct().collect())


def one_hot(df: DataFrame, column: str, block: str, known: list[str] | None = None) -> DataFrame:
    """A 0/1 column per level, in sorted order; unknown levels are all zero."""
    known = levels(df, column) if known is None else known
    return df.withColumns({f"{block}__{column}_{v}": (as_level(column) == v).cast("double") for v in known})


def ordinal(df: DataFrame, column: str, known: list | None = None) -> DataFrame:
    """Index in the declared levels, or in sorted order; unknown or missing is -1."""
    known = levels(df, column) if known is None else known
    typed = F.array(*map(F.lit, known))
    return df.withColumn(column, F.coalesce(F.array_position(typed, F.col(column)) - 1, F.lit(-1)).cast("double"))


def standard_scale(df: DataFrame, column: str) -> DataFrame:
    out = _broadcast_fit(df, _m=F.avg(column), _s=F.stddev_pop(column))
    return out.withColumn(column, (F.col(column) - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")


def robust_scale(df: DataFrame, column: str) -> DataFrame:
    low, middle, high = exact_quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    spread = (high - low if middle is not None else 0.0) or 1.0
    return df.withColumn(column, (F.col(column) - F.lit(middle).cast("double")) / spread)


def log1p_scale(df: DataFrame, column: str) -> DataFrame:
    if (_one(df, {"m": F.min(column)})["m"] or 0) < 0:
        raise ValueError(f"{column} has negative values, so log1p does not apply")
    return standard_scale(df.withColumn(column, F.log1p(column)), column)


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log1p(x) if abs(power) < 1e-12 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if abs(power - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def power_lambda(df: DataFrame, column: str, lo: float = -2.0, hi: float = 4.0, rounds: int = 3, grid: int = 13) -> float:
    """Likelihood-best Yeo-Johnson power: a grid of powers is tried in one aggregation, then refined around the best."""
    x = F.col(column).cast("double")
    for _ in range(rounds):
        tried = np.linspace(lo, hi, grid)
        got = _one(df, {"n": F.count(column), "j": F.sum(F.signum(x) * F.log1p(F.abs(x))), **{f"v{i}": F.var_pop(yeo_johnson(x, float(p))) for i, p in enumerate(tried)}})
        fits = [-got["n"] / 2 * math.log(got[f"v{i}"]) + (p - 1) * got["j"] if got[f"v{i}"] else -math.inf for i, p in enumerate(tried)]
        best = int(np.argmax(fits))
        lo, hi = float(tried[max(0, best - 1)]), float(tried[min(grid - 1, best + 1)])
    return float(tried[best])


def power_scale(df: DataFrame, column: str) -> DataFrame:
    return standard_scale(df.withColumn(column, yeo_johnson(F.col(column).cast("double"), power_lambda(df, column))), column)


def variance_survivors(df: DataFrame, columns: list[str], threshold: float = 0.0) -> list[str]:
    var = _one(df, {c: F.var_pop(c) for c in columns})
    return [c for c in columns if var[c] is not None and var[c] > threshold]


def variance_filter(df: DataFrame, columns: list[str], threshold: float = 0.0) -> DataFrame:
    gone = set(columns) - set(variance_survivors(df, columns, threshold))
    return df.drop(*gone)


@dataclass
class Roles:
    """Which columns are modelled, and how; ids and targets stay outside."""

    continuous: list[str] = field(default_factory=list)
    binary: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    ordinal: list[str] = field(default_factory=list)
    ordinal_maps: dict[str, list] = field(default_factory=dict)

    def all(self) -> list[str]:
        return [*self.continuous, *self.binary, *self.categorical, *self.ordinal]


def _scale_fits(df: DataFrame, columns: list[str], transform: str) -> dict[str, tuple[float, float]]:
    """(shift, divisor) of every column, all from one aggregation."""
    if transform == "none" or not columns:
        return {c: (0.0, 1.0) for c in columns}
    if transform == "robust":
        got = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        pairs = {c: (q[1], q[2] - q[0]) if (q := got[c])[1] is not None else (0.0, 1.0) for c in columns}
    else:
        got = _one(df, {k: e for c in columns for k, e in ((f"m_{c}", F.avg(c)), (f"s_{c}", F.stddev_pop(c)))})
        pairs = {c: (got[f"m_{c}"] or 0.0, got[f"s_{c}"] or 0.0) for c in columns}
    return {c: (float(m), float(s) or 1.0) for c, (m, s) in pairs.items()}


def preprocess(df: DataFrame, roles: Roles, key: str, transform: str = "standard", encoding: str = "onehot", indicators: bool = True, rare: float | int | None = None, variance: float | None = None, rare_token: str = RARE) -> tuple[DataFrame, list[str]]:
    """(key, features array) and the features' names: blocks in the order continuous, binary, categorical, ordinal, indicators last in each.

    Fits take three passes whatever the number of columns: gaps, medians and modes; levels of the collapsed columns; scales. All
    else is one projection. A column that is null throughout is dropped. Names and values are filtered together.
    """
    others = [*roles.binary, *roles.categorical, *roles.ordinal]
    fits = _one(df, {"n": F.count("*"), **{f"g_{c}": F.count_if(F.col(c).isNull()) for c in roles.all()}, **{f"c_{c}": F.mode(c, True) for c in others}})
    fits |= {f"c_{c}": q[0] for c, q in exact_quantiles(df, [c for c in roles.continuous if fits[f"g_{c}"]], [0.5]).items()}
    gaps = {c: fits[f"g_{c}"] for c in roles.all()}
    full = [c for c in roles.all() if gaps[c] < fits["n"] or c in roles.categorical]
    flags = {f"{b}__{c}__missing": F.col(c).isNull().cast("double") for b in ("continuous", "binary", "categorical", "ordinal") for c in getattr(roles, b) if indicators and gaps[c] and c in full}
    filled = {c: F.coalesce(F.col(c).cast("double") if c in roles.continuous else F.col(c), F.lit(fits[f"c_{c}"])) for c in full if gaps[c] and fits.get(f"c_{c}") is not None}
    filled |= {c: F.col(c).cast("double") for c in full if c in roles.continuous and c not in filled}
    out = df.withColumns(flags).withColumns(filled) if flags else df.withColumns(filled) if filled else df

    numbers = [c for c in roles.continuous if c in full]
    if transform == "log1p_standard" and numbers:
        low = _one(out, {c: F.min(c) for c in numbers})
        bad = [c for c in numbers if (low[c] or 0) < 0]
        if bad:
            raise ValueError(f"{bad} have negative values, so log1p does not apply")
        out = out.withColumns({c: F.log1p(c) for c in numbers})
    elif transform == "power":
        out = out.withColumns({c: yeo_johnson(F.col(c), power_lambda(out, c)) for c in numbers})
    scales = _scale_fits(out, numbers, transform)
    out = out.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scales.items()}) if numbers else out

    level_columns = [c for c in roles.categorical if c in full]
    for c in level_columns if rare is not None else []:
        out = rare_collapse(out, c, rare, rare_token)
    known = {c: sorted(v) for c, v in _one(out, {c: F.collect_set(as_level(c)) for c in level_columns}).items()}
    known |= {c: roles.ordinal_maps[c] if c in roles.ordinal_maps else sorted(v) for c, v in _one(out, {c: F.collect_set(as_level(c)) for c in roles.ordinal if c in full}).items()}

    def place(c: str, value: Column) -> Column:
        return F.coalesce(F.array_position(F.array(*map(F.lit, known[c])), value) - 1, F.lit(-1)).cast("double")

    features: dict[str, Column] = {}
    for block in ("continuous", "binary", "categorical", "ordinal"):
        for c in (c for c in getattr(roles, block) if c in full):
            if block == "categorical" and encoding == "onehot":
                features |= {f"{block}__{c}_{v}": (as_level(c) == v).cast("double") for v in known[c]}
            elif block == "categorical":
                features[f"{block}__{c}"] = place(c, as_level(c))
            elif block == "ordinal":
                features[f"{block}__{c}"] = place(c, F.col(c) if c in roles.ordinal_maps else as_level(c))
            else:
                features[f"{block}__{c}"] = F.col(c).cast("double")
        features |= {f: F.col(f"`{f}`") for f in flags if f.startswith(f"{block}__")}
    if variance is not None:
        spread = _one(out, {f"v{i}": F.var_pop(e) for i, e in enumerate(features.values())})
        features = {k: e for i, (k, e) in enumerate(features.items()) if spread[f"v{i}"] is not None and spread[f"v{i}"] > variance}
    return out.select(key, F.array(*features.values()).alias("features")), list(features)
