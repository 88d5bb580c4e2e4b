"""Statistics that guard what the built-in aggregates don't: constants, few rows, ranks, tails."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.sources.scratch import written


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite_pair(x, y) -> Column:
    """Both are numbers, neither infinite."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok(_c(x)) & ok(_c(y))


def pearson(x, y) -> Column:
    """Correlation of at least three pairs; null where a side is constant."""
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when((F.count_if(both) >= 3) & (spread > 0), F.try_divide(F.covar_pop(a, b), spread))


def slope(y, x) -> Column:
    """Least-squares slope; 0 where x is constant."""
    return F.when(F.var_pop(_c(x)) > 0, F.regr_slope(_c(y), _c(x))).otherwise(F.lit(0.0))


def intercept(y, x) -> Column:
    return F.when(F.var_pop(_c(x)) > 0, F.regr_intercept(_c(y), _c(x))).otherwise(F.avg(_c(y)))


def r_squared(y, x) -> Column:
    """Share of variance explained; 0 where either side is constant."""
    return F.when((F.var_pop(_c(x)) > 0) & (F.var_pop(_c(y)) > 0), F.regr_r2(_c(y), _c(x))).otherwise(F.lit(0.0))


def fit_mse(y, x) -> Column:
    """Mean squared residual of the least-squares line, in closed form; 0 where x is constant."""
    y, x = _c(y), _c(x)
    return F.when(F.var_pop(x) > 0, F.greatest(F.lit(0.0), F.var_pop(y) - F.try_divide(F.pow(F.covar_pop(y, x), F.lit(2.0)), F.var_pop(x)))).otherwise(F.lit(0.0))


def _same(by: list[str], one: str, two: str) -> list[Column]:
    """Equality of columns of two aliased frames, nulls being equal."""
    return [F.col(f"{one}.{c}").eqNullSafe(F.col(f"{two}.{c}")) for c in by]


def placed(counts: DataFrame, by: list[str], value: str, parts: int = 64) -> DataFrame:
    """(by, value, n, _part, _before, _total): how many rows of its group come before each distinct value, and how many there are.

    counts has (by, value, n), one row for each distinct value, and is read three times. A group's values are dealt to parts by
    range, so that no task sorts a whole group: a part's values begin after the rows of those before it.
    """
    edges = counts.groupBy(*by).agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10_000).alias("_edges"))  # a bounded list for each group
    rows = counts.alias("c").join(edges.alias("e"), _same(by, "c", "e")).select("c.*", F.size(F.filter("e._edges", lambda e: e < F.col(f"c.{value}"))).alias("_part"))
    sizes = rows.groupBy(*by, "_part").agg(F.sum("n").alias("_m"))
    w = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("_m").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.withColumn("_begin", earlier).withColumn("_total", F.sum("_m").over(w)).drop("_m")
    run = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_in", F.coalesce(F.sum("n").over(run), F.lit(0)))
    joined = inside.alias("i").join(begins.alias("b"), _same([*by, "_part"], "i", "b"))
    return joined.select("i.*", (F.col("b._begin") + F.col("i._in")).alias("_before"), "b._total").drop("_in")


def average_ranks(counts: DataFrame, by: list[str], value: str, out: str, parts: int = 64) -> DataFrame:
    """(by, value, out): rank of each distinct value in its group, ties sharing the mean of their places; counts as for placed."""
    return placed(counts, by, value, parts).select(*by, value, (F.col("_before") + (F.col("n") + 1) / 2.0).alias(out))


def rank_correlations(kept: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, rho) from (by, _x, _y, n), the distinct pairs of values with their numbers; groups of three pairs or more.

    Both sides are ranked in one pass. The mean of n average ranks is (n + 1) / 2, so no pass is needed for it.
    """
    kept = written(kept, "rank-pairs")
    sides = F.array(*[F.struct(F.lit(s).alias("_side"), F.col(c).alias("_v")) for s, c in (("x", "_x"), ("y", "_y"))])
    counts = written(kept.select(*by, F.explode(sides).alias("s"), "n").groupBy(*by, "s._side", "s._v").agg(F.sum("n").alias("n")), "rank-values")
    at = placed(counts, [*by, "_side"], "_v")
    ranks = written(at.select(*by, "_side", "_v", (F.col("_before") + F.col("n") / 2.0 - F.col("_total") / 2.0).alias("_d")), "ranks")  # from the mean
    side = lambda s: ranks.where(F.col("_side") == s).alias(s)
    one = kept.alias("k").join(side("x"), [*_same(by, "k", "x"), F.col("k._x") == F.col("x._v")]).select("k.*", F.col("x._d").alias("_dx"))
    both = one.alias("k").join(side("y"), [*_same(by, "k", "y"), F.col("k._y") == F.col("y._v")]).select("k.*", F.col("y._d").alias("_dy"))
    weighted = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    spread = F.sqrt(weighted("_dx", "_dx") * weighted("_dy", "_dy"))
    return both.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), F.when(spread > 0, weighted("_dx", "_dy") / spread).alias("rho")).where("n >= 3")


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of each group with three pairs or more: (by, n, rho). Equal pairs are counted before they are ranked."""
    # written before the filter, which would work out each value once more for every test of it
    rows = written(df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), "rank-input")
    return rank_correlations(rows.where(finite_pair("_x", "_y")).groupBy(*by, "_x", "_y").agg(F.count("*").alias("n")), by)


def holm(df: DataFrame, p: str, by: list[str], order: list[str], out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within each group; df has each order once in a group.

    Equal p-values have one adjusted value, that of the first of them in any order, so distinct values are counted, dealt to
    ranges and joined back: no task holds a group, nor the rows of one value.
    """
    df = written(df, "holm")
    counts = written(df.groupBy(*by, p).agg(F.count("*").alias("n")).where(F.col(p).isNotNull()), "holm-values")
    at = written(placed(counts, by, p).withColumn("_raw", F.col(p) * (F.col("_total") - F.col("_before"))), "holm-placed")
    tops = at.groupBy(*by, "_part").agg(F.max("_raw").alias("_top"))
    before = tops.withColumn("_highest", F.max("_top").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    run = Window.partitionBy(*by, "_part").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    inside = at.withColumn("_here", F.max("_raw").over(run)).alias("a").join(before.alias("t"), _same([*by, "_part"], "a", "t"))
    final = inside.select(*[F.col(f"a.{c}") for c in [*by, p]], F.least(F.lit(1.0), F.greatest("a._here", "t._highest")).alias(out))
    return df.alias("d").join(final.alias("f"), [*_same(by, "d", "f"), F.col(f"d.{p}") == F.col(f"f.{p}")], "left").select("d.*", F.col(f"f.{out}"))


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive x: Stirling's series, taken eight steps further up."""
    rise, y = x, x + 8
    for k in range(1, 8):
        rise = rise * (x + k)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(rise)


def _not_zero(x: Column) -> Column:
    return F.when(x == 0, 1e-300).otherwise(x)


def correlation_p(r, n) -> Column:
    """Two-sided p-value of a correlation of n pairs by Student's t; null under three pairs.

    The tail is an incomplete beta function, summed as its widely published continued fraction within
    the expression, so that no Python worker is needed.
    """
    r, n = _c(r).cast("double"), _c(n).cast("double")
    half, square = F.greatest(n - 2, F.lit(1.0)) / 2, r * r
    turned = 1 - square > (half + 1) / (half + 2.5)
    a, b, x = F.when(turned, 0.5).otherwise(half), F.when(turned, half).otherwise(0.5), F.when(turned, square).otherwise(1 - square)

    def step(s: Column, i: Column) -> Column:
        m, a, b, x = F.floor(i / 2).cast("double"), s["a"], s["b"], s["x"]
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        num = F.when(i % 2 == 0, even).otherwise(odd)
        d, c = 1 / _not_zero(1 + num * s["d"]), _not_zero(1 + num / s["c"])
        return F.struct((s["f"] * c * d).alias("f"), c.alias("c"), d.alias("d"), a.alias("a"), b.alias("b"), x.alias("x"))

    first = F.struct(F.lit(2.0).alias("f"), F.lit(2.0).alias("c"), F.lit(1.0).alias("d"), a.alias("a"), b.alias("b"), x.alias("x"))
    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(300)), first, step, lambda s: s["f"] - 1)
    front = F.exp(_log_gamma(half + 0.5) - _log_gamma(half) - math.lgamma(0.5) + a * F.ln(x) + b * F.ln(1 - x)) / a
    tail = F.when(turned, 1 - front * fraction).otherwise(front * fraction)
    return F.when(r.isNull() | F.isnan(r) | (n < 3), None).when(F.abs(r) >= 1, 0.0).when(square == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def _poisson_weights(key: np.ndarray, resample: np.ndarray) -> np.ndarray:
    """How often each row (a 64-bit key) is drawn in each resample: Poisson numbers of mean one that hang on these two alone."""
    with np.errstate(over="ignore"):
        z = key[:, None] + (resample[None, :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(below, (z >> np.uint64(11)) / 2.0**53, side="right").astype(float)


def bootstrap_ci(df: DataFrame, by: list[str], x: str, y: str, order: list[str], resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(by, n, lo, hi): 95 % bootstrap interval of each group's correlation; null under five pairs.

    Each row is drawn a Poisson number of times in each resample, by a hash of its order columns, the
    resample and the seed: tasks sum moments of the rows that they have, whatever the size of a group,
    and what is shuffled is a row for each task, group and resample. Rows alike in by and order are drawn together.
    """
    pairs = df.where(finite_pair(F.col(x).cast("double"), F.col(y).cast("double"))).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *[c for c in order if c not in by])
    # about the group's mean, so that the moments keep their digits
    centre = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    rows = pairs.alias("p").join(centre.where("n >= 5").alias("c"), same("p", "c")).select(*[F.col(f"p.{c}") for c in by], F.xxhash64(F.lit(seed), *[F.col(f"p.{c}") for c in [*by, *order]]).alias("_key"), (F.col("_x") - F.col("_mx")).alias("_x"), (F.col("_y") - F.col("_my")).alias("_y"))
    sums = ["_w", "_sx", "_sy", "_sxx", "_syy", "_sxy"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*by).dtypes), "_b int", *(f"{c} double" for c in sums)])

    def moments(batches):
        total, at = {}, np.arange(resamples, dtype=np.uint64)

        def given():
            for key, got in total.items():
                out = pd.DataFrame(got, columns=sums)
                for c, k in zip(by, key):
                    out[c] = k
                yield out.assign(_b=np.arange(resamples, dtype=np.int32))[[*by, "_b", *sums]]
            total.clear()

        for pdf in batches:
            for key, part in pdf.groupby(by, dropna=False, sort=False):
                got = total.setdefault(tuple(None if pd.isna(k) else k for k in key), np.zeros((resamples, 6)))
                for lo in range(0, len(part), 1024):
                    p = part.iloc[lo : lo + 1024]
                    a, b = p["_x"].to_numpy(), p["_y"].to_numpy()
                    got += _poisson_weights(p["_key"].to_numpy().view(np.uint64), at).T @ np.stack([np.ones(len(a)), a, b, a * a, b * b, a * b], axis=1)
                if len(total) > 256:
                    yield from given()
        yield from given()

    drawn = rows.mapInPandas(moments, schema).groupBy(*by, "_b").agg(*[F.sum(c).alias(c) for c in sums]).where("_w > 0")
    return _interval(df, drawn, centre, by)


def _interval(df: DataFrame, drawn: DataFrame, centre: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, lo, hi) of every group of df from the moments of its resamples (by, _b, _w, _sx, …) and its number of pairs."""
    same = lambda a, b: _same(by, a, b)
    cov = lambda ab, a, b: F.col(ab) / F.col("_w") - F.col(a) / F.col("_w") * (F.col(b) / F.col("_w"))
    vx, vy = cov("_sxx", "_sx", "_sx"), cov("_syy", "_sy", "_sy")
    r = F.when((vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov("_sxy", "_sx", "_sy") / F.sqrt(vx * vy))))
    ends = drawn.select(*by, F.round(r, 12).alias("_r")).groupBy(*by).agg(F.count("_r").alias("_k"), F.percentile("_r", F.array(F.lit(0.025), F.lit(0.975))).alias("_q")).where("_k >= 10")
    groups = df.select(*by).distinct().alias("g").join(centre.alias("c"), same("g", "c"), "left").join(ends.alias("e"), same("g", "e"), "left")
    return groups.select(*[F.col(f"g.{c}") for c in by], F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


#: Distinct pairs that a leaf of a group's tree should hold.
LEAF = 512


def resample_moments(pairs: DataFrame, by: list[str], resamples: int, seed: int, leaf: int = LEAF) -> DataFrame:
    """(by, _b, _w, _sx, _sy, _sxx, _syy, _sxy): moments of resamples with as many draws as the group has pairs, exactly.

    pairs has (by, _x, _y, m), distinct pairs with their numbers. A group's pairs are the leaves of a binary tree over their
    hash. At each node the draws are split between its halves by a binomial that hangs on the seed, the group and the node
    alone, so that every leaf finds its own share from the counts on its path, without the others; it then draws among its pairs.
    """
    depth = pairs.groupBy(*by).agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / leaf))).cast("int").alias("_depth"), F.sum("m").alias("_n"))
    held = written(pairs.alias("p").join(depth.alias("d"), _same(by, "p", "d")).select("p.*", "d._depth", "d._n", F.shiftrightunsigned(F.xxhash64("p._x", "p._y", F.lit(5)), 1).alias("_h")).withColumn("_leaf", F.when(F.col("_depth") > 0, F.expr("shiftright(_h, 63 - _depth)")).otherwise(F.lit(0).cast("long"))), "leaves")
    sizes = held.groupBy(*by, "_depth", "_n", "_leaf").agg(F.sum("m").alias("_m"))
    nodes = sizes.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_depth")))).groupBy(*by, "_level", F.expr("shiftright(_leaf, _depth - _level)").alias("_node")).agg(F.sum("_m").alias("_m"))
    nodes = written(nodes, "nodes")
    # for each leaf and level above it: the rows of the node, and of its left half
    path = sizes.drop("_m").where("_depth > 0").withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_depth") - 1))).withColumn("_node", F.expr("shiftright(_leaf, _depth - _level)"))
    at = path.alias("p").join(nodes.alias("n"), [*_same(by, "p", "n"), F.col("p._level") == F.col("n._level"), F.col("p._node") == F.col("n._node")]).select("p.*", F.col("n._m").alias("_all"))
    left = at.alias("p").join(nodes.alias("n"), [*_same(by, "p", "n"), F.col("p._level") + 1 == F.col("n._level"), F.col("p._node") * 2 == F.col("n._node")], "left").select("p.*", F.coalesce("n._m", F.lit(0)).alias("_half"))
    steps = left.groupBy(*by, "_leaf").agg(F.array_sort(F.collect_list(F.struct("_level", "_node", "_all", "_half"))).alias("_path"))  # one entry for each level
    rows = held.alias("h").join(steps.alias("s"), [*_same(by, "h", "s"), F.col("h._leaf") == F.col("s._leaf")], "left").select("h.*", "s._path", F.xxhash64(F.lit(seed), *[F.col(f"h.{c}") for c in by]).alias("_g"))
    sums = ["_w", "_sx", "_sy", "_sxx", "_syy", "_sxy"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in pairs.select(*by).dtypes), "_b int", *(f"{c} double" for c in sums)])

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_x", "_y"])
        first = pdf.iloc[0]
        draws = np.full(resamples, int(first["_n"]), np.int64)
        key = int(first["_g"]) & (2**64 - 1)
        path = first["_path"] if first["_path"] is not None else []
        for k, step in enumerate(path):
            rng = np.random.default_rng([key, int(step["_level"]), int(step["_node"])])
            half = rng.binomial(draws, step["_half"] / step["_all"])
            right = (int(first["_leaf"]) >> (len(path) - 1 - k)) & 1
            draws = draws - half if right else half
        m = pdf["m"].to_numpy().astype(float)
        rng = np.random.default_rng([key, 1 << 20, int(first["_leaf"])])
        a, b = pdf["_x"].to_numpy(), pdf["_y"].to_numpy()
        cols = np.stack([np.ones(len(a)), a, b, a * a, b * b, a * b], axis=1)
        got = np.concatenate([rng.multinomial(draws[lo : lo + 256], m / m.sum()) @ cols for lo in range(0, resamples, 256)])
        out = pd.DataFrame(got, columns=sums).assign(_b=np.arange(resamples, dtype=np.int32))
        for c in by:
            out[c] = first[c]
        return out[[*by, "_b", *sums]]

    return rows.groupBy(*by, "_leaf").applyInPandas(draw, schema).groupBy(*by, "_b").agg(*[F.sum(c).alias(c) for c in sums])


def bootstrap_exact(df: DataFrame, by: list[str], x: str, y: str, resamples: int = 2000, seed: int = 0, leaf: int = LEAF) -> DataFrame:
    """(by, n, lo, hi): 95 % bootstrap interval of each group's correlation, with n draws in every resample; null under five pairs.

    bootstrap_ci draws a Poisson number of times instead, in one pass less. Pairs that are no finite numbers take no part.
    """
    pairs = df.where(finite_pair(F.col(x).cast("double"), F.col(y).cast("double"))).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    centre = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    about = pairs.alias("p").join(centre.where("n >= 5").alias("c"), _same(by, "p", "c")).select(*[F.col(f"p.{c}") for c in by], (F.col("_x") - F.col("_mx")).alias("_x"), (F.col("_y") - F.col("_my")).alias("_y"))
    counted = written(about.groupBy(*by, "_x", "_y").agg(F.count("*").alias("m")), "pairs")
    return _interval(df, resample_moments(counted, by, resamples, seed, leaf), centre, by)


def correlation_pairs(wide: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric_x, metric_y, n, r) of every pair of metrics, in long form; one pass over the table."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    aggs = []
    for a, b in pairs:
        aggs.append(F.struct(F.lit(a).alias("metric_x"), F.lit(b).alias("metric_y"), F.count_if(finite_pair(a, b)).alias("n"), pearson(a, b).alias("r")).alias(f"_{a}__{b}"))
    one = wide.groupBy(*by).agg(*aggs)
    return one.select(*by, F.explode(F.array(*[F.col(f"_{a}__{b}") for a, b in pairs])).alias("p")).select(*by, "p.*")


def correlation_rows(wide: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, method, metric_x, metric_y, n, r, p, p_holm): Pearson and Spearman of every pair of metrics.

    p is adjusted within each group and method; pairs without a correlation are left out.
    """
    wide = written(wide.select(*by, *metrics), "correlations")
    linear = correlation_pairs(wide, by, metrics).withColumn("method", F.lit("pearson"))
    kept = _value_pairs(wide, by, metrics).groupBy(*by, "metric_x", "metric_y", "_x", "_y").agg(F.count("*").alias("n"))
    return _with_p(linear, rank_correlations(kept, [*by, "metric_x", "metric_y"]), by)


def _value_pairs(wide: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(a).alias("metric_x"), F.lit(b).alias("metric_y"), F.col(a).cast("double").alias("_x"), F.col(b).cast("double").alias("_y")) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    return wide.select(*by, F.explode(F.array(*pairs)).alias("c")).select(*by, "c.*").where(finite_pair("_x", "_y"))


def _with_p(linear: DataFrame, ranked: DataFrame, by: list[str]) -> DataFrame:
    rows = linear.unionByName(ranked.withColumnRenamed("rho", "r").withColumn("method", F.lit("spearman"))).where("r is not null").withColumn("p", correlation_p("r", "n"))
    return holm(rows, "p", [*by, "method"], ["metric_x", "metric_y"]).select(*by, "method", "metric_x", "metric_y", "n", "r", "p", "p_holm")


#: Families of conditions by the columns that they keep, and the suffixes for correctness.
FAMILIES = {"unconditional": (), "by_dataset": ("dataset",), "by_model": ("model",), "by_dataset_model": ("dataset", "model")}
SUFFIXES = {"": None, "__correct_only": True, "__incorrect_only": False}


def condition_cells(families: dict[str, tuple[str, ...]] = FAMILIES, correct: str = "correct") -> Column:
    """Array of (condition, grp) that a row of a dataset, model and correctness belongs to; a null correctness has no suffix of its own."""
    out = []
    for name, kept in families.items():
        group = F.concat_ws("::", *[F.coalesce(c, F.lit("none")) for c in kept]) if kept else F.lit("all")
        for suffix, want in SUFFIXES.items():
            cell = F.struct(F.lit(name + suffix).alias("condition"), group.alias("grp"))
            out.append(cell if want is None else F.when(F.col(correct) == F.lit(want), cell))
    return F.array_compact(F.array(*out))


def condition_correlations(wide: DataFrame, metrics: list[str], correct: str = "correct") -> DataFrame:
    """(condition, grp, method, metric_x, metric_y, n, r, p, p_holm) for all families of conditions and all suffixes.

    wide has dataset, model, correct and the metrics; it is read twice. Co-moments are summed once, for each dataset, model and
    correctness, about the metrics' overall means; every condition adds up those of its cells. Ranks depend on a condition's
    own rows, so pairs of values are counted for each cell first and carried up with their numbers.
    """
    fine = ["dataset", "model", correct]
    wide = written(wide.select(*fine, *[F.col(m).cast("double").alias(m) for m in metrics]), "condition-input")
    means = wide.agg(*[F.coalesce(F.avg(F.when(finite_pair(m, m), F.col(m))), F.lit(0.0)).alias(m) for m in metrics]).first()
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    aggs = []
    for a, b in pairs:
        ok = finite_pair(a, b)
        x, y = (F.when(ok, F.col(m) - F.lit(means[m])) for m in (a, b))
        sums = {"n": F.count(x).cast("double"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "syy": F.sum(y * y), "sxy": F.sum(x * y)}
        aggs.append(F.struct(F.lit(a).alias("metric_x"), F.lit(b).alias("metric_y"), *[v.alias(k) for k, v in sums.items()]).alias(f"{a}|{b}"))
    cells = wide.groupBy(*fine).agg(*aggs)
    each = cells.select(F.explode(condition_cells(correct=correct)).alias("c"), F.array(*[F.col(f"`{a}|{b}`") for a, b in pairs]).alias("m")).select("c.*", F.explode("m").alias("m")).select("condition", "grp", "m.*")
    by = ["condition", "grp"]
    total = each.groupBy(*by, "metric_x", "metric_y").agg(*[F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    vx, vy, cov = (F.col(a) / n - F.col(b) / n * (F.col(c) / n) for a, b, c in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    flat = lambda v, s: v > 1e-13 * F.col(s) / n  # noqa: E731  what is left of a constant is rounding
    r = F.when((n >= 3) & flat(vx, "sxx") & flat(vy, "syy"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))))
    linear = total.select(*by, F.lit("pearson").alias("method"), "metric_x", "metric_y", n.cast("long").alias("n"), r.alias("r"))
    kept = _value_pairs(wide, fine, metrics).groupBy(*fine, "metric_x", "metric_y", "_x", "_y").agg(F.count("*").alias("n"))
    up = kept.select(F.explode(condition_cells(correct=correct)).alias("c"), "metric_x", "metric_y", "_x", "_y", "n").groupBy("c.condition", "c.grp", "metric_x", "metric_y", "_x", "_y").agg(F.sum("n").alias("n"))
    return _with_p(linear, rank_correlations(up, [*by, "metric_x", "metric_y"]), by)
