"""Local quadratic smoothing and comparison of scenario curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundwise.functions import codes

# Evaluation points handled by one row; long curves are spread over many rows.
CHUNK = 128


def smooth_curves(df: DataFrame, keys: list[str], x: str, ys: list[str], span: float = 0.25, prefix: str = "smooth_", method: str = "direct", cell: float = 0.2) -> DataFrame:
    """Local quadratic regression with tricube weights, evaluated at every x.

    ``method="direct"`` fits at every x; ``"interpolate"`` fits at the cuts of a partition of
    each curve into cells of at most ``n * span * cell`` observations and blends between
    them (``_interpolated``), as published curves are made.

    The neighbourhood of a point are the ``floor(n * span)`` nearest observations of
    its curve. Observations at the same x are first merged into their count and sum,
    which the weights cannot tell apart. What is gathered per curve is therefore one
    entry per distinct x (a calendar), and the evaluation is cut into chunks that carry
    just the neighbours they can reach and are spread over the cluster.
    """
    sums = [F.sum(y).alias(f"_s{i}") for i, y in enumerate(ys)]
    complete = df.dropna(subset=[x, *ys])
    merged = complete.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"), *sums)
    point = F.struct(
        F.col(x).cast("double").alias("x"),
        F.col("_n").cast("double").alias("n"),
        *[F.col(f"_s{i}").cast("double").alias(f"s{i}") for i in range(len(ys))],
        F.col(x).alias("at"),
    )
    if method == "interpolate":
        return _interpolated(merged, keys, x, ys, span, prefix, cell)
    if method != "direct":
        raise ValueError(f"unknown method {method!r}")
    curves = merged.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("_pts"), F.sum("_n").alias("_total"))
    curves = curves.withColumn("_q", F.floor(F.col("_total") * span + 1e-5).cast("int"))
    size = F.size("_pts")
    chunks = curves.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int"))))
    first = F.col("_chunk") * CHUNK
    reach_from = F.greatest(first - F.col("_q"), F.lit(0))
    reach_to = F.least(first + CHUNK + F.col("_q"), size)
    chunks = chunks.select(
        *keys,
        "_chunk",
        "_q",
        F.slice("_pts", first + 1, F.lit(CHUNK)).alias("_eval"),
        F.slice("_pts", reach_from + 1, reach_to - reach_from).alias("_near"),
    )
    spread = chunks.repartition(*keys, "_chunk")
    fits = F.transform("_eval", lambda e: _fit_at(e, F.col("_near"), F.col("_q"), len(ys)))
    rows = spread.select(*keys, F.inline(fits))
    renamed = [F.col(f"f{i}").alias(f"{prefix}{y}") for i, y in enumerate(ys)]
    return rows.select(*keys, F.col("at").alias(x), *renamed)


def _interpolated(merged: DataFrame, keys: list[str], x: str, ys: list[str], span: float, prefix: str, cell: float) -> DataFrame:
    """Fits at the cuts of a median partition, blended by cubic Hermite polynomials.

    The range of a curve, widened by half a percent on both sides, is one cell at first. A
    cell with more observations than ``n * span * cell`` is cut at its middle observation
    (the last one of the lower part; where neighbours tie, at the nearest place where they
    do not). Value and slope of the local fit are computed at the ends of the cells only,
    so a curve costs the same few fits however long it is: about ``2 / (span * cell)``.
    Missing fits at an end leave the cell's values missing.
    """
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(x))
    point = F.struct(
        F.col(x).cast("double").alias("x"),
        F.col("_n").cast("double").alias("n"),
        *[F.col(f"_s{i}").cast("double").alias(f"s{i}") for i in range(len(ys))],
        F.col(x).alias("at"),
        F.col("_upto").alias("upto"),
    )
    curves = merged.withColumn("_upto", upto).groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("_pts"))
    total = F.element_at("_pts", -1)["upto"]
    curves = curves.withColumns({"_q": F.floor(total * span + 1e-5).cast("int"), "_most": F.floor(total * (span * cell))})
    curves = curves.withColumn("_ends", _cell_ends(F.col("_pts"), F.col("_most")))

    def fitted(v: Column) -> Column:
        e = F.struct(v.alias("x"), v.alias("at"))
        place = F.size(F.filter("_pts", lambda p: p.x <= v))
        # q observations lie on at most q points on either side
        near = F.slice("_pts", F.greatest(place - F.col("_q"), F.lit(0)) + 1, 2 * F.col("_q") + 1)
        return _fit_at(e, near, F.col("_q"), len(ys), slopes=True)

    curves = curves.withColumn("_fits", F.transform("_ends", fitted))

    def blended(p: Column) -> Column:
        upper = F.size(F.filter("_ends", lambda v: v <= p.x))
        a, b = F.col("_fits")[upper - 1], F.col("_fits")[upper]
        width = b["at"] - a["at"]
        h = (p.x - a["at"]) / width
        values = []
        for i in range(len(ys)):
            level = (1 - h) * (1 - h) * (1 + 2 * h) * a[f"f{i}"] + h * h * (3 - 2 * h) * b[f"f{i}"]
            tilt = h * (1 - h) * (1 - h) * a[f"d{i}"] - h * h * (1 - h) * b[f"d{i}"]
            values.append((level + tilt * width).alias(f"f{i}"))
        return F.struct(p["at"].alias("at"), *values)

    rows = curves.select(*keys, F.inline(F.transform("_pts", blended)))
    return rows.select(*keys, F.col("at").alias(x), *[F.col(f"f{i}").alias(f"{prefix}{y}") for i, y in enumerate(ys)])


def _cell_ends(points: Column, most: Column) -> Column:
    """The ends of the cells of one curve in ascending order, range ends included."""
    whole = F.struct(F.lit(1).alias("i"), F.size(points).alias("j"))

    def upto(i: Column) -> Column:
        return F.when(i > 0, F.get(points, i - 1)["upto"]).otherwise(F.lit(0).cast("long"))

    def split(c: Column) -> Column:
        first, last = upto(c.i - 1) + 1, upto(c.j)
        middle = F.floor((first + last) / 2)
        # points behind which the cell may be cut: not the last, and no farther below the
        # middle than the places above it reach
        places = F.transform(F.sequence(c.i, F.greatest(c.j - 1, c.i)), lambda k: F.struct(F.abs(upto(k) - middle).alias("far"), (-upto(k)).alias("u"), k.alias("k")))
        allowed = F.filter(places, lambda s: (s.k < c.j) & (middle + s.u <= last - middle - 1))
        best = F.array_min(allowed)
        halves = F.array(F.struct(c.i.alias("i"), best.k.alias("j")), F.struct((best.k + 1).alias("i"), c.j.alias("j")))
        return F.when((last - first + 1 > most) & best.isNotNull(), halves).otherwise(F.array(F.struct(c.i.alias("i"), c.j.alias("j"))))

    def step(s: Column, _: Column) -> Column:
        # one element arrays name a value, so that it is computed once
        cut = F.transform(F.array(F.flatten(F.transform(s.cells, split))), lambda n: F.struct(n.alias("cells"), (F.size(n) == F.size(s.cells)).alias("done")))
        return F.when(s.done, s).otherwise(F.get(cut, F.lit(0)))

    start = F.struct(F.array(whole).alias("cells"), F.lit(False).alias("done"))
    cells = F.aggregate(F.sequence(F.lit(1), F.size(points)), start, step)["cells"]
    inner = F.transform(F.filter(cells, lambda c: c.j < F.size(points)), lambda c: F.get(points, c.j - 1)["x"])
    low, high = F.get(points, F.lit(0))["x"], F.element_at(points, -1)["x"]
    margin = 0.005 * F.greatest(high - low, F.greatest(F.abs(low), F.abs(high)) * 1e-3 + 1e-30)
    return F.array_sort(F.concat(F.array(low - margin, high + margin), inner))


def _fit_at(e: Column, near: Column, q: Column, n_curves: int, slopes: bool = False) -> Column:
    """Fitted values (and slopes) of all curves at one point, as a struct with its x."""
    distances = F.array_sort(F.transform(near, lambda p: F.struct(F.abs(p.x - e.x).alias("d"), p.n.alias("n"))))
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("d"))
    reached = F.aggregate(
        distances,
        start,
        lambda s, p: F.when(s.seen < q, F.struct((s.seen + p.n).alias("seen"), p.d.alias("d"))).otherwise(s),
    )

    def weighted(h: Column) -> Column:
        def weigh(p: Column) -> Column:
            u = F.try_divide(p.x - e.x, h)  # in bandwidths
            t = 1 - F.pow(F.abs(u), F.lit(3.0))
            w = F.when(t > 0, t * t * t).otherwise(0.0)
            return F.struct(u.alias("u"), (w * p.n).alias("w"), *[(w * p[f"s{i}"]).alias(f"y{i}") for i in range(n_curves)])

        return F.transform(near, weigh)

    names = ["a0", "a1", "a2", "a3", "a4"] + [f"t{k}_{i}" for i in range(n_curves) for k in range(3)]
    zero = F.struct(*[F.lit(0.0).alias(n) for n in names])

    def add(acc: Column, p: Column) -> Column:
        u2 = p.u * p.u
        powers = [F.lit(1.0), p.u, u2, u2 * p.u, u2 * u2]
        parts = [(acc[f"a{k}"] + p.w * powers[k]).alias(f"a{k}") for k in range(5)]
        for i in range(n_curves):
            parts += [(acc[f"t{k}_{i}"] + p[f"y{i}"] * powers[k]).alias(f"t{k}_{i}") for k in range(3)]
        return F.struct(*parts)

    def solve(m: Column, h: Column) -> Column:
        c0 = m.a2 * m.a4 - m.a3 * m.a3
        c1 = m.a2 * m.a3 - m.a1 * m.a4
        c2 = m.a1 * m.a3 - m.a2 * m.a2
        det = m.a0 * c0 + m.a1 * c1 + m.a2 * c2
        usable = det > 1e-12 * m.a0 * m.a0 * m.a0
        fits = [
            F.when(usable, (m[f"t0_{i}"] * c0 + m[f"t1_{i}"] * c1 + m[f"t2_{i}"] * c2) / det).alias(f"f{i}")
            for i in range(n_curves)
        ]
        if slopes:
            b0, b1 = m.a0 * m.a4 - m.a2 * m.a2, m.a1 * m.a2 - m.a0 * m.a3
            fits += [
                F.when(usable, (m[f"t0_{i}"] * c1 + m[f"t1_{i}"] * b0 + m[f"t2_{i}"] * b1) / det / h).alias(f"d{i}")
                for i in range(n_curves)
            ]
        return F.struct(e["at"].alias("at"), *fits)

    moments = F.transform(F.array(reached.d), lambda h: F.struct(h.alias("h"), F.aggregate(weighted(h), zero, add).alias("m")))
    return F.transform(moments, lambda s: solve(s.m, s.h))[0]


def infections_averted(df: DataFrame, baseline: str, keys: list[str], value: str = "cuminc_mean") -> DataFrame:
    """Each scenario against the baseline at the same keys: difference, and its share
    of the scenario's own total. Keys without a baseline row are left out.

    One pass: the baseline's value is looked up in a window over the key, which holds
    one row per scenario.
    """
    own = F.col("scenario") == baseline
    w = Window.partitionBy(*keys)
    spread = df.withColumns({"base_value": F.max(F.when(own, F.col(value))).over(w), "_has_base": F.max(own).over(w)})
    joined = spread.where("_has_base").drop("_has_base")
    delta = F.col(value) - F.col("base_value")
    return joined.select(
        *keys,
        "scenario",
        "base_value",
        value,
        delta.alias("delta_inc_mean"),
        F.try_divide(delta, F.col(value)).alias("delta_inc_mean_pct"),
    )


def stack_measures(curves: DataFrame, averted: DataFrame, keys: list[str]) -> DataFrame:
    """Curves and averted shares (as percent) as one long (measure, value) table."""
    left = curves.select(*keys, "scenario", F.col("loess_inc_mean"))
    right = averted.select(*keys, "scenario", (100 * F.col("delta_inc_mean_pct")).alias("delta_inc_mean_pct"))
    both = left.unionByName(right, allowMissingColumns=True)
    long = both.unpivot([*keys, "scenario"], ["loess_inc_mean", "delta_inc_mean_pct"], "measure", "value")
    names = {"loess_inc_mean": "incidence", "delta_inc_mean_pct": "cum_incidence"}
    return long.where(F.col("value").isNotNull()).withColumn("measure", codes.recode("measure", names))


def compare_to_data(model: DataFrame, observed: DataFrame, keys: list[str], model_value: str, observed_value: str) -> DataFrame:
    """Model curve beside the observed points at the same keys, with the difference."""
    joined = model.join(observed, keys)
    return joined.withColumn("difference", F.col(model_value) - F.col(observed_value))


def running_total(df: DataFrame, keys: list[str], x: str, value: str, out: str) -> DataFrame:
    """Cumulative value along x within each curve (one row per x)."""
    w = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(w))


def combine_indicators(sources: dict[str, DataFrame]) -> DataFrame:
    """Stack indicator tables (year, strata, agecat, prob, lb, ub) under a source tag.

    Sex labels are brought to Female / Male and rows without an estimate dropped.
    """
    stacked = None
    for name, frame in sources.items():
        tagged = frame.select("year", "strata", "agecat", "prob", "lb", "ub").withColumn("source", F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    return stacked.withColumn("strata", codes.recode("strata", codes.SEX_LONG)).where(F.col("prob").isNotNull())
