"""Trend models whose fit has a closed form or a short Newton iteration.

All covariates are rounds, integer ages or bands, so counts per cell say all the data
have to say: the panel is reduced to cells by one aggregation and only cells are fitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundwise.functions import codes
from roundwise.functions.intervals import log_link, logit_link, normal_two_sided
from roundwise.operators.panel import ROUND

NEWTON_STEPS = 30
TOLERANCE = 1e-9


def rate_cells(df: DataFrame, by: list[str]) -> DataFrame:
    """Events and person-years per cell; rows without positive person-time cannot be fitted."""
    rows = df.where(F.col("py") > 0)
    return rows.groupBy(*by).agg(F.sum("py").alias("pysum"), F.sum("hivinc").alias("events"))


def binomial_cells(df: DataFrame, flag: str, by: list[str]) -> DataFrame:
    known = df.where(F.col(flag).isNotNull())
    return known.groupBy(*by).agg(F.count(flag).alias("n"), F.count_if(F.col(flag) == 1).alias("positives"))


def rate_factor(cells: DataFrame, per: float = 1.0) -> DataFrame:
    """Poisson rate with one level per cell: rate, log-scale fit and standard error.

    A cell without events has rate 0 and no interval.
    """
    some = F.col("events") > 0
    fitted = cells.withColumns(
        {
            "fit": F.when(some, F.ln(F.col("events") / F.col("pysum"))),
            "se_fit": F.when(some, 1 / F.sqrt(F.col("events"))),
        }
    )
    _, low, high = log_link(F.col("fit"), F.col("se_fit"))
    return fitted.withColumns({"inc": per * F.col("events") / F.col("pysum"), "lb": per * low, "ub": per * high})


def logit_factor(cells: DataFrame) -> DataFrame:
    """Binomial proportion with one level per cell; at 0 or 1 there is no interval."""
    p = F.col("positives") / F.col("n")
    open_ = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    fitted = cells.withColumns(
        {
            "fit": F.when(open_, F.ln(F.col("positives") / (F.col("n") - F.col("positives")))),
            "se_fit": F.when(open_, 1 / F.sqrt(F.col("n") * p * (1 - p))),
        }
    )
    _, low, high = logit_link(F.col("fit"), F.col("se_fit"))
    return fitted.withColumns({"prob": p, "lb": low, "ub": high})


def patch_upper_bound(df: DataFrame, threshold: float, prob: str = "prob", upper: str = "ub") -> DataFrame:
    """Upper bound 0 where it is missing or the estimate is below a threshold."""
    return df.withColumn(upper, F.when(F.col(upper).isNull() | (F.col(prob) < threshold), 0.0).otherwise(F.col(upper)))


def logit_lines(cells: DataFrame, strata: list[str], x: str = ROUND, centre: float = 0.0) -> DataFrame:
    """Straight line on the logit scale per stratum, with the covariance of its two
    coefficients.

    Each stratum is one short array of cells (a cell per round), iterated by built-in
    array functions; the data themselves are not touched again. ``converged`` tells
    whether a further step would move less than the tolerance; a stratum that is
    separated or has not converged has no fit (NULL). ``first`` and ``last`` are the
    ends of its observed range.
    """
    point = F.struct(
        (F.col(x) - centre).cast("double").alias("x"),
        F.col("n").cast("double").alias("n"),
        F.col("positives").cast("double").alias("k"),
    )
    grouped = cells.groupBy(*strata).agg(
        F.array_sort(F.collect_list(point)).alias("_pts"),
        F.sum("n").alias("n"),
        F.sum("positives").alias("positives"),
        F.min(x).alias("first"),
        F.max(x).alias("last"),
    )
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("g0", "g1", "h00", "h01", "h11")])

    def sums(b0: Column, b1: Column) -> Column:
        def add(acc: Column, c: Column) -> Column:
            p = 1 / (1 + F.exp(-(b0 + b1 * c.x)))
            r, w = c.k - c.n * p, c.n * p * (1 - p)
            return F.struct(
                (acc.g0 + r).alias("g0"),
                (acc.g1 + r * c.x).alias("g1"),
                (acc.h00 + w).alias("h00"),
                (acc.h01 + w * c.x).alias("h01"),
                (acc.h11 + w * c.x * c.x).alias("h11"),
            )

        return F.aggregate("_pts", zero, add)

    def step(s: Column, _: Column) -> Column:
        moved = F.transform(
            F.array(sums(s.b0, s.b1)),
            lambda m: F.struct(
                (s.b0 + F.try_divide(m.h11 * m.g0 - m.h01 * m.g1, m.h00 * m.h11 - m.h01 * m.h01)).alias("b0"),
                (s.b1 + F.try_divide(m.h00 * m.g1 - m.h01 * m.g0, m.h00 * m.h11 - m.h01 * m.h01)).alias("b1"),
            ),
        )
        return moved[0]

    interior = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    start = F.struct(
        F.when(interior, F.ln(F.col("positives") / (F.col("n") - F.col("positives")))).alias("b0"),
        F.when(interior, F.lit(0.0)).alias("b1"),
    )
    fitted = grouped.withColumn("_b", F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step))
    fitted = fitted.withColumn("_m", sums(F.col("_b.b0"), F.col("_b.b1")))
    move = step(F.col("_b"), F.lit(0))
    size = F.abs(move["b0"] - F.col("_b.b0")) + F.abs(move["b1"] - F.col("_b.b1"))
    settled = size <= TOLERANCE * (1 + F.abs(F.col("_b.b0")) + F.abs(F.col("_b.b1")))
    fitted = fitted.withColumn("converged", F.coalesce(settled & ~F.isnan(size), F.lit(False)))
    fitted = fitted.withColumns({"_b": F.when(F.col("converged"), F.col("_b")), "_m": F.when(F.col("converged"), F.col("_m"))})
    det = F.col("_m.h00") * F.col("_m.h11") - F.col("_m.h01") * F.col("_m.h01")
    return fitted.select(
        *strata,
        "n",
        "positives",
        "first",
        "last",
        "converged",
        F.col("_b.b0").alias("intercept"),
        F.col("_b.b1").alias("slope"),
        F.try_divide(F.col("_m.h11"), det).alias("v00"),
        F.try_divide(-F.col("_m.h01"), det).alias("v01"),
        F.try_divide(F.col("_m.h00"), det).alias("v11"),
    )


def predict_lines(lines: DataFrame, x: str = ROUND, centre: float = 0.0) -> DataFrame:
    """Fitted lines on every integer of each stratum's observed range, with intervals."""
    grid = lines.withColumn(x, F.explode(F.sequence("first", "last")))
    d = F.col(x) - centre
    grid = grid.withColumns(
        {
            "fit": F.col("intercept") + F.col("slope") * d,
            "se_fit": F.sqrt(F.col("v00") + 2 * d * F.col("v01") + d * d * F.col("v11")),
        }
    )
    prob, low, high = logit_link(F.col("fit"), F.col("se_fit"))
    return grid.withColumns({"prob": prob, "lb": low, "ub": high})


def ratio_to_reference(df: DataFrame, keys: list[str], value: str, reference: int, out: str, x: str = ROUND) -> DataFrame:
    """Value divided by the group's value at the reference round (NULL without one).

    Meant for prediction tables: a group has one row per round.
    """
    base = F.max(F.when(F.col(x) == reference, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.try_divide(F.col(value), base))


def rate_coefficients(cells: DataFrame, strata: list[str], reference: int, x: str = ROUND) -> DataFrame:
    """Coefficient table of the factor model: intercept and contrasts with a reference.

    Contrast = log rate ratio, variance = sum of the reciprocal event counts. The
    intercept is the row of the reference round itself.
    """
    w = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(1))
    at_ref = F.col(x) == reference
    base_k = F.max(F.when(at_ref, F.col("events"))).over(w)
    base_py = F.max(F.when(at_ref, F.col("pysum"))).over(w)
    both = (F.col("events") > 0) & (F.col("_k") > 0)
    log_rate = F.ln(F.col("events") / F.col("pysum"))
    log_base = F.ln(F.col("_k") / F.col("_t"))
    table = cells.withColumns({"_k": base_k, "_t": base_py}).select(
        *strata,
        x,
        F.when(at_ref, "(Intercept)").otherwise(F.concat(F.lit(f"{x} "), F.col(x).cast("string"))).alias("term"),
        F.when(both, F.when(at_ref, log_rate).otherwise(log_rate - log_base)).alias("estimate"),
        F.when(both, F.when(at_ref, F.sqrt(1 / F.col("events"))).otherwise(F.sqrt(1 / F.col("events") + 1 / F.col("_k")))).alias("std_error"),
    )
    table = table.withColumn("z", F.col("estimate") / F.col("std_error"))
    return table.withColumn("p", normal_two_sided("z"))


def line_coefficients(lines: DataFrame, strata: list[str]) -> DataFrame:
    """Intercept and slope of each fitted line with standard error, z and p value."""
    pieces = F.array(
        F.struct(F.lit("(Intercept)").alias("term"), F.col("intercept").alias("estimate"), F.sqrt("v00").alias("std_error")),
        F.struct(F.lit("slope").alias("term"), F.col("slope").alias("estimate"), F.sqrt("v11").alias("std_error")),
    )
    table = lines.select(*strata, F.inline(pieces)).withColumn("z", F.try_divide(F.col("estimate"), F.col("std_error")))
    return table.withColumn("p", normal_two_sided("z"))


def new_infections(rates: DataFrame, person_years: DataFrame, on: list[str]) -> DataFrame:
    """Expected events: rate and its bounds times person-years; rows without time stay."""
    joined = rates.join(person_years.withColumnRenamed("pysum", "py"), on, "left")
    return joined.withColumns({n: F.col(c) * F.col("py") for n, c in (("newinf", "inc"), ("newinf_lb", "lb"), ("newinf_ub", "ub"))})


def ingest_form(preds: DataFrame, counts: DataFrame) -> DataFrame:
    """Prevalence predictions and effective counts in the layout a simulator ingests."""
    left = preds.select(
        F.col("year").alias("Year"),
        F.lit("All").alias("Province"),
        codes.recode("sex", codes.SEX_LONG).alias("Gender"),
        F.replace(F.col("agecat"), F.lit(","), F.lit(":")).alias("AgeBin"),
        F.col("prob").alias("Prevalence"),
        F.lit("").alias("weight"),
    )
    right = counts.withColumn("AgeBin", F.replace(F.col("AgeBin"), F.lit(","), F.lit(":")))
    joined = left.join(right, ["Gender", "Year", "AgeBin"])
    return joined.select("Year", "Province", "Gender", "AgeBin", "Prevalence", "weight", "effective_count")
