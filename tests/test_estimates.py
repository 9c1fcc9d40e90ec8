import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roundwise.functions.intervals import gamma_quantile, poisson_limits
from roundwise.operators import estimates as E
from roundwise.operators import quantiles as Q
from roundwise.operators import trends as M

# Published rows: events, rounded person-years, then rate per 100 and its bounds as
# printed for the factor model.
FACTOR_ROWS = [
    (9, 776, 1.16, 0.60, 2.23), (10, 1193, 0.84, 0.45, 1.56), (16, 1267, 1.26, 0.77, 2.06), (5, 2373, 0.21, 0.09, 0.51),
    (6, 699, 0.86, 0.39, 1.91), (19, 1177, 1.61, 1.03, 2.53), (44, 2896, 1.52, 1.13, 2.04), (13, 2690, 0.48, 0.28, 0.83),
]
# Published rows: tested, positive, prevalence, standard error and bounds.
PREVALENCE_ROWS = [
    (3025, 450, 0.148760330578512, 0.0064700376082978, 0.136079056866249, 0.161441604290776),
    (2227, 247, 0.110911540188595, 0.0066542750198822, 0.0978691611496254, 0.123953919227564),
    (3931, 614, 0.15619435258204, 0.0057903172011673, 0.144845330867752, 0.167543374296328),
]


def test_factor_rates_reproduce_published_rows(spark):
    cells = spark.createDataFrame([(k, float(t)) for k, t, *_ in FACTOR_ROWS], "events bigint, pysum double")
    got = {(r["events"], r["pysum"]): r for r in M.rate_factor(cells, per=100.0).collect()}
    for k, t, rate, low, high in FACTOR_ROWS:
        r = got[(k, float(t))]
        assert (abs(r["inc"] - rate), abs(r["lb"] - low), abs(r["ub"] - high)) < (0.0051,) * 3
        assert max(abs(r["inc"] - rate), abs(r["lb"] - low), abs(r["ub"] - high)) < 0.0051


def test_wald_reproduces_published_rows(spark):
    cells = spark.createDataFrame([(n, k) for n, k, *_ in PREVALENCE_ROWS], "n bigint, positives bigint")
    got = {r["n"]: r for r in E.with_wald(cells).collect()}
    for n, _, *expected in PREVALENCE_ROWS:
        assert np.allclose([got[n][c] for c in ("prop", "se", "lb", "ub")], expected, rtol=1e-12)


def test_overall_rate_of_the_published_cohort(spark):
    cells = spark.createDataFrame([(1317, 141537.3), (795, 76055.88), (522, 65481.37)], "events bigint, pysum double")
    assert [round(r["rate"], 2) for r in E.with_exact_limits(cells).orderBy(F.desc("pysum")).collect()] == [0.93, 1.05, 0.80]


def poisson_cdf(k, x):
    return math.fsum(math.exp(-x + j * math.log(x) - math.lgamma(j + 1)) for j in range(k + 1))


@pytest.mark.parametrize("k", [0, 1, 2, 9, 50, 400, 1317])
def test_exact_limits_solve_their_equations(k):
    high = gamma_quantile(0.975, np.array([k + 1.0]))[0]
    assert poisson_cdf(k, high) == pytest.approx(0.025, rel=1e-9)
    if k:
        low = gamma_quantile(0.025, np.array([float(k)]))[0]
        assert poisson_cdf(k - 1, low) == pytest.approx(0.975, rel=1e-9)


def test_exact_limits_known_values_and_missing(spark):
    df = spark.createDataFrame([(0,), (1,), (9,), (None,), (10**8,)], "k bigint").select("k", poisson_limits("k").alias("l")).select("k", "l.*")
    rows = {r["k"]: r for r in df.collect()}
    assert rows[0]["lower"] == 0 and rows[0]["upper"] == pytest.approx(3.688879454)
    assert rows[1]["upper"] == pytest.approx(5.571643391)
    assert rows[9]["upper"] == pytest.approx(17.08480345)
    assert rows[10**8]["lower"] == pytest.approx(10**8 - 1.96 * 10**4, rel=1e-6)
    assert rows[None]["lower"] is None or math.isnan(rows[None]["lower"])


def test_null_policies(spark):
    df = spark.createDataFrame([(1,), (0,), (None,), (None,)], "x int")
    assert E.proportion_table(df, "x", []).first()["prop"] == 0.5
    assert E.proportion_table(df, "x", [], "count").first()["prop"] == 0.75
    with pytest.raises(ValueError):
        E.proportion_table(df, "x", [], "other")


def skewed(spark, rows=60_000):
    """A third of all rows in one group, and half of that group at one value."""
    g = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string")))
    v = F.when((F.col("id") % 6 == 0), 7.0).otherwise(F.pmod(F.hash("id"), F.lit(100_000)) / 10)
    return spark.range(rows).select(g.alias("g"), v.alias("v"))


@pytest.mark.parametrize("merged", [False, True])
def test_quantiles_are_exact_on_skewed_groups(spark, merged):
    df = skewed(spark)
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    names = {f"q{i}": p for i, p in enumerate(probs)}
    got = {r["g"]: r for r in Q.group_summary(df, ["g"], "v", names, merged=merged).collect()}
    for g, values in df.toPandas().groupby("g")["v"]:
        assert (got[g]["n"], got[g]["n_missing"]) == (len(values), 0)
        assert got[g]["mean"] == pytest.approx(values.mean())
        for name, p in names.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12), (g, p)


@pytest.mark.parametrize("merged", [False, True])
def test_quantiles_of_values_of_any_size(spark, merged):
    """Neighbouring doubles, both signs, zeros, the smallest and the largest numbers."""
    near = [1.0]
    for _ in range(400):
        near.append(float(np.nextafter(near[-1], 2)))
    groups = {
        "near": near,
        "wide": [s * 10.0**e for e in range(-320, 309) for s in (-1, 1)] + [0.0, -0.0, 5e-324, -5e-324],
        "ends": [float("-inf"), float("-inf"), float("inf"), float("inf"), float("inf")],
        "one": [3.0],
    }
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double")
    got = {r["g"]: r for r in Q.group_summary(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.75}, merged=merged).collect()}
    for g, values in groups.items():
        for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.75)):
            at, values = (len(values) - 1) * p, sorted(values)
            low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            assert got[g][name] == (low if low == high else low + (high - low) * (at - int(at))), (g, p)


def test_quantiles_with_missing_key_and_no_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0), ("a", None), ("b", None)], "g string, v double")
    rows = {r["g"]: (r["n"], r["n_missing"], r["m"]) for r in Q.group_summary(df, ["g"], "v", {"m": 0.5}).collect()}
    assert rows == {None: (2, 0, 1.5), "a": (1, 1, 5.0), "b": (0, 1, None)}
    assert Q.group_summary(df, [], "v", {"m": 0.5}).first()["m"] == 2.0


@pytest.mark.parametrize("merged,passes", [(False, 2), (True, 1)])
def test_quantiles_read_their_source_twice_or_once(spark, merged, passes):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    df = skewed(spark).mapInArrow(counted, "g string, v double")
    assert Q.group_summary(df, ["g"], "v", Q.QUARTILES, merged=merged).select("g", "q50").collect()
    assert rows.value == passes * skewed(spark).count()


def test_quantiles_of_more_groups_than_marks(spark):
    """Every key is marked then, and all rows take the way through the shuffle."""
    df = spark.range(3 * 64 * Q.MARK_WORDS).select((F.col("id") % (64 * Q.MARK_WORDS)).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))
    got = Q.group_summary(df, ["g"], "v", Q.QUARTILES).select("g", *Q.QUARTILES)
    want = df.groupBy("g").agg(*[F.percentile("v", p).alias(k) for k, p in Q.QUARTILES.items()])
    assert got.count() == 64 * Q.MARK_WORDS
    assert got.join(want.toDF("g", "a", "b", "c"), "g").where("abs(q25 - a) + abs(q50 - b) + abs(q75 - c) > 1e-9").count() == 0


def test_histogram_counts_every_row(spark):
    df = skewed(spark).union(spark.createDataFrame([("same", 4.0), ("same", 4.0)], "g string, v double"))
    counts = Q.equal_width_counts(df, "g", "v", 7).groupBy("g").agg(F.sum("n").alias("n"), F.max(F.when(F.col("n") > 0, F.col("bin"))).alias("b"))
    rows = {r["g"]: r for r in counts.collect()}
    assert rows["hot"]["n"] == 20_000 and rows["hot"]["b"] == 6
    assert (rows["same"]["n"], rows["same"]["b"]) == (2, 0)


def test_contingency_zero_fill_and_missing(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "x string, y int")
    full = E.contingency(df, ["x", "y"], {"x": ["a", "b"], "y": [1, 2]})
    assert {(r["x"], r["y"]): r["n"] for r in full.collect()} == {("a", 1): 2, ("a", 2): 0, ("b", 1): 0, ("b", 2): 0}
    assert E.contingency(df, ["y"], keep_missing=True).where("y is null").first()["n"] == 1


def test_empty_band_is_kept(spark):
    cells = spark.createDataFrame([("x", 1, 2, 1)], "band string, round int, n bigint, positives bigint")
    rows = {r["band"]: r for r in E.keep_empty_bands(cells, "band", ["x", "y"], ["n", "positives"]).collect()}
    assert (rows["y"]["round"], rows["y"]["n"]) == (None, 0)


def test_contingency_keeps_levels_beyond_the_listed(spark):
    df = spark.createDataFrame([(1, "x"), (28, "x"), (29, "y")], "round int, g string")
    got = {(r["round"], r["g"]): r["n"] for r in E.contingency(df, ["round", "g"], {"round": [2], "g": []}).collect()}
    assert got == {(r, g): int((r, g) in {(1, "x"), (28, "x"), (29, "y")}) for r in (1, 2, 28, 29) for g in "xy"}


def test_empty_bands_are_added_and_missing_bands_kept(spark):
    cells = spark.createDataFrame([("a", 3), (None, 2)], "band string, n long")
    got = {r["band"]: r["n"] for r in E.keep_empty_bands(cells, "band", ["a", "b"], ["n"]).collect()}
    assert got == {"a": 3, "b": 0, None: 2}


@pytest.mark.parametrize("p", [0.025, 0.975])
def test_gamma_quantiles_of_large_shapes(p):
    """The expansion agrees with series and fraction where both work, and with the
    first terms of the Cornish-Fisher series where those are exact to rounding."""
    import time

    from roundwise.functions import intervals

    for shape in (1e4, 3.7e4, 1e5):
        x = gamma_quantile(p, np.array([shape]))
        assert abs(intervals._lower_gamma(np.array([shape]), x)[0][0] - p) < 1e-10
    z = math.copysign(1.959963984540054, p - 0.5)
    start = time.perf_counter()
    for shape in (1e8, 1e10, 1e14):
        series = shape + z * math.sqrt(shape) + (z * z - 1) / 3 + (z**3 - 7 * z) / (36 * math.sqrt(shape))
        assert abs(gamma_quantile(p, np.array([shape]))[0] - series) <= 1e-9 * math.sqrt(shape) + 4e-16 * shape
    assert time.perf_counter() - start < 0.1


VISITS = "research_id string, round int, finalhiv string"


def test_every_level_that_occurs_gets_a_column(spark):
    rows = [("a", 1, "N"), ("a", 1, "N"), ("b", 1, None), ("c", 2, "indeterminate"), ("d", 2, "N"), (None, 3, "P"), ("e", None, "P")]
    counts = E.level_counts(spark.createDataFrame(rows, VISITS), "round", "finalhiv").persist()
    assert {r["round"]: r["counts"] for r in counts.collect()} == {1: {"N": 1, "missing": 1}, 2: {"indeterminate": 1, "N": 1}, None: {"P": 1}}
    wide = E.spread_levels(counts)
    assert wide.columns == ["round", "N", "P", "indeterminate", "missing"]
    assert {tuple(r) for r in wide.collect()} == {(1, 1, None, None, 1), (2, 1, None, 1, None), (None, None, 1, None, None)}
    with pytest.raises(ValueError):
        E.spread_levels(counts, most=3)
    assert E.spread_levels(counts.limit(0)).columns == ["round"]
    counts.unpersist()


def test_effective_counts_keep_every_sex_and_band(spark):
    rows = [("F", 2000, "[15,20)", 3), ("X", 2001, "[50,55)", 2), (None, 2001, "[15,20)", 4), ("M", 2001, None, 1), ("M", None, "[15,20)", 1)]
    cells = spark.createDataFrame(rows, "sex string, year int, agecat string, n_status long")
    got = {(r["Year"], r["AgeBin"], r["Gender"]): r["effective_count"] for r in E.effective_counts(cells).collect()}
    assert len(got) == 2 * 8 * 3 and sum(got.values()) == 5
    assert got[2000, "[15,20)", "Female"] == 3 and got[2001, "[50,55)", "X"] == 2 and got[2001, "[15,20)", "Male"] == 0


def test_observed_flow_equals_the_counted_one(spark, tmp_path):
    rows = [(f"s{i % 40}" if i % 11 else None, i // 40, i % 7 if i % 5 else None) for i in range(400)] + [("hot", i, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "research_id string, round int, v int").repartition(5)
    stages = {"all": F.lit(True), "big": F.col("v") > 4, "never": F.col("v") > 100, "unknown": F.col("v").isNull()}
    written, counts = E.observed_flow(df, stages)
    written.write.parquet(str(tmp_path / "out"))
    got = {tuple(r) for r in E.flow_table(df, stages, counts).collect()}
    known = df.where("research_id is not null")
    want = {tuple(r) for r in E.cohort_flow(known, stages).collect()}
    assert {(s, n, subjects) for s, n, _, subjects in got} == {(s, n, subjects) for s, n, _, subjects in want}
    assert {n: rows for _, n, rows, _ in got}["all"] == 600
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(repr, df.collect()))


@pytest.mark.parametrize("subjects", [1, 70_000])
def test_subjects_rollup_is_exact(spark, subjects):
    """Also over several bitmaps, repeated rows, missing strata and missing subjects."""
    df = spark.range(subjects * 2).selectExpr(f"CASE WHEN id % 13 <> 5 THEN CAST(id % {subjects} AS STRING) END AS research_id", "CASE WHEN id % 3 = 0 THEN 'F' WHEN id % 3 = 1 THEN 'M' END AS sex", "CAST(id % 4 AS INT) AS round")
    numbers = E.number_subjects(df).persist()
    got = {tuple(r) for r in E.subjects_rollup(df.join(numbers, "research_id", "left"), [[], ["sex"], ["sex", "round"]]).collect()}
    want = {(3, None, None, df.agg(F.count_distinct("research_id")).first()[0])}
    want |= {(1, r[0], None, r[1]) for r in df.groupBy("sex").agg(F.count_distinct("research_id")).collect()}
    want |= {(0, *r) for r in df.groupBy("sex", "round").agg(F.count_distinct("research_id")).collect()}
    assert {g for g in got if g[3]} == {w for w in want if w[3]}
    numbers.unpersist()


def test_tables_of_one_pass_equal_single_tables(spark):
    rows = [("F", 1, "x"), ("F", 2, "x"), ("M", 1, None), ("M", None, "y"), (None, 1, "x"), ("F", 1, "x")]
    df = spark.createDataFrame(rows, "a string, b int, c string")
    tables = {
        "ab": E.Table(["a", "b"], levels={"a": ["F", "M", "X"]}),
        "ba": E.Table(["b", "a"], keep_missing=True),
        "c": E.Table(["c"], only=F.col("a") == "M", keep_missing=True),
        "share": E.Table(["a", "c"], share_of="c"),
    }
    got = [tuple(r) for r in E.finished_tables(E.count_tables(df, tables).persist(), tables).collect()]
    ab = {(r["a"], r["b"], r["n"]) for r in E.contingency(df, ["a", "b"], {"a": ["F", "M", "X"], "b": []}).collect()}
    assert {(a, b, n) for t, a, b, _, n, _ in got if t == "ab"} == ab and len(ab) == 6
    ba = {(r["a"], r["b"], r["n"]) for r in E.contingency(df, ["a", "b"], keep_missing=True).collect()}
    assert {(a, b, n) for t, a, b, _, n, _ in got if t == "ba"} == ba
    assert {(c, n) for t, _, _, c, n, _ in got if t == "c"} == {(None, 1), ("y", 1)}
    assert {(a, c, n, s) for t, a, _, c, n, s in got if t == "share"} == {("F", "x", 3, 1.0), ("M", "y", 1, 1.0)}
