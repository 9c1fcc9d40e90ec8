import random

import pytest
from pyspark.sql import functions as F

from roundwise.functions import codes
from roundwise.operators import demographics as D
from roundwise.operators import panel as P
from roundwise.plans import cohort as C
from roundwise.plans import fixtures as X
from tests.compare import TESTDATA

SF = f"{TESTDATA}/sf0.001"


def visits(spark, rows):
    """rows: (subject, round, status, day)"""
    return spark.createDataFrame(rows, "research_id string, round int, hivstatus int, visit_day double")


def by_key(df, *cols):
    return {(r["research_id"], r["round"]): tuple(r[c] for c in cols) for r in df.collect()}


def test_complete_rounds_adds_only_inner_rounds(spark):
    df = visits(spark, [("a", 2, 0, 1.0), ("a", 5, 1, 9.0), ("b", 3, 0, 2.0)])
    got = by_key(P.complete_rounds(df), "hivstatus")
    assert got == {("a", 2): (0,), ("a", 3): (None,), ("a", 4): (None,), ("a", 5): (1,), ("b", 3): (0,)}


def test_complete_rounds_keeps_a_complete_panel(spark):
    df = visits(spark, [("a", r, 0, float(r)) for r in range(1, 6)])
    assert sorted(P.complete_rounds(df).collect()) == sorted(df.collect())


def test_impute_between_needs_agreement(spark):
    status = [None, 0, None, 0, None, 1, None, 1, None]
    df = visits(spark, [("a", i, s, None) for i, s in enumerate(status)])
    got = by_key(P.impute_between(df, "hivstatus", "out"), "out")
    assert [got[("a", i)][0] for i in range(9)] == [None, 0, 0, 0, None, 1, 1, 1, None]


def test_fill_both_prefers_the_past(spark):
    df = visits(spark, [("a", 1, None, None), ("a", 2, 0, None), ("a", 3, None, None), ("a", 4, 1, None)])
    got = by_key(P.fill_both(df, ["hivstatus"]), "hivstatus")
    assert [got[("a", i)][0] for i in range(1, 5)] == [0, 0, 0, 1]


@pytest.mark.parametrize(
    "statuses, label",
    [
        ([0, 0], P.SERIALLY_NEGATIVE),
        ([0], P.ONE_TEST_NEGATIVE),
        ([1, 1], P.SERIALLY_POSITIVE),
        ([0, 1], P.CONVERTER),
        ([None, None], P.NO_TESTING),
    ],
)
def test_classes(spark, statuses, label):
    df = visits(spark, [("a", i, s, None) for i, s in enumerate(statuses)])
    assert P.classify_subjects(df, status="hivstatus").first()["cohortclass"] == label


def test_bad_bounds_keep_rows_without_labels(spark):
    df = visits(spark, [("a", 1, 0, 1.0), ("a", 2, 1, 2.0), ("a", 3, 0, 3.0)])
    out = P.code_events(P.annotate_subjects(df, 1, status="hivstatus"), status="hivstatus")
    assert out.count() == 3
    assert out.where("cohortclass is not null or hivinc is not null or first_neg is not null").count() == 0


def test_draw_is_within_bounds_and_uniform(spark):
    subjects = spark.range(20000).select(
        F.col("id").cast("string").alias("research_id"), F.lit(1).alias("first_neg"), F.lit(3).alias("last_neg"), F.lit(8).alias("first_pos")
    ).withColumn("cohortclass", P.subject_class())
    counts = {r["seroconv_imp"]: r["count"] for r in P.draw_event_round(subjects, 1984).groupBy("seroconv_imp").count().collect()}
    assert sorted(counts) == [4, 5, 6, 7, 8]
    assert all(abs(n - 4000) < 250 for n in counts.values())


def test_draw_does_not_depend_on_partitioning(spark):
    subjects = P.classify_subjects(C.imputed_panel(X.status_visits(spark, SF), X.SETTINGS))
    one = sorted(P.draw_event_round(subjects.coalesce(1), 7).collect())
    many = sorted(P.draw_event_round(subjects.repartition(13), 7).collect())
    assert one == many


def test_events_and_person_time(spark):
    df = visits(spark, [("a", 1, 0, 0.0), ("a", 2, None, 365.25), ("a", 3, 1, 730.5), ("a", 4, 1, 1461.0)])
    out = P.person_time(P.code_events(P.annotate_subjects(df, 1984, status="hivstatus"), status="hivstatus"))
    rows = sorted(out.collect(), key=lambda r: r["round"])
    event = rows[0]["seroconv_imp"]
    assert event in (2, 3)
    for r in rows:
        assert r["hivinc"] == (1 if r["round"] == event else 0 if r["round"] < event else None)
    assert [r["py"] for r in rows] == [None] + [1.0 if r["hivinc"] is not None else None for r in rows[1:]]


def test_person_time_follows_dates_not_rounds(spark):
    df = visits(spark, [("a", 1, 0, 0.0), ("a", 2, 0, 730.5), ("a", 3, 0, 365.25)]).withColumn("hivinc", F.lit(0))
    got = by_key(P.person_time(df), "py")
    assert got == {("a", 1): (None,), ("a", 2): (1.0,), ("a", 3): (1.0,)}


def test_absorbing_flag_nulls_disordered_subjects(spark):
    df = visits(spark, [("a", 1, 1, None), ("a", 2, 0, None), ("b", 1, 0, None), ("b", 2, 1, None)])
    got = by_key(P.clean_absorbing_flag(df, "hivstatus", "flag"), "flag", "flag_fix")
    assert got == {("a", 1): (1, None), ("a", 2): (0, None), ("b", 1): (0, 0), ("b", 2): (1, 1)}


def test_one_row_per_round_survives_a_hot_subject(spark):
    random.seed(3)
    rows = [("hot", random.randint(1, 5), 0, float(random.randint(0, 999))) for _ in range(3000)]
    rows += [(str(i), 1, 0, float(i)) for i in range(3000)]
    kept = P.one_row_per_round(visits(spark, rows), "research_id", "round", ["visit_day"])
    assert P.duplicate_person_rounds(kept).count() == 0
    got = by_key(kept.where("research_id = 'hot'"), "visit_day")
    for r in range(1, 6):
        assert got[("hot", r)] == (min(d for i, q, _, d in rows if i == "hot" and q == r),)


def test_fused_chain_equals_the_steps(spark):
    status, verif, quest = (make(spark, SF) for make in (X.status_visits, X.eligibility, X.questionnaire))
    fused = C.analysis_panel(status, verif, quest, X.SETTINGS)
    steps = D.attach_demographics(C.event_panel(status, X.SETTINGS), D.clean_eligibility(verif), D.clean_questionnaire(quest))
    steps = D.add_bands(steps.where(F.col("ageyrs2").between(15, 50)))
    columns = sorted(steps.columns)
    assert columns == sorted(fused.columns)
    assert sorted(map(repr, steps.select(columns).collect())) == sorted(map(repr, fused.select(columns).collect()))


def test_raw_coding(spark):
    raw = spark.createDataFrame(
        [("1", "R019", "N", "2001-02-03"), ("2", "R020", "S", "1998-01-01"), ("3", "none", "x", "bad")],
        "study_id string, round string, finalhiv string, intdate string",
    )
    rows = {r["research_id"]: r for r in D.clean_status_visits(raw, 1999).collect()}
    assert (rows["1"]["round"], rows["1"]["hivstatus"], rows["1"]["year"]) == (19, 0, 2001)
    assert (rows["2"]["hivstatus"], rows["2"]["visit_day"], rows["2"]["year"]) == (1, None, None)
    assert (rows["3"]["round"], rows["3"]["hivstatus"], rows["3"]["visit_day"]) == (None, None, None)


def test_bands_disagree_at_the_edges(spark):
    ages = spark.createDataFrame([(a,) for a in (14, 15, 24, 25, 49, 50, 51)], "a int")
    rows = ages.select(
        codes.band("a", **codes.REPORT_BANDS).alias("x"), codes.band("a", **codes.FIVE_YEAR_BANDS).alias("y"), codes.band("a", **codes.MODEL_BANDS).alias("z")
    ).collect()
    assert [r["x"] for r in rows] == [None, "15-24", "15-24", "25-34", "35-49", "35-49", None]
    assert [r["y"] for r in rows] == [None, "[15,20)", "[20,25)", "[25,30)", "[45,50)", None, None]
    assert [r["z"] for r in rows] == ["15-24", "15-24", "15-24", "25-34", "35-49", None, None]


def test_building_a_panel_runs_no_job_and_fills_missing_days(spark):
    from roundwise.plans import catalogue

    sc = spark.sparkContext
    sc.setJobGroup("build", "plans only")
    for name in ("person_time", "fill_visit_day", "rate_by_sex", "person_time_histogram", "numeric_summary", "parameter_quantiles"):
        catalogue.QUERIES[name](spark, SF)
    assert list(sc.statusTracker().getJobIdsForGroup("build")) == []
    sc.setJobGroup("run", "the rest")
    visits = spark.createDataFrame([("a", 1, 10.0, None), ("b", 1, 30.0, None), ("b", 2, None, None), ("c", 1, None, None), ("c", None, None, None)], "research_id string, round int, visit_day double, year int")
    filled = P.fill_visit_day(visits, P.mean_day_by_round(visits))
    got = {(r["research_id"], r["round"]): r["visit_day"] for r in filled.collect()}
    assert got == {("a", 1): 10.0, ("b", 1): 30.0, ("b", 2): None, ("c", 1): 20.0, ("c", None): None}


def test_two_rows_of_one_subject_and_round_are_refused(spark):
    twice = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 2, 0)], "research_id string, round int, v int")
    for make in (P.complete_rounds, P.refuse_duplicates):
        with pytest.raises(Exception, match="two rows of one subject and round"):
            make(twice).collect()
    once = P.one_row_per_round(twice, "research_id", "round", ["v"])
    assert sorted(map(tuple, P.refuse_duplicates(P.complete_rounds(once)).collect())) == [("a", 1, 0), ("b", 2, 0)]


def test_columns_are_dropped_by_pattern(spark):
    df = spark.createDataFrame([(1, 2, 3)], "seroconv_date int, keep int, seroconv int")
    assert P.drop_matching(df, "^seroconv").columns == ["keep"]


def test_averted_keeps_only_keys_with_a_baseline(spark):
    from roundwise.operators import curves as K

    df = spark.createDataFrame([("b", 1, 10.0), ("x", 1, 8.0), ("x", 2, 5.0), ("y", 1, 0.0)], "scenario string, k int, cuminc_mean double")
    rows = sorted(map(tuple, K.infections_averted(df, "b", ["k"]).select("k", "scenario", "delta_inc_mean", "delta_inc_mean_pct").collect()))
    assert rows == [(1, "b", 0.0, 0.0), (1, "x", -2.0, -0.25), (1, "y", -10.0, None)]


def test_histograms_list_empty_bins(spark):
    from roundwise.operators import quantiles as Q

    df = spark.createDataFrame([("a", 0.0), ("a", 4.0), ("a", None), ("b", 7.0), (None, 1.0)], "key string, v double")
    rows = [(r["key"], r["bin"], r["n"]) for r in Q.equal_width_counts(df, "key", "v", 4).collect()]
    assert sorted(r for r in rows if r[0] == "a") == [("a", 0, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 1)]
    assert sum(n for k, _, n in rows if k == "b") == 1


def test_subjects_without_birth_date_are_verified(spark, tmp_path):
    """Being in the eligibility table is enough; 7 has no birth date there, 8 no row."""
    from roundwise.plans import catalogue

    orders = [(1, 7, "F", 10.0, "1996-02-01", "5-LOW"), (2, 7, "F", 10.0, "1996-05-01", "5-LOW"), (3, 9, "F", 10.0, "1996-02-01", "5-LOW"), (4, 8, "F", 10.0, "1996-02-01", "5-LOW")]
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    spark.createDataFrame(orders, names).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    people = [(7, 1, 5.0, "BUILDING"), (9, 1, 5.0, "BUILDING")]
    spark.createDataFrame(people, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalogue.QUERIES["status_of_verified"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(5, 2, 2), (6, 1, 1)]
