import os
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as contract
from roundwise.operators import demographics as D
from roundwise.operators import estimates as E
from roundwise.plans import cohort as C
from roundwise.plans import fixtures as X
from roundwise.session import shared_folder, tune
from roundwise.sources import readers, sinks
from tests.compare import TESTDATA

SF = f"{TESTDATA}/sf0.001"


def test_sinks_refuse_an_existing_path(spark):
    df = spark.range(3)
    path = sinks.write_csv(df, shared_folder(spark), ["n"])
    with pytest.raises(AnalysisException):
        sinks.write_csv(df, path)
    table = sinks.write_table(df, shared_folder(spark))
    with pytest.raises(AnalysisException):
        sinks.write_table(df, table)


def test_csv_missing_values_and_misnamed_columns(spark, tmp_path):
    file = tmp_path / "both.csv"
    file.write_text('"Year","Sex","Age","model","events","py","inc","lb","ub"\n"Men",2004,"15-24","gamfit",12,1307,0.89,NA,1.1\n')
    row = readers.read_csv(spark, str(file), readers.RATES_BOTH_MODELS).first()
    assert (row["sex"], row["year"], row["lb"], row["ub"]) == ("Men", 2004, None, 1.1)


def test_shared_folder_follows_the_session(spark):
    first, second = shared_folder(spark), shared_folder(spark)
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def plan_of(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
        )
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_person_level_chain_shuffles_once_by_subject(spark):
    """From unique visits to person-time there is one exchange, by subject; the other one
    of the plan moves the partial means of the rounds."""
    tune(spark)
    path = sinks.write_table(X.status_visits(spark, SF), shared_folder(spark))
    visits = readers.read_table(spark, path, readers.STATUS_VISITS)
    plan = plan_of(spark, C.event_panel(visits, X.SETTINGS))
    assert len(re.findall(r"Exchange hashpartitioning\(research_id", plan)) == 1
    assert re.findall(r"Exchange hashpartitioning\((?!research_id)(\w+)#\d+, ", plan) == ["round"]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def test_demographic_joins_reuse_the_subject_partitioning(spark):
    tune(spark)
    paths = [sinks.write_table(make(spark, SF), shared_folder(spark)) for make in (X.status_visits, X.eligibility, X.questionnaire)]
    schemas = (readers.STATUS_VISITS, readers.ELIGIBILITY, readers.QUESTIONNAIRE)
    tables = [readers.read_table(spark, p, s) for p, s in zip(paths, schemas)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(spark, C.analysis_panel(*tables, X.SETTINGS))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("SortMergeJoin") == 2
    assert re.findall(r"Exchange hashpartitioning\((?!research_id)(\w+)#\d+, ", plan) == ["round"]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 4


def test_joined_panel_is_not_sorted_again(spark):
    """The joins leave the rows in order of subject and round; only person-time, which goes
    by date, sorts the joined rows."""
    tune(spark)
    paths = [sinks.write_table(make(spark, SF), shared_folder(spark)) for make in (X.status_visits, X.eligibility, X.questionnaire)]
    schemas = (readers.STATUS_VISITS, readers.ELIGIBILITY, readers.QUESTIONNAIRE)
    tables = [readers.read_table(spark, p, s) for p, s in zip(paths, schemas)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(spark, C.analysis_panel(*tables, X.SETTINGS))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    above_joins = plan[: plan.index("SortMergeJoin")]
    assert len(re.findall(r"\bSort \[", above_joins)) == 1 and "visit_day" in re.search(r"\bSort \[(.*?)\]", above_joins)[1]


def test_flow_panel_is_sorted_once_after_its_joins(spark):
    """Windows over the joined rows and the counts of the flow use the order of the joins."""
    tune(spark)
    paths = [sinks.write_table(make(spark, SF), shared_folder(spark)) for make in (X.status_visits, X.eligibility, X.questionnaire)]
    schemas = (readers.STATUS_VISITS, readers.ELIGIBILITY, readers.QUESTIONNAIRE)
    visits, eligible, answers = [readers.read_table(spark, p, s) for p, s in zip(paths, schemas)]
    panel = D.attach_demographics(C.event_panel(visits, X.SETTINGS), D.clean_eligibility(eligible), D.clean_questionnaire(answers))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(spark, E.observed_flow(panel, {"all": F.lit(True)})[0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Sort [" not in plan[: plan.index("SortMergeJoin")]


def test_tasks_follow_bytes_and_not_the_number_of_partitions(spark):
    """A session with one shuffle partition does not give a panel's task all the rows."""
    tune(spark)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = spark.range(1_500_000).select(F.md5(F.col("id").cast("string")).alias("research_id"), F.lit(1).alias("round"))
        again = F.row_number().over(Window.partitionBy("research_id").orderBy("round"))
        sizes = rows.withColumn("n", again).where("n = 1").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert sum(r["count"] for r in sizes) == 1_500_000 and max(r["count"] for r in sizes) < 750_000


def test_one_row_group_of_orders_is_summed_in_parts(spark, tmp_path):
    """No task sums up all customers and quarters of a file that it reads alone; a customer
    with a third of the orders, missing customers and orders that come twice count in full."""
    tune(spark)
    number = F.col("id")
    orders = spark.range(30_000, numPartitions=1).select(
        F.when(number % 5000 == 1, 7).otherwise(number).cast("bigint").alias("o_orderkey"),
        F.when(number % 3 == 0, 1).when(number % 100 != 2, number % 4001).cast("bigint").alias("o_custkey"),
        F.lit("F").alias("o_orderstatus"),
        F.lit(1.25).alias("o_totalprice"),
        F.expr("TIMESTAMP_NTZ'1996-01-01 00:00:00' + make_dt_interval(CAST(id % 700 AS INT))").alias("o_orderdate"),
        F.lit("5-LOW").alias("o_orderpriority"),
    )
    orders.union(orders.where("id % 1000 = 5").drop("id")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    survey = X._survey(spark, str(tmp_path))
    plan = plan_of(spark, survey)
    assert re.search(r"HashAggregate\(.*\n.*HashAggregate\(.*partial_.*\n.*Exchange hashpartitioning\(id#\w+, rnd#\w+, ", plan)
    assert "Aggregate" not in plan[plan.index("REBALANCE") :]
    got = sorted(((r.id, r.rnd, str(r.visit_date), r.key, r.cum, r.ordinal) for r in survey.collect()), key=repr)
    rows = spark.read.parquet(f"{tmp_path}/orders.parquet").selectExpr("o_custkey", f"{X._QUARTER}", "CAST(o_orderdate AS DATE)", "o_orderkey").collect()
    want, firsts, counts = [], {}, {}
    for i, q, day, key in rows:
        firsts[i, q] = min(firsts.get((i, q), (day, key)), (day, key))
        counts[i, q] = counts.get((i, q), 0) + 1
    for (i, q), (day, key) in firsts.items():
        before = sum(counts.get((i, p), 0) for p in range(q))
        want.append((i, q, str(day), key, 125 * (before + 1), before + 1))
    assert len(rows) == 30_000 + 30 and got == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["crude_cases_py", "parameter_quantiles", "smooth_curves", "contingency_3way", "ingest_form", "infections_averted"])
def test_no_cross_join_and_pruned_scans(spark, name):
    plan = plan_of(spark, contract.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "o_comment" not in plan and "c_name" not in plan


def part_lines(path):
    files = sorted(f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-"))
    return [open(os.path.join(path.removeprefix("file:"), f)).read().splitlines()[1:] for f in files]


@pytest.mark.parametrize("single, files", [(True, 1), (False, 5), (False, None)])
def test_csv_files_are_in_order(spark, single, files):
    """Read by name, the part files give the whole order, with ties, missing values and a
    third of all rows on one key."""
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 1000 = 1 THEN NULL ELSE (id * 7919) % 5000 END AS a", "(id * 104729) % 20011 AS b", "id AS c").repartition(7)
    parts = part_lines(sinks.write_csv(df, shared_folder(spark), ["k", "b", "c"], order=["k", "b"], single_file=single, files=files))
    got = [tuple(None if v == "NA" else int(v) for v in line.split(",")) for part in parts for line in part]
    want = sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    assert got == want and files in (None, len(parts))


def test_ordered_ranges_leave_no_single_task(spark):
    sizes = spark.range(50_000).selectExpr("1 AS a", "id AS b").transform(sinks.in_order, ["a"], 8).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 25_000


def test_bucketed_hand_off_needs_no_exchange(spark):
    """The next job's windows, aggregates and joins by subject move nothing."""
    panel = C.event_panel(X.status_visits(spark, SF), X.SETTINGS)
    names = [f"panel_{i}_{os.getpid()}" for i in range(2)]
    for name in names:
        sinks.write_bucketed(panel, name, shared_folder(spark), "research_id", ["round"])
    one, other = (spark.table(n) for n in names)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        windows = one.withColumn("before", F.lag("hivstatus").over(Window.partitionBy("research_id").orderBy("round")))
        by_subject = windows.groupBy("research_id").agg(F.count("before").alias("n"))
        plan = plan_of(spark, by_subject.join(other.select("research_id", "round"), "research_id"))
        assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in names:
            spark.sql(f"DROP TABLE {name}")
    with pytest.raises(AnalysisException):
        spark.table(names[0])


def test_one_scan_for_many_levels_and_tables(spark):
    path = sinks.write_table(contract.queries()["attach_demographics"](spark, SF), shared_folder(spark))
    panel = readers.read_table(spark, path)
    numbers = readers.read_table(spark, sinks.write_table(E.number_subjects(panel), shared_folder(spark)))
    levels = E.subjects_rollup(panel.join(numbers, "research_id", "left"), [[], ["sex"], ["sex", "round"]])
    assert plan_of(spark, levels).count("FileScan") == 2
    tables = {"a": E.Table(["sex"]), "b": E.Table(["round", "sex"], keep_missing=True), "c": E.Table(["agecat"], only=F.col("sex") == "F")}
    assert plan_of(spark, E.count_tables(panel, tables)).count("FileScan") == 1
