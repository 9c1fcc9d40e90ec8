"""Survey tables, scenario curves and parameters derived from the test tables.

Orders stand for visits (customer = subject, calendar quarter = round), order status
and spending stand for test results, customers for demographics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundwise.functions import codes
from roundwise.operators.curves import running_total
from roundwise.operators.quantiles import group_summary
from roundwise.plans.cohort import StudySettings
from roundwise.session import shared_folder
from roundwise.sources.readers import read_table
from roundwise.sources.sinks import write_table

SETTINGS = StudySettings(seed=1984, first_year=1995)


# Only the columns used; naming them spares a schema-inference job per read.
_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "lineitem": "l_quantity double, l_extendedprice double, l_discount double, l_tax double",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


# The codes of the order table.
_STATES = ["F", "O", "P"]
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_KEY_SPACE = 1 << 44  # order keys stay below this
_DEALT = 200  # so many partitions at most are written row by row, without sorting them in memory
_QUARTER = "(year(o_orderdate) - 1995) * 4 + quarter(o_orderdate)"
_BORN = "date_add(DATE '1945-01-01', CAST((c_custkey * 37) % 14000 AS INT))"


def _survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (customer, quarter): its first order, with the running spending and
    order number at that order.

    Orders are summed per quarter before the running sums, so a customer with very
    many orders costs the window no more rows than there are quarters. All aggregation
    buffers are plain numbers, which keeps the aggregation hash-based.

    Orders are dealt by customer and quarter before they are summed: a file of one row
    group is read by one task, which would else hold all of its customers and quarters
    at once. A raw row is also narrower than the buffers it would travel in.
    """
    labels = [codes.level_code("o_orderstatus", _STATES).alias("s"), codes.level_code("o_orderpriority", _PRIORITIES).alias("p")]
    orders = read(spark, sf_dir, "orders").select("*", *labels).selectExpr(
        "o_custkey AS id",
        f"{_QUARTER} AS rnd",
        f"CAST(unix_date(CAST(o_orderdate AS DATE)) AS BIGINT) * {_KEY_SPACE} + o_orderkey AS place",
        "s * 8 + p AS code",
        "floor(o_totalprice * 100 + 0.5) AS cents",
    )
    first = ["min(place) AS place", "min_by(code, place) AS code", "min_by(cents, place) AS cents"]
    totals = ["sum(cents) AS total", "count(1) AS n_orders"]
    dealt = orders.hint("rebalance", _DEALT, "id", "rnd")
    quarters = dealt.groupBy("id", "rnd").agg(*map(F.expr, first + totals))
    before = "OVER (PARTITION BY study_id ORDER BY rnd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return quarters.selectExpr("*", "CAST(id AS STRING) AS study_id").selectExpr(
        "study_id",
        "rnd",
        "concat('R', lpad(CAST(rnd AS STRING), 3, '0')) AS round",
        "id",
        f"date_from_unix_date(CAST(floor(place / {_KEY_SPACE}) AS INT)) AS visit_date",
        f"place % {_KEY_SPACE} AS key",
        "code",
        f"coalesce(sum(total) {before}, 0) + cents AS cum",
        f"coalesce(sum(n_orders) {before}, 0) + 1 AS ordinal",
    )


def survey_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """research_id of every subject of the survey tables."""
    return read(spark, sf_dir, "orders").selectExpr("CAST(o_custkey AS STRING) AS research_id")


def _named(df: DataFrame) -> DataFrame:
    """Order status and priority back as text."""
    names = {"state": ("floor(code / 8)", _STATES), "priority": ("code % 8", _PRIORITIES)}
    return df.withColumns({c: codes.recode(e, {i + 1: v for i, v in enumerate(vs)}, keep_other=False) for c, (e, vs) in names.items()})


def status_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_survey(spark, sf_dir)).selectExpr(
        "study_id",
        "round",
        """CASE WHEN state = 'P' THEN NULL
                WHEN cum >= 300000000 THEN CASE WHEN key % 7 = 0 THEN 'S' ELSE 'P' END
                WHEN id % 20 = 0 AND priority = '5-LOW' THEN 'P' ELSE 'N' END AS finalhiv""",
        "date_format(visit_date, 'yyyy-MM-dd') AS intdate",
    )


def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = read(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS study_id",
        "CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex",
        f"{_BORN} AS born",
        f"CASE WHEN c_custkey % 50 <> 7 THEN date_format({_BORN}, 'dd/MM/yyyy') END AS birthdate",
        "CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS resident",
        "CAST(c_custkey % 3 AS INT) AS mobility",
    )
    visits = _survey(spark, sf_dir).select("study_id", "rnd", "round", "visit_date")
    return visits.join(people, "study_id").selectExpr(
        "study_id",
        "round",
        "CASE WHEN rnd % 5 <> 0 THEN sex END AS sex",
        "year(visit_date) - year(born) AS ageyrs",
        "birthdate",
        "resident",
        "mobility",
    )


def questionnaire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_survey(spark, sf_dir)).selectExpr(
        "study_id",
        "round",
        "CASE WHEN priority = '1-URGENT' THEN 1 WHEN priority <> '2-HIGH' THEN 2 END AS arvmed",
        "CASE WHEN key % 3 = 0 THEN 1 ELSE 2 END AS cuarvmed",
        """CASE WHEN id % 25 = 0 AND ordinal = 7 THEN 2 WHEN priority = '3-MEDIUM' THEN NULL
                WHEN ordinal >= 5 THEN 1 ELSE 2 END AS circum""",
        "CASE WHEN key % 10 = 0 THEN 8 WHEN key % 10 = 1 THEN NULL WHEN key % 10 <= 3 THEN 2 ELSE 1 END AS eversex",
        "CASE WHEN key % 50 = 0 THEN 97 ELSE CAST(8 + key % 20 AS INT) END AS ag1stsex",
    )


# --- scenario curves and parameters -----------------------------------------------

BASELINE_SCENARIO = "BUILDING"
# Prices are given per 100 of this amount; being a prime it keeps means of prices away
# from decimal ties when results are compared at six digits.
PRICE_UNIT = 299_993
CURVE_KEYS = ["scenario", "gender", "age_group"]


def scenario_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders labelled with scenario (market segment), gender, age group and month.

    A plain equi-join on the customer; should one customer hold a large share of the
    orders, AQE splits that partition of the orders side.
    """
    people = read(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "c_mktsegment AS scenario",
        "CASE WHEN c_nationkey % 2 = 0 THEN 'Women' ELSE 'Men' END AS gender",
        f"floor(date_diff(DATE '1998-01-01', {_BORN}) / 365.25) AS age",
    )
    age_group = F.coalesce(codes.band("age", **codes.REPORT_BANDS), F.lit("50+")).alias("age_group")
    orders = read(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS c_custkey",
        "(year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS month",
        f"o_totalprice * 100 / {PRICE_UNIT} AS price",
    )
    return orders.join(people.select("c_custkey", "scenario", "gender", age_group), "c_custkey")


def scenario_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, 2.5 % and 97.5 % quantile and running mean total of each curve by month.

    Orders and customers are joined once; the counting passes read the joined rows.
    """
    joined = scenario_orders(spark, sf_dir).select(*CURVE_KEYS, "month", "price")
    rows = read_table(spark, write_table(joined, shared_folder(spark)), joined.schema)
    summary = group_summary(rows, [*CURVE_KEYS, "month"], "price", {"inc_lower": 0.025, "inc_upper": 0.975})
    curves = summary.select(*CURVE_KEYS, "month", F.col("mean").alias("inc_mean"), "inc_lower", "inc_upper")
    return running_total(curves, CURVE_KEYS, "month", "inc_mean", "cuminc_mean")


def scenario_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and running mean total of each curve by month; no quantile, so one pass."""
    means = scenario_orders(spark, sf_dir).groupBy(*CURVE_KEYS, "month").agg(F.avg("price").alias("inc_mean"))
    return running_total(means, CURVE_KEYS, "month", "inc_mean", "cuminc_mean")


def parameter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide numeric table; the discount enters as its complement."""
    return read(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", (1 - F.col("l_discount")).alias("l_discount"), "l_tax"
    )


PARAMETERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
