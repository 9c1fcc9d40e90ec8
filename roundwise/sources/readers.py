"""Readers with explicit schemas; NULL is written ``NA`` in CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}


def _schema(spec: str) -> T.StructType:
    """Schema from ``name type, name type``; needs no running session."""
    fields = (field.split() for field in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


# Survey inputs, one row per (study_id, round).
ELIGIBILITY = _schema("study_id string, round string, sex string, ageyrs int, birthdate string, resident int, mobility int")
STATUS_VISITS = _schema("study_id string, round string, finalhiv string, intdate string")
QUESTIONNAIRE = _schema(
    "study_id string, round string, arvmed int, cuarvmed int, circum int, eversex int, ag1stsex int"
)

# Published result tables. The one with both models prints sex and year under each
# other's name; it is read by position with the names put right.
RATES_BY_BAND = _schema(
    "round int, year int, sex string, age string, person_years int, events int, rate double, lb double, ub double"
)
RATES_BOTH_MODELS = _schema(
    "sex string, year int, age string, model string, events int, person_years int, rate double, lb double, ub double"
)
RATES_FIVE_YEAR = _schema(
    "round int, year int, sex string, model string, agecat string, rate double, lb double, ub double, py double, events int"
)
PREVALENCE_BY_SEX = _schema(
    "year string, sex string, n int, positives int, prevalence double, se double, lb double, ub double"
)
PREVALENCE_BY_BAND = _schema(
    "model string, sex string, round int, year int, agecat string, prevalence double, lb double, ub double, ratio double"
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Survey table or handed-over panel in Parquet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header line; columns are taken by position under the schema's names."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", "NA")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_collection(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Named result tables, one Parquet folder each."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
