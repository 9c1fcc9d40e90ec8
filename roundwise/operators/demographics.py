"""Cleaning of the raw survey tables and the demographic columns of the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundwise.functions import codes, dates
from roundwise.operators import panel as P


def clean_status_visits(raw: DataFrame, first_year: int) -> DataFrame:
    """Numeric round, 0/1 status and visit day; dates before the study are dropped."""
    day = dates.parse_day(F.col("intdate"))
    early = dates.year_of(day) < first_year
    return raw.select(
        F.col("study_id").alias(P.ID),
        codes.digits(F.col("round")).alias(P.ROUND),
        "finalhiv",
        codes.recode("finalhiv", codes.STATUS_CODES, keep_other=False).alias("hivstatus"),
        F.when(~early, day).alias("visit_day"),
        F.when(~early, dates.year_of(day)).alias("year"),
    )


def clean_eligibility(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("study_id").alias(P.ID),
        codes.digits(F.col("round")).alias(P.ROUND),
        "sex",
        "ageyrs",
        dates.parse_day(F.col("birthdate"), "dd/MM/yyyy").alias("birth_day"),
        "resident",
        "mobility",
    )


def clean_questionnaire(raw: DataFrame) -> DataFrame:
    """Coded answers as 0/1 flags beside the raw codes."""
    return raw.select(
        F.col("study_id").alias(P.ID),
        codes.digits(F.col("round")).alias(P.ROUND),
        "arvmed",
        "cuarvmed",
        codes.recode("circum", codes.CIRCUMCISION_CODES, keep_other=False).alias("circ"),
        codes.recode("eversex", codes.EVER_SEX_CODES, keep_other=False).alias("eversex_clean"),
        "ag1stsex",
        codes.within(F.col("ag1stsex"), 10, 96).alias("ag1stsex_clean"),
        F.when(F.col("arvmed") == 1, 1).otherwise(0).alias("onART"),
    )


def join_demographics(panel: DataFrame, eligibility: DataFrame, questionnaire: DataFrame) -> DataFrame:
    """Left-join both tables by (subject, round).

    Rows that found no questionnaire count as not on treatment. A subject with two rows
    in a round of either table is an error.
    """
    keys = [P.ID, P.ROUND]
    joined = panel.join(eligibility, keys, "left").join(questionnaire, keys, "left")
    joined = P.refuse_duplicates(joined)
    return joined.withColumns({"onART": F.coalesce("onART", F.lit(0)), "resident_imputed": F.col("resident")})


def demographic_fills() -> dict[str, Column]:
    """Window columns that fill the joined answers over a subject's rounds."""
    filled = {c: P.both_ways(c) for c in ("sex", "birth_day", "resident_imputed")}
    return {
        "circ_imputed": P.between("circ"),
        "eversex_clean_imputed": P.between("eversex_clean"),
        **filled,
    }


def age_column() -> Column:
    return dates.age_at(F.col("visit_day"), F.col("birth_day"), F.col("ageyrs"))


def attach_demographics(panel: DataFrame, eligibility: DataFrame, questionnaire: DataFrame) -> DataFrame:
    """Join both tables, clean and fill the flags, compute age.

    No age filter here: person-time must be computed on all rows first.
    """
    joined = join_demographics(panel, eligibility, questionnaire).withColumns(demographic_fills())
    lagged = joined.withColumn("circ_imputed_lag", P.previous("circ_imputed"))
    return lagged.withColumns({"circ_imputed_fix": P.unless_reverted("circ_imputed"), "ageyrs2": age_column()})


def add_bands(panel: DataFrame, age: str = "ageyrs2") -> DataFrame:
    """The three age bandings and the level code of the five-year one."""
    five_year = codes.FIVE_YEAR_BANDS
    codes_of_bands = {**five_year, "labels": range(1, len(five_year["edges"]))}
    return panel.withColumns(
        {
            "agecat": codes.band(age, **five_year),
            "agecat3": codes.band(age, **codes.MODEL_BANDS),
            "age_band": codes.band(age, **codes.REPORT_BANDS),
            "agecat_num": codes.band(age, **codes_of_bands),
        }
    )
