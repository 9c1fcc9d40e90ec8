"""Person-round panel: complete, impute, classify, draw, code events, person-time.

A panel has at most one row per (subject, round); ``one_row_per_round`` gives that
shape and ``duplicate_person_rounds`` reports breaches. A subject's history is then no
longer than the survey has rounds, so windows over one subject stay small whatever the
number of subjects, and all of them share a single hash partitioning by subject.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from roundwise.functions.dates import date_of, years_between
from roundwise.operators.lookups import looked_up

ID = "research_id"
ROUND = "round"

SERIALLY_NEGATIVE = "Serially negative"
ONE_TEST_NEGATIVE = "One test negative"
SERIALLY_POSITIVE = "serially positive"
CONVERTER = "Seroconversion"
NO_TESTING = "No Testing"


def _history(id: str, order: str) -> WindowSpec:
    return Window.partitionBy(id).orderBy(order)


def one_row_per_round(df: DataFrame, id: str, round: str, order: list[str]) -> DataFrame:
    """Keep the first row of each (subject, round) by ``order``.

    Written as an aggregate, so a subject with very many rows is reduced to one row
    per round before anything is shuffled.
    """
    rest = [c for c in df.columns if c not in (id, round, *order)]
    packed = F.min(F.struct(*order, *rest)).alias("_first")
    kept = df.groupBy(id, round).agg(packed)
    return kept.select(*[F.col(c) if c in (id, round) else F.col(f"_first.{c}").alias(c) for c in df.columns])


def duplicate_person_rounds(df: DataFrame, id: str = ID, round: str = ROUND) -> DataFrame:
    """Keys that break the one-row-per-round rule, with their row counts."""
    return df.groupBy(id, round).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def refuse_duplicates(panel: DataFrame, id: str = ID, round: str = ROUND) -> DataFrame:
    """The same rows; fails on two of one subject and round (no shuffle of its own where
    other windows over the subject follow). No column is rewritten, so rows that a join by
    subject and round has put in order are not sorted again for those windows."""
    again = F.lag(round).over(_history(id, round)) == F.col(round)
    alarm = F.raise_error(F.lit("two rows of one subject and round"))
    checked = panel.withColumn("_again", again)
    return checked.where(F.when(F.col("_again"), alarm.cast("boolean")).otherwise(F.lit(True))).drop("_again")


def complete_rounds(visits: DataFrame, id: str = ID, round: str = ROUND) -> DataFrame:
    """Add a row for every round missing between a subject's first and last one.

    Each visit emits itself and the rounds up to the next visit, so no join with a
    generated grid is needed and the partitioning by subject is kept. Two visits of a
    subject in one round are an error; ``one_row_per_round`` reduces them beforehand.
    """
    gap = F.lead(round).over(_history(id, round)) - F.col(round) - 1
    gap = F.when(gap >= 0, gap).when(gap < 0, F.raise_error(F.lit("two rows of one subject and round")).cast("int"))
    steps = F.sequence(F.lit(0), F.greatest(F.coalesce("_gap", F.lit(0)), F.lit(0)))
    spread = visits.withColumn("_gap", gap).select("*", F.explode(steps).alias("_step"))
    columns = []
    for c in visits.columns:
        if c == id:
            columns.append(F.col(c))
        elif c == round:
            columns.append((F.col(c) + F.col("_step")).alias(c))
        else:
            columns.append(F.when(F.col("_step") == 0, F.col(c)).alias(c))
    return spread.select(*columns)


def fill_down(col: str, id: str = ID, order: str = ROUND) -> Column:
    """The value, else the last one before it."""
    w = _history(id, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(col, ignorenulls=True).over(w)


def fill_up(col: str, id: str = ID, order: str = ROUND) -> Column:
    """The value, else the next one after it (one pass, unlike a shrinking frame)."""
    following = F.expr(f"lead(`{col}`) IGNORE NULLS OVER (PARTITION BY `{id}` ORDER BY `{order}`)")
    return F.coalesce(F.col(col), following)


def between(col: str, id: str = ID, order: str = ROUND) -> Column:
    """The value, else the one its neighbours before and after agree on."""
    down, up = fill_down(col, id, order), fill_up(col, id, order)
    return F.when(down == up, down)


def both_ways(col: str, id: str = ID, order: str = ROUND) -> Column:
    """The value, else the last one before it, else the next one after it."""
    return F.coalesce(fill_down(col, id, order), fill_up(col, id, order))


def fill_both(df: DataFrame, cols: list[str], id: str = ID, order: str = ROUND) -> DataFrame:
    """Carry values forward, then backward into what is still missing."""
    return df.withColumns({c: both_ways(c, id, order) for c in cols})


def impute_between(df: DataFrame, col: str, out: str, id: str = ID, order: str = ROUND) -> DataFrame:
    """Fill a gap only where the neighbours before and after it agree."""
    return df.withColumn(out, between(col, id, order))


def round_gaps(df: DataFrame, id: str = ID, round: str = ROUND) -> DataFrame:
    """Rows that follow the previous one of the subject by more than one round."""
    step = F.col(round) - F.lag(round).over(_history(id, round))
    return df.select(id, round, step.alias("round_diff")).where("round_diff > 1")


def mean_day_by_round(visits: DataFrame, round: str = ROUND, day: str = "visit_day") -> DataFrame:
    """Mean visit day of each round and the calendar year it falls in."""
    means = visits.groupBy(round).agg(F.avg(day).alias("mean_day"))
    return means.withColumn("year", F.year(date_of(F.col("mean_day"))))


def fill_visit_day(panel: DataFrame, round_days: DataFrame, round: str = ROUND, day: str = "visit_day") -> DataFrame:
    """Missing visit day <- mean day of the round; missing year follows from it."""
    means = looked_up(round_days, round, ["mean_day"])
    filled = panel.withColumn(day, F.coalesce(day, means[F.col(round)]["mean_day"]))
    return filled.withColumn("year", F.coalesce(F.col("year"), F.year(date_of(F.col(day)))))


# --- subjects ---------------------------------------------------------------------


def _first_last(status: str, round: str) -> dict[str, Column]:
    negative, positive = F.col(status) == 0, F.col(status) == 1
    return {
        "first_neg": F.min(F.when(negative, F.col(round))),
        "last_neg": F.max(F.when(negative, F.col(round))),
        "first_pos": F.min(F.when(positive, F.col(round))),
    }


def subject_class() -> Column:
    """Class label from the first / last rounds; every NULL case is spelled out."""
    no_neg, no_pos = F.col("first_neg").isNull(), F.col("first_pos").isNull()
    return (
        F.when(no_neg & no_pos, NO_TESTING)
        .when(no_neg, SERIALLY_POSITIVE)
        .when(~no_pos, CONVERTER)
        .when(F.col("first_neg") != F.col("last_neg"), SERIALLY_NEGATIVE)
        .otherwise(ONE_TEST_NEGATIVE)
    )


def classify_subjects(panel: DataFrame, id: str = ID, round: str = ROUND, status: str = "hivstatus_imputed") -> DataFrame:
    """One row per subject: first / last negative, first positive, class."""
    bounds = [c.alias(n) for n, c in _first_last(status, round).items()]
    return panel.groupBy(id).agg(*bounds).withColumn("cohortclass", subject_class())


def has_bad_bounds() -> Column:
    """Converter whose first positive round does not come after the last negative."""
    both = F.col("first_neg").isNotNull() & F.col("first_pos").isNotNull()
    return both & (F.col("first_pos") <= F.col("last_neg"))


def bad_bounds(subjects: DataFrame, id: str = ID) -> DataFrame:
    return subjects.where(has_bad_bounds()).select(id, "last_neg", "first_pos")


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop the columns whose name matches a regular expression."""
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def drawn_round(id: str, seed: int) -> Column:
    """Round drawn uniformly from (last_neg, first_pos] by a hash of subject and seed.

    The draw depends on nothing but its inputs, so it survives retries and any
    partitioning; NULL where the bounds leave no round.
    """
    digest = F.md5(F.concat_ws("|", F.col(id).cast("string"), F.lit(str(seed))))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    width = F.col("first_pos") - F.col("last_neg")
    offset = F.pmod(number, F.when(width > 0, width).cast("bigint")).cast("int")
    return F.col("last_neg") + 1 + offset


def draw_event_round(subjects: DataFrame, seed: int, id: str = ID) -> DataFrame:
    """Add ``seroconv_imp`` to usable converters; subjects with bad bounds are left out."""
    usable = drop_matching(subjects, "^seroconv").where(~has_bad_bounds())
    return usable.withColumn("seroconv_imp", F.when(F.col("cohortclass") == CONVERTER, drawn_round(id, seed)))


def subject_bounds_over(id: str = ID, round: str = ROUND, status: str = "hivstatus_imputed") -> dict[str, Column]:
    """First / last rounds of a subject as window columns, for use on the panel itself."""
    whole = _history(id, round).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return {name: column.over(whole) for name, column in _first_last(status, round).items()}


def label_subjects(panel: DataFrame, seed: int, id: str = ID) -> DataFrame:
    """Class and drawn round on every row, from the bounds on it, without a join.

    Subjects with bad bounds stay in the panel with NULL in all of these columns.
    """
    good = ~has_bad_bounds()
    named = panel.withColumns({"cohortclass": F.when(good, subject_class()), "_draw": F.when(good, drawn_round(id, seed))})
    kept = {c: F.when(good, F.col(c)) for c in ("first_neg", "last_neg", "first_pos")}
    return named.withColumns({"seroconv_imp": F.when(F.col("cohortclass") == CONVERTER, F.col("_draw")), **kept}).drop("_draw")


def annotate_subjects(panel: DataFrame, seed: int, id: str = ID, round: str = ROUND, status: str = "hivstatus_imputed") -> DataFrame:
    """Bounds, class and drawn round of the subject on every row of the panel."""
    return label_subjects(panel.withColumns(subject_bounds_over(id, round, status)), seed, id)


def code_events(panel: DataFrame, round: str = ROUND, status: str = "hivstatus_imputed") -> DataFrame:
    """Event flag: status of the serially negative; 0 before, 1 at, NULL after a draw."""
    converter = F.col("cohortclass") == CONVERTER
    flag = (
        F.when(F.col("cohortclass") == SERIALLY_NEGATIVE, F.col(status))
        .when(converter & (F.col(round) == F.col("seroconv_imp")), 1)
        .when(converter & (F.col(round) < F.col("seroconv_imp")), 0)
    )
    return panel.withColumn("hivinc", flag.cast("int"))


def person_time(panel: DataFrame, id: str = ID, round: str = ROUND, day: str = "visit_day") -> DataFrame:
    """Years since the subject's previous visit, on rows with an event flag.

    Previous means by date, then round: a mean date can put rounds out of order.
    """
    w = Window.partitionBy(id).orderBy(F.col(day).asc_nulls_last(), F.col(round))
    years = years_between(F.col(day), F.lag(day).over(w))
    return panel.withColumn("py", F.when(F.col("hivinc").isin(0, 1), years))


def events_without_person_time(panel: DataFrame, id: str = ID, round: str = ROUND) -> DataFrame:
    """All rows of the subjects that have an event on a row without person-time.

    Marked by a window over the subject, so a panel hashed by subject is read once and
    not joined with itself.
    """
    whole = _history(id, round).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lacking = (F.col("hivinc") == 1) & F.col("py").isNull()
    marked = panel.withColumn("_lacking", F.max(F.coalesce(lacking, F.lit(False))).over(whole))
    return marked.where("_lacking").drop("_lacking")


def clean_absorbing_flag(df: DataFrame, col: str, out: str, id: str = ID, order: str = ROUND) -> DataFrame:
    """Gap-safe fill of a flag that cannot go back to 0.

    A subject seen going 1 -> 0 loses all values. Adds ``out`` (filled) and
    ``{out}_lag``, ``{out}_fix`` (filled, unreliable subjects NULL).
    """
    filled = impute_between(df, col, out, id, order)
    lagged = filled.withColumn(f"{out}_lag", previous(out, id, order))
    return lagged.withColumn(f"{out}_fix", unless_reverted(out, id, order))


def previous(col: str, id: str = ID, order: str = ROUND) -> Column:
    return F.lag(col).over(_history(id, order))


def unless_reverted(col: str, id: str = ID, order: str = ROUND) -> Column:
    """The filled flag, NULL for subjects whose flag went from 1 (``{col}_lag``) to 0."""
    backward = F.when((F.col(f"{col}_lag") == 1) & (F.col(col) == 0), 1).otherwise(0)
    whole = _history(id, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.when(F.max(backward).over(whole) == 0, F.col(col))
