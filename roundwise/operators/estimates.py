"""Counts, crude rates and proportions by stratum."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from roundwise.functions import codes
from roundwise.functions.dates import year_of
from roundwise.functions.intervals import interval_text, poisson_limits, wald
from roundwise.operators.panel import ID


def subjects_by(df: DataFrame, strata: list[str], id: str = ID, name: str = "n_subjects") -> DataFrame:
    """Distinct subjects per stratum; a missing subject id does not count."""
    return df.groupBy(*strata).agg(F.count_distinct(id).alias(name))


def rounds_per_subject(df: DataFrame, id: str = ID) -> DataFrame:
    """Mean number of rows per subject, with the number of subjects."""
    per_subject = df.groupBy(id).agg(F.count(F.lit(1)).alias("n_rounds"))
    return per_subject.agg(F.count(F.lit(1)).alias("n_subjects"), F.avg("n_rounds").alias("mean_rounds"))


def status_changes(panel: DataFrame, id: str = ID, order: str = "round", status: str = "hivstatus_imputed") -> DataFrame:
    """By round: rows, rows whose status differs from the subject's row before, and years
    since the subject's first row, summed."""
    own = Window.partitionBy(id).orderBy(order)
    before, first = F.lag(status).over(own), F.first(order).over(own)
    marked = panel.select(order, (F.col(status) != before).alias("changed"), (F.col(order) - first).alias("since"))
    return marked.groupBy(order).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("changed").alias("n_changes"), F.sum("since").alias("rounds_since_first"))


def cohort_flow(df: DataFrame, stages: Mapping[str, Column], id: str = ID) -> DataFrame:
    """Rows and subjects that satisfy each stage's condition.

    Everything is counted per subject first, so the number of stages adds no shuffle.
    """
    per_subject = df.groupBy(id).agg(*[F.count_if(cond).alias(name) for name, cond in stages.items()])
    pieces = [
        F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("stage"), F.sum(name).alias("n_rows"), F.count_if(F.col(name) > 0).alias("n_subjects"))
        for i, name in enumerate(stages)
    ]
    return per_subject.agg(F.array(*pieces).alias("s")).select(F.inline("s"))


def observed_flow(df: DataFrame, stages: Mapping[str, Column], id: str = ID, order: str = "round") -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and an observation that is filled with ``cohort_flow``'s counts
    while somebody else's action runs over it.

    A subject is counted where it first satisfies a stage; that takes a window over the
    subject, which shares the partitioning of a panel's other windows, and no distinct. Put
    it last before a write: metrics of the last stage are counted once per partition.
    """
    so_far = Window.partitionBy(id).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumns({f"_in{i}": F.coalesce(cond, F.lit(False)) for i, cond in enumerate(stages.values())})
    marked = marked.withColumns({f"_first{i}": F.col(f"_in{i}") & F.col(id).isNotNull() & (F.count_if(f"_in{i}").over(so_far) == 1) for i in range(len(stages))})
    counts = Observation()
    metrics = [m for i in range(len(stages)) for m in (F.count_if(f"_in{i}").alias(f"rows{i}"), F.count_if(f"_first{i}").alias(f"subjects{i}"))]
    return marked.observe(counts, *metrics).select(*df.columns), counts


def flow_table(like: DataFrame, stages: Mapping[str, Column], counts: Observation) -> DataFrame:
    """The counts of an observation, once its action has run, in the form of ``cohort_flow``."""
    got = counts.get
    rows = [(i + 1, name, got[f"rows{i}"], got[f"subjects{i}"]) for i, name in enumerate(stages)]
    return like.sparkSession.createDataFrame(rows, "step int, stage string, n_rows long, n_subjects long")


def number_subjects(df: DataFrame, id: str = ID, out: str = "number") -> DataFrame:
    """A whole number for each subject; numbers are dense within a partition, so bitmaps of
    them are well filled. They differ between runs: write the table before it is joined."""
    return df.where(F.col(id).isNotNull()).select(id).distinct().withColumn(out, F.monotonically_increasing_id())


def subjects_rollup(numbered: DataFrame, levels: Sequence[Sequence[str]], number: str = "number", name: str = "n_subjects") -> DataFrame:
    """Exact distinct subjects at many levels in one pass: ``level`` (grouping id), the strata
    of all levels, and the count.

    The rows are reduced once, by the finest strata, to bitmaps of subject numbers (4 KB for
    32,768 subjects); coarser levels merge those. Bitmaps are merged before they are shuffled
    and no level counts rows again. Rows without a number count for no subject.
    """
    strata = list(dict.fromkeys(c for level in levels for c in level))
    finest = numbered.groupBy(*strata, F.bitmap_bucket_number(number).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"))
    sets = [[*level, "_bucket"] for level in levels]
    merged = finest.groupingSets(sets, *strata, "_bucket").agg(F.grouping_id().alias("_level"), F.bitmap_or_agg("_bits").alias("_bits"))
    # the bucket is always grouped: its bit is the lowest one and zero
    counted = merged.groupBy("_level", *strata).agg(F.sum(F.bitmap_count("_bits")).alias(name))
    return counted.select(F.shiftright("_level", 1).cast("long").alias("level"), *strata, name)


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "n_missing")


# --- cells -------------------------------------------------------------------------


def cell_table(df: DataFrame) -> DataFrame:
    """Sums per sex, round, year and age that rates, trends and counts roll up from.

    Bounded by sexes x rounds x years x ages however many subjects there are, so it is
    kept (and recomputed if an executor is lost) while several tables are built on it.
    ``fit_*`` leaves out rows without positive person-time, which no model can use.
    """
    timed, fit = F.col("py").isNotNull(), F.col("py") > 0
    status = F.col("hivstatus_imputed")
    cells = df.groupBy("sex", "round", "year", "ageyrs2", "agecat", "agecat3").agg(
        F.sum("visit_day").alias("day_sum"),
        F.count("visit_day").alias("day_n"),
        F.sum("py").alias("pysum"),
        F.sum(F.when(timed, F.col("hivinc"))).alias("events"),
        F.sum(F.when(fit, F.col("py"))).alias("fit_py"),
        F.sum(F.when(fit, F.col("hivinc"))).alias("fit_events"),
        F.count(status).alias("n_status"),
        F.count_if(status == 1).alias("n_positive"),
    )
    return cells.persist()


def cell_person_time(cells: DataFrame, strata: list[str], known: bool = False) -> DataFrame:
    """Crude events and person-years per stratum; ``known`` drops missing strata."""
    timed = cells.where(F.col("pysum").isNotNull())
    return (timed.dropna(subset=strata) if known else timed).groupBy(*strata).agg(F.sum("pysum").alias("pysum"), F.sum("events").alias("events"))


def cell_fit_time(cells: DataFrame, strata: list[str]) -> DataFrame:
    """Events and person-years for fitting, strata known."""
    usable = cells.where(F.col("fit_py").isNotNull()).dropna(subset=strata)
    return usable.groupBy(*strata).agg(F.sum("fit_py").alias("pysum"), F.sum("fit_events").alias("events"))


def cell_status(cells: DataFrame, strata: list[str]) -> DataFrame:
    """Known and positive statuses per stratum, strata known."""
    usable = cells.where(F.col("n_status") > 0).dropna(subset=strata)
    return usable.groupBy(*strata).agg(F.sum("n_status").alias("n"), F.sum("n_positive").alias("positives"))


def cell_years(cells: DataFrame) -> DataFrame:
    """Calendar year of each round's mean visit day."""
    means = cells.groupBy("round").agg((F.sum("day_sum") / F.sum("day_n")).alias("mean_day"))
    return means.select("round", year_of(F.col("mean_day")).alias("Year"))


# --- person-time and rates --------------------------------------------------------


def crude_person_time(df: DataFrame, strata: list[str]) -> DataFrame:
    """Events and person-years per stratum over rows that have person-time."""
    with_time = df.where(F.col("py").isNotNull())
    return with_time.groupBy(*strata).agg(F.sum("py").alias("pysum"), F.sum("hivinc").alias("events"))


def crude_rate(df: DataFrame, strata: list[str]) -> DataFrame:
    """Events per 100 person-years."""
    return crude_person_time(df, strata).withColumn("rate", F.try_divide(100 * F.col("events"), F.col("pysum")))


def with_exact_limits(cells: DataFrame, events: str = "events", py: str = "pysum") -> DataFrame:
    """Rate per 100 person-years with exact Poisson limits; one Python row per stratum."""
    limits = cells.withColumn("_limits", poisson_limits(F.col(events)))
    return limits.withColumns(
        {
            "rate": F.try_divide(100 * F.col(events), F.col(py)),
            "lower_95": F.try_divide(100 * F.col("_limits.lower"), F.col(py)),
            "upper_95": F.try_divide(100 * F.col("_limits.upper"), F.col(py)),
        }
    ).drop("_limits")


def rate_table(df: DataFrame, sex: str = "sex", band: str = "age_band") -> DataFrame:
    """Report table at three levels: overall, by sex, by sex and age band.

    The panel is reduced to its finest cells once; the levels are grouping sets of
    those few cells.
    """
    usable = df.where(codes.is_in(F.col("hivinc"), 0, 1) & F.col("py").isNotNull())
    cells = usable.groupBy(sex, band).agg(F.sum("py").alias("py"), F.sum("hivinc").alias("hivinc"))
    levels = cells.groupingSets([[], [sex], [sex, band]], sex, band).agg(
        F.grouping_id().alias("level"), F.sum("py").alias("pysum"), F.sum("hivinc").alias("events")
    )
    levels = levels.where((F.col("level") != 0) | F.col(band).isNotNull())
    table = with_exact_limits(levels)
    return table.select(
        F.when(F.col("level") == 3, "Overall").when(F.col("level") == 1, "Sex").otherwise("Sex × Age").alias("group"),
        F.when(F.col("level") == 1, F.col(sex)).when(F.col("level") == 0, F.concat_ws(" / ", sex, band)).alias("subgroup"),
        F.col("pysum").alias("person_years"),
        F.col("events").alias("cases"),
        F.col("rate").alias("inc_per_100py"),
        "lower_95",
        "upper_95",
        interval_text(F.col("rate"), F.col("lower_95"), F.col("upper_95")).alias("inc_95ci"),
    )


def in_listed_order(column: str, order: Sequence[str]) -> Column:
    """Sort key: position in a list of labels."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))


# --- proportions ------------------------------------------------------------------


def _flag_counts(flag: str, null_policy: str) -> tuple[Column, Column]:
    one = F.col(flag) == 1
    if null_policy == "ignore":
        return F.count(flag), F.count_if(one)
    if null_policy == "count":
        return F.count(F.lit(1)), F.count_if(one | F.col(flag).isNull())
    raise ValueError(f"unknown null policy {null_policy!r}")


def proportion_table(df: DataFrame, flag: str, strata: list[str], null_policy: str = "ignore") -> DataFrame:
    """Proportion of a 0/1 flag with Wald interval.

    ``null_policy="count"`` takes a missing flag as a one and every row into the
    denominator, as some published tables do.
    """
    n, positives = _flag_counts(flag, null_policy)
    return with_wald(df.groupBy(*strata).agg(n.alias("n"), positives.alias("positives")))


def proportion_tables(df: DataFrame, flags: Mapping[str, tuple[str, str]], strata: list[str], tag: str) -> DataFrame:
    """Several proportions over the same strata in one pass, stacked under a tag.

    ``flags`` maps each tag value to (flag column, null policy).
    """
    pieces = []
    for name, (flag, policy) in flags.items():
        n, positives = _flag_counts(flag, policy)
        pieces.append(F.struct(F.lit(name).alias(tag), n.alias("n"), positives.alias("positives")))
    return with_wald(df.groupBy(*strata).agg(F.array(*pieces).alias("_p")).select(*strata, F.inline("_p")))


def with_wald(cells: DataFrame) -> DataFrame:
    p = cells.withColumn("prop", F.try_divide(F.col("positives"), F.col("n")))
    se, low, high = wald(F.col("prop"), F.col("n"))
    return p.withColumns({"se": se, "lb": low, "ub": high})


def keep_empty_bands(cells: DataFrame, band: str, levels: Sequence[str], counts: list[str]) -> DataFrame:
    """Add one zero row for every listed band without any row, other keys NULL; rows of
    other bands and rows without a band stay."""
    every = cells.sparkSession.createDataFrame([(v,) for v in levels], f"{band} string")
    return every.join(cells, band, "full").fillna(0, counts)


# --- contingency tables -----------------------------------------------------------


def contingency(df: DataFrame, columns: list[str], levels: Mapping[str, Sequence] | None = None, keep_missing: bool = False) -> DataFrame:
    """Counts of value combinations.

    Rows with a missing value are dropped unless ``keep_missing``. With ``levels`` for
    every column, combinations that never occur get a zero; the levels listed (maybe
    none) are completed by those that occur.
    """
    data = df if keep_missing else df.dropna(subset=columns)
    counts = data.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    if not levels:
        return counts
    grid = level_grid(counts, {c: levels[c] for c in columns})
    same = [grid[c].eqNullSafe(counts[c]) for c in columns]
    return grid.join(counts, same, "left").select(*[grid[c] for c in columns], F.coalesce("n", F.lit(0)).alias("n"))


@dataclass(frozen=True)
class Table:
    """A contingency table: its columns, the rows it counts, whether missing values are kept
    as a level, levels to be completed by zeros (every column, maybe none listed), and the
    column within which shares are wanted."""

    columns: Sequence[str]
    only: Column | None = None
    keep_missing: bool = False
    levels: Mapping[str, Sequence] | None = None
    share_of: str | None = None


def count_tables(df: DataFrame, tables: Mapping[str, Table]) -> DataFrame:
    """The counts of all tables from one pass: rows are reduced to cells of all columns
    together, and the tables are grouping sets of those cells. Cut (write) the result before
    ``finished_tables``, which uses it several times."""
    columns = list(dict.fromkeys(c for t in tables.values() for c in t.columns))
    counts = [(F.count(F.lit(1)) if t.only is None else F.count_if(t.only)).alias(f"_n{i}") for i, t in enumerate(tables.values())]
    cells = df.groupBy(*columns).agg(*counts)
    sets = list(dict.fromkeys(tuple(c for c in columns if c in t.columns) for t in tables.values()))
    return cells.groupingSets([list(s) for s in sets], *columns).agg(F.grouping_id().alias("_set"), *[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(tables))])


def finished_tables(counted: DataFrame, tables: Mapping[str, Table]) -> DataFrame:
    """The tables of ``count_tables`` in long form: table_name, all columns, n, share."""
    columns = [c for c in counted.columns if not c.startswith("_")]
    stacked = None
    for i, (name, t) in enumerate(tables.items()):
        place = sum(1 << (len(columns) - 1 - j) for j, c in enumerate(columns) if c not in t.columns)
        own = counted.where((F.col("_set") == place) & (F.col(f"_n{i}") > 0)).select(*t.columns, F.col(f"_n{i}").alias("n"))
        own = own if t.keep_missing else own.dropna(subset=list(t.columns))
        if t.levels is not None:
            grid = level_grid(own, {c: t.levels.get(c, []) for c in t.columns})
            own = grid.join(own, list(t.columns), "left").fillna(0, ["n"])
        total = F.sum("n").over(Window.partitionBy(t.share_of)) if t.share_of else F.lit(None).cast("double")
        own = own.select(F.lit(name).alias("table_name"), *t.columns, "n", F.try_divide(F.col("n"), total).alias("share"))
        stacked = own if stacked is None else stacked.unionByName(own, allowMissingColumns=True)
    return stacked.select("table_name", *columns, "n", "share")


def level_grid(counts: DataFrame, levels: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of the levels listed or found in a table of counts, generated
    column by column from one row of level sets."""
    kinds = dict(counts.dtypes)
    found = counts.agg(*[F.collect_set(name).alias(f"_{name}") for name in levels])
    for name, values in levels.items():
        listed = F.array(*[F.lit(v) for v in values]).cast(f"array<{kinds[name]}>")
        found = found.select("*", F.explode(F.array_union(listed, f"_{name}")).alias(name))
    return found.select(*levels)


def column_proportions(df: DataFrame, row: str, column: str) -> DataFrame:
    """Share of each row value within its column; totals are taken over the counts."""
    counts = contingency(df, [row, column])
    total = F.sum("n").over(Window.partitionBy(column))
    return counts.withColumn("share", F.col("n") / total)


def level_counts(df: DataFrame, row: str, column: str, id: str = ID, missing: str = "missing", out: str = "counts") -> DataFrame:
    """Distinct subjects per row value, as a map from every level of ``column`` that occurs
    to its count; a missing level is named. Lazy; ``spread_levels`` makes columns of it."""
    levels = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(missing)))
    counts = subjects_by(levels, [row, column], id).where("n_subjects > 0")
    return counts.groupBy(row).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n_subjects")))).alias(out))


def spread_levels(counts: DataFrame, column: str = "counts", most: int = 1000) -> DataFrame:
    """A column for every key that occurs in a map column, in order of the keys; other rows
    hold NULL there. Looks the keys up at once, so give it a finished table; more than
    ``most`` keys are refused, as a report has no such columns."""
    found = [r["k"] for r in counts.select(F.explode(F.map_keys(column)).alias("k")).distinct().orderBy("k").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} levels")
    rest = [c for c in counts.columns if c != column]
    return counts.select(*rest, *[F.col(column)[k].alias(k) for k in found])


def effective_counts(cells: DataFrame) -> DataFrame:
    """Rows with a known status by sex, year and band, zero-filled.

    Starts from ``cell_table``. Years run from the first to the last one with a known
    status; both sexes and all five-year bands are there, and every other sex or band that
    occurs. Labels read Female / Male. Rows without sex or band belong to no line.
    """
    known = cells.where((F.col("n_status") > 0) & F.col("year").isNotNull())
    counts = known.groupBy("sex", "year", "agecat").agg(F.sum("n_status").alias("_n"))
    years = counts.agg(F.sequence(F.min("year"), F.max("year")).alias("_y"), *[F.collect_set(c).alias(f"_{c}") for c in ("sex", "agecat")])
    listed = {"sex": ["F", "M"], "agecat": codes.band_labels(**codes.FIVE_YEAR_BANDS)}
    grid = years.select("*", F.explode("_y").alias("year"))
    for name, values in listed.items():
        grid = grid.select("*", F.explode(F.array_union(F.array(*[F.lit(v) for v in values]), f"_{name}")).alias(name))
    filled = grid.select("year", "sex", "agecat").join(counts, ["sex", "year", "agecat"], "left")
    return filled.select(
        F.col("year").alias("Year"),
        F.col("agecat").alias("AgeBin"),
        F.coalesce("_n", F.lit(0)).alias("effective_count"),
        codes.recode("sex", codes.SEX_LONG).alias("Gender"),
    )
