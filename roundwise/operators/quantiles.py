"""Exact quantiles and histograms for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundwise.operators.lookups import looked_up

OCTAVE_BUCKETS = 1024
BINS = 1 << 15
NARROWINGS = 3
MARK_WORDS = 1 << 12
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def group_summary(df: DataFrame, keys: list[str], value: str, quantiles: Mapping[str, float], merged: bool = False) -> DataFrame:
    """Per group: counts, mean, minimum, maximum and exact named quantiles.

    Quantiles are linearly interpolated order statistics (type 7), found by counting. A
    first pass counts rows per group and bucket of the value's magnitude, and a second
    reads the rows within the buckets that hold a wanted order statistic, equal values
    merged before the shuffle. Those are narrowed ``NARROWINGS`` times to one of ``BINS``
    equal bins. A bucket spans less than 2^43 neighbouring doubles, so the bins of the last
    narrowing hold one value each. No group is gathered or sorted; what is sorted in one
    task are the ``BINS`` bins of one bucket, or the buckets that one group occupies.

    The plan is lazy and reads its source twice. The second pass knows the wanted buckets
    by a bit table of fixed size (``MARK_WORDS`` numbers), whatever the number of groups:
    with few groups next to nothing is shuffled, with very many all distinct values are.
    The joins carry no hint, Spark picks them by the measured size of their sides and
    splits hot buckets.
    With ``merged`` equal values are merged first, by one shuffle that both passes reuse:
    right where values repeat much or the source is dear to compute.
    NaN counts as larger than any number, as it sorts in Spark.
    """
    names = keys or ["_all"]
    data = df.select(*(keys or [F.lit(1).alias("_all")]), F.col(value).cast("double").alias("_v"), F.lit(1).cast("long").alias("_c"))
    if merged:
        data = data.groupBy(*names, "_v").agg(F.sum("_c").alias("_c"))
    given = F.col("_v").isNotNull()
    parts = data.groupBy(*names, _magnitude(F.col("_v")).alias("_code")).agg(
        F.sum(F.when(given, F.col("_c")).otherwise(0)).alias("_c"),
        F.sum(F.when(given, 0).otherwise(F.col("_c"))).alias("_nulls"),
        F.sum(F.col("_v") * F.col("_c")).alias("_sum"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
    )
    # true of every part; it names all columns, so that none is pruned for one user only
    # and all users share one shuffle
    parts = parts.where("(_c > 0 or _nulls > 0) and (_sum is null) = (_low is null) and (_low is null) = (_high is null)")
    stats = parts.groupBy(*names).agg(
        F.sum("_c").alias("n"),
        F.sum("_nulls").alias("n_missing"),
        F.try_divide(F.sum("_sum"), F.sum("_c")).alias("mean"),
        F.min("_low").alias("minimum"),
        F.max("_high").alias("maximum"),
    )
    known = parts.where("_nulls = 0")
    known = known.withColumn("_n", F.sum("_c").over(Window.partitionBy(*names)))
    held = _holding(known.withColumn("_targets", _wanted(F.col("_n"), list(quantiles.values()))), names).withColumn("_bucket", F.col("_code"))
    values = _within_marked(data.withColumn("_bucket", _magnitude(F.col("_v"))), held, [*names, "_bucket"])
    values = values.groupBy(*names, "_bucket", "_v").agg(F.sum("_c").alias("_c"))
    for _ in range(NARROWINGS):
        held = _holding(_narrowed(values, held, [*names, "_bucket"]), [*names, "_bucket", "_within"])
    position = [(F.col("_n") - 1) * F.lit(float(p)) for p in quantiles.values()]
    found = held.select(*names, "_n", F.col("_low").alias("_v"), F.explode("_targets").alias("_t"))
    picked = [F.max(F.when(F.col("_t.i") == i, F.col("_v"))) for i in range(2 * len(quantiles))]
    wide = found.groupBy(*[F.col(k).alias(f"_k_{k}") for k in names], "_n").agg(*[c.alias(f"_p{i}") for i, c in enumerate(picked)])
    between = [
        F.when(F.col(f"_p{2 * j}") == F.col(f"_p{2 * j + 1}"), F.col(f"_p{2 * j}"))
        .otherwise(F.col(f"_p{2 * j}") + (F.col(f"_p{2 * j + 1}") - F.col(f"_p{2 * j}")) * (position[j] - F.floor(position[j])))
        .alias(name)
        for j, name in enumerate(quantiles)
    ]
    joined = stats.join(wide, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in names], "left")
    return joined.select(*keys, "n", "n_missing", "mean", "minimum", "maximum", *between)


def _within_marked(data: DataFrame, held: DataFrame, names: list[str]) -> DataFrame:
    """The rows whose key has the hash of a held bucket: all rows of these, few others."""
    slot = F.pmod(F.xxhash64(*names), F.lit(64 * MARK_WORDS))
    word, bit = F.floor(slot / 64), (slot % 64).cast("int")
    marks = held.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    blank = held.sparkSession.range(MARK_WORDS).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = marks.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])).scalar()
    marked = F.call_function("shiftrightunsigned", F.get(table, word.cast("int")), bit).bitwiseAND(F.lit(1).cast("long"))
    # times the count, so that the filter stays behind a merge that both passes share
    return data.where(marked * F.col("_c") > 0)


def _magnitude(v: Column) -> Column:
    """A whole number that never falls as ``v`` grows: 1024 steps between powers of two."""
    size = F.floor((F.log2(F.abs(v)) + 1075) * OCTAVE_BUCKETS)
    top = F.lit((1025 + 1075) * OCTAVE_BUCKETS).cast("long")
    signed = F.when(v == 0, F.lit(0).cast("long")).when(F.abs(v) == float("inf"), F.signum(v).cast("long") * top).otherwise(F.signum(v).cast("long") * size)
    return F.when(F.isnan(v), top + 1).otherwise(F.when(v.isNotNull(), signed))


def _wanted(n: Column, probs: list[float]) -> Column:
    """The order statistics on both sides of each quantile, as (place in the list, rank)."""
    ranks = []
    for j, p in enumerate(probs):
        below = F.floor((n - 1) * F.lit(float(p))).cast("long")
        ranks += [(2 * j, below), (2 * j + 1, F.least(below + 1, n - 1))]
    return F.array(*[F.struct(F.lit(i).alias("i"), k.alias("k")) for i, k in ranks])


def _holding(counted: DataFrame, within: list[str]) -> DataFrame:
    """The counted buckets that hold a target, with ranks from the bucket's start.

    ``counted`` has one row per bucket: its place ``_code``, count ``_c`` and the
    ``_targets`` of all buckets ``within`` which ranks are counted.
    """
    w = Window.partitionBy(*within).orderBy("_code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("_upto", F.sum("_c").over(w))
    start = F.col("_upto") - F.col("_c")
    here = F.filter("_targets", lambda t: (t["k"] >= start) & (t["k"] < F.col("_upto")))
    moved = F.transform(here, lambda t: F.struct(t["i"].alias("i"), (t["k"] - start).alias("k")))
    names = [k for k in within if k != "_within"]
    return upto.select(*names, "_n", "_code", "_low", "_high", moved.alias("_targets")).where(F.size("_targets") > 0)


def _narrowed(values: DataFrame, held: DataFrame, names: list[str]) -> DataFrame:
    """Counts of the rows inside the held ranges, each cut into equal bins."""
    side = held.select(*[F.col(k).alias(f"_k_{k}") for k in names], "_n", F.col("_low").alias("_within"), F.col("_high").alias("_to"), "_targets")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in names]
    # conditions that let no filter on the value be inferred: all joins share one shuffle
    inside = values.join(side, [*same, F.coalesce((F.col("_v") >= F.col("_within")) & (F.col("_v") <= F.col("_to")), F.lit(False))])
    part = F.try_divide(F.col("_v") - F.col("_within"), F.col("_to") - F.col("_within"))
    code = F.when(F.col("_within") == F.col("_to"), F.lit(0).cast("long")).otherwise(F.floor(part * BINS))
    return inside.groupBy(*names, "_within", code.alias("_code")).agg(
        F.sum("_c").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.any_value("_n").alias("_n"), F.any_value("_targets").alias("_targets")
    )


def equal_width_counts(df: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """Counts per equal-width bin between the minimum and maximum of each key.

    The ranges come from a first aggregation and are looked up by key, so rows are
    counted where they are read and a key holding most of them is never gathered in one
    task. Bins without values are counted as zero.
    """
    data = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v"))
    ranges = data.groupBy(key).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    step = F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_low"), width)), F.lit(0))
    found = looked_up(ranges, key, ["_low", "_high"])[F.col(key)]
    counts = (
        data.where(F.col(key).isNotNull())
        .withColumn("_range", found)
        .select(key, "_v", "_range.*")
        .groupBy(key, F.least(step, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edges = [(F.col("_low") + (F.col("bin") + i) * width).alias(name) for i, name in enumerate(("bin_low", "bin_high"))]
    grid = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    filled = grid.join(counts, [key, "bin"], "left")
    return filled.select(key, "bin", *edges, F.coalesce("n", F.lit(0)).alias("n"))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count, one row per column."""
    table = group_summary(melt(df, columns), ["key"], "value", QUARTILES, merged=True)
    return table.select(F.col("key").alias("column"), "minimum", "q25", "q50", "mean", "q75", "maximum", "n_missing")


def parameter_quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles of every column, one row per column."""
    return group_summary(melt(df, columns), ["key"], "value", QUARTILES).select("key", *QUARTILES)


def melt(df: DataFrame, columns: list[str]) -> DataFrame:
    """All listed columns as (key, value) rows."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "key", "value")
