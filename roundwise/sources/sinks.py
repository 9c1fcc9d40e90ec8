"""Sinks. Each table gets its own path and an existing one is refused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Hand a panel or a table over to another job as Parquet.

    Every task writes one file per ``partition_by`` value it holds, so leave that off
    for a panel spread by subject unless readers really select by those columns.
    """
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_bucketed(df: DataFrame, name: str, path: str, by: str, sort_by: Sequence[str] = (), buckets: int | None = None) -> str:
    """Hand a panel over as table ``name`` (data below ``path``), bucketed by ``by`` and
    sorted within the buckets: windows, aggregates and joins of the next job over that
    column need no exchange.

    A panel that is spread by the same column over as many partitions as there are buckets
    (the default: the session's shuffle partitions) is written as one file per bucket,
    without moving a row. Read it with ``spark.table(name)``.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.write.mode("error").option("path", path).bucketBy(n, by).sortBy(by, *sort_by).saveAsTable(name)
    return name


def in_order(df: DataFrame, order: Sequence[str], files: int | None = None) -> DataFrame:
    """Rows in ascending order over the partitions and within them, so that part files read
    by name give the whole order: ranges of the sort keys are dealt to tasks, and no task
    sorts more than its range. Equal keys are ordered by the other columns; missing values
    come first."""
    keys = [*order, *[c for c in df.columns if c not in order]]
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def write_csv(df: DataFrame, path: str, names: list[str] | None = None, positions: list[int] | None = None, single_file: bool = False, order: Sequence[str] = (), files: int | None = None) -> str:
    """CSV with a header, optionally of some columns by position and under new names.

    With ``order`` (names in the file) rows are in order over the part files as sorted by
    name; the runtime merges small ranges unless the number of ``files`` is given.
    ``single_file`` is for finished report tables only: all rows meet in one task,
    and are ordered there.
    """
    chosen = df.select(*[df.columns[i] for i in positions]) if positions else df
    out = chosen.toDF(*names) if names else chosen
    if order:
        out = in_order(out, order, 1 if single_file else files)
    elif single_file:
        out = out.repartition(1)  # only the finished rows meet in one task
    out.write.mode("error").option("header", True).option("nullValue", "NA").csv(path)
    return path


def write_collection(frames: dict[str, DataFrame], folder: str) -> str:
    for name, frame in frames.items():
        write_table(frame, f"{folder}/{name}")
    return folder
