"""Exact dedup as a stateful stream: disk-backed keyed state, no expiry, full-byte checks.

Arrivals (digest, stable identifier, content locator) flow through a streaming aggregate
whose keyed state sits in RocksDB and is never expired: for each digest it retains the
arrival with the largest identifier, its locator and a count. A hit is then checked
against the content at the retained locator, byte for byte; texts whose bytes differ under
an equal digest are grouped again by the bytes themselves. Everything is DataFrame and
SQL functions.

The arrivals of a run are read in ``BATCHES`` micro-batches, so later ones meet the state of
earlier ones. With a ``state_path`` the state outlives the run: a later run over new rows
meets the digests, identifiers and locators of all runs before it, and reads the retained
content from where it lies (those files must still be there). Its decisions are about its
own rows; ``group_size`` counts all arrivals so far.

Texts are equal when identical after lower-casing A-Z only. Defined cases: a null text is
empty; a null doc_id is smaller than any other; of repeated rows (same doc_id and text)
exactly one is kept, by locator; an empty table gives an empty result; other columns of
the input may have any names.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundwise.llm.shared import cut, fresh_path, unused

BATCHES = 4
ARRIVALS = "doc_id long, at struct<file: string, row: bigint>, digest string, text_sha256 string"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else each of many small stores reserves 4 MB of disk for its manifest
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Digest = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of one streaming query, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def located(docs: DataFrame, name: str = "__at") -> DataFrame:
    """``docs`` with the content locator ``name`` (file, row in the file) of each row.

    A frame that is not a file scan is landed in the shared folder first.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.withColumn(name, at)
    except AnalysisException:
        return cut(docs, "dedup-content").withColumn(name, at)


def fold_state(arrivals: DataFrame, state_path: str) -> DataFrame:
    """Run the stream ``arrivals`` (digest, doc_id, at) to its present end; the state table
    (digest, keeper, arrived): ``keeper`` is the retained (identifier, locator)."""
    spark = arrivals.sparkSession
    state = arrivals.groupBy("digest").agg(F.max(F.struct("doc_id", "at")).alias("keeper"), F.count("*").alias("arrived"))
    changes = f"{state_path}/changes"

    def land(batch: DataFrame, number: int) -> None:
        # overwritten by number, so that a batch repeated after a failure counts once
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    with settings(spark, ROCKSDB):
        query = state.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", f"{state_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    schema = "digest string, keeper struct<doc_id: bigint, at: struct<file: string, row: bigint>>, arrived bigint, batch bigint"
    # each change holds the whole state of its key, and both values only grow
    return spark.read.schema(schema).parquet(changes).groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("arrived").alias("arrived"))


def content_of(docs: DataFrame) -> DataFrame:
    at = unused("__at", docs)
    return located(docs, at).select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("body"), F.col(at).alias("at"))


def deduplicate(docs: DataFrame, digest: Digest = sha256, state_path: str | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per row of ``docs``: doc_id, at, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    content = content_of(docs)
    path = state_path or fresh_path(spark, "dedup-state")
    arrivals = f"{path}/arrivals"
    run = f"{arrivals}/run={uuid.uuid4().hex}"
    content.select("doc_id", "at", digest(F.col("body")).alias("digest"), sha256(F.col("body")).alias("text_sha256")).write.parquet(run)
    arrived = spark.read.schema(ARRIVALS).parquet(run)
    landed = arrived.inputFiles()
    if not landed:
        state = arrived.groupBy("digest").agg(F.max(F.struct("doc_id", "at")).alias("keeper"), F.count("*").alias("arrived"))
    else:
        # the files of earlier runs are in the stream's log already
        stream = spark.readStream.schema(f"{ARRIVALS}, run string").option("maxFilesPerTrigger", -(-len(landed) // batches)).parquet(arrivals)
        state = fold_state(stream.select("digest", "doc_id", "at"), path)
    state = cut(state, "dedup-state-table")

    # hits: every arrival beyond the first of its digest; their bytes against the keeper's
    hits = state.filter("arrived > 1")
    members = arrived.join(hits, "digest").select("digest", "at", "keeper")
    checked = cut(content.select("at", "body").join(members, "at"), "dedup-hits")
    held = checked.filter(F.col("at") == F.col("keeper.at")).select("digest", F.col("body").alias("held"))
    if state_path:
        retained = earlier_content(members.select("digest", F.col("keeper.at").alias("at")), arrived)
        if retained is not None:
            held = held.unionByName(retained.select("digest", F.col("body").alias("held")))
    checked = checked.select("digest", "body").join(held, "digest")
    # written before distinct, so that the join's large partitions can be split
    unequal = cut(checked.filter(F.col("body") != F.col("held")).select("digest"), "dedup-unequal")
    differing = cut(unequal.distinct(), "dedup-differing")

    groups = arrived.join(state, "digest").select("digest", "doc_id", "at", "text_sha256", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.at").alias("keep_at"), F.col("arrived").alias("group_size"))
    if not differing.isEmpty():
        again = content.join(arrived.join(differing, "digest", "left_semi").select("at", "digest", "text_sha256"), "at")
        every = again.select("digest", "body", "doc_id", "at")
        if state_path:
            others = spark.read.schema(ARRIVALS).parquet(f"{arrivals}/run=*").join(differing, "digest", "left_semi")
            before = earlier_content(others.select("digest", "at"), arrived)
            every = every if before is None else every.unionByName(before.select(every.columns))
        exact = every.groupBy("digest", "body").agg(F.max(F.struct("doc_id", "at")).alias("k"), F.count("*").alias("group_size"))
        split = again.join(exact, ["digest", "body"]).select("digest", "doc_id", "at", "text_sha256", F.col("k.doc_id").alias("keep_id"), F.col("k.at").alias("keep_at"), "group_size")
        groups = groups.join(differing, "digest", "left_anti").unionByName(split)
    return groups.select("doc_id", "at", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), "text_sha256")


def earlier_content(met: DataFrame, arrived: DataFrame) -> DataFrame | None:
    """(digest, doc_id, at, body) of the rows in ``met`` (digest, at) that came with an
    earlier run, read from the files of their locators."""
    spark = met.sparkSession
    earlier = cut(met.distinct().join(arrived.select(F.col("at").alias("own")), F.col("at") == F.col("own"), "left_anti"), "dedup-earlier")
    # names of files only, as any reader of a table lists them
    files = [r["file"] for r in earlier.select("at.file").distinct().collect()]
    return content_of(spark.read.parquet(*files)).join(earlier, "at").select("digest", "doc_id", "at", "body") if files else None


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    at = unused("__at", docs)
    source = located(docs, at)
    kept = deduplicate(source.drop(at)).filter("kept").select(F.col("at").alias("__kept"))
    return source.join(kept, source[at] == kept["__kept"], "left_semi").drop(at)
