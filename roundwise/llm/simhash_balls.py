"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 2 or less have a common variant at distance 1 or less from
each. Every distinct fingerprint therefore emits itself and its 64 one-bit variants, and
fingerprints that meet on a variant are linked after their distance is verified. At most
65 distinct fingerprints can meet on one variant, whatever the data, so no group is ever
large; copies are reduced to one fingerprint before any variant is made. Wider even radii
use all variants within half the radius; odd radii are refused, as two fingerprints that
meet there may be further apart than the radius.

``one_of_each_group`` keeps one document of each group. Links are decided by fingerprints
alone, so every pair of fingerprints within the radius ends in one group, however many
texts look alike.

Defined cases: a null text is empty; an empty text has fingerprint zero and links like
any other; a null doc_id is kept and never the smallest; repeated rows give repeated rows;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundwise.llm.components import connected_components
from roundwise.llm.shared import cut, slices

RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
HASH_ROWS = 65536


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of one text, in bounded pieces; nothing without words."""
    # bytes.lower and bytes.split touch exactly A-Z and \x20 \x09-\x0D
    words = (text or "").encode().lower().split()
    if not words:
        return
    n = max(1, len(words) - shingle_words + 1)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, HASH_ROWS):
        stop = min(n, start + HASH_ROWS)
        yield np.fromiter((digest(b" ".join(words[i : i + shingle_words]), SEED) for i in range(start, stop)), np.uint64, stop - start)


def majority(pieces: Iterable[np.ndarray]) -> int:
    """64-bit SimHash of hashes; zero without any."""
    n, votes = 0, np.zeros(64, np.int64)
    for hashes in pieces:
        n += len(hashes)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def text_fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles of one text; zero without words."""
    return majority(shingle_hashes(text, shingle_words))


def text_key() -> Column:
    """Names a text, so that rows of one doc_id with other texts are told apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_key, fp): one row for each row of ``docs``; ``fp`` is the signed 64-bit
    value."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            fps = np.array([text_fingerprint(t, shingle_words) for t in rows["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(rows["text_key"], pa.int64()), pa.array(fps)], ["doc_id", "text_key", "fp"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return named.mapInArrow(run, "doc_id long, text_key long, fp long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ball_edges(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): verified links between the distinct fingerprints of ``nodes`` (fp).

    Within a variant the smallest fingerprint is linked to the others; what else meets
    there is joined to it too, so the components are those of all links.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    flips = np.array([sum(1 << i for i in bits) for k in range(radius // 2 + 1) for bits in itertools.combinations(range(64), k)], np.uint64).view(np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, max(1, HASH_ROWS // len(flips))):
            fps = np.array(rows["fp"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fps, len(flips))), pa.array((fps[:, None] ^ flips).ravel())], ["fp", "variant"])

    balls = nodes.select("fp").mapInArrow(run, "fp long, variant long")
    hub = F.min("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = balls.select("fp", hub.alias("hub")).filter(F.col("hub") < F.col("fp"))
    return met.filter(distance(F.col("hub"), F.col("fp")) <= radius).select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def linked(nodes: DataFrame, radius: int) -> DataFrame:
    """(fp, first) with the smallest ``first`` of each group of linked fingerprints, from
    ``nodes`` with one row per fingerprint and the smallest ``first`` of its rows."""
    roots = connected_components(cut(ball_edges(nodes.select("fp"), radius), "simhash-edges"))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(smallest, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links."""
    prints = cut(fingerprints(docs, shingle_words), "simhash-prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    return prints.join(linked(nodes, radius), "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def one_of_each_group(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, columns unchanged.

    A row without doc_id cannot be named as a copy and stays; repeated rows of a kept doc_id
    and text stay repeated (exact dedup removes them). Rows are dropped by doc_id and text,
    not by doc_id alone.
    """
    prints = cut(fingerprints(docs, shingle_words).filter("doc_id IS NOT NULL"), "simhash-prints")
    keeper = F.struct("doc_id", "text_key")
    nodes = cut(prints.groupBy("fp").agg(F.min(keeper).alias("first")), "simhash-nodes")
    dropped = prints.join(linked(nodes, radius), "fp").filter(keeper != F.col("first")).select(F.col("doc_id").alias("__drop"), F.col("text_key").alias("__text")).distinct()
    return docs.join(dropped, (docs["doc_id"].cast("long") == dropped["__drop"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == dropped["__text"]), "left_anti")
