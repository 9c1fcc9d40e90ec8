"""Ranked lexical search by presence masks.

For a query item the documents of a chunk are grouped by the mask of the item's terms
that they hold (one bit for each term, set by or-ing the term's postings). A mask bounds
the score of all its documents by the largest weight that each of its terms reaches in
the chunk, so masks are evaluated by descending bound until the next bound is below the
item's k-th score so far; that score is carried from chunk to chunk of a task. A bound
equal to it is still evaluated, because ties are decided by doc_id. Each task hands over
its k best documents of every item, and a window over those picks the final ranks.

Items are taken in blocks of at most ``BLOCK_TERMS`` different terms, so what a task
holds of the items is bounded however many there are; each block reads the documents
once, keeps the matched terms of each document as a table in the shared folder, counts
document frequencies from it, and searches it. All integers are exact.

Defined cases: a null or term-less text matches nothing and is not counted; rows of an
item are taken together, their terms once; a null item_id is an item of its own; repeated
document rows are documents of their own; a null doc_id comes last among equal scores;
an empty table of either kind gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundwise.llm.shared import cut, fresh_path, slices

TOP = 10
BLOCK_TERMS = 1 << 17
CHUNK_DOCS, CHUNK_POSTINGS = 8192, 1 << 20
WORD_BYTES = 1 << 20
ROWS_AT_ONCE = 256
LAST_ID = np.iinfo(np.int64).max
# Terms are runs of ASCII letters and digits and of all bytes above ASCII; A-Z lower-cased.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists that cover about ``WORD_BYTES`` each."""
    data = (text or "").encode().translate(LOWERED)
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + WORD_BYTES) if len(data) - start > WORD_BYTES else -1
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the different terms of each item, sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, ROWS_AT_ONCE):
            found = [sorted({t for part in terms_of(text) for t in part}) for text in rows["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(rows["item_id"], pa.int64()), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    each = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms array<binary>")
    # equal rows first, so that copies of one item shrink before they meet
    merged = each.distinct().groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
    return merged.where(F.size("terms") > 0)


def blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items in blocks of at most ``block_terms`` terms (or a single item)."""
    block, size = [], 0
    for row in items.toLocalIterator():
        terms = [bytes(t) for t in row["terms"]]
        if block and size + len(terms) > block_terms:
            yield block
            block, size = [], 0
        block.append((row["item_id"], terms))
        size += len(terms)
    if block:
        yield block


def matched_terms(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): documents with their length in terms, and the numbers and
    occurrences of the wanted terms in them."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for rows in slices(batches, ROWS_AT_ONCE):
            sizes, terms, tfs = [], [], []
            for text in rows["text"]:
                n, counts = 0, Counter()
                for part in terms_of(text):
                    n += len(part)
                    counts.update(map(known.get, part))
                counts.pop(None, None)
                sizes.append(n)
                terms.append(np.fromiter(counts.keys(), np.int32, len(counts)))
                tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
            arrays = [pa.array(rows["doc_id"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Chunk:
    """Postings of some documents, term by term, with the share of each posting in a score."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, docs: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, total: int):
        self.ids = ids
        # exact for any length: 90 * n * N may pass 64 bits before the division
        m = np.array([10 + 90 * int(n) * n_docs // total for n in lengths], np.int64)
        order = np.lexsort((docs, terms))
        self.docs = docs[order].astype(np.int64)
        tf = tfs[order].astype(np.int64)
        self.share = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs])
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.most = np.maximum.reduceat(self.share, starts) if len(order) else np.empty(0, np.int64)

    def of(self, place: int) -> slice:
        return slice(self.starts[place], self.starts[place + 1])


def best(ids: np.ndarray, missing: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id, rows without id last."""
    return np.lexsort((ids, missing, -scores))[:k]


class Ranking:
    """The k best documents of one item so far; the floor is the k-th score."""

    def __init__(self, k: int):
        self.k = k
        self.ids, self.missing, self.scores = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    @property
    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, ids: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        ids, missing, scores = np.append(self.ids, ids), np.append(self.missing, missing), np.append(self.scores, scores)
        kept = best(ids, missing, scores, self.k)
        self.ids, self.missing, self.scores = ids[kept], missing[kept], scores[kept]


def search_chunk(chunk: Chunk, missing: np.ndarray, terms: np.ndarray, weights: np.ndarray, ranking: Ranking) -> int:
    """Add the chunk's documents that may be among the item's best; counts those evaluated."""
    places = np.searchsorted(chunk.terms, terms)
    places = np.minimum(places, max(0, len(chunk.terms) - 1))
    here = (chunk.terms[places] == terms) & (weights > 0) if len(chunk.terms) else np.zeros(len(terms), bool)
    places, weights = places[here], weights[here]
    if not len(places):
        return 0
    tops = weights * chunk.most[places]
    if tops.sum() < ranking.floor:
        return 0
    # presence masks: bit t of a document's words is set if it holds term t
    masks = np.zeros((len(chunk.ids), -(-len(places) // 64)), np.uint64)
    bound = np.zeros(len(chunk.ids), np.int64)
    for bit, place in enumerate(places):
        holders = chunk.docs[chunk.of(place)]
        masks[holders, bit // 64] |= np.uint64(1 << bit % 64)
        bound[holders] += tops[bit]
    held = np.flatnonzero((bound >= ranking.floor) & (bound > 0))
    if not len(held):
        return 0
    keys = masks[held]
    order = np.lexsort([*keys.T, -bound[held]])
    held, keys = held[order], keys[order]
    # documents of one mask now lie together, masks by descending bound
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    ends = np.append(starts[1:], len(held))
    evaluated, at, step = 0, 0, ranking.k
    while at < len(starts) and bound[held[starts[at]]] >= ranking.floor:
        # whole masks, together with at least ``step`` documents
        upto = min(len(starts), int(np.searchsorted(ends, starts[at] + step)) + 1)
        group = np.sort(held[starts[at] : ends[upto - 1]])
        scores = np.zeros(len(group), np.int64)
        for place, weight in zip(places, weights):
            span = chunk.of(place)
            docs = chunk.docs[span]
            spot = np.minimum(np.searchsorted(docs, group), len(docs) - 1)
            scores += np.where(docs[spot] == group, weight * chunk.share[span][spot], 0)
        found = scores >= ranking.floor
        ranking.add(chunk.ids[group[found]], missing[group[found]], scores[found])
        evaluated += len(group)
        at, step = upto, step * 2
    return evaluated


def chunks(batches: Iterable[pa.RecordBatch], n_docs: int, total: int, chunk_docs: int) -> Iterator[tuple[Chunk, np.ndarray]]:
    """Rows of the table of matched terms in chunks of bounded size."""
    kept, docs, postings = [], 0, 0

    def made() -> tuple[Chunk, np.ndarray]:
        rows = pa.Table.from_batches(kept).combine_chunks()
        lists = rows.column("terms").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets))
        ids = rows.column("doc_id")
        missing = np.asarray(ids.is_null())
        values = [np.asarray(rows.column(c).combine_chunks().flatten()) for c in ("terms", "tfs")]
        chunk = Chunk(np.asarray(ids.fill_null(LAST_ID)), np.asarray(rows.column("n")), np.repeat(np.arange(len(sizes)), sizes), *values, n_docs, total)
        return chunk, missing

    for batch in batches:
        for start in range(0, batch.num_rows, min(ROWS_AT_ONCE, chunk_docs)):
            part = batch.slice(start, min(ROWS_AT_ONCE, chunk_docs))
            kept.append(part)
            docs, postings = docs + part.num_rows, postings + len(part.column("terms").flatten())
            if docs >= chunk_docs or postings >= CHUNK_POSTINGS:
                yield made()
                kept, docs, postings = [], 0, 0
    if docs:
        yield made()


def task_best(matched: DataFrame, items: list[tuple[int | None, list[bytes]]], numbers: dict[bytes, int], weights: np.ndarray, n_docs: int, total: int, k: int, chunk_docs: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each item of the block."""
    wanted = [np.sort(np.array([numbers[t] for t in terms], np.int64)) for _, terms in items]
    sent = matched.sparkSession.sparkContext.broadcast((wanted, weights))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = sent.value
        rankings = [Ranking(k) for _ in wanted]
        for chunk, missing in chunks(batches, n_docs, total, chunk_docs):
            for terms, ranking in zip(wanted, rankings):
                search_chunk(chunk, missing, terms, weights[terms], ranking)
        for item, r in enumerate(rankings):
            if len(r.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r.ids), item), pa.int32()), pa.array(r.ids, mask=r.missing), pa.array(r.scores)], ["item", "doc_id", "score"])

    return matched.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    path = fresh_path(spark, "mask-ranks")
    schema = "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in blocks(cut(item_terms(items), "mask-items"), block_terms):
        numbers = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        matched = cut(matched_terms(docs, numbers), "mask-matched")
        counted = matched.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        if not counted["n"]:
            break
        # one row per wanted term, of which a block has a bounded number
        held = np.zeros(len(numbers), np.int64)
        for row in matched.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            held[row["t"]] = row["count"]
        weights = np.array([term_weight(counted["n"], int(df)) for df in held], np.int64)
        found = task_best(matched, block, numbers, weights, counted["n"], counted["l"], k, chunk_docs)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long"))
        ranked.join(names, "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
