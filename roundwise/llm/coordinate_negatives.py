"""Hard negatives by length buckets and pruned coordinate lists.

Vectors become whole numbers. They are dealt by label and length into buckets of at most
``BUCKET_ROWS`` neighbours, each stored as one row of a table: the vectors, and for every
coordinate the sorted list of the vectors' shares (coordinate over length) with their
places. A search for scores of at least t by a query of length |q| skips a bucket whose
longest vector cannot reach t. Otherwise vector and query must lie within the angle
arccos(t / (|q| * longest)) of each other, which leaves each coordinate a feasible range
around the query's own share. The ranges of the query's ``FOCUS`` largest coordinates are
cut out of the sorted lists, their places intersected, and what is left is verified by
exact inner products.

Positives come first: an anchor's best rows of its label, the threshold rising with its
k-th best so far. Negatives follow for the bands [ratio * positive score, positive
score] of all positives of an anchor at once: the threshold is the lowest band floor, or
the k-th best of a band once it is full. Anchors are sent to the buckets in blocks of
bounded size, read from a table block by block; the results of a block are appended to a
table. Tasks hand over k rows of each list at most, and a window picks the final ranks.

Defined cases: rows with a null label, a null vector or a null or non-finite component
take no part; repeated rows count once, other rows of one vec_id are rows of their own; a
null vec_id is no anchor and comes last among equal scores; a shorter vector counts as
padded with zeros; scores beyond 64 bits stop the job; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundwise.llm.shared import cut, fresh_path, partitions

SCALE = 256
TOP = 5
RATIO = (80, 100)
BUCKET_ROWS = 1024
BLOCK_ANCHORS = 8192
FOCUS = 4
EXACT_DOUBLE = float(1 << 53)
LARGEST = (1 << 63) - 1
SLACK = 1e-9
BUCKET = "label int, longest double, shortest double, ids binary, missing binary, dims int, vectors binary, shares binary, places binary"
PIECE = "label int, ids binary, dims int, vectors binary"
FOUND = "anchor long, anchor_label int, place int, id long, score long"


def usable(rows: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(vec_id, label, v, norm): rows that take part, components as whole numbers."""
    x = F.col(embedding)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(SCALE * c.cast("double")).cast("double"))
    kept = rows.where(F.col("label").isNotNull() & x.isNotNull()).where(~bad)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), whole.alias("v")).distinct().withColumn("norm", norm)


def matrix_of(vectors: pa.ListArray) -> np.ndarray:
    """Rows of vectors, shorter ones padded with zeros."""
    sizes = np.diff(np.asarray(vectors.offsets))
    values = np.asarray(vectors.flatten(), np.float64)
    dims = int(sizes.max(initial=0))
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = values
    return out


def runs_of_label(batches: Iterable[pa.RecordBatch], bucket_rows: int) -> Iterator[pa.Table]:
    """Neighbouring rows of one label, ``bucket_rows`` at most."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        labels = np.asarray(batch.column("label"))
        edges = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            if kept and kept[-1].column("label")[0].as_py() != labels[start]:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, size = [], 0
            while start < stop:
                step = min(stop - start, bucket_rows - size)
                kept.append(batch.slice(start, step))
                size, start = size + step, start + step
                if size == bucket_rows:
                    yield pa.Table.from_batches(kept).combine_chunks()
                    kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def columns_of(rows: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    ids = rows.column("vec_id").combine_chunks()
    vectors = rows.column("v").combine_chunks()
    return rows.column("label")[0].as_py(), np.asarray(ids.fill_null(LARGEST), np.int64), np.asarray(ids.is_null()), matrix_of(vectors)


def buckets(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """The index: one row per length bucket of one label, with its coordinate lists.

    Rows are dealt by ranges of label and length; rows of equal label and length by a hash,
    so that copies of one vector spread over many ranges.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of_label(batches, bucket_rows):
            label, ids, missing, vectors = columns_of(part)
            norms = np.asarray(part.column("norm"))
            shares = vectors / np.where(norms > 0, norms, 1.0)[:, None]
            places = np.argsort(shares, axis=0, kind="stable")
            lists = np.take_along_axis(shares, places, axis=0).T
            row = [label, norms.max(), norms.min(), ids.tobytes(), missing.tobytes(), vectors.shape[1], vectors.tobytes(), np.ascontiguousarray(lists).tobytes(), np.ascontiguousarray(places.T.astype(np.int32)).tobytes()]
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], [c.split()[0] for c in BUCKET.split(", ")])

    spread = rows.withColumn("_h", F.xxhash64("vec_id", "v"))
    dealt = spread.repartitionByRange(partitions(rows.sparkSession), "label", "norm", "_h").sortWithinPartitions("label", F.desc("norm"))
    return dealt.select("vec_id", "label", "v", "norm").mapInArrow(run, BUCKET)


def pieces(anchors: DataFrame, bucket_rows: int) -> DataFrame:
    """Anchors packed like buckets, without lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of_label(batches, bucket_rows):
            label, ids, _, vectors = columns_of(part)
            row = zip([label, ids.tobytes(), vectors.shape[1], vectors.tobytes()], [pa.int32(), pa.binary(), pa.int32(), pa.binary()])
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], [c.split()[0] for c in PIECE.split(", ")])

    return anchors.select("vec_id", "label", "v").sortWithinPartitions("label").mapInArrow(run, PIECE)


class Bucket:
    """One row of the index in memory."""

    def __init__(self, row: dict):
        self.label, self.longest, self.shortest, self.dims = row["label"], row["longest"], row["shortest"], row["dims"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.missing = np.frombuffer(row["missing"], bool)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), self.dims)
        self.lists = np.frombuffer(row["shares"], np.float64).reshape(self.dims, len(self.ids))
        self.places = np.frombuffer(row["places"], np.int32).reshape(self.dims, len(self.ids))

    def candidates(self, query: Query, least: float) -> np.ndarray:
        """Places of the vectors that may score ``least`` or more."""
        everything = np.arange(len(self.ids))
        if least == -np.inf:
            return everything
        reach = query.norm * (self.longest if least > 0 else self.shortest)
        if reach <= 0:
            return everything if least <= 0 else everything[:0]
        cosine = least / reach - SLACK
        if cosine > 1:
            return everything[:0]
        if cosine <= -1:
            return everything
        angle = np.arccos(cosine)
        seen = None
        for f, own in query.focus:
            if f >= self.dims:
                continue
            low = np.cos(min(np.pi, own + angle)) - SLACK
            high = np.cos(max(0.0, own - angle)) + SLACK
            start, stop = np.searchsorted(self.lists[f], (low, high), side="left")
            stop = np.searchsorted(self.lists[f], high, side="right")
            inside = np.zeros(len(self.ids), bool)
            inside[self.places[f, start:stop]] = True
            seen = inside if seen is None else seen & inside
            if not seen.any():
                break
        return everything if seen is None else np.flatnonzero(seen)

    def scores(self, query: Query, places: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        shared = min(self.dims, len(query.vector))
        rows, own = self.vectors[places, :shared], query.vector[:shared]
        if query.norm * self.longest < EXACT_DOUBLE:
            return (rows @ own).astype(np.int64)
        exact = [sum(int(a) * int(b) for a, b in zip(r, own)) for r in rows]
        if any(abs(s) * RATIO[1] > LARGEST for s in exact):
            raise OverflowError("an inner product is beyond 64 bits")
        return np.array(exact, np.int64)


class Query:
    """An anchor with its length and focus coordinates (coordinate, angle of its share)."""

    def __init__(self, id: int, label: int, vector: np.ndarray, focus: int = FOCUS):
        self.id, self.label, self.vector = id, label, vector
        self.norm = float(np.sqrt((vector * vector).sum()))
        largest = np.argsort(-np.abs(vector), kind="stable")[:focus]
        self.focus = [(int(f), float(np.arccos(np.clip(vector[f] / self.norm, -1, 1)))) for f in largest] if self.norm else []


class Best:
    """The k best (score, id) rows of one list so far."""

    def __init__(self, k: int):
        self.k = k
        self.ids, self.missing, self.scores = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    @property
    def full(self) -> bool:
        return len(self.ids) == self.k

    def add(self, ids: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        ids, missing, scores = np.append(self.ids, ids), np.append(self.missing, missing), np.append(self.scores, scores)
        kept = np.lexsort((ids, missing, -scores))[: self.k]
        self.ids, self.missing, self.scores = ids[kept], missing[kept], scores[kept]


def is_itself(bucket: Bucket, query: Query, places: np.ndarray) -> np.ndarray:
    """The anchor's own row: its vec_id and, as rows are distinct, its vector."""
    if bucket.label != query.label:
        return np.zeros(len(places), bool)
    own = (bucket.ids[places] == query.id) & ~bucket.missing[places]
    vector = np.zeros(max(bucket.dims, len(query.vector)))
    vector[: len(query.vector)] = query.vector
    for i in np.flatnonzero(own):
        other = np.zeros(len(vector))
        other[: bucket.dims] = bucket.vectors[places[i]]
        own[i] = (other == vector).all()
    return own


def gather_positives(query: Query, bucket: Bucket, best: Best) -> None:
    places = bucket.candidates(query, float(best.scores[-1]) if best.full else -np.inf)
    places = places[~is_itself(bucket, query, places)]
    if len(places):
        best.add(bucket.ids[places], bucket.missing[places], bucket.scores(query, places))


def gather_negatives(query: Query, bucket: Bucket, bands: list[tuple[int, int]], lists: list[Best]) -> None:
    """Bands are (floor, top) of the scores wanted for each positive."""
    floors = [max(low, int(b.scores[-1])) if b.full else low for (low, _), b in zip(bands, lists)]
    places = bucket.candidates(query, float(min(floors)))
    if not len(places):
        return
    scores = bucket.scores(query, places)
    for (_, top), floor, best in zip(bands, floors, lists):
        inside = (scores >= floor) & (scores <= top)
        if inside.any():
            best.add(bucket.ids[places[inside]], bucket.missing[places[inside]], scores[inside])


def band(score: int, ratio: tuple[int, int] = RATIO) -> tuple[int, int]:
    """Whole scores s with ratio[0] * score <= ratio[1] * s <= ratio[1] * score."""
    return -(-ratio[0] * score // ratio[1]), score


def blocks(stored: DataFrame, block_anchors: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(id, label, vector) of the anchors, whole pieces until there are ``block_anchors``."""
    block: list[tuple[int, int, np.ndarray]] = []
    for row in stored.toLocalIterator():
        ids = np.frombuffer(row["ids"], np.int64)
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["dims"])
        block += [(int(i), row["label"], v) for i, v in zip(ids, vectors)]
        if len(block) >= block_anchors:
            yield block
            block = []
    if block:
        yield block


def searched(index: DataFrame, anchors: list[tuple[int, int, np.ndarray]], bands: list[list[tuple[int, int]]] | None, k: int, focus: int) -> DataFrame:
    """Rows of ``FOUND``: for anchor number ``anchor``, the task's k best rows of its label
    (``bands`` None), or of the other labels in each of its bands (numbered by place)."""
    sent = index.sparkSession.sparkContext.broadcast((anchors, bands))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, bands = sent.value
        queries = [Query(*a, focus) for a in anchors]
        lists = [[Best(k) for _ in (bands[i] if bands else (0,))] for i in range(len(queries))]
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = Bucket(batch.slice(i, 1).to_pylist()[0])
                for j, query in enumerate(queries):
                    if bands is None and bucket.label == query.label:
                        gather_positives(query, bucket, lists[j][0])
                    elif bands and bands[j] and bucket.label != query.label:
                        gather_negatives(query, bucket, bands[j], lists[j])
        for j, of_anchor in enumerate(lists):
            for place, best in enumerate(of_anchor):
                if len(best.ids):
                    n = len(best.ids)
                    arrays = [pa.array(np.full(n, j), pa.int64()), pa.array(np.full(n, anchors[j][1]), pa.int32()), pa.array(np.full(n, place), pa.int32()), pa.array(best.ids, mask=best.missing), pa.array(best.scores)]
                    yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in FOUND.split(", ")])

    return index.mapInArrow(run, FOUND)


def first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each list, by score and then vec_id, with their rank."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, k: int = TOP, bucket_rows: int = BUCKET_ROWS, focus: int = FOCUS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, embedding and label; ``is_anchor`` is a condition on vec_id.
    """
    spark: SparkSession = rows.sparkSession
    kept = cut(usable(rows), "lemp-rows")
    index = cut(buckets(kept, bucket_rows), "lemp-buckets")
    stored = cut(pieces(kept.where(is_anchor), bucket_rows), "lemp-anchors")
    path = fresh_path(spark, "lemp-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in blocks(stored, block_anchors):
        # k rows for each anchor of the block, so the driver sees a bounded number
        positives: list[list] = [[] for _ in block]
        for row in first(searched(index, block, None, k, focus), k).orderBy("anchor", "rank").collect():
            positives[row["anchor"]].append((row["id"], row["score"]))
        bands = [[band(score) for _, score in of_anchor] for of_anchor in positives]
        found = first(searched(index, block, bands, k, focus), k)
        pairs = [(j, place, block[j][0], id, score) for j, of_anchor in enumerate(positives) for place, (id, score) in enumerate(of_anchor)]
        named = F.broadcast(spark.createDataFrame(pairs, "anchor long, place int, anchor_id long, positive_id long, positive_score long"))
        out = found.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
