"""Subword lattice likelihood: the marginal probability of a text over all segmentations.

The pieces are those of an existing vocabulary and, as whole-word pieces, the words of the
training texts. The vocabulary's ranks give first unigram scores (Zipf), which
expectation-maximisation adapts to the training words: expected piece counts over all
segmentations. A text is its words and one end mark; no piece crosses a word, so the
lattice of a text is the chain of its words' lattices, each distinct word is summed once,
and a text's log probability is the sum over its words and the end.

A word's lattice has one arc for the whole word, worth its training count less a discount,
and the arcs of the subword pieces, which share the discounted mass: an initial piece
(with a leading space), then further pieces until a stop. Initial pieces have scores that
sum to 1, further pieces and the stop likewise, so the probabilities of all words and the
end mark sum to 1 at most. The discount is estimated from the words seen once and twice;
the subword scores are fitted to what it takes from each distinct word, so they describe
rare words. Sums over segmentations are forward recursions in log space.

The word table is counted over all documents and joined back: its frequent words, at most
``HOT_WORDS``, are broadcast and summed where the texts are read, the others are joined by
shuffle, where no word is frequent any more.

Defined cases: a null text is empty and consists of the end mark; a null doc_id is held in
(its remainder is unknown); any byte string has a segmentation, as single bytes are
pieces; without training text the existing scores are used and nothing is known; repeated
rows are scored (and learnt from) each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundwise.llm.shared import cut, slices

EM_STEPS = 4
ZIPF_SHIFT = 100.0
PRIOR_PIECES = 1000.0
HOT_WORDS = 1 << 17
WORDS_AT_ONCE = 1 << 15
COUNTER_WORDS = 400_000
LATTICE_CELLS = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 20
SPACES = frozenset(b" \t\n\r\x0b\x0c")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


class Pieces:
    """The usable pieces of a rank file and their ids, found by hash for whole arrays.

    Usable are pieces of lower-cased text without inner white space; a space may only
    lead. What collides in the first table of slots gets a place of its own in the second.
    """

    def __init__(self, rank_file: str) -> None:
        with open(rank_file, "rb") as lines:
            ranked = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]
        usable = [(p, r) for p, r in sorted(ranked, key=lambda x: x[1]) if p == p.lower() and not SPACES & set(p[1:] if p.startswith(b" ") else p)]
        self.pieces = [p for p, _ in usable]
        self.initial = np.array([p.startswith(b" ") for p in self.pieces])
        self.existing = np.array([1 / (r + ZIPF_SHIFT) for _, r in usable])
        self.longest = max(map(len, self.pieces))
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, BASE)]), dtype=np.uint64)
        self.keys = np.array([self.key(p) for p in self.pieces], np.uint64)
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have one key")
        wanted = np.arange(len(self.keys), dtype=np.int32)
        self.odd = [BASE, BASE]
        self.first = np.full(1 << SLOT_BITS, -1, np.int32)
        self.first[self.slot(self.keys, 0)] = wanted
        lost = wanted[self.first[self.slot(self.keys, 0)] != wanted]
        self.second = np.full(1 << SLOT_BITS, -1, np.int32)
        while len(np.unique(self.slot(self.keys[lost], 1))) < len(lost):
            self.odd[1] = np.uint64(int(self.odd[1]) * 3 % (1 << 64))
        self.second[self.slot(self.keys[lost], 1)] = lost

    @staticmethod
    def key(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(BASE) + b + 1) % (1 << 64)
        return h

    def slot(self, keys: np.ndarray, table: int) -> np.ndarray:
        return ((keys * self.odd[table]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of pieces by key, -1 where there is none."""
        a = self.first[self.slot(keys, 0)]
        b = self.second[self.slot(keys, 1)]
        return np.where((a >= 0) & (self.keys[a] == keys), a, np.where((b >= 0) & (self.keys[b] == keys), b, -1))

    def lattice(self, block: np.ndarray) -> np.ndarray:
        """(words, n + 1, k): id of the piece of length 1..k that ends at a position, for
        words of equal length given as rows of bytes."""
        w, n = block.shape
        k = min(n, self.longest)
        prefix = np.zeros((w, n + 1), np.uint64)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * BASE + block[:, i] + np.uint64(1)
        ids = np.full((w, n + 1, k), -1, np.int32)
        for length in range(1, k + 1):
            keys = prefix[:, length:] - prefix[:, : n + 1 - length] * self.powers[length]
            ids[:, length:, length - 1] = self.find(keys)
        return ids


@functools.lru_cache(maxsize=2)
def pieces_of(rank_file: str) -> Pieces:
    return Pieces(rank_file)


def log_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials over the last axis; -inf where all terms are."""
    top = x.max(axis=-1)
    safe = np.where(np.isneginf(top), 0.0, top)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe[..., None]).sum(axis=-1)) + safe


def forward(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, arcs): log sums over all segmentations up to each position, and the score
    of each arc; the last column of alpha is the log probability of the whole."""
    arcs = np.where(ids >= 0, scores[ids], -np.inf)
    w, n, k = ids.shape
    alpha = np.full((w, n), -np.inf)
    alpha[:, 0] = 0
    for j in range(1, n):
        m = min(j, k)
        alpha[:, j] = log_sum(alpha[:, j - m : j][:, ::-1] + arcs[:, j, :m])
    return alpha, arcs


def expected_pieces(ids: np.ndarray, scores: np.ndarray, size: int) -> np.ndarray:
    """Expected piece counts over all segmentations, summed over the words."""
    alpha, arcs = forward(ids, scores)
    w, n, k = ids.shape
    beta = np.full((w, n), -np.inf)
    beta[:, -1] = 0
    for i in range(n - 2, -1, -1):
        lengths = np.arange(1, min(k, n - 1 - i) + 1)
        beta[:, i] = log_sum(arcs[:, i + lengths, lengths - 1] + beta[:, i + lengths])
    word, j, length = np.nonzero(ids >= 0)
    mass = np.exp(alpha[word, j - length - 1] + arcs[word, j, length] + beta[word, j] - alpha[word, -1])
    return np.bincount(ids[word, j, length], mass, size)


def by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Words of equal byte length with their leading space, as blocks of bounded size."""
    groups: dict[int, list[int]] = defaultdict(list)
    coded = [b" " + w.encode() for w in words]
    for i, c in enumerate(coded):
        groups[len(c)].append(i)
    for n, members in groups.items():
        at_once = max(1, LATTICE_CELLS // (n * n if n < 64 else n * 64))
        for s in range(0, len(members), at_once):
            part = members[s : s + at_once]
            yield part, np.frombuffer(b"".join(coded[i] for i in part), np.uint8).reshape(len(part), n)


def subword_log_probabilities(words: list[str], pieces: Pieces, scores: np.ndarray, stop: float) -> np.ndarray:
    """Natural log of each word's probability, summed over its subword segmentations."""
    out = np.zeros(len(words))
    for part, block in by_length(words):
        out[part] = forward(pieces.lattice(block), scores)[0][:, -1] + stop
    return out


def word_table(docs: DataFrame) -> DataFrame:
    """(word, n): every word of all texts with its count in the training texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sent() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])

        for rows in slices(batches, 256):
            for held, text in zip(rows["held_out"], rows["text"], strict=True):
                words = (text or "").encode().lower().split()
                counts.update(dict.fromkeys(words, 0) if held else words)
                if len(counts) > COUNTER_WORDS:
                    yield sent()
                    counts = Counter()
        yield sent()

    return docs.select(held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def normalised(mass: np.ndarray, stops: float, pieces: Pieces) -> tuple[np.ndarray, float]:
    """Log scores: initial pieces sum to 1, further pieces and the stop sum to 1."""
    further = mass[~pieces.initial].sum() + stops
    return np.log(mass / np.where(pieces.initial, mass[pieces.initial].sum(), further)), float(np.log(stops / further))


def adapt(words: DataFrame, rank_file: str, distinct: int, steps: int = EM_STEPS) -> tuple[np.ndarray, float]:
    """Log scores of the pieces and of the stop after ``steps`` EM steps over all training
    words. What is gathered is one number for each piece."""
    pieces = pieces_of(rank_file)
    spark = words.sparkSession
    prior = PRIOR_PIECES * pieces.existing / pieces.existing.sum()
    scores, stop = normalised(prior, PRIOR_PIECES / 2, pieces)
    train = words.filter("n > 0").select("word")
    for _ in range(steps if distinct else 0):
        shared = spark.sparkContext.broadcast(scores)

        def expect(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = pieces_of(rank_file)
            total = np.zeros(len(own.pieces))
            for rows in slices(batches, WORDS_AT_ONCE):
                for _, block in by_length(rows["word"]):
                    total += expected_pieces(own.lattice(block), shared.value, len(total))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["piece", "mass"])

        got = train.mapInArrow(expect, "piece long, mass double").groupBy("piece").agg(F.sum("mass").alias("mass")).toArrow()
        mass = prior.copy()
        mass[got["piece"].to_numpy()] += got["mass"].to_numpy()
        scores, stop = normalised(mass, distinct + PRIOR_PIECES / 2, pieces)
    return scores, stop


def score(docs: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    spark = docs.sparkSession
    kept = cut(word_table(docs), "lattice-words")
    ends = docs.filter(~held_out(F.col("doc_id"))).count()
    facts = kept.agg(F.sum("n").alias("n"), *[F.count(F.when(F.col("n") >= k, 1)).alias(f"v{k}") for k in (1, 2, 3)]).first()
    tokens, seen = (facts["n"] or 0) + ends, facts["v1"]
    distinct = seen + (ends > 0)
    once, twice = facts["v1"] - facts["v2"], facts["v2"] - facts["v3"]
    discount = once / (once + 2 * twice) if once and twice else 0.5
    scores, stop = adapt(kept, rank_file, seen)
    learnt = spark.sparkContext.broadcast(scores)
    # one more token for the end and one for words never seen keep both possible
    whole_n = tokens + 2
    subword_share = (discount * seen + 1) / whole_n

    def marginal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(rank_file)
        for rows in slices(batches, WORDS_AT_ONCE):
            subword = subword_log_probabilities(rows["word"], own, learnt.value, stop) + np.log(subword_share)
            counted = np.maximum(0.0, np.array(rows["n"], float) - discount) / whole_n
            with np.errstate(divide="ignore"):
                lattice = np.logaddexp(np.log(counted), subword) / np.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(rows["word"], pa.string()), pa.array(rows["n"], pa.int64()), pa.array(lattice)], ["word", "n", "lattice"])

    def base(n: Column) -> Column:
        return F.log10((n + 0.5) / F.lit(tokens + 0.5 * (distinct + 1)))

    table = cut(kept.mapInArrow(marginal, "word string, n long, lattice double").withColumn("base", base(F.col("n"))), "lattice-scores")
    # the most frequent words that are HOT_WORDS at most: by classes of count, an eighth of a power of two wide
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = table.filter("n > 0").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    hot_level, room = None, HOT_WORDS
    for r in levels:
        room -= r["count"]
        if room < 0:
            break
        hot_level = r["level"]
    is_hot = F.coalesce((F.col("n") > 0) & (level >= hot_level), F.lit(False)) if hot_level is not None else F.lit(False)
    frequent = table.filter(is_hot).toArrow().to_pydict()
    hot = spark.sparkContext.broadcast({w.encode(): (b, s) for w, b, s in zip(frequent["word"], frequent["base"], frequent["lattice"], strict=True)})
    end_base = float(np.log10((ends + 0.5) / (tokens + 0.5 * (distinct + 1))))
    end_lattice = float(np.log10((ends + 1) / whole_n))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for rows in slices(batches, 256):
            wholes, rest = [], []
            for row, doc_id, text in zip(rows["row"], rows["doc_id"], rows["text"], strict=True):
                words = (text or "").encode().lower().split()
                b, s, n = end_base, end_lattice, int(ends > 0)
                cold: Counter = Counter()
                for w, c in Counter(words).items():
                    if (hit := known.get(w)) is None:
                        cold[w] = c
                    else:
                        b, s, n = b + c * hit[0], s + c * hit[1], n + c
                wholes.append((row, doc_id, len(words) + 1, n, b, s))
                rest += [(row, w, c) for w, c in cold.items()]
            n = len(wholes)
            row, ids, size, hits, b, s = (list(x) for x in zip(*wholes, strict=True)) if wholes else ([], [], [], [], [], [])
            cold_row, words, c = (list(x) for x in zip(*rest, strict=True)) if rest else ([], [], [])
            m = len(cold_row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + cold_row, pa.int64()), pa.array(ids + [None] * m, pa.int64()), pa.array([None] * n + words, pa.binary()).cast(pa.string()), pa.array([0] * n + c, pa.int64()), pa.array(size + [None] * m, pa.int64()), pa.array(hits + [None] * m, pa.int64()), pa.array(b + [None] * m, pa.float64()), pa.array(s + [None] * m, pa.float64())],
                ["row", "doc_id", "word", "c", "n_tokens", "known", "b", "s"],
            )

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = cut(texts.mapInArrow(read, "row long, doc_id long, word string, c long, n_tokens long, known long, b double, s double"), "lattice-parts")
    rare = parts.filter(F.col("word").isNotNull()).select("row", "word", "c").join(table.filter(~is_hot).select("word", "n", "base", "lattice"), "word")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("c")).otherwise(0)).alias("known"), F.sum(F.col("c") * F.col("base")).alias("b"), F.sum(F.col("c") * F.col("lattice")).alias("s"))
    whole = parts.filter(F.col("word").isNull()).select("row", "doc_id", "n_tokens", "known", "b", "s").unionByName(rare, allowMissingColumns=True)
    sums = whole.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("b").alias("base_score"), F.sum("s").alias("score"))
    return sums.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
