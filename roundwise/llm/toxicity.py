"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. Windows of a text (tokens with
look-alike signs or drawn-out letters, spaced-out letters, words around a separator or
with a doubled letter) become lattices of the characters they may stand for, with arcs
that delete separators and shrink repeated letters; Viterbi decoding under the character
model restores the likeliest reading. Which separators and doubled letters open a window
is decided by the same model: the gain of one such arc depends on four letters only, and is
computed for all of a text at once. The restored text is scored by learnt evidence: character 5-grams that
are surely more frequent in toxic than in other labelled texts (lower confidence bound of
the log ratio), strongest distinct evidence first, mapped to a probability by logistic
regression.

The classifier is fitted on at most about ``SAMPLE`` labelled rows, chosen by hash; the
character model and the scoring cover all texts whole. Labels, language, source and id are
never inputs of a score.

Defined cases: a null text is empty and gets the score of a text without evidence; missing
labels are no labels; without any usable label every score is 0; repeated rows get equal
scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundwise.llm.ngrams import SYMBOLS, chunks, codes_of, hashed, symbols
from roundwise.llm.shared import cut, slices

SAMPLE = 20_000
ORDER = 5
BITS = 20
CONFIDENCE = 3.0
STRONGEST = 6
THRESHOLD = 0.3
# What a sign may stand for, besides itself.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "×": "x", "*": "aeiou", "#": "h", "%": "x",
}
CHANGE, KEEP, SHRINK, JOIN = -1.0, -6.0, -0.7, -1.0
# A deleted separator between fragments and a letter doubled once are common in clean text.
DELETE, DOUBLE = -5.5, -5.0
# Between single letters it is the separator that is unusual.
APART = -3.0
LONGEST_GAP = 3
LONGEST_KEPT = 256
TRAIL = ".,;:!?\"'()[]{}<>*%&#|+-_~`"
ORNAMENT = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")
SIGNS = frozenset(LOOKALIKES)
DRAWN = re.compile(r"([^\W\d_])\1\1")
ONE = rf"(?:[^\W_]|[{re.escape("".join(c for c in LOOKALIKES if not c.isalnum()))}])"
SPACED = re.compile(rf"(?<![^\W_]){ONE}(?:[\W_]{{1,{LONGEST_GAP}}}?{ONE}(?![^\W_])){{2,}}")
RUNS = re.compile(rf"[^\w{re.escape(''.join(LOOKALIKES))}]+|_+|(.)\1*", re.S)


@functools.lru_cache(maxsize=1 << 16)
def letters_of(piece: str) -> tuple[int, ...]:
    return tuple(symbols(piece)[1:-1].tolist())


class Reader:
    """Restores obfuscated text under a character trigram table (log probabilities)."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.cells = memoryview(np.ascontiguousarray(table).ravel())
        self.read_short = functools.lru_cache(maxsize=1 << 17)(self._read)

    def read(self, token: str) -> tuple[float, str]:
        return self.read_short(token) if len(token) <= LONGEST_KEPT else self._read(token)

    def _read(self, token: str) -> tuple[float, str]:
        """The likeliest letters behind a token and their log probability, boundaries
        included: exact Viterbi over the lattice, with the last two symbols as state. A
        state points back to the one it came from, so time and memory grow with the token."""
        runs = [(m[1] or m[0], len(m[0]), m[1] is None) for m in RUNS.finditer(token.lower())]
        single = [not gap and n == 1 and (i == 0 or runs[i - 1][2]) and (i + 1 == len(runs) or runs[i + 1][2]) for i, (_, n, gap) in enumerate(runs)]
        cells = self.cells
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i, (c, n, gap) in enumerate(runs):
            if gap:
                inner = 0 < i < len(runs) - 1
                spelled = inner and single[i - 1] and single[i + 1]
                options = [(c, APART if spelled else 0.0)]
                if inner and n <= LONGEST_GAP:
                    options.append(("", JOIN if spelled else DELETE))
            else:
                options = [(c * n, KEEP if c in SIGNS else 0.0)]
            if not gap and (n > 2 or n == 2 and c in SIGNS):
                options += [(c, SHRINK), (c * 2, SHRINK)] if n > 2 else [(c, SHRINK)]
            elif not gap and n == 2:
                options.append((c, DOUBLE))
            for other in LOOKALIKES.get(c, ""):
                options += [(other * k, CHANGE * (1 if k == n else 1.5)) for k in {1, min(n, 2)}]
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for piece, cost in options:
                coded = (0,) * bool(piece) if gap else letters_of(piece)
                for (p, q), (score, back) in states.items():
                    s = score + cost
                    for x in coded:
                        s += cells[(p * SYMBOLS + q) * SYMBOLS + x]
                        p, q = q, x
                    if (p, q) not in after or s > after[p, q][0]:
                        after[p, q] = (s, (back, piece))
            states = after
        score, back = max(((score + cells[(p * SYMBOLS + q) * SYMBOLS], back) for (p, q), (score, back) in states.items()), key=lambda x: x[0])
        pieces = []
        while back:
            back, piece = back
            pieces.append(piece)
        return score, "".join(reversed(pieces))

    def token(self, token: str) -> str:
        core = ORNAMENT.sub("", token.strip(TRAIL))
        if len(core) < 2 or core.isalpha() and not DRAWN.search(core) or not any(c.isalpha() for c in core):
            return token
        return token.replace(core, self.read(core)[1], 1)

    def spelled(self, m: re.Match) -> str:
        """A spaced-out run with the separators deleted that its likeliest reading has not."""
        letters = sum(c.isalpha() for c in m[0])
        if letters < 2 or 2 * letters < sum(c.isalnum() or c in SIGNS for c in m[0]):
            return m[0]
        return self.read(m[0])[1]

    def windows(self, text: str) -> list[tuple[int, int]]:
        """(start, stop) of words to be read together: those around separators, or with
        doubled letters, that the character model would rather not have."""
        sym = symbols(text)
        at = np.flatnonzero(sym)
        if len(at) < 3:
            return []
        step = np.diff(at)
        table = self.table
        gaps = np.flatnonzero((step > 1) & (step <= LONGEST_GAP + 1))
        x, y, c, d = sym[at[gaps] - 1], sym[at[gaps]], sym[at[gaps + 1]], sym[at[gaps + 1] + 1]
        gain = table[x, y, c] + table[y, c, d] - table[x, y, 0] - table[y, 0, c] - table[0, c, d]
        joined = [k for k in gaps[gain + DELETE > 0].tolist() if not any(z.isalnum() for z in text[at[k] : at[k + 1] - 1])]
        twice = np.flatnonzero((step == 1) & (sym[at[1:]] == sym[at[:-1]]))
        x, y, d = sym[at[twice] - 1], sym[at[twice]], sym[at[twice + 1] + 1]
        gain = table[x, y, d] - table[x, y, y] - table[y, y, d]
        doubled = twice[gain + DOUBLE > 0].tolist()
        if not joined and not doubled:
            return []
        ends = [*np.flatnonzero(step > 1).tolist(), len(at) - 1]
        spans: list[list[int]] = []
        for k in sorted({*joined, *doubled}):
            first = bisect.bisect_left(ends, k)
            last = first + 1 if ends[first] == k else first
            start, stop = int(at[ends[first - 1] + 1] if first else at[0]) - 1, int(at[ends[last]])
            if spans and start < spans[-1][1]:
                spans[-1][1] = max(stop, spans[-1][1])
            else:
                spans.append([start, stop])
        return [(a, b) for a, b in spans]

    def restore(self, text: str) -> str:
        """A whole text with its obfuscated windows restored; other text is unchanged."""
        out, done = [], 0
        for m in SPACED.finditer(text):
            # what is spelled out is read once, apart from the words around it
            out += [self.words(text[done : m.start()]), self.spelled(m)]
            done = m.end()
        return "".join(out) + self.words(text[done:])

    def words(self, text: str) -> str:
        """A text without spaced-out letters, restored."""
        text = self.tokens(text)
        out, done = [], 0
        for start, stop in self.windows(text):
            read = self.read(text[start:stop])[1]
            out += [text[done:start], text[start:stop] if read == text[start:stop].lower() else read]
            done = stop
        return "".join(out) + text[done:]

    def tokens(self, text: str) -> str:
        """A text with tokens of look-alikes or drawn-out letters restored."""
        drawn = DRAWN.search(text) is not None
        if not drawn and text.isalpha():
            return text
        words = text.split(" ")
        for i, w in enumerate(words):
            if w.isalpha():
                if drawn and DRAWN.search(w):
                    words[i] = self.token(w)
            elif not (core := w.strip(TRAIL)).isalpha() and core and (not SIGNS.isdisjoint(core) or drawn and DRAWN.search(core)):
                words[i] = " ".join(self.token(x) for x in w.split("\n"))
        return " ".join(words)


def count_trigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of symbol trigrams of a partition: one dense table, sent once."""
    counts = np.zeros(SYMBOLS**3, np.int64)
    for rows in slices(batches, 256):
        for text in rows["text"]:
            for chunk in chunks(text or "", 2):
                codes = codes_of(symbols(chunk), 3)
                if len(codes) > SYMBOLS**2:
                    counts += np.bincount(codes, minlength=SYMBOLS**3)
                else:
                    np.add.at(counts, codes, 1)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["code", "n"])


def trigram_table(docs: DataFrame) -> np.ndarray:
    """Log P(symbol | two before), interpolated; at most SYMBOLS**3 counts are gathered."""
    rows = docs.select("text").mapInArrow(count_trigrams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3)
    counts[rows["code"].to_numpy()] = rows["n"].to_numpy()
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def evidence_codes(text: str) -> np.ndarray:
    return np.concatenate([hashed(codes_of(symbols(c), ORDER), BITS) for c in chunks(text, ORDER)])


def drawn_signals(found: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """From the evidence in a text: the sum of the strongest weights, and the number of
    distinct pieces."""
    hit = np.unique(found[weights[found] > 0])
    strongest = np.sort(weights[hit])[::-1][:STRONGEST]
    return float(strongest.sum()), math.log1p(len(hit))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Model:
    """What scoring needs: trigram table, evidence weights, regression coefficients."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, beta: np.ndarray) -> None:
        self.table, self.weights, self.beta = table, weights, beta

    def score(self, reader: Reader, text: str | None) -> float:
        if self.beta is None:
            return 0.0
        strength, n = drawn_signals(evidence_codes(reader.restore(text or "")), self.weights)
        return float(1 / (1 + math.exp(-float(self.beta @ np.array([1.0, strength, n])))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps until the step is small."""
    beta, step = np.zeros(x.shape[1]), np.inf
    penalty = ridge * len(y) * np.diag([0.0, *([1.0] * (x.shape[1] - 1))]) + 1e-9 * np.eye(x.shape[1])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.logaddexp(0, z).sum() - y @ z + b @ penalty @ b / 2)

    while np.abs(step).max() > 1e-8:
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-8:
            step = step / 2
        beta = beta + step
    return beta


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows that ``usable`` (a condition on doc_id) admits."""
    spark = docs.sparkSession
    table = trigram_table(docs)
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n == 0:
        return Model(table, np.zeros(1 << BITS, np.float32), None)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n)))
    shared = spark.sparkContext.broadcast(table)
    # one text for each chosen doc_id, however often it occurs: the sample bounds the rows
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    labelled = cut(found.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text"), "toxicity-sample")

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        df = np.zeros((2, 1 << BITS), np.int32)
        total = np.zeros(2, np.int64)
        for rows in slices(batches):
            for toxic, text in zip(rows["toxic"], rows["text"], strict=True):
                df[toxic, np.unique(evidence_codes(reader.restore(text or "")))] += 1
                total[toxic] += 1
        seen = np.flatnonzero(df.any(axis=0))
        code = np.concatenate([[-1], seen])
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.concatenate([total[:1], df[0, seen]])), pa.array(np.concatenate([total[1:], df[1, seen]]))], ["code", "clean", "toxic"])

    counted = labelled.mapInArrow(frequencies, "code long, clean long, toxic long").groupBy("code").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter("code < 0 or toxic > 1").toArrow()
    code, clean, toxic = (counted[c].to_numpy() for c in ("code", "clean", "toxic"))
    totals = code < 0
    n_clean, n_toxic = clean[totals].sum(), toxic[totals].sum()
    weights = np.zeros(1 << BITS, np.float32)
    clean, toxic, code = clean[~totals] + 0.5, toxic[~totals] + 0.5, code[~totals]
    ratio = np.log(toxic / (n_toxic + 1)) - np.log(clean / (n_clean + 1))
    weights[code] = np.maximum(0, ratio - CONFIDENCE * np.sqrt(1 / toxic + 1 / clean))
    evidence = spark.sparkContext.broadcast(weights)

    def signals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for rows in slices(batches):
            got = [drawn_signals(evidence_codes(reader.restore(t or "")), evidence.value) for t in rows["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(rows["toxic"], pa.int32()), pa.array([a for a, _ in got], pa.float64()), pa.array([b for _, b in got], pa.float64())], ["toxic", "strength", "n"])

    # at most as many rows as the sample has; sorted, so that sums do not depend on their order
    data = labelled.mapInArrow(signals, "toxic int, strength double, n double").toArrow().sort_by([(c, "ascending") for c in ("strength", "n", "toxic")])
    x = np.column_stack([np.ones(data.num_rows), data["strength"].to_numpy(), data["n"].to_numpy()])
    return Model(table, weights, logistic(x, data["toxic"].to_numpy().astype(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value.table)
        for rows in slices(batches):
            scores = [shared.value.score(reader, t) for t in rows["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, columns unchanged."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(shared.value.table)
        for batch in texts:
            yield batch.map(lambda t: shared.value.score(reader, t))

    return docs.filter(toxic("text") < threshold)
