"""Exact token counts of every prefix of a text, by dynamic programming over byte pairs.

The merges of a byte-pair vocabulary decide locally: a row of tokens is the encoding of
its text exactly if every token encodes itself and no merge crosses the border of two
neighbours. So the encoding of a word's first k bytes ends in the only token that
matches there and may follow the last token of the shorter prefix before it, and one
walk over a word gives the counts of all its prefixes. Words end in white space, hence
the counts of a text are those of its words on top of each other: ``prefix_table``
stores them, ``counts_at`` and ``longest_within`` answer from the table and never encode
again. Rows of the table hold ``PART_CHARS`` prefixes at most, however long the text.

A prefix is counted as the text it is: a cut word gets the end-of-word token that the
library gives it, a cut contraction falls apart, a cut special string is ordinary text,
and a combining mark joins its letter only when it is there.

Defined cases: a null text is empty and has no tokens; strings of special tokens count as
one token, as the library's default has it; repeated rows give repeated rows; a doc_id may
be null; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roundwise.llm.shared import slices

TOKEN_LIMIT = 2048
PART_CHARS = 1 << 16
ROWS_AT_ONCE = 128
KEPT_WORDS = 1_000_000
KEPT_PAIRS = 2_000_000
LONGEST_KEPT = 64
END = "</w>"
# The split pattern and normaliser of the supported vocabulary files, and
# the contractions of that pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
NOT_SPACE = re.compile("[^\t-\r \x85\xa0  -     　]+")
SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for str.split, but not for the pattern
ASCII_RUNS = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")
OPENINGS = frozenset(c[:2] for c in CONTRACTIONS if len(c) == 3)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    signs for themselves, the others by the letters from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@functools.cache
def joining_marks() -> frozenset[str]:
    """Characters that may join what stands before them: marks, second halves of canonical
    compositions, and the vowels and finals of Hangul syllables."""
    seconds = set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    for point in range(0x110000):
        parts = unicodedata.decomposition(chr(point)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
        if unicodedata.combining(chr(point)):
            seconds.add(chr(point))
    return frozenset(seconds)


Node = tuple[dict[int, "Node"], int | None]


class Vocabulary:
    """Tokens as tries of reversed byte strings, for those inside a word and those at its
    end, and which token may follow which. A trie node is (children, token)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or kinds != NORMALIZERS or split[:1] != [PATTERN]:
            raise ValueError(f"{path} is no byte-pair vocabulary with word ends and the supported split")
        self.library = Tokenizer.from_file(path)
        self.specials = re.compile("|".join(sorted((re.escape(t["content"]) for t in spec["added_tokens"]), reverse=True)) or "(?!)")
        ids, letters = model["vocab"], byte_letters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(ids[a], ids[b]): i for i, (a, b) in enumerate(pairs)}
        made = {ids[a + b]: (i, ids[a], ids[b]) for i, (a, b) in enumerate(pairs)}
        # the tokens at each side of a token while it is built, with the rank that uses them up
        self.right = {t: [(t, len(pairs))] for t in ids.values()}
        self.left = {t: [(t, len(pairs))] for t in ids.values()}
        alone = set(ids.values()) - set(made)
        for token, (i, a, b) in made.items():
            self.right[token] = [(token, len(pairs)), (b, i), *self.right[b][1:]]
            self.left[token] = [(token, len(pairs)), (a, i), *self.left[a][1:]]
            if a in alone and b in alone and not self._crossed(a, b, i):
                alone.add(token)
        self.inside: Node = ({}, None)
        self.ending: Node = ({}, None)
        for text, token in ids.items():
            if token in alone:
                closed = text.endswith(END) and len(text) > len(END)
                above, node = None, self.ending if closed else self.inside
                path = [letters[x] for x in reversed(text.removesuffix(END) if closed else text)]
                for byte in path:
                    above, node = node, node[0].setdefault(byte, ({}, None))
                above[0][path[-1]] = (node[0], token)
        # any token may start a word
        self.first = dict.fromkeys(alone, True)
        self.following: dict[int, dict[int, bool]] = {token: {} for token in alone}
        self.n_pairs = 0
        self.totals: dict[str, int] = {}
        self.runs: dict[str, int] = {}
        self.kinds: dict[str, tuple[str, str]] = {}

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of a rank under ``before`` joins the end of a to the start of b."""
        for x, used_x in self.right[a]:
            for y, used_y in self.left[b]:
                r = self.rank.get((x, y))
                # of equal merges the left one goes first
                if r is not None and r < before and r < used_x and r <= used_y:
                    return True
        return False

    def may_follow(self, a: int, b: int) -> bool:
        """Decides and keeps a pair that ``following`` does not hold yet."""
        if self.n_pairs >= KEPT_PAIRS:
            for known in self.following.values():
                known.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        known = self.following[a][b] = not self._crossed(a, b, len(self.rank))
        return known

    def shown(self, char: str) -> tuple[str, str]:
        """A composed character as the library lower-cases it, and the kinds of its letters."""
        known = self.kinds.get(char)
        if known is None:
            low = self.library.normalizer.normalize_str(char)
            split = self.library.pre_tokenizer.pre_tokenize_str
            known = self.kinds[char] = low, "".join("L" if len(split("a" + c)) == 1 else "O" if len(split("!" + c)) == 1 else "N" for c in low)
        return known

    def _keep(self, known: dict[str, int], word: str, count: int) -> None:
        if len(word) <= LONGEST_KEPT:
            if len(known) >= KEPT_WORDS:
                known.clear()
            known[word] = count

    def run_total(self, run: str) -> int:
        """Tokens of one match of the split pattern (lower case)."""
        known = self.runs.get(run)
        if known is None:
            walk = Run(self)
            walk.add(run)
            known = walk.ended()
            self._keep(self.runs, run, known)
        return known

    def run_counts(self, run: str) -> Iterator[int]:
        """Counts of all prefixes of one match of the split pattern."""
        walk = Run(self)
        for char in run:
            walk.add(char)
            yield walk.ended()

    def total(self, word: str) -> int:
        """Tokens of a word without white space."""
        known = self.totals.get(word)
        if known is None:
            runs = self._runs(word)
            known = sum(map(self.run_total, runs)) if runs is not None else deque(self.word_counts(word), 1)[0]
            self._keep(self.totals, word, known)
        return known

    def word_counts(self, word: str) -> Iterator[int]:
        """Counts of all prefixes (of one code point or more) of a word without white space."""
        return self._walk(word) if self.specials.search(word) else self._plain(word)

    def _walk(self, word: str) -> Iterator[int]:
        base = at = 0
        for special in self.specials.finditer(word):
            # up to its last character a special string is ordinary text
            yield from (base + n for n in self._plain(word[at : special.end() - 1]))
            base += (self.total(word[at : special.start()]) if special.start() > at else 0) + 1
            yield base
            at = special.end()
        yield from (base + n for n in self._plain(word[at:]))

    def _runs(self, word: str) -> list[str] | None:
        """The matches of a composed word without apostrophe or special string, if each of
        its characters becomes one."""
        if word.isascii():
            low = word.lower()
            if low.isalpha():
                return [low]
            return None if "'" in word or self.specials.search(word) else ASCII_RUNS.findall(low)
        if not unicodedata.is_normalized("NFC", word) or "'" in word or self.specials.search(word):
            return None
        lows, kinds = zip(*map(self.shown, word))
        if len(low := "".join(lows)) != len(word):
            return None
        kinds = "".join(kinds)
        if kinds.count("L") == len(kinds):
            return [low]
        cuts = [i for i in range(1, len(word)) if kinds[i] != kinds[i - 1] or kinds[i] == "N"]
        return [low[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])]

    def _plain(self, word: str) -> Iterator[int]:
        """Counts of the prefixes of a word without special strings."""
        if not word:
            return
        runs = self._runs(word)
        if runs is not None:
            base = 0
            for run in runs:
                yield from (base + n for n in self.run_counts(run))
                base += self.run_total(run)
            return
        composed = unicodedata.is_normalized("NFC", word)
        reader = Reader(self)
        if composed:
            for char in word:
                reader.feed(char)
                yield reader.count()
            return
        start = 0
        while start < len(word):
            stop = start + 1
            while stop < len(word) and word[stop] in joining_marks():
                stop += 1
            for end in range(start + 1, stop + 1):
                mark = reader.mark()
                for char in unicodedata.normalize("NFC", word[start:end]):
                    reader.feed(char)
                yield reader.count()
                if end < stop:
                    reader.back_to(mark)
            start = stop


class Run:
    """The prefix table of one match: for each of its prefixes the last token, what is known
    of that token's followers, and the number of tokens, as long as the match goes on."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.data = vocabulary, bytearray()
        self.last, self.after, self.count = [None], [vocabulary.first], [0]

    def add(self, chars: str) -> None:
        data, last, after, count = self.data, self.last, self.after, self.count
        words = self.vocabulary
        inside, following = words.inside, words.following
        for byte in chars.encode("utf-8", "surrogatepass"):
            data.append(byte)
            at, node, tokens = len(data), inside, 0
            while at:
                at -= 1
                node = node[0].get(data[at])
                if node is None:
                    break
                token = node[1]
                if token is not None:
                    ok = after[at].get(token)
                    if ok or ok is None and words.may_follow(last[at], token):
                        tokens = count[at] + 1
                        break
            # the single bytes are tokens, so one is always found
            last.append(token)
            after.append(following[token])
            count.append(tokens)

    def ended(self) -> int:
        """Tokens of the prefix read so far, as a match that ends here."""
        at, node = len(self.data), self.vocabulary.ending
        while at:
            at -= 1
            node = node[0].get(self.data[at])
            if node is None:
                break
            token = node[1]
            if token is not None:
                ok = self.after[at].get(token)
                if ok or ok is None and self.vocabulary.may_follow(self.last[at], token):
                    return self.count[at] + 1
        return 0

    def shorten(self, size: int) -> None:
        del self.data[size:], self.last[size + 1 :], self.after[size + 1 :], self.count[size + 1 :]


class Reader:
    """The split pattern read character by character, with the count so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.base, self.kind, self.pending, self.run = 0, "", "", Run(vocabulary)

    def mark(self) -> tuple:
        return self.base, self.kind, self.pending, self.run, len(self.run.data)

    def back_to(self, mark: tuple) -> None:
        self.base, self.kind, self.pending, self.run, size = mark
        self.run.shorten(size)

    def feed(self, char: str) -> None:
        for low, kind in zip(*self.vocabulary.shown(char)):
            if self.pending:
                self._open(low, kind)
            else:
                self._next(low, kind)

    def _open(self, low: str, kind: str) -> None:
        """A character behind an apostrophe that starts a match."""
        seen, self.pending = self.pending, ""
        if seen + low in CONTRACTIONS:
            self.base += self.vocabulary.run_total(seen + low)
            self.kind = ""
        elif seen + low in OPENINGS:
            self.pending = seen + low
        else:
            self.kind, self.run = "O", Run(self.vocabulary)
            self.run.add("'")
            for letter in seen[1:]:
                self._next(letter, "L")
            self._next(low, kind)

    def _next(self, low: str, kind: str) -> None:
        if kind != self.kind or kind == "N":
            if self.kind:
                self.base += self.run.ended()
            self.run = Run(self.vocabulary)
            self.kind = kind
            if low == "'":
                self.kind, self.pending = "", low
                return
        self.run.add(low)

    def count(self) -> int:
        if self.pending:
            return self.base + sum(map(self.vocabulary.run_total, self.pending))
        return self.base + (self.run.ended() if self.kind else 0)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, once per worker."""
    return Vocabulary(path)


def words_of(text: str) -> list[str]:
    return SPACE.sub(" ", text).strip(" ").split(" ") if SEPARATORS.search(text) else text.split()


def count(words: Vocabulary, found: list[str]) -> int:
    """Tokens of a text with these words: the last entry of its prefix table."""
    try:
        return sum(map(words.totals.__getitem__, found))
    except KeyError:
        return sum(words.total(word) for word in found if word)


def prefix_counts(words: Vocabulary, text: str | None, part_chars: int = PART_CHARS) -> Iterator[np.ndarray]:
    """Counts of the prefixes of 0, 1, 2, ... code points, in parts of ``part_chars``."""
    text = text or ""
    part = np.zeros(min(part_chars, len(text) + 1), np.int32)
    base, filled = 0, 1  # the empty prefix has no tokens

    def put(values) -> Iterator[np.ndarray]:
        nonlocal part, filled
        done = 0
        while done < len(values):
            if filled == len(part):
                yield part
                part, filled = np.zeros(part_chars, np.int32), 0
            step = min(len(part) - filled, len(values) - done)
            part[filled : filled + step] = values[done : done + step]
            filled, done = filled + step, done + step

    at = 0
    for word in NOT_SPACE.finditer(text):
        yield from put(np.full(word.start() - at, base, np.int32))
        values = np.fromiter(words.word_counts(word.group()), np.int32)
        yield from put(values + base)
        base, at = base + int(values[-1]), word.end()
    yield from put(np.full(len(text) - at, base, np.int32))
    yield part[:filled]


def longest_prefix(words: Vocabulary, text: str | None, limit: int) -> int:
    """Code points of the longest prefix of at most ``limit`` tokens.

    Counts only fall within a word, so the prefix ends in the first word that passes the
    limit, or before it.
    """
    base = 0
    for word in NOT_SPACE.finditer(text or ""):
        total = words.total(word.group())
        if base + total > limit:
            inside = [i + 1 for i, n in enumerate(words.word_counts(word.group())) if base + n <= limit]
            return word.start() + max(inside, default=0)
        base += total
    return len(text or "")


def prefix_table(docs: DataFrame, path: str, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, part, least, counts): ``counts[i]`` are the tokens of the prefix of
    ``part * part_chars + i`` code points, ``least`` the smallest of the row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for rows in slices(batches, ROWS_AT_ONCE):
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                for i, part in enumerate(prefix_counts(words, text, part_chars)):
                    arrays = [pa.array([doc_id], pa.int64()), pa.array([i], pa.int64()), pa.array([int(part.min())], pa.int32()), pa.array([part], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "part", "least", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, part long, least int, counts array<int>")


def counts_at(table: DataFrame, asked: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, n_chars, n_tokens) for the prefixes in ``asked`` (doc_id, n_chars); lengths
    beyond the text get no row."""
    wanted = asked.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.floor(F.col("n_chars") / part_chars).alias("part"))
    inside = (F.col("n_chars") - F.col("part") * part_chars).cast("int")
    found = wanted.join(table.select("doc_id", "part", "counts"), ["doc_id", "part"])
    return found.withColumn("n_tokens", F.get("counts", inside)).where("n_tokens IS NOT NULL").select("doc_id", "n_chars", F.col("n_tokens").cast("long").alias("n_tokens"))


def longest_within(table: DataFrame, asked: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, budget, n_chars): the longest prefix of at most ``budget`` tokens for each
    row of ``asked`` (doc_id, budget)."""
    questions = asked.select("doc_id", F.col("budget").cast("long").alias("budget")).distinct()
    met = table.join(questions, "doc_id").where(F.col("least") <= F.col("budget"))
    back = F.array_position(F.reverse(F.transform("counts", lambda n: n <= F.col("budget"))), F.lit(True))
    last = F.col("part") * part_chars + F.size("counts") - back
    return met.groupBy("doc_id", "budget").agg(F.max(last).alias("n_chars"))


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, limit_chars): tokens of each whole text, and
    the longest prefix (code points) within the limit, answered where the counts are made."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for rows in slices(batches, ROWS_AT_ONCE):
            texts = [t or "" for t in rows["text"]]
            counts = [count(words, words_of(t)) for t in texts]
            kept = [longest_prefix(words, t, limit) if n > limit else len(t) for t, n in zip(texts, counts)]
            arrays = [pa.array(rows["doc_id"], pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts]), pa.array(kept, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")
