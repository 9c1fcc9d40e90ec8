"""Mask search, hard negatives and prefix counts against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roundwise.llm import coordinate_negatives as N
from roundwise.llm import mask_search, prefix_counts
from roundwise.llm import queries as Q
from tests.llm.helpers import SF, awkward, clashing, documents, empty, texts

WORDS = public_tokenizers.path(Q.WORD_FILE)
ITEMS = "item_id long, text string"

# mask search


def test_terms_of_long_texts_are_whole(monkeypatch):
    text = "Ab1 é-漢 x" * 900 + " _ " + "y" * 5000
    monkeypatch.setattr(mask_search, "WORD_BYTES", 50)
    assert [t.decode() for part in mask_search.terms_of(text) for t in part] == plain_terms(text)


def plain_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_search(docs, items, k=10):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc_id, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, doc_id, -neg) for r, (neg, _, _, doc_id) in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("make", [awkward, lambda s: clashing(awkward(s))])
def test_mask_search_of_awkward_rows(spark, make):
    items = [(1, "The quick FOX, a hill"), (1, "idiot fox"), (2, None), (3, "... !"), (None, "vier fünf 漢字"), (5, "zzz"), (6, "the the word of")]
    docs = make(spark)
    got = mask_search.search(docs, spark.createDataFrame(items, ITEMS))
    assert found(got) == brute_search(texts(docs), items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_mask_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    assert mask_search.search(empty(spark), items).count() == 0
    assert mask_search.search(awkward(spark), items.limit(0)).count() == 0


@pytest.mark.parametrize("block_terms, chunk_docs", [(1 << 17, 8192), (60, 16)])
def test_mask_search_over_many_blocks_and_chunks(spark, block_terms, chunk_docs):
    docs = documents(spark).repartition(3)
    items = Q.table(spark, SF, "benchmark").limit(6)
    assert found(mask_search.search(docs, items, 4, block_terms, chunk_docs)) == brute_search(texts(docs), [tuple(r) for r in items.collect()], k=4)


def test_mask_search_with_more_than_64_terms_ties_and_copies():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(150)]
    docs = [(rng.randrange(50), " ".join(rng.sample(vocab, rng.randrange(1, 90)))) for _ in range(60)]
    docs += [(100 + i, "w1 w2 w3") for i in range(40)]  # a third of all rows ties
    rng.shuffle(docs)
    numbers = {t.encode(): i for i, t in enumerate(vocab)}
    counted = [Counter(plain_terms(t)) for _, t in docs]
    total = sum(sum(c.values()) for c in counted)
    df = Counter(t for c in counted for t in c)
    weights = np.array([mask_search.term_weight(len(docs), df[t]) for t in vocab])
    place = [(i, numbers[t.encode()], n) for i, c in enumerate(counted) for t, n in c.items()]
    at, terms, tfs = map(np.array, zip(*place))
    lengths = np.array([sum(c.values()) for c in counted])
    chunk = mask_search.Chunk(np.array([i for i, _ in docs]), lengths, at, terms, tfs, len(docs), total)
    for wanted in (vocab, vocab[:3], vocab[10:80]):
        ranking = mask_search.Ranking(7)
        numbered = np.sort([numbers[t.encode()] for t in wanted])
        seen = mask_search.search_chunk(chunk, np.zeros(len(docs), bool), numbered, weights[numbered], ranking)
        want = brute_search(docs, [(0, " ".join(wanted))], 7)
        assert sorted((s, i) for s, i in zip(ranking.scores.tolist(), ranking.ids.tolist())) == sorted((s, i) for _, _, i, s in want)
        assert seen <= len(docs)


def test_mask_search_leaves_masks_out():
    """Masks whose bound is below the k-th score are not evaluated."""
    docs, terms = np.repeat(np.arange(1000), 2), np.zeros(2000, np.int64)
    terms[1::2] = np.where(np.arange(1000) < 20, 1, 2)
    chunk = mask_search.Chunk(np.arange(1000), np.full(1000, 2), docs, terms, np.ones(2000, np.int64), 1000, 2000)
    ranking = mask_search.Ranking(10)
    assert mask_search.search_chunk(chunk, np.zeros(1000, bool), np.arange(3), np.array([5, 900, 3]), ranking) == 20
    assert ranking.ids.tolist() == list(range(10))


# hard negatives


def brute_negatives(rows, is_anchor, k=5):
    ready = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (vec_id, tuple(math.floor(256 * x) for x in vector), label)
        if row not in ready:
            ready.append(row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a in ready:
        if a[0] is None or not is_anchor(a[0]):
            continue
        others = [(dot(a[1], b[1]), b[0], b[2]) for b in ready if b is not a]
        for ps, positive, _ in sorted((o for o in others if o[2] == a[2]), key=order)[:k]:
            near = sorted((o for o in others if o[2] != a[2] and 80 * ps <= 100 * o[0] <= 100 * ps), key=order)[:k]
            out += [(a[0], positive, r + 1, negative, ps, ns) for r, (ns, negative, _) in enumerate(near)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, norm string, v string, score string"


def negatives(spark, rows, every=10, parts=3, **sizes):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS).repartition(parts)
    return found(N.hard_negatives(df, F.col("vec_id") % every == 0, **sizes))


def made_vectors(n, dims, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (4, dims))
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.1, dims)).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    return rows + [(1000 + i, rows[0][1], i % 2) for i in range(copies)]


@pytest.mark.parametrize("bucket, focus, pieces", [(1024, 4, 8), (7, 2, 1), (16, 9, 1)])
def test_negatives_match_brute_force(spark, bucket, focus, pieces):
    rows = made_vectors(120, 8, 3, copies=60)  # copies of one vector are a third of all rows
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert negatives(spark, rows, bucket_rows=bucket, focus=focus, block_anchors=pieces) == want and len(want) > 50


def test_negatives_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.9, 0.4], 2), (2, [0.9, 0.4], 2), (2, [0.8, 0.4], 1), (None, [0.9, 0.45], 2), (None, [0.9, 0.45], 1),
        (3, None, 1), (4, [1.0, None], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 1), (7, [1.0, 1.0], None), (8, [], 2), (9, [0.95], 2), (10, [0.0, 0.0], 1), (20, [-1.0, -1.0], 1), (30, [], 3),
        (40, [1.0, 1.0, 1.0], 5),
    ]
    assert negatives(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert negatives(spark, rows, parts=1) == negatives(spark, rows, parts=5)
    assert negatives(spark, []) == [] and negatives(spark, [(5, [1.0], 1)]) == [] and negatives(spark, [(0, [1.0], 1)]) == []


def test_negatives_of_large_components_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.float32(rng.normal(0, 1, 4) * 3e5).tolist(), i % 2) for i in range(40)]
    assert negatives(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="beyond 64 bits"):
        negatives(spark, [(0, [1e15, 1e15], 0), (1, [1e15, 1e15], 0)])


def test_coordinate_ranges_lose_nothing_and_prune():
    """Candidates hold every vector that reaches the threshold, and far fewer than all."""
    rng = np.random.default_rng(7)
    vectors = np.floor(rng.normal(0, 40, (500, 6)))
    norms = np.sqrt((vectors**2).sum(axis=1))
    shares = vectors / norms[:, None]
    places = np.argsort(shares, axis=0)
    row = {"label": 0, "longest": norms.max(), "shortest": norms.min(), "dims": 6, "ids": np.arange(500).tobytes(), "missing": np.zeros(500, bool).tobytes(), "vectors": vectors.tobytes()}
    bucket = N.Bucket(row | {"shares": np.ascontiguousarray(np.take_along_axis(shares, places, 0).T).tobytes(), "places": np.ascontiguousarray(places.T.astype(np.int32)).tobytes()})
    pruned = 0
    for v in vectors[:40]:
        query = N.Query(-1, 1, v)
        scores = vectors @ v
        for least in (-5000.0, 0.0, np.sort(scores)[-5], scores.max() + 1):
            kept = bucket.candidates(query, float(least))
            assert set(np.flatnonzero(scores >= least)) <= set(kept)
            pruned += 500 - len(kept)
    assert pruned > 20_000


@pytest.mark.parametrize("score", [0, 1, 4, 5, 99, 100, 101, 12345, -1, -7])
def test_bands_hold_the_stated_scores(score):
    low, top = N.band(score)
    for s in range(-20, 13000):
        assert (low <= s <= top) == (80 * score <= 100 * s <= 100 * score)


# prefix counts


def library_counts(strings):
    coder = Tokenizer.from_file(WORDS)
    return [len(e.ids) for e in coder.encode_batch(list(strings), add_special_tokens=False)]


AWKWARD = [
    "Hello wOrld's <|endoftext|>x", "a <|ENDOFTEXT|> b", "'re 'r <|start 'll'v 've''s 'st '", "é́ ẹ́x 각 Å", "a\x1cb \x1f", "a\x85b​c\xa0d　",
    "ΑΣ İ ǅ '́ <|end", "!!'re!'<|startoftext|>́'ll 12ab34 don't I'LL", "\U0001f600\U0001f600\U0001f602" * 9 + " 漢字漢字", "ha" * 150, "ñ" * 50, "é" * 30, "<|endoftext|<|endoftext|><|endoftext|>", "", " \t\n",
]


@pytest.mark.parametrize("text", AWKWARD)
def test_every_prefix_counts_as_the_library_counts_it(text):
    counts = np.concatenate(list(prefix_counts.prefix_counts(prefix_counts.vocabulary(WORDS), text)))
    assert counts.tolist() == library_counts(text[:i] for i in range(len(text) + 1))


def test_prefixes_of_random_texts():
    rng = random.Random(2)
    letters = "aé'’ sStTlLrevd.<|>́ 12가漢ßỊ̇ᅡ"
    words = prefix_counts.vocabulary(WORDS)
    for i in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) + "<|endoftext|>" * (i % 5 == 0) + "'s"
        counts = np.concatenate(list(prefix_counts.prefix_counts(words, text)))
        assert counts.tolist() == library_counts(text[:i] for i in range(len(text) + 1)), text


def test_prefix_table_answers_without_encoding(spark):
    rows = [(i, t) for i, t in enumerate(AWKWARD[:-4])] + [(90, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = [(i, n) for i, t in rows for n in range(0, len(t or "") + 3, 2)]
    table = prefix_counts.prefix_table(docs, WORDS, 7).collect()
    assert max(len(r.counts) for r in table) == 7
    table = spark.createDataFrame(table, "doc_id long, part long, least int, counts array<int>")
    by_id = {i: t or "" for i, t in rows}
    got = {(r.doc_id, r.n_chars): r.n_tokens for r in prefix_counts.counts_at(table, spark.createDataFrame(asked, "doc_id long, n_chars long"), 7).collect()}
    inside = [(i, n) for i, n in asked if n <= len(by_id[i])]
    assert got == dict(zip(inside, library_counts(by_id[i][:n] for i, n in inside)))
    budgets = spark.createDataFrame([(i, b) for i in by_id for b in (0, 1, 3, 1000)], "doc_id long, budget long")
    for r in prefix_counts.longest_within(table, budgets, 7).collect():
        text = by_id[r.doc_id]
        assert r.n_chars == max(n for n, c in enumerate(library_counts(text[:n] for n in range(len(text) + 1))) if c <= r.budget)


@pytest.mark.parametrize("make", [awkward, documents, lambda s: clashing(awkward(s))])
def test_token_counts_of_tables(spark, make):
    docs = make(spark)
    rows = texts(docs)
    coder = Tokenizer.from_file(WORDS)
    want = []
    for (doc_id, text), n in zip(rows, library_counts(t for _, t in rows)):
        want.append((doc_id, len(text.encode()), n, n > 900))
    got = prefix_counts.token_counts(docs, WORDS, limit=900).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(want)
    by_id = {i: t for i, t in rows if i is not None}
    for r in got:
        if r.over_limit and r.doc_id is not None:
            text = by_id[r.doc_id]
            sizes = {d: len(coder.encode(text[: r.limit_chars + d], add_special_tokens=False).ids) for d in (0, 1)}
            assert sizes[0] <= 900 < sizes[1]
        else:
            assert r.over_limit or r.doc_id is None or r.limit_chars == len(by_id[r.doc_id])


def test_token_counts_of_long_and_empty_texts(spark):
    assert prefix_counts.token_counts(empty(spark), WORDS).count() == 0
    assert prefix_counts.prefix_table(empty(spark), WORDS).count() == 0
    long = "wörter und words " * 40_000 + "x" * 3000
    row = prefix_counts.token_counts(spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string"), WORDS).first()
    assert row.n_tokens == library_counts([long])[0] and row.over_limit and row.n_bytes == len(long.encode())


def test_vocabulary_of_another_kind_is_refused():
    with pytest.raises((ValueError, KeyError)):
        prefix_counts.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
