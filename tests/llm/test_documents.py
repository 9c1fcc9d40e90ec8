"""SpotSigs, BPE, exact dedup, SimHash, lattice scores and pseudonyms against plain code."""

from __future__ import annotations

import datetime
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from roundwise.llm import byte_bpe, components, lattice_lm, pseudonyms, simhash_balls, spotsigs, stream_dedup
from roundwise.llm import queries as Q
from tests.llm.helpers import LONG, SF, awkward, clashing, documents, empty, sort_key, texts

RANKS = public_tokenizers.path(Q.RANK_FILE)
KEY = b"test key"


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]


# SpotSigs


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (set(spotsigs.signature_set(t, frozenset(spotsigs.ANCHORS.encode().split())).tolist()) for t in (text, edited, following))
        near = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), near(a, b), near(a, c)))
    return sorted(out, key=sort_key)


@pytest.mark.parametrize("make", [awkward, documents, lambda s: clashing(awkward(s))])
def test_spotsigs_edits_and_neighbours(spark, make):
    docs = make(spark)
    got = spotsigs.fingerprint_with_edit(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=sort_key) == brute_edits(texts(docs))
    prints = {}
    by_id = dict(texts(docs))
    for r in got:
        assert prints.setdefault(by_id[r.doc_id], r.fingerprint) == r.fingerprint


def test_spotsigs_empty_and_single(spark):
    assert spotsigs.fingerprint_with_edit(empty(spark)).count() == 0
    one = spotsigs.fingerprint_with_edit(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


def test_spotsigs_chains():
    sigs = spotsigs.signature_set("At the Market, a trader sold old things", frozenset(b"at the a".split()))
    want = {b" market trader", b"at market trader", b"the market trader", b"a trader sold"}
    assert set(sigs.tolist()) == {xxhash.xxh32_intdigest(w) for w in want}


def test_spotsigs_pruned_join_finds_all_pairs(spark):
    docs = documents(spark)
    members, pairs = spotsigs.near_duplicate_classes(docs, 0.5)
    sets = {i: frozenset(spotsigs.signature_set(t, frozenset(spotsigs.ANCHORS.encode().split())).tolist()) for i, t in texts(docs)}
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    assert {(r.doc_id, r.class_id) for r in members.collect()} == {(i, least[s]) for i, s in sets.items()}
    want = {frozenset((x, y)) for (s, x), (t, y) in itertools.combinations(least.items(), 2) if s and t and len(s & t) / len(s | t) >= 0.5}
    assert {frozenset((r.class_a, r.class_b)) for r in pairs.collect()} == want and want
    groups = {r.doc_id: r.group_id for r in spotsigs.near_duplicate_groups(docs, 0.5).collect()}
    assert all(groups[a] == groups[b] for a, b in map(tuple, want))


# byte-level BPE


def test_bpe_equals_library_and_decodes(spark):
    docs = clashing(documents(spark).unionByName(awkward(spark)))
    coder = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    want = []
    for i, t in texts(docs):
        ids = coder.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted(map(tuple, got.collect()), key=sort_key) == sorted(want, key=sort_key)
    decoded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert Counter(bytes(r.bytes) for r in decoded.collect()) == Counter(t.encode() for _, t in texts(docs))
    assert byte_bpe.round_trip(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", ["ab  cd\n\n e  ", LONG, "x" * 3000, " a1'll  <|endoftext|> \x1c z", "word " * 50 + "　 " * 9])
def test_bpe_pieces_are_safe(text):
    coder = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for size in (1, 2, 7, 100):
        pieces = list(byte_bpe.safe_pieces(text, size))
        assert "".join(pieces) == text
        assert [x for p in pieces for x in coder.encode_ordinary(p)] == coder.encode_ordinary(text)
    assert isinstance(coder, tiktoken.Encoding)


# exact dedup


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def check_dedup(docs, **how):
    rows = texts(docs)
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    got = stream_dedup.deduplicate(docs, **how).collect()
    want = Counter((i, max((x for x in groups[lowered(t)] if x is not None), default=None), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("make", [awkward, documents])
def test_stream_dedup(spark, make):
    check_dedup(make(spark))
    docs = clashing(make(spark))
    stays = stream_dedup.distinct_documents(docs)
    assert stays.columns == docs.columns
    assert stays.count() == len({lowered(t) for _, t in texts(docs)})


def test_stream_dedup_compares_bytes_when_digests_collide(spark):
    check_dedup(awkward(spark), digest=lambda body: F.lit("same"))
    check_dedup(documents(spark), digest=lambda body: F.length(body).cast("string"))


def test_stream_dedup_state_goes_on(spark, tmp_path):
    """A second run over more arrivals continues from the state of the first."""
    arrivals, state = str(tmp_path / "in"), f"file://{tmp_path}/state"
    schema = "digest string, doc_id long, at struct<file: string, row: bigint>"
    for ids, expected in (([1, 5], (5, 2)), ([9, 3], (9, 4))):
        spark.createDataFrame([("d", i, ("f", i)) for i in ids], schema).write.mode("append").parquet(arrivals)
        row = stream_dedup.fold_state(spark.readStream.schema(schema).parquet(arrivals), state).first()
        assert (row.keeper.doc_id, row.arrived) == expected


@pytest.mark.parametrize("digest", [stream_dedup.sha256, lambda body: F.length(body).cast("string")])
def test_later_runs_meet_the_retained_state(spark, tmp_path, digest):
    """Three runs on one state folder, several micro-batches each: identifiers and counts
    follow all arrivals so far, and retained content is checked byte by byte."""
    state = f"file://{tmp_path}/state"
    runs = [[(1, "a b"), (2, "A B"), (3, "c d"), (None, "x y")], [(9, "a b"), (0, "C D"), (4, "new"), (5, "e f")], [(4, "a B"), (20, "c d"), (6, "g h"), (7, "g H"), (8, None)]]
    seen = defaultdict(list)
    for rows in runs:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        for i, t in rows:
            seen[lowered(t or "")].append(i)
        got = stream_dedup.deduplicate(docs, digest, state_path=state, batches=3).collect()
        text = {i: lowered(t or "") for i, t in rows}
        assert {(r.doc_id, r.keep_id) for r in got} == {(i, max((x for x in seen[text[i]] if x is not None), default=None)) for i in text}
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
        assert {r.doc_id: r.group_size for r in got} == {i: len(seen[text[i]]) for i in text}
    assert spark.read.parquet(f"{state}/changes").select("batch").distinct().count() > len(runs)


def test_stream_dedup_keeps_columns_named_like_its_own(spark):
    docs = awkward(spark).selectExpr("*", "'x' AS __at", "1 AS __AT_", "2 AS __kept")
    stays = stream_dedup.distinct_documents(docs)
    assert stays.columns == docs.columns and stays.count() == len({lowered(t) for _, t in texts(docs)})


def test_stream_dedup_empty(spark):
    assert stream_dedup.deduplicate(empty(spark)).count() == 0


# SimHash


def brute_simhash(rows):
    prints = []
    for i, t in rows:
        words = plain_words(t)
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0))
    values = sorted({f for _, f in prints})
    parent = {f: f for f in values}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    least = {}
    for i, f in prints:
        r = root(f)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, f"{f:016x}", least[root(f)]) for i, f in prints), key=sort_key)


@pytest.mark.parametrize("make", [awkward, documents, lambda s: clashing(awkward(s)), empty])
def test_simhash_against_all_pairs(spark, make):
    docs = make(spark)
    got = simhash_balls.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert sorted(map(tuple, got.collect()), key=sort_key) == brute_simhash(texts(docs))


def test_simhash_fingerprint_is_that_of_spark(spark):
    h = spark.sql("SELECT xxhash64('a b c') AS h").first().h
    assert simhash_balls.text_fingerprint("A b\nC") == h % 2**64


def test_ball_edges_link_chains(spark):
    fps = [0, 3, 15, 63, 255 << 40, -1, -2, 2**63 - 1]
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash_balls.ball_edges(nodes)
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 2 for r in edges.collect())
    roots = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert roots[63] == roots[0] == 0 and roots[-1] == roots[-2] == roots[2**63 - 1] == -2 and 255 << 40 not in roots


def test_one_of_each_group(spark):
    docs = awkward(spark)
    got = Counter(r.doc_id for r in simhash_balls.one_of_each_group(docs).collect())
    assert got == Counter({1: 1, 3: 1, 6: 1, 7: 2, 9: 1, None: 1, 11: 1})


def test_ball_edges_of_wider_radii(spark):
    nodes = spark.createDataFrame([(0,), (15,), (1 << 40,), (31 << 50,)], "fp long")
    assert {(r.a, r.b) for r in simhash_balls.ball_edges(nodes, 4).collect()} == {(0, 15), (0, 1 << 40)}
    assert {(r.a, r.b) for r in simhash_balls.ball_edges(nodes, 2).collect()} == {(0, 1 << 40)}
    with pytest.raises(ValueError):
        simhash_balls.ball_edges(nodes, 3)


def template_texts():
    """Texts of one template with a few words of their own, in chains of small changes."""
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(150):
        own = list(words)
        for k in range(3):
            own[(i * 37 + k * 101) % 300] = f"own{i // 3}"
        own[i % 3 * 50] = f"x{i % 2}"
        rows.append((500 - i, " ".join(own)))
    return rows


@pytest.mark.parametrize("make", [documents, lambda s: s.createDataFrame(template_texts(), "doc_id long, text string")])
def test_one_of_each_group_keeps_the_smallest_of_all_links(spark, make):
    docs = make(spark)
    want = {i for i, _, component in brute_simhash(texts(docs)) if i == component}
    assert {r.doc_id for r in simhash_balls.one_of_each_group(docs).collect()} == want and len(want) < docs.count()


def test_a_copy_takes_no_other_text_of_its_doc_id_along(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (5, long.upper()), (5, "a clean text that is nowhere else"), (6, long), (6, long)]
    got = Counter(map(tuple, simhash_balls.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == Counter([rows[0], rows[2]])


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 400)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 400)}


# lattice likelihood


def brute_marginal(word, pieces, scores, stop):
    total = 0.0
    coded = b" " + word.encode()
    chance = dict(zip(pieces.pieces, np.exp(scores), strict=True))
    for cuts in itertools.product([0, 1], repeat=len(coded) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(coded)]
        p, at = 1.0, 0
        for e in ends:
            p *= chance.get(coded[at:e], 0.0)
            at = e
        total += p
    return math.log(total) + stop


def test_lattice_sums_all_segmentations():
    pieces = lattice_lm.pieces_of(RANKS)
    prior = pieces.existing
    scores, stop = lattice_lm.normalised(prior, 0.1, pieces)
    words = ["a", "the", "thé", "zq9!", "overcome", "ññ"]
    got = lattice_lm.subword_log_probabilities(words, pieces, scores, stop)
    assert np.allclose(got, [brute_marginal(w, pieces, scores, stop) for w in words])
    assert abs(np.exp(scores[pieces.initial]).sum() - 1) < 1e-9 and abs(np.exp(scores[~pieces.initial]).sum() + math.exp(stop) - 1) < 1e-9
    ids = pieces.lattice(np.frombuffer(b" overcome", np.uint8)[None])
    expected = lattice_lm.expected_pieces(ids, scores, len(pieces.pieces))
    assert abs(sum(m * len(p) for m, p in zip(expected, pieces.pieces, strict=True)) - len(b" overcome")) < 1e-6


def test_lattice_of_a_very_long_word():
    pieces = lattice_lm.pieces_of(RANKS)
    scores, stop = lattice_lm.normalised(pieces.existing, 0.1, pieces)
    one, two = lattice_lm.subword_log_probabilities(["ab" * 2000, "ab" * 4000], pieces, scores, stop)
    assert np.isfinite(one) and two < one < 0


@pytest.mark.parametrize("make", [awkward, documents, lambda s: clashing(awkward(s))])
@pytest.mark.parametrize("hot", [lattice_lm.HOT_WORDS, 3])
def test_lattice_base_and_score(spark, make, hot, monkeypatch):
    monkeypatch.setattr(lattice_lm, "HOT_WORDS", hot)
    docs = make(spark)
    rows = texts(docs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in [*plain_words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*plain_words(t), None]
        want.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 6)))
    got = lattice_lm.score(docs, RANKS).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=sort_key) == sorted(want, key=sort_key)
    assert all(r.score < 0 for r in got)


def test_lattice_probabilities_of_words_sum_to_less_than_one(spark):
    docs = spark.createDataFrame([(i, "ab abc b " * 3) for i in range(40)] + [(100 + i, w) for i, w in enumerate(["ab", "abc", "b", "zz", ""])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lattice_lm.score(docs, RANKS).collect()}
    end = got[104]
    single = [10 ** (got[100 + i] - end) for i in range(4)]
    assert sum(single) + 10**end < 1 and single[0] > single[3] > 0


def test_lattice_empty(spark):
    assert lattice_lm.score(empty(spark), RANKS).count() == 0


# pseudonyms


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 10, 97, 1000):
        image = [pseudonyms.feistel(v, size, KEY, "t") for v in range(size)]
        assert sorted(image) == list(range(size))
        assert [pseudonyms.feistel(v, size, KEY, "t", undo=True) for v in image] == list(range(size))


FINDS = {
    "card": ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004"],
    "number": ["4111111111111112"],
    "date": ["2024-02-29", "29.02.2024", "1.2.2003", "12/31/1999", "31/12/1999"],
    "ip": ["192.168.10.254"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (542) 555-3599", "(542) 555-3599", "+44 20 7946 0958"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "email": ["jo.doe-7@mail.example.com"],
}


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in FINDS.items() for v in vs])
def test_pseudonyms_keep_the_format_and_can_be_undone(kind, value):
    text = f"see {value}, please"
    new, found = pseudonyms.replace(text, KEY)
    assert found == {kind: 1} and value not in new
    if kind != "ip":
        assert re.sub(r"\d", "0", re.sub(r"[a-z]", "a", new)) == re.sub(r"\d", "0", re.sub(r"[a-z]", "a", text)) or kind == "date"
    again, found = pseudonyms.replace(new, KEY, undo=True)
    assert again == text and found == {kind: 1}
    assert pseudonyms.replace(text, b"another key")[0] != new


def test_pseudonyms_link_equal_values():
    cards = [re.sub(r"\D", "", pseudonyms.replace(f"x {v} y", KEY)[0]) for v in FINDS["card"][:2]]
    assert cards[0] == cards[1] and pseudonyms.luhn_digit(cards[0][:-1]) == cards[0][-1]


def test_pseudonyms_of_a_day_are_one_in_all_layouts():
    rng = random.Random(5)
    for first, last in (("1900-01-01", "2099-12-31"), ("0001-01-01", "9999-12-31")):
        span = [datetime.date.fromisoformat(d).toordinal() for d in (first, last)]
        for _ in range(150):
            d = datetime.date.fromordinal(rng.randint(*span))
            y = f"{d.year:04d}"
            layouts = {f"{y}-{d.month:02d}-{d.day:02d}": "Ymd", f"{y}/{d.month:02d}/{d.day:02d}": "Ymd", f"{d.day:02d}.{d.month:02d}.{y}": "dmY", f"{d.day}.{d.month}.{y}": "dmY", f"{d.day:02d}.{d.month}.{y}": "dmY", f"{d.month:02d}/{d.day:02d}/{y}": "mdY", f"{d.month}-{d.day}-{y}": "mdY"}
            if d.day > 12:
                layouts |= {f"{d.day:02d}/{d.month:02d}/{y}": "dmY", f"{d.day}-{d.month}-{y}": "dmY"}
            days = set()
            for text, order in layouts.items():
                new, found = pseudonyms.replace(text, KEY)
                assert found == {"date": 1} and len(new) == len(text)
                assert pseudonyms.replace(new, KEY, undo=True)[0] == text
                days.add(tuple(v for _, v in sorted(zip(order, map(int, re.split("[-./]", new)), strict=True))))
            assert len(days) == 1


def test_pseudonyms_of_one_phone_number_link():
    numbers = {
        "353861234567": ["+353 86 123 4567", "+353861234567", "+353-86-1234567", "+353 (0) 86 123 4567", "+353 (86) 123 4567"],
        "442079460958": ["+44 20 7946 0958", "+442079460958", "+44 (0)20 7946 0958"],
        "15425553599": ["+1 (542) 555-3599", "+1 542 555 3599", "(542) 555-3599", "542-555-3599", "+15425553599"],
        "79161234567": ["+7 916 123 45 67", "+79161234567"],
    }
    for whole, written in numbers.items():
        code = pseudonyms.country_code(written[0])
        got = set()
        for text in written:
            new, found = pseudonyms.replace(f"call {text}, please", KEY)
            assert found == {"phone": 1} and pseudonyms.replace(new, KEY, undo=True)[0] == f"call {text}, please"
            digits = re.sub(r"\D", "", new.replace("(0)", ""))
            got.add(digits.removeprefix(code) if "+" in text else digits)
            assert "+" not in text or digits.startswith(code)
        assert len(got) == 1 and got != {whole.removeprefix(code)}


@pytest.mark.parametrize("local", ["j\u00f6rg.m\u00fcller", "jo\u0308rg", "\u0438\u0432\u0430\u043d.\u043f", "\u738b\u5c0f\u660e", "-joe", "Jo.Doe", "a" * 60, "longlocal" * 1000, "x_y+z-1"])
def test_pseudonyms_leave_nothing_of_a_local_part(local):
    text = f"mail {local}@x.de, or {local}@b\u00fccher.example!"
    new, found = pseudonyms.replace(text, KEY)
    assert found == {"email": 2} and len(new) == len(text) and pseudonyms.replace(new, KEY, undo=True)[0] == text
    got = new.split()[1].removesuffix("@x.de,")
    same = sum(a == b for a, b in zip(local, got, strict=True) if a not in "._+-")
    assert same <= max(2, len(local) // 5)
    signs = str.maketrans("", "", "._+-")
    assert [c in "._+-" for c in got] == [c in "._+-" for c in local] and got.translate(signs) != local.translate(signs)


def test_pseudonyms_of_addresses_link_whatever_case_and_bullet():
    news = [pseudonyms.replace(t, KEY)[0].lower().lstrip("-") for t in ("jo.doe@x.de", "Jo.Doe@X.de", "-jo.doe@x.de")]
    assert len(set(news)) == 1


@pytest.mark.parametrize("text", ["no data 12 here", "30.02.2024", "999.1.1.300", "000-12-3456", "", "v1.2.3 and 3.14"])
def test_pseudonyms_leave_invalid_values(text):
    assert pseudonyms.replace(text, KEY) == (text, {})


@pytest.mark.parametrize("value,rest", [
    ("+1 (826) 555-4081", " 190.137.223.9"), ("+1 (017) 555-7713", " 2021"), ("+44 20 7946 0958", " 190.137.2.23"), ("+49 30 123456", " 2021"), ("555 123 4567", " 89"), ("(542) 555-3599", " 2021"),
    ("4111 1111 1111 1111", " 123"), ("4111-1111-1111-1111", " 99"), ("ES91 2100 0418 4502 0005 1332", " EUR"), ("GB82WEST12345698765432", " EURO"), ("2021/03/12", " 10"), ("31-12-1999", ""),
])
def test_pseudonyms_do_not_take_what_follows(value, rest):
    alone, _ = pseudonyms.replace(f"see {value}, please", KEY)
    new, found = pseudonyms.replace(f"see {value}{rest}", KEY)
    assert alone.removesuffix(", please") != f"see {value}" and new.startswith(alone.removesuffix(", please"))
    assert sum(found.values()) == 1 + (rest.count(".") == 3) and (rest.count(".") == 3) == (not new.endswith(rest) and rest != "")
    assert pseudonyms.replace(new, KEY, undo=True)[0] == f"see {value}{rest}"


def test_pseudonyms_of_following_digits_can_be_undone():
    for i in range(300):
        for text in (f"4111 1111 1111 {1000 + i} {i:03d}", f"37{i:02d} 123456 1{i:04d} {i}", f"+353 1 {2000 + i} {i:04d} {i % 255}.1.2.3", f"{100 + i} 45 {6789 - i}", f"+999 12 3456 {i:03d} 12.12.2012"):
            new, found = pseudonyms.replace(text, KEY)
            assert pseudonyms.replace(new, KEY, undo=True) == (text, found)


def test_pseudonyms_of_tables(spark):
    docs = clashing(awkward(spark))
    got = pseudonyms.pseudonymise(docs, KEY)
    assert Counter((r.doc_id, r.text, r.n_replaced) for r in got.collect()) == Counter((r.doc_id, r.text, 0) for r in docs.collect())
    assert pseudonyms.pseudonymise(empty(spark), KEY).count() == 0
    source = dict(texts(documents(spark)))
    for r in Q.op10_pseudonyms(spark, SF).collect():
        text, found = pseudonyms.replace(source[r.doc_id], Q.PSEUDONYM_KEY)
        assert (r.text, r.n_replaced) == (text, sum(found.values()))
        assert pseudonyms.replace(r.text, Q.PSEUDONYM_KEY, undo=True)[0] == source[r.doc_id]
