"""Chat windows, host extraction, toxicity, mixing and the pipeline."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roundwise.llm import chat_windows, html_hosts, mixing, toxicity
from roundwise.llm import queries as Q
from tests.llm.helpers import SF, awkward, clashing, documents, empty, sort_key

TURNS = "conv_id long, turn long, role string, text string"


# chat windows


def brute_chat(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=sort_key)


def awkward_turns(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", r"<\|im_start|> and <|x \ y")]
    rows += [(2, i, "assistant" if i % 2 else "user", "word " * (i % 90)) for i in range(700)]
    rows += [(3, None, None, None), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 5, "a\n\\nb<|", "x")]
    rows += [(5, 0, "assistant", "é" * 5000), (5, 1, "user", "w " * 3000), (5, 2, "assistant", "w " * 3000)]
    rows += [(6, 0, "system", "s " * 600), (6, 1, "user", "u"), (6, 2, "system", "again"), (6, 3, "assistant", Q.CONTROL_TEXT)]
    return spark.createDataFrame(rows, TURNS)


@pytest.mark.parametrize("make", [awkward_turns, lambda s: s.read.parquet(f"{SF}/conversations.parquet"), lambda s: awkward_turns(s).selectExpr("*", "1 AS span", "1 AS n", "1 AS place", "1 AS block", "1 AS system")])
@pytest.mark.parametrize("budget,history", [(512, 128), (60, 20), (30, 0)])
def test_windows_read_back(spark, make, budget, history):
    turns = make(spark)
    made = chat_windows.windows(turns, budget, history)
    got = chat_windows.read_back(made).collect()
    want = brute_chat([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got), key=sort_key) == want
    for r in made.collect():
        assert r.n_tokens <= budget or r.n_new == 1 and r.n_context <= 1
        assert r.formatted.count(chat_windows.START) == r.n_context + r.n_new


def test_windows_keep_system_and_history(spark):
    rows = [(1, 0, "system", "rule"), *[(1, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(1, 40)]]
    made = sorted(chat_windows.windows(spark.createDataFrame(rows, TURNS), 60, 20).collect(), key=lambda r: (r.span, r.piece))
    assert len(made) > 3
    for r in made[1:]:
        turns = chat_windows.read_turns(r.formatted)
        assert turns[0] == ("system", "rule") and r.n_context > 1
        assert all(not any(i["start"] <= p < i["stop"] for i in r.loss) for p in range(len(chat_windows.START)))
    seen = [t for r in made for t in chat_windows.read_turns(r.formatted)[r.n_context :]]
    assert seen == [(role, text) for _, _, role, text in rows]


@pytest.mark.parametrize("text", ["<|", r"<\|", r"<\\|a<|<", "\\", "a<\\", "<|im_start|>x"])
def test_escape_is_reversible(text):
    assert chat_windows.unescape(chat_windows.escape(text)) == text
    assert "<|" not in chat_windows.escape(text)
    assert chat_windows.unescape_role(chat_windows.escape_role(text + "\n")) == text + "\n"


def test_windows_empty(spark):
    assert chat_windows.read_back(chat_windows.windows(spark.createDataFrame([], TURNS))).count() == 0


# pages


ARTICLE = '<!doctype html><head><title>T</title><script>var a="</p><p>no";</script></head><body><nav><a>Home</a></nav><div class="ad">Buy</div><article><header><h1>Big &amp; <b>bo</b>ld</h1></header><p>One<br>two&nbsp;three<p>four <div class="share">share</div><aside>see also</aside><section id="comments"><p>nice</p></section></article><footer>&copy; me</footer>'


def test_article_text():
    got = html_hosts.blocks(ARTICLE)
    assert " ".join(t for s, t in got if s == html_hosts.ARTICLE) == "Big & bold One two three four"


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("a < b <c", "a < b"), ("<ul><li>a<li>b</ul>c", "a b c"), ("<p>x<!-- <p>y</p> -->z", "xz"),
    ("<textarea><p>a</p></textarea>b", "b"), ("<div hidden>a</div>b", "b"), ("<p title='>'>a</p>", "a"), ("<script>if (a<b) '</div>'", ""), ("<form>name</form><p>&#233;&unknown;</p>", "é&unknown;"),
])
def test_pages_without_article(spark, page, want):
    pages = spark.createDataFrame([(1, "http://h/x", page)], "page_id long, url string, html string")
    assert html_hosts.extract(pages).first().text == want


@pytest.mark.parametrize("page,want", [
    ("<p data-x=it's>text</p>more", ["text", "more"]), ('<p title="5" tall">a</p><p>b</p>', ["a", "b"]), ('<p title="5>a</p><p>b</p>', ["a", "b"]), ("<p title='>' x = \">\">a</p>", ["a"]), ("a<p title=\"" * 40, ["a"]),
])
def test_stray_quotes_lose_no_text(page, want):
    got = [t for _, t in html_hosts.blocks(page)]
    assert got[: len(want)] == want


def brute_covered(streams, k):
    """Tokens inside any substring of k or more tokens that also occurs on another page."""
    marks = {}
    for p, tokens in streams.items():
        others = {tuple(o[i : i + k]) for q, o in streams.items() if q != p for i in range(len(o) - k + 1)}
        gone = [False] * len(tokens)
        for i in range(len(tokens) - k + 1):
            if tuple(tokens[i : i + k]) in others:
                gone[i : i + k] = [True] * k
        marks[p] = " ".join(t for t, g in zip(tokens, gone, strict=True) if not g)
    return marks


def test_host_repeats_are_removed(spark):
    bar = "home news sport weather money travel shop account log in"
    own = {i: " ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)}
    bodies = {i: f"<div>{bar}</div><div>{own[i]}</div><div>{bar} tail{i}</div>" for i in own}
    rows = [(i, "http://a.example/p", h) for i, h in bodies.items()] + [(9, "http://b.example/", bodies[0]), (10, None, None)]
    got = {r.page_id: r for r in html_hosts.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "1 AS main")).collect()}
    want = brute_covered({i: f"{bar} {own[i]} {bar} tail{i}".split() for i in own}, html_hosts.MIN_REPEAT)
    assert {i: got[i].text for i in own} == want and own[3] in want[3] and bar not in want[3]
    assert got[9].text.startswith(bar) and got[10].text == "" and got[10].n_chars == 0


def test_equal_articles_on_a_host_stay(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", ARTICLE) for i in range(3)] + [(0, "http://h/0", ARTICLE)], "page_id long, url string, html string")
    assert [r.text for r in html_hosts.extract(pages).collect()] == ["Big & bold One two three four"] * 4


def test_unmarked_text_beside_an_article_is_decided_by_the_array(spark):
    bar = "home news sport weather money travel shop account log in"
    lead = "a teaser of eight words or a few more for the body"
    own = {i: " ".join(f"w{i}x{j}" for j in range(30)) for i in range(4)}
    rows = [(i, f"http://h/{i}", f"<div>{bar}</div><div>{t}</div><article>{lead} {i}</article><div>end {i}</div><div>{bar}</div>") for i, t in own.items()]
    rows.append((8, "http://h/8", f"<div>{lead} 2</div><div>only here</div>"))
    got = {r.page_id: r.text for r in html_hosts.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{t} {lead} {i} end {i}" for i, t in own.items()} | {8: "only here"}


def test_whole_page_copies_are_one_page(spark):
    body = " ".join(f"w{j}" for j in range(40))
    rows = [(i, f"http://h/{i}", f"<nav>to page {i}</nav><div>{body}</div>") for i in range(3)]
    got = html_hosts.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == [body] * 3


def test_pages_of_the_test_table(spark):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in Q.op7_host_extraction(spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        assert r.text == " ".join(unescape(re.sub(r"</?(?:b|i|em)>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
        assert r.n_chars == len(r.text)
    assert html_hosts.extract(pages.limit(0)).count() == 0


# toxicity


@pytest.fixture(scope="module")
def reader(spark):
    return toxicity.Reader(toxicity.trigram_table(documents(spark, "/root/testdata/sf0.01")))


@pytest.mark.parametrize("noisy,plain", [("1d10t", "idiot"), ("m0r0n!", "moron!"), ("s t u p i d", "stupid"), ("looooser", "loser"), ("tr4sh.", "trash."), ("i.d.i.o.t", "idiot"), ("d1sgu5ting", "disgusting"), ("$tup!d", "stupid")])
def test_noise_is_restored(reader, noisy, plain):
    assert reader.restore(f"the {noisy} of them").split()[1] == plain


@pytest.mark.parametrize("noisy,plain", [
    ("i - d - i - o - t", "idiot"), ("i d i o t", "idiot"), ("i,d,i,o,t", "idiot"), ("i   d   i   o   t", "idiot"), ("id iot", "idiot"), ("id.iot", "idiot"), ("id - iot", "idiot"), ("iddiot", "idiot"), ("idioot", "idiot"),
    ("stu pid", "stupid"), ("st,upid", "stupid"), ("1d iot", "idiot"), ("m o r o n", "moron"), ("a s s", "ass"),
])
def test_separators_and_doubled_letters_are_restored(reader, noisy, plain):
    assert reader.restore(f"the {noisy} of them").split() == ["the", plain, "of", "them"]


@pytest.mark.parametrize("text", ["", "plain words stay, as they are.", "the price is 45 or 3 456", "a b", "\n\n", "ab%%% cd***"])
def test_clean_text_is_untouched(reader, text):
    assert reader.restore(text) == text


def test_viterbi_is_the_best_path(reader):
    import itertools

    def value(word):
        sym = [0, 0, *toxicity.symbols(word)[1:-1], 0]
        return sum(float(reader.table[a, b, c]) for a, b, c in zip(sym, sym[1:], sym[2:], strict=False))

    token = "1d10t"
    options = [[(c, toxicity.KEEP if c in toxicity.SIGNS else 0.0)] + [(x, toxicity.CHANGE) for x in toxicity.LOOKALIKES.get(c, "")] for c in token]
    best = max((sum(cost for _, cost in path) + value("".join(p for p, _ in path)), "".join(p for p, _ in path)) for path in itertools.product(*options))
    score, word = reader.read(token)
    assert word == best[1] and abs(score - best[0]) < 1e-3


@pytest.mark.parametrize("token", ["s1llyy", "ii  d", "i.d!!t", "a  b..c", "heeey $$o", "x - 0 - y", "oo0", ".a b.", "a     b", "a_b", "11 1", "\u00e9\u00e93"])
def test_viterbi_is_the_best_path_with_gaps_and_shrinks(reader, token):
    """All readings of a token, written out run by run and scored one by one."""
    import itertools

    runs = [(c, len(list(g))) for c, g in itertools.groupby(token, key=lambda c: c if c.isalnum() or c in toxicity.LOOKALIKES else "_" if c == "_" else " ")]
    starts = list(itertools.accumulate((n for _, n in runs), initial=0))
    sides = [None if c in " _" else n for c, n in runs]
    alone = [sides[i] == 1 and all(sides[k] is None for k in (i - 1, i + 1) if 0 <= k < len(runs)) for i in range(len(runs))]
    options = []
    for i, (c, n) in enumerate(runs):
        own = []
        if sides[i] is None:
            between = 0 < i < len(runs) - 1
            spelled = between and alone[i - 1] and alone[i + 1]
            own.append((token[starts[i] : starts[i] + n], toxicity.APART if spelled else 0.0, [0]))
            if between and n <= toxicity.LONGEST_GAP:
                own.append(("", toxicity.JOIN if spelled else toxicity.DELETE, []))
        else:
            code = {x: toxicity.symbols(x).tolist()[1:-1] for x in c + toxicity.LOOKALIKES.get(c, "")}
            own.append((c * n, toxicity.KEEP if c in toxicity.SIGNS else 0.0, code[c] * n))
            if n == 2:
                own.append((c, toxicity.SHRINK if c in toxicity.SIGNS else toxicity.DOUBLE, code[c]))
            if n > 2:
                own += [(c * k, toxicity.SHRINK, code[c] * k) for k in (1, 2)]
            for y in toxicity.LOOKALIKES.get(c, ""):
                own += [(y * k, toxicity.CHANGE * (1 if k == n else 1.5), code[y] * k) for k in {1, min(n, 2)}]
        options.append(own)
    readings = {}
    for path in itertools.product(*options):
        sym = [0, 0, *itertools.chain(*(codes for _, _, codes in path)), 0]
        value = sum(cost for _, cost, _ in path) + sum(float(reader.table[a, b, c]) for a, b, c in zip(sym, sym[1:], sym[2:], strict=False))
        text = "".join(p for p, _, _ in path)
        readings[text] = max(value, readings.get(text, -np.inf))
    score, text = reader.read(token)
    assert score == pytest.approx(max(readings.values()), abs=1e-6) and readings[text] == pytest.approx(score, abs=1e-6)


def test_long_spelled_text_takes_linear_time(reader):
    import time

    start = time.perf_counter()
    out = reader.restore("i d i o t " * 40_000)
    assert time.perf_counter() - start < 6 and len(out) <= 400_000
    assert reader.read_short.cache_info().currsize < 1 << 17


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = Q.op3_toxicity(spark, sf).join(labels, "doc_id").join(documents(spark, sf).select("doc_id", "lang"), "doc_id").filter("held_out and lang = 'en'").collect()
    hits = sum(r.toxic == 1 and r.predicted == 1 for r in got)
    assert hits >= 0.9 * sum(r.toxic for r in got)  # some labels mark texts without any toxic word
    assert sum(r.toxic == 0 and r.predicted == 1 for r in got) <= 0.05 * len(got)


def test_toxicity_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (11, 1), (7, 0), (4, 0), (6, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    docs = clashing(awkward(spark))
    model = toxicity.fit(docs, labels, F.lit(True))
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    nothing = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), labels, F.lit(True))).count() == 0
    assert toxicity.not_toxic(docs, labels).columns == docs.columns


def test_toxicity_scores_do_not_see_other_columns(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    usable = ~toxicity.held_out(F.col("doc_id"))
    plain = toxicity.score(docs, toxicity.fit(docs, labels, usable))
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    held = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.score(changed, toxicity.fit(changed, held, usable))
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, other.collect()))


def hot(spark, docs):
    """One doc_id on a third of all rows, with columns named like the operators' own."""
    row = docs.where("doc_id = 12")
    return docs.unionByName(row.crossJoin(spark.range(docs.count() // 2)).drop("id"))


def test_a_hot_doc_id_counts_once_in_the_toxicity_sample(spark, monkeypatch):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(12, 1, 1)], "doc_id long, quality int, toxic int"))
    table = toxicity.trigram_table(docs)
    monkeypatch.setattr(toxicity, "trigram_table", lambda _: table)
    plain, other = (toxicity.fit(d, labels, F.lit(True)) for d in (docs, hot(spark, docs)))
    assert np.array_equal(plain.weights, other.weights) and np.array_equal(plain.beta, other.beta)


# mixing


def test_a_hot_doc_id_counts_once_in_the_mixing_sample(spark):
    docs = documents(spark)
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    plain, other = (mixing.fit_classifier(d, labelled) for d in (docs, hot(spark, docs)))
    assert np.array_equal(plain.weights, other.weights) and plain.scale == other.scale
    named = docs.selectExpr("*", "1 AS __copies", "2 AS __copy")
    assert mixing.mixed(named, labelled).columns == named.columns


def test_rates_reach_the_targets(spark):
    docs = documents(spark)
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    targets = {"de": 0.25, "en": 0.25, "es": 0.25, "fr": 0.25}
    got = mixing.rate_documents(docs, labelled, targets).collect()
    t = np.array([r.n_tokens for r in got], float)
    p, rate = np.array([r.posterior for r in got]), np.array([r.rate for r in got])
    have = (t * rate) @ p
    assert np.allclose(have / have.sum(), 0.25, atol=0.01) and (rate >= 0).all()
    assert np.allclose(p.sum(axis=1), 1) and abs(np.mean([r.copies for r in got]) - rate.mean()) < 0.1
    # the same optimum by long plain projected gradient
    goal = np.full(4, 0.25) * max(t @ p / t.sum() / 0.25)
    x = np.ones(len(t))
    step = 1 / (np.linalg.eigvalsh((p * t[:, None]).T @ p / t.sum())[-1] + mixing.PULL)
    for _ in range(20000):
        x = np.maximum(0, x - step * (p @ ((t * x) @ p / t.sum() - goal) + mixing.PULL * (x - 1)))
    assert np.allclose(rate, x, atol=2e-3)


def test_mixing_edge_cases(spark):
    docs = clashing(awkward(spark))
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    rows = mixing.rate_documents(docs, labelled).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    out = mixing.mixed(docs, labelled)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert {r.rate for r in mixing.rate_documents(docs, labelled.limit(0)).collect()} == {1.0}
    assert mixing.rate_documents(empty(spark), labelled).count() == 0
    with pytest.raises(ValueError, match="targets"):
        mixing.rate_documents(docs, labelled, {"xx": 1.0})


# pipeline


def test_pipeline_follows_its_stages(spark):
    docs = documents(spark)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, SF).toArrow()) if name == "mixing" else stage(spark, docs, SF)
        if name != "byte_bpe":
            assert docs.columns == columns
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in docs.collect())
