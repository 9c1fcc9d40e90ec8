"""Soft-membership mixing: document rates whose expected domain tokens match targets.

A naive-Bayes classifier over character trigrams, fitted on a labelled table and tempered
to calibrated probabilities, gives every document a posterior over domains. Rates r >= 0
then minimise

    1/2 sum_k ((sum_i t_i r_i p_ik - T_k) / S)^2 + weight/2 sum_i (t_i / S) (r_i - 1)^2

(t tokens, p posteriors, T target tokens, S all tokens) by projected gradient. In the
metric t/S the gradient of a document is p_i . g + weight (r_i - 1), with the K-vector g of
missed totals, so all iterates have the form r_i = max(0, 1 - p_i . theta): a step moves
theta by the gradient, preconditioned with the K x K curvature of the documents above zero
(halved while it does not help), and projects every rate. A step is one pass over a
compact table that sums K + K^2 numbers; nothing per document is collected or kept.

The classifier is fitted on at most about ``SAMPLE`` labelled rows, chosen by hash;
posteriors, totals and rates cover all documents.

Defined cases: a null text is empty, has no tokens and the prior as its posterior; missing
labels are no labels; one domain alone gives rate 1; without labels every rate is 1;
domains of targets that no label names are refused; repeated rows get equal rates; an
empty table gives an empty result; other columns are ignored (kept by ``mixed``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundwise.llm.ngrams import chunks, codes_of, hashed, symbols
from roundwise.llm.shared import cut, slices, unused

SAMPLE = 20_000
MAX_DOMAINS = 64
BITS = 16
ORDER = 3
TEMPER = 0.7
PULL = 1e-3
TOLERANCE = 1e-9
MAX_STEPS = 200
DOUBT = 0.02


@dataclass
class Classifier:
    """Log probabilities of hashed trigrams by domain, log priors and the temper."""

    domains: list[str]
    weights: np.ndarray
    prior: np.ndarray
    scale: float = 1.0

    def evidence(self, text: str | None) -> np.ndarray:
        """Mean log probability of the text's trigrams by domain."""
        total, n = np.zeros(len(self.domains)), 0
        for chunk in chunks(text or "", ORDER):
            codes = trigrams(chunk)
            total += self.weights[codes].sum(axis=0, dtype=np.float64)
            n += len(codes)
        return total / n if n else total

    def posterior(self, text: str | None) -> np.ndarray:
        return softmax(self.scale * self.evidence(text) + self.prior)


def trigrams(text: str) -> np.ndarray:
    return hashed(codes_of(symbols(text), ORDER), BITS)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_classifier(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on ``labelled`` (doc_id, domain): one hash half gives counts, the other the temper."""
    spark = docs.sparkSession
    known = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain"))
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sizes = known.groupBy("domain").count().orderBy("domain").limit(MAX_DOMAINS + 1).collect()
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    domains, n = [r["domain"] for r in sizes], sum(r["count"] for r in sizes)
    if not domains:
        return Classifier(["all"], np.zeros((1 << BITS, 1), np.float32), np.zeros(1))
    prior = np.log(np.array([r["count"] for r in sizes]) / n)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n)))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    # one text for each chosen doc_id, however often it occurs: the sample bounds the rows
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = cut(found.groupBy("doc_id").agg(F.first("domain").alias("domain"), F.min("text").alias("text")).select("domain", "text", half.alias("half")), "mixing-sample")
    place = {d: k for k, d in enumerate(domains)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(place), 1 << BITS), np.int64)
        for batch in slices(batches):
            for domain, text in zip(batch["domain"], batch["text"], strict=True):
                for chunk in chunks(text or "", ORDER):
                    counts[place[domain]] += np.bincount(trigrams(chunk), minlength=1 << BITS)
        k, code = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(code), pa.array(counts[k, code])], ["k", "code", "n"])

    seen = rows.filter("half = 0").mapInArrow(count, "k long, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((1 << BITS, len(domains)), 0.1)
    counts[seen["code"].to_numpy(), seen["k"].to_numpy()] += seen["n"].to_numpy()
    model = Classifier(domains, np.log(counts / counts.sum(axis=0)).astype(np.float32), prior)
    shared = spark.sparkContext.broadcast(model)

    def evidence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            e = [shared.value.evidence(t) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([pa.array([place[d] for d in batch["domain"]], pa.int64()), pa.array(e, pa.list_(pa.float64()))], ["k", "e"])

    held = rows.filter("half = 1").mapInArrow(evidence, "k long, e array<double>").toArrow()
    if held.num_rows:
        model.scale = temper(np.array(held["e"].to_pylist()), held["k"].to_numpy(), prior)
    return model


def temper(evidence: np.ndarray, truth: np.ndarray, prior: np.ndarray) -> float:
    """The scale of the mean evidence with the least log loss, labels being trusted to
    1 - ``DOUBT`` (golden section on its log)."""
    k = evidence.shape[1]
    belief = np.full((len(truth), k), DOUBT / k)
    belief[np.arange(len(truth)), truth] += 1 - DOUBT

    def loss(log_scale: float) -> float:
        p = softmax(math.exp(log_scale) * evidence + prior)
        return float(-(belief * np.log(np.maximum(p, 1e-300))).sum(axis=1).mean())

    low, high, cut_at = -2.0, 8.0, (math.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - cut_at * (high - low), low + cut_at * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


@dataclass
class Rates:
    """The K-vector that decides the rate of every posterior."""

    theta: np.ndarray

    def of(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, 1 - p @ self.theta)


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, posterior) of every document; tokens are words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            n = [len((t or "").encode().split()) for t in rows["text"]]
            p = [shared.value.posterior(t) for t in rows["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], ["doc_id", "n_tokens", "posterior"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def matrix(rows: dict[str, list], k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array(rows["n_tokens"], float), np.array(rows["posterior"], float).reshape(-1, k)


def summed(table: DataFrame, k: int, width: int, each) -> np.ndarray:
    """Sum over all rows of a vector of ``width`` numbers: one partial row per partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for rows in slices(batches, 8192):
            total += each(*matrix(rows, k))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    parts = table.select("n_tokens", "posterior").mapInArrow(run, "v array<double>")
    got = parts.agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)]).first()
    return np.array([x or 0.0 for x in got])


def solve(table: DataFrame, domains: list[str], targets: dict[str, float] | None = None, total: float | None = None) -> Rates:
    """Rates for the posterior table. Targets are weights of domains; by default the found
    shares to the power ``TEMPER``. ``total`` is the tokens wanted; by default as many as
    leave no domain with fewer than it has."""
    k = len(domains)
    if targets and set(targets) - set(domains):
        raise ValueError(f"targets without labelled domain: {sorted(set(targets) - set(domains))}")

    def totals(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """All tokens, expected tokens by domain, and the curvature of the active rows."""

        def each(t: np.ndarray, p: np.ndarray) -> np.ndarray:
            r = Rates(theta).of(p)
            return np.concatenate([[t.sum()], (t * r) @ p, ((p * (t * (r > 0))[:, None]).T @ p).ravel()])

        got = summed(table, k, 1 + k + k * k, each)
        return got[0], got[1 : 1 + k], got[1 + k :].reshape(k, k)

    theta = np.zeros(k)
    tokens, have, curvature = totals(theta)
    if tokens <= 0 or k == 1:
        return Rates(theta)
    share = have / tokens
    want = np.array([targets.get(d, 0.0) for d in domains]) if targets else share**TEMPER
    want = want / want.sum()
    grown = total / tokens if total else float(np.max(np.where(want > 0, share / np.maximum(want, 1e-12), 0)))
    goal = want * grown
    missed = share - goal - PULL * theta
    for _ in range(MAX_STEPS):
        if np.abs(missed).max() < TOLERANCE:
            break
        step = np.linalg.solve(curvature / tokens + PULL * np.eye(k), missed)
        while True:
            # rounded, so that the order of partial sums does not show in the rates
            ahead = np.round(theta + step, 9)
            _, have, curvature_ahead = totals(ahead)
            missed_ahead = have / tokens - goal - PULL * ahead
            if np.linalg.norm(missed_ahead) < np.linalg.norm(missed) or np.abs(step).max() < TOLERANCE:
                break
            step = step / 2
        if np.abs(step).max() < TOLERANCE:
            break
        theta, curvature, missed = ahead, curvature_ahead, missed_ahead
    else:
        raise RuntimeError(f"rates did not settle within {MAX_STEPS} steps")
    return Rates(theta)


def copies_of(rate: Column, doc_id: Column, seed: int) -> Column:
    """Whole copies with the rate as their mean: the remainder is decided by a hash."""
    u = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def rate_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, seed: int = 0, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_tokens, domains, posterior, rate, copies) of every document."""
    model = fit_classifier(docs, labelled, sample)
    table = cut(posteriors(docs, model), "mixing-posteriors")
    rates = solve(table, model.domains, targets)

    @F.pandas_udf("double")
    def rate(p: pd.Series) -> pd.Series:
        return pd.Series(rates.of(np.array(p.tolist(), float).reshape(len(p), -1)))

    out = table.withColumn("rate", rate("posterior")).withColumn("domains", F.array(*[F.lit(d) for d in model.domains]))
    return out.select("doc_id", "n_tokens", "domains", "posterior", "rate", copies_of(F.col("rate"), F.col("doc_id"), seed).alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, seed: int = 0, at_least: int = 1) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say but ``at_least`` so often,
    columns unchanged. With 1, the default targets only ever repeat documents."""
    model = fit_classifier(docs, labelled)
    rates = solve(cut(posteriors(docs, model), "mixing-posteriors"), model.domains, targets)
    shared = docs.sparkSession.sparkContext.broadcast((model, rates))

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        own, found = shared.value
        return pd.Series(found.of(np.array([own.posterior(t) for t in texts]).reshape(len(texts), -1)))

    name = unused("__copies", docs)
    copies = F.greatest(F.lit(at_least), copies_of(rate("text"), F.col("doc_id"), seed))
    return docs.withColumn(name, copies).withColumn(name, F.explode(F.array_repeat(F.lit(1), F.col(name)))).drop(name)
