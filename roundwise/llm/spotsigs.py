"""SpotSigs fingerprints: word chains behind common-word anchors, compared by Jaccard.

A text's words are lower-cased (A-Z) and freed of outer punctuation. Anchors are common
words, tokens without letter or digit, the start of the text, and every ``REACH``-th word
of a run without any of these. The ``CHAIN`` content words that follow an anchor form one
spot signature with it. A text's fingerprint is its set of distinct signatures, as 32-bit
hashes in ascending order. Sets are compared by Jaccard likeness; near-duplicate pairs are
searched within neighbouring partitions by set length only, and length and prefix bounds
prune pairs before any set is compared.

Defined cases: a null text is empty and has no signature; two empty sets have likeness 1,
an empty and another one 0; a text without content words has one signature of all its
words; rows without doc_id come first in document order; repeated rows follow one another,
ordered by text; one document alone is its own successor; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundwise.llm.components import connected_components
from roundwise.llm.shared import cut, partitions, slices

# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from has have in is it of on or that the this to was were with "
    "au aux ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "als auch auf das dem den der des die ein eine für im in ist mit nicht sich sie und von zu "
    "al como con del el en es la las lo los más no o para por que se su un una y"
)
CHAIN = 2
REACH = 8
OUTER = b".,;:!?\"'()[]{}<>*%&$#"
NEAR = 0.8


def signature_set(text: str | None, anchors: frozenset[bytes], chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct uint32 hashes of the spot signatures of a text."""
    words = [w.strip(OUTER) or w for w in (text or "").encode().lower().split()]
    if not words:
        return np.empty(0, np.uint32)
    content: list[bytes] = []
    spots: list[tuple[bytes, int]] = [(b"", 0)]
    run = 0
    for w in words:
        if w in anchors or (not w[0] & 0x80 and not w.isalnum() and w.strip(OUTER + b"|-+=/\\_~^`@") == b""):
            spots.append((w, len(content)))
            run = 0
        else:
            content.append(w)
            run += 1
            if run == REACH:
                spots.append((w, len(content)))
                run = 0
    digest = xxhash.xxh32_intdigest
    if not content:
        return np.array([digest(b" ".join(words))], np.uint32)
    n = len(content)
    found = {digest(b" ".join((w, *content[c : c + chain]))) for w, c in spots if c < n}
    return np.array(sorted(found), np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Likeness of two sorted sets; 0 where their lengths alone rule out ``least``."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def as_string(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def in_document_order(docs: DataFrame) -> DataFrame:
    """(part, borrowed, doc_id, text): ``docs`` dealt by ranges of doc_id and sorted, each
    range followed by a copy of the first document of the next range (of the first range
    after the last), so that every document meets its successor in its own task.

    Range bounds come from a quantile sketch of the ids; one row per range is broadcast.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = 4 * partitions(spark)
    bounds = sorted(set(keyed.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    part: Column = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= F.col("key"))) if bounds else F.lit(0)
    dealt = keyed.withColumn("part", part)
    firsts = sorted((r["part"], r["key"]) for r in dealt.groupBy("part").agg(F.min("key").alias("key")).collect())
    lend = [(key, firsts[i - 1][0], int(i == 0)) for i, (_, key) in enumerate(firsts)]
    lent = F.broadcast(spark.createDataFrame(lend, "key long, to_part int, wrapped int"))
    copies = dealt.join(lent, "key").select(F.col("to_part").alias("part"), (F.lit(1) + F.col("wrapped")).alias("borrowed"), "key", "doc_id", "text")
    rows = dealt.select("part", F.lit(0).alias("borrowed"), "key", "doc_id", "text").unionByName(copies)
    return rows.repartition(partitions(spark), "part").sortWithinPartitions("part", "borrowed", "key", "text").drop("key")


def fingerprint_with_edit(docs: DataFrame, anchors: str = ANCHORS) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is replaced by
    the beginning of the next document, with the likeness to both."""
    words = frozenset(anchors.encode().split())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        for rows in slices(batches, 128):
            out = []
            for part, borrowed, doc_id, text in zip(rows["part"], rows["borrowed"], rows["doc_id"], rows["text"], strict=True):
                sigs = signature_set(text, words)
                if before and before[0] == part and not before[1]:
                    _, _, old_id, old, old_sigs = before
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    changed = signature_set(edited, words)
                    out.append((old_id, len(old), hashlib.sha256(edited.encode()).hexdigest(), as_string(old_sigs), as_string(changed), jaccard(old_sigs, changed), jaccard(old_sigs, sigs), len(old_sigs)))
                before = (part, borrowed, doc_id, text, sigs)
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"]
    return in_document_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long")


def signature_table(docs: DataFrame, anchors: str = ANCHORS) -> DataFrame:
    """(doc_id, sigs): the signature set of every text as array<bigint>."""
    words = frozenset(anchors.encode().split())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            sets = [signature_set(t, words).astype(np.int64) for t in rows["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "sigs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sigs array<bigint>")


def near_duplicate_classes(docs: DataFrame, least: float = NEAR, anchors: str = ANCHORS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (doc_id, class_id) of equal signature sets, and all pairs
    (class_a, class_b, likeness) of classes with likeness of ``least`` or more.

    Sets are partitioned by length, in bands so wide that a pair reaching ``least`` lies
    in one band or two neighbouring ones. Within a band only sets that share a signature
    of their rarest-first prefix meet, the prefix being as long as ``least`` requires, and
    of such a meeting only the pairs that pass the length bound are compared.
    """
    table = cut(signature_table(docs, anchors), "spotsigs-sets")
    classes = cut(table.groupBy("sigs").agg(F.min("doc_id").alias("class_id")), "spotsigs-classes")
    members = table.join(classes, "sigs").select("doc_id", "class_id")
    sized = classes.filter(F.size("sigs") > 0).withColumn("n", F.size("sigs"))
    band = F.floor(F.log(F.col("n")) / F.lit(-np.log(least) + 1e-12)).cast("int")
    counts = sized.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    ranked = sized.select("class_id", "n", F.explode("sigs").alias("sig")).join(counts, "sig")
    ordered = ranked.groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("order"))
    prefix = F.slice("order", 1, F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int") + 1)
    probes = ordered.select("class_id", "n", band.alias("band"), F.explode(prefix).alias("p")).select("class_id", "n", "band", "p.sig")
    left = probes.select(F.col("class_id").alias("class_a"), F.col("n").alias("n_a"), F.explode(F.array("band", F.col("band") + 1)).alias("band"), "sig")
    right = probes.select(F.col("class_id").alias("class_b"), F.col("n").alias("n_b"), "band", "sig")
    in_order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("class_a") < F.col("class_b")))
    met = left.join(right, ["band", "sig"]).filter(in_order & (F.col("n_a") >= F.lit(least) * F.col("n_b"))).select("class_a", "class_b").distinct()
    a, b = (classes.select(F.col("class_id").alias(f"class_{x}"), F.col("sigs").alias(f"sigs_{x}")) for x in "ab")
    common = F.size(F.array_intersect("sigs_a", "sigs_b"))
    likeness = common / (F.size("sigs_a") + F.size("sigs_b") - common)
    pairs = met.join(a, "class_a").join(b, "class_b").select("class_a", "class_b", likeness.alias("likeness")).filter(F.col("likeness") >= least)
    return members, pairs


def near_duplicate_groups(docs: DataFrame, least: float = NEAR, anchors: str = ANCHORS) -> DataFrame:
    """(doc_id, group_id): smallest doc_id reachable over near-duplicate pairs."""
    members, pairs = near_duplicate_classes(docs, least, anchors)
    roots = connected_components(cut(pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")), "spotsigs-pairs"))
    joined = members.join(roots, members["class_id"] == roots["node"], "left")
    return joined.select("doc_id", F.coalesce("root", "class_id").alias("group_id"))
