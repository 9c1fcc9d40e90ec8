"""Byte-level BPE with the tiktoken library, a local rank file and raw-byte decoding.

A long text is cut before a space that follows a word character: no match of the split
pattern goes from a non-space into a space, and the look-ahead of its white-space branch
never sees such a cut, so the pieces encode to exactly the ids of the whole text.

Defined cases: a null text is empty and has no ids; special-token strings are ordinary
text; repeated rows give repeated rows; an empty table gives an empty result; other
columns of the input are kept by ``encode`` and ignored by ``round_trip``.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundwise.llm.shared import slices

PIECE_CHARS = 1 << 16
ROWS_AT_ONCE = 128
SAFE_CUT = re.compile(r"(?<=\w) ")


@functools.lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file (base64 token and rank on each line), once per worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters that encode independently."""
    start = 0
    while len(text) - start > size:
        found = SAFE_CUT.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(coder: tiktoken.Encoding, text: str | None) -> list[int]:
    ids: list[int] = []
    for piece in safe_pieces(text or ""):
        ids.extend(coder.encode_ordinary(piece))
    return ids


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """The columns of ``docs`` but for the text, with ``ids`` array<int> and ``n_tokens``.

    Columns of these names in ``docs`` are replaced. The ids stand for the text.
    """

    rest = docs.drop("ids", "n_tokens", "text")
    kept = rest.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(rank_file, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                ids = [np.array(encode_text(coder, t), np.int32) for t in part.column("text").to_pylist()]
                arrays = [part.column(c) for c in kept] + [pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, "ids", "n_tokens"])

    schema = T.StructType([*rest.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    return docs.select(*kept, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``encoded`` with the raw bytes of its ids as ``bytes`` (binary); null ids give none."""

    @F.pandas_udf("binary")
    def raw(ids: pd.Series) -> pd.Series:
        coder = encoding(rank_file, pattern)
        return ids.map(lambda x: coder.decode_bytes([] if x is None else list(x)))

    return encoded.withColumn("bytes", raw("ids"))


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded
    in the same task so that ids need not travel."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(rank_file, pattern)
        for rows in slices(batches, ROWS_AT_ONCE):
            counts, packed, raw = [], [], []
            for text in rows["text"]:
                ids = encode_text(coder, text)
                counts.append(len(ids))
                packed.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                raw.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
