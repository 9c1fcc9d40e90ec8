"""Small awkward tables for the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the word of a long text and " * 4000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs to the hill", "en"),
    (2, "the QUICK brown fox jumps over the lazy dog and runs to the hill", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, "   \n\t ", "fr"),
    (6, LONG, "en"),
    (7, "eins zwei drei vier fünf", "de"),
    (7, "eins zwei drei vier fünf", "de"),
    (9, "É é ñ ß 漢字 \U0001f600", None),
    (None, "a row without id", "en"),
    (11, "idiot " * 30, "en"),
    (12, "The quick brown fox jumps over the lazy dog and runs to the hill", None),
]


def awkward(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in ROWS], SCHEMA)


def clashing(docs: DataFrame) -> DataFrame:
    """The same documents with columns named like those that the operators make."""
    names = ["fp", "fingerprint", "row", "score", "digest", "at", "body", "ids", "n_tokens", "rate", "copies", "component_id", "key", "part", "words", "kinds", "n_replaced"]
    return docs.selectExpr("*", *[f"'x' AS {n}" for n in names])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def documents(spark: SparkSession, sf: str = SF) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df: DataFrame) -> list[tuple]:
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def sort_key(row: tuple) -> tuple:
    return tuple((x is not None, str(x)) for x in row)
