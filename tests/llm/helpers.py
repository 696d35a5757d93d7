"""Small inputs and brute-force versions for the operators' tests."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

SF = "/root/testdata/sf0.001"
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()),
                   *(StructField(c, StringType()) for c in ("cls", "score", "ids", "text_key", "node"))])      # extra columns, names that clash


def docs(spark, rows):
    """Rows of (doc_id, text, lang)."""
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), *"abcde") for i, t, lang in rows], DOCS).repartition(3)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_rows():
    """Null id and text, empty and blank texts, repeated rows, a very long text, exotic characters."""
    rng = random.Random(1)
    return [(1, None, None), (2, "", "en"), (3, " \n\t ", None), (None, "a null id with some words here", "en"), (5, "same words in both of these rows", "en"), (5, "same words in both of these rows", "en"),
            (6, "same words in both of these rows", "fr"), (7, " ".join(words(rng, 30_000)), "en"), (8, "日本語 текст ñandú   \U0001F600 'll <|endoftext|> x", "xx"), (9, "...", "en")]
