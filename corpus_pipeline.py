"""A training corpus from raw documents, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet to the
shared folder and read again as the next one's ``docs``, so a lost executor costs no more
than its tasks. All stages but the last return the columns of documents; rows keep their
doc_id. Null or empty texts leave at the first stage (they have no language), and every
stage takes an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.llm import qgram, sanitise, setsketch, transducer, wordlang
from riskspark.llm.common import read, stored

SHINGLE_WORDS, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, which is put into lang; those without a letter go."""
    out = wordlang.predict(docs, wordlang.train(docs), lang_out="__lang", score_out="__score").filter(F.col("__lang") != wordlang.UND)
    return out.withColumn("lang", F.col("__lang").cast(docs.schema["lang"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the least doc_id."""
    return setsketch.deduplicated(docs, k=SHINGLE_WORDS, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of benchmark stands."""
    return qgram.clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced; n_chars follows."""
    return sanitise.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document."""
    import public_tokenizers

    docs = docs.select("doc_id", "lang", "source", "text")
    lexicon = transducer.compile_lexicon(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return transducer.encode(docs, lexicon).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

# Trained language models, near-duplicate sketches and BPE have no SQL form: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on documents; returns the last one's rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
