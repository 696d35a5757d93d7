"""Language identification by words first, then shorter and shorter character n-grams.

A word that the model knows adds the logarithm of its relative frequency in each language.
An unseen word is scored by its 5-grams that the model knows (mean log frequency); if it has
none by its 4-grams, and so on down to single letters. Words are runs of letters in lower
case; n-grams of 2 and more include the word's edges. The language with the largest sum
wins; the score is its share after a softmax, equal priors.

Training takes MAX_DOCS labelled rows (a sample by hash, so a documented bound; all where
there are fewer), counts words and n-grams as Spark aggregates of hashed keys, and keeps the
WORDS most frequent words and GRAMS most frequent n-grams of each length. The model's size
is bounded by these numbers, so it can be broadcast; prediction is a scan without a shuffle.

Defined cases: a null text, and one without letters, is ``und`` with score 0; so is every
text if there are no labelled rows; text with letters gets a learned language always (the
first in alphabetical order on a tie, with an equal share); null languages and null texts
are not learned from; null ids, repeated rows and extra columns of any name change nothing.
Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.llm.common import HashIndex, U64, chunked, mix, prefix_hash, read, span_hash, spread, stored, utf8_view

MAX_DOCS = 6_000         # labelled rows to learn from
WORDS = 1 << 16          # words kept
GRAMS = 20_000           # n-grams kept of each length
LONGEST = 5
UND = "und"

_LETTERS: list[np.ndarray] = []


def letter_values() -> np.ndarray:
    """A random 64-bit value for each letter, alike for both cases; 0 for other characters."""
    if not _LETTERS:
        low = np.zeros(0x110000, U64)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                small = ch.lower()
                low[c] = ord(small) if len(small) == 1 else c
        _LETTERS.append(np.where(low > 0, mix(low * U64(0x9E3779B97F4A7C15)) | U64(1), U64(0)))
    return _LETTERS[0]


class Words:
    """The words of a chunk: spans in an array of letter values, in which a 0 stands before and
    after every document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        ends = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
        values = np.append(np.insert(letter_values()[points], ends[:-1], U64(0)), U64(0))
        inside = values != 0
        self.start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        self.prefix = prefix_hash(values)
        self.first = np.searchsorted(self.start, ends + np.arange(len(ends)))
        self.hash = span_hash(self.prefix, self.start, self.end)

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of some words, and how many each has."""
        edge = int(n > 1)
        start, size = self.start[which] - edge, np.maximum(self.end[which] - self.start[which] + 2 * edge - n + 1, 0)
        at = spread(start, size)
        return span_hash(self.prefix, at, at + n), size


# ---------------------------------------------------------------- training

def counted(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, kind, key, n): words (kind 0) and n-grams (kind n) with their numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in chunked(batches, text_col, 2 << 20):
            langs = rb.column(lang_col).to_numpy(zero_copy_only=False)
            for lang in sorted(set(langs)):
                words = Words(*utf8_view(rb.column(text_col).filter(pa.array(langs == lang))))
                codes, keys = pd.factorize(words.hash)
                n = np.bincount(codes, minlength=len(keys))
                at = np.zeros(len(keys), np.int64)
                at[codes] = np.arange(len(codes))
                parts = [(0, keys, n)]
                for kind in range(1, LONGEST + 1):
                    h, size = words.grams(at, kind)
                    code, grams = pd.factorize(h)
                    parts.append((kind, grams, np.bincount(code, weights=np.repeat(n, size), minlength=len(grams)).astype(np.int64)))
                for kind, key, n in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(U64).view(np.int64)), pa.array(n)], ["lang", "kind", "key", "n"])

    return docs.select(F.col(lang_col).cast("string").alias(lang_col), text_col).mapInArrow(run, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> dict:
    """A model from labelled rows: {langs, kinds: {kind: (keys, log frequencies)}}."""
    labelled = docs.select(text_col, lang_col, F.xxhash64(*docs.columns).alias("_hash")).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = labelled.count()
    if rows > max_docs:
        labelled = labelled.filter(F.pmod("_hash", F.lit(1 << 30)) < int(max_docs / rows * (1 << 30)))
    counts = stored(counted(labelled, text_col, lang_col), "language-counts")
    totals = {(r["lang"], r["kind"]): (r["sum"], r["keys"]) for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("sum"), F.count("*").alias("keys")).collect()}
    langs = sorted({lang for lang, _ in totals})
    by_key = counts.groupBy("kind", "key").agg(F.sum("n").alias("total"))
    least = by_key.groupBy("kind", F.least("total", F.lit(WORDS)).alias("total")).count().collect()
    kept, bounds = {}, {}
    for r in sorted(least, key=lambda r: -r["total"]):
        kept[r["kind"]] = kept.get(r["kind"], 0) + r["count"]
        if kept[r["kind"]] <= (GRAMS if r["kind"] else WORDS):
            bounds[r["kind"]] = r["total"]
    model = {"langs": langs, "kinds": {}}
    for kind, bound in bounds.items():
        known = by_key.filter((F.col("kind") == kind) & (F.col("total") >= bound)).select("kind", "key")
        got = counts.join(known, ["kind", "key"]).select("lang", "key", "n").toPandas()      # WORDS or GRAMS keys at most
        keys, at = np.unique(got["key"].to_numpy(), return_inverse=True)
        table = np.full((len(keys), len(langs)), 0.5)
        table[at, [langs.index(x) for x in got["lang"]]] += got["n"].to_numpy()
        size = np.array([sum(totals.get((x, kind), (0, 0))) for x in langs], float) + 1
        model["kinds"][kind] = (keys.view(U64), np.log(table / size))
    return model


# ---------------------------------------------------------------- prediction

class Predictor:
    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.index = {k: (HashIndex(keys), table) for k, (keys, table) in model["kinds"].items()}

    def words(self, words: Words, which: np.ndarray) -> np.ndarray:
        """Scores of distinct words in each language."""
        out = np.zeros((len(which), len(self.langs)))
        todo = np.arange(len(which))
        for kind in (0, *range(LONGEST, 0, -1)):
            if kind not in self.index or not len(todo):
                continue
            index, table = self.index[kind]
            if kind == 0:
                found = index.find(words.hash[which[todo]])
                hit = found >= 0
                out[todo[hit]] = table[found[hit]]
            else:
                h, size = words.grams(which[todo], kind)
                found = index.find(h)
                of = np.repeat(np.arange(len(todo)), size)[found >= 0]
                known = np.bincount(of, minlength=len(todo))
                hit = known > 0
                for k in range(len(self.langs)):
                    total = np.bincount(of, weights=table[found[found >= 0], k], minlength=len(todo))
                    out[todo[hit], k] = total[hit] / known[hit]
            todo = todo[~hit]
        return out

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        words = Words(data, offsets)
        n = len(offsets) - 1
        if not self.langs:
            return [UND] * n, np.zeros(n)
        codes, keys = pd.factorize(words.hash)
        at = np.zeros(len(keys), np.int64)
        at[codes] = np.arange(len(codes))
        table = self.words(words, at)
        doc = np.repeat(np.arange(n), np.diff(words.first))
        sums = np.stack([np.bincount(doc, weights=table[codes, k], minlength=n) for k in range(len(self.langs))], 1)
        best = sums.argmax(1)
        share = 1 / np.exp(sums - sums[np.arange(n), best][:, None]).sum(1)
        some = np.diff(words.first) > 0
        return [self.langs[b] if s else UND for b, s in zip(best, some)], np.where(some, share, 0.0)


def predict(docs: DataFrame, model: dict, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the language and its score; columns of these names are replaced."""
    docs = docs.drop(*({lang_out, score_out} - {text_col}))
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(held.value)
        for rb in chunked(batches, text_col):
            lang, score = predictor.chunk(*utf8_view(rb.column(text_col)))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(lang, pa.string()), pa.array(score)], [*names, lang_out, score_out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(lang_out, StringType()), StructField(score_out, DoubleType())]))


def held_out() -> F.Column:
    """Rows kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op9_word_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all rows of documents, learned from those not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    out = predict(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
