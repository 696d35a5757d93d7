"""Ranked lexical search in reverse: the queries are indexed and the documents stream by.

The items' terms form an inverted index (term -> items that hold it, and how often). It is
broadcast, and each task streams the term counts of its documents through it: a document's
terms meet their postings, contributions are summed for each item, and the k best documents
of each item are kept in bounded heaps. A task gives out its heaps alone; they are merged by
ranking within buckets of tasks and then over the buckets, so nothing but heaps is shuffled.

Items are taken in blocks of at most ``BLOCK_ITEMS`` items and about ``BLOCK_BYTES`` of text
(a longer item is a block of its own), one after another: each block's index is broadcast to
two scans of the documents - its terms' document frequencies, then the scores -, its heaps
are written, and the broadcast is dropped, so memory doesn't grow with the number of items.

The score is integer throughout but for the terms' weights (floor of a logarithm). Terms are
compared by their bytes.

Defined cases: a null, empty or term-less text is no document of the statistics and never
ranked; an item without terms has no rows; rows are documents (items) of their own, so of
repeated rows each is ranked (has its ranks); equal scores rank by ascending id, null ids
last, and equal ids in any order, as such rows can't be told apart; other columns of any name
aren't read; an empty table of either kind gives an empty result; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskspark.llm.common import LOWER, chunked, read, spread, stored, utf8_view, word_spans
from riskspark.llm.pieces import words

TOP = 10
BLOCK_ITEMS = 4096
BLOCK_BYTES = 1 << 20
CELLS = 1 << 21              # sums (documents x items) and contributions held at a time
BUCKETS = 64                 # of tasks, whose heaps are merged first

# [0-9A-Za-z] and every byte of a character beyond ASCII
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms(col: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """For each term of a column of texts the number of its value; the values; and for each
    text the index of its first term (one more at the end)."""
    data, off = utf8_view(col)
    data = LOWER[data]
    start, end, first = word_spans(data, off, SEPARATOR)
    codes, values = words(data, start, end)
    return codes, values, first


class Index:
    """Inverted index of a block of items."""

    def __init__(self, texts: list[str | None]):
        codes, values, first = terms(pa.array(texts, pa.string()))
        used, codes = np.unique(codes, return_inverse=True)
        self.terms, self.items = values.take(pa.array(used)), len(texts)
        pair, self.repeats = np.unique(codes * len(texts) + np.repeat(np.arange(len(texts)), np.diff(first)), return_counts=True)
        self.item = pair % max(1, len(texts))
        self.at = np.searchsorted(pair // max(1, len(texts)), np.arange(len(used) + 1))

    def counts(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the terms that the index holds: document, term and count in it, by document;
        and the number of all terms of each document."""
        codes, values, first = terms(col)
        n = np.diff(first)
        known = pc.fill_null(pc.index_in(values, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        term = known[codes] if len(codes) else codes
        keep = term >= 0
        width = max(1, len(self.terms))
        pair, tf = np.unique(np.repeat(np.arange(len(n)), n)[keep] * width + term[keep], return_counts=True)
        return pair // width, pair % width, tf, n


class Heaps:
    """The k best (score, document) of each item, in order. Bounded by k x items."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)      # least: a score below can't enter
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        doc, null = np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order, item, rank = order[rank < self.k], item[rank < self.k], rank[rank < self.k]
        self.item, self.score, self.doc, self.null = item, score[order], doc[order], null[order]
        full = rank == self.k - 1
        self.least[item[full]] = self.score[full]


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def length_term(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 75 + (75 * n * docs) div total, exact also where a product needs over 64 bits."""
    whole, rest = divmod(75 * docs, max(1, total))
    if int(n.max(initial=0)) * rest >= 1 << 63:
        return 25 + n * whole + np.array([k * rest // total for k in n.tolist()], np.int64)
    return 25 + n * whole + (n * rest) // max(1, total)


def scored(index: Index, weight: np.ndarray, docs: int, total: int, heaps: Heaps, col: pa.Array, ids: np.ndarray, null: np.ndarray) -> None:
    """Streams a chunk of documents through the index into the heaps."""
    doc, term, tf, n = index.counts(col)
    if not len(doc):
        return
    gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length_term(n, docs, total)[doc]))
    fan = (index.at[1:] - index.at[:-1])[term]
    step = max(1, CELLS // index.items)
    for low in range(0, len(n), step):
        high = min(low + step, len(n))
        a, b = np.searchsorted(doc, [low, high])
        sums = np.zeros((high - low) * index.items, np.int64)
        made = np.concatenate([[0], np.cumsum(fan[a:b])])
        at = 0
        while at < b - a:                                     # a term has at most one posting an item
            to = max(at + 1, int(np.searchsorted(made, made[at] + CELLS, "right")) - 1)
            part = slice(a + at, a + to)
            posting = spread(index.at[term[part]], fan[part])
            np.add.at(sums, np.repeat((doc[part] - low) * index.items, fan[part]) + index.item[posting], np.repeat(gain[part], fan[part]) * index.repeats[posting])
            at = to
        sums = sums.reshape(high - low, index.items)
        where, item = np.nonzero(sums >= heaps.least)
        if len(where):
            heaps.add(item, sums[where, item], ids[low + where], null[low + where])


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, a block at a time; the driver holds one block and one
    partition of the items."""
    ids, texts, held = [], [], 0
    for r in items.select(id_col, text_col).toLocalIterator():
        size = len((r[1] or "").encode())
        if ids and (held + size > BLOCK_BYTES or len(ids) >= BLOCK_ITEMS):
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        held += size
    if ids:
        yield ids, texts


def statistics(docs: DataFrame, index, text_col: str) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each term of the index the documents
    that hold it. A task gives out one row a term; collected are as many as the index has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        df, seen, total = np.zeros(len(own.terms), np.int64), 0, 0
        for rb in chunked(batches, text_col):
            _, term, _, n = own.counts(rb.column(text_col))
            df += np.bincount(term, minlength=len(df))
            seen, total = seen + int((n > 0).sum()), total + int(n.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *held.tolist()], pa.int64()), pa.array([total, seen, *df[held].tolist()], pa.int64())], ["term", "n"])

    rows = docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    got = {r["term"]: r["n"] for r in rows}
    df = np.zeros(len(index.value.terms), np.int64)
    for term, n in got.items():
        if term >= 0:
            df[term] = n
    return got.get(-1, 0), got.get(-2, 0), df


def heaps_of(docs: DataFrame, index, weight: np.ndarray, n: int, total: int, doc_col: str, text_col: str, k: int) -> DataFrame:
    """Rows of the tasks' heaps: place of the item in its block, doc_id, score, task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = index.value
        heaps = Heaps(own.items, k)
        for rb in chunked(batches, "text"):
            ids = rb.column("doc_id")
            scored(own, weight, n, total, heaps, rb.column("text"), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(heaps.item), pa.array(heaps.doc, mask=heaps.null), pa.array(heaps.score), pa.array(np.full(len(heaps.item), TaskContext.get().partitionId()), pa.int64())], ["place", "doc_id", "score", "task"])

    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "place long, doc_id long, score long, task long")


def best(rows: DataFrame, by: list[str], k: int, out: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item. Ids are integers."""
    spark = docs.sparkSession
    item_kind = items.schema[item_col].dataType.simpleString()
    found = []
    for ids, texts in blocks(items, item_col, text_col):
        index = spark.sparkContext.broadcast(Index(texts))
        if len(index.value.terms):
            n, total, df = statistics(docs, index, text_col)
            heaps = heaps_of(docs, index, weights(df, n), n, total, doc_col, text_col, k)
            heaps = best(heaps.withColumn("bucket", F.col("task") % BUCKETS), ["place", "bucket"], k, "near").select("place", "doc_id", "score")
            rows = stored(best(heaps, ["place"], k, "rank"), "search-heaps")
            names = spark.createDataFrame(list(enumerate(ids)), f"place long, `{item_col}` {item_kind}")
            found.append(rows.join(F.broadcast(names), "place").select(item_col, "rank", "doc_id", "score"))     # BLOCK_ITEMS rows at most
        index.destroy()
    if not found:
        return spark.createDataFrame([], f"`{item_col}` {item_kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


def op13_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all documents for every item of benchmark."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), q AS (
  SELECT item_id, t, count(*) AS qtf
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY ALL
), stats AS (
  SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0
), tf AS (
  SELECT doc_id, len, t, count(*) AS tf
  FROM (SELECT doc_id, len(terms)::BIGINT AS len, unnest(terms) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY ALL
), w AS (
  SELECT t, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, stats GROUP BY t
), scores AS (
  SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len * n) // l))))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN w USING (t), stats GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0
) WHERE rank <= 10
"""
