"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are reduced to lower-case letters and digits with single blanks.
An item of n characters that stands in a document with at most e edits shares at least
n + 1 - Q * (e + 1) of its q-grams with the document, all on diagonals (document position
minus item position) that differ by at most e. So the shared q-grams are counted in
overlapping bands of diagonals, each twice as wide as e; the bands that reach the bound are
the only regions that can hold the item, and each is verified by a banded alignment, which
gives the least number of edits and the region itself.

Items too short for the lemma at their edit budget get the largest budget for which the
bound is positive. An item of fewer than Q reduced characters has no q-gram and is matched
exactly, on word borders, in the same scan; beside a character of a script written without
blanks a word ends anywhere.

The benchmark is the stated query set: it is read in blocks of BLOCK_CHARS characters, and
each block's q-gram index, of bounded size therefore, is broadcast to a scan of all
documents. Nothing else is broadcast and no rows are shuffled but the hits.

Defined cases: null and empty texts, and items without a letter or digit, match nothing;
repeated documents and items are matched each for themselves; null ids are kept as they
are; an empty table on either side gives an empty result; only the named columns are read.
Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.llm.common import HashIndex, U64, chunked, mix, read, stored, utf8_view

Q = 9
EDIT_SHARE = 0.09              # edits allowed per character of an item; the lemma's bound stays a sixth of the grams
NO_BLANKS = 0x2E80             # from this code point on, words are written without blanks between
BLOCK_CHARS = 2_000_000        # benchmark characters in one broadcast index
BLANK = 32


def fold_table() -> np.ndarray:
    """For each code point its lower-case form where that is one character, or a blank where
    it is neither letter nor digit."""
    out = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_FOLD: list[np.ndarray] = []


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reduced characters of a chunk; their places in code points of the chunk; the first
    reduced character of each document (one more at the end). Each document ends with a blank."""
    if not _FOLD:
        _FOLD.append(fold_table())
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    ends = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    low = _FOLD[0][points]
    keep = low != BLANK
    blank = ~keep
    first_blank = blank.copy()
    first_blank[1:] &= keep[:-1]                        # of a run of blanks the first stays
    stay = keep | first_blank
    edge = ends[1:-1]
    edge = edge[(edge > 0) & (edge < len(low))]
    stay[edge[blank[edge]]] = True
    place = np.flatnonzero(stay)
    return low[place], place, np.searchsorted(place, ends)


def gram_hashes(chars: np.ndarray, size: int | None = None) -> np.ndarray:
    """Hashes of the ``size`` (Q) characters from each place on."""
    size = Q if size is None else size
    n = len(chars) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    base = U64(0x9E3779B97F4A7C15 | 1)
    for k in range(size):
        h *= base
        h += chars[k:k + n]
    return mix(h)


def budget(n: int) -> int:
    """Edits allowed in an item of n reduced characters: EDIT_SHARE of them, or as many as leave
    the lemma a bound of at least 1."""
    return max(0, min(int(EDIT_SHARE * n), (n - Q) // Q))


class Index:
    """The q-grams of a block of items: sorted hashes with their item and place, and a bitmap
    that tells most other grams apart at once."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids, self.texts, hashes, item, place = [], [], [], [], []
        short: dict[int, dict[int, list[int]]] = {}          # of items without a gram: length -> hash -> items
        for i, text in items:
            raw = text.encode()
            chars, _, _ = fold(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            inside = np.flatnonzero(chars != BLANK)
            if not len(inside):
                continue
            chars = chars[inside[0]:inside[-1] + 1]
            if chars.size < Q:
                short.setdefault(chars.size, {}).setdefault(int(gram_hashes(chars, chars.size)[0]), []).append(len(self.ids))
            h = gram_hashes(chars)
            hashes.append(h)
            item.append(np.full(len(h), len(self.ids)))
            place.append(np.arange(len(h)))
            self.ids.append(i)
            self.texts.append(chars)
        hashes, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, item, place))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order].astype(U64), item[order].astype(np.int32), place[order].astype(np.int32)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(len(t)) for t in self.texts], np.int64)
        self.bound = np.maximum(1, self.size + 1 - Q * (self.edits + 1))
        self.short = {size: (HashIndex(np.array(list(of), U64)), list(of.values())) for size, of in short.items()}
        self.shift = U64(64 - 22)
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(self.hashes >> self.shift).astype(np.int64)] = True

    def exact(self, chars: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, start, end) of the places of the items without a gram."""
        apart = (chars == BLANK) | (chars >= NO_BLANKS)
        for size, (index, items) in self.short.items():
            found = index.find(gram_hashes(chars, size))
            for at in np.flatnonzero(found >= 0).tolist():
                to = at + size
                if doc[at] != doc[to - 1]:
                    continue
                if not (at == 0 or doc[at - 1] != doc[at] or apart[at - 1] or apart[at]):
                    continue
                if not (to == len(chars) or doc[to] != doc[at] or apart[to] or apart[to - 1]):
                    continue
                for i in items[found[at]]:
                    if np.array_equal(self.texts[i], chars[at:to]):
                        yield int(doc[at]), i, at, to

    def regions(self, chars: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, item, least diagonal) of the bands that reach the lemma's bound."""
        none = tuple(np.zeros(0, np.int64) for _ in range(3))
        h = gram_hashes(chars)
        at = np.flatnonzero(self.bitmap[(h >> self.shift).astype(np.int64)])
        low, high = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        n = high - low
        if not n.sum():
            return none
        hit = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        at = np.repeat(at, n)
        item = self.item[hit].astype(np.int64)
        diagonal = at - self.place[hit]
        # a gram counts in the two bands that hold its diagonal: bands are 2e + 2 wide and begin every e + 1
        step = self.edits[item] + 1
        band = np.floor_divide(diagonal, step)
        key_doc = doc[at]
        rows = np.concatenate([np.stack([key_doc, item, band]), np.stack([key_doc, item, band - 1])], 1)
        place = np.concatenate([self.place[hit]] * 2)
        order = np.lexsort((place, rows[2], rows[1], rows[0]))
        rows, place = rows[:, order], place[order]
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
        other = new.copy()
        other[1:] |= place[1:] != place[:-1]             # each of the item's grams counts once in a band
        begin = np.flatnonzero(new)
        count = np.add.reduceat(other, begin)
        rows = rows[:, begin]
        good = count >= self.bound[rows[1]]
        return rows[0, good], rows[1, good], rows[2, good] * (self.edits[rows[1, good]] + 1)


def align(text: np.ndarray, item: np.ndarray, low: int, width: int) -> tuple[int, int, int]:
    """Least edits, start and end of a region of ``text`` that the whole ``item`` matches, over
    alignments whose diagonals lie in [low, low + width). The region may begin and end anywhere
    in the band; a cell of the band is (items' characters so far, diagonal)."""
    n = len(item)
    span = np.zeros(n + width, np.uint32)                # 0 beyond the text: equal to no character
    a, b = max(low, 0), min(low + n + width, len(text))
    span[a - low:b - low] = text[a:b]
    ramp = np.arange(width)
    cost, begin = np.zeros(width, np.int64), ramp.copy()
    for i, c in enumerate(item.tolist()):
        new, source = cost + (span[i:i + width] != c), begin
        left_out = cost[1:] + 1                          # a character of the item without one of the text
        use = left_out < new[:-1]
        new[:-1][use] = left_out[use]
        source = np.where(np.append(use, False), np.append(begin[1:], 0), source)
        least = np.minimum.accumulate(new - ramp)        # and of the text without one of the item
        at = np.maximum.accumulate(np.where(new - ramp == least, ramp, 0))
        cost, begin = least + ramp, source[at]
    k = int(cost.argmin())
    return int(cost[k]), low + int(begin[k]), low + n + k


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document, item and place where the item stands: doc_id, item_id,
    start and end (code points of the document, end exclusive), edits."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start long, end long, edits long"
    item_type = items.select(item_id).limit(0).toArrow().schema.field(0).type
    found = None
    for block in blocks(items, item_id, item_text):
        index = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            held = Index(index.value)
            for rb in chunked(batches, text, 1 << 20):
                rows = chunk_matches(held, *utf8_view(rb.column(text)))
                if rows:
                    d, i, s, e, k = zip(*rows)
                    yield pa.RecordBatch.from_arrays([rb.column(doc_id).take(pa.array(d)), pa.array([held.ids[x] for x in i], item_type), *(pa.array(x, pa.int64()) for x in (s, e, k))], ["doc_id", "item_id", "start", "end", "edits"])

        part = docs.select(doc_id, text).mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found


def blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of BLOCK_CHARS characters, passed through the driver one at a time."""
    block, size = [], 0
    for row in items.select(item_id, item_text).filter(F.col(item_text).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def chunk_matches(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, item, start, end, edits) of a chunk's verified regions, one for each place."""
    chars, place, first = fold(data, offsets)
    if not len(index.ids) or not len(chars):
        return []
    chars = np.append(chars, np.full(Q, BLANK, np.uint32))
    doc = np.searchsorted(first, np.arange(len(chars)), "right") - 1
    begins = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)     # documents' first code points
    rows: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for d, i, diagonal in zip(*(x.tolist() for x in index.regions(chars, doc))):
        e = int(index.edits[i])
        if d >= len(first) - 1:
            continue
        text, item = chars[first[d]:first[d + 1]], index.texts[i]
        low = diagonal - int(first[d])
        whole = text[max(low, 0):low + 2 * e + 2 + len(item)].tobytes().find(item.tobytes())
        if whole >= 0 and whole % 4 == 0:
            cost, s = 0, max(low, 0) + whole // 4
            t = s + len(item)
        else:
            cost, s, t = align(text, item, low - e, 4 * e + 2)
        if cost > e:
            continue
        s, t = max(s, 0) + int(first[d]), min(t, len(text)) + int(first[d])
        while s < t and chars[s] == BLANK:
            s += 1
        while t > s and chars[t - 1] == BLANK:
            t -= 1
        rows.setdefault((d, i), []).append((cost, s, t))
    for d, i, s, t in index.exact(chars, doc):
        if d < len(first) - 1:
            rows.setdefault((d, i), []).append((0, s, t))
    out = []
    for (d, i), spans in rows.items():
        chosen: list[tuple[int, int, int]] = []
        for cost, s, t in sorted(spans):                                         # of overlapping regions the best
            if all(t <= a or s >= b for _, a, b in chosen):
                chosen.append((cost, s, t))
        for cost, s, t in sorted(chosen, key=lambda x: x[1]):
            out.append((d, i, int(place[s] - begins[d]), int(place[t - 1] + 1 - begins[d]), cost))
    return sorted(out)


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item stands. Rows are told apart by their text,
    so rows that share an id (or have none) are judged each for itself."""
    key = F.md5(F.coalesce(text, F.lit("")))
    leaks = stored(matches(docs.select(key.alias("key"), F.col(text).alias("text")), items, "key").select(F.col("doc_id").alias("__leak")).distinct(), "leaks")
    return docs.withColumn("__text_key", key).join(leaks, F.col("__text_key") == F.col("__leak"), "left_anti").drop("__text_key")


def op4_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of documents where an item of benchmark stands, whole texts."""
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
