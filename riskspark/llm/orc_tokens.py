"""Token ids in ORC: integer run-length encoded ids in stripes, with row indexes and Bloom
filters on document ids.

Texts are dealt out by ranges of document id, encoded after that shuffle (texts compress
better than ids) and written sorted, so each file and stripe covers a narrow id range:
readers split files by stripes, and a look-up by id skips files and stripes by their
minimum and maximum and row groups by Bloom filter (``lookup``).

The tokenizers library encodes each distinct pre-token once per chunk; a bounded memo of
each Python worker keeps recent ones, and its entries are compared byte by byte. Texts are whole; the encoding of a text is the concatenation of
its pre-tokens' encodings, which the tests hold against the library on whole texts.

Defined cases: a null text is an empty one (the end id alone); null ids come first; rows
that repeat an id are ordered by a hash of their text; an empty table gives an empty file
set; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskspark.llm.common import BYTE_VALUES, chunked, prefix_hash, read, shared_path, span_hash, spread, stored, utf8_view
from riskspark.llm.pretokens import SPECIAL, PreTokenizer

END_ID = 2
MEMO = 1_200_000           # pre-tokens a worker remembers
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000",
           "orc.stripe.size": str(16 << 20), "compression": "zstd"}


class Memo:
    """Entries of hashed pre-tokens, in an open-addressing table that numpy searches. A hash only
    finds an entry; whether it is that of the same bytes is for the caller to see."""

    def __init__(self, bits: int = 21):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.entry, self.n = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        out, todo, at = np.full(len(h), -1, np.int64), np.arange(len(h)), (h >> self.shift).astype(np.int64)
        while len(todo):
            got = self.entry[at]
            hit = (got >= 0) & (self.keys[at] == h[todo])
            out[todo[hit]] = got[hit]
            more = (got >= 0) & ~hit
            todo, at = todo[more], (at[more] + 1) & self.mask
        return out

    def add(self, h: np.ndarray) -> None:
        """New keys; they get the next entries. Of equal ones the first that is found holds."""
        entries = np.arange(self.n, self.n + len(h), dtype=np.int32)
        todo, at = np.arange(len(h)), (h >> self.shift).astype(np.int64)
        while len(todo):
            free = self.entry[at] < 0
            self.entry[at[free]] = entries[todo[free]]     # of several claims to a slot the last stays
            own = self.entry[at] == entries[todo]
            self.keys[at[own]] = h[todo[own]]
            todo, at = todo[~own], (at[~own] + 1) & self.mask
        self.n += len(h)


class LibraryEncoder:
    """Whole texts to ids, through the tokenizers library."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = special_as_text
        self.cutter = PreTokenizer()
        self.bytes_of = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.bytes_of[i] = len(token)                  # byte-level: a character of the token is a byte
        self.forget()

    def forget(self) -> None:
        self.memo, self.used = Memo(), 0
        self.at, self.size, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)
        self.text_at, self.text, self.written = np.zeros((1 << 16) + 1, np.int64), np.zeros(1 << 20, np.uint8), 0

    def joined(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, gap: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that stay pre-tokens in one text, and how many each has; the bytes
        of the ids tell which belong to which."""
        text = data[np.minimum(spread(start, size + len(gap)), len(data) - 1)]
        ends = np.cumsum(size + len(gap)) - len(gap)
        if gap:
            text[ends] = gap[0]
        got = np.array(self.library.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.int32)
        reach = np.cumsum(self.bytes_of[got])
        last = np.searchsorted(reach, ends)
        if not np.array_equal(reach[last], ends):
            raise ValueError("the library cut a pre-token otherwise")
        first = np.concatenate([[0], last[:-1] + 1 + len(gap)])
        return got if not gap else got[spread(first, last + 1 - first)], last + 1 - first

    def singly(self, data: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given pre-tokens, one call for each, and how many each has."""
        ids = [e.ids for e in self.library.encode_batch_fast([data[bounds[k]:bounds[k + 1]].tobytes().decode() for k in which], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)

    def learn(self, data: np.ndarray, bounds: np.ndarray, new: np.ndarray, hashes: np.ndarray) -> None:
        """Adds pre-tokens to the memo. Those that begin with a blank are encoded as one text,
        those without white space as another with line ends between, the few others singly."""
        start, end = bounds[new], bounds[new + 1]
        head, tail = data[start], data[end - 1]
        blank = (head == 0x20) & (tail > 0x20)
        solid = (head > 0x20) & (head < 0x7F) & (end - start != len(SPECIAL))
        for which, gap in ((blank, b""), (solid, b"\n"), (~blank & ~solid, None)):
            which = np.flatnonzero(which)
            for part in np.split(which, range(20_000, len(which), 20_000)):
                if len(part):
                    flat, size = self.joined(data, start[part], end[part] - start[part], gap) if gap is not None else self.singly(data, bounds, new[part])
                    self.remember(data, start[part], end[part], hashes[new[part]], flat, size)

    def remember(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        n, length = self.memo.n, end - start
        total = int(length.sum())
        while n + len(size) > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
            self.text_at = np.resize(self.text_at, len(self.at) + 1)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        while self.written + total > len(self.text):
            self.text = np.resize(self.text, 2 * len(self.text))
        self.pool[self.used:self.used + len(flat)] = flat
        self.at[n:n + len(size)] = self.used + np.cumsum(size) - size
        self.size[n:n + len(size)] = size
        self.text[self.written:self.written + total] = data[spread(start, length)]
        self.text_at[n:n + len(size) + 1] = self.written + np.concatenate([[0], np.cumsum(length)])
        self.used, self.written = self.used + len(flat), self.written + total
        self.memo.add(hashes)

    def found(self, data: np.ndarray, bounds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The memo's entry of each pre-token (-1 for none), and whether it is of the same bytes."""
        entry = self.memo.find(hashes)
        known = np.flatnonzero(entry >= 0)
        size = bounds[known + 1] - bounds[known]
        alike = size == self.text_at[entry[known] + 1] - self.text_at[entry[known]]
        known, size = known[alike], size[alike]
        differs = data[spread(bounds[known], size)] != self.text[spread(self.text_at[entry[known]], size)]
        wrong = np.add.reduceat(differs, np.cumsum(size) - size) if len(known) else size
        same = np.zeros(len(entry), bool)
        same[known[wrong == 0]] = True
        return entry, same

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk and the number of ids of each document."""
        codes, first, held, bounds = self.cutter.distinct(data, offsets)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        hashes = span_hash(prefix_hash(BYTE_VALUES[held]), bounds[:-1], bounds[1:])
        if self.memo.n + len(hashes) > MEMO:
            self.forget()
            if len(hashes) > MEMO:
                self.memo = Memo(int(2 * len(hashes)).bit_length())
        new = np.flatnonzero(self.memo.find(hashes) < 0)
        if len(new):
            self.learn(held, bounds, new, hashes)
        entry, same = self.found(held, bounds, hashes)
        at, size, pool = self.at[entry], self.size[entry].astype(np.int64), self.pool
        if len(other := np.flatnonzero(~same)):              # their hash is that of other bytes
            flat, size[other] = self.singly(held, bounds, other)
            at[other] = self.used + np.cumsum(size[other]) - size[other]
            pool = np.concatenate([pool[:self.used], flat])
        ids = pool[spread(at[codes], size[codes])]
        total = np.concatenate([[0], np.cumsum(size[codes])])
        return ids, total[first[1:]] - total[first[:-1]]


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder_of(path: str) -> LibraryEncoder:
    """This worker's encoder: its memo serves all tasks that the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """doc_id, part and line (place in the sorted whole), ids; sorted by id within each part,
    parts in ascending order of id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, line = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        for rb in chunked(batches, "text", 2 << 20):
            ids, n = encoder.encode(*utf8_view(rb.column("text")))
            if end_id is not None:
                ends = np.cumsum(n)
                ids, n = np.insert(ids, ends, np.int32(end_id)), n + 1
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
            rows = rb.num_rows
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(line, line + rows)), lists], ["doc_id", "part", "line", "ids"])
            line += rows

    order = F.xxhash64("text")
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id", order).sortWithinPartitions("doc_id", order)
    return dealt.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, part int, line long, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer: str, **columns) -> None:
    encode(docs, tokenizer, **columns).write.options(**OPTIONS).orc(path)


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, part, line, n_tokens, ids_crc32 of the ids as written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            lists = rb.column("ids")
            off, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in ("doc_id", "part", "line")), pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "part", "line", "n_tokens", "ids_crc32"])

    kind = dict(tokens.dtypes)["doc_id"]
    return tokens.select("doc_id", "part", "line", "ids").mapInArrow(run, f"doc_id {kind}, part int, line long, n_tokens long, ids_crc32 long")


def starts(rows: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before. Parts are summed first; the running sum
    over parts has one row a file, that within a part the rows of one file."""
    before = rows.groupBy("part").agg(F.sum("n_tokens").alias("_sum")).withColumn(
        "_before", F.sum("_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).drop("_sum")
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.join(before, "part").withColumn("start", F.col("_before") + inside).drop("_before")


def lookup(tokens: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of the given documents; the condition reaches the ORC reader, which prunes by it."""
    return tokens.filter(F.col("doc_id").isin(ids))


def op5_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every row of documents as ORC and reads the files back."""
    import public_tokenizers

    path = shared_path(spark, "orc-tokens")
    write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = stored(digest(spark.read.schema("doc_id long, part int, line long, ids array<int>").orc(path)), "orc-rows")
    return starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
