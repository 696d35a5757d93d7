"""Shared helpers: storage in the cluster's shared folder, byte-level text views, hashing.

Text work happens on whole Arrow buffers: a chunk of documents is one array of
bytes plus the offsets of each document, so that splitting and hashing of words
is done by numpy over the chunk and not word by word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
CHUNK_BYTES = 1 << 20


# ---------------------------------------------------------------- storage

def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets a
    temporary folder of its own (tests); a cluster gets an error, since its executors
    would not see one another's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:                    # the default file system's path, spelt in full for readers outside Spark
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        root = "file://" + root.removeprefix("file:") if root.startswith("file:/") else root
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path, never used before, in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut and a
    lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- Arrow text

def utf8_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def chunked(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text is a batch of its own."""
    for rb in batches:
        if not rb.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(rb.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, rb.num_rows]):
            yield rb.slice(a, b - a)


# ---------------------------------------------------------------- hashing

def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain): a bijection of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15 | 1):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            up, down = np.full(m, self.base, U64), np.full(m, self.inverse, U64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i; span_hash reads the hash of any span from them."""
    up, _ = POWERS.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), alike for equal content at any place."""
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


BYTE_VALUES = seeds(256, 7)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32                       # A-Z only
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separator bytes, none of which crosses a
    document's end, and for each document the index of its first word (one more at the end)."""
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words with A-Z in lower case."""
    return span_hash(prefix_hash(BYTE_VALUES[LOWER[data]]), starts, ends)


def text_hash(words: list[str]) -> np.ndarray:
    """word_hashes of given words (each without separators)."""
    raw = [w.encode() for w in words]
    off = np.cumsum([0, *map(len, raw)])
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:])


class HashIndex:
    """Static table from 64-bit keys to their positions; lookups are vectorised."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, dtype=U64)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int64)
        todo, at = np.arange(len(self.keys)), (self.keys >> self.shift).astype(np.int64)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]           # of several claims to a slot the last stays
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each key, -1 for an unknown one."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys) or not len(h):
            return out
        todo, at = np.arange(len(h)), (h >> self.shift).astype(np.int64)
        while len(todo):
            got = self.slot[at]
            hit = (got >= 0) & (self.keys[got] == h[todo])
            out[todo[hit]] = got[hit]
            more = (got >= 0) & ~hit
            todo, at = todo[more], (at[more] + 1) & self.mask
        return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
