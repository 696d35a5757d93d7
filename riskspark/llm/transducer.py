"""BPE encoding and decoding with a transducer lexicon.

The corpus's frequent pre-tokens are compiled into a minimal acyclic automaton (shared
prefixes and suffixes). Each transition carries the number of words that sort before it, so
the sum along a path is the word's number, and that number's entry in a table is the word's
ids: the automaton maps a word to its ids. One file holds the automaton, the id lists and
the merge table; it is written to the shared folder, handed to executors by Spark and
memory-mapped there, so workers of one machine share its pages.

A chunk's distinct pre-tokens walk the automaton together, a byte per step. Pre-tokens that
it doesn't hold are merged exactly, pair by pair in order of rank, many words at a time.
Which words are in the lexicon changes the speed and never the ids.

Defined cases: a null or empty text has no ids and decodes to the empty text; rows are
judged by themselves, so repeated rows, null ids and extra columns of any name change
nothing; an empty table gives an empty result (and an empty lexicon); very long texts are
read whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.llm.common import HashIndex, U64, chunked, mix, read, shared_path, spread, stored, utf8_view
from riskspark.llm.pretokens import SPECIAL, PreTokenizer

LEXICON_WORDS = 1 << 16      # a bound on the lexicon: the most frequent pre-tokens
BATCH_BYTES = 32             # words up to this length are merged many at a time
NO_PAIR = np.int64(1 << 40)


def byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary and the bytes they stand for: printable Latin-1
    bytes stand for themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


# ---------------------------------------------------------------- the automaton

def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Transitions and finality of the minimal acyclic automaton of sorted, distinct words.
    Words are added in order; a finished branch is replaced by an equal known state."""
    next_of, final, known = [{}], [False], {}
    path: list[tuple[int, int, int]] = []          # state, byte, child along the last word
    free: list[int] = []

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            state, byte, child = path.pop()
            key = (final[child], *sorted(next_of[child].items()))
            if (same := known.get(key)) is not None:
                next_of[state][byte] = same
                next_of[child] = {}
                free.append(child)
            else:
                known[key] = child

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        state = path[-1][2] if path else 0
        for byte in word[common:]:
            if free:
                child = free.pop()
                final[child] = False
            else:
                child = len(next_of)
                next_of.append({})
                final.append(False)
            next_of[state][byte] = child
            path.append((state, byte, child))
            state = child
        final[state] = True
        last = word
    settle(0)
    return next_of, final


def number_words(next_of: list[dict[int, int]], final: list[bool]) -> tuple[np.ndarray, ...]:
    """Transition arrays (from, byte, to, words before) of what the start state reaches."""
    count, order, todo = {}, [], [(0, False)]
    while todo:
        state, done = todo.pop()
        if done:
            count[state] = final[state] + sum(count[c] for c in next_of[state].values())
            order.append(state)
        elif state not in count:
            count[state] = 0
            todo.append((state, True))
            todo += [(c, False) for c in next_of[state].values() if c not in count]
    rows = []
    for state in order:
        before = int(final[state])
        for byte in sorted(next_of[state]):
            child = next_of[state][byte]
            rows.append((state, byte, child, before))
            before += count[child]
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def transition_keys(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix((state.astype(U64) << U64(8)) | byte.astype(U64))


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a.astype(U64) << U64(32)) | b.astype(U64))


# ---------------------------------------------------------------- the file

def save(arrays: dict[str, np.ndarray], uri: str) -> None:
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    place, path = fs.FileSystem.from_uri(uri)
    place.create_dir(path.rpartition("/")[0], recursive=True)
    with place.open_output_stream(path, compression=None) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        f.write(b"\0" * (-(8 + len(text)) % 64))
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 64))


def load(path: str) -> dict[str, np.ndarray]:
    whole = np.asarray(np.memmap(path, np.uint8, "r"))      # plain views: the pages stay mapped
    n = int.from_bytes(whole[:8].tobytes(), "little")
    base = -(-(8 + n) // 64) * 64
    return {k: whole[base + at:base + at + size * np.dtype(kind).itemsize].view(kind) for k, (kind, size, at) in json.loads(whole[8:8 + n].tobytes()).items()}


def mapped_index(keys: np.ndarray, slots: np.ndarray) -> HashIndex:
    """A HashIndex over arrays that were built before."""
    out = HashIndex.__new__(HashIndex)
    bits = len(slots).bit_length() - 1
    out.keys, out.slot, out.shift, out.mask = keys, slots, U64(64 - bits), len(slots) - 1
    return out


# ---------------------------------------------------------------- the coder

class Coder:
    """Encodes and decodes chunks by the arrays of a lexicon file."""

    def __init__(self, a: dict[str, np.ndarray]):
        self.a = a
        self.pairs = mapped_index(a["pair_keys"], a["pair_slots"])
        self.moves = mapped_index(a["move_keys"], a["move_slots"])
        self.cutter = PreTokenizer()
        self.rank_of: dict[int, int] | None = None           # of pairs, made for the first long word

    def walk(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each word in the lexicon, -1 where it isn't there."""
        state, number = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        alive = np.arange(len(start))
        at = start.copy()
        while len(alive := alive[at[alive] < end[alive]]):
            move = self.moves.find(transition_keys(state[alive], data[at[alive]]))
            state[alive[move < 0]] = -1
            alive, move = alive[move >= 0], move[move >= 0]
            number[alive] += self.a["move_before"][move]
            state[alive] = self.a["move_to"][move]
            at[alive] += 1
        ended = state >= 0
        ended[ended] = self.a["final"][state[ended]] > 0 if len(self.a["final"]) else False
        return np.where(ended, number, -1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.pairs.find(pair_keys(a, b))
        return np.where(found < 0, NO_PAIR, found)

    def merge_batch(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges words of one length (rows of byte ids); returns the rows and their lengths."""
        rows, width = symbols.shape
        size = np.full(rows, width, np.int64)
        if width == 1:
            return symbols, size
        ranks = np.full((rows, width), NO_PAIR)
        ranks[:, :-1] = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, width - 1)
        active, columns = np.arange(rows), np.arange(width)
        while len(active):
            r = ranks[active]
            best = r.argmin(1)
            low = r[np.arange(len(active)), best]
            go = low < NO_PAIR
            active, best, low, r = active[go], best[go], low[go], r[go]
            if not len(active):
                break
            s = symbols[active]
            k = np.arange(len(active))
            s[k, best] = self.a["pair_ids"][low]
            moved = np.minimum(columns + (columns > best[:, None]), width - 1)
            s, r = np.take_along_axis(s, moved, 1), np.take_along_axis(r, moved, 1)
            size[active] -= 1
            n = size[active]
            r[k, n - 1] = NO_PAIR
            has = best > 0
            r[k[has], best[has] - 1] = self.rank(s[k[has], best[has] - 1], s[k[has], best[has]])
            has = best < n - 1
            r[k[has], best[has]] = self.rank(s[k[has], best[has]], s[k[has], best[has] + 1])
            r[columns >= (n - 1)[:, None]] = NO_PAIR
            symbols[active], ranks[active] = s, r
        return symbols, size

    def merge_long(self, word: bytes) -> list[int]:
        """Merges one long word with a heap of (rank, place)."""
        if self.rank_of is None:
            self.rank_of = dict(zip(self.a["pair_raw"].tolist(), range(len(self.a["pair_raw"]))))
        rank, made = self.rank_of.get, self.a["pair_ids"]
        ids = self.a["byte_ids"][np.frombuffer(word, np.uint8)].tolist()
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap = [(r, k, x, y) for k, (x, y) in enumerate(zip(ids, ids[1:])) if (r := rank(x << 32 | y)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, x, y = heapq.heappop(heap)
            n = after[k] if ids[k] >= 0 else -1
            if n < 0 or ids[k] != x or ids[n] != y:
                continue
            ids[k], ids[n], after[k] = int(made[r]), -1, after[n]
            if after[k] >= 0:
                before[after[k]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q >= 0 and (r := rank(ids[p] << 32 | ids[q])) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, one after another, and how many each has."""
        a = self.a
        number = self.walk(data, start, end)
        size, flat_at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        pool, used = [a["word_ids"]], len(a["word_ids"])
        known = number >= 0
        flat_at[known] = a["word_at"][number[known]]
        size[known] = a["word_at"][number[known] + 1] - flat_at[known]
        length = end - start
        special = np.frombuffer(SPECIAL.encode(), np.uint8)
        for k in np.flatnonzero(~known & (length == len(special))):
            if np.array_equal(data[start[k]:end[k]], special):
                pool.append(a["special_id"])
                flat_at[k], size[k], known[k], used = used, 1, True, used + 1
        for n in np.unique(length[~known]):
            which = np.flatnonzero(~known & (length == n))
            if n <= BATCH_BYTES:
                got, kept = self.merge_batch(a["byte_ids"][data[start[which][:, None] + np.arange(n)]].astype(np.int64))
                flat = got[np.arange(n) < kept[:, None]]
            else:
                lists = [self.merge_long(data[start[k]:end[k]].tobytes()) for k in which]
                kept, flat = np.array([len(x) for x in lists]), np.concatenate([np.array(x, np.int64) for x in lists])
            flat_at[which], size[which] = used + np.cumsum(kept) - kept, kept
            pool.append(flat.astype(np.int32))
            used += len(flat)
        return np.concatenate(pool)[spread(flat_at, size)], size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk, and the place of each document's first id (one more at the end)."""
        codes, first, held, bounds = self.cutter.distinct(data, offsets)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        flat, size = self.words(held, bounds[:-1], bounds[1:])
        at = np.cumsum(size) - size
        ids = flat[spread(at[codes], size[codes])]
        return ids, np.concatenate([[0], np.cumsum(size[codes])])[first]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a chunk's ids, and the place of each document's first byte."""
        at, size = self.a["token_at"][ids], self.a["token_at"][ids + 1] - self.a["token_at"][ids]
        return self.a["token_bytes"][spread(at, size)], np.concatenate([[0], np.cumsum(size)])[bounds]


# ---------------------------------------------------------------- Spark jobs

def base_arrays(tokenizer: str) -> dict[str, np.ndarray]:
    """Merge table and token bytes of a byte-level BPE tokenizer file."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, to_byte = spec["model"]["vocab"], byte_alphabet()
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    left, right, made = (np.array(c, np.int64) for c in zip(*((vocab[x], vocab[y], vocab[x + y]) for x, y in merges)))
    raw = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for token, i in vocab.items():
        raw[i] = bytes(to_byte[c] for c in token)
    for token, i in added.items():
        raw[i] = token.encode()
    byte_ids = np.zeros(256, np.int32)
    for c, b in to_byte.items():
        byte_ids[b] = vocab[c]
    index = HashIndex(pair_keys(left, right))
    return {"pair_keys": index.keys, "pair_slots": index.slot, "pair_raw": left << 32 | right, "pair_ids": made.astype(np.int32), "byte_ids": byte_ids,
            "token_at": np.cumsum([0, *map(len, raw)]), "token_bytes": np.frombuffer(b"".join(raw), np.uint8),
            "special_id": np.array([added[SPECIAL]], np.int32)}


def lexicon_arrays(words: list[bytes], base: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The automaton of ``words`` and their ids, by exact merging."""
    words = sorted(words)
    next_of, final = minimal_automaton(words)
    state, byte, to, before = number_words(next_of, final)
    index = HashIndex(transition_keys(state, byte))
    empty = base | {"move_keys": np.zeros(0, U64), "move_slots": np.full(16, -1), "move_to": np.zeros(0, np.int64), "move_before": np.zeros(0, np.int64),
                    "final": np.zeros(1, np.uint8), "word_at": np.zeros(1, np.int64), "word_ids": np.zeros(0, np.int32)}
    off = np.cumsum([0, *map(len, words)])
    ids, size = Coder(empty).words(np.frombuffer(b"".join(words), np.uint8), off[:-1], off[1:]) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    return base | {"move_keys": index.keys, "move_slots": index.slot, "move_to": to, "move_before": before, "final": np.array(final, np.uint8),
                   "word_at": np.concatenate([[0], np.cumsum(size)]), "word_ids": ids.astype(np.int32)}


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent pre-tokens of all documents, ``most`` at most. Counts are summed per
    chunk, then by Spark; the least count that keeps within ``most`` is read off their histogram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokenizer()
        for rb in chunked(batches, text_col, 2 << 20):
            data, off = utf8_view(rb.column(text_col))
            codes, _, held, bounds = cutter.distinct(data, off)
            raw, at = held.tobytes(), bounds.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary()), pa.array(np.bincount(codes, minlength=len(at) - 1))], ["word", "n"])

    counts = docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = stored(counts, "bpe-words")
    by_count = counts.groupBy(F.least("n", F.lit(most)).alias("n")).count().orderBy(F.desc("n")).collect()   # at most ``most`` rows
    total, least = 0, None
    for r in by_count:
        total += r["count"]
        if total > most:
            break
        least = r["n"]
    if least is None:
        return []
    return [bytes(r["word"]) for r in counts.filter(F.col("n") >= least).select("word").collect()]


def compile_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text") -> str:
    """Writes the lexicon file of a corpus and hands it to the executors; returns its name."""
    spark = docs.sparkSession
    uri = shared_path(spark, "lexicon") + ".bin"
    save(lexicon_arrays(frequent_words(docs, text_col), base_arrays(tokenizer)), uri)
    spark.sparkContext.addFile(uri)
    return uri.rpartition("/")[2]


def encode(docs: DataFrame, lexicon: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as array<int>, in place of a column of that name. No
    shuffle."""
    docs = docs.drop(*({ids_col} - {text_col}))
    names = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(load(SparkFiles.get(lexicon)))
        for rb in chunked(batches, text_col, 2 << 20):
            ids, bounds = coder.encode(*utf8_view(rb.column(text_col)))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], [*names, ids_col])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))


def digest(docs: DataFrame, lexicon: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and SHA-256 of each text's ids, and SHA-256 of the text decoded from them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(load(SparkFiles.get(lexicon)))
        for rb in chunked(batches, text_col, 2 << 20):
            ids, bounds = coder.encode(*utf8_view(rb.column(text_col)))
            back, ends = coder.decode(ids, bounds)
            ids, raw = ids.astype("<u4"), back.tobytes()
            of_ids = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            of_text = [hashlib.sha256(raw[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([rb.column(id_col), pa.array(np.diff(bounds)), pa.array(of_ids), pa.array(of_text)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every row of documents with a lexicon of its frequent words."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return digest(docs, compile_lexicon(docs, public_tokenizers.path("byte_bpe_50k.json")))
