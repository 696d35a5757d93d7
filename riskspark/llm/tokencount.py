"""Token counts by the whole-token shortcut.

Most pre-tokens of running text are single tokens. Which vocabulary strings are so is proved
once, before any text is read: a string is *whole* if merging its bytes by the tokenizer's
own rules ends in that one token. A pre-token's tokens depend on its bytes alone, so a
pre-token equal to a whole string counts one and is never merged. Only the others are merged,
each distinct one of a chunk once.

A chunk's pre-tokens are an Arrow array over the text's own bytes; equality to a whole string
is equality of bytes, never of hashes. The proved strings and the tokenizer's rules, both
bounded by the tokenizer's file, are broadcast; texts are read in one scan without a shuffle.

Defined cases: a null text has 0 bytes and 0 tokens, as the empty text has; rows are judged by
themselves, so repeated rows, null ids and ties change nothing; the result holds the id column
and the counts only, so other columns of any name don't meet them (an id column named like a
count is refused); an empty table gives an empty result; a very long text is read whole, as a
chunk of its own, and its time grows in proportion to its length.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from riskspark.llm.common import chunked, read, utf8_view
from riskspark.llm.pieces import binary, coded
from riskspark.llm.pretokens import SPECIAL, PreTokenizer
from riskspark.llm.transducer import byte_alphabet

LIMIT = 1024                 # tokens beyond which a text is over the limit
MEMO = 1 << 18               # pre-tokens whose counts a worker remembers; forgotten when full
MEMO_WORD = 64               # longer ones are merged anew


class Merger:
    """The merging rules of a byte-level BPE tokenizer, applied to single pre-tokens."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.merge = Tokenizer.from_str(spec).model.tokenize
        self.chars = {b: c for c, b in byte_alphabet().items()}
        self.memo: dict[str, int] = {}

    def ids(self, raw: bytes) -> list[int]:
        return [t.id for t in self.merge(raw.decode("latin-1").translate(self.chars))]

    def counts(self, words: pa.Array) -> list[int]:
        """Tokens of each of the given pre-tokens."""
        data, off = words.buffers()[2], np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
        if data is None:
            return [0] * len(words)
        text = data[off[0]:off[-1]].to_pybytes().decode("latin-1").translate(self.chars)
        at, out, memo, merge = (off - off[0]).tolist(), [], self.memo, self.merge
        for a, b in zip(at, at[1:]):
            word = text[a:b]
            n = memo.get(word)
            if n is None:
                n = len(merge(word))
                if b - a <= MEMO_WORD:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = n
            out.append(n)
        return out


def prove(spec: str) -> list[bytes]:
    """The vocabulary strings that, as pre-tokens of their own, are one token; the special
    token among them, as the library takes it out of a text before anything is merged."""
    given = json.loads(spec)
    if given["model"]["type"] != "BPE" or given["pre_tokenizer"]["type"] != "ByteLevel" or given["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("not a byte-level BPE tokenizer")
    if [t["content"] for t in given["added_tokens"]] != [SPECIAL]:
        raise ValueError(f"the only added token must be {SPECIAL}")
    merger, byte_of = Merger(spec), byte_alphabet()
    whole = []
    for text, i in given["model"]["vocab"].items():
        if all(c in byte_of for c in text):
            raw = bytes(byte_of[c] for c in text)
            if merger.ids(raw) == [i]:
                whole.append(raw)
    return sorted({*whole, SPECIAL.encode()})


class Counter:
    """Counts the tokens of chunks."""

    def __init__(self, spec: str, whole: list[bytes]):
        self.merger, self.cutter = Merger(spec), PreTokenizer()
        self.whole = pa.array(whole, pa.large_binary())

    def count(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each document, and how many of its pre-tokens were whole."""
        begin, first = self.cutter.cut(data, offsets)
        if len(begin) < 2:
            return np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
        codes, values = coded(binary(data, begin))
        whole = pc.is_in(values, value_set=self.whole).to_numpy(zero_copy_only=False)
        tokens = np.ones(len(values), np.int64)
        rest = np.flatnonzero(~whole)
        tokens[rest] = self.merger.counts(values.take(pa.array(rest)))
        sums = [np.concatenate([[0], np.cumsum(x[codes])]) for x in (tokens, whole.astype(np.int64))]
        return tuple(s[first[1:]] - s[first[:-1]] for s in sums)


_COUNTER: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """For each row: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) and
    n_whole, the pre-tokens that the shortcut counted. No shuffle."""
    if id_col in ("n_bytes", "n_tokens", "over_limit", "n_whole"):
        raise ValueError(f"{id_col} is a column of the result")
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    rules = docs.sparkSession.sparkContext.broadcast((spec, prove(spec)))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTER:                              # one for all tasks of a worker
            _COUNTER.clear()
            _COUNTER[key] = Counter(*rules.value)
        counter = _COUNTER[key]
        for rb in chunked(batches, "text"):
            data, off = utf8_view(rb.column("text"))
            n, whole = counter.count(data, off)
            yield pa.RecordBatch.from_arrays([rb.column(id_col), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit), pa.array(whole)], [id_col, "n_bytes", "n_tokens", "over_limit", "n_whole"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, n_whole long")


def op11_whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every row of documents."""
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
