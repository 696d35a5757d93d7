"""Conversation structure repair by a cost DP and prefix-doubling path ranking.

A conversation's rows are read in order by an automaton of the role initials
``(s?(ua)+)?``. Its states are: nothing read (0), a system turn (1), a user turn (2), an
assistant turn (3); 0 and 3 accept. Each row is kept (0), given the role that fits (1) or
deleted (2, the only choice for blank rows and repeats), empty turns can be inserted before
any row and at the end (5), and a truncated row that stays adds 5.

*Costs.* A node is (rows read, state). Costs to the end are found backwards; arcs that lie on a
cheapest path are optimal. An edit's initial (D, I, K, R) leads from a node to one node only,
because states fix the role to come next.

*Ranks.* All nodes of a batch are ranked by the first letter of their least audit, then by its
first 2, 4, 8 ... letters: a node's rank for twice the length is that of the pair (its rank, the
rank of the node that many letters on), and its pointer goes twice as far. Final ranks choose
among a node's optimal arcs, and the doubled pointers give the whole path from a start.

*Scale.* No task holds a conversation. Rows without their texts (role, flags, a digest) are
sorted over all tasks; runs of at most ``PIECE`` consecutive rows of one conversation are
pieces. A piece's matrix of costs from state to state is found in parallel; one row per piece
then hands costs back from the last piece to the first; with them each piece's paths are ranked
in parallel for every state it can begin in. Repeats are found by the least place of each
(role, text), counted with map-side combining. Equal rows are one row with a count. Only the
digest of the repaired conversation is sequential by nature (SHA-256): a conversation's texts
stream once through a task in order, held one Arrow batch at a time.

Defined cases: rows are taken in order of turn (null first), rows of one turn in order of role,
then of the SHA-256 of their texts; a row repeated as a whole stands beside itself and its
later copies are duplicates (or blank). A null role or text, and a null id or turn in the key
that selects damage, count as one blank. A null conv_id is a conversation of its own. Long
texts are read whole; other columns of any name aren't read; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskspark.llm.common import read, stored

PIECE_BITS = 12
PIECE = 1 << PIECE_BITS      # rows of a piece at most
CELLS = 1 << 22              # path places or matrix entries held at a time
BLANKS = r"[^\x20\x09-\x0D]"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = np.int64(1) << 60
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)            # in ASCII order; 0 ends an audit
FOLLOWS = np.array([2, 2, 3, 2])                       # the state that an inserted turn leads to
# state after a kept row of class s, u, a, other (rows) from each state (columns); -1: doesn't fit
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
AT_END = np.array([0, 2 * INSERT, INSERT, 0])          # cost of the insertions that end a conversation

# A row's symbol: class * 3 + fault (0 none, 1 truncated, 2 must go).


def arc_costs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol and state the costs of D, K, R (FAR where impossible) without insertions;
    the states these lead to; and the cost matrix of a symbol with insertions before it."""
    costs, to = np.full((12, 4, 3), FAR), np.zeros((12, 4, 3), np.int64)
    for symbol in range(12):
        kind, fault = divmod(symbol, 3)
        for state in range(4):
            costs[symbol, state, 0], to[symbol, state, 0] = DELETE, state
            if fault < 2:
                if KEPT[kind, state] >= 0:
                    costs[symbol, state, 1], to[symbol, state, 1] = KEEP + TRUNCATED * fault, KEPT[kind, state]
                costs[symbol, state, 2], to[symbol, state, 2] = REROLE + TRUNCATED * fault, FOLLOWS[state]
    step = np.full((12, 4, 4), FAR)
    for symbol in range(12):
        for state in range(4):
            at, paid = state, 0
            for _ in range(3):                           # more than two insertions return to a state
                for arc in range(3):
                    if costs[symbol, at, arc] < FAR:
                        end = to[symbol, at, arc]
                        step[symbol, state, end] = min(step[symbol, state, end], paid + costs[symbol, at, arc])
                at, paid = FOLLOWS[at], paid + INSERT
    return costs, to, step


ARCS, ARC_TO, STEP = arc_costs()


def matrices(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cost matrices (state to state) of pieces; piece k has symbols[at[k]:at[k + 1]]."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    out = np.full((len(size), 4, 4), FAR)
    out[:, range(4), range(4)] = 0
    live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")     # pieces longer than j
    for j, n in enumerate(live):
        own = order[:n]
        out[own] = np.minimum((out[own][:, :, :, None] + STEP[symbols[at[own] + j]][:, None]).min(2), FAR)
    return out


def least_paths(symbols: np.ndarray, at: np.ndarray, exits: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least audits of pieces of like length, from each state. ``exits``: costs from each
    state behind the piece; ``last``: whether the conversation ends there. Returns the arcs of
    the paths as (4 * pieces, longest) letters (0 where a path has ended), the row before which
    each stands, and the states that the paths end in."""
    size = np.diff(at)
    pieces, width = len(size), int(size.max(initial=0)) + 1
    rows = np.zeros((pieces, width), np.int64)
    inside = np.arange(width - 1) < size[:, None]
    rows[:, :-1][inside] = symbols
    # costs to the end from every node, and costs of its arcs D, I, K, R
    value = np.full((pieces, width, 4), FAR)
    arc = np.full((pieces, width, 4, 4), FAR)
    states = np.arange(4)
    for j in range(width - 1, -1, -1):
        ends = size == j
        if ends.any():
            value[ends, j] = exits[ends]
            done = ends & last
            arc[done, j, :, 1] = np.where((states == 0) | (states == 3), FAR, INSERT + AT_END[FOLLOWS])
        more = np.flatnonzero(size > j)
        if len(more):
            symbol = rows[more, j]
            taken = np.minimum(ARCS[symbol] + value[more, j + 1][np.arange(len(more))[:, None, None], ARC_TO[symbol]], FAR)
            arc[more, j, :, 0], arc[more, j, :, 2], arc[more, j, :, 3] = taken[..., 0], taken[..., 1], taken[..., 2]
            best = taken.min(-1)
            value[more, j] = np.minimum(best, np.minimum(INSERT + best[:, FOLLOWS], 2 * INSERT + best[:, FOLLOWS[FOLLOWS]]))
            arc[more, j, :, 1] = INSERT + value[more, j][:, FOLLOWS]
    value, arc = value.reshape(-1), arc.reshape(-1, 4)
    nodes = np.arange(len(value))
    state = nodes % 4
    symbol = rows.reshape(-1)[nodes // 4]
    heads = np.stack([nodes + 4 - state + ARC_TO[symbol, state, 0], nodes - state + FOLLOWS[state], nodes + 4 - state + ARC_TO[symbol, state, 1], nodes + 4 - state + ARC_TO[symbol, state, 2]], 1)
    optimal = (arc == value[:, None]) & (value[:, None] < FAR)
    letter = np.where(optimal.any(1), optimal.argmax(1) + 1, 0)
    heads = np.where(optimal, heads, nodes[:, None])
    # ranks of the first 1, 2, 4 ... letters, and pointers that many letters on
    longest = 3 * width
    rank, jump, reach = letter.astype(np.int64), heads[nodes, np.maximum(letter - 1, 0)], 1
    while reach < longest:
        pair = rank * (rank.max(initial=0) + 1) + rank[jump]
        rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
        jump, reach = jump[jump], 2 * reach
    key = np.where(optimal, np.arange(1, 5) * (len(nodes) + 1) + rank[heads], FAR)
    choice = np.where(letter > 0, key.argmin(1) + 1, 0)
    jump = heads[nodes, np.maximum(choice - 1, 0)]
    path = (np.arange(pieces)[:, None] * width * 4 + states).reshape(-1, 1)
    while path.shape[1] < longest:
        path = np.concatenate([path, jump[path]], 1)
        jump = jump[jump]
    return choice[path], (path // 4) % width, path[:, -1] % 4


def audits(symbols: np.ndarray, tails: np.ndarray, at: np.ndarray, exits: np.ndarray, last: np.ndarray, first: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """For each piece its audits from states 0 to 3 (from 0 alone where a conversation begins)
    and the states they end in. A row's further copies are deleted after it."""
    size = np.diff(at)
    found: list[list[str]] = [[] for _ in size]
    ends = np.zeros((len(size), 4), np.int64)
    bits = np.frompyfunc(lambda n: int(n).bit_length(), 1, 1)(size).astype(np.int64) if len(size) else size
    for b in np.unique(bits):
        alike = np.flatnonzero(bits == b)
        step = max(1, CELLS // (64 << int(b)))
        for k in range(0, len(alike), step):
            own = alike[k:k + step]
            flat = np.concatenate([np.arange(at[p], at[p + 1]) for p in own]) if b else np.zeros(0, np.int64)
            begin = np.concatenate([[0], np.cumsum(size[own])])
            letters, row, end = least_paths(symbols[flat], begin, exits[own], last[own])
            ends[own] = end.reshape(-1, 4)
            for i, p in enumerate(own):
                tail = tails[at[p]:at[p + 1]]
                for s in range(1 if first[p] else 4):
                    way = letters[4 * i + s]
                    n = int((way > 0).sum())
                    way, place = way[:n], row[4 * i + s, :n]
                    copies = np.ones(n, np.int64)
                    taken = way != 2
                    copies[taken] += tail[place[taken]]
                    out = np.full(int(copies.sum()), ord("D"), np.uint8)
                    out[np.cumsum(copies) - copies] = LETTERS[way]
                    found[p].append(out.tobytes().decode())
    return found, ends


# ---------------------------------------------------------------- Spark jobs

def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text and copies (0 to 2) of each row after the damage."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("harm"))
    text = F.when(F.col("harm").isin(0, 1), F.lit("")).when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1).cast("long").alias("copies"))


def digest_of(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def row_class(role: str) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def placed(rows: DataFrame) -> DataFrame:
    """Rows without text in the order of conversations: conv, turn, role, digest, kind (class),
    blank, cut (truncated), n (equal rows) and place, ascending over all tasks."""
    slim = rows.filter("copies > 0").select(
        "conv", "turn", "role", digest_of("text").alias("digest"), (~F.col("text").rlike(BLANKS)).alias("blank"),
        (~F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")).rlike(r"[.!?]\z")).alias("cut"), "copies")
    by = ["conv", "turn", "role", "digest"]
    slim = slim.groupBy(*by).agg(F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.sum("copies").alias("n"))
    order = [F.asc_nulls_first(c) for c in by]
    return slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "digest", row_class("role").alias("kind"), "blank", "cut", "n", F.monotonically_increasing_id().alias("place"))


def pieces(rows: DataFrame) -> DataFrame:
    """One row for each run of at most PIECE places of a conversation: conv, piece (its first
    place), symbols, tails (further copies of each row), counts of faults."""
    first = rows.groupBy("conv", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    marked = rows.join(first, "place", "left")
    again = F.col("new").isNull()
    fault = F.when(F.col("blank") | again, 2).when(F.col("cut"), 1).otherwise(0)
    marked = marked.select("conv", "place", F.struct("place", (F.col("kind") * 3 + fault).cast("int").alias("symbol"), (F.col("n") - 1).alias("tail")).alias("row"),
                           F.when(F.col("blank"), F.col("n")).otherwise(0).alias("blank"),
                           F.when(F.col("blank"), 0).when(again, F.col("n")).otherwise(F.col("n") - 1).alias("duplicate"),
                           (fault == 1).cast("long").alias("truncated"))
    out = marked.groupBy("conv", F.shiftright("place", PIECE_BITS).alias("block")).agg(
        F.sort_array(F.collect_list("row")).alias("rows"), F.min("place").alias("piece"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    return out.select("conv", "piece", F.col("rows.symbol").alias("symbols"), F.col("rows.tail").alias("tails"), "blank", "duplicate", "truncated")


def lists(col: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    off = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]].astype(kind), off - off[0]


def with_matrix(found: DataFrame) -> DataFrame:
    """Adds matrix: 16 costs from state to state, those of further copies included."""
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rb in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
                symbols, at = lists(rb.column("symbols"), np.int64)
                tails, _ = lists(rb.column("tails"), np.int64)
                paid = np.concatenate([[0], np.cumsum(tails)])[at]
                cost = np.minimum(matrices(symbols, at) + DELETE * np.diff(paid)[:, None, None], FAR)
                yield pa.RecordBatch.from_arrays([*rb.columns, pa.FixedSizeListArray.from_arrays(pa.array(cost.reshape(-1)), 16).cast(pa.list_(pa.int64()))], [*names, "matrix"])

    from pyspark.sql.types import ArrayType, LongType, StructField, StructType
    return found.mapInArrow(run, StructType([*found.schema.fields, StructField("matrix", ArrayType(LongType()))]))


def exit_costs(found: DataFrame) -> DataFrame:
    """For each piece: exits (costs from each state behind it to the end of its conversation),
    last, first, and cost (from its beginning, state 0). One row of a piece is read at a time,
    from a conversation's last piece to its first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, value = False, None, None
        for rb in batches:
            if not rb.num_rows:
                continue
            out = []
            for c, piece, first, matrix in zip(*(rb.column(k).to_pylist() for k in ("conv", "piece", "begins", "matrix"))):
                last = not begun or c != conv
                exits = np.array(AT_END, np.int64) if last else value
                value = np.minimum((np.array(matrix, np.int64).reshape(4, 4) + exits).min(1), FAR)
                out.append((piece, exits.tolist(), last, first, int(value[0])))
                begun, conv = True, c
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64()))], ["piece", "exits", "last", "first", "cost"])

    begins = F.col("piece") == F.min("piece").over(Window.partitionBy("conv"))
    ordered = found.select("conv", "piece", begins.alias("begins"), "matrix").repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.desc("piece"))
    return ordered.mapInArrow(run, "piece long, exits array<long>, last boolean, first boolean, cost long")


def with_audits(found: DataFrame) -> DataFrame:
    """conv, piece, cost, counts of faults, audits (from each state) and ends (states)."""
    keep = ["conv", "piece", "cost", "blank", "duplicate", "truncated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rb in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
                symbols, at = lists(rb.column("symbols"), np.int64)
                tails, _ = lists(rb.column("tails"), np.int64)
                exits = lists(rb.column("exits"), np.int64)[0].reshape(-1, 4)
                got, ends = audits(symbols, tails, at, exits, *(rb.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("last", "first")))
                yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), pa.array(got, pa.list_(pa.string())), pa.array(ends.tolist(), pa.list_(pa.int64()))], [*keep, "audits", "ends"])

    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType
    fields = [f for f in found.select(*keep).schema.fields]
    return found.mapInArrow(run, StructType([*fields, StructField("audits", ArrayType(StringType())), StructField("ends", ArrayType(LongType()))]))


class Conversation:
    """Reads one conversation's pieces, then its rows, in order; holds its audit and its running
    digest."""

    def __init__(self, conv):
        self.conv, self.parts, self.state = conv, [], 0
        self.cost, self.counts = None, [0, 0, 0]
        self.audit: str | None = None
        self.at, self.expects, self.sha, self.empty = 0, "user", hashlib.sha256(), True
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.initial: str | None = None

    def piece(self, audits: list[str], ends: list[int], cost: int, counts: tuple[int, ...]) -> None:
        if self.cost is None:
            self.cost = cost
        self.parts.append(audits[self.state])
        self.state = ends[self.state]
        self.counts = [a + b for a, b in zip(self.counts, counts)]

    def write(self, role: str, text: str) -> None:
        if not self.empty:
            self.sha.update(b"\n")
        self.empty = False
        self.sha.update(f"{role}:{text}".encode())
        self.expects = "assistant" if role[:1] == "u" else "user"

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.write(self.expects, "")
            self.at += 1

    def row(self, turn, role: str, text: str, copies: int) -> None:
        if self.audit is None:
            self.audit = "".join(self.parts)
        if turn is not None and copies:
            if self.turn is None or turn != self.turn:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        for _ in range(copies):
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = role[:1]
            self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                self.write(role if edit == "K" else self.expects, text)

    def result(self) -> tuple:
        if self.audit is None:
            self.audit = ""
        self.inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.counts, self.illegal, self.cost or 0, self.audit, self.sha.hexdigest())


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(rows: DataFrame, found: DataFrame, conv_kind: str) -> DataFrame:
    """The result of each conversation: its pieces' audits, then its rows, stream by in order."""
    none = {"audits": "array<string>", "ends": "array<long>", "cost": "long", "blank": "long", "duplicate": "long", "truncated": "long"}
    texts = rows.select("conv", F.lit(None).cast("long").alias("piece"), F.col("turn").cast("long").alias("turn"), "role", "text", "copies", digest_of("text").alias("digest"),
                        *(F.lit(None).cast(k).alias(c) for c, k in none.items()))
    heads = found.select("conv", "piece", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("copies"),
                         F.lit(None).cast("binary").alias("digest"), *none)
    order = [F.asc_nulls_first("conv"), F.asc_nulls_last("piece"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    stream = heads.unionByName(texts).repartition("conv").sortWithinPartitions(*order)
    columns = ["conv", "piece", "turn", "role", "text", "copies", *none]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for rb in batches:
            out = []
            for conv, piece, turn, role, text, copies, audit, ends, cost, *counts in zip(*(rb.column(c).to_pylist() for c in columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.result())
                    now = Conversation(conv)
                if piece is not None:
                    now.piece(audit, ends, cost, counts)
                else:
                    now.row(turn, role, text, copies)
            yield as_batch(out, rb.schema.field("conv").type)
        if now is not None:
            yield as_batch([now.result()], rb.schema.field("conv").type)

    def as_batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["conv", *RESULT])

    return stream.select(*columns).mapInArrow(run, f"conv {conv_kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv of ``rows`` (conv, turn, role, text, copies; rows of 0 copies only
    name their conversation): gaps, counts of faults, cost, audit, repaired_sha256. ``turn`` is
    an integer."""
    found = stored(with_matrix(pieces(stored(placed(rows), "repair-rows"))), "repair-pieces")
    found = with_audits(found.join(exit_costs(found), "piece"))
    return repaired(rows, found, rows.schema["conv"].dataType.simpleString())


def op12_path_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages conversations, then repairs every one."""
    return repair(damaged(read(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


ORACLE = r"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)),
                    lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS harm
  FROM conversations, bytes
), damaged AS (
  SELECT conv_id, turn, copy, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM keyed, range(CASE harm WHEN 3 THEN 2 ELSE 1 END) AS c(copy) WHERE harm <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) || left(role, 1) AS initials,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    rtrim(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) AS bare
  FROM damaged
), rows AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (initials NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM rows GROUP BY conv_id
), conv AS (
  SELECT DISTINCT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(n, 0) AS n
  FROM conversations c LEFT JOIN facts f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
), ins AS (
  SELECT * FROM (VALUES (0, '', 0, 0, []::VARCHAR[]), (1, '', 0, 1, []), (2, '', 0, 2, []), (3, '', 0, 3, []),
    (0, 'I', 5, 2, ['user:']), (1, 'I', 5, 2, ['user:']), (3, 'I', 5, 2, ['user:']), (2, 'I', 5, 3, ['assistant:']),
    (0, 'II', 10, 3, ['user:', 'assistant:']), (1, 'II', 10, 3, ['user:', 'assistant:']), (3, 'II', 10, 3, ['user:', 'assistant:'])) AS t(q, letters, paid, mid, added)
), edit AS (
  SELECT * FROM (VALUES (0, 's', 1, 'user'), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (3, 'u', 2, 'user'), (2, 'a', 3, 'assistant')) AS t(mid, initial, target, fits)
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'out': []::VARCHAR[]} AS best FROM conv
  UNION ALL
  SELECT conv_id, i + 1, target, min(k) FROM (
    SELECT w.conv_id, w.i, a.target, {'cost': (w.best.cost + n.paid + a.paid)::BIGINT, 'audit': w.best.audit || n.letters || a.letter, 'out': w.best.out || n.added || a.added} AS k
    FROM walk w JOIN rows r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = w.i + 1 JOIN ins n ON n.q = w.q,
    LATERAL (
      SELECT 'D' AS letter, 2 AS paid, n.mid AS target, []::VARCHAR[] AS added
      UNION ALL SELECT 'K', CASE r.fault WHEN 'truncated' THEN 5 ELSE 0 END, e.target, [r.role || ':' || r.text] FROM edit e WHERE e.mid = n.mid AND e.initial = left(r.role, 1) AND r.fault IN ('', 'truncated')
      UNION ALL SELECT 'R', CASE r.fault WHEN 'truncated' THEN 6 ELSE 1 END, e.target, [e.fits || ':' || r.text] FROM edit e WHERE e.mid = n.mid AND e.target > 1 AND r.fault IN ('', 'truncated')
    ) a
  ) GROUP BY conv_id, i, target
), ended AS (
  SELECT w.conv_id, min({'cost': (w.best.cost + n.paid)::BIGINT, 'audit': w.best.audit || n.letters, 'out': w.best.out || n.added}) AS best
  FROM walk w JOIN conv c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n JOIN ins n ON n.q = w.q AND n.mid IN (0, 3) GROUP BY w.conv_id
)
SELECT c.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.out, chr(10))) AS repaired_sha256
FROM conv c JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
