"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct word shingles, hashed to 64 bits. Each of M registers holds
the minimum of an exponential variable over the set, on a scale of powers of BASE and
truncated to 0..TOP (SetSketch; Ertl, VLDB 2021). Registers of a union are the maxima of the
registers, so sketches merge; two sets' registers agree with a probability close to their
Jaccard similarity. ROWS registers make a band; documents that agree on a band are
candidates. With the sets' sizes known, the similarity of candidates is estimated from the
numbers of registers that are larger, smaller and equal by maximum likelihood; those not far
below the threshold are verified on their full sets.

No pairs within a group are emitted. Equal sets become one class first. Shingles that no
other candidate has bound what a class can share: a class with too many of them links with
nothing, and any pair's intersection is at most what the two have besides; nor is it more
than a set's size less the slots of a bitmap that only this set occupies. Each band bucket
then checks its members against one pivot, the member with the least share of such shingles
(of copies of one text the most central), and after that, round by round, against a growing
number of pivots from outside its largest component; members that are linked already are not
compared again, a pair that shares several buckets is checked in the first, and a pivot that
met all others retires. The rounds go on until every
bucket's remaining members are one component. So a bucket of n copies costs about n checks,
and no link between different components is left unchecked.

At similarity 0.8, 32 bands of 4 miss a pair with probability 2e-8; the likelihood filter
keeps pairs estimated at 0.6 and more, over five standard errors below the threshold.

Defined cases: documents without words have an empty set, link with nothing and are kept;
null ids are documents too (a component of such alone has a null id, and all of them are
kept); rows that repeat an id are documents of their own and link as their texts do; an
empty table gives an empty result; only id and text are read, so other columns may have any
name. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskspark.llm.common import SPACE, U64, chunked, mix, read, seeds, stored, utf8_view, word_hashes, word_spans
from riskspark.llm.links import components, joined

BASE, RATE, TOP = 1.02, 20.0, 65_535       # SetSketch's b, a and q + 1
M, ROWS = 128, 4
BANDS = M // ROWS
SLOTS, MORE = 512, 16                      # pivots of a bucket in the second round; times more in each later one
WORDS = 8                                  # of 64 bits: the bitmap of occupied slots that a set's hashes fall into
BITS = [f"bits{i}" for i in range(WORDS)]
LEAST_ESTIMATE = 0.6


# ---------------------------------------------------------------- sets and registers

def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and their bounds.
    A document of fewer than k words has one shingle, all its words."""
    starts, ends, first = word_spans(data, offsets, SPACE)
    words = word_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.cumsum(count) - count
    begin = np.repeat(first[:-1] - at, count) + np.arange(int(count.sum()))
    length = np.repeat(np.minimum(n, k), count)
    salt, total = seeds(k, 11), length.astype(U64)
    for j in range(k):
        inside = j < length
        total[inside] += words[begin[inside] + j] * salt[j]
    total = mix(total)
    sets = [np.unique(total[a:a + c]) for a, c in zip(at.tolist(), count.tolist())]
    bounds = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else total), bounds


def registers(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """M registers of each set (0 for an empty one). The minimum of exponentials is found as
    the minimum of the uniform hashes that they are monotone in."""
    out = np.zeros((len(bounds) - 1, M), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    x = (sets >> U64(32)).astype(np.uint32) ^ (sets & U64(0xFFFFFFFF)).astype(np.uint32)
    least = np.empty((len(full), M), np.float64)
    buffer = np.empty_like(x)
    for i, s in enumerate((seeds(M, 13) >> U64(31)).astype(np.uint32) | np.uint32(1)):
        np.multiply(x, s, out=buffer)
        np.bitwise_xor(buffer, buffer >> np.uint32(15), out=buffer)
        np.multiply(buffer, np.uint32(0x2C1B3C6D), out=buffer)
        least[:, i] = np.minimum.reduceat(buffer, bounds[full])
    smallest = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    out[full] = np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sets of known sizes, from how many
    registers of a are larger, smaller and equal."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    floor = 1e-12
    likelihood = above[:, None] * np.log(more + floor) + below[:, None] * np.log(less + floor) + equal[:, None] * np.log(np.maximum(1 - more - less, floor))
    return grid[np.arange(len(a)), likelihood.argmax(1)]


def set_keys(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits that name a set."""
    total = np.zeros((2, len(sets) + 1), U64)
    for row, salt in zip(total, seeds(2, 17)):
        np.cumsum(mix(sets ^ salt), out=row[1:])
    keys = np.ascontiguousarray((total[:, bounds[1:]] - total[:, bounds[:-1]]).T)
    return [k.tobytes() for k in keys]


# ---------------------------------------------------------------- Spark jobs

def sketched(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), cls (the set's key, null for an empty set), n,
    registers (binary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in chunked(batches, "text"):
            sets, bounds = shingle_sets(*utf8_view(rb.column("text")), k)
            n = np.diff(bounds)
            keys = [key if m else None for key, m in zip(set_keys(sets, bounds), n.tolist())]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("text_key"), pa.array(keys, pa.binary()), pa.array(n), pa.array([r.tobytes() for r in registers(sets, bounds)], pa.binary())], ["doc_id", "text_key", "cls", "n", "registers"])

    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    return keyed.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, text_key long, cls binary, n long, registers binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(node, keys): a 64-bit key of each band's number and registers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = seeds(BANDS, 19)
        for rb in batches:
            if rb.num_rows:
                regs = np.frombuffer(b"".join(rb.column("registers").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
                keys = mix(np.ascontiguousarray(regs).view(U64)[:, :, 0] ^ salt)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * rb.num_rows + 1, BANDS), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([rb.column("node"), lists], ["node", "keys"])

    return classes.select("node", "registers").mapInArrow(run, "node long, keys array<long>")


def band_rows(classes: DataFrame) -> DataFrame:
    """(band, node): a row for each key."""
    return band_keys(classes).select(F.explode("keys").alias("band"), "node")


def candidate_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, shingles, BITS) of the wanted classes (node, cls, doc_id), from their documents' texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in chunked(batches, "text"):
            sets, bounds = shingle_sets(*utf8_view(rb.column("text")), k)
            keys = set_keys(sets, bounds)
            occupied = np.zeros((rb.num_rows, 64 * WORDS), bool)
            occupied[np.repeat(np.arange(rb.num_rows), np.diff(bounds)), (sets >> U64(55)).astype(np.int64) % (64 * WORDS)] = True
            bits = np.packbits(occupied, axis=1).view(">i8").astype(np.int64)
            rows = [i for i, (key, want) in enumerate(zip(keys, rb.column("cls").to_pylist())) if key == want]
            yield pa.RecordBatch.from_arrays([rb.column("node").take(pa.array(rows, pa.int64())), pa.array([sets[bounds[i]:bounds[i + 1]].view(np.int64) for i in rows], pa.list_(pa.int64())), *(pa.array(bits[rows, j]) for j in range(WORDS))], ["node", "shingles", *BITS])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(wanted.withColumnRenamed("doc_id", "_id"), texts["doc_id"].eqNullSafe(F.col("_id"))).select("node", "cls", "text")
    schema = ", ".join(["node long, shingles array<long>", *(f"{b} long" for b in BITS)])
    return texts.mapInArrow(run, schema).groupBy("node").agg(*(F.first(c).alias(c) for c in ("shingles", *BITS)))


def unshared(sets: DataFrame) -> DataFrame:
    """(node, alone): how many shingles of each class no other class of ``sets`` has."""
    owners = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.first("node").alias("node"))
    return owners.filter("n = 1").groupBy("node").agg(F.count("*").alias("alone"))


def possible(a: str, b: str, percent: int) -> F.Column:
    """Whether two classes of n shingles, of which m may be shared, can be linked. A slot that
    one set occupies and the other doesn't holds a shingle that they don't share."""
    def besides(x: str, y: str) -> F.Column:
        own = [F.bit_count(F.col(f"{c}_{x}").bitwiseAND(F.bitwise_not(F.col(f"{c}_{y}")))) for c in BITS]
        return F.col(f"n_{x}") - reduce(lambda s, t: s + t, own)

    share = F.least(F.col(f"m_{a}"), F.col(f"m_{b}"), besides(a, b), besides(b, a))
    return (100 + percent) * share >= percent * (F.col(f"n_{a}") + F.col(f"n_{b}"))


def verified(pairs: DataFrame, info: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked: those estimated near enough, on their full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for k in range(0, rb.num_rows, 1024):         # the likelihood grid holds 101 numbers a pair
                p = rb.slice(k, 1024)
                a, b = (np.frombuffer(b"".join(p.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("registers_a", "registers_b"))
                near = estimate(a, b, p.column("n_a").to_numpy(), p.column("n_b").to_numpy()) >= LEAST_ESTIMATE
                yield p.select(["a", "b"]).filter(pa.array(near))

    regs = info.select("node", "n", "registers")
    near = pairs.join(regs.toDF("a", "n_a", "registers_a"), "a").join(regs.toDF("b", "n_b", "registers_b"), "b")
    near = near.select("a", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(run, "a long, b long")
    near = stored(near, "near")                 # its size is known then, so few pairs are joined without dealing out all sets
    only = sets.select("node", "shingles")
    both = near.join(only.toDF("a", "set_a"), "a").join(only.toDF("b", "set_b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return stored(both.filter(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b"), "links")


def in_company(rows: DataFrame) -> DataFrame:
    """The rows (band, ...) of buckets that hold two rows at least."""
    return rows.join(rows.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select("band"), "band")


def link_classes(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(node, root) of the classes (node, cls, doc_id, n, registers) that have a link."""
    rows = stored(in_company(band_rows(classes)), "bands")
    wanted = rows.select("node").distinct().join(classes.select("node", "cls", "doc_id"), "node")
    sets = stored(candidate_sets(docs, wanted, id_col, text_col, k), "sets")
    shared = F.size("shingles") - F.coalesce("alone", F.lit(0))
    info = sets.select("node", *BITS, "shingles").join(unshared(sets), "node", "left").withColumn("m", shared)
    info = info.filter(100 * F.col("m") >= percent * F.size("shingles")).select("node", "m", *BITS)
    info = stored(info.join(classes.select("node", "n", "registers"), "node"), "candidates")
    facts = ["node", "n", "m", *BITS]
    rows = stored(in_company(rows.join(info.select(*facts), "node")), "bands")
    centre = rows.groupBy("band").agg(F.min(F.struct((1 - F.col("m") / F.col("n")).alias("alone"), *facts)).alias("c"))
    centre = centre.select("band", *(F.col(f"c.{c}").alias(c + "_b") for c in facts))
    side = rows.select("band", *(F.col(c).alias(c + "_a") for c in facts))
    pairs = side.join(centre, (side["band"] == centre["band"]) & (F.col("node_a") != F.col("node_b")) & possible("a", "b", percent))
    links = verified(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), info, sets, percent)
    roots = components(links)
    rows = rows.join(centre.select("band", F.col("node_b").alias("node")), ["band", "node"], "left_anti")     # the centres have met all others
    slots, keys = SLOTS, band_keys(info)
    while True:
        of = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        groups = of.groupBy("band", "root").agg(F.count("*").alias("size"))
        widest = groups.groupBy("band").agg(F.count("*").alias("groups"), F.max(F.struct("size", "root")).alias("widest")).filter("groups > 1")
        of = of.join(widest.select("band", F.col("widest.root").alias("widest")), "band")
        # pivots: members outside their bucket's largest component, one for each hash slot
        outside = F.col("root") != F.col("widest")
        slot = F.when(outside, F.pmod(F.xxhash64("node", "band"), F.lit(slots))).otherwise(F.col("node"))
        first = F.row_number().over(Window.partitionBy("band", slot, outside).orderBy(*facts)) == 1
        of = of.withColumn("pivot", outside & first)
        rows = stored(of if "keys" in of.columns else of.join(keys, "node"), "bands")
        if rows.isEmpty():
            return roots
        pivots = rows.filter("pivot").select("band", *(F.col(c).alias(c + "_b") for c in (*facts, "root", "keys")))
        side = rows.select("band", *(F.col(c).alias(c + "_a") for c in (*facts, "root", "keys")))
        same = F.filter(F.zip_with("keys_a", "keys_b", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
        met = side.join(pivots, (side["band"] == pivots["band"]) & (F.col("root_a") != F.col("root_b")) & possible("a", "b", percent)
                        & (F.try_element_at(same, F.lit(1)) == side["band"]))
        fresh = verified(met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), info, sets, percent)
        if not fresh.isEmpty():
            roots = joined(roots, fresh)
        rows = rows.filter("not pivot").drop("root", "widest", "pivot")
        slots *= MORE


def labelled(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, root (of the component, null for an empty set) and
    component_id for each row of ``docs``."""
    rows = stored(sketched(docs, id_col, text_col, k), "sketches")
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")       # stored, so a class keeps its number
    roots = link_classes(docs, classes, id_col, text_col, k, percent)
    least = classes.select("cls", "node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = least.join(by_root, "root").select("cls", "root", "component_id")
    return (rows.select("doc_id", "text_key", "cls", F.col("n").alias("n_shingles")).join(of_class, "cls", "left")
            .select("doc_id", "text_key", "n_shingles", "root", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, component_id (least id reachable by links) and kept for each row of
    ``docs``; documents link where 100 * intersection >= percent * union of their sets."""
    out = labelled(docs, id_col, text_col, k, percent).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that with the least id (of rows that
    share it the one with the least text hash, and one of equal rows). Documents without words
    stay, but for rows that repeat one."""
    rows = stored(labelled(docs, id_col, text_col, k, percent), "labelled")
    group = F.coalesce(F.concat(F.lit("root "), F.col("root").cast("string")), F.col("text_key").cast("string"))
    stay = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", group.alias("__group")).agg(F.min("text_key").alias("__text"))
    times = rows.groupBy(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t")).agg(F.count("*").alias("__times"))
    stay = stay.join(times, stay["doc_id"].eqNullSafe(times["__d"]) & (stay["__text"] == times["__t"])).select("__d", "__t", "__times").distinct()
    names = docs.columns
    kept = stored(docs.withColumn("__key", F.xxhash64(text_col)).join(stay, F.col(id_col).eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__t"))).select(*names, "__key", "__times"), "kept")
    return kept.filter("__times = 1").union(kept.filter("__times > 1").dropDuplicates([id_col, "__key"])).select(*names)


def op3_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all rows of documents on four-word shingles at 0.8."""
    return near_duplicates(read(spark, sf_dir, "documents"), k=4)


def oracle(k: int = 4, percent: int = 80) -> str:
    """Brute force over an inverted index of shingles; the components by recursion."""
    upper = "".join(map(chr, range(65, 91)))
    return f"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(list_slice(w, i, i + {k - 1}), ' '))) end) g from d),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id != b.doc_id group by 1, 2),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= {percent} * (a.n + b.n - c)),
r as (select doc_id x, doc_id y from n union select r.x, e.y from r join e on r.y = e.x),
m as (select x, min(y) c from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(m.c, d.doc_id) component_id, coalesce(m.c, d.doc_id) = d.doc_id kept
from d left join n using (doc_id) left join m on m.x = d.doc_id"""
