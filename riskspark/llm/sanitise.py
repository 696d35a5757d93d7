"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that the
base patterns find. A term of an entity's texts discloses it as far as the corpus makes the two
co-occur: with IC(e) = log(N / n_e) the entity's information content and PMI(e, t) =
log(N n_et / (n_e n_t)), a term whose PMI is at least GENERALISE of IC tells that share of
what the entity tells. Every place of such a term, in all texts that hold the entity and at any
distance from it, becomes a span of kind ``term``; ``redact`` replaces entities and terms by
class names, and removes terms that reach REMOVE.

All four numbers count distinct whole texts, so exact copies count once; a term stands in a
text where it overlaps no base span. Pairs seen in fewer than SUPPORT texts are no evidence.
Counts run over all documents: one scan finds entities; a second reads the words of texts with
an entity of SUPPORT texts or more, whose pairs Spark sums; a third counts, in all texts, the
terms that have enough pairs; a fourth marks. Bitmaps of fixed size tell the scans which texts
and words may matter, and joins make that exact. Entities of the same texts have the same
numbers and are counted as one.

Defined cases: a null or empty text has no span; rows are judged by their text, so repeated
rows get equal results; null ids are kept; an empty table gives an empty result; only the
named columns are read. Whole texts are read; no pattern backtracks more than linearly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from riskspark.llm.common import U64, chunked, read, stored, utf8_view
from riskspark.llm.wordlang import Words

KINDS = ["email", "ip", "card", "phone", "term"]       # fixed order of spans with one start
SUPPORT = 5                                            # distinct texts that make a pair evidence
GENERALISE, REMOVE = 0.85, 0.97                        # shares of an entity's information content
TERM_LETTERS = 3
BITS = 22                                              # a bitmap has 2**BITS places
TASK_TERMS = 1 << 20                                   # sums that a task holds before it gives them out

# Base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")    # a match can begin only where a run of digits does
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def entity_key(kind: int, text: str) -> int:
    """A signed 64-bit name of an entity: letters in lower case, numbers by their digits."""
    plain = text.lower() if kind < 2 else NOT_DIGIT.sub("", text)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text key, numbers of base spans, base spans and the keys of the entities."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in chunked(batches, "text"):
            texts = [t or "" for t in rb.column("text").to_pylist()]
            spans = [base_spans(t) for t in texts]
            count = [[sum(s[1] == k for s in x) for x in spans] for k in range(4)]
            entities = [sorted({entity_key(k, t[a:b]) for a, k, b in s}) or None for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("text_key"), *(pa.array(c, pa.int64()) for c in count), pa.array([spell(s) for s in spans]), pa.array(entities, pa.list_(pa.int64()))],
                                             ["id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base", "entities"])

    kind = dict(docs.dtypes)[id_col]
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("text_key"))
    return keyed.mapInArrow(run, f"id {kind}, text_key string, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>")


def text_key(text_col: str) -> F.Column:
    return F.md5(F.coalesce(text_col, F.lit("")))


def text_place(key: str = "text_key") -> F.Column:
    return F.shiftright(F.conv(F.substring(key, 1, 6), 16, 10).cast("int"), 24 - BITS)


def term_place(key: str = "t") -> F.Column:
    return F.shiftrightunsigned(F.col(key), 64 - BITS).cast("int")


def bitmap(places: DataFrame) -> Broadcast:
    """A broadcast bitmap of 2**BITS places from the one column, p, of ``places``."""
    parts = places.groupBy(F.expr("p >> 5 as part")).agg(F.expr("bit_or(shiftleft(1L, p & 31)) as bits")).collect()     # 2**(BITS - 5) rows at most
    held = np.zeros(1 << BITS - 5, np.uint32)
    for part, bits in parts:
        held[part] = bits
    return places.sparkSession.sparkContext.broadcast(held)


def terms_in(texts: list[str], bits: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(text number, term's key, start, end) of the words of TERM_LETTERS letters or more that
    overlap no base span; of those alone whose place in ``bits`` is set, if given."""
    words = Words(*utf8_view(pa.array(texts, pa.large_string())))
    good = words.end - words.start >= TERM_LETTERS
    if bits is not None:
        good &= bits[(words.hash >> U64(64 - BITS)).astype(np.int64)]
    which = np.flatnonzero(good)
    doc = np.searchsorted(words.first, which, "right") - 1
    at = (np.cumsum([0, *(len(t) + 1 for t in texts)]) + 1)[doc]                            # where a text's characters begin
    start, end, key = words.start[which] - at, words.end[which] - at, words.hash[which].view(np.int64)
    free = np.ones(len(which), bool)
    some, first = np.unique(doc, return_index=True)
    for i, low, high in zip(some, first, [*first[1:], len(doc)]):
        for a, _, b in base_spans(texts[i]):
            x, y = np.searchsorted(end[low:high], a, "right"), np.searchsorted(start[low:high], b, "left")
            free[low + x:low + y] = False
    return doc[free], key[free], start[free], end[free]


def scan(docs: DataFrame, text_col: str, emit: Callable, schema: str, texts: Broadcast | None = None, terms: Broadcast | None = None, wanted: bool = True) -> DataFrame:
    """What ``emit`` makes of the terms of a task's chunks (for each its text keys, and terms_in's
    arrays). Bitmaps: only texts whose place has the ``wanted`` value are read, and only terms
    whose place is set."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        texts_of, terms_of = (held and np.unpackbits(held.value.view(np.uint8), bitorder="little").astype(bool) for held in (texts, terms))
        for rb in chunked(batches, "text"):
            if texts:
                rb = rb.filter(pa.array(texts_of[[int(k[:6], 16) >> 24 - BITS for k in rb.column("text_key").to_pylist()]] == wanted))
            if rb.num_rows:
                yield rb.column("text_key"), *terms_in([t or "" for t in rb.column("text").to_pylist()], terms_of)

    return docs.select(F.col(text_col).alias("text"), text_key(text_col).alias("text_key")).mapInArrow(lambda batches: emit(chunks(batches)), schema)


def pairs_of(chunks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for keys, doc, term, *_ in chunks:
        doc, term = np.unique(np.stack([doc, term]), axis=1) if len(doc) else (doc, term)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), pa.array(term)], ["text_key", "t"])


def places_of(chunks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for keys, doc, term, start, end in chunks:
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), pa.array(term), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["text_key", "t", "a", "b"])


def counts_of(chunks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Sums over a task's chunks, given out whenever TASK_TERMS terms are held."""
    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], ["t", "n"])

    held, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, doc, term, *_ in chunks:
        if len(doc):
            more, times = np.unique(np.unique(np.stack([doc, term]), axis=1)[1], return_counts=True)
            held, at = np.unique(np.concatenate([held, more]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n, times])).astype(np.int64)
            if len(held) >= TASK_TERMS:
                yield batch()
                held, n = held[:0], n[:0]
    yield batch()


def disclosing(docs: DataFrame, text_col: str, rows: DataFrame) -> DataFrame | None:
    """(text_key, t, share): the terms of each text that tell at least GENERALISE of the
    information of an entity in it; None where no entity has SUPPORT texts."""
    texts = rows.select("text_key").distinct().count()
    held = rows.filter("entities is not null").groupBy("text_key").agg(F.first("entities").alias("e")).select("text_key", F.explode("e").alias("e"))
    # the entities of one set of texts, named by two hashes of the set; an entity of every text tells nothing
    names = (held.groupBy("e").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("text_key")).alias("x"), F.bit_xor(F.xxhash64("text_key", F.lit(1))).alias("y"))
             .filter((F.col("n_e") >= SUPPORT) & (F.col("n_e") < texts)))
    held = stored(held.join(names, "e").select("text_key", "n_e", "x", "y").distinct(), "entity-texts")
    most = held.agg(F.max("n_e")).first()[0]
    if most is None:
        return None
    n = F.lit(float(texts))

    def share(n_et: F.Column, n_t: str) -> F.Column:
        """PMI by IC."""
        return F.log(n * n_et / (F.col("n_e") * F.col(n_t))) / F.log(n / F.col("n_e"))

    words = scan(docs, text_col, pairs_of, "text_key string, t long", texts=bitmap(held.select(text_place().alias("p"))))
    words = stored(words.join(held.select("text_key").distinct(), "text_key", "leftsemi").distinct(), "entity-words")
    here = stored(words.groupBy("t").agg(F.count("*").alias("here")).filter(F.col("here") >= SUPPORT), "entity-terms")
    # texts that surely stand in one row are counted where they are read, which rules out common
    # words before pairs are made; the others, whose copies must count once, are counted by key
    repeated = bitmap(rows.groupBy("text_key").count().filter("count > 1").select(text_place().alias("p")))
    single = scan(docs, text_col, counts_of, "t long, n long", texts=repeated, terms=bitmap(here.select(term_place().alias("p"))), wanted=False).groupBy("t").agg(F.sum("n").alias("n"))
    terms = here.join(single, "t", "left").select("t", F.coalesce("n", F.lit(0)).alias("single"), F.greatest("here", F.coalesce("n", F.lit(0))).alias("at_least"))
    terms = terms.filter((F.col("at_least") <= most) | (F.log(n / F.col("at_least")) >= GENERALISE * F.log(n / F.lit(float(most))) - 1e-9))
    pairs = words.join(terms, "t").join(held, "text_key").groupBy("n_e", "x", "y", "t", "single", "at_least").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= SUPPORT)
    pairs = stored(pairs.filter(share(F.col("n_et"), "at_least") >= GENERALISE), "disclosure-pairs")
    if pairs.isEmpty():
        return None
    copied = scan(docs, text_col, pairs_of, "text_key string, t long", texts=repeated, terms=bitmap(pairs.select(term_place().alias("p"))))
    copied = copied.join(pairs.select("t").distinct(), "t", "leftsemi").distinct().groupBy("t").agg(F.count("*").alias("copied"))
    flagged = pairs.join(copied, "t", "left").withColumn("n_t", F.col("single") + F.coalesce("copied", F.lit(0))).withColumn("share", share(F.col("n_et"), "n_t")).filter(F.col("share") >= GENERALISE)
    return stored(flagged.join(held, ["n_e", "x", "y"]).groupBy("text_key", "t").agg(F.max("share").alias("share")), "disclosing")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_key, n_email, n_ip, n_card, n_phone, base and terms (array of {a, b, remove})
    for each row of ``docs``."""
    rows = stored(found(docs, id_col, text_col), "entities")
    out = rows.drop("entities").withColumnRenamed("id", id_col)
    flagged = disclosing(docs, text_col, rows)
    if flagged is None:
        return out.withColumn("terms", F.lit(None).cast("array<struct<a:int,b:int,remove:boolean>>"))
    places = scan(docs, text_col, places_of, "text_key string, t long, a int, b int", texts=bitmap(flagged.select(text_place().alias("p"))), terms=bitmap(flagged.select(term_place().alias("p"))))
    terms = (places.join(flagged, ["text_key", "t"]).distinct()
             .groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("a", "b", (F.col("share") >= REMOVE).alias("remove")))).alias("terms")))     # of one text
    return out.join(terms, "text_key", "left")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities replaced by their class, disclosing terms generalised to [TERM] or
    removed. Texts without either stay as they are."""
    once = spans(docs, id_col, text_col).filter("base != '' or terms is not null").groupBy(F.col("text_key").alias("__key")).agg(F.first("base").alias("__base"), F.first("terms").alias("__terms"))
    names = docs.columns
    joined = docs.withColumn("__text_key", text_key(text_col)).join(once, F.col("__text_key") == F.col("__key"), "left").select(*names, "__base", "__terms")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = rb.column(at).to_pylist()
            for i, (base, terms) in enumerate(zip(rb.column("__base").to_pylist(), rb.column("__terms").to_pylist())):
                if base or terms:
                    marks = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (x.split(":") for x in (base or "").split(",") if x)]
                    marks += [(t["a"], t["b"], "" if t["remove"] else "[TERM]") for t in terms or ()]
                    texts[i] = replaced(texts[i], marks)
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, rb.column(k).type) if k == at else rb.column(k) for k in range(len(names)))], names)

    return joined.mapInArrow(run, docs.schema)


def replaced(text: str, marks: list[tuple[int, int, str]]) -> str:
    """Each run of overlapping spans gives way to the name of the one that begins first (the
    longest of several)."""
    out, end = [], 0
    for a, b, name in sorted(marks, key=lambda m: (m[0], -m[1])):
        if a >= end:
            out += [text[end:a], name]
            end = b
        else:
            end = max(end, b)
    return "".join([*out, text[end:]])


def op7_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all rows of documents: base spans and disclosing terms."""
    docs = read(spark, sf_dir, "documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            base = [b for b in rb.column("base").to_pylist()]
            digest = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            whole = []
            for b, terms in zip(base, rb.column("terms").to_pylist()):
                if terms:
                    every = [(int(x), KINDS.index(k), int(y)) for k, x, y in (s.split(":") for s in b.split(","))]
                    b = spell(sorted([*every, *((t["a"], 4, t["b"]) for t in terms)]))
                whole.append(b)
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")), pa.array(digest, pa.string()), pa.array(whole, pa.string())], [f.name for f in schema.fields])

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(c, LongType()) for c in ("n_email", "n_ip", "n_card", "n_phone")), StructField("base_sha256", StringType()), StructField("spans", StringType())])
    return spans(docs).mapInArrow(run, schema)
