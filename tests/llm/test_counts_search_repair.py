"""Token counts, reversed search, conversation repair."""

import hashlib
import math
import os
import random
import re
import sys
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import helpers as H  # noqa: E402
from test_text import ALPHABET  # noqa: E402

from riskspark.llm import convrepair, pieces, queries, revsearch, tokencount  # noqa: E402
from riskspark.llm.common import utf8_view  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- op11

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    return tokencount.Counter(spec, tokencount.prove(spec))


def test_pieces_are_told_apart_by_bytes():
    data = np.frombuffer(b"abxabyab", np.uint8)
    codes, values = pieces.coded(pieces.binary(data, np.array([0, 2, 3, 5, 6, 8])))
    assert [values[c].as_py() for c in codes.tolist()] == [b"ab", b"x", b"ab", b"y", b"ab"]
    codes, values = pieces.words(data, np.array([0, 3, 6]), np.array([2, 5, 8]))
    assert len(set(codes.tolist())) == 1 and values[codes[0]].as_py() == b"ab"
    assert len(pieces.coded(pieces.binary(data, np.zeros(1, np.int64)))[0]) == 0


def test_proved_strings_are_single_tokens(counter, library):
    whole = counter.whole.to_pylist()
    assert len(whole) > 50_000
    for raw in random.Random(5).sample(whole, 500):
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        assert len(library.encode(text, add_special_tokens=False).ids) <= 1 + text.count("\n") + sum(c.isspace() for c in text) or len(counter.merger.ids(raw)) == 1


def test_counts_equal_the_library(counter, library):
    for seed in range(30):
        rng = random.Random(seed)
        texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(40)]
        n, _ = counter.count(*utf8_view(pa.array(texts)))
        assert n.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_crafted_pre_tokens_that_collide_in_polynomial_hashes(counter, library):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word[:n] for n in (1024, 2048)] + [word.translate(str.maketrans("ab", "ba"))[:n] for n in (1024, 2048)]
    n, _ = counter.count(*utf8_view(pa.array(texts)))
    assert n.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_memo_may_be_forgotten(counter, library, monkeypatch):
    monkeypatch.setattr(tokencount, "MEMO", 3)
    counter.merger.memo.clear()
    text = " ".join(H.words(random.Random(2), 300))
    assert counter.count(*utf8_view(pa.array([text])))[0].tolist() == [len(library.encode(text, add_special_tokens=False).ids)]


def test_time_of_long_pre_tokens_is_in_proportion(counter):
    def took(n):
        data = utf8_view(pa.array(["中文字" * n]))
        t = time.process_time()
        counter.count(*data)
        return time.process_time() - t

    took(1000)
    assert took(160_000) < 6 * took(40_000) + 0.5


def test_token_counts_of_a_table(spark, library):
    rows = H.edge_rows()
    out = tokencount.token_counts(H.docs(spark, rows), PATH, limit=20)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"]
    want = sorted((i is None, i or 0, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    assert tokencount.token_counts(H.docs(spark, []), PATH).count() == 0
    with pytest.raises(ValueError):
        tokencount.token_counts(H.docs(spark, rows).withColumnRenamed("doc_id", "n_bytes"), PATH, id_col="n_bytes")


def test_other_kinds_of_tokenizer_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        with pytest.raises(ValueError):
            tokencount.prove(f.read())


# ---------------------------------------------------------------- op13

def brute_search(docs, items, k):
    """(item place, rank, doc_id or None, score) by scoring every document for every item."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = [(i, pattern.findall((t or "").translate(lower))) for i, t in docs]
    cut = [(i, w) for i, w in cut if w]
    n, total = len(cut), sum(len(w) for _, w in cut)
    df = {}
    for _, w in cut:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for place, (_, text) in enumerate(items):
        found = []
        for i, w in cut:
            m, score = 25 + (75 * len(w) * n) // total, 0
            for t in pattern.findall((text or "").translate(lower)):
                if (tf := w.count(t)):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(place, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return out


def search_rows(seed, n_docs=120, n_items=9):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "é", "日本語", "ABC", "abc", "x9", "İ"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!", "_z"]) for _ in range(n))
    docs = [(k, text(rng.randrange(1, 30))) for k in range(n_docs)]
    docs += [(None, "w1 w2 abc"), (500, None), (501, ""), (502, " ,;_"), (503, "w3 w4 w5"), (503, "w3 w4 w5"), *((600 + k, "w7 w8 copies") for k in range(30)), (700, "w9 " * 5000)]
    items = [(k, text(rng.randrange(1, 12))) for k in range(n_items)] + [(90, None), (91, ""), (92, "nowhere"), (93, "w7 w7 w8 copies"), (93, "w1"), (None, "abc ABC w9")]
    return docs, items


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 4)])
def test_search_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(revsearch, "BLOCK_ITEMS", block)
    monkeypatch.setattr(revsearch, "CELLS", 100)
    docs, items = search_rows(seed)
    texts = H.docs(spark, [(i, t, "en") for i, t in docs])
    asked = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, score string").coalesce(1)
    got = revsearch.search(texts, asked, 5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = sorted((str(items[p][0]), r, str(d), s) for p, r, d, s in brute_search(docs, items, 5))
    assert sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in got.collect()) == want


def test_search_of_empty_tables(spark):
    docs, items = H.docs(spark, [(1, "a b", "en")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert revsearch.search(docs.limit(0), items).count() == 0
    assert revsearch.search(docs, items.limit(0)).count() == 0
    assert revsearch.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_length_term_is_exact_for_wide_products():
    for n, docs, total in ((20_000, 10**11, 10**14), (1, 1, 1), (10**9, 10**10, 10**13 + 7)):
        assert revsearch.length_term(np.array([n]), docs, total)[0] == 25 + (75 * n * docs) // total


# ---------------------------------------------------------------- op12

def brute_repair(rows):
    """rows: (turn, role, text) after damage, in order. The result by a plain recursion."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    fits = {0: "su", 1: "u", 2: "a", 3: "u"}
    after = {"s": 1, "u": 2, "a": 3}
    best = [[None] * 4 for _ in range(len(rows) + 1)]
    for j in range(len(rows), -1, -1):
        options = [[] for _ in range(4)]
        for q in range(4):
            if j == len(rows):
                if q in (0, 3):
                    options[q].append((0, "", []))
                continue
            _, role, text = rows[j]
            cost, audit, out = best[j + 1][q]
            options[q].append((cost + 2, "D" + audit, out))
            if faults[j] in ("", "truncated"):
                extra = 5 if faults[j] else 0
                if role[:1] and role[:1] in fits[q]:
                    cost, audit, out = best[j + 1][after[role[0]]]
                    options[q].append((cost + extra, "K" + audit, [f"{role}:{text}", *out]))
                new = "assistant" if q == 2 else "user"
                cost, audit, out = best[j + 1][after[new[0]]]
                options[q].append((cost + 1 + extra, "R" + audit, [f"{new}:{text}", *out]))
        best[j] = [min(o, default=(10**9, "", [])) for o in options]
        for _ in range(3):
            for q in range(4):
                new = "assistant" if q == 2 else "user"
                cost, audit, out = best[j][after[new[0]]]
                best[j][q] = min(best[j][q], (cost + 5, "I" + audit, [f"{new}:", *out]))
    cost, audit, out = best[0][0]
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Yes.", "No", "Why?", " ", "", None, "a longer text!\n", "tail \x1f", f"t{rng.randrange(30)}."])
            rows.append((c, None if rng.random() < 0.05 else turn + rng.randrange(2) * 3, role, text))
    rows += [(None, 1, "user", "no id."), (None, 2, "assistant", "none"), (777, 1, "user", "same."), (777, 1, "user", "same."), (777, 1, "user", "same.")]
    return rows


def damage(rows):
    """Rows of each conversation after damage, in order; every conversation is there."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(r, key=key) for c, r in out.items()}


def as_frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, cost int").repartition(5)


def results(out):
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out.collect()}


@pytest.mark.parametrize("seed,bits", [(1, 12), (2, 12), (3, 1), (4, 0)])
def test_repair_equals_brute_force(spark, monkeypatch, seed, bits):
    """Also with pieces of one or two rows, so that paths cross many pieces."""
    monkeypatch.setattr(convrepair, "PIECE_BITS", bits)
    rows = conversations(seed)
    got = results(convrepair.repair(convrepair.damaged(as_frame(spark, rows))))
    assert got == {c: brute_repair(r) for c, r in damage(rows).items()}


def test_repair_in_sql_equals_brute_force():
    rows = conversations(9, 25)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = {r[0]: tuple(r[1:]) for r in con.execute(convrepair.ORACLE).fetchall()}
    assert got == {c: brute_repair(r) for c, r in damage(rows).items()}


def test_repair_of_a_long_conversation_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(convrepair, "PIECE_BITS", 8)
    rng = random.Random(3)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"t{k}.", f"t{k}"])) for k in range(3000)] + [(1, 9000, "user", "again.")] * 500
    assert results(convrepair.repair(convrepair.damaged(as_frame(spark, rows)))) == {c: brute_repair(r) for c, r in damage(rows).items()}
    assert convrepair.repair(convrepair.damaged(as_frame(spark, []))).count() == 0


def test_ranks_choose_the_least_of_equally_cheap_audits():
    symbols = np.array([1 * 3, 1 * 3 + 2, 2 * 3])            # user, a blank user, assistant
    got, _ = convrepair.audits(symbols, np.zeros(3, np.int64), np.array([0, 3]), np.array([convrepair.AT_END]), np.array([True]), np.array([True]))
    assert got == [["KDK"]]
    symbols = np.array([3, 3])                               # two users: delete one (2), rerole the second (1)
    got, _ = convrepair.audits(symbols, np.zeros(2, np.int64), np.array([0, 2]), np.array([convrepair.AT_END]), np.array([True]), np.array([True]))
    assert got == [["KR"]]


@pytest.mark.parametrize("name", ["op11_whole_tokens", "op12_path_ranking", "op13_reversed_search"])
def test_queries_run_on_a_table_with_their_columns(spark, name):
    want = {"op11_whole_tokens": ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"], "op13_reversed_search": ["item_id", "rank", "doc_id", "score"],
            "op12_path_ranking": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]}
    assert queries.QUERIES[name](spark, H.SF).columns == want[name]
    assert queries.QUERIES[name](spark, H.SF).agg(F.count("*")).first()[0] > 0
