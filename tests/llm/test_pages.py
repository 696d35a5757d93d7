"""WARC archives and main text of pages."""

import gzip
import io
import os
import sys

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import helpers as H  # noqa: E402

from riskspark.llm import blocklstm, common, queries, warc  # noqa: E402


def archive(payloads):
    import hashlib

    return b"".join(warc.record(k, f"http://x/{k} é", p, hashlib.sha256(p).hexdigest(), None, False) for k, p in enumerate(payloads))


def test_reader_returns_what_was_written():
    payloads = [b"", b"x", os.urandom(300_000), b"\r\n\r\n" * 50, "é".encode() * 1000]
    raw = archive(payloads)
    got = list(warc.read_records(io.BytesIO(raw), with_payload=True))
    assert [r["payload"] for r in got] == payloads
    assert [warc.key_of(r["warc-record-id"]) for r in got] == list(range(5))
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == 5            # a plain gzip reader sees the members in a row


def test_reader_finds_damage():
    raw = archive([b"some payload " * 30] * 3)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(raw[:-9])))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(warc.record(1, None, b"abc", "0" * 64, None, False))))
    member = gzip.compress(gzip.decompress(archive([b"abcdef"])).replace(b"Content-Length: 6", b"Content-Length: 4"))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(member)))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(b"plain text")))


def test_warc_edges(spark):
    big, other = "p" * 100, "é" * 50
    rows = [(4, "u", big), (2, None, big), (2, "v", big), (None, "w", big), (7, "x\r\ny", None), (8, "", ""), (9, "u", "short"), (10, "u", "short"), (11, "u", other), (12, "u", other)]
    pages = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, path string, bytes string").repartition(3)
    got = warc.scan(warc.write(pages, common.shared_path(spark, "warc-test")), with_payload=True).collect()
    kinds = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == sorted([(4, "revisit", 2, 100), (2, "response", None, 100), (2, "response", None, 100), (-1, "revisit", 2, 100), (7, "response", None, 0), (8, "response", None, 0),
                            (9, "response", None, 5), (10, "response", None, 5), (11, "response", None, 100), (12, "revisit", 11, 100)], key=lambda x: x)
    assert {bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"} == {big, other, "", "short"}
    assert warc.scan(warc.write(pages.limit(0), common.shared_path(spark, "warc-test"))).count() == 0


@pytest.mark.parametrize("name", ["op1_warc", "op10_license_templates"])
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, H.SF).toPandas()
    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{H.SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name]).df()

    def rows(df):
        return sorted(map(repr, df[sorted(want.columns)].astype(object).where(df[sorted(want.columns)].notna(), None).map(lambda x: int(x) if isinstance(x, float) and x == int(x) else x).itertuples(index=False, name=None)))

    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav class="main-nav"><a href=/>Home</a></nav><div class="cookie-bar">We use cookies.</div><main><article><h1>Head &amp; line</h1>
<p>First&nbsp; para <b>&eacute;<br>two</b>.<p>Second &lt;para&gt;, long enough.<div class="ad">Buy</div><ul><li>One<li>Two</ul>
<section class="comments"><div class="comment"><p>Nice article, thanks for writing it.</p></div></section></article></main><footer>&copy; me</footer></body></html>"""


@pytest.fixture(scope="module")
def model():
    pages = [r[0] for r in duckdb.sql("select html from read_parquet('/root/testdata/sf0.01/pages.parquet') order by page_id limit 150").fetchall()]
    return blocklstm.fit(pages)


def test_blocks_of_a_page():
    texts = [b.text for b in blocklstm.blocks_of(PAGE)]
    assert texts == ["Home", "We use cookies.", "Head & line", "First para é two.", "Second <para>, long enough.", "Buy", "One", "Two", "Nice article, thanks for writing it.", "© me"]
    assert blocklstm.blocks_of("") == [] and [b.text for b in blocklstm.blocks_of("a < b <p")] == ["a < b <p"]


def test_unclosed_containers_leave_the_page_whole():
    def texts(page):
        return [b.text for b in blocklstm.blocks_of(page)]

    article = "<article><h1>Head</h1><p>First.</p><p>Second.</p></article>"
    for tag in ("object", "video", "audio", "canvas", "select", "svg", "math", "noscript", "template"):
        for page in (f"<body><{tag}>{article}</body>", f"<body><div><{tag}></div>{article}<div><{tag}>x</{tag}></div></body>"):
            assert texts(page)[:3] == ["Head", "First.", "Second."], (tag, page)
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>") == ["Let x=2 hold."]
    assert texts("<p>A <video><source src=v>fallback</video> and <object>other</object>.</p>") == ["A fallback and other."]
    assert texts("<p>A <svg><title>t</title><text>u</text></svg>b <select><option>c<option>d</select>e</p>") == ["A b e"]
    assert texts("<p>A</p><template><div>x<p>y</div></template><noscript><p>z</p></noscript><p>B<script>if (a<b) </p>") == ["A", "B"]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = blocklstm.Labeller(blocklstm.initial(rng))
    pages = [blocklstm.blocks_of(PAGE), blocklstm.blocks_of("<p>a b<p>c")]
    _, grads = net.gradients(pages)
    for name in ("wf", "ub", "cf", "out", "path", "word"):
        flat = np.flatnonzero(grads[name])[:3]
        for i in flat:
            at = np.unravel_index(i, grads[name].shape)
            net.p[name][at] += 1e-5
            up = net.gradients(pages)[0]
            net.p[name][at] -= 2e-5
            down = net.gradients(pages)[0]
            net.p[name][at] += 1e-5
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-4 * max(1, abs(grads[name][at]))


def test_main_text(spark, model):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<html><body></body></html>"), (None, PAGE), (1, PAGE), (5, "<article>" + "<p>word word word, and more words.</p>" * 4000 + "</article>")]
    pages = spark.createDataFrame([(i, h, "x", "y") for i, h in rows], "page_id long, html string, url string, path string").repartition(2)
    got = {(r["page_id"], r["text"]) for r in blocklstm.extract(pages, model).collect()}
    main = "Head & line\n\nFirst para é two.\n\nSecond <para>, long enough.\n\nOne\n\nTwo"
    assert got == {(1, main), (None, main), (2, ""), (3, ""), (4, ""), (5, "\n\n".join(["word word word, and more words."] * 4000))}
    empty = pages.limit(0)
    assert blocklstm.extract(empty, blocklstm.train(empty)).count() == 0


def test_held_out_pages_are_cut_as_their_landmarks(model):
    pages = [blocklstm.blocks_of(r[0]) for r in duckdb.sql("select html from read_parquet('/root/testdata/sf0.01/pages.parquet') order by page_id offset 150").fetchall()]
    labels = blocklstm.Labeller(model).label(pages)
    right = [all(bool(b.label) == bool(k) for b, k in zip(page, label)) for page, label in zip(pages, labels)]
    assert np.mean(right) > 0.97


def test_time_of_deep_pages_is_in_proportion():
    import time

    def took(n):
        t = time.process_time()
        found = blocklstm.blocks_of("<div>a" * n + "<span>" * n + "<p>b" * n + "</i>" * n)
        return time.process_time() - t, len(found)

    took(1000)
    assert took(40_000)[1] == 80_000 and took(40_000)[0] < 8 * took(10_000)[0] + 0.5


def test_words_of_a_block_count_to_its_end():
    """Blocks that differ after their first words have different inputs."""
    start = "word " * 60
    one, two = (blocklstm.encode_blocks(blocklstm.blocks_of(f"<p>{start}{end}</p>"))[2].tolist() for end in ("advert", "river"))
    assert len(one) == len(two) == 61 and one != two


def plain_labels(model, page):
    """The network on one page, a block and a gate at a time."""
    import math
    import zlib

    def mean(table, tokens):
        return np.mean([table[k] for k in tokens], axis=0)

    x = []
    for k, b in enumerate(page):
        names = {*b.path, *("near " + t for t in b.near)}
        tokens = [zlib.crc32(t.encode()) % blocklstm.PATH_BUCKETS for t in names] or [0]
        words = [zlib.crc32(w.encode()) % blocklstm.WORD_BUCKETS for w in b.text.lower().split()]
        n, stops = len(b.text), sum(b.text.count(c) for c in ".!?,")
        own = [math.log1p(n) / 8, b.linked / n, min(1.0, 20 * stops / n), float(len(b.tag) == 2 and b.tag.startswith("h")), float(b.tag == "p"), k / len(page), 1.0]
        x.append(np.concatenate([mean(model["path"], tokens), mean(model["word"], words), own]))
    size, gate = blocklstm.HIDDEN, lambda v: 1 / (1 + math.exp(-max(-30, min(30, v))))

    def read(order, w, u, c):
        h, s, out = np.zeros(size), np.zeros(size), {}
        for k in order:
            z = x[k] @ w + h @ u + c
            nh, ns = np.zeros(size), np.zeros(size)
            for j in range(size):
                i, f, o = (gate(z[j + q * size]) for q in range(3))
                ns[j] = f * s[j] + i * math.tanh(z[j + 3 * size])
                nh[j] = o * math.tanh(ns[j])
            h, s = nh, ns
            out[k] = h
        return out

    fwd = read(range(len(x)), model["wf"], model["uf"], model["cf"])
    back = read(range(len(x) - 1, -1, -1), model["wb"], model["ub"], model["cb"])
    return [bool(np.concatenate([fwd[k], back[k], x[k]]) @ model["out"] + model["bias"][0] > 0) for k in range(len(x))]


def test_labels_equal_a_plain_network(model):
    pages = [blocklstm.blocks_of(r[0]) for r in duckdb.sql("select html from read_parquet('/root/testdata/sf0.01/pages.parquet') order by page_id offset 200 limit 25").fetchall()]
    pages = [p for p in [*pages, blocklstm.blocks_of(PAGE)] if p]
    got = blocklstm.Labeller(model).label(pages)
    assert [g.tolist() for g in got] == [plain_labels(model, p) for p in pages]
