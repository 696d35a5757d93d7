"""Near duplicates, decontamination, personal data, embeddings and the pipeline, against brute force."""

import os
import random
import re
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import helpers as H  # noqa: E402

from riskspark.llm import capfilter, common, links, qgram, queries, sanitise, setsketch  # noqa: E402


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def near_copies(seed=3):
    """Families whose members differ by growing shares of words, so chains and non-links arise."""
    rng, out = random.Random(seed), []
    for family in range(12):
        base = H.words(rng, rng.choice([3, 8, 40, 120]))
        for copy in range(rng.randrange(1, 14)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(50)}"
            out.append(" ".join(text))
            if rng.random() < 0.2:
                base = text
    rng.shuffle(out)
    return out


def test_components_equal_brute_force(spark):
    texts = near_copies()
    sets = [shingles(t, 4) for t in texts]
    want = brute_components(len(texts), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = setsketch.near_duplicates(H.docs(spark, [(i, t, "en") for i, t in enumerate(texts)]), k=4).orderBy("doc_id").collect()
    assert [r["n_shingles"] for r in got] == [len(s) for s in sets]
    assert [r["component_id"] for r in got] == want
    assert [r["kept"] for r in got] == [i == c for i, c in enumerate(want)]
    assert len(set(want)) < len(texts)


def test_near_duplicate_edges(spark):
    docs = H.docs(spark, H.edge_rows())
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in setsketch.near_duplicates(docs).collect())
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (5, 3, 5, True) in got and (6, 3, 5, False) in got and (-1, 3, None, True) in got
    stay = sorted((r["doc_id"] or -1) for r in setsketch.deduplicated(docs).collect())
    assert stay == [-1, 1, 2, 3, 5, 7, 8, 9] and setsketch.deduplicated(docs).columns == docs.columns
    assert setsketch.near_duplicates(docs.limit(0)).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.8, 0.95):
        guesses = []
        for _ in range(15):
            n = int(rng.integers(50, 3000))
            shared = int(round(2 * n * j / (1 + j)))
            x = common.mix(rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64))
            a, b, union = np.sort(x[:n]), np.sort(x[n - shared:]), np.sort(x)
            ra, rb, ru = (setsketch.registers(s, np.array([0, len(s)])) for s in (a, b, union))
            assert (setsketch.merge(ra, rb) == ru).all()
            guesses.append(setsketch.estimate(ra, rb, np.array([n]), np.array([n]))[0])
        assert abs(np.mean(guesses) - j) < 0.04 and max(abs(g - j) for g in guesses) < 0.2


def test_contraction_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = links.components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 140))]
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- decontamination

def reduced(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def edits(item, text):
    """Least edits of ``item`` in any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    pool = ["river", "stone", "quickly", "over", "the", "blue", "window", "and", "seven", "small", "houses", "écoute", "bien"]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([3, 6, 12, 25])))) for i in range(8)]
    rows = []
    for d in range(60):
        text = rng.choices(pool, k=rng.randrange(0, 60))
        if d % 2:
            leak = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 5)):
                leak[rng.randrange(len(leak))] = rng.choice("qzx")
            if rng.random() < 0.3:
                leak = list("".join(leak).upper().replace(" ", " ,\n"))
            text.insert(rng.randrange(len(text) + 1), "".join(leak))
        rows.append((d, " ".join(text), "en"))
    got = qgram.matches(H.docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for d, t, _ in rows:
        for i, x in items:
            x, s = " ".join(reduced(x)), " ".join(reduced(t))
            if len(x) >= qgram.Q and (e := edits(x, s)) <= qgram.budget(len(x)):
                want[d, i] = e
    found = {}
    for r in got:
        found[r["doc_id"], r["item_id"]] = min(r["edits"], found.get((r["doc_id"], r["item_id"]), 99))
        part = " ".join(reduced(rows[r["doc_id"]][1][r["start"]:r["end"]]))
        assert edits(" ".join(reduced(dict(items)[r["item_id"]])), part) <= r["edits"]
    assert found == want and any(want.values()) and len(want) > 20


def test_decontamination_edges(spark):
    item = "a passage of the benchmark that is long enough to be found"
    docs = H.docs(spark, [*H.edge_rows(), (30, "x " * 50_000 + item + " y" * 50_000, "en"), (None, item.upper(), "en"), (31, item[:30], "en")])
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "!!"), (5, "tiny"), (1, item)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["end"] - r["start"]) for r in qgram.matches(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(30, 1, len(item))] * 2 + [(None, 1, len(item))] * 2, key=str)
    assert qgram.clean(docs, items).count() == docs.count() - 2 and qgram.clean(docs, items).columns == docs.columns
    assert qgram.matches(docs, items.limit(0)).count() == 0 and qgram.matches(docs.limit(0), items).count() == 0


def test_planted_passages_are_found(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{H.SF}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{H.SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op4_qgram_decontamination"](spark, H.SF).collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert exact and exact <= got


# ---------------------------------------------------------------- personal data

def naive_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    alphabet = list("ab1 2-3.4+5@6(7)8_9%0A") + ["a@b.c", "1.2.3.4", "+1 (743) 555-3824", "4757965300669737 ", "é"]
    for _ in range(20_000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert naive_spans(t) == sanitise.base_spans(t), t
    for t in ("1" * 50_000, "a" * 50_000 + "@", "1." * 20_000, "+1" + " (" * 20_000, "1 " * 20_000):
        sanitise.base_spans(t)                                 # in linear time


def test_disclosing_terms(spark):
    rng = random.Random(6)
    rows = [(200 + i, " ".join(H.words(rng, 40, 60)) + " meeting notes today", "en") for i in range(80)]
    for i in range(6):
        rows.append((100 + i, f"{' '.join(H.words(rng, 5, 60))} Xanthippe today mail jane@corp.example.com {' '.join(H.words(rng, 5, 60))}", "en"))
    rows.append((106, rows[-1][1], "en"))
    docs = H.docs(spark, [*H.edge_rows(), *rows])
    out = {r["doc_id"]: r for r in sanitise.spans(docs).collect()}
    text = dict((r[0], r[1]) for r in rows)
    for i in (100, 105, 106):
        assert {text[i][t["a"]:t["b"]] for t in out[i]["terms"]} == {"Xanthippe", "mail"} and out[i]["n_email"] == 1
    assert all(not out[200 + i]["terms"] for i in range(80))
    clean = {r["doc_id"]: r["text"] for r in sanitise.redact(docs).collect()}
    assert "[EMAIL]" in clean[100] and "Xanthippe" not in clean[100] and "today" in clean[100] and clean[3] == " \n\t " and clean[1] is None and clean[7] == dict((r[0], r[1]) for r in H.edge_rows())[7]
    assert sanitise.redact(docs).columns == docs.columns and sanitise.redact(docs.limit(0)).count() == 0


def test_disclosing_terms_at_any_distance(spark):
    """Terms that stand far from the entity, once or always, are evidence and are marked at each place."""
    rng = random.Random(7)
    rows = [(200 + i, " ".join(H.words(rng, 40, 60)) + " meeting notes today", "en") for i in range(80)]
    for i in range(6):
        far = " ".join(H.words(rng, 60, 60))
        rows.append((100 + i, f"Zenobia {far} Xanthippe mail jane@corp.example.com today {far} Xanthippe {far}", "en"))
    docs = H.docs(spark, [*H.edge_rows(), *rows])
    text = dict((r[0], r[1]) for r in rows)
    out = {r["doc_id"]: r for r in sanitise.spans(docs).collect()}
    for i in range(100, 106):
        assert [text[i][t["a"]:t["b"]] for t in out[i]["terms"]] == ["Zenobia", "Xanthippe", "mail", "Xanthippe"]
    assert all(not r["terms"] for i, r in out.items() if i not in range(100, 106))
    clean = {r["doc_id"]: r["text"] for r in sanitise.redact(docs).collect()}
    assert all("Xanthippe" not in clean[i] and "Zenobia" not in clean[i] for i in range(100, 106))


def test_disclosing_terms_equal_brute_force(spark):
    """Shares from whole texts, exact copies counted once."""
    from math import log

    rng, mails = random.Random(9), [f"m{k}@x.org" for k in range(6)]
    texts = []
    for _ in range(150):
        k = rng.randrange(12)
        own = [f"own{chr(97 + k)}"] + [f"own{chr(97 + rng.randrange(12))}"] * (rng.random() < 0.2)
        body = ["".join(rng.choice("abc") for _ in range(3)) for _ in range(8)] + own * rng.randrange(1, 3) + (mails[k:k + 2] if k < 6 else [])
        rng.shuffle(body)
        texts.append(" , ".join(body))
    texts += rng.choices(texts, k=60)
    once = sorted(set(texts))
    ents = [{m.group() for m in re.finditer(r"m[0-9]@x\.org", t)} for t in once]
    terms = [set(re.findall("[a-z]{3,}", re.sub(r"m[0-9]@x\.org", "", t))) for t in once]
    want = {}
    for e in mails:
        n_e = sum(e in x for x in ents)
        for term in set().union(*terms):
            n_et, n_t = sum(e in x and term in y for x, y in zip(ents, terms)), sum(term in y for y in terms)
            if n_et >= sanitise.SUPPORT and (share := log(len(once) * n_et / (n_e * n_t)) / log(len(once) / n_e)) >= sanitise.GENERALISE:
                for t, x in zip(once, ents):
                    if e in x and term in t:
                        want[t, term] = max(share, want.get((t, term), 0))
    docs = H.docs(spark, [(i, t, "en") for i, t in enumerate(texts)])
    got = [{(texts[r["doc_id"]], texts[r["doc_id"]][x["a"]:x["b"]], x["remove"]) for x in r["terms"] or ()} for r in sanitise.spans(docs).collect()]
    assert want and set().union(*got) == {(t, term, share >= sanitise.REMOVE) for (t, term), share in want.items()}


def test_replaced_merges_overlaps():
    assert sanitise.replaced("abcdefgh", [(1, 4, "[X]"), (2, 6, "[Y]"), (7, 8, "")]) == "a[X]g"


def test_op7_base_columns(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{H.SF}/documents.parquet").collect()}
    got = queries.QUERIES["op7_disclosure_pii"](spark, H.SF).collect()
    assert len(got) == len(docs)
    import hashlib
    for r in got:
        base = naive_spans(docs[r["doc_id"]] or "")
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(sanitise.spell(base).encode()).hexdigest()
        assert set(filter(None, sanitise.spell(base).split(","))) <= set(filter(None, r["spans"].split(",")))


# ---------------------------------------------------------------- embeddings

def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 24))
    for k in range(60):                                       # copies at growing distances, some equal, some opposite
        x[k + 60] = x[k] + rng.normal(size=24) * 0.02 * (k % 25)
    x[120:140] = x[0]
    x[140] = -x[1]
    x[150:190] = x[3] + rng.normal(size=(40, 24)) * 0.13
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, []), (905, [float("inf")] * 24), (906, [1.0, 0.0]), (907, [2.0, 0.1]), (None, x[0].tolist()), (5, x[5].tolist()), (908, (x[7] * 1e200).tolist())]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], "vec_id long, embedding array<double>, node string, unit string").repartition(3)
    got = sorted(capfilter.near_duplicates(frame).collect(), key=lambda r: (str(r["vec_id"]), r["n_links"]))
    ok = [(i, np.array(v) / np.abs(v).max()) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    units = [(i, v / np.linalg.norm(v)) for i, v in ok]
    link = [[a != b and len(u) == len(v) and float(u @ v) >= 0.95 for b, (_, v) in enumerate(units)] for a, (_, u) in enumerate(units)]
    comp = brute_components(len(units), lambda a, b: link[a][b])
    least = {}
    for c, (i, _) in zip(comp, units):
        least[c] = min([v for v in (least.get(c), i) if v is not None], default=None)
    want = [(i, sum(l), least[c]) for (i, _), l, c in zip(units, link, comp)] + [(i, 0, i) for i in range(900, 906)]
    assert [(r["vec_id"], r["n_links"], r["component_id"]) for r in got] == sorted(want, key=lambda r: (str(r[0]), r[1]))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert capfilter.near_duplicates(frame.limit(0)).count() == 0


def test_list_decoding_finds_the_best_directions():
    code, rng = capfilter.Code(10, 40), np.random.default_rng(4)
    x = rng.normal(size=(20, 10))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x @ code.rotation
    every = (y[:, :5] @ code.words[0].T)[:, :, None] + (y[:, 5:] @ code.words[1].T)[:, None, :]
    for row, scores in zip(code.decode(x, 48), every.reshape(20, -1)):
        assert set(row.tolist()) == set(np.argsort(-scores)[:48].tolist())


# ---------------------------------------------------------------- the pipeline

def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(8)
    item = "this very passage belongs to the benchmark and must not be learned"
    base = H.words(rng, 60)
    near = " ".join([*base[:-1], "other"])
    good = [(20 + i, " ".join(H.words(rng, 50)) + f" mail me{i}@x.org", "en") for i in range(5)]
    rows = [*H.edge_rows(), (10, " ".join(base), "en"), (11, near, "en"), (12, " ".join(base), "en"), (13, "words before " + item + " words after", "en"), *good]
    sf = f"file://{tmp_path}"
    H.docs(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, names = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = common.stored(stage(spark, docs, sf), "test-" + name)
        names.append(sorted((r["doc_id"] or -1) for r in docs.select("doc_id").collect()))
        if name == "personal_data":
            texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
        assert docs.columns == columns or name == "tokens"
    some = [20, 21, 22, 23, 24]
    assert names == [sorted([-1, 5, 5, 6, 7, 8, 10, 11, 12, 13, *some]), sorted([-1, 5, 7, 8, 10, 13, *some]), *[sorted([-1, 5, 7, 8, 10, *some])] * 3]
    assert all("[EMAIL]" in texts[i][0] and len(texts[i][0]) == texts[i][1] for i in some)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in docs.collect():
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]][0], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    assert corpus_pipeline.run(spark, sf).count() == len(names[-1])
    empty = H.docs(spark, rows).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_components_are_joined_by_fresh_links(spark):
    """Links that come in later, between known components and new nodes, give what all links give at once."""
    rng = random.Random(8)
    old = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    new = [(rng.randrange(90), rng.randrange(90)) for _ in range(25)]
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    groups = lambda out: sorted(sorted(g) for g in out.groupBy("root").agg({"node": "collect_list"}).toPandas().iloc[:, 1])
    roots = links.joined(links.components(frame(old)), frame(new))
    assert groups(roots) == groups(links.components(frame(old + new)))
    assert roots.join(roots.select("node").toDF("root"), "root", "left_anti").count() == 0        # a root is a node of its component
    assert links.joined(links.components(frame([])), frame([(1, 2)])).count() == 2


def test_short_items_are_matched_on_word_borders(spark):
    items = spark.createDataFrame([(1, "7 x 8?"), (2, "中国的首都是哪里"), (3, "Why so"), (4, "Why so"), (5, "!")], "item_id long, text string")
    rows = [(1, "so 7 (x) 8, then", "en"), (2, "17 x 8 and 7 x 81", "en"), (3, "请问中国的首都是哪里？", "zh"), (4, "why, so? why so", "en"), (5, "whyso why sofa", "en"), (6, "why", "en"), (7, "so", "en"), (8, "", "en")]
    got = sorted((r["doc_id"], r["item_id"], r["start"], r["end"], r["edits"]) for r in qgram.matches(H.docs(spark, rows), items).collect())
    assert got == [(1, 1, 3, 10, 0), (3, 2, 2, 10, 0), *((4, i, s, e, 0) for i in (3, 4) for s, e in ((0, 7), (9, 15)))]


def test_recall_by_replaced_words():
    """Items of some 37 words with words replaced by others: what the budget of edits reaches."""
    rng = random.Random(2)
    pool = ["river", "stone", "quickly", "over", "the", "blue", "window", "and", "seven", "small", "houses", "écoute", "bien"]
    items = [(i, " ".join(rng.choices(pool, k=37))) for i in range(60)]
    index = qgram.Index(items)
    recall = []
    for k in (0, 1, 2):
        texts = []
        for _, t in items:
            w = t.split()
            for a in rng.sample(range(37), k):
                w[a] = rng.choice(pool)
            texts.append(" ".join(rng.choices(pool, k=20) + w + rng.choices(pool, k=20)))
        found = {(r[0], r[1]) for r in qgram.chunk_matches(index, *common.utf8_view(pa.array(texts)))}
        recall.append(sum((i, i) in found for i in range(60)) / 60)
    assert recall[0] == 1 and recall[1] >= 0.98 and recall[2] >= 0.8
