"""Text helpers, pre-tokens, BPE, ORC tokens, licenses, language."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import helpers as H  # noqa: E402

from riskspark.llm import common, license_template, orc_tokens, queries, transducer, wordlang  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list(" \n\t'\u0085\x1c 　sdtmrevlabcXYZ019.,!é中あ\U0001F600՘֐<|>") + ["'ll", "'re", " '", "'s", "  ", "<|endoftext|>", "\r\n", "ing" * 14, "a" * 70]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_words_are_those_of_bytes_split():
    texts = [*random_texts(0, 300), "", " x", "x ", "a b"]
    data, off = common.utf8_view(pa.array(texts))
    start, end, first = common.word_spans(data, off, common.SPACE)
    for k, t in enumerate(texts):
        assert [data[a:b].tobytes() for a, b in zip(start[first[k]:first[k + 1]], end[first[k]:first[k + 1]])] == t.encode().split()
    assert common.text_hash(["Abc", "aBC", "abd"])[0] == common.text_hash(["x", "abc"])[1]


def test_hash_index_finds_all_and_no_other():
    keys = common.mix(np.arange(5000, dtype=np.uint64))
    index = common.HashIndex(keys)
    assert (index.find(keys) == np.arange(5000)).all()
    assert (index.find(common.mix(np.arange(5000, 9000, dtype=np.uint64))) == -1).all()


def test_chunks_keep_all_rows():
    rb = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 30, 1, 1, 9)] + [None])], ["t"])
    assert [x for part in common.chunked([rb], "t", 10) for x in part.column(0).to_pylist()] == rb.column(0).to_pylist()


def test_library_encoder_equals_library_on_whole_texts(library):
    encoder = orc_tokens.LibraryEncoder(PATH)
    for seed in range(20):
        texts = random_texts(seed, 50)
        ids, n = encoder.encode(*common.utf8_view(pa.array(texts)))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.forget()
    assert encoder.encode(*common.utf8_view(pa.array([None, ""])))[1].tolist() == [0, 0]


@pytest.mark.parametrize("lexicon", [[], [b" the", b"the", b"ing", b" a", b"!!", b"X"]])
def test_transducer_equals_library(library, lexicon):
    coder = transducer.Coder(transducer.lexicon_arrays(lexicon, transducer.base_arrays(PATH)))
    for seed in range(20):
        texts = random_texts(seed, 50)
        ids, bounds = coder.encode(*common.utf8_view(pa.array(texts)))
        back, ends = coder.decode(ids, bounds)
        for k, t in enumerate(texts):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids[bounds[k]:bounds[k + 1]].tolist() == want
            assert back[ends[k]:ends[k + 1]].tobytes().decode() == library.decode(want, skip_special_tokens=False)


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(4)
    lexicon = sorted({bytes(rng.choices(b"abc", k=rng.randrange(1, 7))) for _ in range(400)})
    next_of, final = transducer.minimal_automaton(lexicon)
    state, byte, to, before = transducer.number_words(next_of, final)
    prefixes = {w[:k] for w in lexicon for k in range(len(w) + 1)}
    rests = {frozenset(w[len(p):] for w in lexicon if w.startswith(p)) for p in prefixes}
    assert len({0, *state.tolist(), *to.tolist()}) == len(rests)           # one state for each set of continuations
    move = {(s, b): (t, n) for s, b, t, n in zip(state, byte, to, before)}
    for k, w in enumerate(lexicon):
        at, number = 0, 0
        for b in w:
            at, n = move[at, b]
            number += n
        assert final[at] and number == k


def test_op6_edges(spark, library):
    docs = H.docs(spark, H.edge_rows())
    got = transducer.digest(docs, transducer.compile_lexicon(docs, PATH)).toPandas()
    want = []
    for i, t, _ in H.edge_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want)
    empty = docs.limit(0)
    assert transducer.digest(empty, transducer.compile_lexicon(empty, PATH)).count() == 0


def orc_want(rows, library):
    out, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op5_equals_library(spark, library):
    rows = spark.read.parquet(f"{H.SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.QUERIES["op5_orc_tokens"](spark, H.SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == orc_want(rows, library)


def test_orc_edges_and_lookup(spark, library):
    path = common.shared_path(spark, "orc-test")
    docs = H.docs(spark, H.edge_rows())
    orc_tokens.write(docs, path, PATH)
    tokens = spark.read.orc(path)
    rows = orc_tokens.starts(orc_tokens.digest(tokens)).orderBy("part", "line").collect()
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in H.edge_rows()), key=lambda x: (x is not None, x))
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    assert {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows} == {(i, n, c) for i, _, n, c in orc_want([r[:2] for r in H.edge_rows()], library)}
    found = orc_tokens.lookup(tokens, [7, 12345])
    assert [r["doc_id"] for r in found.collect()] == [7]
    assert "In(doc_id" in found._jdf.queryExecution().toString() or "doc_id IN" in found._jdf.queryExecution().toString()
    empty = common.shared_path(spark, "orc-test")
    orc_tokens.write(docs.limit(0), empty, PATH)
    assert spark.read.schema(tokens.schema).orc(empty).count() == 0


def test_license_automata():
    scanner = license_template.Scanner(license_template.PHRASES, license_template.TEMPLATES)

    def labels(text):
        return scanner.chunk(*common.utf8_view(pa.array([text])))["labels"][0]

    assert labels("Licensed under the terms of the Apache License, Version 2.0.") == "apache,apache-2.0"
    assert labels("Licensed under the Apache Licence, Version 2.0.") == ""
    assert labels("licensed under the GNU General Public License, either version 3") == "gpl,gpl-3.0"
    assert labels("licensed under the GNU General Public License, perhaps version 3") == "gpl"
    assert labels("x licensed under CC BY-NC 4.0") == "cc-by,cc-by-nc-4.0"
    header = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at {} unless required by applicable law"
    own = license_template.Scanner({}, {"header": [license_template.TEMPLATES["apache-2.0"][1]]})
    for place, want in (("http://x.org/a", "header"), ("", ""), ("a " * 13, "")):
        assert own.chunk(*common.utf8_view(pa.array([header.format(place)])))["labels"] == [want]


def test_license_edges(spark):
    rows = [*H.edge_rows(), (20, "mit license MIT LICENSE", None), (21, "MIT\nlicense x gnu general public license", None), (22, "mit", None), (23, "license", None)]
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_template.scan(H.docs(spark, rows)).collect()}
    assert {(20, 4, 2, 0, 2, "mit"), (21, 7, 2, 0, 3, "gpl,mit"), (22, 1, 0, None, None, ""), (1, 0, 0, None, None, "")} <= got
    assert license_template.scan(H.docs(spark, rows).limit(0)).count() == 0


def test_language_backs_off_to_grams():
    rng = random.Random(2)
    data = {"aa": ["bada", "dabab", "abadab"], "zz": ["zyxy", "xyzzy", "yzyx"]}
    rows = [(lang, [rng.choice(w) for _ in range(50)]) for lang, w in data.items()]
    model = {"langs": ["aa", "zz"], "kinds": {}}
    for kind in range(0, wordlang.LONGEST + 1):
        counts = {}
        for k, (lang, ws) in enumerate(rows):
            x = wordlang.Words(*common.utf8_view(pa.array([" ".join(ws)])))
            for h in (x.hash if kind == 0 else x.grams(np.arange(len(x.hash)), kind)[0]).tolist():
                counts.setdefault(h, [0.5, 0.5])[k] += 1
        model["kinds"][kind] = (np.array(list(counts), np.uint64), np.log(np.array(list(counts.values())) / 100))
    lang, score = wordlang.Predictor(model).chunk(*common.utf8_view(pa.array(["Bada DABAB", "zyxyzyx", "baddab", "qqq", "", "12 !", None])))
    assert lang == ["aa", "zz", "aa", "aa", "und", "und", "und"]
    assert score[0] > 0.9 and score[1] > 0.9 and abs(score[3] - 0.5) < 1e-9 and score[4] == 0


def test_language_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.QUERIES["op9_word_language"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    held = got[got["held_out"] & got["lang"].notna()]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    edges = H.docs(spark, H.edge_rows())                     # its column score is replaced
    out = wordlang.predict(edges, wordlang.train(edges)).select("doc_id", "lang_pred", "score").collect()
    assert len(out) == len(H.edge_rows()) and all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 9)) and 0 <= r["score"] <= 1 for r in out)
    none = edges.limit(0)
    assert [r["lang_pred"] for r in wordlang.predict(edges.limit(1), wordlang.train(none)).collect()] == ["und"]
    assert wordlang.predict(none, wordlang.train(none)).count() == 0


def thue_morse(n):
    """Words that collide with their complements in polynomial hashes modulo 2**64, whatever the base."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word[:n], word[:n].translate(str.maketrans("ab", "ba"))


def test_colliding_pre_tokens_keep_their_own_ids(library):
    texts = [w for n in (512, 1024, 2048, 4096) for w in thue_morse(n)] * 2
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    one, two = thue_morse(4096)
    start = np.array([0, 4096])
    raw = np.frombuffer((one + two).encode(), np.uint8)
    assert len(set(common.word_hashes(raw, start, start + 4096).tolist())) == 1                     # they do collide
    encoder = orc_tokens.LibraryEncoder(PATH)
    for part in (texts, texts[::-1], texts[1::2]):
        ids, n = encoder.encode(*common.utf8_view(pa.array(part)))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in part]
    coder = transducer.Coder(transducer.lexicon_arrays([one.encode(), b"ab"], transducer.base_arrays(PATH)))
    ids, bounds = coder.encode(*common.utf8_view(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def test_time_of_long_pre_tokens_is_in_proportion(library):
    import time
    coder = transducer.Coder(transducer.lexicon_arrays([], transducer.base_arrays(PATH)))
    rng = random.Random(6)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(200_000))

    def took(n):
        t = time.process_time()
        ids, _ = coder.encode(*common.utf8_view(pa.array([text[:n]])))
        return time.process_time() - t, ids

    assert took(2000)[1].tolist() == library.encode(text[:2000], add_special_tokens=False).ids
    assert took(200_000)[0] < 6 * took(50_000)[0] + 0.5


def test_time_of_many_license_anchors_is_in_proportion():
    import time
    scanner = license_template.Scanner(license_template.PHRASES, license_template.TEMPLATES)

    def took(n):
        data = common.utf8_view(pa.array(["licensed under the terms " * n]))
        t = time.process_time()
        scanner.chunk(*data)
        return time.process_time() - t

    took(100)
    assert took(80_000) < 8 * took(20_000) + 0.5             # 2 MB


def plain_languages(rows, texts):
    """Word-first backoff with dictionaries: rows (text, lang) to learn from, texts to judge; all counts are kept."""
    import math
    from collections import Counter, defaultdict

    def split(text):
        out, word = [], ""
        for c in (text or "") + " ":
            if c.isalpha():
                word += c.lower() if len(c.lower()) == 1 else c
            elif word:
                out.append(word)
                word = ""
        return out

    def grams(word, n):
        padded = f" {word} " if n > 1 else word
        return [padded[i:i + n] for i in range(len(padded) - n + 1)]

    counts = defaultdict(Counter)
    for text, lang in rows:
        for w in split(text):
            counts[lang, 0][w] += 1
            for n in range(1, wordlang.LONGEST + 1):
                counts[lang, n].update(grams(w, n))
    langs = sorted({lang for lang, _ in counts})
    known = {n: set().union(*(counts[x, n] for x in langs)) for n in range(wordlang.LONGEST + 1)}
    size = {(x, n): sum(counts[x, n].values()) + len(counts[x, n]) + 1 for x in langs for n in known}
    log = lambda x, n, key: math.log((counts[x, n][key] + 0.5) / size[x, n])

    def word_scores(w):
        if w in known[0]:
            return [log(x, 0, w) for x in langs]
        for n in range(wordlang.LONGEST, 0, -1):
            if found := [g for g in grams(w, n) if g in known[n]]:
                return [sum(log(x, n, g) for g in found) / len(found) for x in langs]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        scores = [word_scores(w) for w in split(text)]
        if not scores or not langs:
            out.append((wordlang.UND, 0.0))
            continue
        sums = [sum(s[k] for s in scores) for k in range(len(langs))]
        best = max(range(len(langs)), key=lambda k: sums[k])
        out.append((langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums)))
    return out


def test_languages_equal_plain_dictionaries(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{H.SF}/documents.parquet").limit(60).collect()]
    learn = [(t, x) for i, t, x in rows if x is not None and t is not None and i % 3]
    texts = [t for _, t, _ in rows] + ["", None, "12 ?!", "Überß straße ÉTÉ", "zzzz qqq", "日本 語", "a"]
    model = wordlang.train(spark.createDataFrame(learn, "text string, lang string"))
    asked = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = [(r["lang_pred"], r["score"]) for r in wordlang.predict(asked, model).orderBy("k").collect()]
    want = plain_languages(learn, texts)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)
