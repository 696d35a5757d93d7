"""License scans by template matching.

A license template is marked-up wording: plain words are mandatory, ``[[ ... ]]`` is an
optional region, ``{min,max}`` a replaceable region of that many words. Each template is
compiled into a token automaton (states are positions in the wording, an optional region
adds a skip, a replaceable region a counted loop); a text is accepted where the automaton
runs from its first to its last word, i.e. where all mandatory words match exactly.

``scan`` also reports the fixed phrases of PHRASES wherever their words stand consecutively.

Defined cases: a null or empty text has no words and no label; a row is judged by itself,
so repeated rows, ties, null ids and extra columns of any name change nothing; an empty
table gives an empty result. Very long texts are read whole: the automata start only at
words that can begin a template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riskspark.llm.common import HashIndex, chunked, read, text_hash, utf8_view, word_hashes, word_spans

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licenses and license notices, as templates.
TEMPLATES = {
    "gpl-3.0": [
        "licensed under the [[terms of the]] GNU General Public License [[as published by the Free Software Foundation]]"
        " [[either]] version 3 [[of the license]]",
        "this program is free software you can redistribute it and or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation either version 3 of the license or [[at your option]] any later version",
    ],
    "gpl-2.0": [
        "licensed under the [[terms of the]] GNU General Public License [[as published by the Free Software Foundation]]"
        " [[either]] version 2 [[of the license]]",
        "this program is free software you can redistribute it and or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation either version 2 of the license or [[at your option]] any later version",
    ],
    "apache-2.0": [
        "licensed under the [[terms of the]] Apache License version 2 0",
        "licensed under the Apache License version 2 0 the license you may not use this file except in compliance with the"
        " license you may obtain a copy of the license at {1,12} unless required by applicable law",
    ],
    "cc-by-4.0": ["licensed under [[a]] [[the]] [[creative commons]] CC BY 4 0"],
    "cc-by-sa-4.0": ["licensed under [[a]] [[the]] [[creative commons]] CC BY SA 4 0"],
    "cc-by-nc-4.0": ["licensed under [[a]] [[the]] [[creative commons]] CC BY NC 4 0"],
    "mit": [
        "released under the [[terms of the]] MIT License",
        "licensed under the [[terms of the]] MIT License",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice"
        " and this permission notice [[including the next paragraph]] shall be included in all copies or substantial"
        " portions of the software",
    ],
    "bsd-2-clause": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list"
        " of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright"
        " notice this list of conditions and the following disclaimer in the documentation and or other materials provided"
        " with the distribution",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
    ],
}

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True  # A-Z are words' letters

Token = tuple[str, object]


def parse(markup: str) -> list[Token]:
    """("word", w) | ("skip", n): the next n tokens are optional | ("any", (min, max))."""
    out: list[Token] = []
    for optional, region, word in re.findall(r"\[\[(.*?)\]\]|(\{\d+,\d+\})|([^\s\[\]{}]+)", markup):
        if optional:
            inner = parse(optional)
            out += [("skip", len(inner)), *inner]
        elif region:
            low, high = map(int, region[1:-1].split(","))
            out.append(("any", (low, high)))
        else:
            out.append(("word", word.lower()))
    return out


class Automaton:
    """Non-deterministic automaton over word numbers. A state is (token, words already taken
    by the replaceable region at that token)."""

    def __init__(self, markup: str, number: dict[str, int]):
        self.tokens = [(k, number[v] if k == "word" else v) for k, v in parse(markup)]
        self.begin = self.close({(0, 0)})
        self.first = {self.tokens[i][1] for i, _ in self.begin if i < len(self.tokens) and self.tokens[i][0] == "word"}

    def close(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        seen, todo = set(), list(states)
        while todo:
            s = i, taken = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            if i < len(self.tokens):
                kind, v = self.tokens[i]
                if kind == "skip":
                    todo += [(i + 1, 0), (i + 1 + v, 0)]
                elif kind == "any" and taken >= v[0]:
                    todo.append((i + 1, 0))
        return seen

    def match(self, words: list[int], at: int, end: int) -> bool:
        """Whether the wording stands in ``words`` from ``at`` on, before ``end``. It reads no
        further than the longest wording that the template accepts."""
        states = self.begin
        for k in range(at, end):
            if any(i == len(self.tokens) for i, _ in states):
                return True
            w, step = words[k], set()
            for i, taken in states:
                if i < len(self.tokens):
                    kind, v = self.tokens[i]
                    if kind == "word" and v == w:
                        step.add((i + 1, 0))
                    elif kind == "any" and taken < v[1]:
                        step.add((i, taken + 1))
            if not step:
                return False
            states = self.close(step)
        return any(i == len(self.tokens) for i, _ in states)


class Scanner:
    """Phrases and automata over one vocabulary; ``chunk`` scans the documents of a chunk."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        words = sorted({w for p in phrases for w in p.split()} | {v for ms in templates.values() for m in ms for k, v in parse(m) if k == "word"})
        number = {w: i for i, w in enumerate(words)}
        self.index = HashIndex(text_hash(words))
        self.phrases = [([number[w] for w in p.split()], label) for p, label in phrases.items()]
        self.automata = [(label, Automaton(m, number)) for label, ms in templates.items() for m in ms]
        self.anchors = sorted(set().union(*(a.first for _, a in self.automata))) if self.automata else []

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, list]:
        starts, ends, first = word_spans(data, offsets, SEPARATOR)
        n_words = np.diff(first)
        ids = self.index.find(word_hashes(data, starts, ends))
        hits: list[tuple[int, int, str]] = []           # document, word, base label
        for wording, label in self.phrases:
            at = np.flatnonzero(ids[:len(ids) - len(wording) + 1] == wording[0])
            for k, w in enumerate(wording[1:], 1):
                at = at[ids[at + k] == w]
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + len(wording) <= first[doc + 1]
            hits += [(int(d), int(a - first[d]), label) for d, a in zip(doc[inside], at[inside])]
        found: dict[int, set[str]] = {}
        at = np.flatnonzero(np.isin(ids, self.anchors))
        doc = np.searchsorted(first, at, "right") - 1
        # every template begins with two words of the vocabulary
        two = (at + 1 < first[doc + 1]) & (np.append(ids, -1)[at + 1] >= 0)
        words = ids.tolist() if two.any() else []
        for d, a, end in zip(doc[two].tolist(), at[two].tolist(), first[doc[two] + 1].tolist()):
            for label, automaton in self.automata:
                if words[a] in automaton.first and label not in found.get(d, ()) and automaton.match(words, a, end):
                    found.setdefault(d, set()).add(label)
        out = {"n_words": n_words.tolist()} | {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        by_doc: dict[int, list[tuple[int, str]]] = {}
        for d, a, label in hits:
            by_doc.setdefault(d, []).append((a, label))
        for d in range(len(n_words)):
            base, more = by_doc.get(d, ()), found.get(d, set())
            labels = {label for _, label in base}
            out["n_base"].append(len(base))
            out["first_word"].append(min(base)[0] if base else None)
            out["last_word"].append(max(base)[0] if base else None)
            out["base_labels"].append(",".join(sorted(labels)))
            out["labels"].append(",".join(sorted(labels | more)))
            out["score"].append(1.0 if more else 0.5 if base else 0.0)
        return out


FIELDS = [("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"),
          ("last_word", pa.int64(), "long"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"),
          ("score", pa.float64(), "double")]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
         templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col and the columns of FIELDS. score: 1 where a template
    was accepted, 0.5 where only phrases were found, else 0. No shuffle."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for rb in chunked(batches, text_col):
            got = scanner.chunk(*utf8_view(rb.column(text_col)))
            yield pa.RecordBatch.from_arrays([rb.column(id_col), *(pa.array(got[n], t) for n, t, _ in FIELDS)], [id_col, *(n for n, _, _ in FIELDS)])

    kind = dict(docs.dtypes)[id_col]
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{n} {s}" for n, _, s in FIELDS)])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op10_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of every row of documents, whole texts."""
    return scan(read(spark, sf_dir, "documents"))


def pattern(markup: str) -> str:
    """The regular expression of a template over words joined by single blanks, each followed by one."""
    def walk(tokens: list[Token]) -> str:
        out, i = "", 0
        while i < len(tokens):
            kind, v = tokens[i]
            if kind == "skip":
                out += f"(?:{walk(tokens[i + 1:i + 1 + v])})?"
                i += v
            elif kind == "any":
                out += f"(?:[^ ]+ ){{{v[0]},{v[1]}}}"
            else:
                out += f"{v} "
            i += 1
        return out
    return walk(parse(markup))


def oracle() -> str:
    places = {p: f"len(list_filter(range(0, greatest(len(w) - {len(p.split()) - 1}, 0)), lambda i: " + " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + "))" for p in PHRASES}
    spots = {p: x.removeprefix("len(")[:-1] for p, x in places.items()}
    label = " , ".join(f"case when len({spots[p]}) > 0 then '{v}' end" for p, v in PHRASES.items())
    more = " , ".join(f"case when {' or '.join(f"regexp_matches(s, ' {pattern(m)}')" for m in ms)} then '{v}' end" for v, ms in TEMPLATES.items())
    upper = "".join(map(chr, range(65, 91)))
    return f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
e as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' s from d),
f as (select doc_id, len(w) n_words, list_concat({", ".join(spots.values())}) places,
  list_distinct(list_filter([{label}], lambda x: x is not null)) base,
  list_distinct(list_filter([{more}], lambda x: x is not null)) more from e)
select doc_id, n_words::bigint n_words, len(places)::bigint n_base, list_min(places)::bigint first_word, list_max(places)::bigint last_word,
  array_to_string(list_sort(base), ',') base_labels, array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') labels,
  case when len(more) > 0 then 1.0 when len(places) > 0 then 0.5 else 0.0 end::double score from f"""
