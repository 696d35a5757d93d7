"""Cutting whole chunks of text into the pre-tokens of a byte-level BPE tokenizer.

The public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
is expressed as rules on runs of one character class, evaluated by numpy over all
documents of a chunk. The class of a character is asked of the tokenizers library when the
character is first seen, so that both agree on any version of Unicode.
"""

from __future__ import annotations

import numpy as np

from riskspark.llm.pieces import binary, coded

SPECIAL = "<|endoftext|>"      # fixed value: the vocabulary's only added token
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255


class PreTokenizer:
    def __init__(self):
        from tokenizers import pre_tokenizers

        self.probe = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)

    def classes(self, points: np.ndarray) -> np.ndarray:
        kind = self.kind[points]
        if (new := points[kind == UNKNOWN]).size:
            for c in np.unique(new).tolist():
                alike = [len(self.probe(x + chr(c))) == 1 for x in "a1!"]
                self.kind[c] = next((k for k, same in zip((LETTER, NUMBER, OTHER), alike) if same), SPACE)
            kind = self.kind[points]
        return kind

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where the pre-tokens of a chunk begin (and its end), and for each
        document the index of its first pre-token (one more at the end)."""
        raw = data.tobytes()
        edges = offsets[(offsets > 0) & (offsets < len(raw))]
        spans = np.zeros((0, 2), np.int64)
        if SPECIAL.encode() in raw:
            spans, at = [], raw.find(SPECIAL.encode())
            while at >= 0:
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(SPECIAL) - 1, "right"):
                    spans.append((at, at + len(SPECIAL)))
                    at = raw.find(SPECIAL.encode(), at + len(SPECIAL))
                else:
                    at = raw.find(SPECIAL.encode(), at + 1)
            spans = np.array(spans, np.int64).reshape(-1, 2)
            edges = np.unique(np.concatenate([edges, spans.ravel()]))
            edges = edges[(edges > 0) & (edges < len(raw))]
        if not raw:
            return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(points) == len(raw):
            place, edge = None, edges
        else:
            place = np.flatnonzero((data & 0xC0) != 0x80)           # byte position of each character
            edge = np.searchsorted(place, edges)
        n, kind = len(points), self.classes(points)
        start = np.ones(n + 1, bool)
        start[1:n] = kind[1:] != kind[:-1]
        start[edge] = True
        hard = np.zeros(n + 1, bool)                                 # a document (or special token) begins here
        hard[edge] = hard[0] = hard[n] = True
        # the last white space before other text: a blank joins that text, any other is a token of its own
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~hard[1:n]) + 1
        start[after - 1] = True
        start[after[points[after - 1] == 0x20]] = False
        # contractions, where an apostrophe begins a token
        quote = np.flatnonzero((points == 0x27) & start[:n])
        if len(quote):
            padded = np.concatenate([points, np.zeros(2, np.uint32)])
            soft = np.concatenate([~hard, np.zeros(2, bool)])
            one, two = padded[quote + 1], padded[quote + 2]
            short = soft[quote + 1] & np.isin(one, [ord(c) for c in "stmd"])
            long = soft[quote + 1] & soft[quote + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            for which, size in ((short, 2), (long, 3)):
                at = quote[which]
                start[at + 1] = False
                start[at + size] = True
        begin = np.flatnonzero(start[:n])
        if place is not None:
            begin = place[begin]
        if len(spans):
            inside = np.searchsorted(spans[:, 0], begin, "left") - 1
            begin = begin[(inside < 0) | (begin >= spans[np.maximum(inside, 0), 1])]
        return np.append(begin, len(raw)), np.searchsorted(begin, offsets)

    def distinct(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a chunk: the number of its distinct pre-token for each pre-token; the first
        pre-token of each document; the bytes of the distinct ones, one after another, and their
        bounds. Pre-tokens are told apart by their bytes."""
        begin, first = self.cut(data, offsets)
        codes, values = coded(binary(data, begin))
        if not len(values):
            return codes, first, data[:0], np.zeros(1, np.int64)
        off = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
        return codes, first, np.frombuffer(values.buffers()[2], np.uint8)[off[0]:off[-1]], off - off[0]
