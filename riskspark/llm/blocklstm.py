"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks: runs of text between block-level tags, each with the
path of its ancestors (tag names, words of class and id). A block's vector joins the mean of
its hashed path vectors, the mean of its hashed word vectors and a few measures (length,
links, punctuation, place). A bidirectional LSTM, in numpy, reads the page's blocks in
order, so every block is labelled with the whole page in view; blocks labelled content, in
page order, are the main text.

The model is trained where it is used, on SAMPLE_PAGES pages at most (a sample by hash, of
pages up to SAMPLE_BYTES): their own blocks, labelled by their landmarks (article or main,
against nav, aside, footer and the like), and pages composed anew from those blocks inside
containers that the wording of CONTENT and NOISE names, with words of NEUTRAL beside it. Training is seeded, so equal pages
give an equal model. Labelling is a scan without a shuffle.

Defined cases: a null, empty or text-free page has empty text; pages are judged each by
itself, so repeated rows, null keys and extra columns of any name change nothing; an empty
table gives an empty result; whole pages are read, long ones too (time grows with length).
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.llm.common import chunked, read

SAMPLE_PAGES, SAMPLE_BYTES = 200, 100_000
PATH_BUCKETS, WORD_BUCKETS = 2048, 1024
PATH_DIM, WORD_DIM, HIDDEN = 24, 6, 16
COMPOSED, EPOCHS, BATCH, RATE = 1200, 12, 30, 0.01

# Elements of the HTML standard by their role here.
RAW = frozenset("script style iframe textarea title".split())                  # their text ends at their own closing tag only
UNSHOWN = frozenset("noscript template svg select annotation annotation-xml".split())     # containers whose text is not shown
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img br input button object canvas audio video source track param
math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd maction semantics""".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl article section div body nav aside main header footer form blockquote".split())
BREAKS_OUT = SCOPES | frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 pre figure address".split())     # cannot stand in svg or select
LANDMARK_CONTENT = frozenset(["article", "main"])
LANDMARK_NOISE = frozenset("nav aside footer header form menu dialog".split())

# Containers that training pages are composed of (element, class or id).
CONTENT = [("article", ""), ("main", ""), ("div", "content"), ("div", "main-content"), ("div", "post-body"), ("div", "entry-content"), ("section", "article-text"), ("div", "story"), ("div", "post"), ("", "")]
NOISE = [("nav", ""), ("nav", "main-nav"), ("div", "main-menu"), ("header", "top"), ("header", ""), ("nav", "menu"), ("div", "menu"), ("div", "navigation"), ("ul", "breadcrumbs"), ("header", ""), ("header", "site-header"), ("div", "header"), ("footer", ""), ("div", "footer"),
         ("div", "copyright"), ("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related-posts"), ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"),
         ("div", "banner"), ("div", "sponsored"), ("div", "promo"), ("div", "cookie-notice"), ("div", "cookie-banner"), ("div", "consent"), ("div", "notice"), ("div", "alert"), ("div", "popup"), ("div", "modal"),
         ("form", ""), ("form", "newsletter"), ("form", "search"), ("div", "subscribe"), ("div", "login"), ("section", "comments"), ("div", "comments"), ("div", "comment"), ("ol", "comment-list"), ("div", "responses"),
         ("div", "share"), ("div", "social"), ("div", "pagination"), ("div", "tags")]
NEUTRAL = "main top left right col row box wrap inner section page site block primary secondary area list item".split()

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Block:
    __slots__ = ("text", "path", "near", "tag", "linked", "label")

    def __init__(self, text: str, path: tuple[str, ...], near: tuple[str, ...], tag: str, linked: int, label: int):
        self.text, self.path, self.near, self.tag, self.linked, self.label = text, path, near, tag, linked, label


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """The element's name and the words of its class, id and role, with their first letters."""
    out = [tag]
    if attributes and "=" in attributes:
        for found in NAMES.findall(attributes):
            for word in PARTS.findall("".join(found)):
                word = word.lower()
                out += ["." + word, "." + word[:5]] if len(word) > 5 else ["." + word]
    return tuple(out)


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order. label: 1 in an article or main element, 0 in a landmark
    of other kinds inside or outside it, or outside all."""
    out: list[Block] = []
    # an open element: tag, names, and what text in it has from it and its ancestors (names of
    # the nearest container, the leaf's tag, the label), so that depth costs nothing
    stack: list[tuple[str, tuple[str, ...], tuple[str, ...], str, int]] = []
    open_at: dict[str, list[int]] = {}                      # where the elements of a tag stand on the stack
    named: dict[str, int] = {}                              # how often a name stands on the stack
    pieces: list[str] = []
    linked, links, at, hidden, outer = 0, 0, 0, 0, 0
    last: dict[str, int] = {}                               # where the last closing tag of an UNSHOWN element stands

    def push(tag: str, names: tuple[str, ...]) -> None:
        nonlocal links, hidden, outer
        _, _, near, leaf, label = stack[-1] if stack else ("", (), (), "", 0)
        if tag not in INLINE:
            leaf = tag
            if tag not in CLOSES and tag[:1] != "h":
                near = names
        if tag in LANDMARK_CONTENT:
            label = 1
        elif tag in LANDMARK_NOISE or ".ad" in names or ".ads" in names:
            label = 0
        for n in names:
            named[n] = named.get(n, 0) + 1
        open_at.setdefault(tag, []).append(len(stack))
        if tag in UNSHOWN:
            outer = len(stack) if not hidden else outer
            hidden += 1
        links += tag == "a"
        stack.append((tag, names, near, leaf, label))

    def pop(to: int) -> None:
        nonlocal links, hidden
        while len(stack) > to:
            t, names = stack.pop()[:2]
            open_at[t].pop()
            for n in names:
                named[n] -= 1
                if not named[n]:
                    del named[n]
            links -= t == "a"
            hidden -= t in UNSHOWN

    def closed_later(tag: str) -> bool:
        if tag not in last:
            last[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}\s*>", page, re.I)), default=-1)
        return at <= last[tag]

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                _, _, near, leaf, label = stack[-1] if stack else ("", (), (), "", 0)
                out.append(Block(text, tuple(named), near, leaf, min(linked, len(text)), label))
            pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            pieces.append(entities.unescape(raw) if "&" in raw else raw)
            if links:
                linked += len(raw)

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            k = open_at[tag][-1] if open_at.get(tag) else -1
            if k >= 0:
                if hidden and k < outer:
                    pop(outer)                              # a parent ends what is hidden in it
                if not hidden and tag not in INLINE:
                    flush()
                pop(k)
            continue
        if tag in RAW and not m[3].endswith("/") and not (hidden and tag == "title"):     # svg's title is no raw text
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "head":                                   # its elements are skipped one by one
            continue
        if hidden and stack[outer][0] in ("svg", "select") and tag in BREAKS_OUT:
            pop(outer)
        if tag in UNSHOWN and not m[3].endswith("/"):
            if closed_later(tag):                           # without a closing tag its text belongs to the page
                push(tag, names_of(tag, m[3]))
            continue
        if hidden:
            if tag not in VOID and not m[3].endswith("/"):
                push(tag, ())
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
        else:
            flush()
        if tag in CLOSES:
            scope = max((open_at[t][-1] for t in SCOPES if open_at.get(t)), default=-1)
            ended = [places[k] for t in CLOSES[tag] if (places := open_at.get(t)) and (k := bisect_right(places, scope)) < len(places)]
            if ended:
                pop(min(ended))
        elif tag not in INLINE and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)                             # a block-level element ends a paragraph
        if tag not in VOID and not m[3].endswith("/"):
            push(tag, names_of(tag, m[3]))
    flush()
    return out


# ---------------------------------------------------------------- features

def bucket(token: str, n: int) -> int:
    return zlib.crc32(token.encode()) % n


_WORDS: dict[str, int] = {}


def word_bucket(word: str) -> int:
    if (found := _WORDS.get(word)) is None:
        if len(_WORDS) > 200_000:
            _WORDS.clear()
        found = _WORDS[word] = bucket(word, WORD_BUCKETS)
    return found


_PATHS: dict[tuple, np.ndarray] = {}


def path_buckets(b: Block) -> np.ndarray:
    key = (b.path, b.near)
    if key not in _PATHS:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        _PATHS[key] = np.array([bucket(t, PATH_BUCKETS) for t in {*b.path, *("near " + t for t in b.near)}] or [0])
    return _PATHS[key]


def measures(b: Block, place: float) -> list[float]:
    n = len(b.text)
    stops = b.text.count(".") + b.text.count("!") + b.text.count("?") + b.text.count(",")
    return [np.log1p(n) / 8, b.linked / n, min(1.0, 20 * stops / n), float(b.tag[:1] == "h" and len(b.tag) == 2), float(b.tag == "p"), place, 1.0]


MEASURES = 7
INPUT = PATH_DIM + WORD_DIM + MEASURES


def encode_blocks(blocks: list[Block]) -> tuple[np.ndarray, ...]:
    """Path buckets and word buckets with their bounds, and measures."""
    paths = [path_buckets(b) for b in blocks]
    words = [[word_bucket(w) for w in b.text.lower().split()] for b in blocks]
    more = [measures(b, k / len(blocks)) for k, b in enumerate(blocks)]
    return (np.concatenate(paths), np.cumsum([0, *map(len, paths)]), np.concatenate([np.array(w, np.int64) for w in words]), np.cumsum([0, *map(len, words)]), np.array(more))


# ---------------------------------------------------------------- the network

def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def means(table: np.ndarray, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[tokens], bounds[:-1], axis=0) / np.diff(bounds)[:, None]


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"path": rng.normal(size=(PATH_BUCKETS, PATH_DIM)) * 0.3, "word": rng.normal(size=(WORD_BUCKETS, WORD_DIM)) * 0.1,
         "out": rng.normal(size=(2 * HIDDEN + INPUT,)) * 0.1, "bias": np.zeros(1)}
    for d in "fb":
        p |= {"w" + d: rng.normal(size=(INPUT, 4 * HIDDEN)) / np.sqrt(INPUT), "u" + d: rng.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN), "c" + d: np.zeros(4 * HIDDEN)}
        p["c" + d][HIDDEN:2 * HIDDEN] = 1
    return p


def run_direction(x: np.ndarray, live: np.ndarray, w: np.ndarray, u: np.ndarray, c: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states of an LSTM along axis 0 of x (time, page, input); pages that have ended
    keep their state at zero."""
    steps, pages, _ = x.shape
    gates = x @ w + c
    h, s = np.zeros((pages, HIDDEN), x.dtype), np.zeros((pages, HIDDEN), x.dtype)
    out, tape = np.zeros((steps, pages, HIDDEN), x.dtype), []
    for t in range(steps):
        z = gates[t] + h @ u
        z[:, :3 * HIDDEN] = sigmoid(z[:, :3 * HIDDEN])
        i, f, o, g = z[:, :HIDDEN], z[:, HIDDEN:2 * HIDDEN], z[:, 2 * HIDDEN:3 * HIDDEN], np.tanh(z[:, 3 * HIDDEN:])
        before, s = s, (f * s + i * g) * live[t]
        squashed = np.tanh(s)
        if keep:
            tape.append((h, before, i, f, o, g, squashed))
        h = o * squashed * live[t]
        out[t] = h
    return out, tape


def back_direction(x: np.ndarray, live: np.ndarray, u: np.ndarray, tape: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of u."""
    steps, pages, _ = x.shape
    dz_all, du = np.zeros((steps, pages, 4 * HIDDEN)), np.zeros_like(u)
    dh, ds = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, g, squashed = tape[t]
        dh = (dh + grad[t]) * live[t]
        ds = (ds + dh * o * (1 - squashed**2)) * live[t]
        dz = np.concatenate([ds * g * i * (1 - i), ds * before * f * (1 - f), dh * squashed * o * (1 - o), ds * i * (1 - g**2)], 1)
        du += h.T @ dz
        dz_all[t] = dz
        dh, ds = dz @ u.T, ds * f
    return dz_all, du


class Labeller:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def inputs(self, pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Input vectors (time, page, input), which are there, and where each block stands."""
        blocks = [b for page in pages for b in page]
        tokens, bounds, words, word_bounds, more = parts = encode_blocks_of(pages, blocks)
        x = np.concatenate([means(self.p["path"], tokens, bounds), means(self.p["word"], words, word_bounds), more], 1)
        size = np.array([len(page) for page in pages])
        t = np.concatenate([np.arange(n) for n in size])
        page = np.repeat(np.arange(len(pages)), size)
        full = np.zeros((size.max(), len(pages), INPUT), x.dtype)
        full[t, page] = x
        live = np.zeros((size.max(), len(pages), 1), x.dtype)
        live[t, page] = 1
        return full, live, t, page, parts

    def forward(self, x: np.ndarray, live: np.ndarray, keep: bool = False) -> tuple:
        p = self.p
        f, tape_f = run_direction(x, live, p["wf"], p["uf"], p["cf"], keep)
        b, tape_b = run_direction(x[::-1], live[::-1], p["wb"], p["ub"], p["cb"], keep)
        joined = np.concatenate([f, b[::-1], x], 2)
        return joined @ p["out"] + p["bias"], joined, tape_f, tape_b

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page which of its blocks are content. Pages of like length go together."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, page in enumerate(pages) if page), key=lambda i: len(pages[i]))
        for k in range(0, len(order), 128):
            some = order[k:k + 128]
            x, live, t, page, _ = self.inputs([pages[i] for i in some])
            score = self.forward(x, live)[0]
            for j, i in enumerate(some):
                out[i] = score[:len(pages[i]), j] > 0
        return out

    def gradients(self, pages: list[list[Block]]) -> tuple[float, dict[str, np.ndarray]]:
        p = self.p
        x, live, t, page, (tokens, bounds, words, word_bounds, _) = self.inputs(pages)
        score, joined, tape_f, tape_b = self.forward(x, live, True)
        want = np.zeros(score.shape)
        want[t, page] = [b.label for pg in pages for b in pg]
        guess = sigmoid(score)
        loss = -(live[..., 0] * (want * np.log(guess + 1e-9) + (1 - want) * np.log(1 - guess + 1e-9))).sum() / len(t)
        d = (guess - want) * live[..., 0] / len(t)
        g = {"out": np.einsum("tp,tpi->i", d, joined), "bias": d.sum(keepdims=True)[0]}
        dj = d[..., None] * p["out"]
        zf, g["uf"] = back_direction(x, live, p["uf"], tape_f, dj[..., :HIDDEN])
        zb, g["ub"] = back_direction(x[::-1], live[::-1], p["ub"], tape_b, dj[::-1, :, HIDDEN:2 * HIDDEN])
        zb = zb[::-1]
        g["wf"], g["wb"] = np.einsum("tpi,tpg->ig", x, zf), np.einsum("tpi,tpg->ig", x, zb)
        g["cf"], g["cb"] = zf.sum((0, 1)), zb.sum((0, 1))
        dx = (dj[..., 2 * HIDDEN:] + zf @ p["wf"].T + zb @ p["wb"].T)[t, page]
        for name, tok, bound, a, b in (("path", tokens, bounds, 0, PATH_DIM), ("word", words, word_bounds, PATH_DIM, PATH_DIM + WORD_DIM)):
            n = np.diff(bound)
            g[name] = np.zeros_like(p[name])
            np.add.at(g[name], tok, np.repeat(dx[:, a:b] / n[:, None], n, axis=0))
        return loss, g


def encode_blocks_of(pages: list[list[Block]], blocks: list[Block]) -> tuple[np.ndarray, ...]:
    parts = encode_blocks(blocks)
    parts[4][:, 5] = np.concatenate([np.arange(len(page)) / max(1, len(page) - 1) for page in pages])
    return parts


# ---------------------------------------------------------------- training

def compose(rng: np.random.Generator, content: list[str], noise: list[str]) -> list[Block]:
    """Blocks of a page built from texts inside named containers."""
    def some(pool: list[str]) -> str:
        return entities.escape(pool[rng.integers(len(pool))])

    def wrap(container: tuple[str, str], inner: str) -> str:
        tag, name = container
        if not tag:
            return inner
        if rng.random() < 0.4:                               # words that tell nothing, before or behind
            word = NEUTRAL[rng.integers(len(NEUTRAL))]
            name = f"{word}-{name}".strip("-") if rng.random() < 0.5 else f"{name} {word}".strip()
        attribute = f' {"id" if rng.random() < 0.3 else "class"}="{name}"' if name else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def zone() -> str:
        pool = noise if rng.random() < 0.5 else content      # the wording alone must not decide
        form = rng.integers(4)
        n = int(rng.integers(1, 6))
        if form == 0:
            inner = "<ul>" + "".join(f'<li><a href="#">{some(noise)}</a></li>' for _ in range(n)) + "</ul>"
        elif form == 1:
            inner = "".join(f"<p>{some(pool)}</p>" for _ in range(n))
        elif form == 2:
            inner = f"<h3>{some(noise)}</h3>" + "".join(f"<div><p>{some(pool)}</p></div>" for _ in range(n))
        else:
            inner = some(pool)
        return '<div class="zzn">' + wrap(NOISE[rng.integers(len(NOISE))], inner) + "</div>"

    def text() -> str:
        return ["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<div>{}</div>", "<p><b>{}<br>"][rng.integers(8)].replace("{}", "\0").replace("\0", some(content), 1).replace("\0", some(content))

    body = [f"<h1>{some(content)}</h1>"] * (rng.random() < 0.8) + [text() for _ in range(int(rng.integers(1, 12)))]
    for _ in range(int(rng.integers(0, 3))):
        body.insert(int(rng.integers(1, len(body) + 1)), zone())
    page = "".join(zone() for _ in range(int(rng.integers(0, 4)))) + wrap(CONTENT[rng.integers(len(CONTENT))], "".join(body)) + "".join(zone() for _ in range(int(rng.integers(0, 4))))
    if rng.random() < 0.5:
        page = wrap(("div", ["page", "wrapper", "container", "site"][rng.integers(4)]), page)
    out = blocks_of("<html><body>" + page + "</body></html>")
    for b in out:                                              # the composer's own mark gives the label and then goes
        b.label = int(".zzn" not in b.path)
        b.path = tuple(n for n in b.path if n != ".zzn")
        b.near = tuple(n for n in b.near if n != ".zzn")
    return out


def fit(pages: list[str], seed: int = 5) -> dict[str, np.ndarray]:
    """Trains on sample pages and pages composed from them."""
    rng = np.random.default_rng(seed)
    real = [b for b in map(blocks_of, pages) if b]
    content = [b.text for page in real for b in page if b.label][:5000] or ["lorem ipsum dolor sit amet, consectetur adipiscing elit."]
    noise = [b.text for page in real for b in page if not b.label][:5000] or ["home", "contact"]
    marked = [page[:120] for page in real if any(b.label for b in page)]
    train = marked * (1 + 200 // max(1, len(marked))) if marked else []
    train = train[:400] + [page for _ in range(COMPOSED) if (page := compose(rng, content, noise)[:120])]
    net = Labeller(initial(rng))
    first, second, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(train))
        order = order[np.argsort([len(train[i]) + 4 * rng.random() for i in order], kind="stable")]     # pages of like length together
        batches = [order[k:k + BATCH] for k in range(0, len(order), BATCH)]
        for k in rng.permutation(len(batches)):
            _, g = net.gradients([train[i] for i in batches[k]])
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for name, d in g.items():                          # Adam
                first[name] += 0.1 * (d - first[name])
                second[name] += 0.01 * (d * d - second[name])
                net.p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in net.p.items()}


def train(pages: DataFrame, html_col: str = "html") -> dict[str, np.ndarray]:
    """A model from a bounded sample of ``pages``."""
    fit_for = pages.select(html_col, F.xxhash64(html_col).alias("_hash")).filter(F.octet_length(html_col).between(1, SAMPLE_BYTES))
    rows = fit_for.count()
    if rows > SAMPLE_PAGES:
        fit_for = fit_for.filter(F.pmod("_hash", F.lit(1 << 30)) < int(2 * SAMPLE_PAGES / rows * (1 << 30)))
    sample = fit_for.orderBy("_hash", html_col).limit(SAMPLE_PAGES).collect()
    return fit([r[html_col] for r in sample])


# ---------------------------------------------------------------- Spark job

def extract(pages: DataFrame, model: dict[str, np.ndarray], html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without html_col, with its main text and n_chars."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    held = pages.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in pages.schema.fields if f.name != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller(held.value)
        for rb in chunked(batches, html_col):
            pages_of = [blocks_of(h) if h else [] for h in rb.column(html_col).to_pylist()]
            texts = ["\n\n".join(b.text for b, good in zip(page, keep) if good) for page, keep in zip(pages_of, net.label(pages_of))]
            yield pa.RecordBatch.from_arrays([*(rb.column(f.name) for f in fields), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in fields), text_col, "n_chars"])

    return pages.mapInArrow(run, StructType([*fields, StructField(text_col, StringType()), StructField("n_chars", LongType())]))


def op2_recurrent_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of pages."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages))
