"""Main text of HTML pages by a recurrent block labeller.

A page is cut into its leaf blocks: the runs of text between the starts and ends of block
elements, each with the path of open elements above it. A bidirectional LSTM in numpy reads
the blocks of a page as one sequence - a block is the sum of learned vectors of its path's
tags, classes and ids, hashed word vectors of its text and a few counts - and says of each
whether it belongs to the article, so a block is judged by what stands anywhere before and
behind it. The kept blocks, in page order, are the text.

No table holds labels of blocks, so the network learns from weak ones: blocks of a bounded
sample of the pages, labelled by their elements' names where those tell (``MARKS``), as they
stand and set anew into made-up page frames with other names, places and missing marks.
Labels only teach; at work the network alone decides, also where a path says nothing.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_batches, table, text_or_empty
from .tokens import pieces_of

# --- blocks ----------------------------------------------------------------------------

#: Elements by their role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html"
    " iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp svg math template".split())
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
KEEPS_P = frozenset("body html head caption dd dt li option td th tr tbody tfoot thead title optgroup legend".split())
SCOPES = frozenset("table ul ol dl select menu td th".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)
WORDS_OF = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


@lru_cache(maxsize=50_000)
def _names(attributes: str) -> tuple[str, ...]:
    """The words of an element's class, id and role."""
    found = (w.lower() for value in NAMES.findall(attributes) for w in WORDS_OF.findall(value))
    return tuple(dict.fromkeys(f".{w}" for w in found))


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks with text of a whole page, in order. One pass; what is not closed ends with the page."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    path: tuple[str, ...] = ()
    links, balanced, at, end = 0, True, 0, len(page)

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(path, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def said(raw: str):
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    def opened():
        nonlocal path
        path = tuple(dict.fromkeys(x for tag, names in stack for x in (tag, *names)))

    def popped(depth: int):
        nonlocal links
        links -= sum(tag == "a" for tag, _ in stack[depth:])
        del stack[depth:]
        opened()

    def close(tags: tuple[str, ...], within: frozenset[str]):
        """Pop to the innermost of ``tags``, if no element of ``within`` is open inside it."""
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in tags:
                popped(depth)
                return
            if stack[depth][0] in within:
                return

    while at < end:
        start = page.find("<", at)
        if start < 0:
            said(page[at:])
            break
        said(page[at:start])
        after = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        if after in ("!", "?"):
            stop = page.find(">", start)
            at = end if stop < 0 else stop + 1
            continue
        closing = after == "/"
        if not page[start + 1 + closing : start + 2 + closing].isalpha():
            if closing and after:  # a bogus comment
                stop = page.find(">", start)
                at = end if stop < 0 else stop + 1
            else:
                said("<")
                at = start + 1
            continue
        found = TAG.match(page, start) if balanced else None
        if found:
            name, attributes, at = found[2].lower(), found[3], found.end()
        else:  # a quote that is never closed: from here on a tag ends at the next sign
            balanced = False
            stop = page.find(">", start)
            if stop < 0:
                break
            inside = page[start + 1 + closing : stop].split(None, 1)
            name, attributes, at = inside[0].rstrip("/").lower(), inside[1] if len(inside) > 1 else "", stop + 1
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None or name == "p":
                if name in BLOCKS:
                    flush()
                if depth is not None:
                    popped(depth)
            continue
        if name in RAW:
            if name in BLOCKS:
                flush()
            stop = _end_of(name).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in VOID:
            if name == "hr":
                flush()
                close(("p",), SCOPES)
            elif name in ("br", "wbr"):
                parts.append(" " if name == "br" else "")
            continue
        if name in BLOCKS:
            flush()
            if name in CLOSES:
                close(CLOSES[name], SCOPES - {"td", "th"} if name in ("td", "th", "tr") else SCOPES)
            if name not in KEEPS_P:
                close(("p",), SCOPES)
            if re.fullmatch("h[1-6]", name) and stack and re.fullmatch("h[1-6]", stack[-1][0]):
                popped(len(stack) - 1)
        if not attributes.endswith("/") or name in BLOCKS or name == "a":
            links += name == "a"
            stack.append((name, _names(attributes) if attributes else ()))
            if name in BLOCKS or name in ("button", "label", "noscript"):
                opened()
    flush()
    return out


@lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?", re.I)


# --- features --------------------------------------------------------------------------

PATH_ROWS, PATH_DIM = 4096, 24
WORD_ROWS, WORD_DIM = 1 << 15, 16
COUNTS = 8
DIM = PATH_DIM + WORD_DIM + COUNTS


@lru_cache(maxsize=1)
def word_vectors() -> np.ndarray:
    """Hashed word vectors, the same on every machine."""
    return np.random.default_rng(3).choice(np.array([-1, 0, 0, 1], np.float32), (WORD_ROWS, WORD_DIM))


@lru_cache(maxsize=100_000)
def _word(word: str) -> int:
    return crc32(word.lower().encode()) % WORD_ROWS


@lru_cache(maxsize=50_000)
def path_rows(path: tuple[str, ...]) -> np.ndarray:
    """The rows of the learned vectors of a path: every name in it, and its last element by itself."""
    last = next((x for x in reversed(path) if x[0] != "."), "")
    return np.array(sorted({crc32(x.encode()) % PATH_ROWS for x in (*path, f"/{last}")}), np.int64)


def text_features(block: Block) -> np.ndarray:
    words = block.text.split(" ")
    out = np.zeros(WORD_DIM + COUNTS, np.float32)
    ids = np.fromiter(map(_word, words), np.int64, len(words))
    total = np.zeros(WORD_DIM)
    for at in range(0, len(ids), 1 << 16):  # a very long block needs no more memory than a part of it
        total += word_vectors()[ids[at : at + (1 << 16)]].sum(0)
    out[:WORD_DIM] = 2 * total / max(1.0, float(np.sqrt(total @ total)))  # of one length, also where one word is repeated
    n, text = len(block.text), block.text
    out[WORD_DIM:] = (
        min(1.5, np.log1p(len(words)) / 4), min(1.5, np.log1p(n) / 6), block.linked / n, min(1.0, sum(map(text.count, ".!?")) / len(words)),
        min(1.0, sum(map(text.count, ",;:")) / len(words)), float(text[-1] in ".!?"), float(text[:1].isupper()), float("©" in text or "·" in text),
    )
    return out


# --- the network -----------------------------------------------------------------------


@dataclass
class Labeller:
    """A bidirectional LSTM; ``params`` are path vectors, two directions' (input, state, bias), and the
    output layer, which reads both directions' states and the block itself."""

    params: list[np.ndarray]
    hidden: int

    def inputs(self, paths: list[np.ndarray], texts: np.ndarray) -> np.ndarray:
        """(blocks, DIM): path vectors are summed, then set beside the text's features."""
        out = np.empty((len(paths), DIM), np.float32)
        sizes = np.fromiter(map(len, paths), np.int64, len(paths))
        if len(paths):
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            out[:, :PATH_DIM] = np.add.reduceat(self.params[0][np.concatenate(paths)], starts, axis=0)
        out[:, PATH_DIM:] = texts
        return out

    def logits(self, pages: list[tuple[list[np.ndarray], np.ndarray]]) -> list[np.ndarray]:
        """A number for each block of each page. Pages of like length run side by side."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k][0])), key=lambda k: len(pages[k][0]))
        while order:
            longest = len(pages[order[-1]][0])
            some = [order.pop() for _ in range(min(len(order), max(1, 16_384 // longest)))]
            for k, z in zip(some, self._run([pages[k] for k in some])):
                out[k] = z
        return out

    def _run(self, pages) -> list[np.ndarray]:
        sizes = [len(p) for p, _ in pages]
        both = [np.zeros((len(pages), max(sizes), self.hidden), np.float32) for _ in range(2)]
        out, bias = self.params[7], self.params[8][0]
        own = np.zeros((len(pages), max(sizes)), np.float32)
        for way in range(2):
            w, u, b = self.params[1 + 3 * way : 4 + 3 * way]
            h, c = np.zeros((len(pages), self.hidden), np.float32), np.zeros((len(pages), self.hidden), np.float32)
            for at in range(0, max(sizes), 1024):  # inputs of a long page are made part by part
                stop = min(at + 1024, max(sizes))
                x = np.zeros((len(pages), stop - at, DIM), np.float32)
                for k, (paths, texts) in enumerate(pages):
                    n = sizes[k]
                    if at < n:
                        lo, hi = (at, min(stop, n)) if not way else (n - min(stop, n), n - at)
                        part = self.inputs(paths[lo:hi], texts[lo:hi])
                        x[k, : hi - lo] = part[::-1] if way else part
                if not way:
                    own[:, at:stop] = x @ out[2 * self.hidden :]
                x = x @ w + b
                for t in range(at, stop):
                    h, c, _ = cell(x[:, t - at] + h @ u, c)
                    both[way][:, t] = h
        n = self.hidden
        return [both[0][k, :m] @ out[:n] + both[1][k, :m][::-1] @ out[n : 2 * n] + own[k, :m] + bias for k, m in enumerate(sizes)]


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def cell(z: np.ndarray, c: np.ndarray):
    """One step: gates in, forget, out and candidate from ``z``; the new state, the new memory and what the way back needs."""
    n = c.shape[1]
    gates = squash(z[:, : 3 * n])
    i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
    new = f * c + i * g
    flat = np.tanh(new)
    return o * flat, new, (i, f, o, g, c, flat)


def train(pages: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]], *, hidden: int = 24, epochs: int = 14, batch: int = 32, seed: int = 17) -> Labeller:
    """Fit on (path rows, text features, labels) of pages; a label of -1 does not count.

    Adam on the mean log loss of the labelled blocks, through time in both directions; the
    result is the mean of the parameters over the second half of the steps. Names
    of paths, and texts of blocks, are left out at random, so that either and the surroundings must tell as well.
    """
    rng = np.random.default_rng(seed)

    def made(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    params = [made(PATH_ROWS, PATH_DIM, scale=0.3)]
    for _ in range(2):
        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden : 2 * hidden] = 1
        params += [made(DIM, 4 * hidden, scale=DIM**-0.5), made(hidden, 4 * hidden, scale=hidden**-0.5), bias]
    params += [made(2 * hidden + DIM, scale=(2 * hidden + DIM) ** -0.5), np.zeros(1, np.float32)]
    net = Labeller(params, hidden)
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    pages = [p for p in pages if len(p[0])]
    mean, seen = [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        turn = sorted(rng.permutation(len(pages)), key=lambda k: len(pages[k][0]) + rng.integers(0, 6))
        parts = [turn[at : at + batch] for at in range(0, len(turn), batch)]
        for k in rng.permutation(len(parts)):
            step += 1
            grads = gradients(net, [pages[j] for j in parts[k]], rng)
            rate = 0.008 * (1 - epoch / epochs) + 0.0005
            for j, g in enumerate(grads):
                np.clip(g, -1, 1, out=g)
                first[j] += 0.1 * (g - first[j])
                second[j] += 0.001 * (g * g - second[j])
                params[j] -= rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
            if epoch >= epochs // 2:
                seen += 1
                for total, p in zip(mean, params):
                    total += (p - total) / seen
    return Labeller(mean, hidden)


def gradients(net: Labeller, pages, rng: np.random.Generator | None = None) -> list[np.ndarray]:
    """The loss's gradient by every parameter, back through both directions."""
    hidden, sizes = net.hidden, [len(p[0]) for p in pages]
    longest, many = max(sizes), len(pages)
    x, y = np.zeros((many, longest, DIM), np.float32), np.full((many, longest), -1, np.int64)
    used = []
    for k, (paths, texts, labels) in enumerate(pages):
        if rng is not None and rng.random() < 0.4:
            paths = [p[keep] if (keep := rng.random(len(p)) < 0.75).any() else p[:1] for p in paths]
        used.append(paths)
        if rng is not None and rng.random() < 0.4:
            texts = texts * (rng.random((len(texts), 1)) < 0.6)
        x[k, : sizes[k]], y[k, : sizes[k]] = net.inputs(paths, texts), labels
    states, kept = [], []
    turned = np.zeros((many, longest), np.int64)
    for k, n in enumerate(sizes):
        turned[k] = np.concatenate([np.arange(n)[::-1], np.arange(n, longest)])
    rows = np.arange(many)[:, None]
    for way in range(2):
        w, u, b = net.params[1 + 3 * way : 4 + 3 * way]
        z = (x[rows, turned] if way else x) @ w + b
        h, c, hs, back = np.zeros((many, hidden), np.float32), np.zeros((many, hidden), np.float32), [], []
        for t in range(longest):
            before = h
            h, c, cache = cell(z[:, t] + h @ u, c)
            hs.append(h)
            back.append((before, cache))
        hs = np.stack(hs, 1)
        states.append(hs[rows, turned] if way else hs)
        kept.append(back)
    both = np.concatenate([*states, x], 2)
    told = y >= 0
    d = np.where(told, squash(both @ net.params[7] + net.params[8][0]) - y, 0).astype(np.float32) / max(1, told.sum())
    grads = [np.zeros_like(p) for p in net.params]
    grads[7], grads[8] = np.einsum("ktj,kt->j", both, d), np.array([d.sum()], np.float32)
    dx = d[:, :, None] * net.params[7][2 * hidden :]
    for way in range(2):
        w, u, _ = net.params[1 + 3 * way : 4 + 3 * way]
        up = d[:, :, None] * net.params[7][way * hidden : (way + 1) * hidden]
        up = up[rows, turned] if way else up
        dz_all = np.zeros((many, longest, 4 * hidden), np.float32)
        dh, dc = np.zeros((many, hidden), np.float32), np.zeros((many, hidden), np.float32)
        for t in range(longest - 1, -1, -1):
            before, (i, f, o, g, c, flat) = kept[way][t]
            dh = dh + up[:, t]
            dc = dc + dh * o * (1 - flat * flat)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * flat * o * (1 - o), dc * i * (1 - g * g)], 1)
            dz_all[:, t] = dz
            grads[2 + 3 * way] += before.T @ dz
            dh, dc = dz @ u.T, dc * f
        seen = x[rows, turned] if way else x
        grads[1 + 3 * way] += np.einsum("ktd,ktj->dj", seen, dz_all, optimize=True)
        grads[3 + 3 * way] += dz_all.sum((0, 1))
        part = dz_all @ w.T
        dx += part[rows, turned] if way else part
    for k, paths in enumerate(used):
        sizes_k = [len(p) for p in paths]
        np.add.at(grads[0], np.concatenate(paths), np.repeat(dx[k, : len(paths), :PATH_DIM], sizes_k, axis=0))
    return grads


# --- weak labels and made-up frames ----------------------------------------------------

#: Names of elements, classes and ids that tell a block's part in a page.
MARKS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc pager pagination",
    "head": "header masthead topbar logo branding",
    "foot": "footer copyright colophon imprint legal",
    "side": "aside sidebar widget related recommended trending popular",
    "note": "notice cookie cookies consent gdpr banner alert popup modal dialog",
    "advert": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion",
    "form": "form fieldset select option button label search newsletter subscribe signup login",
    "comment": "comment comments discussion reply replies disqus respond",
    "share": "share sharing social follow tags",
}
AGAINST = {name for names in MARKS.values() for name in names.split()}
FOR = set("article main content post entry story body text prose".split())


def weak_label(path: tuple[str, ...]) -> int:
    """1 article, 0 not, -1 untold. Whatever stands in a marked part is not the article."""
    names = [x.removeprefix(".") for x in path]
    if any(x in AGAINST for x in names):
        return 0
    return 1 if any(x in FOR and (x != "body" or f".{x}" in path) and (x != "text" or f".{x}" in path) for x in names) else -1


def frames(texts: dict[int, list[np.ndarray]], rng: np.random.Generator, count: int) -> list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """``count`` made-up pages: the texts of sampled blocks in random frames. ``texts``: features by label."""
    if not texts[1]:
        texts = {**texts, 1: texts[0]}
    if not texts[0]:
        texts = {**texts, 0: texts[1]}
    links = [t for t in texts[0] if t[WORD_DIM + 2] > 0.5] or texts[0]
    wide = [t for t in texts[0] if t[WORD_DIM + 2] <= 0.5] or texts[0]
    leaves = {"menu": (("ul", "li", "a"), ("a",), ("div", "a")), "head": (("h1",), ("div",), ("p",), ("a",)), "foot": ((), ("p",), ("div",), ("ul", "li", "a")), "side": (("h3",), ("p",), ("ul", "li", "a"), ("div",)), "note": ((), ("p",), ("div",), ("button",)), "advert": ((), ("p",), ("div",), ("a",)), "form": (("label",), ("p",), ("button",), ("option",)), "comment": (("p",), ("div", "p"), ("li", "p"), ("div", ".author"), ("h3",)), "share": (("a",), ("ul", "li", "a"), ("span",))}
    elements = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}
    homes = [("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".main", ".content"), ("section", ".post"), ("div", ".entry", ".content"), ("div", ".article", ".body"), ("div", ".story"), ("div",), ("section",), ("td",), ("div", ".text")]
    body = [("p",), ("p",), ("p",), ("p",), ("p",), ("h2",), ("h3",), ("ul", "li"), ("blockquote", "p"), ("pre",), ("div",), ("figure", "figcaption"), ("table", "tbody", "tr", "td"), ("section", "p"), ("ol", "li"), ("p", "a"), ("dl", "dd")]

    def one(pool):
        return pool[int(rng.integers(len(pool)))]

    def place(kind: str, inside: tuple[str, ...]) -> list:
        names, top = MARKS[kind].split(), elements.get(kind)
        outer = ((top,) if top and rng.random() < 0.6 else (one(("div", "section", "ul", "p", "aside")), f".{one(names)}", *([f".{one(names)}"] if rng.random() < 0.3 else [])))
        pool = links if kind in ("menu", "share") and rng.random() < 0.8 else wide
        if rng.random() < (0.6 if kind in ("comment", "side", "head") else 0.2):
            pool = texts[1]  # reads like an article, stands elsewhere
        style = one(leaves[kind])
        many = 1 if rng.random() < 0.3 else int(rng.integers(1, 7))
        return [((*inside, *outer, *(style if rng.random() < 0.8 else one(leaves[kind]))), one(pool), 0) for _ in range(many)]

    out = []
    for _ in range(count):
        root = ("html", "body", *([("div",), ("div", ".wrapper"), ("div", ".page"), ("div", ".container"), ()][int(rng.integers(5))]))
        home = (*root, *one(homes))
        rows = [r for kind in ("head", "menu", "note", "advert", "side", "form") if rng.random() < 0.45 for r in place(kind, root)]
        main = [((*home, "h1"), one(texts[1]), 1)] if rng.random() < 0.85 else []
        main += [((*home, *one(body)), one(wide if rng.random() < 0.25 else texts[1]), 1) for _ in range(int(rng.integers(1, 16)))]  # some as short as notes are
        for kind in ("advert", "share", "note", "menu", "form", "side"):
            if rng.random() < 0.25:
                at = int(rng.integers(0, len(main) + 1))
                main[at:at] = place(kind, home)
        if rng.random() < 0.2:
            main += place("comment", home)
        rows += main + [r for kind in ("share", "comment", "side", "form", "advert", "menu", "note", "foot") if rng.random() < 0.4 for r in place(kind, root)]
        out.append(([path_rows(tuple(dict.fromkeys(p))) for p, _, _ in rows], np.array([t for _, t, _ in rows], np.float32), np.array([y for _, _, y in rows], np.int64)))
    return out


# --- on Spark --------------------------------------------------------------------------

#: Blocks of one sampled page that training reads, at most.
SAMPLE_BLOCKS = 64


def fit(pages: DataFrame, *, key: str = "page_id", sample: int = 400, made: int = 1200) -> Labeller | None:
    """Fit on up to ``sample`` pages, the first by hash of their key, and ``made`` frames of their blocks.

    Of a sampled page a run of ``SAMPLE_BLOCKS`` blocks counts, as numbers of a fixed size, so
    that what reaches the driver is bounded whatever the pages. None if no page has any block.
    """
    some = pages.select(F.xxhash64(F.lit("sample"), F.col(key)).alias("h"), text_or_empty("html").alias("html"))
    # the hash of the last page of the sample; ties beyond it are cut by the limit below
    edge = some.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if edge is None:
        return None

    def told(batches):
        for batch in pieces_of(batches):
            rows = []
            for h, page in zip(*(c.to_pylist() for c in batch.columns)):
                found = blocks_of(page)
                start = h % max(1, len(found) - SAMPLE_BLOCKS + 1)
                found = found[start : start + SAMPLE_BLOCKS]
                rows.append((h, [path_rows(b.path).astype(np.int32).tobytes() for b in found], [text_features(b).tobytes() for b in found], [weak_label(b.path) for b in found]))
            kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["h", "paths", "texts", "labels"])

    rows = some.filter(F.col("h") <= edge).mapInArrow(told, "h long, paths array<binary>, texts array<binary>, labels array<int>")
    rows = rows.orderBy("h", "texts", "paths").limit(sample).collect()  # ``sample`` rows of bounded size
    real, texts = [], {0: [], 1: []}
    for r in rows:
        if r["paths"]:
            features = np.array([np.frombuffer(t, np.float32) for t in r["texts"]])
            real.append(([np.frombuffer(p, np.int32).astype(np.int64) for p in r["paths"]], features, np.array(r["labels"], np.int64)))
            for f, y in zip(features, r["labels"]):
                texts[max(y, 0)].append(f)
    if not real:
        return None
    return train(real + frames(texts, np.random.default_rng(29), made))


def extract(pages: DataFrame, *, key: str = "page_id", sample: int = 400) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, and ``n_chars``, its code points.

    Null and empty html give the empty text, as does a page without any article. Pages of any
    length are read whole; equal pages get equal texts, null keys count like any other,
    repeated rows stay; no rows give no rows. Columns ``text`` and ``n_chars`` are replaced.
    """
    pages = pages.drop("text", "n_chars")
    net = fit(pages, key=key, sample=sample)
    model = pages.sparkSession.sparkContext.broadcast(net)  # of a fixed size
    names = pages.columns
    at = names.index("html")
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in pieces_of(batches):
            found = [blocks_of(page or "") for page in batch.column(at).cast(pa.string()).to_pylist()]
            read = [([path_rows(b.path) for b in bs], np.array([text_features(b) for b in bs], np.float32)) for bs in found]
            marks = model.value.logits(read) if model.value else [()] * len(found)
            texts = ["\n\n".join(b.text for b, z in zip(bs, zs) if z > 0) for bs, zs in zip(found, marks)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    return pages.mapInArrow(run, schema)


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    bounded_batches(spark)
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op12_html_text": op12_html_text}
ORACLE_SQL: dict[str, str] = {}
