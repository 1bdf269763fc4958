"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text with no block element's edge inside. Each block is described by its tag path
(names, words of class, id and role of every open element, hashed to learned vectors), its words (hashed to learned
vectors, averaged) and a few numbers. A bidirectional LSTM in numpy reads the whole page's sequence and labels every block
with what stands before and after it in view; blocks labelled as main text are the result.

The model is trained here, on pages made by a seeded generator: many layouts of articles among menus, headers, footers, sidebars,
notices, adverts, forms and reader comments (also threads without names), and pages that are nothing but their text, with invented
words, so that it learns structure and not a vocabulary. Its
weights are in ``block_labeller.npz``, written by ``python -m eventloom.llm.htmltext``; without that file the model is
trained on the first call. It is sent to the tasks as a broadcast of a fixed size.

Scripts, styles, comments and the content of drawings and players aren't text. Character references are decoded, white space
inside a block (line breaks among it) becomes one space. Null and empty pages give an empty text; broken markup is read as far
as it goes, an unclosed script, style, title, textarea or comment to the page's end, while of an unclosed or self-closed
drawing or player only the tag is left out. Custom elements (title-bar) are elements like any other. Nothing is cut: a page of any
number of blocks is labelled whole. Reading takes time and memory in proportion to the page, whatever stands in it. Repeated
rows give a row each, an empty table gives none.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATHS, WORDS, PATH_WIDTH, WORD_WIDTH, NUMBERS, HIDDEN = 1024, 512, 24, 8, 6, 24
PAGES, EPOCHS, BATCH, STEPS, SEED = 8000, 6, 48, 150, 11

#: Fixed element names: those whose edges end a block, those without content, those whose content isn't markup, those whose
#: content isn't text, and those that a new element of the same kind closes.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = "script style title textarea".split()
SKIPPED_TAGS = frozenset("template svg iframe canvas audio video".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK_TAGS - frozenset("body button caption head html label legend option optgroup select summary tbody td tfoot th thead tr".split())

#: What ends the search for a new li, td, ... for open ones that it closes.
BOUNDARY = frozenset("ul ol dl table select tr tbody thead".split())
ROW_BOUNDARY = frozenset("table tbody thead".split())

_NAME = re.compile(r"(/?)([a-zA-Z][\w:-]*)")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW_TAGS}
_ATTR = re.compile(r"\b(class|id|role|style|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Token(NamedTuple):
    """A piece of markup; without a tag it is only left out."""

    start: int
    stop: int
    tag: str = ""
    end: bool = False
    attrs: str = ""


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Places of quotes and > in the page, and for each the end of a tag whose attributes go on there (-1: it has none).

    A quote in a tag runs to the next one like it. Read from the page's end on, each place is looked at once."""
    marks = [m.start() for m in re.finditer("[\"'>]", page)]
    ends, following = [-1] * (len(marks) + 1), {'"': -1, "'": -1}
    for k in range(len(marks) - 1, -1, -1):
        mark = page[marks[k]]
        if mark == ">":
            ends[k] = marks[k]
        else:
            ends[k] = ends[following[mark] + 1] if following[mark] >= 0 else -1
            following[mark] = k
    return marks, ends


def tokens_of(page: str) -> list[Token]:
    """Tags, comments, declarations and raw elements of a page in order. A < that begins nothing is text."""
    out: list[Token] = []
    marks, ends = _tag_ends(page)
    last = page.rfind(">")
    at = page.find("<")
    while at >= 0:
        stop = -1
        head = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            stop = close + 3 if close >= 0 else len(page)
            out.append(Token(at, stop))
        elif head in ("!", "?"):
            if at < last:
                stop = page.find(">", at) + 1
                out.append(Token(at, stop))
        elif head and at < last and (name := _NAME.match(page, at + 1)):
            end = ends[bisect_left(marks, name.end())]
            if end >= 0:
                tag, attrs = name[2].lower(), page[name.end() : end]
                stop = end + 1
                if tag in _RAW_END and not name[1] and (not attrs or attrs[0].isspace() or attrs[0] == "/"):
                    close = _RAW_END[tag].search(page, stop)
                    stop = page.find(">", close.end()) + 1 if close else 0
                    stop = stop or len(page)
                    out.append(Token(at, stop))
                else:
                    out.append(Token(at, stop, tag, bool(name[1]), attrs))
        at = page.find("<", stop if stop >= 0 else at + 1)
    return out


def _words_of(tag: str, attrs: str) -> list[str]:
    """What a path says of an element."""
    out = [tag]
    if attrs:
        for key, value in _ATTR.findall(attrs):
            key = key.lower()
            if key == "hidden" or key == "style" and "none" in value:
                out.append("=hidden")
            elif key != "style":
                out += ["=" + part.lower() for part in _PART.findall(value)]
    return out


def _skipped(tokens: list[Token]) -> dict[int, int]:
    """Start tags of closed elements whose content isn't text, each with its end tag, by their places among the tokens."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for k, token in enumerate(tokens):
        if token.tag not in SKIPPED_TAGS:
            continue
        if not token.end:
            if not token.attrs.endswith("/"):
                open_.setdefault(token.tag, []).append(k)
        elif open_.get(token.tag):
            out[open_[token.tag].pop()] = k
    return out


class TagPath(NamedTuple):
    """A tag path: hashed words of all open elements as the bits of a number, and how many words there are."""

    codes: int
    n_words: int


class Block(NamedTuple):
    """A leaf block; ``linked`` of its characters are in links."""

    path: TagPath
    text: str
    linked: int


class _Open:
    """The open elements, each with its path, and where each kind of them stands."""

    def __init__(self):
        self.tags: list[str] = []
        self.paths: list[TagPath] = [TagPath(0, 0)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.block_places: list[int] = []

    def push(self, tag: str, attrs: str) -> None:
        codes, n_words = _element_codes(tag, attrs)
        own = self.paths[-1]
        self.paths.append(TagPath(own.codes | codes, own.n_words + n_words))
        self.places[tag].append(len(self.tags))
        if tag in BLOCK_TAGS:
            self.block_places.append(len(self.tags))
        self.tags.append(tag)

    def cut(self, depth: int) -> None:
        """Close the element at this depth and all inside it."""
        while len(self.tags) > depth:
            tag = self.tags.pop()
            self.places[tag].pop()
            self.paths.pop()
            if tag in BLOCK_TAGS:
                self.block_places.pop()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def first_after(self, tags, depth: int) -> int:
        """The outermost of such elements that is inside the one at this depth, or -1."""
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, depth)) < len(p)]
        return min(found, default=-1)

    def end(self, tag: str) -> None:
        """An end tag: it closes the last such element, but an inline one isn't closed across a block's edge."""
        depth = self.last((tag,))
        if depth >= 0 and (tag in BLOCK_TAGS or not self.block_places or self.block_places[-1] <= depth):
            self.cut(depth)

    def make_room(self, tag: str) -> None:
        """Close what a new element of this kind ends."""
        if tag in CLOSES_P and self.block_places and self.tags[self.block_places[-1]] == "p":
            self.cut(self.block_places[-1])
        if tag == "tr":
            depth = self.first_after(CLOSED_BY[tag], self.last(ROW_BOUNDARY))
            if depth >= 0:
                self.cut(depth)
        elif tag in CLOSED_BY:
            depth = self.last(CLOSED_BY[tag])
            if depth > self.last(BOUNDARY):
                self.cut(depth)


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    open_, out, text = _Open(), [], []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if text:
            clean = " ".join(html.unescape("".join(text)).split())
            if clean:
                out.append(Block(open_.paths[-1], clean, min(linked, len(clean))))
            text.clear()
        linked = 0

    at = stop = 0
    tokens = tokens_of(page)
    skipped = _skipped(tokens)
    for place, token in enumerate(tokens):
        if place < stop:
            continue
        if token.start > at:
            text.append(page[at : token.start])
            if in_link:
                linked += token.start - at
        at = token.stop
        tag = token.tag
        if not tag:
            continue
        if tag in SKIPPED_TAGS:
            if place in skipped:
                stop = skipped[place] + 1
                at = tokens[stop - 1].stop
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
        if token.end:
            open_.end(tag)
            if tag == "a":
                in_link = False
            continue
        open_.make_room(tag)
        if tag in VOID_TAGS or token.attrs.endswith("/"):
            continue
        if tag == "a":
            in_link = True
        open_.push(tag, token.attrs)
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


_ELEMENT_CODES: dict[tuple[str, str], tuple[int, int]] = {}


def _code(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


def _element_codes(tag: str, attrs: str) -> tuple[int, int]:
    """Hashed words of an element, as bits, and their number; pages repeat few elements often."""
    found = _ELEMENT_CODES.get((tag, attrs))
    if found is None:
        words, codes = _words_of(tag, attrs), 0
        for word in words:
            codes |= 1 << _code(word, PATHS)
        found = codes, len(words)
        if len(attrs) < 200:
            if len(_ELEMENT_CODES) > 20_000:
                _ELEMENT_CODES.clear()
            _ELEMENT_CODES[tag, attrs] = found
    return found


class Page:
    """Inputs of a page's blocks: the different tag paths (bits of hashed words) and that of each block, hashed words and
    the block of each, and numbers."""

    __slots__ = ("n", "paths", "path_of", "words", "word_at", "numbers")

    def __init__(self, blocks: list[Block]):
        self.n = len(blocks)
        words, word_at = [], []
        paths: dict[int, int] = {}
        self.path_of = np.zeros(self.n, np.int64)
        self.numbers = np.zeros((self.n, NUMBERS), np.float32)
        for k, (path, text, linked) in enumerate(blocks):
            self.path_of[k] = paths.setdefault(path.codes, len(paths))
            some = sorted({_code(w, WORDS) for w in set(text.lower().split())})
            words += some
            word_at += [k] * len(some)
            n = len(text)
            self.numbers[k] = (np.log1p(n) / 6, linked / n, text.count(" ") / 40 if n < 400 else 1 + n / 4000, text[-1] in ".!?…", path.n_words / 12, k / (self.n + 1))
        self.numbers[:, 2] = np.minimum(self.numbers[:, 2], 3)
        self.paths = np.frombuffer(b"".join(p.to_bytes(PATHS // 8, "little") for p in paths), np.uint8).reshape(len(paths), PATHS // 8)
        self.words, self.word_at = np.array(words, np.int64), np.array(word_at, np.int64)

    def path_bits(self, start: int, stop: int) -> np.ndarray:
        """Which words the paths from one to another have, each weighed by the root of their number (path x word)."""
        bits = np.unpackbits(self.paths[start:stop], axis=1, bitorder="little").astype(np.float32)
        return bits / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))


def new_model(rng: np.random.Generator) -> dict[str, np.ndarray]:
    width = PATH_WIDTH + WORD_WIDTH + NUMBERS
    model = {"paths": rng.normal(0, 0.3, (PATHS, PATH_WIDTH)), "words": rng.normal(0, 0.1, (WORDS, WORD_WIDTH)), "out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
    for way in ("f", "b"):
        model["w" + way] = rng.normal(0, 1 / np.sqrt(width + HIDDEN), (width + HIDDEN, 4 * HIDDEN))
        model["c" + way] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {k: v.astype(np.float32) for k, v in model.items()}


def _inputs(model: dict, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Input of each block (block x page x width) and which are there."""
    longest = max(p.n for p in pages)
    x = np.zeros((longest, len(pages), PATH_WIDTH + WORD_WIDTH + NUMBERS), np.float32)
    mask = np.zeros((longest, len(pages), 1), np.float32)
    for k, page in enumerate(pages):
        mask[: page.n, k] = 1
        x[: page.n, k, PATH_WIDTH + WORD_WIDTH :] = page.numbers
        some = [page.path_bits(a, a + 4096) @ model["paths"] for a in range(0, len(page.paths), 4096)]
        if some:
            x[: page.n, k, :PATH_WIDTH] = np.concatenate(some)[page.path_of]
        if len(page.words):
            first = np.flatnonzero(np.diff(page.word_at, prepend=-1))
            sums = np.add.reduceat(model["words"][page.words], first, axis=0)
            x[page.word_at[first], k, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] = sums / np.sqrt(np.diff(np.append(first, len(page.words))))[:, None]
    return x, mask


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, c: np.ndarray, order, keep: list | None = None) -> np.ndarray:
    """Hidden states of one direction; where the mask is 0 the state stays. ``keep`` gets what the gradient needs."""
    n = x.shape[1]
    h, s = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((len(x), n, HIDDEN), np.float32)
    for t in order:
        both = np.hstack([x[t], h])
        z = both @ w + c
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * s + i * g
        tanh = np.tanh(new)
        if keep is not None:
            keep.append((t, both, i, f, o, g, s, tanh))
        m = mask[t]
        h, s = m * (o * tanh) + (1 - m) * h, m * new + (1 - m) * s
        out[t] = h
    return out


def _lstm_gradient(d_out: np.ndarray, mask: np.ndarray, w: np.ndarray, kept: list, d_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = d_out.shape[1]
    d_h, d_s = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    d_w, d_c, width = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32), d_x.shape[2]
    for t, both, i, f, o, g, s, tanh in reversed(kept):
        m = mask[t]
        d_h = d_h + d_out[t]
        new_h, new_s = m * d_h, m * d_s
        new_s = new_s + new_h * o * (1 - tanh * tanh)
        d_z = np.hstack([new_s * g * i * (1 - i), new_s * s * f * (1 - f), new_h * tanh * o * (1 - o), new_s * i * (1 - g * g)])
        d_w += both.T @ d_z
        d_c += d_z.sum(0)
        back = d_z @ w.T
        d_x[t] += back[:, :width]
        d_h, d_s = (1 - m) * d_h + back[:, width:], (1 - m) * d_s + new_s * f
    return d_w, d_c


def scores(model: dict, pages: list[Page]) -> list[np.ndarray]:
    """Log-odds of being main text, for each block of each page."""
    out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if p.n), key=lambda k: pages[k].n)
    at = 0
    while at < len(order):
        stop = at + 1  # pages of about equal length together, up to a bounded number of blocks
        while stop < len(order) and stop - at < 256 and (stop + 1 - at) * pages[order[stop]].n <= 16_384:
            stop += 1
        some = order[at:stop]
        x, mask = _inputs(model, [pages[k] for k in some])
        steps = range(len(x))
        h = np.concatenate([_lstm(x, mask, model["wf"], model["cf"], steps), _lstm(x, mask, model["wb"], model["cb"], reversed(steps))], 2)
        odds = h @ model["out"] + model["bias"]
        for n, k in enumerate(some):
            out[k] = odds[: pages[k].n, n]
        at = stop
    return out


def train(pages: list[Page], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = BATCH, seed: int = SEED, rate: float = 6e-3) -> dict[str, np.ndarray]:
    """Back-propagation through time with Adam."""
    rng = np.random.default_rng(seed)
    model = new_model(rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step, total = 0, epochs * -(-len(pages) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        #: Pages of about equal length stand together within a stretch of the epoch.
        order = np.concatenate([part[np.argsort([pages[k].n for k in part], kind="stable")] for part in np.array_split(order, max(1, len(order) // (batch * 8)))])
        for at in rng.permutation(range(0, len(order), batch)):
            some = [int(k) for k in order[at : at + batch]]
            x, mask = _inputs(model, [pages[k] for k in some])
            y = np.zeros(mask.shape[:2], np.float32)
            for n, k in enumerate(some):
                y[: pages[k].n, n] = labels[k]
            keep_f, keep_b, steps = [], [], range(len(x))
            h = np.concatenate([_lstm(x, mask, model["wf"], model["cf"], steps, keep_f), _lstm(x, mask, model["wb"], model["cb"], reversed(steps), keep_b)], 2)
            d_odds = (_sigmoid(h @ model["out"] + model["bias"]) - y) * mask[:, :, 0] / mask.sum()
            grad = {"out": np.einsum("tb,tbh->h", d_odds, h), "bias": d_odds.sum(keepdims=True).ravel()}
            d_h, d_x = d_odds[:, :, None] * model["out"], np.zeros_like(x)
            grad["wf"], grad["cf"] = _lstm_gradient(d_h[:, :, :HIDDEN], mask, model["wf"], keep_f, d_x)
            grad["wb"], grad["cb"] = _lstm_gradient(d_h[:, :, HIDDEN:], mask, model["wb"], keep_b, d_x)
            grad["paths"], grad["words"] = np.zeros_like(model["paths"]), np.zeros_like(model["words"])
            for n, page in enumerate(pages[k] for k in some):
                own = np.zeros((len(page.paths), PATH_WIDTH), np.float32)
                np.add.at(own, page.path_of, d_x[: page.n, n, :PATH_WIDTH])
                grad["paths"] += page.path_bits(0, len(page.paths)).T @ own
                size = np.sqrt(np.bincount(page.word_at, minlength=page.n))[page.word_at][:, None]
                np.add.at(grad["words"], page.words, d_x[page.word_at, n, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] / size)
            step += 1
            for key, g in grad.items():
                g = np.clip(g, -1, 1)
                m1[key] += 0.1 * (g - m1[key])
                m2[key] += 0.01 * (g * g - m2[key])
                model[key] -= rate * (1 - step / (total + 1)) * (m1[key] / (1 - 0.9**step)) / (np.sqrt(m2[key] / (1 - 0.99**step)) + 1e-8)
    return model


WEIGHTS = Path(__file__).with_name("block_labeller.npz")
_MODEL: dict | None = None


def trained(pages: int = PAGES, seed: int = SEED) -> dict[str, np.ndarray]:
    """A model from so many made pages, read EPOCHS times or as often as STEPS steps take; the same from the same seed."""
    from eventloom.llm.pagemaker import MARK, marked_pages

    inputs, labels = [], []
    for page in marked_pages(pages, seed):
        found = blocks_of(page)
        inputs.append(Page([Block(path, text.replace(MARK, ""), min(linked, len(text.replace(MARK, "")))) for path, text, linked in found]))
        labels.append(np.array([MARK in text for _, text, _ in found], np.float32))
    return train(inputs, labels, max(EPOCHS, -(-STEPS * BATCH // pages)))


def model() -> dict[str, np.ndarray]:
    """The weights in the package, or, where they are missing, those of a training."""
    global _MODEL
    if _MODEL is None:
        if WEIGHTS.exists():
            with np.load(WEIGHTS) as file:
                _MODEL = {key: file[key].astype(np.float32) for key in file.files}
        else:
            _MODEL = trained()
    return _MODEL


def extract(pages: list[str], weights: dict[str, np.ndarray]) -> list[str]:
    """Main text of each page."""
    found = [blocks_of(p) for p in pages]
    odds = scores(weights, [Page(b) for b in found])
    return ["\n".join(text for (_, text, _), o in zip(b, some, strict=True) if o > 0) for b, some in zip(found, odds, strict=True)]


def main_text(pages: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    from eventloom.llm.common import blocks

    sent = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, 2, batch_bytes):
            texts = extract([x or "" for x in part.column(2).to_pylist()], sent.value)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{key: value.astype(np.float16) for key, value in trained().items()})
