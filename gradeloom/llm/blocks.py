"""Main text of web pages: a bidirectional LSTM labels the leaf blocks of a page by tag path, words and context."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradeloom.llm.common import Shipped

#: Weights of the labeller, written by ``python -m gradeloom.llm.block_training``.
WEIGHTS = Path(__file__).with_name("block_weights.npz")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
BETWEEN = re.compile(r"[\s/]*")
#: One attribute of a tag, as HTML reads it: a quote opens a value only right after the equals sign.
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
# Elements whose content is no markup but runs to their end tag, and elements whose content is no text of the page.
RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "title", "textarea")}
HIDDEN = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("template", "svg", "select")}
# Elements of HTML that have no end tag, that stand within a line, and whose start ends an open p.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
DIGIT = re.compile(r"\d")
ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Widths of the hashed tag path and of the hashed words, plain numbers, units of each direction.
PATH, WORDS, PLAIN, UNITS = 384, 96, 8, 24
#: Blocks, padding included, that are labelled at once; longer pages are read in parts that hand on their state.
CELLS = 1 << 14


def bucket(word: str, width: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % width


def attributes(page: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """Of a tag from behind its name: names and values, whether it closes itself, and where it ends (-1: never)."""
    found = []
    while True:
        m = BETWEEN.match(page, at)
        at = m.end()
        if at >= len(page):
            return found, False, -1
        if page[at] == ">":
            return found, m.group().endswith("/"), at + 1
        m = ATTRIBUTE.match(page, at)
        found.append((m[1].lower(), m[2] or m[3] or m[4] or ""))
        at = m.end()


def tokens(page: str):
    """('text', text, [], False), ('start', name, attributes, closes itself) and ('end', name, [], False) of a page, in one pass forward."""
    at, n, gone = 0, len(page), set()
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            yield "text", page[at : n if lt < 0 else lt], [], False
            if lt < 0:
                return
        after = page[lt + 1 : lt + 3]
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):  # an empty comment
                at = page.index(">", lt) + 1
                continue
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif after[:1] in ("!", "?") or (after[:1] == "/" and len(after) == 2 and not (after[1].isascii() and after[1].isalpha())):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif m := NAME.match(page, lt + 1 + (after[:1] == "/")):
            name = m.group().lower()
            given, itself, at = attributes(page, m.end())
            if at < 0:
                return  # the page ends within the tag
            if after[0] == "/":
                yield "end", name, [], False
            elif name in RAW:
                end = RAW[name].search(page, at)
                at = n if end is None else end.start()
            else:
                yield "start", name, given, itself
                if name in HIDDEN and not itself and name not in gone:
                    if end := HIDDEN[name].search(page, at):
                        at = end.end()
                    else:
                        gone.add(name)  # none closes any more; the tag alone is dropped
        else:
            yield "text", "<", [], False
            at = lt + 1


def leaf_blocks(page: str | None) -> list[tuple[str, int, int, float]]:
    """The page's text in order: (text, bits of its hashed tag path, depth, share of its characters within links).

    A block ends where an element other than one within a line starts or ends. Scripts, styles, comments and
    the like are no text. Character references are decoded, white space becomes one space.
    """
    out, path, buf, linked, links, page = [], [], [], 0, 0, page or ""
    opened: Counter = Counter()

    def close():
        nonlocal linked
        text = " ".join(entities.unescape("".join(buf)).split())
        buf.clear()
        if text:
            out.append((text, path[-1][1] if path else 0, len(path), min(1.0, linked / len(text))))
        linked = 0

    def end(at):
        for name, _ in path[at:]:
            opened[name] -= 1
        del path[at:]

    def innermost(name):
        return next(i for i in range(len(path) - 1, -1, -1) if path[i][0] == name) if opened[name] else None

    for kind, name, given, itself in tokens(page):
        if kind == "text":
            buf.append(name)
            if links:
                linked += len(name.strip())
            continue
        if name in HIDDEN:
            continue
        if kind == "end":
            if name in INLINE:
                if name == "a" and links:
                    links -= 1
                continue
            close()
            if (i := innermost(name)) is not None:
                end(i)
                links = 0
            continue
        if name in INLINE:
            if name == "br":
                buf.append(" ")
            links += name == "a"
            continue
        close()
        if name in CLOSES_P and (i := innermost("p")) is not None and not any(p[0] in ("td", "th", "li") for p in path[i:]):
            end(i)
        if name in ENDS and opened[name]:
            for i in range(len(path) - 1, -1, -1):
                if path[i][0] in ENDS[name]:
                    break
                if path[i][0] == name:
                    end(i)
                    break
        if name not in VOID and not itself:
            links = 0
            bits = path[-1][1] if path else 0
            for p in (name, *(f"{a}={w}" for a, value in given if a in ("class", "id", "role") for w in re.split(r"[\s_-]+", value.lower()) if w)):
                bits |= 1 << bucket(p, PATH)
            path.append((name, bits))
            opened[name] += 1
    close()
    return out


def block_vectors(blocks: list[tuple[str, int, int, float]], first: int = 0, of: int | None = None) -> np.ndarray:
    """One row a block: hashed tag path, all its hashed words, and plain numbers. ``first``: its place among the page's ``of`` blocks."""
    x, of, k = np.zeros((len(blocks), PATH + WORDS + PLAIN), np.float32), len(blocks) if of is None else of, PATH + WORDS
    if blocks:
        bits = np.frombuffer(b"".join(b[1].to_bytes(PATH // 8, "little") for b in blocks), np.uint8).reshape(len(blocks), -1)
        x[:, :PATH] = np.unpackbits(bits, axis=1, bitorder="little")
    for i, (text, _, depth, links) in enumerate(blocks):
        words = text.lower().split()
        x[i, PATH:k] = np.bincount([bucket(w, WORDS) for w in words], minlength=WORDS) / len(words)
        x[i, k:] = links, min(1.0, np.log1p(len(text)) / 7), text[-1] in ".!?:", (first + i) / max(1, of - 1), min(depth, 20) / 10, DIGIT.search(text) is not None, text.isupper(), 1
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


class Labeller:
    """A bidirectional LSTM with one sigmoid output a block, in numpy."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def run(self, x: np.ndarray, side: str, mask: np.ndarray, state=None, keep: bool = False):
        """x: (steps, pages, inputs), already in this direction's order; ``state``: what came before. (outputs, state, what training needs)"""
        steps, n, _ = x.shape
        h, c = state or (np.zeros((n, UNITS), np.float32), np.zeros((n, UNITS), np.float32))
        kept = []
        z_in = (x.reshape(steps * n, -1) @ self.p["w" + side] + self.p["c" + side]).reshape(steps, n, -1)
        out = np.empty((steps, n, UNITS), np.float32)
        for t in range(steps):
            z = z_in[t] + h @ self.p["u" + side]
            g = _sigmoid(z[:, : 3 * UNITS])
            i, f, o, a = g[:, :UNITS], g[:, UNITS : 2 * UNITS], g[:, 2 * UNITS :], np.tanh(z[:, 3 * UNITS :])
            m = mask[t][:, None]
            c2 = f * c + i * a
            tc = np.tanh(c2)
            if keep:
                kept.append((h, c, i, f, o, a, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c2, c)
            out[t] = h
        return out, (h, c), kept

    def label(self, pages: list[list[tuple[str, int, int, float]]]) -> list[np.ndarray]:
        """For each page's leaf blocks: True for those of the main text. Pages of like length run together, ``CELLS`` blocks
        at a time; a longer page is read part by part in both directions, each part starting from the state before it."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            n = 1
            while n < len(order) and len(pages[order[n]]) * (n + 1) <= CELLS:
                n += 1
            ids, order = order[:n], order[n:]
            steps = len(pages[ids[-1]])
            starts = range(0, steps, max(1, CELLS // n))
            logit, held = np.full((steps, n), float(self.p["oc"][0])), {}
            for side, parts in (("f", starts), ("b", reversed(starts))):
                state, flip = None, 1 if side == "f" else -1
                for a in parts:
                    if a not in held:
                        z = min(steps, a + starts.step)
                        held = {a: padded([block_vectors(pages[i][a:z], a, len(pages[i])) for i in ids], z - a)}
                    x, mask = held[a]
                    h, state, _ = self.run(x[::flip], side, mask[::flip], state)
                    logit[a : a + len(x)] += h[::flip] @ (self.p["o"][:UNITS] if side == "f" else self.p["o"][UNITS:])
            for j, i in enumerate(ids):
                out[i] = logit[: len(pages[i]), j] >= 0
        return out


def padded(rows: list[np.ndarray], steps: int = 0) -> tuple[np.ndarray, np.ndarray]:
    steps = max(steps, *(len(r) for r in rows))
    x, mask = np.zeros((steps, len(rows), PATH + WORDS + PLAIN), np.float32), np.zeros((steps, len(rows)), bool)
    for j, r in enumerate(rows):
        x[: len(r), j], mask[: len(r), j] = r, True
    return x, mask


@cache
def trained() -> Labeller:
    """The labeller with the weights that ``block_training`` has written; the same on every machine."""
    with np.load(WEIGHTS) as f:
        return Labeller({k: f[k].astype(np.float32) for k in f.files})


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html; other columns are not used).

    The text is that of the blocks labelled main text, in page order, joined by an empty line; n_chars is its
    number of code points. A null or empty html has the empty text. Rows stand alone: repeated rows give
    repeated results, an empty table an empty one. A whole page is read, however long it is.
    """
    labeller = labeller or trained()
    box = Shipped(pages.sparkSession, labeller)  # fixed size, some 100 kB

    def run(batches):
        labeller = box.get()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [leaf_blocks(h.as_py()) for h in part.column("html")]
                marks = labeller.label(found)
                texts = ["\n\n".join(f[i][0] for i in np.flatnonzero(m)) for f, m in zip(found, marks)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
