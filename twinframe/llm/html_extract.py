"""Main text of web pages from a recurrent block labeller.

A page is cut into blocks, the leaf texts between block-level tags, each with the path of open elements above it. A
bidirectional LSTM in numpy reads the whole page's blocks in both directions, so that every block's label can depend on all
others: its input is the tag path (names, classes, ids and roles, hashed), the block's words (hashed) and a few measures such as
the share of linked text. Blocks labelled main are joined. html_train.py trains the weights on generated pages.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from pathlib import Path
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

PATH_BITS, WORD_BITS, MEASURES, HIDDEN = 96, 32, 10, 24
INPUT = PATH_BITS + WORD_BITS + MEASURES

#: Cells (pages x blocks of the longest) that a batch holds at most, unless one page alone has more.
CELLS = 16_384

#: Elements whose content is no text of the page; elements without content; inline elements (all others bound a block).
RAW = {"script", "style", "template", "title", "textarea", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label map mark meter nobr object output progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics svg g text tspan".split())

#: What an opening tag closes implicitly, and the elements that stop the search.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "body", "html"}
CLOSE_P = set("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S,
)
#: The same for pages whose quotes don't close: a tag ends at its first bracket. Empty groups keep the others' numbers.
PLAIN = re.compile(r"<!--.*?(?:--!?>|\Z)|()()()(?!)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)

#: Tags whose quotes run to the page's end, each of which is read that far, before PLAIN takes over.
UNCLOSED = 16

ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECES = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


@lru_cache(maxsize=50_000)
def element(name: str, attributes: str) -> tuple[str, ...]:
    """The marks that an element adds to the path: its name, and the words of its class, id and role."""
    marks = [name]
    for m in ATTRIBUTE.finditer(attributes):
        marks += [f".{p.lower()}" for p in PIECES.findall(m[2] or m[3] or m[4] or "")]
    return tuple(marks)


class Page:
    """Blocks of a page in order: paths, texts and linked characters."""

    def __init__(self, source: str | None):
        self.paths: list[tuple] = []
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.stack: list[tuple[str, tuple]] = []
        self.run: list[str] = []
        self.links = 0
        self.parse(source or "")

    def flush(self) -> None:
        if self.run:
            text = " ".join(html.unescape("".join(self.run)).split())
            if text:
                self.paths.append(tuple(x[1] for x in self.stack if x[0] not in INLINE))
                self.texts.append(text)
                self.linked.append(self.links)
            self.run, self.links = [], 0

    def pop(self, names: set[str], stop: set[str]) -> None:
        """Closes the innermost open element of these names, and what is open inside it."""
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in names:
                if any(x[0] not in INLINE for x in self.stack[k:]):
                    self.flush()
                del self.stack[k:]
                return
            if name in stop:
                return

    def text(self, s: str) -> None:
        if s:
            self.run.append(s)
            if any(x[0] == "a" for x in self.stack[-4:]):
                self.links += len(s)

    def parse(self, source: str) -> None:
        at, last, token, unclosed = 0, source.rfind(">"), TOKEN, 0
        while at <= last and (m := token.search(source, at)):  # without a bracket ahead no tag ends
            unclosed += m[5] is not None
            if unclosed == UNCLOSED:
                token = PLAIN
            self.text(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if name not in INLINE:
                    self.flush()
                self.pop({name}, set() if name not in INLINE else {"td", "th", "body"})
                continue
            attributes = m[3] or m[6] or ""
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(source, at)
                at = end.end() if end else len(source)
                if name not in ("script", "style"):
                    self.run.append(" ")
                continue
            if name in INLINE:
                if name == "br":
                    self.run.append(" ")
                elif name not in VOID:
                    self.stack.append((name, ()))
                continue
            self.flush()
            if name in VOID:
                continue
            if name in CLOSE_P:
                self.pop({"p"}, SCOPE - {"ul", "ol", "dl"} | {"td", "th", "li", "div", "article", "section"})
            if name in CLOSES:
                self.pop(CLOSES[name], SCOPE)
            self.stack.append((name, element(name, attributes)))
        self.text(source[at:].partition("<!--")[0])
        self.flush()


@lru_cache(maxsize=50_000)
def path_vector(path: tuple) -> bytes:
    """Hashed marks of a path: those of the three innermost elements once more, apart from the rest."""
    v = np.zeros(PATH_BITS, np.float32)
    for k, marks in enumerate(reversed(path)):
        for mark in marks:
            h = crc32(mark.encode())
            v[h % (PATH_BITS // 2)] += 1.0 if h >> 16 & 1 else -1.0
            if k < 3:
                h = crc32(b"in" + mark.encode())
                v[PATH_BITS // 2 + h % (PATH_BITS // 2)] += 1.0 if h >> 16 & 1 else -1.0
    return np.clip(v, -2, 2).tobytes()


@lru_cache(maxsize=200_000)
def word_place(word: str) -> int:
    return crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BITS


PUNCTUATION = re.compile(r"[.!?,;:]")


def inputs(page: Page) -> np.ndarray:
    """Input vectors of a page's blocks."""
    n = len(page.texts)
    x = np.zeros((n, INPUT), np.float32)
    for i, (path, text, linked) in enumerate(zip(page.paths, page.texts, page.linked, strict=True)):
        words = text.split(" ")
        x[i, :PATH_BITS] = np.frombuffer(path_vector(path), np.float32)
        counts = np.bincount(list(map(word_place, words)), minlength=WORD_BITS)
        x[i, PATH_BITS : PATH_BITS + WORD_BITS] = np.sqrt(counts / len(words))
        inner = path[-1][0] if path else ""
        marks = len(PUNCTUATION.findall(text))
        x[i, PATH_BITS + WORD_BITS :] = (
            np.log1p(len(words)) / 4,
            min(1.0, linked / len(text)),
            min(2.0, 10 * marks / (len(words) + 5)),
            inner == "p",
            inner in ("h1", "h2", "h3", "h4"),
            inner in ("li", "td", "dd"),
            "©" in text or "(c)" in text,
            text[-1] in ".!?…\"»”",
            len(path) / 8,
            i / n,
        )
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


def run_lstm(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], side: str, keep: list | None = None) -> np.ndarray:
    """Hidden states (pages, blocks, HIDDEN) in one direction; states don't change past a page's end. keep gathers what training needs."""
    b, t, _ = x.shape
    pre = x @ w[f"{side}x"] + w[f"{side}b"]
    h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
    out = np.zeros((b, t, HIDDEN), np.float32)
    for k in range(t) if side == "f" else range(t - 1, -1, -1):
        z = pre[:, k] + h @ w[f"{side}h"]
        g = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
        u = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[:, k, None]
        new = np.where(m, f * c + i * u, c)
        s = np.tanh(new)
        if keep is not None:
            keep.append((k, h, c, i, f, o, u, s, m))
        c, h = new, np.where(m, o * s, h)
        out[:, k] = h
    return out


def label(xs: list[np.ndarray], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Probability of each block being main text, page by page; pages of like length share a batch."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(xs)
    order = sorted((i for i in range(len(xs)) if len(xs[i])), key=lambda i: len(xs[i]))
    while order:
        longest, group = 0, []
        while order and (not group or max(longest, len(xs[order[0]])) * (len(group) + 1) <= CELLS):
            longest = max(longest, len(xs[order[0]]))
            group.append(order.pop(0))
        x, mask = np.zeros((len(group), longest, INPUT), np.float32), np.zeros((len(group), longest), bool)
        for k, i in enumerate(group):
            x[k, : len(xs[i])], mask[k, : len(xs[i])] = xs[i], True
        h = np.concatenate([run_lstm(x, mask, w, s) for s in "fr"], axis=2)
        p = sigmoid(h @ w["o"] + w["ob"])[:, :, 0]
        for k, i in enumerate(group):
            out[i] = p[k, : len(xs[i])]
    return out


@lru_cache(maxsize=1)
def weights() -> dict[str, np.ndarray]:
    with np.load(Path(__file__).with_name("html_weights.npz")) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def main_texts(sources: list[str | None]) -> list[str]:
    pages = [Page(s) for s in sources]
    found = label([inputs(p) for p in pages], weights())
    return ["\n".join(t for t, q in zip(p.texts, pr, strict=True) if q >= 0.5) for p, pr in zip(pages, found, strict=True)]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page's main text: id, url, text (blocks joined by newlines, empty if none), n_chars long (code points).

    Null html is empty; broken markup is read as far as it goes (an unclosed raw element takes the rest); repeated rows give
    repeated results; other columns are not read.
    """

    def make():
        def rows(part):
            return [(i, u, t, len(t)) for (i, u, _), t in zip(part, main_texts([s for _, _, s in part]), strict=True)]

        return rows

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, url_col, html_col), make, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
