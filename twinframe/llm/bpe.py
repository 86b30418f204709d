"""Byte-pair encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list; a priority queue holds its adjacent pairs by merge rank and place. The lowest
rank is merged first; entries whose symbols have changed since are stale and skipped. Decoding looks ids up in the
vocabulary and joins the strings.

The vocabulary file is a parameter and every task reads it by itself, so nothing is broadcast. Words repeat, so each Python
worker keeps a memo of encoded words; it is emptied when it holds MEMO_WORDS of them and changes no result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from .common import map_rows

#: Words that a worker's memo holds at most (about 300 bytes each).
MEMO_WORDS = 400_000

#: White space as Unicode's White_Space property has it, which the split pattern's \s means.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where Latin-1 prints it, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


@lru_cache(maxsize=1)
def unassigned() -> str:
    """Character class ranges of code points that the regex module takes for letters or numbers and this Python's Unicode tables, with which the tokenizers library agrees, for unassigned."""
    open_ = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn")
    found = sorted(map(ord, regex.findall(r"[\p{L}\p{N}]", open_)))
    ranges: list[list[int]] = []
    for c in found:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class WordBPE:
    """Encoder and decoder of a tokenizer file whose words end in a suffix, without a decoder of its own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        symbols = byte_symbols()
        self.byte_id = [vocab[s] for s in symbols]
        self.last_id = [vocab[s + self.suffix] for s in symbols]
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        new = unassigned()
        letter, number = (rf"[\p{{L}}--[{new}]]", rf"[\p{{N}}--[{new}]]") if new else (r"\p{L}", r"\p{N}")
        contractions = "'s|'t|'re|'ve|'m|'ll|'d"
        self.split_plain = regex.compile(rf"{contractions}|[a-zß-öø-ÿ]+|[0-9]|[^{WHITE}a-zß-öø-ÿ0-9]+")
        self.split = regex.compile(rf"{contractions}|{letter}+|{number}|[[^{WHITE}]--{letter}--{number}]+", regex.V1)
        #: Finds what the plainer, faster pattern would not class rightly: signs beyond Latin-1, and those of Latin-1 that are letters or numbers.
        self.beyond = regex.compile(r"[^\x00-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]").search
        self.ids_text: dict[str, str] = {}
        self.strings_text: dict[str, str] = {}

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.byte_id[b] for b in raw[:-1]] + [self.last_id[raw[-1]]]
        n = len(ids)
        if n == 1:
            return ids
        merges = self.merges
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        queue = []
        for i in range(n - 1):
            if m := merges.get((ids[i], ids[i + 1])):
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((merged, ids[k])):
                    heapq.heappush(queue, (m[0], i, merged, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], merged))):
                heapq.heappush(queue, (m[0], h, ids[h], merged, m[1]))
        return [x for x in ids if x >= 0]

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text; special strings are pre-tokens of their own, which the split pattern never yields (they mix letters and signs)."""
        found: list[str] = []
        for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if k % 2:
                found.append(part)
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower-cased character by character, so no final sigma
                part = part.lower()
                found += (self.split if self.beyond(part) else self.split_plain).findall(part)
        return found

    def _learn(self, words: set[str]) -> None:
        for w in words:
            ids = [self.special[w]] if w in self.special else self.encode_word(w)
            self.ids_text[w] = " ".join(map(str, ids))
            self.strings_text[w] = " ".join(self.strings[i] for i in ids)

    def encode_text(self, text: str | None) -> tuple[str, str]:
        """Decimal ids and decoded text, each joined by one space."""
        words = self.words(text or "")
        if len(self.ids_text) > MEMO_WORDS:
            self.ids_text.clear()
            self.strings_text.clear()
        if missing := set(words).difference(self.ids_text):
            self._learn(missing)
        return " ".join(map(self.ids_text.__getitem__, words)), " ".join(map(self.strings_text.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.encode_text(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Concatenates the ids' vocabulary strings, one space between; unknown ids are left out."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    """One encoder for each file and worker process; its memo outlives tasks."""
    return WordBPE(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and the decoded text of every row: id, ids array<int>, decoded string.

    Whole texts of any length; a null text is empty (no ids, empty decoded text); repeated rows give repeated results; other
    columns, whatever their names, are not read.
    """

    def make():
        bpe = load(path)

        def rows(part):
            out = []
            for i, t in part:
                ids, decoded = bpe.encode_text(t)
                out.append((i, [int(x) for x in ids.split()], decoded))
            return out

        return rows

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), make, f"`{id_col}` {kind}, ids array<int>, decoded string")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The decoded text of every row's ids: id, decoded string; null ids are empty."""

    def make():
        bpe = load(path)
        return lambda part: [(i, bpe.decode(ids or [])) for i, ids in part]

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, ids_col), make, f"`{id_col}` {kind}, decoded string")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), but of ids and decoded text only the count and SHA-256 digests leave the worker: id, n_tokens, ids_sha256, decoded_sha256."""

    def make():
        bpe = load(path)

        def rows(part):
            out = []
            for i, t in part:
                ids, decoded = bpe.encode_text(t)
                out.append((i, ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()))
            return out

        return rows

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
