"""A byte-level BPE vocabulary file: its merges, its added tokens and how it cuts a text into pieces."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import regex

from scoregate.llm.common import kept_by

#: Fixed value: the pattern that cuts a text into pieces before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters and numbers that Unicode 16.0 added to 15.1 (first, last). The tokenizers library knows 16.0.
UNICODE_VERSION = (16, 0)
LETTERS_OF_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_OF_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)


def _spelled(points: Iterable[int]) -> str:
    """Code points as ranges of a character class."""
    points = np.fromiter(points, np.int64)
    starts = np.flatnonzero(np.diff(points, prepend=-2) != 1)
    ends = np.append(starts[1:], len(points)) - 1
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[starts].tolist(), points[ends].tolist(), strict=True)) if len(points) else ""


@lru_cache(1)
def piece_patterns() -> tuple[str, str]:
    """(the class of the code points that the regex module takes for letters or numbers and the library does not, or the other
    way round; PIECES with the library's letters and numbers spelled out, for texts that hold such a code point)."""
    if tuple(map(int, unicodedata.unidata_version.split(".")))[:2] > UNICODE_VERSION:
        raise RuntimeError("this Python knows a later Unicode version than the tokenizers library")
    kinds = {"L": set(), "N": set()}
    whole = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for c in whole:
        if (kind := unicodedata.category(c)[0]) in kinds:
            kinds[kind].add(ord(c))
    for kind, added in (("L", LETTERS_OF_16), ("N", NUMBERS_OF_16)):
        kinds[kind].update(x for a, b in added for x in range(a, b + 1))
    text, odd = "".join(whole), set()
    for kind, own in kinds.items():
        odd |= own ^ set(map(ord, regex.findall(rf"\p{{{kind}}}", text)))
    spelled = {kind: _spelled(sorted(own)) for kind, own in kinds.items()}
    exact = PIECES.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{spelled['L']}{spelled['N']}]")
    return f"[{_spelled(sorted(odd))}]" if odd else "", exact.replace(r"\p{L}", f"[{spelled['L']}]").replace(r"\p{N}", f"[{spelled['N']}]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


@dataclass(frozen=True)
class Model:
    """merges: pair of ids -> (rank, id of the merged symbol); symbols: the id of each byte; pieces: the bytes of each id."""

    merges: dict[tuple[int, int], tuple[int, int]]
    symbols: tuple[int, ...]
    pieces: dict[int, bytes]
    added: dict[str, int] = field(default_factory=dict)
    name: str = ""
    patterns: tuple[str, str] = ("", "")

    def pairs(self) -> tuple[int, dict[int, tuple[int, int]]]:
        """(m, merges with the pair (a, b) as the key a * m + b)."""
        m = max(self.pieces) + 1
        return m, {a * m + b: found for (a, b), found in self.merges.items()}

    def cut(self) -> Callable[[str], Iterator[str | int]]:
        """A function from a text to its pieces, an added token as its id."""
        plain, exact = regex.compile(PIECES).findall, None
        odd = re.compile(self.patterns[0]).search if self.patterns[0] else None

        def find(text: str) -> list[str]:
            nonlocal exact
            if odd is None or text.isascii() or not odd(text):
                return plain(text)
            exact = exact or re.compile(self.patterns[1]).findall
            return exact(text)

        if not self.added:
            return find
        parts = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        added, strings = self.added, tuple(self.added)

        def cut(text: str) -> list:
            if not any(s in text for s in strings):
                return find(text)
            out: list = []
            for part in parts.split(text):
                out += [added[part]] if part in added else find(part)
            return out

        return cut


def load(path: str) -> Model:
    """Read a tokenizer file of the byte-level BPE kind; one that does anything else to the text is refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(
        model.get(k)
        for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback",
            "ignore_merges"
        )
    )
    if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    vocabulary = model["vocab"]
    characters = byte_characters()
    byte_of = {c: b for b, c in enumerate(characters)}
    merges = {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        merges.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
    pieces = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items()}
    added = {}
    for token in spec.get("added_tokens", []):
        if token.get("single_word") or token.get("lstrip") or token.get("rstrip"):
            raise ValueError(f"{path}: the added token {token['content']!r} takes its neighbours with it")
        added[token["content"]] = token["id"]
        pieces[token["id"]] = token["content"].encode()
    return Model(merges, tuple(vocabulary[c] for c in characters), pieces, added, path, piece_patterns())


#: Pieces that a worker remembers in each of two generations, and the longest piece worth it.
REMEMBERED, LONGEST = 120_000, 64


class Memo(dict):
    """Results by piece, worked out when first asked for. Once it holds `limit` pieces it starts anew, and what is asked for again
    comes from the generation before, so that frequent pieces stay and its memory is bounded."""

    def __init__(self, work: Callable, limit: int = REMEMBERED, longest: int = LONGEST):
        super().__init__()
        self.work, self.limit, self.longest, self.before = work, limit, longest, {}

    def __missing__(self, piece):
        found = self.before.get(piece)
        if found is None:
            found = self.work(piece)
        if type(piece) is int or len(piece) <= self.longest:
            if len(self) >= self.limit:
                self.turn()
            self[piece] = found
        return found

    def turn(self) -> None:
        self.before = self.copy()
        self.clear()

    def learn(self, pieces: Iterable, together: Callable[[list], list]) -> None:
        """Remember the results of pieces, those that are new worked out together. Pieces above `longest` are left out."""
        new = [p for p in set(pieces) if p not in self and (type(p) is int or len(p) <= self.longest)]
        if len(self) + len(new) > self.limit:
            self.turn()
        before = self.before
        unknown = [p for p in new if p not in before]
        self.update((p, before[p]) for p in new if p in before)
        self.update(zip(unknown, together(unknown), strict=True))


def memo_for(kind: str, model: Model, make: Callable[[Model], Callable]) -> Memo:
    """The worker's memo for a model; it lives as long as the Python worker, over tasks."""
    store = kept_by(kind)
    key = (model.name, len(model.merges))
    if key not in store:
        store.clear()
        store[key] = Memo(make(model))
    return store[key]
