"""Cached encoding with the tokenizers library, whose vocabulary files are given by path."""

from __future__ import annotations

import re
from struct import pack

import numpy as np

#: Unicode's white space, which the tokenizers' patterns call \s: code points, inclusive ranges.
BLANK_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
BLANK = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in BLANK_RANGES)
RARE = [chr(c) for a, b in BLANK_RANGES for c in range(a, b + 1) if c not in (0x20, 0x0A)]
#: Pairs of blanks, of which the byte-level pattern makes one token or two by what follows.
PAIRS = ("  ", " \n", "\n ", "\n\n")
CONTROLS = "\x1c\x1d\x1e\x1f"
CACHE = 300_000
LONGEST = 64
MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch

_encoders: dict[tuple[str, str], Encoder] = {}


def public_path(name: str) -> str:
    """Where the box's public vocabulary file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Cache(dict):
    """word -> ids of prefix + word as little-endian unsigned 32-bit integers; two bounded generations."""

    def __init__(self, owner: Encoder, prefix: str):
        self.owner, self.prefix = owner, prefix
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            # Both patterns cut between a letter and marks, so a word and its closing marks are encoded apart.
            base = word.rstrip(MARKS)
            if 1 < len(base) < len(word) and base[-1].isascii() and base[-1].isalpha():
                ids = self[base] + self.owner.plain[word[len(base) :]]
            elif self.owner.kind == "word" and LATIN(word) and (low := word.lower()) != word:
                ids = self[low]  # that vocabulary's own first step
            else:
                ids = self.owner.ids(self.prefix, word)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encodes whole texts word by word: both vocabularies' patterns never join text across these cuts.

    kind "byte": a cut before each word and its one leading space; kind "word": a cut at every run of blanks,
    which that vocabulary drops. Strings of special tokens in a text become their ids, as in the library's defaults.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"{path}: special tokens that take in what stands beside them are not supported")
        self.special = {x: pack("<I", i) for x, i in special.items()}
        self.at_special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # the caches below see each word first; its own would only add locks
        self.kind = kind
        letters = _byte_letters()
        self.shown = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.plain = _Cache(self, "")
        self.spaced = _Cache(self, " ")
        pattern = f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]" if kind == "byte" else f"[^{BLANK}]+"
        self.pieces = re.compile(pattern).findall

    def ids(self, prefix: str, word: str) -> bytes:
        if LATIN(word):  # one word of the pattern: straight to the library's model
            shown = (prefix + (word if self.kind == "byte" else word.lower())).translate(self.shown)
            found = [t.id for t in self.model.tokenize(shown)]
        else:
            found = self.tokenizer.encode(prefix + word, add_special_tokens=False).ids
        return pack(f"<{len(found)}I", *found)

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not any(x in text for x in self.special):
            return np.frombuffer(self.ordinary(text), dtype="<u4")
        parts, at = [], 0
        for m in self.at_special.finditer(text):
            parts += self.ordinary(text[at : m.start()]), self.special[m[0]]
            at = m.end()
        return np.frombuffer(b"".join([*parts, self.ordinary(text[at:])]), dtype="<u4")

    def ordinary(self, text: str) -> bytes:
        """The ids of a text without special tokens, as bytes."""
        plain = self.plain
        if self.kind == "word":
            pieces = self.pieces(text) if any(c in text for c in CONTROLS) else text.split()
            return b"".join(map(plain.__getitem__, pieces))
        if any(p in text for p in PAIRS) or any(c in text for c in RARE):
            return b"".join([plain[p] for p in self.pieces(text)])
        spaced, out = self.spaced.__getitem__, []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(plain["\n"])
            head, *rest = line.split(" ")
            if head:
                out.append(plain[head])
            out += map(spaced, rest)
        return b"".join(out)


def encoder(path: str, kind: str) -> Encoder:
    """The worker's one encoder of that file."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
