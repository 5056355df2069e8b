"""Word, shingle and MinHash kernels shared by the text operators.

A word is a run of ``[^\\x20\\x09-\\x0D]``. Kernels work on UTF-8 bytes and never build one object per
shingle, so that a document of any length is handled in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_CHARS = 1 << 21

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
U = np.uint64


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """The words of a text; bytes.split() cuts at exactly the six ASCII blanks."""
    return utf8(text).split()


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _MULT), ("down", _INV)):
            a = np.full(size, base, dtype=U)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def span_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of joined[starts[i]:ends[i]], from one prefix sum."""
    b = np.frombuffer(joined, dtype=np.uint8).astype(U) + U(1)
    up, down = _power(len(b) + 1)
    prefix = np.zeros(len(b) + 1, dtype=U)
    np.cumsum(b * up[: len(b)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text whose words are joined by one space."""
    if not joined:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    return np.concatenate(([0], gap + 1)), np.concatenate((gap, [len(joined)]))


def word_blocks(text: str | None, overlap: int) -> Iterator[tuple[int, bytes]]:
    """(number of the first word, words joined by one space) for blocks that share `overlap` words."""
    text = text or ""
    if len(text) <= BLOCK_CHARS:
        yield 0, b" ".join(words(text))
        return
    first, at, carried = 0, 0, []
    while at < len(text):
        stop = min(len(text), at + BLOCK_CHARS)
        while stop < len(text) and text[stop] not in " \t\n\v\f\r":
            stop += 1
        found = carried + words(text[at:stop])
        yield first, b" ".join(found)
        carried = found[max(0, len(found) - overlap) :] if overlap else []
        first += len(found) - len(carried)
        at = stop


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter text is one shingle, an empty one none.

    Two different shingles get the same hash with a probability of about 2**-64.
    """
    out = []
    for _, joined in word_blocks(text, k - 1):
        s, e = word_bounds(joined)
        if len(s) >= k:
            out.append(span_hashes(joined, s[: len(s) - k + 1], e[k - 1 :]))
        elif len(s) and not out:
            out.append(span_hashes(joined, s[:1], e[-1:]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(_MULT) + U(seed)) | U(1)


def minhash(h: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """One 32-bit minimum for each multiplier over a non-empty set of hashes."""
    best = np.full(len(mult), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), 1024):
        x = (h[None, at : at + 1024] * mult[:, None]) >> U(32)
        np.minimum(best, x.min(axis=1).astype(np.uint32), out=best)
    return best
