"""Improbable-feature digests of byte strings.

Each window of 32 bytes has a Shannon entropy, carried along the text by incremental counts in integers. Its
rarity is the distance from the entropy that is typical of prose; windows of very low entropy rank last.
In each run of 32 successive windows the rarest (the first of equals) gets a vote, and windows with 8
votes or more are features. Features go, in order and once each, into a chain of Bloom filters of 2048
bits with 5 bits a feature and 160 features a filter. The likeness of two digests is the mean, over the
shorter chain's filters weighted by their features, of the best overlap of bits with the other chain's filters,
normalised to 0 for what chance gives and 1 for all that is possible.

All of this is local to about 100 bytes, so that long texts are digested in overlapping blocks.

Defined cases: null text is empty; the empty text has the digest without features, which is like itself (1) and
like nothing else (0); a text of fewer than 32 bytes is one feature; rows of one doc_id follow one another by a hash
of their texts; null doc_ids come last; of equally rare windows of a run the first gets the vote; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.text import U, mix, utf8
from kinetrace.session import cut, prepare, ranges

WIDTH, RUN, VOTES = 32, 32, 8
BITS, PROBES, LOAD = 2048, 5, 160
TYPICAL, LEAST = 3.6, 1.5
CHUNK = 1 << 19
_f = np.zeros(WIDTH + 1)
_f[1:] = np.arange(1, WIDTH + 1) * np.log2(np.arange(1, WIDTH + 1))
_F = np.rint(_f * 65536).astype(np.int64)
#: What a count of c adds to the sum of c*log2(c) over c - 1.
_STEP = np.concatenate(([0], np.diff(_F))).astype(np.int64)
_SUM = lambda bits: round((np.log2(WIDTH) - bits) * WIDTH * 65536)


def entropy_sums(x: np.ndarray) -> np.ndarray:
    """The scaled sum of c*log2(c) of each window of WIDTH bytes."""
    enter, leave = np.ones(len(x), np.uint8), np.ones(len(x), np.uint8)
    for lag in range(1, min(WIDTH, len(x))):
        same = (x[lag:] == x[:-lag]).view(np.uint8)
        enter[lag:] += same
        leave[:-lag] += same
    gone = np.concatenate(([0], np.cumsum(_STEP[leave])))
    return np.cumsum(_STEP[enter])[WIDTH - 1 :] - gone[: len(x) - WIDTH + 1]


def _features(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the features of texts x[starts[i]:ends[i]] of WIDTH bytes or more, and the texts' numbers."""
    sums = entropy_sums(x)
    rank = (1 << 26) - np.abs(sums - _SUM(TYPICAL))
    rank[sums > _SUM(LEAST)] = 1 << 27
    key = (rank << 32) | np.arange(len(rank))
    span = 1
    while span < RUN:
        key = np.minimum(key[:-span], key[span:]) if len(key) > span else key[:0]
        span *= 2
    windows = ends - starts - WIDTH + 1
    runs = windows - RUN + 1
    first = np.repeat(starts, np.maximum(runs, 0))
    within = np.arange(len(first)) - np.repeat(np.cumsum(np.maximum(runs, 0)) - np.maximum(runs, 0), np.maximum(runs, 0))
    votes = np.bincount(key[first + within] & 0xFFFFFFFF, minlength=len(rank)) if len(first) else np.zeros(len(rank), np.int64)
    need = np.minimum(VOTES, np.maximum(runs, 1))
    for i in np.flatnonzero(runs < 1):
        votes[starts[i] + rank[starts[i] : starts[i] + windows[i]].argmin()] = 1
    at = np.flatnonzero(votes)
    text = np.searchsorted(starts, at, side="right") - 1
    good = votes[at] >= need[text]
    return at[good], text[good]


def _hashes(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(x[at[:, None] + np.arange(WIDTH)]).view(np.uint64)
    h = np.zeros(len(at), U)
    for k in range(words.shape[1]):
        h = mix(h * U(0x9E3779B97F4A7C15) + words[:, k] + U(k + 1))
    return h


def _short(data: bytes) -> np.ndarray:
    return _hashes(np.frombuffer(data.ljust(WIDTH, b"\0"), np.uint8), np.zeros(1, np.int64)) ^ U(len(data))


def feature_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The features of each text as 64-bit hashes, in order and once each."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    batch: list[tuple[int, bytes, int, int]] = []

    def solve():
        if not batch:
            return
        ends = np.cumsum([len(d) for _, d, _, _ in batch])
        starts = ends - [len(d) for _, d, _, _ in batch]
        x = np.frombuffer(b"".join(d for _, d, _, _ in batch), np.uint8)
        at, owner = _features(x, starts, ends)
        low = starts + np.array([lo for _, _, lo, _ in batch])
        high = starts + np.array([hi for _, _, _, hi in batch])
        core = (at >= low[owner]) & (at < high[owner])
        at, owner = at[core], owner[core]
        h = _hashes(x, at) if len(at) else np.zeros(0, U)
        cuts = np.searchsorted(owner, np.arange(len(batch) + 1))
        for k, (i, *_) in enumerate(batch):
            found[i].append(h[cuts[k] : cuts[k + 1]])
        batch.clear()

    size = 0
    for i, data in enumerate(texts):
        if 0 < len(data) < WIDTH:
            found[i].append(_short(data))
        elif len(data) >= WIDTH:
            for lo in range(0, len(data), CHUNK):
                if lo and len(data) - lo < WIDTH:
                    break
                hi = min(len(data), lo + CHUNK)
                hi = len(data) if len(data) - hi < WIDTH else hi
                a, b = max(0, lo - RUN), min(len(data), hi + RUN + WIDTH)
                batch.append((i, data[a:b], lo - a, hi - a))
                size += b - a
                if size >= CHUNK:
                    solve()
                    size = 0
    solve()
    out = []
    for parts in found:
        h = np.concatenate(parts) if parts else np.zeros(0, U)
        out.append(h[np.sort(np.unique(h, return_index=True)[1])])
    return out


def filters(h: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters of a text's features, 32 unsigned 64-bit words each."""
    chain = np.zeros((-(-len(h) // LOAD), BITS), bool)
    row = np.arange(len(h)) // LOAD
    for k in range(PROBES):
        chain[row, ((h >> U(11 * k)) & U(BITS - 1)).astype(np.int64)] = True
    return np.packbits(chain, axis=1).view(np.uint64)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """0 to 1 for two digests given as (number of features, chain)."""
    if not a[0] or not b[0]:
        return float(a[0] == b[0])
    if a[0] == b[0]:
        if np.array_equal(a[1], b[1]):
            return 1.0
        return (_likeness(a, b) + _likeness(b, a)) / 2
    return _likeness(a, b) if a[0] < b[0] else _likeness(b, a)


def _likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    n, chain = a
    weight = np.full(len(chain), LOAD)
    weight[-1] = n - LOAD * (len(chain) - 1)
    pb = np.bitwise_count(b[1]).sum(axis=1, dtype=np.int64)
    total = 0.0
    for f, w in zip(chain, weight, strict=True):
        pa_ = int(np.bitwise_count(f).sum())
        both = np.bitwise_count(b[1] & f).sum(axis=1, dtype=np.int64)
        chance, most = pa_ * pb / BITS, np.minimum(pa_, pb)
        noise = 3 * np.sqrt(chance)
        score = np.where(both - chance > noise, (both - chance) / np.maximum(most - chance, 1e-9), 0.0)
        score = np.where((both == most) & (pb == pa_), 1.0, score)
        total += w * min(1.0, float(score.max()))
    return total / n


def digest(h: np.ndarray) -> tuple[int, np.ndarray]:
    return len(h), filters(h)


def shown(d: tuple[int, np.ndarray]) -> str:
    """A digest as text: the number of features, a colon and the filters in base64."""
    return f"{d[0]}:{base64.b64encode(d[1].tobytes()).decode()}"


def parsed(text: str) -> tuple[int, np.ndarray]:
    n, data = text.split(":")
    return int(n), np.frombuffer(base64.b64decode(data), np.uint64).reshape(-1, BITS // 64)


def fingerprint(text: str | None) -> str:
    """The digest of one text."""
    return shown(digest(feature_hashes([utf8(text)])[0]))


SCHEMA = "kind int, pid int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def edited(text: str, following: str) -> str:
    """The text whose last half gives way to as many first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _compare(pairs: list[tuple], pid: int) -> list[tuple]:
    """Result rows of (doc_id, text, digest, next text, next digest)."""
    changed = [edited(t, nt) for _, t, _, nt, _ in pairs]
    out = []
    for (doc, text, own, _, following), e, h in zip(pairs, changed, feature_hashes([utf8(e) for e in changed]), strict=True):
        d = digest(h)
        out.append((0, pid, doc, len(text), sha256(utf8(e)).hexdigest(), shown(own), shown(d), likeness(own, d), likeness(own, following), None))
    return out


def _sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order: each with the next one; the task's first (kind 1) and last (kind 2) as texts."""
    pid, held = TaskContext.get().partitionId(), None
    for batch in batches:
        docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for lo in range(0, len(docs), 128):
            part = texts[lo : lo + 128]
            own = [digest(h) for h in feature_hashes([utf8(t) for t in part])]
            line = ([held] if held else []) + list(zip(docs[lo : lo + 128], part, own, strict=True))
            if held is None:
                yield _rows([(1, pid, line[0][0], None, None, None, None, None, None, line[0][1])])
            pairs = [(*a, b[1], b[2]) for a, b in zip(line, line[1:], strict=False)]
            if pairs:
                yield _rows(_compare(pairs, pid))
            held = line[-1]
    if held:
        yield _rows([(2, pid, held[0], None, None, None, None, None, None, held[1])])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True):
            a, b = (digest(h) for h in feature_hashes([utf8(text), utf8(following)]))
            rows += _compare([(doc, text, a, following, b)], 0)
        if rows:
            yield _rows(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    Texts are dealt once, by ranges of descending doc_id and a hash of the text. Neighbours meet inside a task; the first and last
    text of each task are matched afterwards.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = texts.repartitionByRange(ranges(texts), *order).sortWithinPartitions(*order, "text")
    done = cut(dealt.mapInArrow(_sequence, SCHEMA))
    first = done.where("kind = 1").select("pid", F.col("text").alias("next_text"))
    ids = done.where("kind = 2").select("pid")
    following = ids.selectExpr("pid", "coalesce(lead(pid) over (order by pid), min(pid) over ()) as next_pid")
    last = done.where("kind = 2").select("pid", "doc_id", "text").join(following, "pid")
    joined = last.join(first.withColumnRenamed("pid", "next_pid"), "next_pid").select("doc_id", "text", "next_text")
    every = done.where("kind = 0").unionByName(joined.mapInArrow(_borders, SCHEMA))
    return every.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
