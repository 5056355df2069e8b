"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback splits each word of a text. Three measures follow: characters per
token, the share of byte-fallback tokens, and the entropy of the document's tokens as a share of the most that
so many tokens can have. The bands of a language (of the script, where lang is null) are the quartiles of all its
documents that pass the base rules, widened by `spread` times their distance (at least a floor for
each measure); groups of fewer than LEAST documents use the bands of all documents. Documents outside a band
are rejected, as are those that fail the base rules: fewer than 20 words, or more than 30% of the words in
eight-word windows that the text repeats.

Defined cases: null and empty texts have zero counts and fail the base rules; texts of white space alone too;
null doc_ids keep their rows; repeated rows are judged alike, and values on a band's edge are inside; the words of very
long texts are measured whole; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.session import cut, prepare

SYMBOLS = "[#*$%&|<>]"
BLANKS = " \t\n\v\f\r"
GRAM = 8
CACHE = 150_000
LEAST, SPREAD = 50, 3.0
#: Band tables of up to so many rows (some 80 bytes each) go to all workers.
MOST_GROUPS = 100_000
#: Least distance between quartile and band: characters per token, byte share, entropy share.
FLOORS = {"chars_per_token": 0.1, "byte_share": 0.05, "token_entropy": 0.08}
MEASURES = tuple(FLOORS)

_models: dict[str, Pieces] = {}


class Pieces:
    """Token ids and byte-fallback counts of single words, from a sentencepiece vocabulary."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.known: dict[bytes, bytes] = {}

    def ids(self, word: bytes) -> bytes:
        found = np.array(self.model.encode(word.decode("utf-8", "replace")), np.int32).tobytes()
        if len(word) <= 40:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = found
        return found

    def measures(self, words: list[bytes], word_chars: int) -> tuple[float, float, float] | None:
        known, ids = self.known, self.ids
        tokens = np.frombuffer(b"".join([known.get(w) or ids(w) for w in words]), np.int32)
        if not len(tokens):
            return None
        n = np.unique(tokens, return_counts=True)[1] / len(tokens)
        entropy = float(-(n * np.log2(n)).sum()) / np.log2(max(2, len(tokens)))
        return word_chars / len(tokens), float(self.bytes[tokens].mean()), entropy


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def repeated_words(words: list[bytes], k: int = GRAM) -> int:
    """Words inside k-word windows that occur twice or more; hashes find candidates, the words decide."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = np.zeros(n, np.uint64)
    for i in range(k):
        window = window * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    order = np.sort(window)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(window, again))
    exact = Counter(tuple(words[i : i + k]) for i in at.tolist())
    at = np.array([i for i in at.tolist() if exact[tuple(words[i : i + k])] > 1], np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    """The script of most letters of a text: the first word of a letter's Unicode name."""
    found: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            found[unicodedata.name(c, "none").split()[0]] += n
    return "script " + (found.most_common(1)[0][0] if found else "none")


SCHEMA = "doc_id long, grp string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, byte_share double, token_entropy double"


def _measure(path: str):
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, *[pa.float64()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            rows = []
            for doc, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                data = text.encode("utf-8", "surrogatepass")
                words = data.split()
                chars = len(text) - sum(map(text.count, BLANKS))
                m = model.measures(words, chars) or (None, None, None)
                grp = script(text) if lang is None else lang
                rows.append((doc, grp, len(words), chars, sum(map(text.count, SYMBOLS[1:-1])), duplicate_lines(data), repeated_words(words), *m))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def bands(measured: DataFrame, spread: float = SPREAD, least: int = LEAST) -> DataFrame:
    """(grp, low and high of each measure) from the documents that pass the base rules."""
    good = measured.where("not base_failed and chars_per_token is not null")
    quartiles = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000)).alias(m) for m in MEASURES]
    out = good.groupBy("grp").agg(*quartiles, F.count("*").alias("n")).where(F.col("n") >= least)
    widths = {m: F.greatest((F.col(m)[1] - F.col(m)[0]) * spread, F.lit(FLOORS[m])) for m in MEASURES}
    edges = [x for m in MEASURES for x in ((F.col(m)[0] - widths[m]).alias(f"{m}_low"), (F.col(m)[1] + widths[m]).alias(f"{m}_high"))]
    return out.select("grp", *edges)


def quality_rules(docs: DataFrame, vocabulary: str, spread: float = SPREAD, least: int = LEAST) -> DataFrame:
    """One row for each document: the base counts, the measures, base_failed and kept."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(_measure(vocabulary), SCHEMA)
    rows = cut(rows.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")))
    by_group = cut(bands(rows, spread, least))
    if by_group.count() <= MOST_GROUPS:  # one row a language or script: a shuffle would deal documents to as many tasks
        by_group = F.broadcast(by_group)
    every = bands(rows.withColumn("grp", F.lit("all")), spread, 1).first()
    joined = rows.join(by_group, "grp", "left")
    inside = F.lit(True)
    for m in MEASURES:
        low, high = (F.coalesce(f"{m}_{x}", F.lit(None if every is None else every[f"{m}_{x}"]).cast("double")) for x in ("low", "high"))
        inside = inside & F.coalesce(F.col(m).between(low, high), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES
    )
