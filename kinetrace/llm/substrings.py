"""Substring dedup: paragraphs that repeat across documents.

Paragraphs are (a) the lines of a text with `least` (five) words or more and (b) content-anchored windows of exactly
`window` words, which start where a five-word shingle has the least hash of `anchors` successive ones. Any
passage of `window + anchors - 1` words (51) has an anchored window wholly inside it, wherever it stands in a
line, and the same one in each copy.

Paragraph MinHash banding: a line has `bands` bands of `rows` MinHash values, tuned so that a pair at the
threshold collides with a chance of 1 - (1 - threshold**rows)**bands (0.997). A window, of which a
repeated passage holds several, has one band of all its words, its hash. Colliding lines are verified by the
exact Jaccard index of their shingle sets, first with the leader of their band bucket, and where a line is unlike
its leader each with each, and clustered by connected components; equal paragraphs are one node. Of each cluster that spans several documents the
instance with the smallest (doc_id, start) stays and the others are removals.

Defined cases: null text counts as empty; documents without a long enough paragraph have no row; null
doc_ids are taken as one document; rows that repeat a doc_id are taken as one document; a paragraph that
repeats only inside one document is no repeat across documents; very long texts are read in overlapping blocks; of
instances alike the one with the smallest (doc_id, start) stays; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.llm.graph import components
from kinetrace.llm.text import U, minhash, mix, multipliers, shingles, span_hashes, utf8, word_blocks, word_bounds
from kinetrace.operators.sets import verifier
from kinetrace.session import cut, partitions, prepare

NO_ID = -(1 << 63)


def anchored_windows(text: str | None, window: int, anchors: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the content-anchored windows of a text."""
    hs, at = [], []
    for first, joined in word_blocks(text, window + anchors - 2):
        s, e = word_bounds(joined)
        n = len(s) - window + 1
        if n <= 0:
            continue
        h = span_hashes(joined, s[: len(s) - 4], e[4:])
        w = min(anchors, len(h))
        low = np.lib.stride_tricks.sliding_window_view(h, w).argmin(axis=1)
        pos = np.unique(low + np.arange(len(low)))
        pos = pos[pos < n]
        hs.append(span_hashes(joined, s[pos], e[pos + window - 1]))
        at.append(pos + first)
    if not hs:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at, once = np.unique(np.concatenate(at), return_index=True)
    return np.concatenate(hs)[once], at


def long_lines(text: str | None, least: int) -> Iterator[tuple[int, int, bytes]]:
    """(first word, number of words, words joined by one space) of the lines with `least` words or more."""
    first = 0
    for line in utf8(text).split(b"\n"):
        found = line.split()
        if len(found) >= least:
            yield first, len(found), b" ".join(found)
        first += len(found)


def _groups(lines: list[bytes], most: int = 1 << 16) -> Iterator[list[bytes]]:
    """Runs of lines of about `most` bytes; the hashes of one run are computed together."""
    held, size = [], 0
    for line in lines:
        if held and size + len(line) > most:
            yield held
            held, size = [], 0
        held.append(line)
        size += len(line)
    if held:
        yield held


def line_hashes(lines: list[bytes]) -> np.ndarray:
    """One hash for each line of words joined by one space."""
    out = []
    for group in _groups(lines):
        size = np.array([len(x) for x in group])
        ends = np.cumsum(size + 1) - 1
        out.append(mix(span_hashes(b" ".join(group), ends - size, ends) ^ U(0x5C)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def line_minhashes(lines: list[bytes], mult: np.ndarray, k: int = 5) -> np.ndarray:
    """A row of MinHash values for each line of a word or more, over its k-word shingles."""
    out = []
    for group in _groups(lines):
        if len(group[0]) > 1 << 20:  # one very long line is read in blocks
            out.append(minhash(shingles(group[0].decode("utf-8", "surrogatepass"), k), mult).astype(U)[None])
            continue
        joined = b" ".join(group)
        s, e = word_bounds(joined)
        n = np.array([x.count(b" ") + 1 for x in group])
        wide = np.minimum(n, k)
        count, word = n - wide + 1, np.cumsum(n) - n
        begin = np.cumsum(count) - count
        line = np.repeat(np.arange(len(group)), count)
        at = np.arange(len(line)) + (word - begin)[line]
        h = span_hashes(joined, s[at], e[at + wide[line] - 1])
        out.append(np.stack([np.minimum.reduceat((h * m) >> U(32), begin) for m in mult], axis=1))
    return np.concatenate(out)


def _paragraphs(window: int, anchors: int, least: int):
    names = ["h", "doc_id", "start", "n"]

    def flush(cols, lines):
        cols[0].append(line_hashes([x[3] for x in lines]))
        for i in range(3):
            cols[i + 1].append(np.array([x[i] for x in lines], np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, lines = [[], [], [], []], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h, at = anchored_windows(text, window, anchors)
                lines += [(doc, *x) for x in long_lines(text, least)]
                for col, x in zip(cols, (h.astype(np.int64), np.full(len(h), doc, np.int64), at, np.full(len(h), window, np.int64)), strict=True):
                    col.append(x)
                if len(cols[0]) >= 256:
                    yield flush(cols, lines)
                    cols, lines = [[], [], [], []], []
            if cols[0]:
                yield flush(cols, lines)

    return run


def _banded(least: int, bands: int, rows: int):
    mult = multipliers(bands * rows, 2)

    def flush(found):
        lines = [x[3] for x in found]
        m = line_minhashes(lines, mult).reshape(len(found), bands, rows)
        key = np.tile(np.arange(1, bands + 1, dtype=U), (len(found), 1))
        for r in range(rows):
            key = mix(key ^ m[:, :, r]) + U(r)
        keys = pa.ListArray.from_arrays(np.arange(0, key.size + 1, bands, dtype=np.int32), key.astype(np.int64).ravel())
        return pa.RecordBatch.from_arrays([keys, pa.array(line_hashes(lines)), *(pa.array([x[i] for x in found], pa.int64()) for i in range(3))], ["keys", "h", "doc_id", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found += [(doc, *x) for x in long_lines(text, least)]
                if len(found) >= 1024:
                    yield flush(found)
                    found = []
            if found:
                yield flush(found)

    return run


def _line_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, starts in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            want = {(x["start"], x["n"]): x["h"] for x in starts}
            for first, n, line in long_lines(text, min(x["n"] for x in starts)):
                if (first, n) in want and line_hashes([line])[0] == want[first, n]:
                    out.append((want[first, n], shingles(line.decode("utf-8", "surrogatepass")).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["h", "set"])


def _jaccard(threshold: float):
    frac = Fraction(str(threshold))
    p, q = frac.numerator, frac.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                good.append((p + q) * len(np.intersect1d(x, y, assume_unique=True)) >= p * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _bucket_links(members: DataFrame, edges: DataFrame, good: DataFrame, sets: DataFrame, threshold: float, block_lines: int, block_shingles: int) -> DataFrame:
    """(a, b) of verified lines of the buckets in which a line is unlike the leader: all their other pairs are compared.

    Where all lines are like the leader, they are one cluster already. A bucket is compared in blocks of bounded size.
    """
    failed = edges.join(good, ["a", "b"], "left_anti").select(F.col("a").alias("h"), F.col("b").alias("lead"))
    unlike = members.join(failed, ["h", "lead"], "left_semi").select("key").distinct()
    inside = cut(members.join(unlike, "key", "left_semi").select("key", "h", "n"))
    size = F.greatest(F.count("*") / block_lines, F.sum("n") / block_shingles)
    blocks = inside.groupBy("key").agg(F.ceil(size).cast("int").alias("parts"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("h")).alias("sig")).where("m > 1")
    blocks = blocks.dropDuplicates(["m", "sig"])  # the same lines meet in several bands
    dealt = inside.join(blocks, "key").select("key", "h", "parts", F.pmod(F.hash("h"), "parts").alias("chunk"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.join(sets, "h").select(F.col("key").alias("component"), F.least("chunk", "other").alias("bi"), F.greatest("chunk", "other").alias("bj"), F.col("h").alias("uid"), "chunk", F.col("set").alias("text"))
    dealt = dealt.repartition(partitions(sets.sparkSession), "component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
    return dealt.mapInArrow(verifier(threshold), "uid long, links long, root long").select(F.col("uid").alias("a"), F.col("root").alias("b")).where("a <> b")


def line_clusters(texts: DataFrame, least: int, bands: int, rows: int, threshold: float, block_lines: int = 1000, block_shingles: int = 100_000) -> DataFrame:
    """(h, cluster) of the lines that are verified near copies of other, different lines."""
    banded = texts.mapInArrow(_banded(least, bands, rows), "keys array<long>, h long, doc_id long, start long, n long")
    # Equal lines become one row before their bands are dealt out.
    lines = cut(banded.groupBy("h").agg(F.min(F.struct("doc_id", "start", "n")).alias("x"), F.first("keys").alias("keys")))
    keyed = lines.select("h", F.col("x.n").alias("n"), F.explode("keys").alias("key"))
    ranked = Window.partitionBy("key").orderBy(F.xxhash64("h", "key"), "h")
    members = cut(keyed.withColumn("lead", F.first("h").over(ranked)).where("h <> lead"))
    edges = cut(members.select(F.col("h").alias("a"), F.col("lead").alias("b")).distinct())
    wanted = edges.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    one = lines.select("h", "x").join(wanted, "h", "left_semi")
    per_doc = one.groupBy("x.doc_id").agg(F.collect_list(F.struct("h", "x.start", "x.n")).alias("wanted"))
    sets = texts.join(per_doc, "doc_id").select("text", "wanted").mapInArrow(_line_sets, "h long, set binary").dropDuplicates(["h"])
    sets = cut(sets)
    pairs = edges.join(sets.select(F.col("h").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("h").alias("b"), F.col("set").alias("sb")), "b")
    good = cut(pairs.select("a", "b", "sa", "sb").mapInArrow(_jaccard(threshold), "a long, b long"))
    good = good.unionByName(_bucket_links(members, edges, good, sets, threshold, block_lines, block_shingles))
    return components(good).select(F.col("node").alias("h"), F.col("component").alias("cluster"))


def _merged(parts: str) -> str:
    """SQL: the union of sorted half-open spans in an array of structs (start, n)."""
    return f"""aggregate({parts}, cast(array() as array<struct<s:bigint,e:bigint>>),
        (acc, x) -> if(size(acc) > 0 and x.start <= element_at(acc, -1).e,
            concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', greatest(element_at(acc, -1).e, x.start + x.n)))),
            concat(acc, array(named_struct('s', x.start, 'e', x.start + x.n)))))"""


def repeated_passages(docs: DataFrame, window: int = 32, anchors: int = 20, bands: int = 8, rows: int = 3, threshold: float = 0.8, least: int = 5, report: int = 1) -> DataFrame:
    """One row for each document with a passage of `report` words or more that repeats in another document.

    The passage is a merged span: lines and windows that touch are one. Documents that share no more than a licence line
    or another short line are left alone by a `report` above its length; in the others such lines are still in the spans.
    doc_id, repeated_words, removed_words, spans and removed_spans ('start:end' in words, comma-joined),
    keep_ids (the documents that keep its passages) and n_clusters.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = texts.mapInArrow(_paragraphs(window, anchors, least), "h long, doc_id long, start long, n long")
    similar = cut(line_clusters(texts, least, bands, rows, threshold))
    nodes = parts.groupBy("h").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last"))
    mapped = nodes.join(similar, "h", "left").where("first.doc_id <> last or cluster is not null")
    mapped = cut(mapped.withColumn("cluster", F.coalesce("cluster", "h")))
    heads = mapped.groupBy("cluster").agg(F.min("first").alias("keep"), F.max("last").alias("last")).where("keep.doc_id <> last")
    repeated = mapped.select("h", "cluster").join(heads, "cluster")
    hits = parts.join(repeated, "h").select("doc_id", "start", "n", "cluster", F.col("keep.doc_id").alias("keep_id"), F.expr("doc_id <> keep.doc_id or start <> keep.start").alias("removed"))
    span = F.struct("start", "n")
    per_doc = hits.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(span)).alias("all_parts"),
        F.array_sort(F.collect_set(F.when(F.col("removed"), span))).alias("cut_parts"),
        F.array_sort(F.collect_set("keep_id")).alias("keep_ids"),
        F.size(F.collect_set("cluster")).alias("n_clusters"),
    )
    out = per_doc.withColumn("s", F.expr(_merged("all_parts"))).withColumn("r", F.expr(_merged("cut_parts")))
    total = "aggregate({0}, 0L, (a, x) -> a + x.e - x.s)"
    shown = "array_join(transform({0}, x -> concat(x.s, ':', x.e)), ',')"
    out = out.where(F.expr(f"array_max(transform(s, x -> x.e - x.s)) >= {report}"))
    return out.select(
        F.expr(f"nullif(doc_id, {NO_ID + 1} - 1)").alias("doc_id"),
        F.expr(total.format("s")).alias("repeated_words"),
        F.expr(total.format("r")).alias("removed_words"),
        F.expr(shown.format("s")).alias("spans"),
        F.expr(shown.format("r")).alias("removed_spans"),
        "keep_ids",
        "n_clusters",
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("removed_spans").to_pylist(), strict=True):
            if spans:
                found = [m.span() for m in word.finditer(text)]
                at, kept = 0, []
                for s, e in (map(int, x.split(":")) for x in spans.split(",")):
                    kept.append(text[at : found[s][0]])
                    at = found[e - 1][1]
                text = "".join([*kept, text[at:]])
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def remove_passages(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text) of every document, without the passages that an earlier document keeps."""
    spans = repeated_passages(docs, **options).select("doc_id", "removed_spans").alias("s")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").alias("t")
    joined = texts.join(spans, F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")), "left")
    return joined.select("t.doc_id", "text", "removed_spans").mapInArrow(_without, "doc_id long, text string")
