"""N-gram Jaccard join with a MinHash LSH forest.

Every text gets `trees` MinHash sequences of `max_depth` values. In each tree the sequences are sorted, as
the leaves of a prefix trie; texts that share a prefix are candidates. The prefix starts at `max_depth` values and is
shortened, value by value, until the chance to lose a pair exactly at the threshold, the hardest one, is at most
`lost`. No sample of the texts decides it: with 16 trees and a threshold of 0.8 the prefix is one value, and a pair is lost with
a chance of 0.2**16, about 7 in 10**12. Longer prefixes lose pairs that are there (four values 2 in 10,000), so that there is
no exact rest to find beside them. Texts that share a value by chance are told apart by their sketches, in the canopies.

The sort is a range partitioning on (tree, sequence, text), so that a prefix which a third of all texts
share spreads over many tasks. Canopies join the candidates of a prefix into loose candidate groups with one
row for each member; groups that the borders of tasks cut are joined again by their leaders.

Candidate groups are then verified exactly, in blocks of bounded size, on the full shingle sets. Large groups are dealt by
the size of the sets first: sets can only link if their sizes are of one class or of neighbouring ones, so that blocks of
other classes never meet. Links are counted and never written as pairs.

Defined cases: a null text counts as empty; texts without a word link with nothing but share one class with
other texts of the same bytes; a text of fewer than k words is one shingle; exact copies share one class and
are not links of each other; null doc_ids keep their rows; repeated rows are copies; very long texts are read in blocks;
of copies alike the smallest doc_id represents them; further columns are ignored, and kept by `keep_one`, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.graph import components
from kinetrace.llm.text import minhash, multipliers, shingles
from kinetrace.operators import sets as sets_
from kinetrace.session import cut, partitions, prepare

#: Estimated likeness above which a canopy takes a text in, and above which the text needs no other canopy.
LOOSE, TIGHT, RIM = 0.5, 0.88, 0.4
#: Pairs that measure recall: how far above the threshold, and how many at least.
BAND, LEAST_PAIRS = 0.1, 200
#: The most bits of a block's incidence matrix that are held at a time.
MATRIX = sets_.MATRIX


def forest_depth(threshold: float, trees: int, max_depth: int, recall: float, measured: dict[int, int] | None = None) -> int:
    """The longest prefix that reaches the target recall.

    The chance of a pair at the threshold decides. Only where a caller states them, `measured` counts true pairs by the
    longest prefix that they share in some tree, and decides if there are enough; `near_duplicates` states none.
    """
    found = measured or {}
    pairs, depth = sum(found.values()), max_depth

    def reached() -> float:
        if pairs >= LEAST_PAIRS:
            return sum(n for d, n in found.items() if d >= depth) / pairs
        return 1 - (1 - threshold**depth) ** trees

    while depth > 1 and reached() < recall:
        depth -= 1
    return depth


class Sample:
    """Stated shingle sets with an index from shingle to sets, and their MinHash sequences: measures recall, and decides nothing."""

    def __init__(self, uids: list[int], sets: list[np.ndarray], mult: np.ndarray, trees: int, threshold: float):
        self.uids, self.size = uids, np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.size)[order]
        self.shingle, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.sig = np.stack([minhash(x, mult) for x in sets]) if sets else np.zeros((0, len(mult)), np.uint32)
        self.trees = trees
        low, high = Fraction(str(threshold)), Fraction(str(threshold)) + Fraction(str(BAND))
        self.low, self.high = (low.numerator, low.denominator), (high.numerator, high.denominator)

    def depths(self, uid: int, h: np.ndarray, sig: np.ndarray) -> list[int]:
        """For each stated partner just above the threshold: the longest prefix that it shares with a text in some tree."""
        at = np.searchsorted(self.shingle, h)
        at = at[at < len(self.shingle)] if len(at) and at[-1] == len(self.shingle) else at
        at = at[self.shingle[at] == h[: len(at)]]
        count = self.first[at + 1] - self.first[at]
        spread = np.repeat(self.first[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        both = np.bincount(self.owner[spread], minlength=len(self.uids))
        (p, q), (r, t) = self.low, self.high
        total = self.size + len(h)
        near = np.flatnonzero(((p + q) * both >= p * total) & ((r + t) * both < r * total))
        near = near[[self.uids[i] != uid for i in near.tolist()]] if len(near) else near
        same = (self.sig[near] == sig).reshape(len(near), self.trees, len(sig) // self.trees)
        return np.cumprod(same, axis=2).sum(axis=2).max(axis=1).tolist()


def _signer(k: int, trees: int, depth: int, kept: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = multipliers(trees * depth, 9)
        for batch in batches:
            size, sig, sketch = [], [], []
            for text in batch.column("text"):
                h = shingles(text.as_py(), k)
                size.append(len(h))
                m = minhash(h, mult) if len(h) else None
                sig.append(None if m is None else m.astype(">u4").reshape(trees, depth)[:, :kept].tobytes())
                sketch.append(None if m is None else (m & 0xFF).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("uid"), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary())],
                ["doc_id", "uid", "size", "sig", "sketch"],
            )

    return sign


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard index from 8-bit sketches; equal by chance once in 256."""
    return ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _canopies(depth: int):
    """Rows sorted by (tree, key, uid): edges of a text to the leaders near it, and the rim runs' leaders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, sketches, up, first = None, [], np.zeros((0, 1), np.uint8), [], True

        def rows(kind, a, b, run_key, sketch):
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([run_key] * n if run_key else [None] * n, pa.binary()), pa.array(sketch if sketch else [None] * n, pa.binary())],
                ["kind", "a", "b", "run", "sketch"],
            )

        def rim():
            return rows(1, ids, ids, current, [s.tobytes() for s in sketches])

        def root(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for batch in batches:
            keys = [t.to_bytes(4, "big") + k[: 4 * depth] for t, k in zip(batch.column("tree").to_pylist(), batch.column("key").to_pylist(), strict=True)]
            uid, sk = batch.column("uid").to_numpy(), _matrix(batch.column("sketch"))
            change = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            ea, eb = [], []
            for lo, hi in zip(change, change[1:], strict=False):
                if keys[lo] != current:
                    if first and current is not None:
                        yield rim()
                        first = False
                    current, ids, sketches, up = keys[lo], [], sk[:0], []
                left, leads = np.arange(lo, hi), np.full(hi - lo, -1)
                n = 0
                while len(left):
                    if n == len(ids):  # the next text that no canopy holds leads its own
                        ids.append(int(uid[left[0]]))
                        sketches = np.concatenate((sketches, sk[left[:1]])) if n else sk[left[:1]]
                        up.append(n)
                        if leads[left[0] - lo] >= 0:
                            up[n] = root(leads[left[0] - lo])
                        left = left[1:]
                    near = likeness(sk[left], sketches[n][None]) if len(left) else np.zeros(0)
                    hit = left[near >= LOOSE] - lo
                    # One edge a text, and one for each pair of canopies that a text joins anew.
                    for other in np.unique(leads[hit]).tolist():
                        if other >= 0 and root(other) != root(n):
                            ea.append(ids[n])
                            eb.append(ids[other])
                            up[root(other)] = root(n)
                    leads[hit[leads[hit] < 0]] = n
                    left = left[near < TIGHT]
                    n += 1
                led = np.flatnonzero(leads >= 0)
                ea += uid[lo + led].tolist()
                eb += [ids[k] for k in leads[led].tolist()]
            if ea:
                yield rows(0, ea, eb, None, None)
        if current is not None:
            yield rim()

    return run


def _stitch(pdf):
    """A spanning forest of the near leaders of one run that lie in different tasks."""
    import pandas as pd

    uid, sk = pdf["a"].to_numpy(), np.stack([np.frombuffer(x, np.uint8) for x in pdf["sketch"]])
    a, b, group = [], [], np.arange(len(uid))
    for i in range(len(uid) - 1):
        near = np.flatnonzero(likeness(sk[i + 1 :], sk[i][None]) >= RIM) + i + 1
        for other in np.unique(group[near]).tolist():
            if other != group[i]:
                a.append(uid[i])
                b.append(uid[near[group[near] == other][0]])
                group[group == other] = group[i]
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _shingled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), k).tobytes() for t in batch.column("text")]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, pa.field("text", pa.binary()), pa.array(sets, pa.binary()))

    return run


def linked_pairs(sets: list[np.ndarray], split: int, p: int, q: int) -> Iterator[tuple[int, np.ndarray]]:
    return sets_.linked_pairs(sets, split, p, q, MATRIX)


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    threshold: float = 0.8,
    trees: int = 16,
    max_depth: int = 6,
    lost: float = 1e-9,
    block_docs: int = 1000,
    block_shingles: int = 1_000_000,
) -> DataFrame:
    """One row for each document: doc_id, class_id, copy_of, n_copies, n_links (and its key uid).

    copy_of is the smallest doc_id with the same text, n_links counts the other texts whose shingle sets
    have a Jaccard index of `threshold` or more, class_id is the smallest doc_id that links lead to.
    """
    spark = prepare(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    depth = forest_depth(threshold, trees, max_depth, 1 - lost)
    signed = keyed.mapInArrow(_signer(k, trees, max_depth, depth), "doc_id long, uid long, size long, sig binary, sketch binary")
    reps = cut(signed.groupBy("uid").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"), *(F.first(c).alias(c) for c in ("size", "sig", "sketch"))))

    leaves = reps.where("sig is not null").select("uid", "sketch", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    leaves = leaves.select("tree", F.expr(f"substring(sig, tree * {4 * depth} + 1, {4 * depth})").alias("key"), "uid", "sketch")
    tries = leaves.repartitionByRange(partitions(spark), "tree", "key", "uid").sortWithinPartitions("tree", "key", "uid")
    found = cut(tries.mapInArrow(_canopies(depth), "kind int, a long, b long, run binary, sketch binary").where("kind = 1 or a <> b"))
    rims = found.where("kind = 1").dropDuplicates(["run", "a"]).groupBy("run").applyInPandas(_stitch, "a long, b long")
    loose = components(found.where("kind = 0").select("a", "b").unionByName(rims)).withColumnRenamed("node", "uid")

    full = sets_.verified(keyed.withColumnRenamed("doc_id", "id"), reps, loose, _shingled(k), threshold, block_docs, block_shingles)
    return keyed.select("doc_id", "uid").join(full, "uid").select("doc_id", "class_id", "copy_of", "n_copies", "n_links", "uid")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents, in their own columns, of which each class has one: the smallest doc_id."""
    verdict = near_duplicates(docs, **options).where("doc_id <=> class_id").select("doc_id", "uid").distinct().alias("v")
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("uid")
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key).alias("d")
    kept = d.join(verdict, F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("d.uid") == F.col("v.uid")), "left_semi")
    return kept.dropDuplicates(["doc_id", "uid"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
