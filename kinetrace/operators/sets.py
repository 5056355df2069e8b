"""Similarity join of sets: all links at a Jaccard index, exactly, without a row for each of them.

Sets are arrays of 64-bit hashes of their members. Members are ordered by their frequency in all sets, from the rarest on;
the most frequent ones (at most `listed`) are sent to the workers with their counts, all others come before them
in the order of their hashes. Any one order gives exact results, so that the bound costs time alone. The members of a
prefix are dealt by hash, packed in binary columns, and meet there:

* A pair at the threshold shares at least l members (1 to 5, by the smaller set's size) at positions that leave
  room for the rest. Groups of at most SMALL sets give such pairs, which are counted.
* Larger groups give no pairs. There, sets are joined whose parity bitmaps (bit b: whether an odd number of members fall
  on b) do not differ in more bits than two sets at the threshold can differ in members. A spanning forest is kept.

Both ways keep every pair at the threshold; what they connect is compared exactly, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.operators.graph import components
from kinetrace.session import cut, partitions, prepare

#: The most bits of a block's incidence matrix that are held at a time.
MATRIX = 1 << 26
#: The largest group that gives pairs, bits of a parity bitmap, and prefix rows that a task packs at a time.
SMALL, BITS, PACKED = 256, 1024, 1 << 19
#: The most rows of one side of the join of texts with their blocks that are broadcast.
BROADCAST = 200_000
COUNT = np.dtype([("h", "<u8"), ("n", "<u4")])
ENTRY = np.dtype([("h", "<u8"), ("uid", "<i8"), ("n", "<u4"), ("r", "<u4")])


def linked_pairs(sets: list[np.ndarray], split: int, p: int, q: int, matrix: int = MATRIX) -> Iterator[tuple[int, np.ndarray]]:
    """For each i the j > i with a Jaccard index of p/q or more; split > 0: only pairs across that position."""
    size = np.array([len(x) for x in sets])
    n = len(sets)
    if n <= 4:
        for i in range(n - 1):
            js = [j for j in range(max(i + 1, split), n) if (i < split or not split) and (p + q) * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= p * (size[i] + size[j])]
            yield i, np.array(js, dtype=np.int64)
        return
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count >= 2
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = np.repeat(np.arange(n), size)[keep], place[column[keep]]
    width, step = int(shared.sum()), max(64, matrix // n // 64 * 64)

    def packed(lo: int) -> np.ndarray:
        here = (column >= lo) & (column < lo + step)
        bits = np.zeros((n, -(-min(step, width - lo) // 64) * 64), dtype=bool)
        bits[row[here], column[here] - lo] = True
        return np.packbits(bits, axis=1).view(np.uint64)

    def common(x: np.ndarray, i: int) -> np.ndarray:
        return np.bitwise_count(x[max(i + 1, split) :] & x[i]).sum(axis=1, dtype=np.int64)

    ends = range(split or n - 1)
    if width <= step:
        x = packed(0) if width else np.zeros((n, 0), np.uint64)
        both = (common(x, i) for i in ends)
    else:  # a wide block is counted in parts of its columns
        sums = [0] * len(ends)
        for lo in range(0, width, step):
            x = packed(lo)
            sums = [sums[i] + common(x, i) for i in ends]
        both = iter(sums)
    for i in ends:
        lo = max(i + 1, split)
        yield i, np.flatnonzero((p + q) * next(both) >= p * (size[lo:] + size[i])) + lo


def verifier(threshold: float):
    """Rows sorted by (component, bi, bj): the links of each set within its block, and a set of its class there."""
    frac = Fraction(str(threshold))
    p, q = frac.numerator, frac.denominator

    def solve(uid, chunk, sets):
        order = sorted(range(len(uid)), key=lambda i: (chunk[i], uid[i]))
        order = [i for n, i in enumerate(order) if not n or uid[order[n - 1]] != uid[i]]
        ids, sets = np.array([uid[i] for i in order]), [sets[i] for i in order]
        chunks = [chunk[i] for i in order]
        split = chunks.index(chunks[-1]) if chunks[0] != chunks[-1] else 0
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, js in linked_pairs(sets, split, p, q):
            if len(js):
                links[i] += len(js)
                links[js] += 1
                roots = np.unique(np.append(label[js], label[i]))
                if len(roots) > 1:
                    label[np.isin(label, roots)] = roots[0]
        return ids, links, ids[label]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, ([], [], [])

        def done():
            out = solve(*group) if not key or key[1] == key[2] or len(set(group[1])) > 1 else None
            if out is None or not out[1].any():
                return None
            hit = out[1] > 0
            return pa.RecordBatch.from_arrays([pa.array(x[hit], pa.int64()) for x in out], ["uid", "links", "root"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("component", "bi", "bj", "uid", "chunk", "text")]
            for component, bi, bj, uid, chunk, data in zip(*cols, strict=True):
                if (component, bi, bj) != key:
                    if key is not None and (out := done()) is not None:
                        yield out
                    key, group = (component, bi, bj), ([], [], [])
                for x, y in zip(group, (uid, chunk, np.frombuffer(data, np.uint64)), strict=True):
                    x.append(y)
        if key is not None and (out := done()) is not None:
            yield out

    return run


def meetings(sized: DataFrame, threshold: float, block_docs: int, block_shingles: int) -> DataFrame:
    """(uid, component, copy_of, chunk, bi, bj): a text's block, and the pairs of blocks in which it is compared."""
    parts = F.ceil(F.greatest(F.count("*") / block_docs, F.sum("size") / block_shingles))
    wholes = sized.groupBy("component").agg(parts.alias("whole"))
    # A little wider than the threshold asks, so that rounding never sets two sizes that can link two classes apart.
    of_size = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1.01 / threshold))).cast("long")
    classed = sized.join(wholes, "component").withColumn("class", F.when(F.col("whole") > 1, of_size).otherwise(F.lit(0)).cast("long"))
    classed = cut(classed.select("uid", "component", "copy_of", "size", "class"))
    blocks = classed.groupBy("component", "class").agg(parts.cast("long").alias("parts"))
    chunk = F.expr("shiftleft(class, 32) + pmod(hash(uid), parts)")
    placed = classed.join(blocks, ["component", "class"]).select("uid", "component", "copy_of", "class", chunk.alias("chunk"))
    near = blocks.select("component", F.explode(F.expr("array(class - 1, class, class + 1)")).alias("class"), F.col("class").alias("met"), "parts")
    met = placed.join(near, ["component", "class"]).select("uid", "component", "copy_of", "chunk", "met", F.explode(F.expr("sequence(0L, parts - 1)")).alias("j"))
    other = F.expr("shiftleft(met, 32) + j")
    return met.select("uid", "component", "copy_of", "chunk", F.least("chunk", other).alias("bi"), F.greatest("chunk", other).alias("bj"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The members of a list column, one after another, and where each row begins."""
    start = column.offsets.to_numpy()
    return column.values.to_numpy()[start[0] : start[-1]].view(np.uint64), start - start[0]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, uid, size, bits): each set's size and parity bitmap; rows of counts alone: packed members and how many sets hold them."""
    names = ["id", "uid", "size", "bits", "counts"]
    held, n = [], 0

    def counted():
        h, count = np.unique(np.concatenate(held), return_counts=True)
        e = np.empty(len(h), COUNT)
        e["h"], e["n"] = h, count
        full = pa.array([e[at : at + (1 << 16)].tobytes() for at in range(0, len(e), 1 << 16)], pa.binary())
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(full), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())), full], names)

    for batch in batches:
        h, start = _lists(batch.column("w"))
        bits = []
        for lo, hi in zip(start, start[1:], strict=False):
            odd = np.bincount((h[lo:hi] % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
            bits.append(np.packbits(odd.astype(bool)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("uid"), pa.array(np.diff(start), pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(bits), pa.binary())], names)
        held.append(h.copy())
        n += len(h)
        if n >= PACKED * 4:
            yield counted()
            held, n = [], 0
    if n:
        yield counted()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("counts").to_pylist():
            e = np.frombuffer(data, COUNT)
            yield pa.RecordBatch.from_arrays([pa.array(e["h"].astype(np.int64)), pa.array(e["n"].astype(np.int64))], ["h", "n"])


def shared_at_least(n):
    """How many members of their prefixes a pair must share, by the smaller size."""
    return 1 + np.minimum(n // 32, 4)


def _prefixes(frequent, p: int, q: int, buckets: int):
    """Packed prefix members, by bucket of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = frequent.value
        held, n = [], 0

        def out():
            e = np.concatenate(held)
            bucket = (e["h"] >> np.uint64(20)) % np.uint64(buckets)
            e = e[np.argsort(bucket, kind="stable")]
            ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))
            full = [(b, e[lo:hi].tobytes()) for b, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False)) if hi > lo]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in full], pa.int32()), pa.array([x for _, x in full], pa.binary())], ["bucket", "data"])

        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            h, start = _lists(batch.column("w"))
            size = np.diff(start)
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            df = np.where(known[at] == h, often[at], 0) if len(known) else np.zeros(len(h), np.int64)
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((h, df, row))
            r = np.arange(len(h)) - np.repeat(start[:-1], size) + 1
            long = size - -(-p * size // q) + shared_at_least(size)
            keep = r <= np.repeat(long, size)
            e = np.empty(int(keep.sum()), ENTRY)
            uid = batch.column("uid").to_numpy()
            e["h"], e["uid"], e["n"], e["r"] = h[order][keep], uid[row[keep]], size[row[keep]], r[keep]
            held.append(e)
            n += len(e)
            if n >= PACKED:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return run


def _met(p: int, q: int, small: int = SMALL):
    """Rows sorted by bucket: (a, b, k, least) of pairs in small groups, (a, null, null, null, h) of members of large ones."""

    def solve(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        e = np.frombuffer(b"".join(blobs), ENTRY)
        e = e[np.lexsort((e["uid"], e["n"], e["h"]))]
        e = e[np.append(True, (e["h"][1:] != e["h"][:-1]) | (e["uid"][1:] != e["uid"][:-1]))]  # copies meet as one
        h, uid, n, r = e["h"], e["uid"], e["n"].astype(np.int64), e["r"].astype(np.int64)
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        count = np.diff(np.append(first, len(h)))
        of = np.repeat(count, count)
        large = np.flatnonzero(of > small)
        if len(large):
            none = pa.nulls(len(large), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(uid[large]), none, none, none, pa.array(h[large].view(np.int64))], ["a", "b", "k", "least", "h"])
        left = np.repeat(first + count, count) - np.arange(len(h)) - 1  # members of the group behind each
        left[of > small] = 0
        i, step, found = np.flatnonzero(left > 0), 0, []
        while len(i):
            step += 1
            i = i[left[i] >= step]
            j = i + step
            near = q * n[i] >= p * n[j]  # sizes rise: a set without a partner here has none further on
            i, j = i[near], j[near]
            need = -(-p * (n[i] + n[j]) // (p + q))
            least = np.minimum(shared_at_least(n[i]), need)
            hit = (n[i] - r[i] + least >= need) & (n[j] - r[j] + least >= need)
            if hit.any():
                found.append(np.stack((uid[i[hit]], uid[j[hit]], least[hit])))
        if found:
            a, b, least = np.concatenate(found, axis=1)
            order = np.lexsort((b, a))
            a, b, least = a[order], b[order], least[order]
            new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            k = np.diff(np.append(new, len(a)))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (a[new], b[new], k, least[new])), pa.nulls(len(new), pa.int64())], ["a", "b", "k", "least", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for x, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if x != bucket and held:
                    yield from solve(held)
                    held = []
                bucket = x
                held.append(data)
        if held:
            yield from solve(held)

    return run


def _forest(p: int, q: int):
    """A spanning forest of the sets of one large group whose bitmaps leave room for a link."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["size", "uid"])
        uid, size = pdf["uid"].to_numpy(), pdf["size"].to_numpy()
        bits = np.frombuffer(b"".join(pdf["bits"]), np.uint64).reshape(len(uid), -1)
        a, b, group = [], [], np.arange(len(uid))
        for i in range(len(uid) - 1):
            end = np.searchsorted(size, size[i] * q // p, side="right")
            js = np.arange(i + 1, end)[group[i + 1 : end] != group[i]]
            if len(js):
                apart = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64)
                js = js[(p + q) * apart <= (q - p) * (size[js] + size[i])]
                for other, first in zip(*np.unique(group[js], return_index=True), strict=True):
                    a.append(uid[i])
                    b.append(uid[js[first]])
                    group[group == other] = group[i]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _frequent(packed: DataFrame, listed: int) -> tuple[np.ndarray, np.ndarray]:
    """The members of the highest counts, at most `listed`, and their counts; ties at the lowest are left out together."""
    counts = cut(packed.mapInArrow(_unpacked, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    left, least = listed, None
    for n, members in sorted((tuple(r) for r in counts.groupBy("n").count().collect()), reverse=True):
        if members > left:
            break
        left, least = left - members, n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.where(F.col("n") >= least).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        h, start = _lists(batch.column(at))
        data = [np.sort(h[lo:hi]).tobytes() for lo, hi in zip(start, start[1:], strict=False)]
        yield batch.set_column(at, pa.field("text", pa.binary()), pa.array(data, pa.binary()))


def verified(rows: DataFrame, reps: DataFrame, loose: DataFrame, to_sets, threshold: float, block_docs: int, block_members: int) -> DataFrame:
    """(uid, class_id, copy_of, n_copies, n_links) of all `reps` (uid, copy_of, n_copies, size), whose links lie within `loose` (uid, component).

    rows (id, uid, text) hold a text for each of them, of which `to_sets` makes the sorted hashes. Where few rows of blocks
    are wanted, they are broadcast, so that the texts stay in place.
    """
    spark = rows.sparkSession
    sized = loose.join(reps.select("uid", "copy_of", "size"), "uid")
    met = cut(meetings(sized, threshold, block_docs, block_members))
    wanted = met.groupBy("uid", "component", "copy_of", "chunk").agg(F.collect_list(F.struct("bi", "bj")).alias("pairs"))
    if met.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    texts = rows.alias("d").join(wanted.alias("w"), (F.col("d.uid") == F.col("w.uid")) & F.col("d.id").eqNullSafe(F.col("w.copy_of")))
    sets = texts.select("d.uid", "component", "chunk", "pairs", "text").mapInArrow(to_sets, "uid long, component long, chunk long, pairs array<struct<bi long, bj long>>, text binary")
    paired = sets.select("component", F.inline("pairs"), "uid", "chunk", "text")
    paired = paired.repartition(partitions(spark), "component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
    linked = cut(paired.mapInArrow(verifier(threshold), "uid long, links long, root long"))
    classes = components(linked.select(F.col("uid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "uid")
    counts = linked.groupBy("uid").agg(F.sum("links").alias("n_links"))
    full = reps.select("uid", "copy_of", "n_copies").join(classes, "uid", "left").join(counts, "uid", "left")
    full = full.withColumn("component", F.coalesce("component", "uid"))
    heads = full.groupBy("component").agg(F.min("copy_of").alias("class_id"))
    return full.join(heads, "component").select("uid", "class_id", "copy_of", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def alike(items: DataFrame, threshold: float, id_: str = "id", words: str = "words", listed: int = 1 << 18, block_docs: int = 1000, block_members: int = 1_000_000) -> DataFrame:
    """One row for each item: id, class_id, copy_of, n_copies, n_links.

    copy_of is the smallest id with the same set of words and n_copies the number of such rows; n_links counts the other sets
    with a Jaccard index of `threshold` or more, and class_id is the smallest id that links lead to. Links are exact, up to
    collisions of 64-bit hashes. Items without a word are alone, null ids keep their rows.
    """
    spark = prepare(items.sparkSession)
    frac = Fraction(str(threshold))
    p, q = frac.numerator, frac.denominator
    hashed = F.sort_array(F.array_distinct(F.transform(F.filter(words, lambda x: x.isNotNull()), lambda x: F.xxhash64(x))))
    every = items.select(F.col(id_).cast("long").alias("id"), F.coalesce(hashed, F.array().cast("array<long>")).alias("w"))
    every = every.select("id", F.xxhash64("w").alias("uid"), "w")
    seen = cut(every.mapInArrow(_described, "id long, uid long, size long, bits binary, counts binary"))
    described = seen.where("size > 0")
    reps = cut(described.groupBy("uid").agg(F.min("id").alias("copy_of"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bits").alias("bits")))

    frequent = spark.sparkContext.broadcast(_frequent(seen.where("counts is not null").select("counts"), listed))
    packed = every.select("uid", "w").mapInArrow(_prefixes(frequent, p, q, 4 * partitions(spark)), "bucket int, data binary")
    packed = packed.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    met = cut(packed.mapInArrow(_met(p, q), "a long, b long, k long, least long, h long"))
    pairs = met.where("h is null").groupBy("a", "b").agg(F.sum("k").alias("k"), F.max("least").alias("least")).where("k >= least").select("a", "b")
    large = met.where("h is not null").select("h", F.col("a").alias("uid")).join(reps.select("uid", "size", "bits"), "uid")
    forests = large.groupBy("h").applyInPandas(_forest(p, q), "a long, b long")
    loose = components(pairs.unionByName(forests)).withColumnRenamed("node", "uid")

    full = verified(every.withColumnRenamed("w", "text"), reps, loose, _as_bytes, threshold, block_docs, block_members)
    alone = seen.where("size = 0").select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return described.select("id", "uid").join(full, "uid").select(*alone.columns).unionByName(alone)
