"""Mixing sources to target weights by systematic sampling.

A source's documents stand in the order of size (largest first), then of a hash of doc_id, then of doc_id. Each has
target / source size expected copies; their prefix sum plus one random offset, drawn by the source's name, is cut at the
integers, and a document is taken once for each integer boundary that it crosses. Every document so has its expected
copies over all offsets, and as the sizes fall along the order, a source's total misses its target by less than its
largest document (by more only of rounding).

The rank of a document in its source is a sum of three counts (of larger sizes, of smaller hashes within the
size, within the hash), so that no task orders a whole source. Rows that share doc_id, source and size are one row with
a count, and their copies are dealt out again at the end, so that a repeated or null doc_id is no hot key.

Defined cases: null and empty texts have size 0, are sampled as the others and add no words; a null source is
a source of its own, in last place; null doc_ids are kept, before all others of their size and hash; repeated rows have
successive ranks; equal sizes and hashes follow doc_id; sources without a word have the target 0 and nothing taken; an
empty table gives an empty result; further columns are ignored by `mix` and kept by `mixed_documents`, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.llm.text import WORD
from kinetrace.session import cut, prepare

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
LIMIT = 3
SLOTS = 4096
PAGE = 65_536


def _size() -> F.Column:
    n = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    return F.when(F.col("text").isNull(), 0).otherwise(n).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the slot (hash) of doc_id."""
    slot = F.expr(f"pmod(pmod(coalesce(doc_id, 0), 1000003) * 7919, {SLOTS})")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _size().alias("size"), slot.cast("long").alias("slot"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target: shares by weight, none above limit * source_size, the excess reshared.

    With sources in ascending order of limit * size / weight, a source is capped if its cap is no more than
    its share of what the capped ones before it leave; one row a source is ordered.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w.cast("long"))
    s = s.withColumn("cap", F.col("source_size") * limit)
    everything = Window.partitionBy()
    before = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("capped", F.col("cap") * F.col("rest_w") <= F.col("rest") * F.col("w"))
    free = F.sum("source_size").over(everything) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    free_w = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything)
    share = F.col("w").cast("double") * free.cast("double") / F.nullif(free_w.cast("double"), F.lit(0.0))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def offset():
    """The random offset of a source: a multiple of 2**-16, so that sums with it are exact."""
    digest = F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit("#0")))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65536


def _same(x: str, y: str, *names: str) -> F.Column:
    return reduce(lambda p, q: p & q, (F.col(f"{x}.{n}").eqNullSafe(F.col(f"{y}.{n}")) for n in names))


def planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row for each (doc_id, source, size): its number n of rows, `before` (rows ahead in its source), source_size, target, per_doc."""
    prepare(docs.sparkSession)
    rows = cut(sized(docs).groupBy("doc_id", "source", "size", "slot").agg(F.count("*").alias("n")))
    slots = rows.groupBy("source", "size", "slot").agg(F.sum("n").alias("n"))
    sizes = slots.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goals = targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, limit)
    ahead = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("source", "size", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("larger"))
    within = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("source", "size", "slot", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("smaller"))
    inside = Window.partitionBy("source", "size", "slot").orderBy(F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    r, a, b, g = ranked.alias("r"), slots.alias("a"), sizes.alias("b"), goals.alias("g")
    joined = r.join(a, _same("r", "a", "source", "size", "slot")).join(b, _same("r", "b", "source", "size")).join(g, _same("r", "g", "source"))
    per_doc = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    return joined.select("r.doc_id", "r.source", "r.size", "r.n", (F.col("larger") + F.col("smaller") + F.col("local")).alias("before"), "source_size", "target", per_doc.alias("per_doc"))


def _crossed(first, last) -> F.Column:
    """The integer boundaries between the prefix sums of the ranks `first` and `last`."""
    return (F.floor(offset() + last * F.col("per_doc")) - F.floor(offset() + first * F.col("per_doc"))).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken."""
    plan = planned(docs, weights, limit)
    # Rows alike are numbered in pages, so that no array grows with their number.
    plan = plan.withColumn("lo", F.explode(F.expr(f"sequence(0L, n - 1, {PAGE}L)")))
    plan = plan.withColumn("i", F.explode(F.expr(f"sequence(lo, least(n, lo + {PAGE}) - 1)")))
    rank = F.col("before") + F.col("i")
    plan = plan.withColumn("copies", _crossed(rank, rank + 1))
    return plan.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents in their own columns, each as often as the mix takes it.

    Rows that share doc_id, source and size share their copies: the first ones, by a hash of the text, get one more where
    these do not come out even.
    """
    before = F.col("before")
    plan = planned(docs, **options).select("doc_id", "source", "size", "n", _crossed(before, before + F.col("n")).alias("total")).where("total > 0")
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", _size().alias("size"))
    joined = d.alias("d").join(plan.alias("p"), _same("d", "p", "doc_id", "source", "size")).select("d.row", "p.*")
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("row.text")))
    joined = joined.withColumn("copies", F.expr("total div n") + F.when(nth <= F.expr("total % n"), 1).otherwise(0))
    repeated = joined.where("copies > 0").select("row", F.explode(F.expr("array_repeat(0, cast(copies as int))")))
    return repeated.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def mix_sql() -> str:
    """The DuckDB SQL that gives doc_id, size, source_size, target and taken of `mix` with its defaults."""
    size = r"CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END"
    return rf"""
    WITH d AS (SELECT doc_id, source, CAST({size} AS BIGINT) AS size,
                      ((coalesce(doc_id, 0) % 1000003) * 7919) % {SLOTS} AS slot FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, 3 * source_size AS cap,
                 CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
    p AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest_w
          FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, cap * rest_w <= rest * w AS capped FROM p),
    t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
                 CAST(w AS DOUBLE) * CAST(sum(source_size) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE)
                 / nullif(CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS DOUBLE), 0) END AS target FROM c),
    r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(t.target / nullif(CAST(t.source_size AS DOUBLE), 0), 0) AS per_doc,
                 row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.slot, d.doc_id NULLS FIRST) AS rank
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    o AS (SELECT source, CAST('0x' || substr(md5(coalesce(source, '') || '#0'), 1, 4) AS BIGINT) / 65536.0::DOUBLE AS off FROM t)
    SELECT r.doc_id, r.size, r.source_size, r.target,
           CAST((floor(o.off + r.rank * r.per_doc) - floor(o.off + (r.rank - 1) * r.per_doc)) * r.size AS BIGINT) AS taken
    FROM r JOIN o ON r.source IS NOT DISTINCT FROM o.source"""
