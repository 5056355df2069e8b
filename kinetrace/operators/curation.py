"""Curation: allow-listed predicates, listings, slice impact and build coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)),
}


def predicate(document: dict, allowed: set[str]) -> Column:
    """{"all": [..]}, {"any": [..]}, {"not": ..} or {"field", "op", "value"} as a column; other fields are refused."""
    if "all" in document or "any" in document:
        parts = [predicate(x, allowed) for x in document.get("all", document.get("any"))]
        if not parts:
            return F.lit("all" in document)
        return reduce((lambda a, b: a & b) if "all" in document else (lambda a, b: a | b), parts)
    if "not" in document:
        return ~predicate(document["not"], allowed)
    if document.get("field") not in allowed or document.get("op") not in _OPS:
        raise ValueError(f"not allowed: {document}")
    return _OPS[document["op"]](F.col(document["field"]), document["value"])


def page(rows: DataFrame, keys: list[tuple[str, bool]], limit: int, after: tuple | None = None) -> DataFrame:
    """Keyset pagination on (column, descending) keys: rows after a cursor, in order. Spark keeps the top rows of each task."""
    if after is not None:
        conditions = []
        for i, (c, desc) in enumerate(keys):
            same = [F.col(k) == after[j] for j, (k, _) in enumerate(keys[:i])]
            conditions.append(reduce(lambda a, b: a & b, [*same, F.col(c) < after[i] if desc else F.col(c) > after[i]]))
        rows = rows.where(reduce(lambda a, b: a | b, conditions))
    return rows.orderBy(*[F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in keys]).limit(limit)


def slice_impact(rows: DataFrame, match: Column, measures: dict[str, Column]) -> DataFrame:
    """kept and dropped counts and medians; rows on which the predicate is null are in neither."""
    side = F.when(match, "kept").when(~match, "dropped")
    return rows.withColumn("side", side).where("side is not null").groupBy("side").agg(F.count("*").alias("n"), *[F.median(c).alias(n) for n, c in measures.items()])


def coverage(catalog: DataFrame, in_build: str, axes: list[str], limit: int = 50) -> DataFrame:
    """Counts of each value of each axis in a build and in the catalog, ranks, totals and gaps.

    The axes are unpivoted once, and both scopes are counted in one aggregation; the windows see one row a value.
    """
    long = catalog.select(F.col(in_build).alias("inside"), F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(F.nullif(F.trim(F.col(a).cast("string")), F.lit("")), F.lit("(none)")).alias("value")) for a in axes])).alias("x"))
    counts = long.groupBy("x.axis", "x.value").agg(F.count_if("inside").alias("build_count"), F.count("*").alias("catalog_count"))
    axis = Window.partitionBy("axis")
    out = counts.select(
        "*",
        F.row_number().over(axis.orderBy(F.col("build_count").desc(), "value")).alias("build_rank"),
        F.row_number().over(axis.orderBy("value")).alias("value_rank"),
        F.count_if(F.col("build_count") == 0).over(axis).alias("gap_total"),
        F.count_if(F.col("build_count") > 0).over(axis).alias("build_distinct"),
        F.count("*").over(axis).alias("catalog_distinct"),
        F.sum("build_count").over(axis).alias("build_total"),
        F.sum("catalog_count").over(axis).alias("catalog_total"),
    )
    return out.where((F.col("build_rank") <= limit) | ((F.col("build_count") == 0) & (F.col("value_rank") <= limit)))


#: Flags of a slice, with their condition and the order of the rows.
FLAGS = {
    "jerky": ("verdict = 'jerky'", ("jerk_score", True)),
    "stalled": ("stall_ratio >= 0.5", ("stall_ratio", True)),
    "short": (None, ("coalesce(frame_count, 0)", False)),
    "long": (None, ("coalesce(frame_count, 0)", True)),
}


def slice_rule(state: str | None = None, flag: str | None = None) -> tuple[Column, list[Column]]:
    """(condition, order) of a slice by state and flag; `short` and `long` only order."""
    if flag is not None and flag not in FLAGS:
        raise ValueError(f"unknown flag: {flag}")
    test, (by, down) = FLAGS[flag] if flag else (None, ("created_at", True))
    match = F.lit(True)
    if state is not None:
        match = match & (F.col("state") == state)
    if test is not None:
        match = match & F.expr(test)
    return match, [F.expr(by).desc_nulls_first() if down else F.expr(by).asc_nulls_last(), F.col("id").desc()]


def episode_listing(episodes: DataFrame, quality: DataFrame, state: str | None = None, flag: str | None = None, limit: int = 50, before=None) -> DataFrame:
    """Episodes with their quality, if they have one, by state and flag. A cursor on created_at sets the order by time in place of the flag's."""
    q = quality.select(F.col("episode_id").alias("id"), "verdict", "jerk_score", "stall_ratio", "movement_score")
    rows = episodes.join(q, "id", "left")
    match, order = slice_rule(state, flag)
    rows = rows.where(match)
    if before is not None:
        rows, order = rows.where(F.col("created_at") < before), slice_rule()[1]
    return rows.orderBy(*order).limit(limit)


def slice_members(episodes: DataFrame, quality: DataFrame, audit: DataFrame, slice_id: str, state: str | None = None, flag: str | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(the rows that a slice holds now, the audit (slice_id, episode_id) with those it has not seen; nothing ever leaves the audit)."""
    now = episode_listing(episodes, quality, state, flag, limit)
    seen = audit.where(F.col("slice_id") == slice_id).select("episode_id")
    new = now.select(F.col("id").alias("episode_id")).join(seen, "episode_id", "left_anti").select(F.lit(slice_id).alias("slice_id"), "episode_id")
    return now, audit.select("slice_id", "episode_id").unionByName(new)


def coverage_report(rows: DataFrame) -> DataFrame:
    """Adds share (of the build), catalog_share, ratio (how over- or under-represented a value is; null without one) and truncated to `coverage` rows."""
    shown = F.count("*").over(Window.partitionBy("axis"))
    share, whole = F.try_divide("build_count", "build_total"), F.try_divide("catalog_count", "catalog_total")
    return rows.withColumns({"share": share, "catalog_share": whole, "ratio": F.try_divide(share, whole), "truncated": shown < F.col("catalog_distinct")})


def vocabulary_gaps(entries: DataFrame, catalog: DataFrame, in_build: str, limit: int = 50) -> DataFrame:
    """(id, label, catalog_episodes, missing_total, total): the entries without an episode in the build, by label.

    catalog: entry_id and whether an episode is in the build.
    """
    n = catalog.groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("catalog_episodes"), F.count_if(in_build).alias("_in"))
    e = entries.select("id", "label").join(n, "id", "left").fillna(0, ["catalog_episodes", "_in"])
    w = Window.partitionBy()
    e = e.withColumns({"missing_total": F.count_if(F.col("_in") == 0).over(w), "total": F.count("*").over(w)}).where("_in = 0").drop("_in")
    return e.orderBy("label", "id").limit(limit)
