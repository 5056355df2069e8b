"""Downloads of listings and the metric log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.sources.records import refused

#: Fixed value: the most rows of a download.
MOST = 50_000


def _ordered(c: Column, kind: T.DataType) -> Column:
    """A nested value with its fields and keys in alphabetical order."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(c, lambda k, v: _ordered(v, kind.valueType)))))
    return c


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as texts: null is empty, booleans are true and false, stamps are ISO-8601, nested values JSON with sorted keys."""
    out = []
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StructType | T.ArrayType | T.MapType):
            text = F.to_json(_ordered(F.col(c), kind), {"ignoreNullFields": "false"})
        elif isinstance(kind, T.TimestampType):
            text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        else:
            text = F.col(c).cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(c))
    return df.select(*out)


def download(df: DataFrame, path: str, kind: str, columns: list[str], order: list[Column], limit: int = MOST) -> None:
    """The first rows of a listing as CSV or JSON lines, in order, with the columns in a stable order."""
    first = df.orderBy(*order).limit(limit)
    if kind == "csv":
        cells(first, columns).write.csv(path, header=True, nullValue="", emptyValue="", quoteAll=False, escape='"')
    elif kind == "jsonl":
        first.select(*columns).write.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown download format: {kind}")


def append_metrics(records: DataFrame, path: str) -> int:
    """Appends metric records to a log, by day; how many were refused (see `refused`). A reader of one day reads one folder."""
    bad = F.coalesce(refused(F.col("name"), F.col("labels")), F.lit(True))
    sorted_labels = F.map_from_entries(F.array_sort(F.map_entries("labels")))
    good = records.where(~bad).withColumn("labels", sorted_labels).withColumn("day", F.to_date(F.try_to_timestamp("timestamp")))
    good.write.partitionBy("day").mode("append").json(path)
    return records.where(bad).count()
