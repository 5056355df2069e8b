"""The functions that SQL text can use, by name."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.functions import tasks
from kinetrace.session import prepare


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def token_vector(text: pd.Series) -> pd.Series:
    """The hashed bag of a text's tokens, of unit length."""
    return text.map(lambda t: tasks.token_vector(t or "").tolist())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def pseudo_embedding(text: pd.Series) -> pd.Series:
    """A signed, hashed bag of words, of unit length."""
    return text.map(lambda t: tasks.pseudo_embedding(t or "").tolist())


@F.pandas_udf(T.StringType())
def blake2b64(text: pd.Series) -> pd.Series:
    """The 16 hexadecimal digits of the 64-bit BLAKE2b of a text; null for null."""
    return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=8).hexdigest())


class FlatNumbers:
    """A table function: the numbers of a JSON text by path."""

    def eval(self, text: str | None):
        from kinetrace.sources.recordings import flat_numbers

        try:
            value = json.loads(text or "null")
        except (ValueError, RecursionError):
            return
        yield from flat_numbers(value)


SCALAR = {"token_vector": token_vector, "pseudo_embedding": pseudo_embedding, "blake2b64": blake2b64}
TABLE = {"flat_numbers": (FlatNumbers, "dimension: string, value: double")}
#: SQL expressions over named arguments, registered as functions that Catalyst inlines.
SQL = {
    "inner_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "nearest_rank": ("v ARRAY<DOUBLE>, q DOUBLE", "DOUBLE", "element_at(array_sort(v), cast(least(greatest(1, ceil(q * size(v))), size(v)) as int))"),
    "upper_median": ("v ARRAY<DOUBLE>", "DOUBLE", "element_at(array_sort(v), cast(size(v) div 2 + 1 as int))"),
    "robust_z": ("x DOUBLE, median DOUBLE, sigma DOUBLE", "DOUBLE", "(x - median) / sigma"),
    "age_seconds": ("at TIMESTAMP, now TIMESTAMP", "DOUBLE", "greatest(0D, (unix_micros(now) - unix_micros(at)) / 1e6)"),
    "blank_to": ("x STRING, other STRING", "STRING", "coalesce(nullif(trim(x), ''), other)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to a session; their names."""
    prepare(spark)
    for name, f in SCALAR.items():
        spark.udf.register(name, f)
    for name, (cls, kind) in TABLE.items():
        spark.udtf.register(name, F.udtf(cls, returnType=kind))
    for name, (arguments, kind, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return sorted([*SCALAR, *TABLE, *SQL])
