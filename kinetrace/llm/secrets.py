"""Secret scans with native expressions only.

Three patterns of known secrets, and a sliding-window Shannon entropy over candidate strings, one threshold
per character class. A window carries one count for each character of the alphabet: each step takes the leaving
character's count down and the entering one's up, and replaces their terms in the sum of c*log2(c); nothing is
counted again. Terms are integers (scaled by 2**20), so that the sum is exact. Candidates that an allow-list pattern
matches, or that touch a pattern's span, are suppressed.

Positions of matches are prefix sums of the lengths of the pieces between them, computed by doubling steps, so that a
text with very many matches takes n*log(n) steps. Spans are code points, end exclusive.

Defined cases: null text counts as empty and has no span; very long candidates are scanned in overlapping
segments, so that each window is seen once; repeated rows each get their result; an empty table gives an
empty result; further columns are kept apart, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed, and their patterns.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_lower", "entropy_upper", "entropy_base64")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
SEGMENT = 200
#: Character classes, the first that holds a whole candidate counts: pattern, and the least entropy in bits of a window.
CLASSES = {
    "entropy_hex": ("^[0-9A-Fa-f]+$", 3.0),
    "entropy_lower": ("^[a-z0-9]+$", 3.5),
    "entropy_upper": ("^[A-Z0-9]+$", 3.5),
    "entropy_base64": (".", 3.7),
}
#: Candidates that are no secrets: words, joined words, plain numbers, UUIDs, counting sequences, samples.
ALLOWED = (
    r"^[A-Za-z]+([-_/+=]+[A-Za-z]+)*[-_/+=]*$",
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|0123456789|1234567890|abcdefghij|qwertyuiop",
)


def _quoted(s: str) -> str:
    return "r'" + s.replace("'", "\\x27") + "'"


def _terms() -> str:
    scaled = [0] + [round(c * math.log2(c) * (1 << 20)) for c in range(1, WINDOW + 1)]
    return "array(" + ",".join(f"{x}L" for x in scaled) + ")"


def most_entropy_sum(bits: float) -> int:
    """The largest scaled sum of c*log2(c) of a window with at least that entropy."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * (1 << 20))


def _scan(array: str, merged: str = "x + y") -> str:
    """SQL: the inclusive running sums (or maxima, minima) of an array; each round takes in what stands 2**k places before."""
    merged = merged.replace("y", "a[i - shiftleft(1, k)]")
    return f"""aggregate(sequence(0, 30), {array}, (a, k) -> if(size(a) <= shiftleft(1, k), a,
        transform(a, (x, i) -> if(i >= shiftleft(1, k), {merged}, x))))"""


def _located(text: str, pattern: str, kind: int, good: str = "true") -> str:
    """SQL: an array of structs (s, k, e, m) of the pattern's matches m (number k in KINDS) for which `good` holds."""
    found = f"regexp_extract_all({text}, {_quoted(pattern)}, 0)"
    steps = f"zip_with(slice(split({text}, {_quoted(pattern)}, -1), 1, size({found})), {found}, (gap, m) -> length(gap) + length(m))"
    return f"""if({text} rlike {_quoted(pattern)}, filter(
        zip_with({found}, {_scan(steps)}, (m, e) -> named_struct('s', e - length(m), 'k', {kind}, 'e', e, 'm', m)),
        x -> {good.format("x.m")}), cast(array() as array<struct<s:int,k:int,e:int,m:string>>))"""


def _lowest_sum(run: str) -> str:
    """SQL: the least scaled sum of c*log2(c) over the windows of a candidate.

    The state holds `n`, a string with one character for each letter of the alphabet, whose code is 65 plus its count.
    Each character enters, and leaves WINDOW places later: x is (place in the alphabet, +1 or -1).
    """
    w = WINDOW
    places = f"transform(split(g, ''), c -> instr('{ALPHABET}', c))"
    steps = f"flatten(transform({places}, (c, p) -> if(p >= {w}, array(named_struct('c', instr('{ALPHABET}', substring(g, p - {w - 1}, 1)), 'd', -1), named_struct('c', c, 'd', 1)), array(named_struct('c', c, 'd', 1)))))"
    count = "ascii(substring(acc.n, x.c, 1)) - 65"
    change = f"element_at(terms, {count} + x.d + 1) - element_at(terms, {count} + 1)"
    return f"""array_min(transform(transform(sequence(0, greatest(length({run}) - {w}, 0) div {SEGMENT}), i -> substring({run}, i * {SEGMENT} + 1, {SEGMENT + w - 1})),
        g -> aggregate({steps}, named_struct('n', repeat('A', {len(ALPHABET)}), 'in', 0, 'sum', 0L, 'low', {1 << 60}L),
            (acc, x) -> named_struct('n', overlay(acc.n, char({count} + x.d + 65), x.c, 1), 'in', acc.in + if(x.d > 0, 1, 0),
                'sum', acc.sum + {change}, 'low', if(x.d > 0 and acc.in >= {w - 1}, least(acc.low, acc.sum + {change}), acc.low)),
            acc -> acc.low)))"""


def _apart() -> str:
    """SQL: the candidates of `found`, an array in the order of starts, that no base span touches.

    Of the base spans that start no later, the greatest end decides, of the others the least start.
    """
    ends = _scan("transform(found, x -> if(x.k < 3, x.e, -1))", "greatest(x, y)")
    starts = f"reverse({_scan('transform(reverse(found), x -> if(x.k < 3, x.s, 2147483647))', 'least(x, y)')})"
    sides = f"zip_with({ends}, {starts}, (e, s) -> named_struct('e', e, 's', s))"
    return f"transform(filter(zip_with(found, {sides}, (x, y) -> named_struct('x', x, 'y', y)), z -> z.x.k > 2 and z.y.e <= z.x.s and z.y.s >= z.x.e), z -> z.x)"


def find_secrets(docs: DataFrame) -> DataFrame:
    """Each row as a struct `row`, with `base` and `added`: arrays of (s, k, e, m): start, number in KINDS, end, matched text."""
    assign = f"length(regexp_extract({{0}}, {_quoted(ASSIGN)}, 2)) >= 6"
    allowed = " or ".join(f"x.m rlike {_quoted(p)}" for p in ALLOWED)
    d = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("base", F.expr(f"array_sort(concat({_located('t', ASSIGN, 0, assign)}, {_located('t', ACCESS, 1)}, {_located('t', HEX, 2)}))"))
    d = d.withColumn("added", F.expr(f"filter({_located('t', CANDIDATE, 4)}, x -> not ({allowed}))"))
    d = d.withColumn("found", F.expr("if(size(base) = 0 or size(added) = 0, cast(array() as array<struct<s:int,k:int,e:int,m:string>>), array_sort(concat(base, added)))"))
    d = d.withColumn("added", F.expr(f"if(size(found) = 0, added, {_apart()})"))
    low = _lowest_sum("x.m").replace("terms", _terms())
    kind = "case " + " ".join(f"when x.m rlike '{p}' then {KINDS.index(k)}" for k, (p, _) in CLASSES.items()) + " end"
    most = "case x.k " + " ".join(f"when {KINDS.index(k)} then {most_entropy_sum(bits)}L" for k, (_, bits) in CLASSES.items()) + " end"
    classed = f"transform(added, x -> named_struct('s', x.s, 'k', {kind}, 'e', x.e, 'm', x.m))"
    return d.select("row", "t", "base", F.expr(f"filter({classed}, x -> {low} <= {most})").alias("added"))


def _shown(spans: str) -> str:
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = find_secrets(docs.select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{KINDS[i]}") for i in range(3)]
    digest = F.sha2(F.expr(_shown("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("row.doc_id", *counts, digest, F.expr(_shown("array_sort(concat(base, added))")).alias("spans"))


PAGE = 1024


def _between(lo: str, hi: str) -> str:
    """SQL: the code points lo to hi of a text that is cut into `pages` of PAGE code points."""
    first, last = f"({lo}) div {PAGE}", f"({hi}) div {PAGE}"
    part = f"substring(pages[{first} + j], if(j = 0, ({lo}) % {PAGE}, 0) + 1, if({first} + j = {last}, ({hi}) % {PAGE}, {PAGE}) - if(j = 0, ({lo}) % {PAGE}, 0))"
    return f"if({hi} <= {lo}, '', array_join(transform(sequence(0, {last} - {first}), j -> if({first} + j >= size(pages), '', {part})), ''))"


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents in their own columns, each secret (overlapping ones together) replaced by a mark; n_chars follows where there is one.

    A text is cut into pages first, so that each piece between secrets is read from its own pages alone.
    """
    d = find_secrets(docs).withColumn("hit", F.expr("size(base) + size(added) > 0"))
    d = d.withColumn("spans", F.expr("if(hit, array_sort(concat(transform(base, x -> named_struct('s', x.s, 'e', x.e)), transform(added, x -> named_struct('s', x.s, 'e', x.e)))), null)"))
    d = d.withColumn("ends", F.expr(_scan("transform(spans, x -> x.e)", "greatest(x, y)")))
    d = d.withColumn("pages", F.expr(f"if(hit, regexp_extract_all(t, '(?s).{{1,{PAGE}}}', 0), null)"))
    before = "if(i = 0, 0, ends[i - 1])"
    # A secret that starts inside the ones before it adds no mark of its own.
    piece = f"if(i > 0 and x.s < {before}, '', concat({_between(before, 'x.s')}, '{mark}'))"
    d = d.withColumn("new", F.expr(f"if(hit, concat(array_join(transform(spans, (x, i) -> {piece}), ''), {_between('array_max(ends)', 'length(t)')}), row.text)"))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("new").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("hit"), F.length("new")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return d.select(*out)
