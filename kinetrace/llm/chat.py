"""Chat formatting by schema fingerprints, with native expressions only.

The nested field paths that a record or a table has, of those that layouts use, are sorted and hashed; the
hash selects a declarative mapping, which turns the record into canonical turns: an array of (role, content).
Unknown fingerprints give null turns, so that a caller sees them.

The template marks turns as <|im_start|>role\\n content <|im_end|>\\n. Control strings inside texts are broken by
a backslash after their first character, and ones that are broken already get one more, so that removing one
backslash from each gives the text back. Output is a list of segments (text, loss), whose texts joined
are the formatted conversation; loss marks the assistants' texts.

Defined cases: null text is empty; a null role is empty; turns of one number follow role, then text; null
turn numbers come first; a null conv_id is one conversation; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of public chat templates (fixed values), each without its first character.
TAILS = {
    "<": ("|im_start|>", "|im_end|>", "|endoftext|>", "|system|>", "|user|>", "|assistant|>", "s>", "/s>", "<SYS>>", "</SYS>>", "start_of_turn>", "end_of_turn>"),
    "[": ("INST]", "/INST]"),
}
TURNS = "array<struct<role:string,content:string>>"

#: Declarative mappings: required paths, optional paths, SQL for the turns over the record's fields.
_PAIR = "array_compact(array({}))"
_TURN = "named_struct('role', '{}', 'content', {})"
LAYOUTS = {
    "messages": (("messages", "messages.role", "messages.content"), (), "transform(messages, m -> named_struct('role', m.role, 'content', coalesce(m.content, '')))"),
    "sharegpt": (
        ("conversations", "conversations.from", "conversations.value"),
        ("system",),
        "concat(if(system is null, cast(array() as " + TURNS + "), array(" + _TURN.format("system", "system") + ")), transform(conversations, m -> named_struct('role',"
        " case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end, 'content', coalesce(m.value, ''))))",
    ),
    "alpaca": (
        ("instruction", "output"),
        ("input", "system"),
        _PAIR.format("if(system is null, null, " + _TURN.format("system", "system") + "), " + _TURN.format("user", "concat_ws('\\n', instruction, nullif(input, ''))") + ", " + _TURN.format("assistant", "output")),
    ),
    "prompt": (
        ("prompt", "completion"),
        ("system",),
        _PAIR.format("if(system is null, null, " + _TURN.format("system", "system") + "), " + _TURN.format("user", "prompt") + ", " + _TURN.format("assistant", "completion")),
    ),
    "response": (("prompt", "response"), (), _PAIR.format(_TURN.format("user", "prompt") + ", " + _TURN.format("assistant", "response"))),
    "question": (("question", "answer"), (), _PAIR.format(_TURN.format("user", "question") + ", " + _TURN.format("assistant", "answer"))),
}
#: Layouts of tables with one row for each turn: paths and (conversation, order, role, content) columns.
ROW_LAYOUTS = {
    "turn rows": (("conv_id", "role", "text", "turn"), ("conv_id", "turn", "role", "text")),
    "message rows": (("content", "conversation_id", "message_index", "role"), ("conversation_id", "message_index", "role", "content")),
}
RECORD = (
    "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, system string, "
    "instruction string, input string, output string, prompt string, completion string, response string, question string, answer string"
)


def fingerprint(paths) -> str:
    """The hash of a set of nested field paths."""
    return sha256(",".join(sorted(paths)).encode()).hexdigest()


def registry() -> dict[str, str]:
    """fingerprint -> layout, for each layout with each set of its optional paths."""
    out = {}
    for name, (need, optional, _) in LAYOUTS.items():
        for n in range(len(optional) + 1):
            for extra in combinations(optional, n):
                out[fingerprint((*need, *extra))] = name
    return out


def schema_paths(schema: T.StructType, above: str = "") -> list[str]:
    """The nested field paths of a schema; an array's or map's values add no step."""
    out = []
    for f in schema.fields:
        out.append(above + f.name)
        kind = f.dataType
        while isinstance(kind, T.ArrayType | T.MapType):
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if isinstance(kind, T.StructType):
            out += schema_paths(kind, f"{above}{f.name}.")
    return out


def record_turns(df: DataFrame, column: str) -> DataFrame:
    """JSON records of mixed layouts: adds `fingerprint`, `layout` and `turns` (null for unknown layouts)."""
    schema = T._parse_datatype_string(RECORD)
    present = []
    for f in schema.fields:
        present.append(f"if(__r.`{f.name}` is null, null, '{f.name}')")
        if isinstance(f.dataType, T.ArrayType):
            present += [f"if(exists(__r.`{f.name}`, m -> m.`{x.name}` is not null), '{f.name}.{x.name}', null)" for x in f.dataType.elementType.fields]
    found = df.withColumn("__r", F.from_json(column, RECORD))
    found = found.withColumn("fingerprint", F.expr(f"sha2(cast(array_join(array_sort(array_compact(array({', '.join(present)}))), ',') as binary), 256)"))
    known = F.create_map(*[F.lit(x) for pair in registry().items() for x in pair])
    found = found.withColumn("layout", F.try_element_at(known, F.col("fingerprint")))
    fields = {f.name for f in schema.fields}
    cases = []
    for name, (_, _, sql) in LAYOUTS.items():
        source = found.select("__r.*").schema.fieldNames()
        assert fields <= set(source)
        cases.append(f"when '{name}' then cast({_qualified(sql, fields)} as {TURNS})")
    return found.withColumn("turns", F.expr("case layout " + " ".join(cases) + " end")).drop("__r")


def _qualified(sql: str, fields: set[str]) -> str:
    import re

    return re.sub(r"'(?:\\.|[^'\\])*'|(?<![\w.])(?:" + "|".join(sorted(fields)) + r")\b", lambda m: m[0] if m[0][0] == "'" else f"__r.{m[0]}", sql)


def table_turns(df: DataFrame) -> DataFrame:
    """A table with one row for each turn: conv_id and turns; its schema's fingerprint selects the columns."""
    known = {fingerprint(paths): (name, cols) for name, (paths, cols) in ROW_LAYOUTS.items()}
    words = {p for paths, _ in ROW_LAYOUTS.values() for p in paths}
    print_ = fingerprint(p for p in schema_paths(df.schema) if p in words)
    if print_ not in known:
        raise ValueError(f"no mapping for the field paths {sorted(schema_paths(df.schema))}")
    conv, order, role, content = (F.col(c) for c in known[print_][1])
    turn = F.struct(order.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(content, F.lit("")).alias("content"))
    grouped = df.groupBy(conv.alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return grouped.select("conv_id", F.expr("transform(t, x -> named_struct('role', x.role, 'content', x.content))").alias("turns"))


def _tails(first: str) -> str:
    import re

    return "|".join(re.escape(t).replace("'", "\\x27") for t in TAILS[first])


def escape(text: str) -> str:
    """SQL: a text whose control strings are broken."""
    for first in TAILS:
        text = f"regexp_replace({text}, r'\\{first}(\\\\*)(?=(?:{_tails(first)}))', r'{first}\\\\$1')"
    return text


def unescape(text: str) -> str:
    """SQL: the inverse of `escape`."""
    for first in TAILS:
        text = f"regexp_replace({text}, r'\\{first}\\\\(\\\\*)(?=(?:{_tails(first)}))', r'{first}$1')"
    return text


def _role(role: str) -> str:
    return escape(f"replace(replace({role}, '%', '%25'), '\\n', '%0A')")


def _unrole(role: str) -> str:
    return f"replace(replace({unescape(role)}, '%0A', '\\n'), '%25', '%')"


def format_turns(df: DataFrame) -> DataFrame:
    """Adds `segments`: (text, loss) pieces of the formatted conversation, in order."""
    head = f"named_struct('text', concat('{START}', {_role('x.role')}, '\\n'), 'loss', false)"
    body = f"named_struct('text', {escape('x.content')}, 'loss', x.role <=> 'assistant')"
    tail = f"named_struct('text', '{END}\\n', 'loss', false)"
    return df.withColumn("segments", F.expr(f"flatten(transform(turns, x -> array({head}, {body}, {tail})))"))


def formatted(df: DataFrame) -> DataFrame:
    """Adds `formatted`, the whole conversation as one string."""
    return df.withColumn("formatted", F.expr("array_join(transform(segments, x -> x.text), '')"))


def read_back(df: DataFrame) -> DataFrame:
    """Adds `back` and `loss_text`, read from `formatted` and the loss mask of `segments` alone."""
    parts = f"filter(split(formatted, r'{START.replace('|', chr(92) + '|')}'), (x, i) -> i > 0)"
    cut_end = f"substring(x, 1, length(x) - {len(END) + 1})"
    turn = f"named_struct('role', {_unrole('substring_index(x, chr(10), 1)')}, 'content', {unescape(f'substring({cut_end}, length(substring_index(x, chr(10), 1)) + 2)')})"
    back = df.withColumn("back", F.expr(f"transform({parts}, x -> {turn})"))
    return back.withColumn("loss_text", F.expr(f"array_join(transform(filter(segments, x -> x.loss), x -> {unescape('x.text')}), '')"))


def digests(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations."""
    flat = "array_join(transform(back, x -> concat(x.role, '\\n', x.content, '\\n')), '')"
    return read_back(formatted(df)).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.expr(flat).cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_sql() -> str:
    """The DuckDB SQL of the op4 query."""
    esc = "text"
    for first in TAILS:
        esc = f"regexp_replace({esc}, '(\\{first})(\\\\*)({_tails(first)})', '\\1\\\\\\2\\3', 'g')"
    size = f"length('{START}{END}') + 2 + length(role) + length({esc})"
    return f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum({size}) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id"""
