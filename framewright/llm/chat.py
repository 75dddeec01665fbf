"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

DataFrame functions only. A record is a JSON text, or a struct column. Its fingerprint is a hash of its sorted nested
field paths (types and key order do not count); each known layout is a row of data: an example
of its shape, and where its roles and texts are. Records of an unknown layout yield no turns and
are returned by ``unmatched``, payload included. Spark's JSON parser takes strings of up to 20 million characters; a longer payload
that it does not parse is such a record too, marked ``too_long`` there: passed as columns (``column_turns``), it has no such limit.

The template writes ``<turn role>text</turn>`` and a newline per turn. ``&``, ``<`` and ``>`` in
roles and texts are written as ``&a``, ``&l`` and ``&g``, so no text can hold a control string, and reading back
restores it exactly. The loss mask is a list of (start, length) in code points, over the texts of
assistant turns.

Defined results: a null text or role is empty; very long texts are kept whole; turns with equal numbers are ordered by role, then
text; repeated rows are repeated turns; a conversation without rows does not occur in the output;
rows with a null conversation id form one conversation with a null id. Further columns are not read.
A long conversation is formatted in segments of SEGMENT turn numbers, so that only its strings, not its
rows, meet in one place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

SEGMENT = 256
#: Payloads of so many characters may be beyond the parser's limits.
LONGEST_JSON = 16_000_000
TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Reader:
    """How SQL reads a record: a string at a path, and turns from a list of objects at a path."""

    text: Callable[[str], str]
    turns: Callable[[str, str, str, bool], str]


def _said(role: str, text: str, human: bool) -> str:
    role = f"CASE {role} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE {role} END" if human else role
    return f"named_struct('role', coalesce({role}, ''), 'text', coalesce({text}, ''))"


_VARIANT = Reader(
    lambda path: f"coalesce(try_variant_get(v, '$.{path}', 'string'), '')",
    lambda path, role, text, human: f"transform(try_variant_get(v, '$.{path}', 'array<variant>'), x -> {_said(f"try_variant_get(x, '$.{role}', 'string')", f"try_variant_get(x, '$.{text}', 'string')", human)})",
)
_STRUCT = Reader(
    lambda path: f"coalesce(cast(v.{path} AS string), '')",
    lambda path, role, text, human: f"transform(v.{path}, x -> {_said(f'cast(x.{role} AS string)', f'cast(x.{text} AS string)', human)})",
)


@dataclass(frozen=True)
class Layout:
    """``shape``: an example record; ``turns``: SQL over the record ``v`` giving TURN, by the reader of its form."""

    name: str
    shape: str
    turns: Callable[[Reader], str]


def _pair(prompt: str, answer: str) -> Callable[[Reader], str]:
    return lambda r: f"array({_said("'user'", r.text(prompt), False)}, {_said("'assistant'", r.text(answer), False)})"


def _with_input(r: Reader) -> str:
    asked = f"concat({r.text('instruction')}, CASE WHEN {r.text('input')} = '' THEN '' ELSE concat('\\n\\n', {r.text('input')}) END)"
    return f"array({_said("'user'", asked, False)}, {_said("'assistant'", r.text('output'), False)})"


LAYOUTS = (
    Layout("turn", '{"role":"","text":""}', lambda r: f"array({_said(r.text('role'), r.text('text'), False)})"),
    Layout("messages", '{"messages":[{"role":"","content":""}]}', lambda r: r.turns("messages", "role", "content", False)),
    Layout("shared", '{"conversations":[{"from":"","value":""}]}', lambda r: r.turns("conversations", "from", "value", True)),
    Layout("prompt", '{"prompt":"","response":""}', _pair("prompt", "response")),
    Layout("completion", '{"prompt":"","completion":""}', _pair("prompt", "completion")),
    Layout("instruction", '{"instruction":"","output":""}', _pair("instruction", "output")),
    Layout("instruction_input", '{"instruction":"","input":"","output":""}', _with_input),
    Layout("question", '{"question":"","answer":""}', _pair("question", "answer")),
    Layout("nested", '{"data":{"prompt":"","response":""}}', _pair("data.prompt", "data.response")),
)


def _shape(kind: DataType) -> str:
    """The shape of a column's type, as ``fingerprint`` writes that of a variant."""
    if isinstance(kind, StructType):
        return f"OBJECT<{', '.join(f'{f.name}: {_shape(f.dataType)}' for f in sorted(kind.fields, key=lambda f: f.name))}>"
    return f"ARRAY<{_shape(kind.elementType)}>" if isinstance(kind, ArrayType) else "*"


def fingerprint(v: Column) -> Column:
    """Hash of the nested field names of a variant: its schema with the types of leaves left out.

    Spark lists object keys in sorted order, so key order does not count.
    """
    return F.xxhash64(_variant_shape(v))


def _variant_shape(v: Column) -> Column:
    """The schema of a variant without the types of its leaves, as ``_shape`` writes that of a column."""
    return F.regexp_replace(F.schema_of_variant(v), r"\b(STRING|VOID|VARIANT|BIGINT|BOOLEAN|DOUBLE|FLOAT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "*")


def known_layouts(spark, layouts=LAYOUTS) -> DataFrame:
    """One row per layout: fingerprint and name. As many rows as there are layouts: broadcast."""
    rows = spark.createDataFrame([(x.name, x.shape) for x in layouts], "layout string, shape string")
    return rows.select(fingerprint(F.try_parse_json("shape")).alias("fingerprint"), "layout")


def _mapped(marked: DataFrame, layouts) -> DataFrame:
    """``layout`` and ``turns`` in place of the variant ``v`` and its fingerprint."""
    found = marked.join(F.broadcast(known_layouts(marked.sparkSession, layouts)), "fingerprint", "left")
    turns = F.lit(None).cast(TURN)
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, F.expr(x.turns(_VARIANT)).cast(TURN)).otherwise(turns)
    return found.withColumn("turns", turns).drop("v", "fingerprint")


def canonical_turns(records: DataFrame, layouts=LAYOUTS, payload: str = "payload") -> DataFrame:
    """``records`` with ``layout`` and ``turns`` (role, text) in place of the JSON payload; both null where no layout fits."""
    v = F.try_parse_json(payload)
    return _mapped(records.withColumn("v", v).drop(payload).withColumn("fingerprint", fingerprint(F.col("v"))), layouts)


def column_turns(records: DataFrame, layouts=LAYOUTS, record: str = "record") -> DataFrame:
    """``records`` with ``layout`` and ``turns`` in place of a struct column, whose field paths are those of every row."""
    fields = _shape(records.schema[record].dataType)
    known = known_layouts(records.sparkSession, layouts).filter(F.col("fingerprint") == F.xxhash64(F.lit(fields))).select("layout").first()
    chosen = next((x for x in layouts if known and x.name == known.layout), None)
    turns = F.lit(None) if chosen is None else F.expr(chosen.turns(_STRUCT))
    found = records.withColumnRenamed(record, "v").withColumn("layout", F.lit(chosen and chosen.name).cast("string"))
    return found.withColumn("turns", turns.cast(TURN)).drop("v")


def unmatched(records: DataFrame, layouts=LAYOUTS, payload: str = "payload") -> DataFrame:
    """The records whose layout is not known, with their fingerprints, to add mappings for, and whether the payload may be too long for the parser."""
    v = F.try_parse_json(payload)
    too_long = F.coalesce(v.isNull() & (F.char_length(payload) >= LONGEST_JSON), F.lit(False))
    marked = records.withColumn("fingerprint", fingerprint(v)).withColumn("too_long", too_long)
    return marked.join(F.broadcast(known_layouts(records.sparkSession, layouts).select("fingerprint")), "fingerprint", "left_anti")


def escape(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&a")), F.lit("<"), F.lit("&l")), F.lit(">"), F.lit("&g"))


def unescape(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&l"), F.lit("<")), F.lit("&g"), F.lit(">")), F.lit("&a"), F.lit("&"))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, segment, text, loss_mask from rows (conv_id, turn, role, text)."""
    piece = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62))).cast("long").alias("segment"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    lists = piece.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    head = F.transform("ts", lambda t: F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">")))
    body = F.transform("ts", lambda t: escape(t["text"]))
    parts = lists.select("conv_id", "segment", "ts", head.alias("head"), body.alias("body"))
    whole = F.concat_ws("", F.zip_with("head", "body", lambda h, b: F.concat(h, b, F.lit("</turn>\n"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    marked = F.arrays_zip(F.transform("ts", lambda t: (t["role"] == "assistant")).alias("loss"), F.transform("head", F.char_length).alias("h"), F.transform("body", F.char_length).alias("b"))
    step = lambda s, x: F.struct(
        (s["at"] + x["h"] + x["b"] + 8).alias("at"),
        F.when(x["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + x["h"]).alias("start"), x["b"].alias("length"))))).otherwise(s["spans"]).alias("spans"),
    )
    return parts.select("conv_id", "segment", whole.alias("text"), F.aggregate(marked, zero, step, lambda s: s["spans"]).alias("loss_mask"))


def read_back(output: DataFrame) -> DataFrame:
    """conv_id, segment, turns (role, text) and the unescaped texts under the loss mask."""
    pieces = F.split("text", "</turn>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    turn = lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, ">", 1), 7, 1 << 30)).alias("role"),
        unescape(F.substring_index(p, ">", -1)).alias("text"),
    )
    under = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("text"), m["start"] + 1, m["length"])))
    return output.select("conv_id", "segment", F.transform(pieces, turn).alias("turns"), under.alias("loss"), F.char_length("text").cast("long").alias("n_chars"))


def digests(output: DataFrame) -> DataFrame:
    """Per conversation, what was read back from the formatted output."""
    back = read_back(output).select(
        "conv_id",
        F.struct(
            "segment",
            F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("said"),
            F.concat_ws("", "loss").alias("loss"),
        ).alias("s"),
        F.size("turns").cast("long").alias("n"),
        "n_chars",
    )
    whole = back.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("ss"), F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"))
    said = F.concat_ws("", F.transform("ss", lambda s: s["said"]))
    loss = F.concat_ws("", F.transform("ss", lambda s: s["loss"]))
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars"
    )
