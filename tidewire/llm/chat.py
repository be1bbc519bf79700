"""Conversations of any known layout as canonical turns, formatted for training, and read back.

Records are JSON. A record's *fingerprint* is a hash of its nested field paths, without types and values; it selects the
declared layout that says which paths hold the turns. Turns of a conversation then stream through a template that marks
them, escapes its own control strings inside texts so that they can be read back, and notes the spans that a model is
trained on. Long conversations are cut into parts, so neither a task nor a row ever holds a whole one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.frames import short_batches, written


# -- layouts -----------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Layout:
    """One layout of records, by declaration.

    ``example``: a record of the layout, of which only the field paths count. Either ``turns`` lists (role, paths), the
    texts at several paths joined by an empty line; or ``each`` is the path of a list whose entries hold ``role`` and
    ``text`` fields. ``roles`` renames the roles of such a list.
    """

    name: str
    example: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)


# Layouts in common use.
LAYOUTS = (
    Layout("prompt and response", '{"prompt": "", "response": ""}', (("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Layout("prompt and completion", '{"prompt": "", "completion": ""}', (("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Layout("prompt", '{"prompt": ""}', (("user", ("$.prompt",)),)),
    Layout("response", '{"response": ""}', (("assistant", ("$.response",)),)),
    Layout("system", '{"system": ""}', (("system", ("$.system",)),)),
    Layout("question and answer", '{"question": "", "answer": ""}', (("user", ("$.question",)), ("assistant", ("$.answer",)))),
    Layout("instruction", '{"instruction": "", "output": ""}', (("user", ("$.instruction",)), ("assistant", ("$.output",)))),
    Layout("instruction with input", '{"instruction": "", "input": "", "output": ""}', (("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("instruction with system", '{"system": "", "instruction": "", "input": "", "output": ""}',
           (("system", ("$.system",)), ("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("messages", '{"messages": [{"role": "", "content": ""}]}', each="$.messages", role="role", text="content"),
    Layout("no messages", '{"messages": []}', each="$.messages", role="role", text="content"),
    Layout("conversations", '{"conversations": [{"from": "", "value": ""}]}', each="$.conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("nested messages", '{"data": {"messages": [{"author": {"role": ""}, "content": {"text": ""}}]}}', each="$.data.messages", role="author.role", text="content.text"),
)


def field_paths(value: Column) -> Column:
    """The nested field names of a parsed record in alphabetical order, without types; null if it is no JSON.

    Entries of a list count together, and a field that is null counts as there.
    """
    return F.regexp_replace(F.schema_of_variant(value), r"(: |ARRAY<)[A-Z_]+(\([0-9,]+\))?(?=[,>])", "$1")


def fingerprint(paths: Column) -> Column:
    """64 bits of the field paths."""
    return F.when(paths.isNotNull(), F.xxhash64(paths))


def _turns(layout: Layout, value: Column) -> Column:
    def text_at(path: str) -> Column:
        return F.try_variant_get(value, path, "string")

    if layout.each:
        def entry(x: Column) -> Column:
            found = role = F.try_variant_get(x, f"$.{layout.role}", "string")
            for old, new in layout.roles.items():
                role = F.when(found == old, new).otherwise(role)
            return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(F.try_variant_get(x, f"$.{layout.text}", "string"), F.lit("")).alias("text"))

        return F.transform(F.try_variant_get(value, layout.each, "array<variant>"), entry)
    made = []
    for role, paths in layout.turns:
        texts = [F.coalesce(text_at(p), F.lit("")) for p in paths]
        whole = texts[0] if len(texts) == 1 else F.concat_ws("\n\n", *(F.when(t != "", t) for t in texts))
        made.append(F.struct(F.lit(role).alias("role"), whole.alias("text")))
    return F.array(*made)


def _parsed(records: DataFrame, record: str, layouts: tuple[Layout, ...]) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` and the parsed ``__value``; each step refers to the one before more than
    once, so Spark keeps them apart and parses once."""
    frame = records.drop("fingerprint", "layout").withColumn("__value", F.try_parse_json(record))
    frame = frame.withColumn("__paths", field_paths(F.col("__value")))
    frame = frame.withColumn("fingerprint", fingerprint(F.col("__paths"))).drop("__paths")
    name = F.lit(None).cast("string")
    for layout in reversed(layouts):
        known = fingerprint(field_paths(F.try_parse_json(F.lit(layout.example))))
        name = F.when(F.col("fingerprint") == known, layout.name).otherwise(name)
    return frame.withColumn("layout", name)


def with_layout(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with ``fingerprint`` and ``layout`` (a declared name, or null); columns so named are replaced."""
    return _parsed(records, record, layouts).drop("__value")


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """A row per turn: the columns of ``records`` without the record, ``layout``, ``position`` in the record, ``role``, ``text``.

    A role or text that is null or missing in a list's entry is empty. Records of no declared layout, no JSON and null
    have no turns here; ``unmapped`` has them. Repeated records stay repeated. All within the JVM, no shuffle; columns
    with the names of results are replaced.
    """
    frame = _parsed(records, record, layouts).where("layout is not null")
    turns = F.lit(None).cast("array<struct<role: string, text: string>>")
    for layout in reversed(layouts):
        turns = F.when(F.col("layout") == layout.name, _turns(layout, F.col("__value"))).otherwise(turns)
    others = [c for c in frame.columns if c not in (record, "__value", "fingerprint", "position", "role", "text")]
    opened = frame.select(*(f"`{c}`" for c in others), F.posexplode(turns).alias("position", "__turn"))
    return opened.select(*(f"`{c}`" for c in others), "position", F.col("__turn.role").alias("role"), F.col("__turn.text").alias("text"))


def unmapped(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The records of no declared layout, with their ``fingerprint`` (null if they are no JSON)."""
    return with_layout(records, record, layouts).where("layout is null").drop("layout")


# -- template ----------------------------------------------------------------------------------------------------
# The control strings of a common instruction format, and own ones for further roles.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>")
#: What stands before and after a text, by role.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER = ("<|role|>", "<|text|>", "<|end|>")
BEGIN = "<s>"
#: Code points of a part, unless one turn has more.
PART = 1 << 20

_ESCAPED = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_UNESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """The text without any control string: a backslash goes behind a control string's first character and is doubled
    where it stands itself. No control string's end begins another, so none is left or made."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as it is formatted, and where its text begins and ends in it."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
    shown = escape(text)
    return before + shown + after, len(before), len(before) + len(shown)


def parse_turns(formatted: str, at: int = 0) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted part, which may begin with ``BEGIN``."""
    at += len(BEGIN) if formatted.startswith(BEGIN, at) else 0
    while at < len(formatted):
        if formatted.startswith(OTHER[0], at):
            cut = formatted.index(OTHER[1], at)
            role, begin, after = unescape(formatted[at + len(OTHER[0]) : cut]), cut + len(OTHER[1]), OTHER[2]
        else:
            role = next(r for r, (before, _) in MARKS.items() if formatted.startswith(before, at))
            begin, after = at + len(MARKS[role][0]), MARKS[role][1]
        mark = after.strip()  # the control string alone is never part of a text
        end = formatted.index(mark, begin) - after.index(mark)
        yield role, unescape(formatted[begin:end])
        at = end + len(after)


# -- Spark jobs --------------------------------------------------------------------------------------------------
def _stream(df: DataFrame, run: Callable, schema: str, *order: str) -> DataFrame:
    """``run`` over rows that lie together by the first column of ``order`` and are sorted by all."""
    short_batches(df.sparkSession)
    return df.repartition(order[0]).sortWithinPartitions(*order).mapInArrow(run, schema)


_PART = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
    ("trained", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
])


def format_conversations(turns: DataFrame, trained: tuple[str, ...] = ("assistant",), part: int = PART) -> DataFrame:
    """``conv_id``, ``part``, ``n_turns``, ``formatted``, ``trained`` (spans of code points in ``formatted``): the parts of a
    conversation after one another are its formatted text, and a part holds whole turns.

    ``turns`` has ``conv_id``, ``turn``, ``position``, ``role`` and ``text``; ties go by role and text, nulls first. A null
    role or text is empty, rows without an id are one conversation, repeated rows are repeated turns. Each turn of a
    role in ``trained`` has a span of its own text. Further columns are left out. One shuffle; a task holds one part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, shown, spans, size, count = object(), 0, [], [], 0, 0

        def row() -> dict:
            return {"conv_id": now, "part": number, "n_turns": count, "formatted": "".join(shown), "trained": spans}

        for batch in batches:
            out, out_size = [], 0
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
                if conv != now or size >= part:
                    if shown:
                        out.append(row())
                        out_size += size
                    number = number + 1 if conv == now else 0
                    shown, size = ([BEGIN], len(BEGIN)) if conv != now else ([], 0)
                    now, spans, count = conv, [], 0
                made, begin, end = format_turn(role or "", text or "")
                if (role or "") in trained:
                    spans.append({"begin": size + begin, "end": size + end})
                shown.append(made)
                size += len(made)
                count += 1
                if out_size >= part:
                    yield pa.RecordBatch.from_pylist(out, _PART)
                    out, out_size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, _PART)
        if shown:
            yield pa.RecordBatch.from_pylist([row()], _PART)

    rows = turns.selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "cast(position as bigint) position", "role", "text")
    spans = "array<struct<begin: bigint, end: bigint>>"
    return _stream(rows, run, f"conv_id bigint, part bigint, n_turns bigint, formatted string, trained {spans}", "conv_id", "turn", "position", "role", "text")


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
    ("formatted_chars", pa.int64()),
])


def read_back(parts: DataFrame) -> DataFrame:
    """``conv_id``, ``role``, ``text``, ``part``, ``at`` (turn in the part) of formatted parts."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    short_batches(parts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, number, formatted in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (conv, number, i, *turn))) for i, turn in enumerate(parse_turns(formatted))], schema)

    return parts.select("conv_id", "part", "formatted").mapInArrow(run, "conv_id bigint, part bigint, at bigint, role string, text string")


def conversation_digests(parts: DataFrame) -> DataFrame:
    """One row per conversation, from its parts alone: ``n_turns``, ``turns_sha256`` (role and text of each turn, each with a
    line break after it), ``loss_chars`` and ``loss_sha256`` (the unescaped texts under the spans, one after another),
    ``formatted_chars``. One shuffle; parts stream through, so a task holds one part of one conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = object(), False
        count = loss = chars = 0
        turns = trained = None

        def row() -> dict:
            return dict(zip(_DIGEST.names, (now, count, turns.hexdigest(), loss, trained.hexdigest(), chars)))

        for batch in batches:
            out = []
            for conv, formatted, spans in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if not seen or conv != now:
                    if seen:
                        out.append(row())
                    now, seen, count, loss, chars = conv, True, 0, 0, 0
                    turns, trained = hashlib.sha256(), hashlib.sha256()
                for role, text in parse_turns(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    count += 1
                for span in spans:
                    text = unescape(formatted[span["begin"] : span["end"]])
                    trained.update(text.encode())
                    loss += len(text)
                chars += len(formatted)
            if out:
                yield pa.RecordBatch.from_pylist(out, _DIGEST)
        if seen:
            yield pa.RecordBatch.from_pylist([row()], _DIGEST)

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return _stream(parts.select("conv_id", "part", "formatted", "trained"), run, schema, "conv_id", "part")


def formatted_table(records: DataFrame, record: str = "record") -> DataFrame:
    """The parts of all conversations as a written table; ``records`` has ``conv_id``, ``turn`` and a JSON record per row."""
    return written(format_conversations(canonical_turns(records, record)), "conversations")
