"""Quality rules on lines that many documents of a host share.

A line counts for a host once per *distinct document* it stands in, and the host's documents are counted the same way:
texts that are equal are one document. Lines over the host's limit are removed, and documents of which too little is left
are rejected.

Edited copies of one document are distinct texts, so many of them would turn its own sentences into shared lines. After the
first count, documents that would lose much of their text are therefore compared with each other by the exact Jaccard
join, and those that link count as one, for their lines and for the host alike. This is done once. Texts that are little but
shared lines link too; they are told apart by their own lines, those with words that mostly do not stand in the text that
leads the component (an edited line keeps most of its words).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import setjoin, words
from tidewire.llm.frames import arrow_map, short_batches, small, text_chunks, written

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Members of a component that are compared with its leading text in one group; a larger component has several groups.
MEMBERS = 1000


@dataclass(frozen=True)
class LineRules:
    """Limits. A line is removed if it stands in more than ``least`` distinct documents of its host and in more than
    ``percent`` per cent of the host's; a document with a removed line is rejected if under ``keep_percent`` per cent
    of its words are left. Documents that would lose ``copy_percent`` per cent of their words are looked at for copies."""

    least: int = 10
    percent: int = 2
    keep_percent: int = 20
    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    copy_percent: int = 25


def normal(line_words: list[str]) -> str:
    """Words joined by one space, A-Z lower-cased."""
    return " ".join(line_words).translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
_SPACES = str.maketrans({c: " " for c in "\t\x0b\x0c\r"})


def line_words(text: str) -> list[list[str]]:
    """Words of each line that has any; words are separated by space and \\x09 to \\x0D, lines by \\n."""
    lines = (line.translate(_SPACES).split(" ") if _odd(line) else line.split(" ") for line in text.split("\n"))
    return [found for line in lines if (found := [w for w in line if w])]


def _odd(line: str) -> bool:
    return "\t" in line or "\r" in line or "\x0b" in line or "\x0c" in line


def line_key(text: str) -> int:
    """64 bits of the line's MD5, as a signed integer."""
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big", signed=True)


def own_lines(text: str, known: set[str]) -> list[int]:
    """Sorted keys of the lines with more words outside ``known`` than in it."""
    rows = (normal(row).split(" ") for row in line_words(text))
    return sorted({line_key(" ".join(row)) for row in rows if 2 * sum(w not in known for w in row) > len(row)})


#: What a document's own text gives.
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"

_TABLE = words.byte_table()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(SYMBOLS.encode(), np.uint8)] = True


# -- one pass over the texts -------------------------------------------------------------------------------------
def with_keys(docs: DataFrame, host: str) -> DataFrame:
    """``docs`` with ``__host`` (text; null hosts are one host) and ``__digest`` (60 bits of the text's MD5; null is empty)."""
    name = F.when(F.col(host).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(host).cast("string")))
    digest = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 15), 16, 10).cast("bigint")
    return docs.withColumn("__host", name).withColumn("__digest", digest)


_MEASURES = [f.split()[0] for f in BASE.split(", ")]


def measured(docs: DataFrame, rules: LineRules, host: str) -> DataFrame:
    """The columns of ``docs`` without the text, ``__host``, ``__digest``, the counts of ``BASE``, and of each distinct line
    its key and its words in the text (``__keys``, ``__sizes``); as a written table."""
    frame = with_keys(docs.drop(*_MEASURES, "removed_words", "base_failed", "kept"), host)

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index("text")
            counts = base_counts(batch.column(at), rules.window)
            keys, sizes = [], []
            for text in batch.column(at).to_pylist():
                own: dict[int, int] = {}
                for row in line_words(text or ""):
                    key = line_key(normal(row))
                    own[key] = own.get(key, 0) + len(row)
                keys.append(list(own))
                sizes.append(list(own.values()))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            longs = pa.list_(pa.int64())
            new = [*(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(_MEASURES))), pa.array(keys, longs), pa.array(sizes, longs)]
            return pa.RecordBatch.from_arrays([*columns, *new], [*(n for n in batch.schema.names if n != "text"), *_MEASURES, "__keys", "__sizes"])

        return run

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.drop("text").schema.fields)
    return written(arrow_map(frame, make, f"{kept}, {BASE}, __keys array<bigint>, __sizes array<bigint>"), "measured-lines")


def _lines(rows: DataFrame) -> DataFrame:
    """A row per line of each text: ``__host``, ``__digest``, ``n_words``, ``key``, ``size``."""
    opened = rows.select("__host", "__digest", "n_words", F.explode(F.arrays_zip("__keys", "__sizes")).alias("line"))
    return opened.select("__host", "__digest", "n_words", F.col("line.__keys").alias("key"), F.col("line.__sizes").alias("size"))


# -- lines over the limit ----------------------------------------------------------------------------------------
def line_counts(rows: DataFrame, rules: LineRules) -> tuple[DataFrame, DataFrame]:
    """``__host``, ``key``, ``n`` of lines in more than ``least`` distinct documents, and ``__host``, ``total``.

    Rows are made distinct first, so that counts are plain sums which tasks add up before they send them on: neither a
    hot host nor a hot line meets in one task.
    """
    one = F.lit(1).alias("one")
    lines = _lines(rows).groupBy("__host", "key", "__digest").agg(one).groupBy("__host", "key").agg(F.sum("one").alias("n")).where(F.col("n") > rules.least)
    totals = rows.groupBy("__host", "__digest").agg(one).groupBy("__host").agg(F.sum("one").alias("total"))
    return written(lines, "line-counts"), written(totals, "host-totals")


def over_limit(lines: DataFrame, totals: DataFrame, rules: LineRules) -> DataFrame:
    hot = lines.join(small(totals), "__host").where((F.col("n") > rules.least) & (F.col("n") * 100 > F.col("total") * rules.percent))
    return written(hot.select("__host", "key"), "removed-lines")


def removed_from(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Distinct documents with removed lines: ``__host``, ``__digest``, ``n_words``, ``removed_words``, ``removed`` (their keys)."""
    found = _lines(rows).join(small(hot), ["__host", "key"]).distinct()
    each = found.groupBy("__host", "__digest", "n_words").agg(F.sum("size").alias("removed_words"), F.collect_list("key").alias("removed"))
    return written(each, "shortened")


def copy_classes(texts: DataFrame) -> DataFrame:
    """``__digest``, ``class`` of texts (``__digest``, ``text``) that link to others; equal classes count as one document.

    A class is that of the component's leading text (the smallest digest), or is made of it and of the text's own lines.
    Members are compared with their leader's words as they stream past it, in groups of about ``MEMBERS``.
    """
    found = setjoin.link_components(texts.withColumnRenamed("__digest", "doc_id"))
    linked = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__digest"), F.col("component_id").alias("lead")), "linked-texts")
    groups = linked.groupBy("lead").agg(F.count("*").alias("members")).select("lead", F.expr(f"cast(ceil(members / {MEMBERS}) as bigint)").alias("groups"))
    groups = written(groups, "leads")
    members = texts.join(small(linked), "__digest").join(small(groups), "lead")
    members = members.select("lead", F.pmod(F.xxhash64("__digest"), F.col("groups")).alias("part"), "__digest", "text")
    leads = texts.join(small(groups), F.col("__digest") == F.col("lead")).select("lead", F.explode(F.expr("sequence(0L, groups - 1)")).alias("part"), "__digest", "text")
    schema = pa.schema([("__digest", pa.int64()), ("class", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        for batch in batches:
            out = []
            for lead, digest, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
                if lead == digest:
                    known = {w for row in line_words(text) for w in normal(row).split(" ")}
                    own = []
                else:
                    own = own_lines(text, known)
                out.append({"__digest": digest, "class": line_key(f"{lead} {own}") if own else lead})
            yield pa.RecordBatch.from_pylist(out, schema)

    both = members.unionByName(leads).withColumn("place", F.col("lead") != F.col("__digest"))
    ordered = both.select("lead", "part", "place", "__digest", "text").repartition("lead", "part").sortWithinPartitions("lead", "part", "place")
    short_batches(texts.sparkSession)
    return written(ordered.mapInArrow(run, "__digest bigint, class bigint").distinct(), "copy-classes")


def _fewer(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key how many fewer its classes are than its documents: ``keys``, ``fewer``."""
    one = F.lit(1).alias("one")
    docs = rows.select(*keys, "__digest").distinct().groupBy(*keys).agg(F.count("*").alias("docs"))
    classes = rows.groupBy(*keys, "class").agg(one).groupBy(*keys).agg(F.sum("one").alias("classes"))
    return written(docs.join(classes, keys).where("docs > classes").select(*keys, (F.col("docs") - F.col("classes")).alias("fewer")), "fewer")


def shortened(docs: DataFrame, rows: DataFrame, rules: LineRules) -> DataFrame:
    """``removed_from`` for the final lines of ``rows``, the measured rows of ``docs`` (which has ``text`` and ``__digest``)."""
    lines, totals = line_counts(rows, rules)
    found = removed_from(rows, over_limit(lines, totals, rules))
    near = written(found.where(F.col("removed_words") * 100 >= F.col("n_words") * rules.copy_percent).select("__host", "__digest"), "much-shortened")
    wanted = written(near.select("__digest").distinct(), "looked-at")
    if wanted.count() < 2:
        return found
    texts = docs.select("__digest", "text").join(small(wanted), "__digest", "left_semi").groupBy("__digest").agg(F.first("text").alias("text"))
    classes = copy_classes(written(texts, "looked-at-texts"))
    classed = near.join(small(classes), "__digest").select("__host", "__digest", "class")
    held = _lines(rows).join(small(written(classed, "classed")), ["__host", "__digest"]).select("__host", "key", "__digest", "class").distinct()
    fewer_lines, fewer_docs = _fewer(held, ["__host", "key"]), _fewer(classed, ["__host"])
    lines = lines.join(small(fewer_lines), ["__host", "key"], "left").select("__host", "key", (F.col("n") - F.coalesce("fewer", F.lit(0))).alias("n"))
    totals = totals.join(small(fewer_docs), "__host", "left").select("__host", (F.col("total") - F.coalesce("fewer", F.lit(0))).alias("total"))
    return removed_from(rows, over_limit(lines, written(totals, "class-totals"), rules))


# -- counts of one text ------------------------------------------------------------------------------------------
def base_counts(column: pa.Array, window: int) -> list[tuple]:
    """The counts of ``BASE`` for a column of texts, runs of rows at a time with numpy."""
    out = []
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    for first, end, data, offsets in text_chunks(column):
        found = words.scan(data, offsets, _TABLE)
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        chars = heads[found.ends] - heads[found.starts]
        chars = np.concatenate(([0], np.cumsum(chars)))
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
        for row in range(end - first):
            a, b = found.firsts[row], found.firsts[row + 1]
            own = found.hashes[a:b]
            text = data[offsets[row] : offsets[row + 1]].tobytes()
            out.append((
                int(b - a),
                int(chars[b] - chars[a]),
                int(symbols[offsets[row + 1]] - symbols[offsets[row]]),
                duplicate_lines(text),
                repeated_words(own, window),
            ))
    return out


def duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.strip(words.SPACES)]
    return len(lines) - len(set(lines))


def repeated_words(own: np.ndarray, window: int) -> int:
    """Words inside a window that stands in the text twice or more."""
    if len(own) <= window:
        return 0
    found = words.windows(own, window)
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(own) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


# -- verdicts ----------------------------------------------------------------------------------------------------
def _judged(rows: DataFrame, found: DataFrame, rules: LineRules) -> DataFrame:
    gone = small(found.select("__host", "__digest", "removed_words"))
    counted = rows.drop("__keys", "__sizes").join(gone, ["__host", "__digest"], "left").fillna(0, ["removed_words"])
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    depleted = (F.col("removed_words") > 0) & (100 * (F.col("n_words") - F.col("removed_words")) < rules.keep_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def judge(docs: DataFrame, rules: LineRules = LineRules(), host: str = "source") -> DataFrame:
    """The columns of ``docs`` but the text, with the counts of ``BASE``, ``removed_words``, ``base_failed`` and ``kept``.

    ``base_failed``: under ``min_words`` words, or more than ``repeat_percent`` per cent of them repeated. Else a
    document is rejected only if it has removed lines and too little is left. Null and empty texts have no words and
    fail the base rule; they count as one document of their host. A null host is a host of its own. Every row stays,
    repeated ones too; columns of ``docs`` with the names of results are replaced. One pass over the texts leaves a table
    of counts and line keys; after it only texts that lose much are read again.
    """
    rows = measured(docs, rules, host)
    return _judged(rows, shortened(with_keys(docs, host), rows, rules), rules).drop("__host", "__digest")


def kept_rows(docs: DataFrame, rules: LineRules = LineRules(), host: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, whole. A verdict depends on host and text alone, so rejected ones are
    found by the two; they are broadcast if they are few."""
    rows = measured(docs.select(host, "text"), rules, host)
    keyed = with_keys(docs, host)
    rejected = _judged(rows, shortened(keyed, rows, rules), rules).where("not kept").select("__host", "__digest").distinct()
    return keyed.join(small(written(rejected, "rejected")), ["__host", "__digest"], "left_anti").drop("__host", "__digest").select(*docs.columns)


def without_lines(docs: DataFrame, rules: LineRules = LineRules(), host: str = "source") -> DataFrame:
    """``docs`` whose texts have lost their host's removed lines; null texts stay null."""
    rows = measured(docs.select(host, "text"), rules, host)
    keyed = with_keys(docs, host)
    found = shortened(keyed, rows, rules).select("__host", "__digest", F.col("removed").alias("__removed"))
    joined = keyed.join(small(found), ["__host", "__digest"], "left").select(*(f"`{c}`" for c in docs.columns), "__removed")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, gone = batch.schema.get_field_index("text"), batch.schema.get_field_index("__removed")
            texts = [strip_lines(t, set(k)) if t and k else t for t, k in zip(batch.column(at).to_pylist(), batch.column(gone).to_pylist())]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns) if i != gone]
            return pa.RecordBatch.from_arrays(columns, [n for n in batch.schema.names if n != "__removed"])

        return run

    return arrow_map(joined, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def strip_lines(text: str, keys: set[int]) -> str:
    kept = []
    for line in text.split("\n"):
        found = line_words(line)
        if not found or line_key(normal(found[0])) not in keys:
            kept.append(line)
    return "\n".join(kept)
