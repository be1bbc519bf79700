"""Sharding by balanced label propagation: equal texts move together, shard sizes stay even.

Documents with the same text are linked. Every linked document begins in a shard chosen by hash; in each round the
links' shards are counted per text, each document wants the shard where most of its text's copies are, and moves as
far as the shard's quota goes, free places and those that leavers make. Documents without links fill the shards at the end, so that row counts differ
by at most one. All steps are DataFrame joins and aggregations; the driver only sees one number per shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.frames import small, written

#: Share of a shard's quota above which it takes no more moves in a round, and share of its room that moves may fill.
FULL, FILL = 0.9, 0.98


def described(docs: DataFrame) -> DataFrame:
    """One row per document: ``rid`` (the row's own number, high bits its partition), ``doc_id``, ``size``,
    ``text_crc32`` and ``link`` (digest of the text). Null texts are empty."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 8).alias("size"),
        F.crc32(text).cast("bigint").alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("link"),
    )
    return written(rows.withColumn("rid", F.monotonically_increasing_id()), "shard-rows")


def _array(values: list[int | float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _per_shard(df: DataFrame, column: str, shards: int) -> list[int]:
    """Rows per shard, the only thing the driver collects: one number each."""
    found = {r[0]: r[1] for r in df.groupBy(column).agg(F.count("*")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(linked: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """Labels of the linked documents (``rid``, ``link``, ``shard``) after at most ``rounds`` rounds.

    A round ends the loop when nobody moves. Of shards with equally many copies the text's hash picks one, so ties
    spread over all shards; a full shard that nobody leaves is passed over for the next best. A text with more copies than a shard
    holds fills one shard after another.
    """
    # the shard and the hash of a text are combined so that both sides of a move are compared by one struct
    rank = F.struct(F.col("n"), F.xxhash64("link", "shard").alias("tie"), F.col("shard").alias("at"))
    leaving = None
    for turn in range(rounds):
        load = _per_shard(linked, "shard", shards)
        leaving = leaving or load
        # of those that wanted to leave in the last round, about half will have gone
        open_to = [int(n - out / 2 < FULL * quota) for n, out in zip(load, leaving)]
        counts = linked.groupBy("link", "shard").agg(F.count("*").alias("n")).withColumn("rank", rank)
        counts = written(counts.select("link", "shard", "rank"), "shard-counts")
        best = counts.where(F.element_at(_array(open_to), F.col("shard") + 1) == 1).groupBy("link").agg(F.max("rank").alias("best"))
        moves = written(counts.join(best, "link").where("best > rank").select("link", "shard", F.col("best.at").alias("target"), F.col("rank.n").alias("n")), "shard-moves")
        asked = {r[0]: r[1] for r in moves.groupBy("target").agg(F.sum("n")).collect()}
        if not asked:
            break
        gone = {r[0]: r[1] for r in moves.groupBy("shard").agg(F.sum("n")).collect()}
        leaving = [gone.get(s, 0) for s in range(shards)]
        room = [max(0.0, quota - load[s] + leaving[s] / 2) for s in range(shards)]
        share = [min(1.0, FILL * room[s] / asked[s]) if asked.get(s) else 0.0 for s in range(shards)]
        dice = F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(1_000_000)) / 1_000_000.0
        goes = F.col("target").isNotNull() & (dice < F.element_at(_array(share), F.col("target") + 1))
        linked = written(
            linked.join(small(moves.select("link", "shard", "target")), ["link", "shard"], "left").select("rid", "link", F.when(goes, F.col("target")).otherwise(F.col("shard")).alias("shard")),
            "shard-labels",
        )
    return linked


def _numbered(df: DataFrame, *groups: str) -> DataFrame:
    """``number``: gapless from 0 within ``groups``, in ``rid`` order.

    Rows are numbered within their input partition, which the high bits of ``rid`` name, and the partitions' counts
    are added up; no task sees more rows than one input partition has.
    """
    df = df.withColumn("part", F.shiftright("rid", 33))
    counts = df.groupBy(*groups, "part").agg(F.count("*").alias("n"))
    before = W.partitionBy(*groups).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*groups, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = F.row_number().over(W.partitionBy(*groups, "part").orderBy("rid")) - 1
    numbered = df.withColumn("inner", inner).join(F.broadcast(offsets), [*groups, "part"])  # one row per input partition and shard
    return numbered.withColumn("number", F.col("inner") + F.col("before")).drop("inner", "before", "part")


def assign(docs: DataFrame, shards: int = 24, rounds: int = 12) -> DataFrame:
    """Every row of ``docs`` in a shard: ``doc_id``, ``size``, ``text_crc32``, ``law`` (always ``rows``), ``shard``,
    ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (null).

    The law: the shards' row counts differ by at most one. ``size`` is the text's UTF-8 bytes plus 8. Null texts
    count as empty; empty texts are linked like any other equal texts; repeated rows are rows of their own; a null
    ``doc_id`` is a row like any other; an empty table gives no rows. Other columns are not read.
    """
    rows = described(docs)
    total = rows.count()
    base, extra = divmod(total, shards)
    quotas = [base + (s < extra) for s in range(shards)]
    groups = written(rows.groupBy("link").agg(F.count("*").alias("copies")).where("copies > 1").select("link"), "shard-links")
    marked = written(rows.select("rid", "link").join(small(groups.withColumn("linked", F.lit(True))), "link", "left").select("rid", F.when(F.col("linked"), F.col("link")).alias("link")), "shard-marked")
    linked = written(marked.where("link is not null").withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")), "shard-labels")
    linked = propagate(linked, shards, base, rounds)
    placed = written(_numbered(linked.select("rid", "shard"), "shard"), "shard-placed")
    quota = F.element_at(_array(quotas), F.col("shard") + 1)
    kept = placed.where(F.col("number") < quota).select("rid", "shard", F.col("number").alias("slot"))
    # what a shard cannot hold and what has no links fill the places that are left, in row order
    free = marked.where("link is null").select("rid").unionByName(placed.where(F.col("number") >= quota).select("rid"))
    have = [min(n, q) for n, q in zip(_per_shard(placed, "shard", shards), quotas)]
    ends, at = [], 0
    for s in range(shards):
        at += quotas[s] - have[s]
        ends.append(at)
    starts = [e - (q - h) for e, q, h in zip(ends, quotas, have)]
    shard = F.size(F.filter(_array(ends), lambda e: e <= F.col("number"))).cast("int")
    filled = _numbered(free.withColumn("all", F.lit(0)), "all").withColumn("shard", shard)
    slot = F.col("number") - F.element_at(_array(starts), F.col("shard") + 1) + F.element_at(_array(have), F.col("shard") + 1)
    where = kept.unionByName(filled.select("rid", "shard", slot.cast("bigint").alias("slot")))
    return rows.join(where, "rid").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
