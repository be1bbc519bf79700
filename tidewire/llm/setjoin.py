"""Near-duplicate documents by an exact Jaccard join over word shingles that uses the sets' relations.

Sets are ordered by one order of shingles (rare ones first), so two sets that reach the threshold share a shingle in
their prefixes. Index lists hold, per shingle, the sets with their sizes and the shingle's position.

* Within a list, sets are skipped by position: what two sets can still share behind the position bounds their
  overlap, and a list is read in order of size, where the bound on sizes ends a block.
* Equal sets are one class, answered once. In a list one set leads. Every set is first compared with the leader that
  shares most of its prefix, and takes over the leader's answer - its component - if it links to it. Only pairs of
  sets whose components still differ are compared after that, so a group of very similar sets costs one comparison
  each and never all pairs.
* What leaders leave open in long lists is compared in blocks: a task takes two blocks of sets, drops pairs by bitmaps,
  counts what the rest share, and gives only links that join sets not joined yet. Pairs are never rows. The sets of a
  list's largest component meet the sets outside it only, so few sets outside cost rows in proportion to the list.

Sets are known by a hash of their shingles, so rows may repeat a ``doc_id`` with other texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm import words
from tidewire.llm.components import components
from tidewire.llm.frames import arrow_map, discard, small, text_chunks, written

TABLE = words.byte_table(words.SPACES, lower=True)
SHINGLE = 5
#: The threshold as a fraction: intersection / union >= OF / TO.
OF, TO = 3, 4

#: Every how many documents are looked at for frequent shingles, from how many of them a shingle counts as frequent,
#: and how many frequent ones are kept. They only order shingles: any choice gives the same links.
LOOK, OFTEN, MOST_FREQUENT = 8, 6, 1 << 18
#: Mask of a position in the long that holds size and position.
LOW = (1 << 32) - 1
#: Parts that the list of a frequent shingle is cut into.
CUTS = 32
#: Rounds of leaders, at most. What is open then is compared pair by pair or in blocks, so this only steers the work.
MOST_ROUNDS = 1
#: Pairs that a list may hold, by size and position, to be compared as rows: the sets of a list of more are compared in blocks.
#: Sets and shingles of a block, about. They only steer the work.
LIST_PAIRS, BLOCK_SETS, BLOCK_SHINGLES = 200, 1024, 1 << 19


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for first, end, data, offsets in text_chunks(column):
        found = words.scan(data, offsets, TABLE)
        for row in range(end - first):
            yield np.unique(words.windows(found.of(row), SHINGLE))


def prefix_length(n: int) -> int:
    """Places of the order in which a set of ``n`` must share one with any set that reaches the threshold."""
    return n - -(-OF * n // TO) + 1


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes of frequent shingles, rarest first: counted over every ``LOOK``-th distinct text, at most ``MOST_FREQUENT``.

    This is only the order of the prefix filter. A frequent shingle that is missed makes a list longer, no more.
    """
    looked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(LOOK)) == 0).select("text")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(list(shingle_sets(batch.column(0)))), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

        return run

    counts = arrow_map(looked, make, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    top = counts.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()
    return top.column("token").to_numpy()[::-1].view(np.uint64)


def set_hash(own: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Per row: ``doc_id``, ``text_hash``, ``n`` (set size), ``node`` (hash of the set), ``prefix`` (its first shingles in the
    order) and ``rare`` (how many of them are not frequent)."""
    held = docs.sparkSession.sparkContext.broadcast((np.sort(frequent), np.argsort(frequent, kind="stable")))

    def make():
        known, place = held.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, nodes, prefixes, rare = [], [], [], []
            for own in shingle_sets(batch.column(2)):
                n = len(own)
                sizes.append(n)
                nodes.append(set_hash(own))
                cut = prefix_length(n) if n else 0
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                often = known[at] == own if len(known) else np.zeros(n, bool)
                first = own[~often][:cut]
                rare.append(len(first))
                if len(first) < cut:
                    rest = own[often][np.argsort(place[at[often]], kind="stable")]
                    first = np.concatenate((first, rest[: cut - len(first)]))
                prefixes.append(first.view(np.int64))
            new = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(rare, pa.int32())]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], ["doc_id", "text_hash", "n", "node", "prefix", "rare"])

        return run

    rows = docs.select("doc_id", "text_hash", "text")
    return arrow_map(rows, make, "doc_id bigint, text_hash bigint, n bigint, node bigint, prefix array<bigint>, rare int")


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    """One bit per shingle, by the low bits of its hash; as 64-bit integers."""
    marks = np.zeros(bits, np.uint8)
    marks[(own & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").view(np.int64)


def sets_of(docs: DataFrame, ids: DataFrame, handles: DataFrame) -> DataFrame:
    """``node``, ``n``, its shingles, and bitmaps of them (at least two bits a shingle in ``wide``, half as many in
    ``narrow``) for the sets named in ``ids`` (``node``); ``handles`` names a document of each set."""
    wanted = written(ids.join(handles, "node").select("doc_id").distinct(), "set-documents", ids.count())
    rows = docs.join(small(wanted), "doc_id", "left_semi").select("doc_id", "text")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = list(shingle_sets(batch.column(1)))
            bits = [max(128, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 128 for s in sets]
            longs = pa.list_(pa.int64())
            columns = [
                pa.array([set_hash(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s.view(np.int64) for s in sets], longs),
                pa.array([bitmap(s, b) for s, b in zip(sets, bits)], longs),
                pa.array([bitmap(s, b // 2) for s, b in zip(sets, bits)], longs),
            ]
            return pa.RecordBatch.from_arrays(columns, ["node", "n", "shingles", "wide", "narrow"])

        return run

    made = arrow_map(rows, make, "node bigint, n bigint, shingles array<bigint>, wide array<bigint>, narrow array<bigint>")
    return made.join(small(ids), "node", "left_semi")  # a document's other texts are not asked for


def _can_link(n1: str, p1: str, n2: str, p2: str) -> str:
    """Sizes within the threshold, and enough left behind both positions for the overlap it asks for."""
    need = f"{OF + TO} * least({n1} - {p1}, {n2} - {p2}) >= {OF} * ({n1} + {n2})"
    return f"{TO} * least({n1}, {n2}) >= {OF} * greatest({n1}, {n2}) and {need}"


def verified(pairs: DataFrame, docs: DataFrame, handles: DataFrame) -> DataFrame:
    """``pairs`` (``a``, ``b``) whose sets reach the threshold, as a written table; the sets are made again from the texts they
    need.

    Bits in which two bitmaps of one width differ are no more than the shingles in which the sets differ, so pairs that
    differ in too many are dropped before whole sets are joined.
    """
    most = pairs.count()
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "verify-ids", 2 * most)
    sets = written(sets_of(docs, ids, handles), "verify-sets")

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    marked = pairs.join(side("a", "n", "wide", "narrow"), "a").join(side("b", "n", "wide", "narrow"), "b")
    own = "if(size(wide_a) > size(wide_b), narrow_a, wide_a)"
    other = "if(size(wide_b) > size(wide_a), narrow_b, wide_b)"
    differ = F.expr(f"aggregate(zip_with({own}, {other}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")
    # sizes of sets that can link are so close that their widths differ by a factor of two at most
    close = f"{TO} * least(n_a, n_b) >= {OF} * greatest(n_a, n_b)"
    kept = written(marked.where(close).where((TO - OF) * (F.col("n_a") + F.col("n_b")) >= (OF + TO) * differ).select("a", "b").distinct(), "verify-pairs", most)
    both = kept.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    found = written(both.where((OF + TO) * common >= OF * (F.size("shingles_a") + F.size("shingles_b"))).select("a", "b").distinct(), "verified-links", kept.count())
    discard(ids, sets, kept)
    return found


def link_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``text_hash``, ``n_shingles``, ``component_id``, ``component``.

    Documents link if their sets of distinct five-word shingles reach the threshold; the component is the smallest
    ``doc_id`` reachable. A text with fewer words is one shingle; null, empty and word-free texts have no shingle and
    are components of their own. A null ``doc_id`` links with nothing and has a null component. Rows that repeat a
    ``doc_id`` stay rows, each in its own text's component; ``component``, a hash, tells components apart where one id has
    several (null without shingles or id). Other columns are not read. An empty table gives no rows.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(coalesce(text, '')) text_hash", "text")
    signs = signatures(rows, frequent_shingles(rows))
    members = written(signs.select("doc_id", "text_hash", "n", "node"), "members")
    named = "doc_id is not null and n > 0"
    # classes of equal sets; only those with several members need a table
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    classes = members.where(named).groupBy("node").agg(first, F.count("*").alias("copies")).where("copies > 1").select("node", "first")
    classes = written(classes, "set-classes")
    leads = "first is null or doc_id = first.doc_id and text_hash = first.text_hash"
    # prefixes are made again from the texts rather than kept: they are as large as the texts
    heads = signs.where(named).join(small(classes), "node", "left").where(leads).select("node", "n", "prefix", "rare")
    index = written(index_lists(heads), "index-lists")
    handles = written(members.where(named).join(small(classes), "node", "left").where(leads).select("node", "doc_id").distinct(), "set-handles")
    found = components_of(index, rows, handles)
    rooted = members.join(small(found), "node", "left").withColumn("root", F.expr(f"if({named}, coalesce(component, node), null)"))
    lows = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")).where("rows > 1")
    joined = rooted.join(small(written(lows.select("root", "low"), "lowest-ids")), "root", "left")
    return joined.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"), F.col("root").alias("component"))


def index_lists(heads: DataFrame) -> DataFrame:
    """Index lists that may hold a pair: ``token``, ``cut``, ``node``, ``n``, ``pos``.

    The list of a frequent shingle is cut into parts by the sets' hash (``cut`` 1 and up), so no task reads a whole
    one. Of other lists, sets are dropped that no set beside them in order of size is near enough to, and whole lists
    of one set, or of two that cannot link by size and position. List key, set and (size, position) are one long each
    while they are shuffled.
    """
    places = heads.select("node", "n", "rare", F.posexplode("prefix").alias("pos", "token"))
    often = F.col("pos") >= F.col("rare")
    cut = F.when(often, F.pmod(F.xxhash64("node"), F.lit(CUTS)) + 1).otherwise(0)
    packed = places.select(
        F.when(often, F.xxhash64("token", cut)).otherwise(F.col("token")).alias("list"),
        F.when(often, F.col("token")).alias("token"),
        "node",
        (F.col("n") * F.lit(1 << 32) + F.col("pos")).alias("place"),
    )
    # in order of size, the sets beside a set are those nearest to it in size
    beside = W.partitionBy("list").orderBy("place", "node")
    for name, at in (("before", F.lag("place").over(beside)), ("before2", F.lag("place", 2).over(beside)), ("after", F.lead("place").over(beside)), ("after2", F.lead("place", 2).over(beside))):
        packed = packed.withColumn(name, at)

    def fits(other: str, alone: str) -> Column:
        """Whether the set beside is near enough in size; where the two are the whole list, by position too."""
        n, m = F.shiftright("place", 32), F.shiftright(other, 32)
        left = F.least(n - F.col("place").bitwiseAND(LOW), m - F.col(other).bitwiseAND(LOW))
        near = TO * F.least(n, m) >= OF * F.greatest(n, m)
        return F.col(other).isNotNull() & near & (~F.expr(alone) | ((OF + TO) * left >= OF * (n + m)))

    shared = fits("before", "after is null and before2 is null") | fits("after", "before is null and after2 is null")
    kept = packed.where(F.col("token").isNotNull() | F.coalesce(shared, F.lit(False)))
    return kept.select(
        F.coalesce("token", "list").alias("token"),
        F.when(F.col("token").isNotNull(), F.pmod(F.xxhash64("node"), F.lit(CUTS)) + 1).otherwise(0).cast("int").alias("cut"),
        "node",
        F.shiftright("place", 32).alias("n"),
        F.col("place").bitwiseAND(LOW).alias("pos"),
    )


def components_of(index: DataFrame, rows: DataFrame, handles: DataFrame) -> DataFrame:
    """Components of the sets in the index (``node``, ``component``; sets without a link may be left out).

    In a round every set whose list holds other components is compared with one leader, chosen anew by hash, and takes
    over its answer. Rounds end when one finds less than a tenth of the first one's links. Of what is then open, short
    lists are compared pair by pair between components, long ones in blocks.
    """
    links: DataFrame | None = None
    tried: DataFrame | None = None
    found = index.sparkSession.createDataFrame([], "node bigint, component bigint")
    live, first = index, 0
    for turn in range(MOST_ROUNDS):
        if turn:
            live = _next(live, found)
        else:
            live = live.withColumn("component", F.col("node"))
        asked = leader_pairs(live, turn)
        asked = written(asked if tried is None else asked.join(tried, ["a", "b"], "left_anti"), "leader-pairs")
        new = verified(asked, rows, handles)
        tried = asked if tried is None else tried.unionByName(asked)
        count = new.count()
        first = first or count
        if count:
            links = new if links is None else links.unionByName(new)
            found = components(links)
        if 10 * count < first or not count:
            break
    # what the leaders leave open
    live = _next(live, found)
    long = written(long_lists(live), "long-list-tokens")
    pairs = written(all_pairs_between(live.join(small(long), "token", "left_anti")).join(tried, ["a", "b"], "left_anti"), "open-pairs")
    new = verified(pairs, rows, handles)
    if long.limit(1).count():
        new = new.unionByName(block_links(live.join(small(long), "token", "left_semi"), rows, handles))
    if new.limit(1).count():
        found = components(new if links is None else links.unionByName(new))
    discard(live)
    return found


def _next(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The lists that are still mixed, as a written table; the table before is not needed any more."""
    left = written(mixed_lists(lists, found), "live-lists")
    discard(lists)
    return left


def long_lists(live: DataFrame) -> DataFrame:
    """``token`` of lists with more than ``LIST_PAIRS`` pairs between components that sizes and positions allow, at most.

    Of two sets that may link the smaller one has the shingle within the first seventh of its places, and the other is
    at most a third larger.
    """
    may = F.expr(f"cast(({OF + TO}) * pos <= ({TO - OF}) * n as int)")
    scaled = live.withColumn("scale", F.floor(F.log("n") * 1e6)).withColumn("may", may)
    reach = -math.ceil(math.log(TO / OF) * 1e6) - 1

    def met(*keys: str) -> Column:
        return F.sum("may").over(W.partitionBy(*keys).orderBy("scale").rangeBetween(reach, 0))

    counted = scaled.withColumn("others", met("token") - met("token", "component"))
    return counted.groupBy("token").agg(F.sum("others").alias("pairs")).where(F.col("pairs") > LIST_PAIRS).select("token")


def block_links(lists: DataFrame, rows: DataFrame, handles: DataFrame) -> DataFrame:
    """Links that connect, with the components so far, all sets of the long ``lists`` that link, as a written table.

    Lists led by the same set are one region. The sets of its largest component are dealt to ``inner`` blocks and the others
    to ``outer`` ones; every two blocks meet in a group, but for two inner ones, whose sets are connected already.
    """
    order = F.struct(F.xxhash64("node").alias("order"), "node")
    leads = written(lists.groupBy("token").agg(F.min(order).alias("lead")).select("token", F.col("lead.node").alias("to")), "list-leads")
    members = written(lists.join(small(leads), "token").select("to", "node", "n", "component").distinct(), "regions")
    sums = members.groupBy("to", "component").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    whole = sums.groupBy("to").agg(F.max(F.struct("sets", "component", "shingles")).alias("top"), F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles"))

    def blocks(sets: str, shingles: str) -> Column:
        return F.expr(f"greatest(1L, ceil(({sets}) / {BLOCK_SETS}), ceil(({shingles}) / {BLOCK_SHINGLES}))")

    outer, inner = blocks("sets - top.sets", "shingles - top.shingles"), blocks("top.sets", "top.shingles")
    regions = written(whole.select("to", F.col("top.component").alias("largest"), outer.alias("outer"), inner.alias("inner")), "region-blocks")
    dealt = members.join(small(regions), "to").withColumn("mark", F.xxhash64("node", "to"))
    dealt = dealt.withColumn("block", F.expr("if(component = largest, outer + pmod(mark, inner), pmod(mark, outer))"))
    meets = F.explode(F.expr("sequence(0L, if(component = largest, outer, outer + inner) - 1)"))
    placed = dealt.select("to", "node", "component", "block", meets.alias("other"))
    placed = placed.select("to", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component")
    ids = written(members.select("node").distinct(), "block-ids")
    sets = written(sets_of(rows, ids, handles).select("node", "shingles"), "block-sets")
    groups = placed.join(sets, "node").groupBy("to", "low", "high")
    found = written(groups.applyInArrow(_connecting, "a bigint, b bigint").distinct(), "block-links")
    discard(members, ids, sets)
    return found


def _connecting(table: pa.Table) -> pa.Table:
    """Links between the two blocks of a group (inside it, if it is one) that connect all its sets that link."""
    node, block = (table.column(c).to_numpy() for c in ("node", "block"))
    joined = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
    lists = table.column("shingles").combine_chunks()
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    flat = lists.flatten().to_numpy().view(np.uint64)
    tokens = np.unique(flat, return_inverse=True)[1]
    bits = min(1 << 14, max(256, 1 << (4 * int(n.max()) - 1).bit_length()))
    maps = np.zeros((len(n), bits), np.uint8)
    maps[np.repeat(np.arange(len(n)), n), (flat & np.uint64(bits - 1)).astype(np.int64)] = 1
    maps = np.packbits(maps, axis=1).view(np.uint64)
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    others = np.flatnonzero(block == high)
    own, own_maps, own_n = np.zeros(len(tokens) and int(tokens.max()) + 1, bool), maps[others], n[others]
    links: list[tuple[int, int]] = []
    for x in np.flatnonzero(block == low):
        may = (joined[others] != joined[x]) & (TO * np.minimum(own_n, n[x]) >= OF * np.maximum(own_n, n[x]))
        if low == high:
            may &= others > x
        at = np.flatnonzero(may)
        # bits that differ are no more than the shingles that do
        differ = np.bitwise_count(own_maps[at] ^ maps[x]).sum(1, dtype=np.int64)
        near = (TO - OF) * (n[x] + own_n[at]) >= (OF + TO) * differ
        left = others[at[near][np.argsort(differ[near], kind="stable")]]
        mine = tokens[ends[x] - n[x] : ends[x]]
        own[mine] = True
        step = 16
        while len(left):
            part, left = left[:step], left[step:]
            step *= 2
            heads = np.cumsum(n[part]) - n[part]
            places = np.arange(int(n[part].sum())) + np.repeat(ends[part] - n[part] - heads, n[part])
            common = np.add.reduceat(own[tokens[places]], heads, dtype=np.int64)
            for y in part[(OF + TO) * common >= OF * (n[x] + n[part])]:
                if joined[y] != joined[x]:
                    links.append((max(node[x], node[y]), min(node[x], node[y])))
                    joined[joined == joined[y]] = joined[x]
            left = left[joined[left] != joined[x]]
        own[mine] = False
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def mixed_lists(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Lists (all parts together) that hold sets of several components, with each set's ``component``."""
    placed = lists.select("token", "cut", "node", "n", "pos").join(small(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    return placed.join(mixed, "token", "left_semi")


def leader_pairs(live: DataFrame, turn: int) -> DataFrame:
    """One pair per set: with the leader, of another component, that leads most of its lists.

    Leaders are first by hash, the same order in all lists, so similar sets have the same one. The leaders of a
    frequent shingle's parts follow the first of them.
    """
    order = F.xxhash64("node", F.lit(turn))
    who = F.struct(order.alias("order"), "node", "n", "pos", "component")
    led = live.withColumn("lead", F.first(who).over(W.partitionBy("token", "cut").orderBy(order, "node", "pos")))
    heads = led.where("cut > 0 and lead.node = node").select("token", "node", "n", "pos", "component")
    first = heads.groupBy("token").agg(F.min(who).alias("lead"))
    columns = ["node", "n", "pos", "component", "lead"]
    parts = heads.join(first, "token").select(*columns, F.lit(1).alias("kind"))
    asked = led.select(*columns, F.lit(0).alias("kind")).unionByName(parts).where("lead.component <> component and " + _can_link("n", "pos", "lead.n", "lead.pos"))
    shared = asked.groupBy("node", "kind", F.col("lead.node").alias("to")).agg(F.count("*").alias("common"))
    best = shared.groupBy("node", "kind").agg(F.max(F.struct("common", (-F.col("to")).alias("less"))).alias("top")).select("node", (-F.col("top.less")).alias("to"))
    return best.select(F.greatest("node", "to").alias("a"), F.least("node", "to").alias("b")).distinct()


def all_pairs_between(live: DataFrame) -> DataFrame:
    """Pairs of sets of different components that share a list and may reach the threshold."""
    x = live.select("token", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "pos", "component")])
    y = live.select("token", *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "pos", "component")])
    # the first of a pair is the smaller set: the order in which a list is read
    smaller = "(n_x < n_y or n_x = n_y and node_x < node_y)"
    met = x.join(y, "token").where(f"component_x <> component_y and {smaller} and " + _can_link("n_x", "pos_x", "n_y", "pos_y"))
    return met.select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b")).distinct()
