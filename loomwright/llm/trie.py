"""Prefix trie of conversations, built level by level and rolled up level by level.

A node of depth d is a distinct sequence of d turns; its number is the least
conversation of its members, which within a depth names one node. Each level
groups the conversations still live by (parent node, next turn) and takes the
least id. A conversation that is alone in its node leaves the live ones: what
follows is a chain of its own, written out without further levels. So there are
as many levels as turns that two conversations share from their start.

Turns enter as a hash (SHA-256 of role and text) and a size, so texts are read
once. Turns are numbered without a window over a conversation: rows are sorted
by range, numbered within their part, and the few conversations that span parts
get the counts of the parts before. Conversations are joined back to their
group with hot groups by broadcast (operators/skew.py). Each level is a table
in the shared folder; a lost executor costs one level.

The members that end at a node are hashed as one string, in order. Their ids
are sorted by range and packed into pieces of PIECE bytes; the task that hashes
a node streams its pieces, so it holds one at a time and sees few rows.

Defined results: null roles and texts are empty; null turns come first; rows of
one conversation and turn are ordered by their hash, so repeated rows are two
equal turns; rows of a null conversation take no part; other columns are
ignored; a table without conversations gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.skew import hot_join
from loomwright.sources.shared import discard, written

PIECE = 1 << 20
#: Most turns that a conversation takes from its base (the contract's modulus less one).
BORROWED = 8
NO_END = hashlib.sha256(b"").hexdigest()
TURNS = "conv_id long, depth long, turn binary, bytes long"


def numbered_turns(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth (from 1), hash and size of each turn; a written table."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    one = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = table.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("at"), one.alias("turn"), F.octet_length(text).cast("long").alias("bytes"))
    raw = written(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    parts = max(1, raw.rdd.getNumPartitions())
    order = ("conv_id", F.col("at").asc_nulls_first(), "turn", "row")

    def number(batches):
        last, n = None, 0
        for b in batches:
            out = []
            for c in b.column("conv_id").to_pylist():
                last, n = (c, n + 1) if c == last else (c, 1)
                out.append(n)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(out, pa.int64()), b.column("turn"), b.column("bytes")], names=["conv_id", "depth", "turn", "bytes"])

    sorted_rows = raw.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("at", "row")
    placed = written(sorted_rows.mapInArrow(number, TURNS).withColumn("part", F.spark_partition_id()), "numbered")
    discard(raw)
    counts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    spanning = counts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts")).where(F.size("parts") > 1)
    # a part spans two conversations' borders at most, so these are fewer rows than twice the parts
    before = spanning.select("conv_id", F.explode(F.transform("parts", lambda p: F.struct(p["part"].alias("part"), F.aggregate(F.filter("parts", lambda q: q["part"] < p["part"]), F.lit(0).cast("long"), lambda a, q: a + q["n"]).alias("before")))).alias("p")).select("conv_id", "p.*")
    return placed.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("depth") + F.coalesce("before", F.lit(0))).alias("depth"), "turn", "bytes")


def rebuilt(turns: DataFrame, base: Callable[[Column], Column], borrowed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and each conversation's number of turns.

    Conversation c takes the first borrowed(c) turns of base(c), BORROWED at most, then its own after as many.
    """
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.max("depth").alias("own"))
    plan = sizes.select("conv_id", "own", base(c).alias("base"), F.least(borrowed(c), F.lit(BORROWED)).cast("long").alias("h"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    plan = written(plan.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "plan")
    first = turns.where(F.col("depth") <= BORROWED).withColumnRenamed("conv_id", "base").join(plan.where("taken > 0").select("conv_id", "base", "taken"), "base").where("depth <= taken").select("conv_id", "depth", "turn", "bytes")
    # a conversation's own turns follow what was taken, which is less than what they make room for where the base is short
    rest = turns.where(F.col("depth") > F.least(borrowed(c), F.lit(BORROWED)))
    rest = hot_join(rest, plan.select("conv_id", (F.col("h") - F.col("taken")).alias("gap")), ["conv_id"], rest.count())
    rest = rest.select("conv_id", (F.col("depth") - F.col("gap")).alias("depth"), "turn", "bytes")
    return first.unionByName(rest), plan.select("conv_id", "size")


def _levels(turns: DataFrame, sizes: DataFrame) -> list[DataFrame]:
    """The conversations live at each depth with their node: conv_id, size, parent, node, n_convs and bytes; a written table a level.

    A node is the row of its least conversation. Rows of nodes of one conversation don't go on to the next level.
    """
    least = sizes.agg(F.min("conv_id").alias("m"), F.count("*").alias("n"), F.count_if(F.col("size") > 0).alias("more")).first()
    if not least["n"]:
        return []
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    levels = [sizes.select("conv_id", "size", none.alias("parent"), F.lit(least["m"]).alias("node"), F.lit(least["n"]).alias("n_convs"), zero.alias("bytes"))]
    live, count = levels[0], least["more"]
    while count:
        depth = len(levels)
        now = turns.where(F.col("depth") == depth).select("conv_id", "turn", "bytes")
        step = live.where(F.col("size") >= depth).select("conv_id", "size", F.col("node").alias("parent")).join(now, "conv_id")
        groups = step.groupBy("parent", "turn").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"))
        level = written(hot_join(step, groups, ["parent", "turn"], count).select("conv_id", "size", "parent", "node", "n_convs", "bytes"), "level")
        levels.append(level)
        live = level.where("n_convs > 1")
        count = live.where(F.col("size") > depth).count()
    return levels


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _ends(levels: list[DataFrame]) -> DataFrame:
    """depth, node and the hash of the ids of those that end there, for nodes of several conversations and the root."""
    ends = _union([live.where((F.col("size") == depth) & ((F.col("n_convs") > 1) | F.lit(depth == 0))).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id") for depth, live in enumerate(levels)])

    def packed(batches):
        key, ids, size = None, [], 0

        def piece():
            return pa.RecordBatch.from_pylist([{"depth": key[0], "node": key[1], "first": int(ids[0]), "ids": ",".join(ids)}], pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

        for b in batches:
            for d, n, c in zip(*(b.column(k).to_pylist() for k in ("depth", "node", "conv_id")), strict=True):
                if (d, n) != key or size > PIECE:
                    if ids:
                        yield piece()
                    key, ids, size = (d, n), [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def hashed(batches):
        key, h = None, None
        names = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())])
        for b in batches:
            out = []
            for d, n, ids in zip(*(b.column(k) for k in ("depth", "node", "ids")), strict=True):
                if (d.as_py(), n.as_py()) != key:
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = (d.as_py(), n.as_py()), hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.as_py().encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, h.hexdigest())], schema=names)

    order = ("depth", "node", "conv_id")
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, "depth long, node long, first long, ids string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(hashed, "depth long, node long, ends_sha256 string")


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, depth from 1, turn, bytes) with their number of turns; see the module."""
    turns = written(turns.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "steps")  # a level reads its own row groups
    sizes = written(sizes, "sizes")
    levels = _levels(turns, sizes)
    if not levels:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    zero, one = (F.lit(k).cast("long") for k in (0, 1))
    below, rolled, tops = None, [], []
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth].where("conv_id = node").select("conv_id", F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "size", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
        alone = F.col("n_convs") == 1 if depth else F.lit(False)
        tops.append(nodes.where(alone))  # of chains: nothing but one leaf below them
        own = nodes.where(~alone).drop("size")
        if below is None:
            own = own.select("*", zero.alias("n_children"), one.alias("n_leaves"), zero.alias("under"))
        else:
            own = own.join(below.withColumnRenamed("parent_conv_id", "conv_id"), "conv_id", "left")
        now = written(own.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", one).alias("n_leaves"), (F.col("own") + F.coalesce("under", zero)).alias("saved_tokens")), "rolled")
        rolled.append(now)
        up = now.select("parent_conv_id", "n_leaves", "saved_tokens").unionByName(tops[-1].select("parent_conv_id", one.alias("n_leaves"), zero.alias("saved_tokens")))
        below = up.groupBy("parent_conv_id").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("under"))
    shared, tops = _union(rolled), _union(tops)
    shared = shared.join(_ends(levels).withColumnRenamed("node", "conv_id"), ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_END)))
    shared = shared.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    chain = tops.select("conv_id", F.col("depth").alias("top"), F.col("parent_conv_id").alias("above"), "size", F.explode(F.sequence("depth", "size")).alias("depth"))
    last = F.col("depth") == F.col("size")
    chain = chain.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NO_END)).alias("ends_sha256"),
    )
    return shared.unionByName(chain)
