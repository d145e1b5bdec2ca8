"""Conversation prefix trie: depth-band rollup.

A node is a distinct sequence of first turns. Its key is the exclusive-or of 2 x 64
bit hashes of its turns, salted with their places, so that prefixes are running
sums: blocks of a long conversation are hashed apart and their totals carried on.

Sums over subtrees take two steps. The tree is cut into bands of ``HEIGHT`` levels;
every node explodes to its ancestors inside its own band, which gives sums within
bands. The nodes on top of bands form a tree of their own, ``HEIGHT`` times lower, which
is summed in the same way. Then each band's top passes its completed total to its
ancestors in the band above. A node is sent ``HEIGHT`` times at most, and the
number of rounds is the logarithm of the depth.

The ids of conversations that end at a node are sorted across the cluster, joined to
pieces of bounded size there, and the pieces of a node run through one hash in
order: of a node at which very many end, one task sees few rows, and keeps none.

Defined results: a null role or text is empty. Turns are in order of their number,
null first; equal numbers by a hash of role and text, so repeated rows are repeated
turns. Rows without a conversation id belong to no conversation and are left out.
An empty text has no words. An empty table has no node, not even the root. Only the
four named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cropline.functions.joins import lookup
from cropline.functions.ranking import ordinals
from cropline.llm.common import WORD, column
from cropline.session import materialise

HEIGHT = 8
BLOCK = 1_024
# Bytes of joined ids in one row.
PIECE = 8_192


@dataclass(frozen=True)
class SharedHeads:
    """Conversations that begin with the first turns of another one.

    Conversation c begins with up to ``crc32(c) % most`` first turns of conversation
    ``c - c % period``, in place of as many of its own.
    """

    period: int = 20
    most: int = 4


def _turns(conversations: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """``conv``, ``place``, ``h1``, ``h2`` (hashes of role and text), ``words`` of every turn."""
    role, text = (F.coalesce(column(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    rows = conversations.filter(column(id_column).isNotNull()).select(
        column(id_column).cast("bigint").alias("conv"),
        column(turn_column).alias("turn"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), role, text).alias("h2"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    return materialise(ordinals(rows, ["conv"], ["turn", "h1", "h2"], "place").drop("turn"))


def _share_heads(turns: DataFrame, convs: DataFrame, shared: SharedHeads) -> DataFrame:
    """``turns`` after each conversation got the head of its base."""
    own = F.crc32(F.col("conv").cast("string").cast("binary")) % shared.most
    entry = F.struct("place", "h1", "h2", "words")
    # At most ``most - 1`` turns a base.
    heads = (
        turns.filter((F.col("conv") % shared.period == 0) & (F.col("place") < shared.most - 1))
        .groupBy(F.col("conv").alias("base"))
        .agg(F.array_sort(F.collect_list(entry)).alias("head"))
    )
    given = materialise(
        convs.select("conv", own.cast("int").alias("wanted"), (F.col("conv") - F.col("conv") % shared.period).alias("base"))
        .join(heads, "base", "left")
        .select("conv", "wanted", F.slice("head", F.lit(1), F.col("wanted")).alias("head"))
    )
    got = F.coalesce(F.size("head"), F.lit(0))
    shifts = materialise(given.filter(got < F.col("wanted")).select(F.col("conv").alias("short"), (got - F.col("wanted")).alias("shift")))
    rest = lookup(turns.filter(F.col("place") >= own), shifts, {"conv": "short"})
    moved = (F.col("place") + F.coalesce("shift", F.lit(0))).cast("int").alias("place")
    first = given.select("conv", F.inline("head"))
    return rest.select("conv", moved, "h1", "h2", "words").unionByName(first)


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv``, ``depth``, key ``k1``, ``k2``, parent's key ``p1``, ``p2``, ``words``: one row
    for every node on the way of every conversation, the root included."""
    salted = turns.select(
        "conv",
        "place",
        F.floor(F.col("place") / BLOCK).cast("int").alias("block"),
        F.xxhash64("place", "h1").alias("x1"),
        F.xxhash64("place", "h2").alias("x2"),
        "words",
    )
    inside = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    running = salted.withColumns({f"b{i}": F.bit_xor(f"x{i}").over(inside) for i in (1, 2)})
    # Only blocks behind the first of a conversation have something before them.
    before = Window.partitionBy("before").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = salted.groupBy(F.col("conv").alias("before"), F.col("block").alias("at")).agg(
        F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2")
    )
    offsets = materialise(
        blocks.withColumns({f"o{i}": F.bit_xor(f"t{i}").over(before) for i in (1, 2)})
        .filter("at > 0")
        .select("before", "at", "o1", "o2")
    )
    joined = lookup(running, offsets, {"conv": "before", "block": "at"})
    keys = {f"k{i}": F.col(f"b{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0).cast("bigint"))) for i in (1, 2)}
    rows = joined.withColumns(keys).select(
        "conv",
        (F.col("place") + 1).alias("depth"),
        "k1",
        "k2",
        F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"),
        "words",
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = [F.lit(0).alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("words")]
    return rows.unionByName(convs.select("conv", *root))


def _with_ancestors(rows: DataFrame, height: int) -> DataFrame:
    """``up``: keys of the ancestors from the top of the parent's band down to the parent."""
    band = Window.partitionBy("conv", F.ceil(F.col("depth") / height)).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keys = F.collect_list(F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2"))).over(band)
    return rows.withColumn("up", F.when(F.col("depth") > 0, keys).otherwise(F.slice(keys, 1, 0)))


def _sums(rows: DataFrame, sums: list[str]) -> DataFrame:
    return rows.groupBy("k1", "k2").agg(*[F.sum(c).alias(c) for c in sums])


def _subtree_sums(nodes: DataFrame, rows: DataFrame, sums: list[str], height: int) -> DataFrame:
    """Columns ``sums`` of every node added up over its subtree.

    ``nodes`` has keys, ``depth`` and ``up`` and is stored; ``rows`` are the stored rows of
    :func:`_with_ancestors` that the nodes come from.
    """
    something = F.lit(False)
    for c in sums:
        something = something | (F.col(c) != 0)
    is_top = F.col("depth") % height == 0

    def to_ancestors(df: DataFrame) -> DataFrame:
        return df.filter(something).select(F.inline("up"), *sums)

    inside = _sums(nodes.select("k1", "k2", *sums).unionByName(to_ancestors(nodes.filter(~is_top))), sums)
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None or deepest < height:
        return inside
    inside = materialise(inside)
    # The tops of bands, as a tree whose parents are the tops of the bands above.
    upper = F.get("up", F.lit(0))
    tops = rows.filter(is_top).select(
        "conv", (F.col("depth") / height).cast("int").alias("depth"), "k1", "k2", upper["k1"].alias("p1"), upper["k2"].alias("p2")
    )
    tops = materialise(_with_ancestors(tops, height))
    top_nodes = tops.groupBy("depth", "k1", "k2").agg(F.first("up").alias("up")).join(inside, ["k1", "k2"])
    totals = _subtree_sums(materialise(top_nodes), tops, sums, height)
    carried = nodes.filter(is_top & (F.col("depth") > 0)).drop(*sums).join(totals, ["k1", "k2"])
    return _sums(inside.unionByName(to_ancestors(carried)), sums)


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node in order, joined to pieces of at most about ``PIECE`` bytes."""
    node, first, ids, size = None, None, [], 0
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["k1", "k2", "first", "ids"])

    for batch in batches:
        for k1, k2, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if ids and (node != (k1, k2) or size >= PIECE):
                out.append((*node, first, ",".join(ids).encode()))
                ids, size = [], 0
                if len(out) == 1_024:
                    yield batch_of(out)
                    out = []
            if not ids:
                node, first = (k1, k2), conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        out.append((*node, first, ",".join(ids).encode()))
    if out:
        yield batch_of(out)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of every node, which come in order."""
    node, state = None, None
    for batch in batches:
        done = []
        for k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if node == (k1, k2):
                state.update(b",")
            else:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (k1, k2), hashlib.sha256()
            state.update(ids)
        yield _digests(done)
    if node:
        yield _digests([(*node, state.hexdigest())])


def _digests(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done)) or [(), (), ()]
    kinds = [pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["k1", "k2", "ends_sha256"])


def _ends(rows: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``ends_sha256`` of the nodes at which a conversation ends."""
    last = rows.groupBy("conv").agg(F.max_by("k1", "depth").alias("k1"), F.max_by("k2", "depth").alias("k2"))
    order = ["k1", "k2", "conv"]
    spread = last.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = spread.mapInArrow(_join_ids, "k1 bigint, k2 bigint, first bigint, ids binary")
    gathered = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return gathered.mapInArrow(_digest, "k1 bigint, k2 bigint, ends_sha256 string")


def conversation_trie(
    conversations: DataFrame,
    shared: SharedHeads | None = None,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    height: int = HEIGHT,
) -> DataFrame:
    """One row per node: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    turns = _turns(conversations, id_column, turn_column, role_column, text_column)
    convs = materialise(turns.select("conv").distinct())
    rebuilt = turns if shared is None else _share_heads(turns, convs, shared)
    rows = materialise(_with_ancestors(_prefixes(materialise(rebuilt), convs), height))
    found = materialise(
        rows.groupBy("depth", "k1", "k2").agg(
            F.min("conv").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.max("words").alias("words"),
            # Equal in all members.
            F.max("p1").alias("p1"),
            F.max("p2").alias("p2"),
            F.first("up").alias("up"),
        )
    )
    children = found.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(
        found.join(children, ["k1", "k2"], "left").withColumns(
            {
                "n_children": F.coalesce("n_children", F.lit(0).cast("bigint")),
                "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
                "n_leaves": F.col("n_children").isNull().cast("bigint"),
            }
        )
    )
    sums = ["saved_tokens", "n_leaves"]
    totals = _subtree_sums(nodes.select("k1", "k2", "depth", "up", *sums), rows, sums, height)
    # Many nodes can have one parent: its key is split where it is hot.
    parents = nodes.filter("n_children > 0").select(
        F.col("k1").alias("parent1"), F.col("k2").alias("parent2"), F.col("conv_id").alias("parent_conv_id")
    )
    own = lookup(nodes.drop("up", *sums), materialise(parents), {"p1": "parent1", "p2": "parent2"})
    nothing: Column = F.lit(hashlib.sha256().hexdigest())
    return (
        own.join(totals, ["k1", "k2"])
        .join(_ends(rows), ["k1", "k2"], "left")
        .select(
            "conv_id",
            F.col("depth").cast("bigint").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )
