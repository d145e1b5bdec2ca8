"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its
documents: a whole part that all get and a fraction. The fractions are rounded in
pairs. Words move at random from one document's expected copies to the other's,
so that the expectation of both stays, until one of the fractions is 0 or 1; the
other goes on to the next pair. The sum of expected words never changes, until a single fraction is left, which
goes to the nearer side. Documents are rounded in leaves of about ``LEAF`` documents;
each leaf has one fraction left, and these are combined by a tree of the same fan-in.
This is done first for the documents above the mean size of their source, then for
the others, whose fractions are shifted alike by the few words that the first pass
is off: a source ends within half of its mean document of its target, or, where the
short documents cannot take the shift, within half of its largest.

Defined results: a null text has size 0 and a document of size 0 is never taken;
the null source is a source like any other and ranks last; a null id is an
ordinary id. Rows that repeat id, text and source are rounded together, however many
they are, and share their copies as evenly as can be; rows that repeat an id only are
documents of their own. A source without words has target 0. An empty table gives an empty result. All draws are hashes of
ids and a seed, so a rerun agrees. Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cropline.functions.joins import lookup
from cropline.functions.ranking import ordinals
from cropline.llm.common import WORD, column, fresh
from cropline.session import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2.0
LEAF = 256
SEED = 20
# Copies of one row that one task makes.
CHUNK = 1_000


@dataclass(frozen=True)
class Mix:
    """Weights of the sources in code point order, repeated; share of all words
    to take; most copies of a source; seed of the draws."""

    weights: tuple[float, ...] = WEIGHTS
    share: float = SHARE
    ceiling: float = CEILING
    leaf: int = LEAF
    seed: int = SEED


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def _mark(text: str) -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.coalesce(column(text).cast("string"), F.lit("")))


def _key(source: str) -> Column:
    """A source as a key without nulls."""
    return F.when(column(source).isNull(), "n").otherwise(F.concat(F.lit("s"), column(source).cast("string")))


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``(_key, _total, _items, _weight, _target)`` of every source.

    ``sizes`` has ``_key``, ``_source``, ``_size``. What a source at its ceiling
    cannot take is shared by weight among the others, again and again until none
    is above. Each round is one small aggregate; only its three sums come back.
    """
    sources = materialise(
        sizes.groupBy("_key", "_source").agg(
            F.sum("_size").alias("_total"), F.count(F.when(F.col("_size") > 0, 1)).alias("_items")
        )
    )
    ranked = ordinals(
        sources.withColumn("_all", F.lit(0)).withColumn("_last", F.col("_source").isNull()),
        ["_all"],
        ["_last", "_source"],
        "_rank",
    )
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    table = materialise(
        ranked.select(
            "_key",
            "_total",
            "_items",
            F.element_at(weights, (F.col("_rank") % len(mix.weights) + 1).cast("int")).alias("_weight"),
            (F.col("_total") * F.lit(mix.ceiling)).alias("_most"),
        )
    )
    whole = table.agg(F.sum("_total")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        at_most = F.lit(level) * F.col("_weight") >= F.col("_most")
        now = table.agg(
            F.count(F.when(at_most, 1)),
            F.sum(F.when(at_most, F.col("_most")).otherwise(0.0)),
            F.sum(F.when(~at_most, F.col("_weight")).otherwise(0.0)),
        ).first()
        if now[0] == full or not now[2]:
            level = level if now[2] else math.inf
            break
        full = now[0]
        level = max(level, (mix.share * whole - now[1]) / now[2])
    wanted = F.lit(level) * F.col("_weight")
    return table.select(
        "_key", "_total", "_items", "_weight", F.least(F.col("_most"), F.greatest(wanted, F.lit(0.0))).alias("_target")
    )


def _draw(seed: int, level: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    bits = F.xxhash64(F.lit(seed), F.lit(level), *parts)
    return F.shiftrightunsigned(bits, 11).cast("double") / F.lit(float(1 << 53))


def _item(id_: Column, size: Column, part: Column, extra: Column) -> Column:
    return F.struct(id_.alias("id"), size.alias("size"), part.alias("part"), extra.alias("extra"))


def _round_pair(mix: Mix, level: int):
    """Fold step: the open document ``c`` of the state meets the next one, ``x``."""

    def step(state: Column, x: Column) -> Column:
        c = state["open"]
        words_c, words_x = c["size"].cast("double"), x["size"].cast("double")
        # Most words that c can gain from x, and lose to x.
        gain = F.least((1 - c["part"]) * words_c, x["part"] * words_x)
        loss = F.least(c["part"] * words_c, (1 - x["part"]) * words_x)
        up = _draw(mix.seed, level, c["id"], x["id"], c["size"], x["size"]) * (gain + loss) < loss
        c_is_done = F.when(up, (1 - c["part"]) * words_c <= x["part"] * words_x).otherwise(
            c["part"] * words_c <= (1 - x["part"]) * words_x
        )
        moved = F.when(up, gain).otherwise(-loss)

        def clip(part: Column) -> Column:
            return F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))

        one, nothing = F.lit(1), F.lit(0)
        closed = F.when(c_is_done, _item(c["id"], c["size"], c["part"], F.when(up, one).otherwise(nothing))).otherwise(
            _item(x["id"], x["size"], x["part"], F.when(up, nothing).otherwise(one))
        )
        stays = F.when(c_is_done, _item(x["id"], x["size"], clip(x["part"] - moved / words_x), nothing)).otherwise(
            _item(c["id"], c["size"], clip(c["part"] + moved / words_c), nothing)
        )
        first = c["size"].isNull()
        return F.struct(
            F.when(first, state["done"]).otherwise(F.concat(state["done"], F.array(closed))).alias("done"),
            F.when(first, _item(x["id"], x["size"], x["part"], nothing)).otherwise(stays).alias("open"),
        )

    return step


def _round_fractions(items: DataFrame, mix: Mix, id_type: str) -> DataFrame:
    """``(_key, _id, _size, _extra)``: 0 or 1 more copy for every item.

    ``items`` has ``_key``, ``_id``, ``_size`` (positive), ``_part`` and
    ``_leaf``, ``_leaves``: number and count of the source's leaves.
    """
    kind = f"struct<id:{id_type},size:bigint,part:double,extra:int>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open"))
    most = items.agg(F.max("_leaves")).first()[0] or 0
    settled, level = [], 0
    while most:
        spread = F.xxhash64(F.lit(mix.seed), "_id")
        entry = F.struct(
            F.col("_size").alias("size"), spread.alias("spread"), F.col("_id").alias("id"), F.col("_part").alias("part")
        )
        folded = materialise(
            items.groupBy("_key", "_leaf", "_leaves")
            .agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
            .withColumn("_state", F.aggregate("_entries", start, _round_pair(mix, level)))
            .select("_key", "_leaf", "_leaves", "_state")
        )
        done = folded.select("_key", F.explode("_state.done").alias("_d"))
        settled.append(done.select("_key", F.col("_d.id").alias("_id"), F.col("_d.size").alias("_size"), F.col("_d.extra").alias("_extra")))
        items = folded.select(
            "_key",
            F.col("_state.open.id").alias("_id"),
            F.col("_state.open.size").alias("_size"),
            F.col("_state.open.part").alias("_part"),
            F.floor(F.col("_leaf") / mix.leaf).alias("_leaf"),
            F.ceil(F.col("_leaves") / mix.leaf).alias("_leaves"),
        )
        level += 1
        if most == 1:
            break
        most = math.ceil(most / mix.leaf)
    if not settled:
        return items.select("_key", "_id", "_size", F.lit(0).alias("_extra"))
    last = (F.col("_part") >= 0.5).cast("int")
    result = items.select("_key", "_id", "_size", last.alias("_extra"))
    for part in settled:
        result = result.unionByName(part)
    return result


def _rounded(rated: DataFrame, mix: Mix) -> DataFrame:
    """``_key``, ``_id``, ``_size``, ``_part``, ``_extra``, ``_whole``, ``_rows`` of open documents."""
    items = rated.select(
        "_key",
        # The fold passes through what it does not need.
        F.struct("_id", "_whole", "_rows", "_fraction").alias("_id"),
        "_size",
        F.col("_fraction").alias("_part"),
        F.pmod(F.xxhash64(F.lit(mix.seed + 1), "_id"), F.col("_leaves")).alias("_leaf"),
        "_leaves",
    )
    rounded = _round_fractions(items, mix, items.schema["_id"].dataType.simpleString())
    return rounded.select(
        "_key",
        F.col("_id._id").alias("_id"),
        "_size",
        F.col("_id._fraction").alias("_part"),
        "_extra",
        F.col("_id._whole").alias("_whole"),
        F.col("_id._rows").alias("_rows"),
    )


def mix_sources(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    mix: Mix = Mix(),
) -> DataFrame:
    """One row per document: ``_id``, ``_mark`` (hash of its text), ``size``, ``source_size``, ``target``,
    ``copies`` (times the mix takes it) and ``taken`` (words)."""
    sizes = materialise(
        docs.select(
            F.struct(column(id_column).alias("id"), _mark(text_column).alias("mark")).alias("_id"),
            _key(source_column).alias("_key"),
            column(source_column).cast("string").alias("_source"),
            word_count(text_column).alias("_size"),
        )
    )
    targets = materialise(
        source_targets(sizes, mix)
        .withColumn("_rate", F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(0.0))
        .withColumn("_leaves", F.greatest(F.ceil(F.col("_items") / F.lit(mix.leaf)), F.lit(1)))
        .withColumnRenamed("_key", "_k")
    )
    alike = sizes.groupBy("_key", "_id", "_size").agg(F.count(F.lit(1)).alias("_rows"))
    expected = F.col("_rate") * F.col("_rows")
    rated = lookup(alike, targets, {"_key": "_k"}, "inner").withColumns(
        {"_whole": F.floor(expected), "_fraction": expected - F.floor(expected)}
    )
    rated = materialise(rated)
    is_open = (F.col("_size") > 0) & (F.col("_fraction") > 0)
    is_long = F.col("_size") > F.try_divide("_total", "_items")
    long = materialise(_rounded(rated.filter(is_open & is_long), mix))
    short = rated.filter(is_open & ~is_long)
    # What the long documents are off, in words, moves the fractions of the short ones.
    # Summed as decimals, in any order alike.
    each = ((F.col("_extra") - F.col("_part")) * F.col("_size")).cast("decimal(28,9)")
    off = long.groupBy("_key").agg(F.sum(each).cast("double").alias("_off"))
    room = short.groupBy(F.col("_key").alias("_room")).agg(F.sum("_size").alias("_words"))
    shifts = materialise(
        off.join(room, F.col("_key") == F.col("_room")).select(
            F.col("_key").alias("_k"), (-F.col("_off") / F.col("_words")).alias("_shift")
        )
    )
    shifted = F.col("_fraction") + F.coalesce("_shift", F.lit(0.0))
    short = lookup(short, shifts, {"_key": "_k"}, source=targets).withColumn(
        "_fraction", F.least(F.greatest(shifted, F.lit(0.0)), F.lit(1.0))
    )
    rounded = long.unionByName(_rounded(short, mix)).drop("_part")
    plain = rated.filter(~is_open).select("_key", "_id", "_size", F.lit(0).alias("_extra"), "_whole", "_rows")
    both = lookup(plain.unionByName(rounded), targets.select("_k", "_total", "_target"), {"_key": "_k"}, "inner")
    total = (F.col("_whole") + F.col("_extra")) * (F.col("_size") > 0).cast("int")
    even, over = F.floor(total / F.col("_rows")), total % F.col("_rows")
    single = both.filter("_rows = 1").withColumn("_copies", total)
    # Rows alike come back from the rows themselves, numbered across tasks: one group may be very large.
    shared = both.filter("_rows > 1").select(
        *[F.col(c).alias(f"_of{c}") for c in ("_key", "_id", "_size")], "_total", "_target", even.alias("_even"), over.alias("_over")
    )
    alike_rows = sizes.select("_key", "_id", "_size", F.monotonically_increasing_id().alias("_at"))
    members = lookup(alike_rows, materialise(shared), {c: f"_of{c}" for c in ("_key", "_id", "_size")}, "inner")
    several = ordinals(members, ["_key", "_id", "_size"], ["_at"], "_row").withColumn(
        "_copies", F.col("_even") + (F.col("_row") < F.col("_over")).cast("int")
    )
    wanted = ["_id", "_size", "_total", "_target", "_copies"]
    single, several = single.select(*wanted), several.select(*wanted)
    copies = F.col("_copies").cast("int")
    return single.unionByName(several).select(
        F.col("_id.id").alias("_id"),
        F.col("_id.mark").alias("_mark"),
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_target").alias("target"),
        copies.alias("copies"),
        (copies * F.col("_size")).cast("bigint").alias("taken"),
    )


def apply_mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    mix: Mix = Mix(),
) -> DataFrame:
    """``docs`` as the mix takes them: every row as often as it has copies.

    Of rows that repeat an id and a text, one comes as often as all together have copies.
    """
    own, mark, key, times = (fresh(docs.columns, x) for x in ("_own", "_mark", "_key", "_times"))
    counts = materialise(
        mix_sources(docs, id_column, text_column, source_column, mix)
        .groupBy(F.col("_id").alias(key), F.col("_mark").alias(mark))
        .agg(F.sum("copies").cast("int").alias(times), (F.count(F.lit(1)) > 1).alias("_repeated"))
        .filter(F.col(times) > 0)
    )
    marked = docs.withColumn(own, _mark(text_column))
    same = column(id_column).eqNullSafe(F.col(key)) & (F.col(own) == F.col(mark))
    taken = marked.join(counts.filter("NOT _repeated").drop("_repeated"), same)
    repeated = counts.filter("_repeated").drop("_repeated")
    if not repeated.isEmpty():
        one_each = marked.join(repeated.drop(times), same, "left_semi").dropDuplicates([id_column, own])
        # So many copies of one row are made by several tasks.
        chunk = fresh(taken.columns, "_chunk")
        left = F.col(times) - F.col(chunk) * CHUNK
        chunks = F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / CHUNK).cast("int")))
        spread = one_each.join(repeated, same).withColumn(chunk, chunks).repartition(F.col(own), F.col(chunk))
        taken = taken.unionByName(spread.withColumn(times, F.least(left, F.lit(CHUNK)).cast("int")).drop(chunk))
    repeats = F.explode(F.sequence(F.lit(1), F.col(times)))
    return taken.withColumn(times, repeats).select(*[column(c) for c in docs.columns])
