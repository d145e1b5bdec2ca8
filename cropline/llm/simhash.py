"""SimHash near-dedup: tiled exact comparison of fingerprints.

Distinct fingerprints are dealt into tiles by population count, taken for each of
``parts`` slices of the 64 bits. The counts of two fingerprints differ in sum by
at most their number of differing bits, so a pair of tiles whose counts differ by
more than the radius is skipped without losing a link. The others are compared
whole, as blocks of numpy words with exclusive-or and bit counts. More slices
make smaller tiles; their number follows the number of fingerprints and changes
the work only, not the links.

Defined results: a null or wordless text has fingerprint zero and links like any
other. A null id never names a group, unless it has no other. Repeated rows have
the same group. An empty table gives an empty result. Only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cropline.llm.common import column, drop_matches, fresh
from cropline.llm.components import connected_components
from cropline.session import materialise

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCK = 2048
# Up to so many fingerprints, that many slices; a table of costs, not of results.
PARTS = ((1 << 12, 1), (1 << 24, 4), (1 << 30, 8))
_STEP = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text, as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        spans: Iterable[tuple[int, int]] = [(0, len(joined))]
        count = 1
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        count = len(words) - shingle + 1
        spans = zip((ends - lengths)[:count].tolist(), ends[shingle - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _STEP):
        piece = hashes[at : at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<i8")[0])


def _mark(text: str) -> Column:
    return F.xxhash64(F.coalesce(column(text).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(_id, _mark, _fp)`` of every row; ``_mark`` is a hash of its text."""
    texts = docs.select(
        column(id_column).alias("_id"),
        _mark(text_column).alias("_mark"),
        F.coalesce(column(text_column).cast("string"), F.lit("")).cast("binary").alias("_text"),
    )
    kind = texts.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(v.as_py(), shingle) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values, pa.int64())], ["_id", "_mark", "_fp"])

    return texts.mapInArrow(run, f"_id {kind}, _mark bigint, _fp bigint")


def _slices(fp: str, parts: int) -> Column:
    """Population counts of the slices, packed at the slices' own places."""
    width = 64 // parts
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("bigint")
    packed = F.lit(0).cast("bigint")
    for i in range(parts):
        count = F.bit_count(F.shiftrightunsigned(F.col(fp), i * width).bitwiseAND(mask)).cast("bigint")
        packed = packed.bitwiseOR(F.shiftleft(count, i * width))
    return packed


def _offsets(parts: int, radius: int) -> list[int]:
    """Differences of packed counts within the radius, one of each sign pair."""
    width, found = 64 // parts, {0}
    for size in range(1, radius + 1):
        for places in combinations_with_replacement(range(parts), size):
            for signs in product((1, -1), repeat=size):
                found.add(abs(sum(s << (width * p) for s, p in zip(signs, places))))
    return sorted(x for x in found if x < 1 << 63)


def _spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Of edges between numbered nodes, those that join what was apart."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    chosen = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            chosen.append(i)
    return chosen


def _compare(radius: int):
    def words(values: pa.ListArray, i: int) -> np.ndarray:
        return values[i].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for i in range(batch.num_rows):
                left, right = words(batch.column(0), i), words(batch.column(1), i)
                rows, columns = [], []
                for at in range(0, len(left), 256):
                    near = np.bitwise_count(left[at : at + 256, None] ^ right[None, :]) <= radius
                    r, c = np.nonzero(near)
                    rows.append(r + at)
                    columns.append(c)
                a, b = left[np.concatenate(rows)].view(np.int64), right[np.concatenate(columns)].view(np.int64)
                apart = a != b
                a, b = a[apart], b[apart]
                chosen = _spanning(a, b)
                heads.append(a[chosen])
                tails.append(b[chosen])
            if heads:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(heads), pa.int64()), pa.array(np.concatenate(tails), pa.int64())], ["a", "b"]
                )

    return run


def near_links(distinct: DataFrame, fp: str, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints at most ``radius`` bits apart.

    Of the links inside one pair of blocks only a spanning forest is returned,
    which has the same components. ``distinct`` must be stored.
    """
    if parts is None:
        count = distinct.count()
        parts = next((p for most, p in PARTS if count <= most), 16)
    while parts > 1 and len(_offsets(parts, radius)) > 600:
        parts //= 2
    tiled = distinct.select(F.col(fp).alias("_fp"), _slices(fp, parts).alias("_tile"))
    sizes = tiled.groupBy(F.col("_tile").alias("_t")).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("_blocks"))
    # A tile of many fingerprints is cut into blocks of bounded size.
    dealt = tiled.join(sizes.filter("_blocks > 1"), F.col("_tile") == F.col("_t"), "left").withColumn(
        "_block", F.pmod(F.xxhash64("_fp"), F.coalesce("_blocks", F.lit(1)))
    )
    blocks = materialise(dealt.groupBy("_tile", "_block").agg(F.collect_list("_fp").alias("_fps")))
    offsets = F.array(*[F.lit(x).cast("bigint") for x in _offsets(parts, radius)])
    left = blocks.withColumn("_offset", F.explode(offsets)).select(
        F.col("_fps").alias("_left"),
        F.col("_block").alias("_lb"),
        "_offset",
        F.try_add(F.col("_tile"), F.col("_offset")).alias("_want"),
    )
    pairs = left.join(blocks, F.col("_want") == F.col("_tile")).filter(
        (F.col("_offset") != 0) | (F.col("_lb") <= F.col("_block"))
    )
    return pairs.select("_left", "_fps").mapInArrow(_compare(radius), "a bigint, b bigint")


def near_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """One row per document: ``_id``, ``_mark``, ``_fp``, ``_group`` (least fingerprint of
    the group), ``component_id`` (least id of the group), ``_stays`` (id and mark of the
    document that stands for it)."""
    rows = materialise(fingerprints(docs, id_column, text_column, shingle))
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_mark").alias("mark"))
    distinct = materialise(rows.groupBy("_fp").agg(F.min(first).alias("_least")))
    links = materialise(near_links(distinct, "_fp", radius))
    roots = materialise(connected_components(links, "a", "b"))
    grouped = distinct.join(roots, F.col("_fp") == F.col("node"), "left").select(
        F.col("_fp").alias("_f"), "_least", F.coalesce("root", "_fp").alias("_group")
    )
    least = grouped.groupBy(F.col("_group").alias("_g")).agg(F.min("_least").alias("_stays"))
    named = materialise(grouped.join(least, F.col("_group") == F.col("_g")).select("_f", "_group", "_stays"))
    # Both sides are stored tables, so the rows of a frequent fingerprint are split.
    joined = rows.join(named, F.col("_fp") == F.col("_f"))
    return joined.select("_id", "_mark", "_fp", "_group", F.col("_stays.id").alias("component_id"), "_stays")


def near_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """``docs`` with one row of each group, that with the least id.

    Of rows that share it, or have none, the one whose text has the least hash; of rows that
    repeat the text as well, any one.
    """
    mark = fresh(docs.columns, "_mark")
    groups = materialise(near_groups(docs, id_column, text_column, shingle, radius))
    wins = F.col("_id").eqNullSafe(F.col("_stays.id")) & (F.col("_mark") == F.col("_stays.mark"))
    losers = materialise(groups.filter(~wins).select("_id", "_mark").distinct())
    marked = docs.withColumn(mark, _mark(text_column))
    keys = {id_column: "_id", mark: "_mark"}
    kept = drop_matches(marked, losers, keys)
    # Of a winner that repeats, one row comes back.
    several = groups.filter(wins).groupBy("_id", "_mark").count().filter("count > 1")
    twins = materialise(several.select(F.col("_id").alias("_ti"), F.col("_mark").alias("_tm")))
    if not twins.isEmpty():
        same = column(id_column).eqNullSafe(F.col("_ti")) & (F.col(mark) == F.col("_tm"))
        one_each = kept.join(twins, same, "left_semi").dropDuplicates([id_column, mark])
        kept = kept.join(twins, same, "left_anti").unionByName(one_each)
    return kept.drop(mark)
