"""Exact top-k search by inner product over norm-sorted vectors.

Components become integers, ``floor(SCALE * x)``, so scores are exact. The Gram
matrix of all vectors, scaled to length one, is a sum of bounded size over the table and
gives the rotation of their singular value decomposition, which gathers most of each vector's length in
its first coordinates. Vectors are cut by falling norm into blocks of bounded size
and stored packed. Queries are blocks too.

A first job scores the queries against the block of largest norms and leaves each
query with a threshold, its k-th best score so far. A second one brings the query blocks
to every other block; a task holds one block of rows and takes the queries for it one
after the other. There, rows go by falling norm in tiles; a tile whose largest norm times the
query's norm is below the threshold ends the search, since all further ones are
shorter. In the other tiles the inner product of the first coordinates plus the
product of the residual norms bounds the score (Cauchy-Schwarz), and only rows that
may reach the threshold are scored, in integers. Bounds have a margin above rounding
errors, and equal scores are never pruned, so ties are exact.

Defined results: vectors that are null or hold a null or non-finite component take
no part, as queries or candidates, and neither do rows with a null id. Shorter
vectors count as padded with zeros. Rows that repeat an id are candidates of their
own, but none of a query with that id; of queries that repeat an id the first
vector in order is taken. Finite components count whatever their size: blocks whose sums
are not exact in doubles are scored in whole numbers of any length, scores beyond 64 bits are
ranked by their exact value and then reported as the largest number. A query with
fewer than k candidates has fewer rows; an empty table gives none. Extra columns
are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cropline.llm.common import column
from cropline.session import materialise

K = 5
SCALE = 256
MOST_ROWS, LEAST_ROWS, SPREAD = 65_536, 2_048, 48
QUERIES_PER_BLOCK = 4_096
# Bytes of components in one block of rows, and of queries.
BLOCK_BYTES, QUERY_BYTES = 64 << 20, 16 << 20
BANDS = 1_024
TILE, QUERY_TILE = 2_048, 1_024
HEAD = 16
# Sums of products of whole numbers below this are exact in double precision.
_EXACT = float(1 << 53)
_LARGEST = (1 << 63) - 1
_NONE = -(1 << 63)


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """``(_id, _v, _norm, _dim)`` of the vectors that take part; ``_v`` holds the whole
    numbers ``floor(scale * x)``, divided by ``scale`` again, as packed doubles. ``scale`` is a
    power of two, so that this is exact, and no finite component becomes infinite."""
    rows = vectors.filter(column(id_column).isNotNull() & column(vector_column).isNotNull()).select(
        column(id_column).cast("bigint").alias("_id"), column(vector_column).cast("array<double>").alias("_x")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed, norms, dims = [], [], [], []
            for id_, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = vector.values
                if values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    whole = np.floor(x * scale)
                    norm = float(np.sqrt((whole * whole).sum()))
                ids.append(id_)
                packed.append(np.where(np.isfinite(whole), whole / scale, x).astype("<f8").tobytes())
                norms.append(norm)
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(norms, pa.float64()), pa.array(dims, pa.int32())],
                ["_id", "_v", "_norm", "_dim"],
            )

    return rows.mapInArrow(run, "_id bigint, _v binary, _norm double, _dim int")


def _matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for row, packed in zip(out, vectors):
        x = np.frombuffer(packed, "<f8")
        row[: len(x)] = x
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, by falling singular value.

    Every task sums the outer products of its rows; the ``dim * dim`` sums are
    added by a shuffle, and only these come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0).to_pylist(), dim)
            with np.errstate(over="ignore"):
                length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = np.divide(x, length, out=np.zeros_like(x), where=(length > 0) & np.isfinite(length))
            gram += x.T @ x
        place = np.arange(dim * dim)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(gram.ravel())], ["place", "part"])

    sums = vectors.select("_v").mapInArrow(run, "place bigint, part double").groupBy("place").agg(F.sum("part").alias("part"))
    gram = np.zeros(dim * dim)
    for place, part in sums.collect():
        gram[place] = part
    return np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1].copy()


def _pack(dim: int, name: str):
    """Rows of one block as one row, by falling norm."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_norm", "_id"], ascending=[False, True])
        matrix = _matrix(list(rows["_v"]), dim)
        return pd.DataFrame(
            {
                name: [rows[name].iloc[0]],
                "ids": [rows["_id"].to_numpy(np.int64).tobytes()],
                "matrix": [matrix.tobytes()],
                "longest": [float(rows["_norm"].iloc[0])],
            }
        )

    return run


_PACKED = "ids binary, matrix binary, longest double"


class _Side:
    """Vectors of one block: ids, components, first rotated coordinates, lengths of the rest."""

    def __init__(self, ids: bytes, matrix: bytes, turn: np.ndarray, scale: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.scale = scale
        self.parts = np.frombuffer(matrix, np.float64).reshape(len(self.ids), -1)
        with np.errstate(over="ignore", invalid="ignore"):
            self.x = self.parts * scale
            turned = self.x @ turn
            head = min(HEAD, turned.shape[1])
            self.head = turned[:, :head]
            self.rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
            self.norm = np.sqrt((self.x**2).sum(axis=1))
        self.most = float(np.abs(self.x).max(initial=0.0))


    def whole(self) -> np.ndarray:
        """Components as whole numbers of any length."""
        return np.vectorize(lambda v: int(v) * self.scale + int((v - int(v)) * self.scale), otypes=[object])(self.parts)


def _search_exactly(queries: _Side, rows: _Side, k: int) -> list[tuple[int, int, int]]:
    """``(query, row, score)`` of the k best rows of each query, where doubles are not exact."""
    whole, hits = rows.whole(), []
    for id_, query in zip(queries.ids.tolist(), queries.whole()):
        scored = ((-score, other) for other, score in zip(rows.ids.tolist(), whole.dot(query)) if other != id_)
        hits += [(id_, other, -score) for score, other in heapq.nsmallest(k, scored)]
    return hits


def _beyond(score: int) -> bytes | None:
    """A key in the order of scores at and beyond the largest number, of either sign."""
    if abs(score) < _LARGEST:
        return None
    size = (score.bit_length() + 7) // 8
    key = size.to_bytes(8, "big") + abs(score).to_bytes(size, "big")
    return key if score > 0 else bytes(255 - b for b in key)


def _merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the k highest scores; of equal ones, the least ids."""
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _search(queries: _Side, rows: _Side, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top k of each query among the rows; hits below ``start`` may be left out."""
    count = len(queries.ids)
    top_ids = np.full((count, k), _LARGEST)
    top = np.full((count, k), _NONE)
    for at in range(0, len(rows.ids), TILE):
        tile = slice(at, at + TILE)
        for first in range(0, count, QUERY_TILE):
            part = slice(first, first + QUERY_TILE)
            least = np.maximum(start[part], top[part, -1]).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                lengths = queries.norm[part] * rows.norm[at]
                slack = 1e-9 * lengths + 1.0
                # Not "at least": a bound that is no number prunes nothing.
                asks = np.nonzero(~(lengths + slack < least))[0]
                if not len(asks):
                    continue
                bound = queries.head[part][asks] @ rows.head[tile].T + np.outer(queries.rest[part][asks], rows.rest[tile])
                may = ~(bound + slack[asks, None] < least[asks, None])
            alive = may.any(axis=1)
            asks, may = asks[alive], may[alive]
            if not len(asks):
                continue
            near = np.nonzero(may.any(axis=0))[0]
            ids = rows.ids[tile][near]
            found = (queries.x[part][asks] @ rows.x[tile][near].T).astype(np.int64)
            allowed = may[:, near] & (queries.ids[part][asks, None] != ids[None, :])
            found = np.where(allowed, found, _NONE)
            if len(ids) > k:
                # Ids in order, so that of equal scores the first is the least.
                by_id = np.argsort(ids, kind="stable")
                ids, found = ids[by_id], found[:, by_id]
                best = _top(found, k)
                new_ids, new = ids[best], np.take_along_axis(found, best, 1)
            else:
                new_ids, new = np.broadcast_to(ids, found.shape), found
            new_ids = np.where(new == _NONE, _LARGEST, new_ids)
            own = asks + first
            top_ids[own], top[own] = _merge(
                np.concatenate([top_ids[own], new_ids], axis=1), np.concatenate([top[own], new], axis=1), k
            )
    return top_ids, top


def _top(found: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest of each row, of equal ones the first."""
    width = found.shape[1]
    if np.abs(found[found != _NONE]).max(initial=0) >= 1 << 40:
        return np.argsort(~found, axis=1, kind="stable")[:, :k]
    ranked = np.where(found == _NONE, -float(1 << 50), found) - np.arange(width) / (2.0 * width)
    return np.argpartition(-ranked, k - 1, axis=1)[:, :k]


def _hits(queries: _Side, rows: _Side, start: np.ndarray, k: int) -> pa.RecordBatch:
    """Top k of each query among the rows of one block."""
    # Where sums may not be exact in doubles, or are no numbers.
    if not queries.most * rows.most * max(rows.x.shape[1], 1) < _EXACT:
        found = _search_exactly(queries, rows, k)
        asked, ids = [h[0] for h in found], [h[1] for h in found]
        scores = [max(-_LARGEST, min(_LARGEST, h[2])) for h in found]
        beyond = [_beyond(h[2]) for h in found]
    else:
        best, scores = _search(queries, rows, start, k)
        hit = scores != _NONE
        asked, ids, scores = np.broadcast_to(queries.ids[:, None], hit.shape)[hit], best[hit], scores[hit]
        beyond = [None] * len(ids)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(c, kind) for c, kind in zip((asked, ids, scores, beyond), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "beyond"])


def _meet(turn: np.ndarray, k: int, scale: int):
    """Rows of one block, then the queries for it, one block after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = None, None
        for batch in batches:
            # One at a time: each row is a block.
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("_block", "ids", "matrix", "least")}
                if row["_block"] != number:
                    number, rows = row["_block"], _Side(row["ids"], row["matrix"], turn, scale)
                    continue
                queries = _Side(row["ids"], row["matrix"], turn, scale)
                start = np.frombuffer(row["least"], np.int64) if row["least"] else np.full(len(queries.ids), _NONE)
                yield _hits(queries, rows, start, k)

    return run


_HIT = "query_id bigint, vec_id bigint, score bigint, beyond binary"


def _meetings(rows: DataFrame, queries: DataFrame, tasks: int, turn: np.ndarray, k: int, scale: int) -> DataFrame:
    """Hits of blocks of ``rows`` (``_block``) with the ``queries`` dealt to them (``_block``, ``_group``, ``least``).

    The row of a block comes before its queries in its task, and every block has one.
    """
    blocks = rows.select("_block", F.lit(-1).cast("bigint").alias("_group"), "ids", "matrix", F.lit(None).cast("binary").alias("least"))
    both = blocks.unionByName(queries.select("_block", "_group", "ids", "matrix", "least"))
    ordered = both.repartition(tasks, "_block").sortWithinPartitions("_block", "_group")
    return ordered.mapInArrow(_meet(turn, k, scale), _HIT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    # Beyond 64 bits the exact score decides; keys of one sign only meet equal scores.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_k(
    vectors: DataFrame,
    is_query: Column | str,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = K,
    scale: int = SCALE,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows of every query.

    ``is_query`` is a condition on the column ``_id``.
    """
    spark = vectors.sparkSession
    rows = materialise(integer_vectors(vectors, id_column, vector_column, scale))
    total, dim = rows.agg(F.count(F.lit(1)), F.max("_dim")).first()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dim = max(dim, 1)
    turn = rotation(rows, dim)

    # Blocks of rows: bands of falling norm, cut by row number where they are too
    # large, so that rows alike in every column are spread as well.
    size = min(MOST_ROWS, max(LEAST_ROWS, -(-total // SPREAD)), max(1, BLOCK_BYTES // (8 * dim)))
    bands = min(BANDS, -(-total // size))
    marks = [i / bands for i in range(1, bands)]
    cuts = rows.agg(F.percentile_approx("_norm", marks, 10_000)).first()[0] if marks else []
    above = F.lit(0)
    for cut in sorted(set(cuts)):
        above = above + (F.col("_norm") <= F.lit(cut)).cast("int")
    banded = rows.withColumn("_band", above)
    counts = banded.groupBy("_band").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("_cuts"))
    before = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    places = materialise(counts.withColumn("_base", F.coalesce(F.sum("_cuts").over(before), F.lit(0))))
    blocks = places.agg(F.sum("_cuts")).first()[0]
    dealt = banded.join(F.broadcast(places), "_band").withColumn(
        "_block", (F.col("_base") + F.pmod(F.monotonically_increasing_id(), F.col("_cuts"))).cast("bigint")
    )
    kept = ["_block", "_id", "_v", "_norm"]
    packed = materialise(dealt.select(*kept).groupBy("_block").applyInPandas(_pack(dim, "_block"), f"_block bigint, {_PACKED}"))

    asked = rows.filter(is_query).groupBy("_id").agg(F.min(F.struct("_v", "_norm")).alias("_q"))
    asked = asked.select("_id", "_q._v", "_q._norm")
    groups = max(1, -(-asked.count() // min(QUERIES_PER_BLOCK, max(1, QUERY_BYTES // (8 * dim)))))
    asked = asked.withColumn("_group", F.pmod(F.xxhash64("_id"), F.lit(groups)).cast("bigint"))
    queries = materialise(asked.groupBy("_group").applyInPandas(_pack(dim, "_group"), f"_group bigint, {_PACKED}"))

    # The block of the largest norms gives every query a threshold. Each group of queries meets a copy
    # of that block, numbered like the group, so that they are searched by several tasks.
    top, group = packed.filter("_block = 0"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))
    first = queries.withColumn("_block", F.col("_group")).withColumn("least", F.lit(None).cast("binary"))
    head = materialise(_meetings(top.withColumn("_block", group), first, groups, turn, k, scale))
    least = head.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    least = least.filter(F.col("n") >= k).select(
        "query_id", "least", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("bigint").alias("_group")
    )

    def align(ask: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Thresholds in the order of a query block, and the least of them."""
        if not len(ask):
            return pd.DataFrame({"_group": [], "least": [], "lowest": []})
        score = dict(zip(known["query_id"], known["least"]))
        values = np.array([score.get(i, _NONE) for i in np.frombuffer(ask["ids"].iloc[0], np.int64)], np.int64)
        return pd.DataFrame(
            {"_group": [ask["_group"].iloc[0]], "least": [values.tobytes()], "lowest": [float(values.min())]}
        )

    known = materialise(
        queries.select("_group", "ids")
        .groupBy("_group")
        .cogroup(least.groupBy("_group"))
        .applyInPandas(align, "_group bigint, least binary, lowest double")
    )
    if blocks == 1:
        return _best(head, k)
    # Every other block meets the query blocks that its longest vector may still serve.
    others = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    wanted = materialise(
        queries.select("_group", F.col("longest").alias("_asks"))
        .join(known.select("_group", "lowest"), "_group")
        .withColumn("_block", others)
        .join(packed.select("_block", "longest"), "_block")
        .filter(~(F.col("_asks") * F.col("longest") * (1 + 1e-9) + 1 < F.col("lowest")))
        .select("_group", "_block")
    )
    asks = wanted.join(queries.select("_group", "ids", "matrix"), "_group").join(known.select("_group", "least"), "_group")
    served = packed.join(wanted.select("_block").distinct(), "_block", "left_semi")
    # A block is small to ship and long to search, so the tasks are dealt by number, not by bytes.
    tasks = max(1, min(blocks - 1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return _best(head.unionByName(_meetings(served, asks, tasks, turn, k, scale)), k)
