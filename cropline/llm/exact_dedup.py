"""Exact dedup with a heavy-hitter split.

Misra-Gries counters over the digests (``freqItems`` is Karp, Schenker and
Papadimitriou's form of them) find every digest with more than a share of
``SUPPORT`` of the rows. Their exact counts and winners are then computed and
broadcast, at most ``1 / SUPPORT`` rows at any input size, so the rows of large
groups are decided where they are. All other digests are shuffled as usual.

Defined results: a null text counts as empty, texts are otherwise compared
unchanged and whole. A null id is smaller than every id. Of rows that share text
and largest id exactly one stays. An empty table gives an empty result. Only the
id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cropline.llm.common import column, drop_matches, fresh
from cropline.session import materialise

SUPPORT = 0.001


def _digest(text: str):
    return F.unhex(F.sha2(F.coalesce(column(text).cast("string"), F.lit("")), 256))


def _winner():
    """Of a group: its size and the row that stays."""
    return F.count(F.lit(1)).alias("_size"), F.max(F.struct("_id", "_row")).alias("_best")


def resolve_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT
) -> DataFrame:
    """One row per document: id, digest, kept id, group size, whether it stays.

    Columns ``_id``, ``_row`` (number of the row), ``_digest`` (SHA-256, binary),
    ``keep_id``, ``group_size``, ``kept``.
    """
    # Written once: texts are read and hashed a single time, and row numbers stay as they are.
    rows = materialise(
        docs.select(column(id_column).alias("_id"), _digest(text_column).alias("_digest"))
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_hash", F.xxhash64("_digest"))
    )
    frequent = rows.stat.freqItems(["_hash"], support).select(F.explode("_hash_freqItems").alias("_frequent"))
    frequent = materialise(frequent)
    suspects = rows.join(F.broadcast(frequent), F.col("_hash") == F.col("_frequent"), "left_semi")
    heavy = materialise(
        suspects.groupBy(F.col("_digest").alias("_heavy")).agg(*_winner()).filter(F.col("_size") > 1)
    )
    decided = rows.join(F.broadcast(heavy), F.col("_digest") == F.col("_heavy"), "inner").drop("_heavy")
    others = rows.join(F.broadcast(heavy.select("_heavy")), F.col("_digest") == F.col("_heavy"), "left_anti")
    winners = others.groupBy(F.col("_digest").alias("_light")).agg(*_winner())
    shuffled = others.join(winners, F.col("_digest") == F.col("_light"), "inner").drop("_light")
    return decided.unionByName(shuffled).select(
        "_id",
        "_row",
        "_digest",
        F.col("_best._id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_best._row")).alias("kept"),
    )


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT
) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that with the largest id."""
    digest = fresh(docs.columns, "_digest")
    losers = materialise(
        resolve_copies(docs, id_column, text_column, support)
        .filter(~F.col("kept"))
        .select("_digest", "_id", F.col("_id").eqNullSafe(F.col("keep_id")).alias("_twin"))
    )
    marked = docs.withColumn(digest, _digest(text_column))
    keys = {digest: "_digest", id_column: "_id"}
    kept = drop_matches(marked, losers, keys)
    # A row that repeats the winner's id and text is a loser too, and takes its
    # twin along. One row of each such group comes back.
    twins = losers.filter("_twin").select(F.col("_digest").alias("_td"), F.col("_id").alias("_ti")).distinct()
    if not twins.isEmpty():
        same = F.col(digest).eqNullSafe(F.col("_td")) & column(id_column).eqNullSafe(F.col("_ti"))
        kept = kept.unionByName(marked.join(twins, same, "left_semi").dropDuplicates([digest, id_column]))
    return kept.drop(digest)
