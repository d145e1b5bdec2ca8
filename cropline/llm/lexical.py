"""Ranked lexical search: pipelined term partitioning.

Documents are dealt into slices of about ``SLICE`` rows, items into groups of
``GROUP``. The terms of the items have owners, ``STAGES`` of them by falling weight.
For every slice and group a bundle of items goes from owner to owner: a
stage cogroups the bundles with the postings of its own terms in that slice and adds
their contributions, whole numbers, to the sparse accumulators that the bundles carry.
After the last stage each bundle selects its best documents, and the best of all
slices are ranked.

Between stages a bundle drops an accumulator that cannot reach the k best of its own
slice any more: what it lacks to the k-th one now is above the most that the
later owners can add. That most is the sum of each later term's weight times its
largest contribution in any document, so no result is lost.

Weights are doubles, rounded down once; all else is 64-bit arithmetic. Items are
tokenised like documents, so postings are of items' terms only: their terms are handed
to the tasks where they fit a checked broadcast, else joined.

Defined results: a null text has no terms. Rows that repeat an id are documents, or
items, of their own; equal scores go by id, null ids last, then in any order. An item
or document without terms has no result. A very long text is one row of postings, one
number for each term of the items. Empty tables give none. Only the id and text
columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cropline.functions.joins import fits_broadcast, lookup
from cropline.llm.common import column
from cropline.session import materialise

K = 10
SLICE = 4_096
GROUP = 256
STAGES = 4
# Rows in one batch that a task returns.
BATCH = 1_024

# Bytes of terms keep their place, A-Z in lower case; all others become blanks. Bytes
# above 127 belong to characters beyond ASCII, which are all part of terms.
_TERMS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def _count_terms(wanted: frozenset[bytes] | None) -> Callable:
    """Number of terms of each text, and how often it has each wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sizes, terms, counts = [], [], []
                for text in part.column(1):
                    found = text.as_py().translate(_TERMS).split()
                    sizes.append(len(found))
                    counted = Counter(found)
                    kept = sorted(counted if wanted is None else wanted.intersection(counted))
                    terms.append([t.decode() for t in kept])
                    counts.append([counted[t] for t in kept])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(terms, pa.list_(pa.string())),
                        pa.array(counts, pa.list_(pa.int64())),
                    ],
                    ["_id", "n", "terms", "counts"],
                )

    return run


def term_counts(texts: DataFrame, id_column: str, text_column: str, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """``_id``, ``n`` (terms), ``terms`` and ``counts`` of every row; ``wanted`` ones only, if given."""
    rows = texts.select(
        column(id_column).alias("_id"),
        F.coalesce(column(text_column).cast("string"), F.lit("")).cast("binary").alias("_text"),
    )
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_count_terms(wanted), f"_id {kind}, n bigint, terms array<string>, counts array<bigint>")


def _value(documents: int, terms: int) -> Column:
    """Contribution of a term to a document but for its weight, from columns ``n`` and ``tf``."""
    m = f"(25 + (75 * n * {documents}L) div {max(terms, 1)}L)"
    return F.expr(f"(1000000000L * tf) div (1000 * tf + 8 * {m})")


def _weight(documents: int) -> Column:
    ratio = F.lit(2 * documents + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    return F.floor(1000 * F.log(ratio)).cast("bigint")


def _visit(stage: int, k: int, last: bool) -> Callable:
    """Bundles after the stage's owner has added its postings."""

    def run(bundles: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(postings["term"].to_numpy(np.int64), kind="stable")
        terms, starts = np.unique(postings["term"].to_numpy(np.int64)[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        places = postings["place"].to_numpy(np.int64)[order]
        values = postings["value"].to_numpy(np.int64)[order]
        where = {t: slice(a, b) for t, a, b in zip(terms.tolist(), starts.tolist(), ends.tolist())}
        done = []
        for bundle in bundles.itertuples(index=False):
            at = np.frombuffer(bundle.places, np.int32)
            size = int(max(places.max(initial=-1), at.max(initial=-1))) + 1
            sums = np.zeros(size, np.int64)
            sums[at] = np.frombuffer(bundle.scores, np.int64)
            for term, factor, owner in zip(bundle.terms, bundle.factors, bundle.owners):
                hits = where.get(term) if owner == stage else None
                if hits is not None:
                    sums[places[hits]] += factor * values[hits]
            at = np.nonzero(sums)[0]
            found = sums[at]
            if last:
                best = np.lexsort((at, -found))[:k]
                at, found = at[best], found[best]
            elif len(found) > k:
                reachable = found + bundle.rest[stage] >= np.partition(found, -k)[-k]
                at, found = at[reachable], found[reachable]
            done.append((at.astype(np.int32).tobytes(), found.tobytes()))
        return bundles.assign(places=[d[0] for d in done], scores=[d[1] for d in done])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for slice_, item, places, scores in zip(*(batch.column(i).to_pylist() for i in range(4))):
            at = np.frombuffer(places, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), slice_, np.int64)), pa.array(np.full(len(at), item, np.int64)), pa.array(at), pa.array(np.frombuffer(scores, np.int64))],
                ["slice", "item", "place", "score"],
            )


_BUNDLE = (
    "slice bigint, part bigint, item bigint, terms array<bigint>, factors array<bigint>, owners array<int>,"
    " rest array<bigint>, places binary, scores binary"
)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    k: int = K,
    slice_rows: int = SLICE,
    group_rows: int = GROUP,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k best documents of every item."""
    asked = materialise(
        term_counts(items, item_column, item_text_column).withColumn("item", F.monotonically_increasing_id())
    )
    used = asked.select("item", F.inline(F.arrays_zip("terms", "counts"))).withColumnsRenamed({"terms": "word", "counts": "times"})
    words = materialise(used.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
    wanted = frozenset(r.word.encode() for r in words.collect()) if fits_broadcast(words) else None

    slices = max(1, -(-docs.count() // slice_rows))
    counted = term_counts(docs, id_column, text_column, wanted).withColumn("row", F.monotonically_increasing_id())
    in_slice = Window.partitionBy("slice").orderBy(F.col("_id").asc_nulls_last(), "row")
    counted = materialise(
        counted.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices))).withColumn("place", F.row_number().over(in_slice) - 1)
    )
    documents, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    hits = counted.select("slice", "place", "n", F.inline(F.arrays_zip("terms", "counts")))
    hits = hits.withColumnsRenamed({"terms": "word", "counts": "tf"}).withColumn("value", _value(documents, total))
    known = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.max("value").alias("most"))
    weighed = words.join(known, "word").select("word", "term", "most", _weight(documents).alias("weight")).filter("weight > 0")
    weighed = materialise(weighed)
    # Owners take the terms by falling weight, so that later stages can change little.
    cuts = weighed.agg(F.percentile_approx("weight", [i / STAGES for i in range(STAGES - 1, 0, -1)], 10_000)).first()[0] or []
    owner = F.lit(0)
    for cut in cuts:
        owner = owner + (F.col("weight") <= F.lit(cut)).cast("int")
    owned = materialise(weighed.withColumn("owner", owner))

    # Bundles: terms of an item with times x weight, owners, and what owners behind a stage can add.
    groups = max(1, -(-asked.count() // group_rows))
    part = F.pmod(F.xxhash64("item"), F.lit(groups))
    entries = lookup(used, owned.withColumnRenamed("word", "own_word"), {"word": "own_word"}, "inner").withColumn(
        "factor", F.col("times") * F.col("weight")
    )
    later = [
        F.coalesce(F.sum(F.when(F.col("owner") > s, F.col("factor") * F.col("most"))), F.lit(0).cast("bigint")) for s in range(STAGES)
    ]
    entry = F.array_sort(F.collect_list(F.struct("term", "factor", "owner")))
    bundled = entries.groupBy("item").agg(entry.alias("_e"), F.array(*later).alias("rest"))
    none = F.lit(b"").cast("binary")
    bundles = (
        bundled.select(
            part.alias("part"), "item", F.col("_e.term").alias("terms"), F.col("_e.factor").alias("factors"), F.col("_e.owner").alias("owners"),
            "rest", none.alias("places"), none.alias("scores"),
        )
        .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))))
        .select("slice", "part", "item", "terms", "factors", "owners", "rest", "places", "scores")
    )
    # Postings of the owners, once for each group of items that has the term.
    parts = materialise(entries.select("word", "term", "owner", part.alias("part")).distinct())
    postings = lookup(hits.select("slice", "place", "word", "value"), parts.withColumnRenamed("word", "own_word"), {"word": "own_word"}, "inner")
    postings = materialise(postings.select("owner", "slice", "part", "term", "place", "value"))
    for stage in range(STAGES):
        own = postings.filter(F.col("owner") == stage).drop("owner")
        bundles = (
            bundles.groupBy("slice", "part")
            .cogroup(own.groupBy("slice", "part"))
            .applyInPandas(_visit(stage, k, stage == STAGES - 1), _BUNDLE)
        )
    found = bundles.select("slice", "item", "places", "scores").mapInArrow(_unpack, "slice bigint, item bigint, place int, score bigint")
    named = found.join(counted.select("slice", "place", "_id", "row"), ["slice", "place"])
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("_id").asc_nulls_last(), "row")
    ranked = named.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    titles = asked.select("item", F.col("_id").alias("item_id"))
    return ranked.join(titles, "item").select("item_id", "rank", F.col("_id").alias("doc_id"), "score")
