"""Line dedup: winnowing over line hashes.

A *window* is the shortest run of lines from a start that has ``MIN_LINES`` lines
or ``MIN_WORDS`` words. The least line hash of every window, the last of equals, is
its fingerprint. Only the places of fingerprints are stored, one row for each place
that any window selects, with the lines around it. Equal runs have equal windows and
so the same fingerprints at the same places: every repeated run as long as a window
is found. Fingerprints whose hash stands at one place only are dropped, which leaves few.

The places of the others are joined, and matches are extended from the fingerprint:
first to both ends of the windows that selected it, by the hashes of all their lines,
then line by line, left and right, until the lines differ. The first place of each
window, and of each window with the lines taken so far, in order of id and position
keeps its lines; all later ones are deleted. So a line is deleted if it lies in any
run of lines, at least a window long, that stood together before, with whatever
earlier place it has most in common. Beyond a window only the lines up to the
next one can be missing, two or some without words, as that one is matched
itself; windows that equal are never compared in pairs.

Defined results: a null text is empty and stays null; an empty text has one empty
line. Windows without any word never match. Lines are compared unchanged. Null ids
come first. Rows that repeat both id and text are one document and get one result;
rows that repeat an id only are ordered by a hash of their texts. An empty table
gives an empty result. Extra columns are kept and never clash.

Hashes are 2 x 64 bits a line. No group is gathered: places are reduced to the
least before a shuffle, and rows of a frequent line are split by adaptive
execution, as both sides of each join are stored tables.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from cropline.llm.common import WORD, column, fresh
from cropline.session import materialise

MIN_LINES = 3
MIN_WORDS = 50


def _lines(text: str) -> Column:
    return F.split(F.coalesce(column(text).cast("string"), F.lit("")), "\n", -1)


def _mark(text: str) -> Column:
    return F.xxhash64(F.coalesce(column(text).cast("string"), F.lit("")))


def _next_to(min_lines: int) -> list[Column]:
    """Hashes of the lines that a run may have behind a window and before it, the nearest first.

    Behind: ``min_lines - 1``, or all without a word if more of these follow. Before:
    those without a word, if the window begins with such lines but for its last.
    """
    size, end, none = F.size("_h"), F.col("_start") + F.col("_length"), F.lit(None).cast("array<bigint>")
    flags = F.array_join(F.transform("_w", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    found = F.position(F.lit("1"), flags, end + 1)
    wordless = F.when(found > 0, found - 1 - end).otherwise(size - end)
    follow = [F.coalesce(F.get("_w", end + i), F.lit(1)) == 0 for i in range(min_lines)]
    behind = F.when(reduce(and_, follow), wordless).otherwise(min_lines - 1)
    found = F.position(F.lit("1"), F.reverse(flags), size - F.col("_start") + 1)
    before = F.when(found > 0, F.col("_start") - 1 - size + found).otherwise(F.col("_start"))
    begin = [F.get("_w", F.col("_start") + i) == 0 for i in range(min_lines - 1)]
    headed = reduce(and_, begin, (F.col("_length") == min_lines) & (F.col("_start") > 0))
    lines = []
    for x in ("_h", "_g"):
        lines.append(F.slice(x, end + 1, behind).alias(f"_behind{x}"))
        head = F.reverse(F.slice(x, F.col("_start") - before + 1, before))
        lines.append(F.when(headed, head).otherwise(none).alias(f"_ahead{x}"))
    return lines


def fingerprints(docs: DataFrame, id_column: str, text_column: str, min_lines: int, min_words: int) -> DataFrame:
    """Every place that a window selects: ``_id``, ``_mark`` (document), ``_place``, ``_print`` and
    ``_windows``, those that select it: ``_start``, ``_length``, ``_a``, ``_b`` (content) and the
    lines of ``_next_to``."""
    hashed = (
        docs.select(
            column(id_column).alias("_id"), _mark(text_column).alias("_mark"), _lines(text_column).alias("_lines")
        )
        .select(
            "_id",
            "_mark",
            F.transform("_lines", lambda x: F.xxhash64(x)).alias("_h"),
            F.transform("_lines", lambda x: F.xxhash64(F.lit(1), x)).alias("_g"),
            F.transform("_lines", lambda x: F.regexp_count(x, F.lit(WORD))).alias("_w"),
        )
        .dropDuplicates(["_id", "_mark"])
    )
    starts = hashed.withColumn("_start", F.explode(F.sequence(F.lit(0), F.size("_h") - 1)))
    words, length = F.lit(0), F.lit(min_lines)
    sums = []
    for i in range(min_lines):
        words = words + F.coalesce(F.get("_w", F.col("_start") + i), F.lit(0))
        sums.append(words)
    for i in reversed(range(min_lines - 1)):
        length = F.when(sums[i] >= min_words, i + 1).otherwise(length)
    sized = starts.withColumn("_length", length).withColumn("_words", sums[-1])
    inside = (F.col("_start") + F.col("_length") <= F.size("_h")) & (F.col("_words") > 0)
    cut = sized.filter(inside).withColumn("_cut", F.slice("_h", F.col("_start") + 1, F.col("_length")))
    least = F.array_min("_cut")
    last = F.col("_length") - F.array_position(F.reverse("_cut"), least)
    windows = cut.select(
        "_id",
        "_mark",
        (F.col("_start") + last).cast("int").alias("_place"),
        least.alias("_print"),
        "_start",
        "_length",
        F.xxhash64("_cut").alias("_a"),
        F.xxhash64(F.slice("_g", F.col("_start") + 1, F.col("_length"))).alias("_b"),
        *_next_to(min_lines),
    )
    key = ["_id", "_mark", "_place", "_print"]
    # At most ``min_lines`` windows; documents are dealt by id and mark already.
    return windows.groupBy(*key).agg(F.collect_list(F.struct(*[c for c in windows.columns if c not in key])).alias("_windows"))


def _grown(repeated: DataFrame) -> DataFrame:
    """Stretches of lines at the ends of repeated windows that an earlier window has too: ``_id``, ``_mark``, ``_start``, ``_stop``."""
    content = ["_a", "_b", "_before", "_after"]
    sides = [
        repeated.select("_id", "_mark", "_start", *content, F.lit(side).alias("_side"), h.alias("_h"), g.alias("_g"))
        for side, h, g in (
            ("behind", F.col("_behind_h"), F.col("_behind_g")),
            ("ahead", F.col("_ahead_h"), F.col("_ahead_g")),
        )
    ]
    lines = sides[0].unionByName(sides[1]).select("*", F.posexplode(F.arrays_zip("_h", "_g")).alias("_n", "_line"))
    # Hashes of the first lines on a side, of each number of lines.
    until = Window.partitionBy("_id", "_mark", "_start", "_side").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    taken = materialise(
        lines.withColumns(
            {
                "_x": F.bit_xor(F.xxhash64("_n", F.col("_line._h"))).over(until),
                "_y": F.bit_xor(F.xxhash64("_n", F.col("_line._g"))).over(until),
            }
        ).drop("_h", "_g", "_line")
    )
    where, key = F.struct("_id", "_mark", "_start"), [*content, "_side", "_n", "_x", "_y"]
    firsts = materialise(
        taken.groupBy(*[F.col(k).alias(f"_first{k}") for k in key])
        .agg(F.min(where).alias("_first"), F.max(where).alias("_end"))
        .filter(~F.col("_first").eqNullSafe(F.col("_end")))
        .drop("_end")
    )
    same = reduce(and_, [F.col(k) == F.col(f"_first{k}") for k in key])
    later = taken.join(firsts, same).filter(~where.eqNullSafe(F.col("_first")))
    behind, count = F.col("_side") == "behind", F.col("_n") + 1
    return later.select(
        "_id",
        "_mark",
        F.when(behind, F.col("_start")).otherwise(F.col("_start") - count).alias("_begin"),
        (F.col("_start") + F.col("_before") + F.col("_after") + F.when(behind, count).otherwise(0)).alias("_stop"),
    ).withColumnRenamed("_begin", "_start")


def repeated_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_lines: int = MIN_LINES,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Runs of lines to delete: ``_id``, ``_mark``, ``_from`` and ``_to`` (exclusive)."""
    selected = materialise(fingerprints(docs, id_column, text_column, min_lines, min_words))
    place = F.struct("_id", "_mark", "_place")
    repeated = materialise(
        selected.groupBy(F.col("_print").alias("_p"))
        .agg(F.min(place).alias("_low"), F.max(place).alias("_high"))
        .filter(~F.col("_low").eqNullSafe(F.col("_high")))
        .select("_p")
    )
    # From here on the places of repeated fingerprints only, with the windows that select them.
    matched = materialise(
        selected.join(repeated, F.col("_print") == F.col("_p"), "left_semi")
        .select("_id", "_mark", "_place", F.inline("_windows"))
        .withColumns(
            {
                "_before": F.col("_place") - F.col("_start"),
                "_after": F.col("_start") + F.col("_length") - F.col("_place"),
            }
        )
        .drop("_place", "_length")
    )
    where = F.struct("_id", "_mark", "_start")
    firsts = materialise(
        matched.groupBy(
            F.col("_a").alias("_fa"), F.col("_b").alias("_fb"), F.col("_before").alias("_fl"), F.col("_after").alias("_fr")
        )
        .agg(F.min(where).alias("_first"), F.max(where).alias("_end"))
        .filter(~F.col("_first").eqNullSafe(F.col("_end")))
        .drop("_end")
    )
    extended = (
        (F.col("_a") == F.col("_fa"))
        & (F.col("_b") == F.col("_fb"))
        & (F.col("_before") == F.col("_fl"))
        & (F.col("_after") == F.col("_fr"))
    )
    later = matched.join(firsts, extended).filter(~where.eqNullSafe(F.col("_first")))
    stops = later.select("_id", "_mark", "_start", (F.col("_start") + F.col("_before") + F.col("_after")).alias("_stop"))
    stops = stops.unionByName(_grown(matched.join(firsts, extended, "left_semi")))
    # Overlapping and touching windows of one document become one run.
    by_doc = Window.partitionBy("_id", "_mark").orderBy("_start", "_stop")
    reached = F.max("_stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    begins = stops.withColumn("_new", F.coalesce((F.col("_start") > reached).cast("int"), F.lit(1)))
    runs = begins.withColumn("_run", F.sum("_new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("_id", "_mark", "_run").agg(F.min("_start").alias("_from"), F.max("_stop").alias("_to")).drop("_run")


def line_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_lines: int = MIN_LINES,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``docs`` with cleaned texts, and columns ``lines`` and ``removed_lines``."""
    runs = materialise(
        repeated_runs(docs, id_column, text_column, min_lines, min_words)
        .groupBy("_id", "_mark")
        .agg(F.array_sort(F.collect_list(F.struct("_from", "_to"))).alias("_runs"))
    )
    mark, lines, removed = (fresh(docs.columns, x) for x in ("_line_mark", "lines", "removed_lines"))
    own = {c: fresh(docs.columns, f"_run{c}") for c in ("_id", "_mark", "_runs")}
    runs = runs.select(*[F.col(c).alias(n) for c, n in own.items()])
    same = column(id_column).eqNullSafe(F.col(own["_id"])) & (F.col(mark) == F.col(own["_mark"]))
    # The same join at every size: both sides are shuffled, whatever the estimates say.
    joined = docs.withColumn(mark, _mark(text_column)).join(runs.hint("merge"), same, "left")
    whole = fresh(joined.columns, "_split")
    joined = joined.withColumn(whole, _lines(text_column))
    split, cut, start = F.col(whole), F.col(own["_runs"]), F.lit(0)
    # What stands before each run, and after the last.
    before = F.transform(
        cut,
        lambda x, i: F.slice(
            split, F.when(i == 0, start).otherwise(F.get(cut, i - 1)["_to"]) + 1,
            x["_from"] - F.when(i == 0, start).otherwise(F.get(cut, i - 1)["_to"]),
        ),
    )
    end = F.element_at(cut, -1)["_to"]
    rest = F.slice(split, end + 1, F.greatest(F.size(split) - end, F.lit(0)))
    cleaned = F.array_join(F.concat(F.flatten(before), rest), "\n")
    gone = F.aggregate(cut, F.lit(0), lambda n, x: n + x["_to"] - x["_from"])
    return joined.select(
        *[
            F.when(cut.isNull(), column(c)).otherwise(cleaned).alias(c) if c == text_column else column(c)
            for c in docs.columns
        ],
        F.size(split).alias(lines),
        F.coalesce(gone, F.lit(0)).alias(removed),
    )
