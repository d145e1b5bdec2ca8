"""Small tables with every odd case, and plain re-implementations of shared rules."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, kept string, size int, _mark int, lines int"
LONG = "\n".join(f"word{i % 7} and word{i % 11} then word{i}" for i in range(4000))
PASSAGE = "one two three\nfour five six\nseven eight nine\nten eleven twelve"


def documents(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing columns."""
    texts = [
        (1, "alpha beta gamma delta epsilon", "a"),
        (2, "alpha beta gamma delta epsilon", "a"),
        (3, "Alpha beta gamma delta epsilon", "b"),
        (4, None, None),
        (5, "", "b"),
        (6, " \t\n", ""),
        (7, LONG, "a"),
        (8, LONG, "b"),
        (9, LONG + " tail", "b"),
        (10, PASSAGE, "a"),
        (11, "intro\n" + PASSAGE + "\noutro", "z"),
        (11, "intro\n" + PASSAGE + "\noutro", "z"),
        (12, "x", None),
        (12, "y", None),
        (None, "no id here", "a"),
        (None, "no id here", "a"),
        (None, None, "a"),
        (13, "é ü 😀 ſ K\x00 tail", "é"),
    ]
    rows = [(i, t, None, s, None, 7, "x", 3, None, 1) for i, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
