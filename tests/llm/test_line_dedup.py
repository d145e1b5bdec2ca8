import random
from collections import Counter

from pyspark.sql import functions as F

from cropline.llm.line_dedup import fingerprints, line_dedup
from tests.llm.rows import documents, empty, words


def test_odd_documents(spark):
    docs = documents(spark).drop("lines").withColumnRenamed("kept", "removed_lines")
    cleaned = line_dedup(docs)
    assert cleaned.columns == [*docs.columns, "lines", "_removed_lines"]
    rows = {(r.doc_id, r.source): r for r in cleaned.collect()}
    assert cleaned.count() == docs.count()
    assert rows[4, None].text is None and rows[5, "b"].text == "" and rows[5, "b"].lines == 1
    assert rows[10, "a"]["_removed_lines"] == 0 and rows[11, "z"].text == "intro\noutro"
    assert rows[7, "a"]["_removed_lines"] == 0 and rows[8, "b"].text == ""
    # Rows that repeat id and text get one result.
    assert Counter(r.text for r in cleaned.filter("doc_id = 11").collect()) == Counter({"intro\noutro": 2})


def test_a_long_line_is_a_run_of_its_own(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, "a\nb")], "doc_id long, text string")
    assert [r.text for r in line_dedup(docs).orderBy("doc_id").collect()] == [f"a\n{long}\nb", "c\nd", "a\nb"]


def test_empty_table(spark):
    assert line_dedup(empty(spark).drop("lines")).count() == 0


def plain_runs(rows, min_lines, min_words):
    """Texts without any run of lines, at least a window long, that stood together before."""
    split = [(text or "").split("\n") for _, text in rows]
    places = {}
    for n, lines in enumerate(split):
        for start in range(len(lines)):
            total = 0
            for size in range(1, min(min_lines, len(lines) - start) + 1):
                total += len(words(lines[start + size - 1]))
                if size == min_lines or total >= min_words:
                    if total:
                        places.setdefault(tuple(lines[start : start + size]), []).append((n, start))
                    break
    gone = [set() for _ in split]
    for window, found in places.items():
        for i, (n, p) in enumerate(found):
            for m, q in found[:i]:
                low, high = 0, len(window)
                while min(p, q) + low > 0 and split[n][p + low - 1] == split[m][q + low - 1]:
                    low -= 1
                while p + high < len(split[n]) and q + high < len(split[m]) and split[n][p + high] == split[m][q + high]:
                    high += 1
                gone[n].update(range(p + low, p + high))
    return ["\n".join(x for i, x in enumerate(lines) if i not in g) for lines, g in zip(split, gone)]


def test_matches_brute_force(spark):
    rng = random.Random(9)
    lines = ["", "", " ", "a", "b c", "d e f g h i j k", "l", "m n", "", "a"]
    rows = []
    for i in range(200):
        size = rng.choice([0, 1, 2, 3, 5, 8, 20])
        rows.append((i, "\n".join(rng.choice(lines) if rng.random() < 0.8 else f"u{rng.randrange(100)}" for _ in range(size))))
    want = plain_runs(rows, 3, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = line_dedup(docs, min_lines=3, min_words=6).orderBy("doc_id").collect()
    assert [r.text for r in got] == want
    for row, (_, text) in zip(got, rows):
        assert row.lines == text.count("\n") + 1
        assert row.lines - row.removed_lines == (row.text.count("\n") + 1 if row.text or row.lines > row.removed_lines else 0)


def test_one_row_for_each_selected_place(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice("abcdefgh") for _ in range(30))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = fingerprints(docs, "doc_id", "text", 3, 50)
    assert stored.count() == stored.select("_id", "_place").distinct().count() < 20 * 28
    assert stored.select("_id", F.inline("_windows")).count() == 20 * 28


def test_runs_take_short_last_lines(spark):
    para = " ".join(f"w{i}" for i in range(60))
    run = f"{para}\nshort one\nshort two"
    blank = "\n\n\n\n\nx y z"
    rows = [(1, f"a\n{run}\nb"), (2, f"c\n{run}\nd"), (3, run), (None, f"e\n{run}"), (4, blank), (5, "q" + blank)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup(docs).collect()}
    assert got == {1: "a\nb", 2: "c\nd", 3: "", None: f"e\n{run}", 4: blank, 5: "q"}
