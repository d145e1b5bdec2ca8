import random
import re
from collections import Counter
from functools import partial

import pytest
from pyspark.sql import functions as F

from cropline.functions import joins
from cropline.functions import matching
from cropline.functions.matching import containing, first_containing, matching_regex
from cropline.functions.ranking import exact_quantiles, ordinals
from cropline.session import materialise


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("int").alias("k")
    )
    right = spark.range(40).select(F.col("id").cast("int").alias("key"), (F.col("id") * 2).alias("v"))
    return left, right


def bag(df):
    return Counter(tuple(r) for r in df.select("id", "k", "v").collect())


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys_are_split_without_changing_the_join(sides, how):
    left, right = sides
    plain = left.join(right, F.col("k") == F.col("key"), how).drop("key")
    split = joins.split_hot_keys(left, right, {"k": "key"}, how, share=0.05, min_rows=10)
    assert bag(split) == bag(plain)


def test_hot_key_lands_in_several_parts(sides):
    left, right = sides
    spread, repeated = joins.spread_hot_keys(left, right, {"k": "key"}, share=0.05, min_rows=10)
    parts = dict(spread.groupBy("k").agg(F.countDistinct("_part")).collect())
    assert parts[7] > 3 and parts[8] == 1
    assert repeated.count() < 40 + 2 / 0.05


def test_lookup_gives_the_same_on_both_ways(sides):
    left, right = sides
    assert bag(joins.lookup(left, right, {"k": "key"})) == bag(joins.lookup(left, right, {"k": "key"}, broadcast_rows=1))


def test_large_table_is_not_broadcast(sides):
    left, right = sides
    assert joins.fits_broadcast(right, 40) and not joins.fits_broadcast(right, 39)


def test_repeated_right_rows_survive_the_split(frame):
    left = frame("id long, k string", [(i, "hot") for i in range(50)])
    right = frame("key string, v long", [("hot", 1), ("hot", 2), ("cold", 3)])
    assert joins.split_hot_keys(left, right, {"k": "key"}, "inner", 0.1, 2).count() == 100


@pytest.mark.parametrize("how", ["left", "inner"])
def test_stored_counts_do_not_change_the_join(frame, how):
    left = frame("id long, k string, j int", [(i, [None, "hot", f"k{i}"][i % 3], i % 2) for i in range(200)])
    right = frame("key string, jj int, v long", [("hot", 0, 1), ("hot", 0, 2), ("k2", 0, 3), ("k2", 1, 4), (None, 1, 5)])
    on = {"k": "key", "j": "jj"}
    plain = left.join(right, (F.col("k") == F.col("key")) & (F.col("j") == F.col("jj")), how).drop("key", "jj")
    split = joins.split_hot_keys(left, right, on, how, share=0.05, min_rows=10, chained=True)
    assert split.columns == plain.columns and bag(split) == bag(plain)
    spread, _ = joins.spread_hot_keys(left, right, on, share=0.05, min_rows=10, chained=True)
    parts = {tuple(r)[:2]: r.n for r in spread.groupBy("k", "j").agg(F.countDistinct("_part").alias("n")).collect()}
    assert parts[None, 0] > 1 and parts["hot", 1] > 1 and parts["k2", 0] == 1


def test_plan_of_chained_joins_holds_each_table_once(spark):
    df = materialise(spark.range(20).select(F.col("id").alias("req"), (F.col("id") % 3).alias("k")))
    for i in range(4):
        right = spark.range(3).select(F.col("id").alias("key"), F.col("id").alias(f"v{i}"))
        df = joins.split_hot_keys(df, right, {"k": "key"}, chained=True)
    assert df._jdf.queryExecution().analyzed().toString().count("Relation [req#") == 1
    assert df.filter("v0 = k AND v1 = k AND v2 = k AND v3 = k").count() == 20


WORDS = ["ring", "a", "rod", "", "bolt", "ringring", "n r", None]
NAMES = ["small ring", "red ring rod", "anvil", "ring", "ringringring", None]


def test_containing_equals_brute_force(frame):
    pairs = containing(
        frame("w string", [(w,) for w in WORDS]), frame("n string", [(n,) for n in NAMES + NAMES]), "w", "n"
    )
    expected = {(w, n) for w in WORDS for n in NAMES if w and n and w in n}
    assert Counter(tuple(r) for r in pairs.collect()) == Counter(expected)


@pytest.mark.parametrize("small", [True, False])
def test_first_containing_equals_brute_force(frame, monkeypatch, small):
    monkeypatch.setattr(matching, "fits_broadcast", lambda df: small)
    ranked = [(n, i) for i, n in enumerate(NAMES) if n]
    found = first_containing(
        frame("w string", [(w,) for w in WORDS]), frame("n string, r int", ranked), "w", "n", "r"
    )
    expected = {w: min(i for n, i in ranked if w in n) for w in WORDS if w and any(w in n for n, _ in ranked)}
    assert dict(map(tuple, found.collect())) == expected


@pytest.mark.parametrize("small", [True, False])
def test_random_words_in_random_names(frame, monkeypatch, small):
    monkeypatch.setattr(matching, "fits_broadcast", lambda df: small)
    monkeypatch.setattr(matching, "split_hot_keys", partial(joins.split_hot_keys, share=0.01, min_rows=3))
    rng = random.Random(5)

    def texts(n, longest):
        return ["".join(rng.choices("abcé ", [5, 3, 1, 1, 1], k=rng.randrange(longest + 1))) for _ in range(n)]

    words, names = texts(120, 7), texts(200, 30) + ["a" * 500, "ab" * 300]
    want = {(w, n) for w in words for n in names if w and w in n}
    pairs = containing(frame("w string", [(w,) for w in words]), frame("n string", [(n,) for n in names]), "w", "n")
    assert Counter(map(tuple, pairs.collect())) == Counter(want)
    ranked = [(n, i * 7919 % 1009) for i, n in enumerate(names)]
    first = first_containing(frame("w string", [(w,) for w in set(words)]), frame("n string, r int", ranked), "w", "n", "r")
    assert dict(map(tuple, first.collect())) == {w: min(r for n, r in ranked if w in n) for w, _ in want}


def test_pieces_do_not_grow_with_the_words(frame):
    names = frame("n string", [("".join(chr(97 + (i * i + j) % 26) for i in range(60)),) for j in range(5)])
    assert matching.grams(names, "n", F.array(F.lit(1), F.lit(2), F.lit(3))).count() <= 3 * 60 * 5
    words = frame("w string", [(("abcdefghij" * 6)[i : i + k],) for k in range(3, 50) for i in range(3)])
    size = F.least(F.length("w"), F.lit(matching.GRAM))
    keyed = matching.rarest_grams(words.distinct(), matching.grams(names, "n", F.array(F.lit(3))), "w", size, True)
    assert all(len(r._key) == 3 and r._key in r.w for r in keyed.collect())


def test_words_are_joined_by_their_rarest_piece(frame):
    names = frame("n string", [("rice fine",), ("rice",), ("price",), ("wheat",)])
    words = frame("w string", [("rice f",), ("price",), ("ricex",), ("oats",)])
    cut = matching.grams(names, "n", F.array(F.lit(3)))
    keyed = matching.rarest_grams(words, cut, "w", F.lit(3), True)
    # "ce " and "e f" are in one name each; "cex" and "oat" are in none.
    assert dict(map(tuple, keyed.collect())) == {"rice f": "ce ", "price": "pri"}


PATTERNS = ["x(y)", "ring", "a|b", "^r", "r.d", "", "(lobia) cow", "dal+", "m(n)(o)p"]
TARGETS = ["xy", "x(y)", "a", "red", "rid", "boring", "lobia cow", "dall", "mnop", "moong(green gram)"]


def test_regex_matching_equals_brute_force(frame):
    pairs = matching_regex(
        frame("p string", [(p,) for p in PATTERNS]), frame("n string", [(n,) for n in TARGETS]), "p", "n"
    )
    expected = {(p, n) for p in PATTERNS for n in TARGETS if re.search(p, n)}
    assert Counter(tuple(r) for r in pairs.collect()) == Counter(expected)


@pytest.mark.parametrize("window_rows", [10, 100_000])
def test_ordinals_on_both_ways(spark, window_rows):
    df = spark.range(2500).select(
        F.when(F.col("id") % 4 == 0, "small").otherwise("large").alias("g"),
        F.format_string("%05d", F.pmod(F.col("id") * 7919, F.lit(100_003))).alias("v"),
    )
    rows = ordinals(df, ["g"], ["v"], window_rows=window_rows).collect()
    for group in ("small", "large"):
        mine = sorted((r.ordinal, r.v) for r in rows if r.g == group)
        assert [o for o, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted(v for _, v in mine)


@pytest.mark.parametrize("window_rows", [0, 1000])
@pytest.mark.parametrize("accuracy", [200, 100_000])
def test_exact_quantiles_with_a_hot_value(spark, accuracy, window_rows):
    import numpy as np

    values = [5.0] * 3000 + [float((i * 7919) % 10_007) / 3 for i in range(6000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    wanted = [0.1, 0.25, 0.5, 0.75, 0.99]
    found = dict(exact_quantiles(df, "x", wanted, accuracy=accuracy, window_rows=window_rows).collect())
    for p in wanted:
        assert found[p] == pytest.approx(float(np.quantile(values, p)), abs=1e-9)


def test_few_large_rows_do_not_fit(spark):
    wide = spark.range(3).selectExpr("id", "repeat('x', 1000) AS text")
    assert joins.fits_broadcast(wide, 10) and not joins.fits_broadcast(wide, 10, size=2000)
    assert not joins.fits_broadcast(wide, 2)
