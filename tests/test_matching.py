import random

import pytest
from pyspark.errors import IllegalArgumentException
from pyspark.sql import functions as F

from cropline.functions import joins
from cropline.functions.matching import matching_regex, required_literal
from cropline.operators import aggregates as A, matching as J
from cropline.session import materialise

VOCAB = "model string, feature string, ordinal int, value string"


@pytest.fixture(scope="module")
def vocab(frame):
    entries = {
        "season": ["Autumn     ", "Kharif     ", "Rabi       "],
        "market": ["Agra Mandi", "Cachar Town", "cachar", "Silchar"],
        "variety": ["Basmati", "Common", "Local", "Rice Fine"],
        "commodity": ["Paddy", "Rice", "Wheat"],
        "grade": ["FAQ", "Large", "Medium"],
    }
    return frame(VOCAB, [("m", f, i, v) for f, values in entries.items() for i, v in enumerate(values)])


def one(df, name):
    return {r.req_id: r[name] for r in df.collect()}


def test_category_ignores_case_and_blanks(frame, vocab):
    df = frame("req_id long, season string", [(1, " kharif"), (2, "RABI "), (3, "monsoon"), (4, None)])
    df = J.match_category(df, vocab, "season")
    assert one(df, "season_value") == {1: "Kharif     ", 2: "Rabi       ", 3: "Autumn     ", 4: "Autumn     "}
    assert one(df, "season_code") == {1: 1, 2: 2, 3: 0, 4: 0}


@pytest.mark.parametrize("shuffled", [{"market"}, {"season", "market", "variety", "grade", "commodity"}])
def test_large_features_are_shuffled_one_by_one(frame, vocab, monkeypatch, shuffled):
    features = ["season", "market", "variety", "grade"]
    rows = [(1, "kharif", "SILCHAR", "local", "FAQ", "rice", "x"), (2, "x", None, "Basmati ", "medium", "x", "wheat"), (3, "rabi", "cachar", "x", "", None, None)]
    df = frame("req long, season string, market string, variety string, grade string, commodity string, crop string", rows)

    def coded(df, vocab):
        found = J.encode(df, vocab, {f: f for f in features})
        return J.match_either(found, vocab, "commodity", "crop", "commodity", "commodity")

    want = coded(df, vocab)
    small, known = joins.fits_broadcast, materialise(vocab)
    large = [J._by_folded_name(known, f) for f in shuffled]
    for module in (joins, J):
        monkeypatch.setattr(module, "fits_broadcast", lambda df, *size: df is not known and all(df is not x for x in large) and small(df, *size))
    found = coded(materialise(df), known)
    plan = found._jdf.queryExecution()
    assert plan.analyzed().toString().count("Relation [req#") == 1
    assert plan.analyzed().toString().count("_rpart") > 0
    if shuffled == {"market"}:
        assert plan.optimizedPlan().toString().count("strategy=broadcast") > len(features)
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_either_follows_the_vocabulary_order(frame, vocab):
    rows = [(1, "wheat", "Rice"), (2, "rice", "x"), (3, "x", " WHEAT "), (4, "x", "y")]
    df = J.match_either(frame("req_id long, a string, b string", rows), vocab, "a", "b", "commodity", "c")
    assert one(df, "c_value") == {1: "Rice", 2: "Rice", 3: "Wheat", 4: "Paddy"}


def test_contains_takes_the_first_entry(frame, vocab):
    df = frame("req_id long, district string", [(1, "CACHAR"), (2, "nowhere"), (3, ""), (4, "char")])
    df = J.match_contains(df, vocab, "district", "market", "market")
    assert one(df, "market") == {1: "Cachar Town", 2: "Agra Mandi", 3: "Agra Mandi", 4: "Cachar Town"}


def test_contains_with_a_generic_word(frame, vocab):
    df = frame("req_id long, crop string", [(1, "rice"), (2, "basmati"), (3, "maize"), (4, "")])
    df = J.match_contains(df, vocab, "crop", "variety", "variety", "local")
    assert one(df, "variety") == {1: "Local", 2: "Basmati", 3: "Local", 4: "Basmati"}


def test_preferred_value(frame, vocab):
    df = frame("req_id long", [(1,)])
    assert df.select(J.preferred(vocab, "grade", "Large")).first()[0] == "Large"
    assert df.select(J.preferred(vocab, "grade", "Export")).first()[0] == "FAQ"


def test_regions_cascade(frame, vocab):
    agri = frame("State string, District string, Crop string", [("B", "d2", "Rice"), ("A", "d1", "Maize"), ("B", "d1", "Rice"), ("B", "d2", "Gram")])
    meta = A.metadata(agri, vocab)
    assert [r[0] for r in J.regions(meta).collect()] == ["A", "B"]
    assert [r[0] for r in J.regions(meta, "B").collect()] == ["d1", "d2"]
    assert [r[0] for r in J.regions(meta, "B", "d2").collect()] == ["Gram", "Rice"]


def test_vocabulary_codes_are_sorted_positions(frame):
    df = frame("a string, b string", [("y", "1"), ("x", "2"), ("y", None)])
    rows = A.vocabulary(A.category_values(df, {"fa": "a", "fb": "b"}, "m")).collect()
    assert {(r.feature, r.ordinal, r.value) for r in rows} == {("fa", 0, "x"), ("fa", 1, "y"), ("fb", 0, "1"), ("fb", 1, "2")}


PATTERNS = [
    "rice", "ri.e", "^rice", "rice$", "ric+e", "ri?ce", "r[iy]ce", "ri(ce)?", "(ri)+ce", "pad{2}y", "pad{0,2}y", "a|rice", "(a|b)c rice",
    r"rice\.", r"\d rice", r"\bpaddy", "(?i)RICE", "x*", ".*", "", "gra(m(s)?)? \\(", "paddy.*fine", "a+?b", "co*?rn", "[a[b]]c", "[]r]ice",
    "[^]r]ice", r"\Qa.b\E", r"\x72ice", "pad(d(y( f(ine)?)?)?)?", "((((((((((deep))))))))))x", "naïve?", "mill[ei]t{1,2}s+", "()rice",
    "wheat()", "(rice", "r{1}ice",
]


def test_regex_index_equals_all_pairs(spark, frame):
    rng = random.Random(3)
    atoms = ["a", "b", "ri", "ce", "pad", ".", "[ab]", "(ab)", "(a)?", "b*", "c+", "i?", "^", "$", r"\.", r"\w", "|", "d{2}", "(b(c)?)*", " "]
    patterns = {"".join(rng.choice(atoms) for _ in range(rng.randrange(1, 5))) for _ in range(150)}
    patterns = [p for p in {*PATTERNS, *patterns} if valid(spark, p)]
    letters = ["a", "b", "c", "d", "ri", "ce", "pad", "dy", " ", ".", "fine", "e", "x", "("]
    names = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(300)}
    names |= {"rice", "ryce", "paddy fine", "Rice", "rice.", "gram (", "padddy", "a.b", "naïve", "naïv", "millets", "deepx", "9 rice", "]ice"}
    left, right = frame("p string", [(p,) for p in patterns] + [(None,)]), frame("n string", [(n,) for n in names] + [(None,)])
    want = {(r.p, r.n) for r in left.crossJoin(right).filter("n rlike p").collect()}
    got = [tuple(r) for r in matching_regex(left, right, "p", "n").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 2000


def valid(spark, pattern):
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except IllegalArgumentException:
        return False


def test_literals_that_every_match_contains(spark, frame):
    df = frame("p string", [(p,) for p in PATTERNS])
    found = {r.p: r.w for r in df.select("p", required_literal(F.col("p")).alias("w")).collect()}
    assert found["paddy.*fine"] == "paddy" and found["ri?ce"] == "ce" and found["pad{2}y"] == "pa" and found["naïve?"] == "naïv"
    assert found["r[iy]ce"] == "ce" and found[r"\bpaddy"] == "paddy" and found["mill[ei]t{1,2}s+"] == "mill"
    assert [found[p] for p in ("a|rice", "x*", ".*", "", "(?i)RICE", r"\Qa.b\E", "(rice")] == [None] * 7


def test_patterns_with_a_literal_are_not_joined_by_block(spark, frame):
    names = frame("n string", [("rice fine",), ("paddy",)])
    for patterns, blocks in ((["ri.e", "pad+y"], False), (["ri.e", "a|b"], True)):
        plan = matching_regex(frame("p string", [(p,) for p in patterns]), names, "p", "n")._jdf.queryExecution().toString()
        assert ("_nblock" in plan) == blocks
