import math

import numpy as np
import pytest

from cropline.llm import topk
from cropline.llm.topk import top_k

QUERY = "_id % 50 = 0"


def plain_top(rows, k=5):
    usable = [
        (i, [math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, q in sorted({i: v for i, v in reversed(usable)}.items()):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)
            out += [(i, n + 1, j, max(-(2**63 - 1), min(2**63 - 1, -s))) for n, (s, j) in enumerate(best[:k])]
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"LEAST_ROWS": 60, "QUERIES_PER_BLOCK": 3, "TILE": 32, "QUERY_TILE": 2, "HEAD": 2}.items():
        monkeypatch.setattr(topk, name, value)


def test_odd_vectors_match_brute_force(spark, small_blocks):
    rng = np.random.default_rng(1)
    rows = [
        (int(i), [float(x) for x in rng.normal(size=rng.integers(2, 7)) * rng.choice([0.01, 1, 30])])
        for i in rng.choice(500, 300, replace=False)
    ]
    rows += [(1000 + i, [1.0, 2.0, 3.0]) for i in range(150)]  # ties
    rows += [(2050, None), (None, [1.0]), (2100, [None, 1.0]), (2150, [float("nan")]), (2200, [float("inf"), 1.0])]
    rows += [(5000, [1e300, 1.0]), (5050, [1e200, -1e300]), (5100, []), (5150, [0.0, 0.0]), (7, [9.0]), (7, [9.0])]
    rows = [(i, v) for n, (i, v) in enumerate(rows) if i != 7 or n >= len(rows) - 2]
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, _id int, _v int, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(frame, QUERY).collect())
    assert got == plain_top(rows)


def test_pruned_search_matches_brute_force(spark, small_blocks):
    rng = np.random.default_rng(2)
    # Lengths fall fast and most of each vector lies in a few directions.
    base = rng.normal(size=(700, 12)) * np.array([8, 4, 2] + [0.2] * 9) * rng.pareto(1.5, size=(700, 1))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(frame, QUERY).collect())
    assert got == plain_top(rows)


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_scores_beyond_64_bits_are_ranked_exactly(spark, small_blocks, sign):
    rng = np.random.default_rng(5)
    rows = [(i, [sign * float(x) for x in rng.uniform(1, 2, 3) * 10.0 ** rng.integers(12, 309)]) for i in range(0, 90)]
    rows += [(100 + i, [float(x) for x in rng.normal(size=3)]) for i in range(100)] + [(50_000, [1.0, 0.5, -0.25]), (50_050, [-1e308, -1.5e308, -1e308])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(frame, QUERY).collect())
    assert got == plain_top(rows)


def test_no_cross_join_and_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 4 * 25)
    monkeypatch.setattr(topk, "QUERY_BYTES", 8 * 4 * 3)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = top_k(frame, QUERY)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == plain_top(rows)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    assert top_k(frame.limit(0), QUERY).count() == 0
    assert [(r.query_id, r.rank, r.vec_id) for r in top_k(frame, QUERY).orderBy("query_id", "rank").collect()] == [
        (0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)
    ]
