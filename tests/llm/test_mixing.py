import math
import struct
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
import xxhash

from pyspark.sql import functions as F

from cropline.llm import mixing
from cropline.llm.mixing import Mix, apply_mix, mix_sources
from tests.llm.rows import documents, empty, words

SF = "/root/testdata/sf0.01"


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, ceiling=2.0):
    """Targets by the rule, source by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, full = share * sum(sizes.values()), {s for s in sizes if sizes[s] == 0}
    while True:
        free = [s for s in sizes if s not in full]
        level = (goal - sum(ceiling * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > ceiling * sizes[s]}
        if not above:
            return {s: ceiling * sizes[s] if s in full else level * weight[s] for s in sizes}
        full |= above


@pytest.mark.parametrize("leaf", [256, 4])
def test_mix_meets_its_targets(spark, leaf):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = mix_sources(docs, mix=Mix(leaf=leaf)).collect()
    assert sorted(r._id for r in got) == sorted(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        source = rows[r._id].source
        assert r.size == len(words(rows[r._id].text)) and r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        sizes[source] += r.size
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
    targets = plain_targets(sizes)
    for r in got:
        source = rows[r._id].source
        assert r.source_size == sizes[source] and math.isclose(r.target, targets[source], rel_tol=1e-9)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1e-3
    # Long documents are rounded first, so most sources end far closer.
    off = sorted(abs(taken[s] - t) / t for s, t in targets.items())
    assert off[len(off) * 3 // 4] < 0.01
    again = mix_sources(docs.repartition(5), mix=Mix(leaf=leaf)).collect()
    assert Counter((r._id, r.copies) for r in again) == Counter((r._id, r.copies) for r in got)


def hashed(*parts, seed=42):
    """Spark's xxhash64 of integers ("i"), longs, doubles ("d") and texts, one after the other."""
    for kind, value in parts:
        if value is not None:
            data = value.encode() if kind == "s" else struct.pack(f"<{kind}", value)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_rounding(items, mix):
    """0 or 1 more copy of (fields, size, part, leaf, leaves) by pairs, leaf by leaf and level by level."""
    extra, level = {}, 0
    most = max((i[4] for i in items), default=0)
    while most:
        leaves = defaultdict(list)
        for item in items:
            leaves[item[3], item[4]].append(item)
        items = []
        for (leaf, count), group in leaves.items():
            c = None
            for x in sorted(group, key=lambda i: (i[1], hashed(("i", mix.seed), *i[0]))):
                if c is None:
                    c = x
                    continue
                (c_id, c_size, c_part), (x_id, x_size, x_part) = c[:3], x[:3]
                gain = min((1 - c_part) * c_size, x_part * x_size)
                loss = min(c_part * c_size, (1 - x_part) * x_size)
                bits = hashed(("i", mix.seed), ("i", level), *c_id, *x_id, ("q", c_size), ("q", x_size)) % (1 << 64)
                up = (bits >> 11) / (1 << 53) * (gain + loss) < loss
                first_done = (1 - c_part) * c_size <= x_part * x_size if up else c_part * c_size <= (1 - x_part) * x_size
                moved = gain if up else -loss
                if first_done:
                    extra[c_id] = int(up)
                    c = (x_id, x_size, min(max(x_part - moved / x_size, 0.0), 1.0))
                else:
                    extra[x_id] = int(not up)
                    c = (c_id, c_size, min(max(c_part + moved / c_size, 0.0), 1.0))
            items.append((*c[:3], leaf // mix.leaf, -(-count // mix.leaf)))
        level += 1
        if most == 1:
            break
        most = -(-most // mix.leaf)
    extra.update({i[0]: int(i[2] >= 0.5) for i in items})
    return extra


@pytest.mark.parametrize("leaf", [256, 8])
def test_rounding_matches_brute_force(spark, leaf):
    mix = Mix(leaf=leaf)
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    # Few sources, so that their leaves make a tree of several levels.
    source = {r.doc_id: "ab"[r.doc_id % 2] if r.doc_id % 7 else None for r in rows}
    size = {r.doc_id: len(words(r.text)) for r in rows}
    mark = {r.doc_id: hashed(("s", r.text or "")) for r in rows}
    totals, counts = Counter(), Counter()
    for i, s in source.items():
        totals[s] += size[i]
        counts[s] += size[i] > 0
    docs = spark.createDataFrame([(r.doc_id, r.text, source[r.doc_id]) for r in rows], "doc_id long, text string, source string")
    got = mix_sources(docs.repartition(4), mix=mix).collect()
    # To the last bit, as the draws depend on it.
    targets, want = {source[r._id]: r.target for r in got}, {}
    assert targets == pytest.approx(plain_targets(totals))
    for s, target in targets.items():
        rate, leaves = target / totals[s], max(-(-counts[s] // leaf), 1)
        whole = math.floor(rate)
        ids = [i for i in source if source[i] == s and size[i] > 0]
        want.update({i: whole for i in ids})
        passes = [[i for i in ids if size[i] > totals[s] / counts[s]], [i for i in ids if size[i] <= totals[s] / counts[s]]]
        part = rate - whole
        for number, chosen in enumerate(passes):
            fields = {i: (("q", i), ("q", mark[i]), ("q", whole), ("q", 1), ("d", part)) for i in chosen}
            items = [(f, size[i], part, hashed(("i", mix.seed + 1), *f[:2]) % leaves, leaves) for i, f in fields.items()]
            extra = plain_rounding(items, mix)
            want.update({i: whole + extra[f] for i, f in fields.items()})
            if number == 0:
                off = sum(Decimal(repr((extra[f] - part) * size[i])).quantize(Decimal("1e-9"), ROUND_HALF_UP) for i, f in fields.items())
                part = min(max(part - float(off) / sum(size[i] for i in passes[1]), 0.0), 1.0)
    assert {r._id: r.copies for r in got} == {r.doc_id: want.get(r.doc_id, 0) for r in rows}


def test_each_document_keeps_its_expectation(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 5)), "a" if i % 2 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    runs, mix = 4, {"weights": (1, 3), "share": 0.8, "leaf": 16}
    total = Counter()
    for seed in range(runs):
        total.update({r._id: r.copies for r in mix_sources(docs, mix=Mix(seed=seed, **mix)).collect()})
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    rates = {s: target / sizes[s] for s, target in plain_targets(sizes, (1, 3), 0.8).items()}
    # Short and long documents alike get the source's rate.
    for group in range(10):
        ids = [i for i, *_ in rows if i % 10 == group]
        assert abs(sum(total[i] for i in ids) / runs / len(ids) - rates["a" if group % 2 else "b"]) < 0.12


def test_odd_documents(spark):
    docs = documents(spark)
    got = mix_sources(docs).collect()
    assert Counter(str(r._id) for r in got) == Counter(str(r.doc_id) for r in docs.collect())
    assert all(0 <= r.taken <= 2 * r.size and (r.size or r.taken == 0) for r in got)
    applied = apply_mix(docs)
    assert applied.columns == docs.columns
    assert sum(len(words(r.text)) for r in applied.collect()) == sum(r.taken for r in got)
    assert Counter(r.doc_id for r in applied.collect()) == Counter(
        {i: n for i, n in sum((Counter({r._id: r.copies}) for r in got), Counter()).items() if n}
    )


def test_empty_tables(spark):
    assert mix_sources(empty(spark)).count() == 0 and apply_mix(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert {(r._id, r.target, r.taken) for r in mix_sources(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_rows_alike_are_rounded_together(spark):
    rows = spark.range(3000).selectExpr("if(id < 2000, 1, id) AS doc_id", "'a b c' AS text", "'s' AS source")
    other = spark.range(500).selectExpr("id + 10000 AS doc_id", "'a b' AS text", "'t' AS source")
    got = mix_sources(rows.union(other), mix=Mix(weights=(1, 5), share=0.9, leaf=32)).collect()
    assert len(got) == 3500
    by_source = defaultdict(int)
    for r in got:
        by_source[r.size] += r.taken
        assert 0 <= r.copies <= 2
    target = {r.size: r.target for r in got}
    assert all(abs(by_source[size] - target[size]) <= size for size in target)
    # The 2,000 rows of one document have as many copies each, to one.
    assert len({r.copies for r in got if r._id == 1}) <= 2
    rate = target[3] / 9000
    assert abs(sum(r.copies for r in got if r._id == 1) - 2000 * rate) <= 1


def test_copies_of_one_row_come_from_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    docs = spark.range(1000).selectExpr("1 AS doc_id", "'a b c' AS text", "'s' AS source", "id % 3 AS _chunk")
    # One source is taken up to its ceiling.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        taken = apply_mix(docs, mix=Mix(share=2.0))
        assert taken.columns == docs.columns and taken.count() == 2000
        per_task = [r["count"] for r in taken.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) > 2 and max(per_task) < 1500
