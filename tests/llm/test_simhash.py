import random

import numpy as np
import pytest
import xxhash

from cropline.llm.components import connected_components
from cropline.llm.simhash import fingerprint, near_dedup, near_groups, near_links
from cropline.session import materialise
from tests.llm.rows import documents, empty, words


def plain_fingerprint(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    found = words(lowered)
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] if len(found) > 2 else [" ".join(found)] * bool(found)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("text", ["", " ", "A", "a b", "a b c", "A b\tC\nd\x0be\x0cf\rg", "ſ É é ü 😀 x x x x", "x " * 70_000])
def test_fingerprint_matches_the_rule(text):
    assert fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text)


@pytest.mark.parametrize("parts", [1, 2, 4, 8, 16])
def test_links_join_what_brute_force_joins(spark, parts):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for value in list(values)[:60]:
        near = value
        for _ in range(4):  # chains of neighbours, one or two bits apart
            near ^= 1 << rng.randrange(64)
            near ^= rng.choice([0, 1 << rng.randrange(64)])
            values.add(near)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    table = materialise(spark.createDataFrame([(v,) for v in signed], "fp long"))
    links = [(r.a, r.b) for r in near_links(table, "fp", 2, parts).collect()]
    ordered = sorted(values)
    near = [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= 2]
    signed_of = {v: int(np.uint64(v).astype(np.int64)) for v in values}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and a != b for a, b in links)
    want = plain_components([(signed_of[a], signed_of[b]) for a, b in near], signed)
    assert plain_components(links, signed) == want


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 120)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000), (7, 3), (None, 4)]
    links += [(2000 + i, 2000 + (i * 7) % 50) for i in range(50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = plain_components(real, {n for pair in real for n in pair})
    assert got == want
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_groups_match_brute_force(spark):
    rows = documents(spark).collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    number = plain_components(
        [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2], range(len(rows))
    )
    least = {}
    for i, row in enumerate(rows):
        if row.doc_id is not None:
            least[number[i]] = min(least.get(number[i], row.doc_id), row.doc_id)
    want = sorted((str(r.doc_id), prints[i], str(least.get(number[i]))) for i, r in enumerate(rows))
    got = near_groups(documents(spark)).collect()
    assert sorted((str(r._id), r._fp % (1 << 64), str(r.component_id)) for r in got) == want


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    rows = docs.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    number = plain_components(
        [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2], range(len(rows))
    )
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(number[i], []).append((row.doc_id is None, row.doc_id))
    want = sorted(str(min(ids, key=str if all(n for n, _ in ids) else lambda x: (x[0], x[1] or 0))[1]) for ids in groups.values())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_near_copies_without_an_id_or_with_one_id(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(None, text), (None, text + " end"), (None, text), (5, "a b c d"), (5, "q r s t"), (5, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert (plain_fingerprint(text) ^ plain_fingerprint(text + " end")).bit_count() <= 2
    kept = [(r.doc_id, r.text) for r in near_dedup(docs).collect()]
    assert sorted(t for i, t in kept if i == 5) == ["a b c d", "q r s t"]
    assert len([t for i, t in kept if i is None]) == 1


def test_empty_table(spark):
    assert near_groups(empty(spark)).count() == 0 and near_dedup(empty(spark)).count() == 0
