import hashlib
from collections import Counter, defaultdict

import pytest

from cropline.llm.exact_dedup import exact_dedup, resolve_copies
from tests.llm.rows import documents, empty


def _key(doc_id):
    return float("-inf") if doc_id is None else doc_id


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_groups_match_brute_force(spark, support):
    rows = documents(spark).collect()
    groups = defaultdict(list)
    for row in rows:
        groups[row.text or ""].append(row.doc_id)
    want = Counter()
    for text, ids in groups.items():
        best = max(ids, key=_key)
        for n, i in enumerate(sorted(ids, key=_key, reverse=True)):
            want[i, best, len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    got = resolve_copies(documents(spark), support=support).collect()
    assert Counter((r._id, r.keep_id, r.group_size, r.kept, r._digest.hex()) for r in got) == want


def test_one_row_of_each_text_stays(spark):
    docs = documents(spark)
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    best = {}
    for row in docs.collect():
        best[row.text or ""] = max(best.get(row.text or "", row.doc_id), row.doc_id, key=_key)
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter((i, t) for t, i in best.items())


def test_heavy_group_keeps_the_largest_id(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) AS text")
    rows = resolve_copies(docs).filter("group_size > 1")
    assert rows.count() == 1667 and {r.keep_id for r in rows.select("keep_id").distinct().collect()} == {4998}
    assert exact_dedup(docs).count() == 5000 - 1666


def test_empty_table(spark):
    assert resolve_copies(empty(spark)).count() == 0 and exact_dedup(empty(spark)).count() == 0
