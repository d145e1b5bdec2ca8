import math
import random
import re
from collections import Counter

import pytest

from cropline.llm import lexical
from cropline.llm.lexical import rank_documents
from tests.llm.rows import documents, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranks(docs, items, k):
    """Ranks of (id, text) rows for (item, text) rows. Ids of equal scores are compared as sets."""
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for i, c, n in counted:
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * n * n_docs) // total
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out.update((item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1))
    return out


def ranks_of(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(tuple(r) for r in df.collect())


def sample(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "Éa", "x1", "9", "naïve", "a", "b", *[f"w{i}" for i in range(60)], "日本"]
    weights = [200 / (i + 1) for i in range(len(vocabulary))]

    def text(most):
        return rng.choice([" ", "\n", "-", "\x7f", "_"]).join(rng.choices(vocabulary, weights, k=rng.randrange(most)))

    docs = [(i, text(40)) for i in range(300)] + [(1000 + i, "the of w9 w9") for i in range(60)] + [(7, "w9 of"), (7, "w9 of")]
    docs += [(None, "w9 of"), (500, None), (501, ""), (502, "!!")]
    return docs, [(i, text(14)) for i in range(12)] + [(50, ""), (51, None), (52, "w9 W9 of zzz"), (None, "w3"), (52, "the")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_matches_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(lexical, "fits_broadcast", lambda *_: False)
    docs, items = sample(4)
    left = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, score int, slice string")
    right = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    got = ranks_of(rank_documents(left.repartition(5), right, slice_rows=32, group_rows=4))
    assert got == plain_ranks(docs, items, 10)


def test_more_results_than_documents(spark):
    docs, items = [(1, "a b"), (2, "a a c"), (3, "d")], [(1, "a b d"), (2, "q")]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranks_of(rank_documents(left, right)) == plain_ranks(docs, items, 10)
    assert ranks_of(rank_documents(left, right, k=1)) == plain_ranks(docs, items, 1)


def test_odd_documents(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, "alpha no ID"), (2, "😀 k word3 THREE"), (3, None)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ranks_of(rank_documents(docs, items)) == plain_ranks(rows, [(1, "alpha no ID"), (2, "😀 k word3 THREE")], 10)
    assert rank_documents(empty(spark), items).count() == 0
    assert rank_documents(docs, items.limit(0)).count() == 0
