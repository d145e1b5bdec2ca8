import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from cropline.llm import prefix_trie
from cropline.llm.prefix_trie import SharedHeads, conversation_trie
from tests.llm.rows import words

SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth int, k1 int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_hash(role, text):
    value = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(role.encode(), 42))
    return value - (1 << 64) if value >> 63 else value


def plain_trie(rows, shared=None):
    """Rows of all nodes, from lists."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, plain_hash(role, text), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    built = own
    if shared:
        built = {}
        for c, ts in own.items():
            head = zlib.crc32(str(c).encode()) % shared.most
            # As in SQL, the remainder has the sign of the number.
            base = c - (abs(c) % shared.period) * (1 if c >= 0 else -1)
            built[c] = own.get(base, [])[:head] + ts[head:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[x] for x in children[node]]
        saved = (len(members[node]) - 1) * len(words(node[-1][1])) if node else 0
        sums[node] = (sum(b[0] for b in below) or int(not below), saved + sum(b[1] for b in below))
    out = Counter()
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(built[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out[
            min(ids), len(node), parent, len(ids), len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()
        ] += 1
    return out


def rows_of(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 6) for r in rows], SCHEMA).repartition(3)


def sample(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 400), convs):
        common = rng.random() < 0.4
        for t in range(rng.randrange(1, longest)):
            text = f"w{t}  of\tall" if common else rng.choice(["a b", "", None, "c d e", "q"])
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", None]) if t > 4 else "user", text))
    return rows


@pytest.mark.parametrize("height", [2, 8])
def test_matches_brute_force(spark, monkeypatch, height):
    # Small blocks and pieces: prefixes cross blocks, ends are hashed in several pieces.
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    rows = sample(height, 90, 14)
    assert rows_of(conversation_trie(table(spark, rows), height=height)) == plain_trie(rows)
    shared = SharedHeads()
    got = rows_of(conversation_trie(table(spark, rows), shared, height=height))
    assert got == plain_trie(rows, shared) and max(r[1] for r in got) > 8


def test_bands_of_bands(spark):
    """A chain far deeper than the square of the height, shared to different depths."""
    rows = [(c, t, "user", f"turn {t} of all") for c, n in ((1, 70), (2, 70), (3, 41), (4, 9)) for t in range(n)]
    rows += [(4, 9, "user", "another way")]
    assert rows_of(conversation_trie(table(spark, rows), height=2)) == plain_trie(rows)


def test_many_alike_end_at_one_node(spark):
    rows = [(c, 0, "user", "the same words") for c in range(3000)]
    found = rows_of(conversation_trie(table(spark, rows)))
    assert found == plain_trie(rows) and len(found) == 2


def test_turnless_conversations_and_absent_bases(spark):
    # 7, 27 and 47 have no base; those whose head is wanted but absent lose their own first turns.
    rows = [(c, t, "user", f"{c} {t}") for c in (7, 27, 47, 60, 61) for t in range(1 + c % 3)]
    got = rows_of(conversation_trie(table(spark, rows), SharedHeads()))
    assert got == plain_trie(rows, SharedHeads())


def test_nulls_and_empty_tables(spark):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, None, None, None), (6, None, None, None), (6, 3, None, "x y")]
    assert rows_of(conversation_trie(table(spark, rows))) == plain_trie(rows)
    assert conversation_trie(table(spark, rows[:1])).count() == 0
    assert conversation_trie(spark.createDataFrame([], SCHEMA), SharedHeads()).count() == 0
