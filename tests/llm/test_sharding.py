import hashlib
from collections import Counter

import pytest

from cropline.llm.sharding import SHARDS, SLOTS, fill_table, lookup_table, place, write_shards
from tests.llm.rows import documents, empty


def plain_table(shards, slots):
    """Whole preference lists, then turns."""
    lists = []
    for name in shards:
        digest = hashlib.md5(name.encode()).hexdigest()
        offset, step = int(digest[:16], 16) % slots, int(digest[16:], 16) % (slots - 1) + 1
        lists.append([(offset + j * step) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for shard, order in enumerate(lists):
            slot = next((s for s in order if s not in owner), None)
            if slot is not None:
                owner[slot] = shard
    return [owner[s] for s in range(slots)]


def test_table_is_filled_in_turns():
    names = ["a", "b", "c", "d", "e"]
    assert fill_table(names, 101) == plain_table(names, 101)
    sizes = Counter(fill_table(SHARDS))
    assert len(sizes) == len(SHARDS) and max(sizes.values()) - min(sizes.values()) <= 1


def test_few_slots_move_when_a_shard_leaves():
    names = [f"s{i}" for i in range(20)]
    before, after = fill_table(names, 5003), fill_table(names[:-1], 5003)
    moved = sum(a != b for a, b in zip(before, after) if names[a] != "s19")
    assert moved < 0.1 * 5003


@pytest.mark.parametrize("names, slots", [(["a", "a"], 101), ([], 101), (["a"], 100)])
def test_bad_tables_are_refused(names, slots):
    with pytest.raises(ValueError):
        fill_table(names, slots)


def test_rows_go_to_the_owner_of_their_slot(spark):
    table = fill_table(SHARDS)
    assert [SHARDS[n] for n in table] == [r._shard for r in lookup_table(spark).orderBy("_slot").collect()]
    docs = documents(spark).withColumnRenamed("kept", "slot").withColumnRenamed("lines", "_slot")
    placed = place(docs, "doc_id")
    assert placed.columns == [*docs.columns, "_slot" if "_slot" not in docs.columns else "__slot", "shard"]
    for row in placed.collect():
        key = "n" if row.doc_id is None else f"k{row.doc_id}"
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % SLOTS
        assert (row["__slot"], row.shard) == (slot, SHARDS[table[slot]])
    assert placed.count() == docs.count() and place(empty(spark), "doc_id").count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = spark.range(2000).withColumnRenamed("id", "doc_id")
    write_shards(docs, str(tmp_path / "out"), "doc_id", files=2, shards=SHARDS[:4])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("doc_id").distinct().count() == 2000
    sizes = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.3 * min(sizes)
