import hashlib
from collections import Counter

import pytest

from brindle.llm.sharding import assign_shards, fill_table


def brute(shards, size):
    """Each shard's whole preference list, then turns over the lists."""
    lists = []
    for name in shards:
        # The first 64 bits of the MD5 of "offset:<name>" and "skip:<name>".
        a = int(hashlib.md5(f"offset:{name}".encode()).hexdigest()[:16], 16) % size
        b = int(hashlib.md5(f"skip:{name}".encode()).hexdigest()[:16], 16) % (size - 1) + 1
        lists.append([(a + j * b) % size for j in range(size)])
    table = {}
    while len(table) < size:
        for k, order in enumerate(lists):
            free = next((s for s in order if s not in table), None)
            if free is not None:
                table[free] = k
    return [table[s] for s in range(size)]


def test_table_matches_brute_force_and_is_even():
    shards = [f"s{k}" for k in range(7)]
    table = fill_table(shards, 101)
    assert table == brute(shards, 101)
    n = Counter(table)
    assert max(n.values()) - min(n.values()) <= 1


def test_losing_a_shard_moves_few_other_slots():
    shards = [f"s{k}" for k in range(20)]
    a, b = fill_table(shards, 10007), fill_table(shards[:-1], 10007)
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 19)
    assert moved < 0.15 * 10007


def test_bad_parameters():
    for shards, size in ((["a", "a"], 101), ([], 101), (["a"], 100)):
        with pytest.raises(ValueError):
            fill_table(shards, size)


def test_placement(spark):
    rows = [(1, "x", "s"), (1, "x", "s"), (None, None, None), (2, "", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = assign_shards(df, "doc_id", ["a", "b", "c"], 101)
    assert sorted(out.columns) == ["doc_id", "shard", "slot", "text"]
    got = out.collect()
    table = fill_table(["a", "b", "c"], 101)
    assert len(got) == 4 and all(r.shard == "abc"[table[r.slot]] for r in got)
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    assert assign_shards(df.limit(0), "doc_id", ["a"], 101).count() == 0
