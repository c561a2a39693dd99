import random

import pytest

from brindle.llm import decontamination
from brindle.llm.decontamination import IDENTITY, MASKS, SPAN, WINDOW, contaminated, overlaps, remove_contaminated


def brute(doc, item):
    """The largest identity in a window around a seed; None without one."""
    best, n = None, min(WINDOW, len(item))
    for q in range(len(item) - SPAN + 1):
        for p in range(len(doc) - SPAN + 1):
            if any(all(doc[p + o] == item[q + o] for o in m) for m in MASKS):
                first = max(0, min(q - (WINDOW - SPAN) // 2, len(item) - n))
                same = sum(0 <= k + p - q < len(doc) and doc[k + p - q] == item[k] for k in range(first, first + n))
                if 100 * same >= IDENTITY * n:
                    best = max(best or 0, 100 * same / n)
    return best


def test_matches_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz")
    items = [[word() for _ in range(rng.choice((5, 11, 13, 20, 40)))] for _ in range(8)]
    docs = []
    for i in range(40):
        base = [word() for _ in range(rng.randrange(0, 60))]
        if i % 2:
            part = list(rng.choice(items))
            for k in range(len(part)):
                if rng.random() < (0, 0.1, 0.3)[i % 3]:
                    part[k] = word()
            base[10:10] = part
        docs.append(base)
    d = spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.identity, 6) for r in overlaps(d, b).collect()}
    want = {(i, j): brute(x, y) for i, x in enumerate(docs) for j, y in enumerate(items)}
    assert got == {k: round(v, 6) for k, v in want.items() if v is not None}
    assert len(got) > 5


def test_substitutions_of_one_word_in_six_are_tolerated(spark):
    item = [f"w{k}" for k in range(40)]
    text = [w if k % 6 else f"other{k}" for k, w in enumerate(item)]
    d = spark.createDataFrame([(1, "start here " + " ".join(text)), (2, "clean text " * 30)], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [r.doc_id for r in contaminated(d, b).collect()] == [1]


def test_edges(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    d = spark.createDataFrame([(None, passage, 1), (None, "x", 2), (1, passage, 3), (1, passage, 3), (2, None, 4), (3, "", 5), (4, "clean", 6)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(7, passage, 0), (7, passage, 0), (8, None, 0), (None, "", 0)], "item_id long, text string, doc_id int")
    rows = {r.doc_id: r for r in contaminated(d, b).collect()}
    assert set(rows) == {None, 1} and rows[1].items == "7" and rows[1].n_items == 1
    left = remove_contaminated(d, b)
    assert left.columns == d.columns
    # Without an id a row is known by its text: the clean one stays.
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "4", "None"]
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("limit", ["MAX_BROADCAST_SEEDS", "MAX_BROADCAST_BYTES"])
def test_shuffled_seeds_match_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, limit, 0)
    test_matches_brute_force(spark)
    test_edges(spark)


def test_seed_rows_do_not_grow_with_texts(spark, monkeypatch):
    """A long item and a long document with the item's last words, by both ways."""
    words = [f"w{k}" for k in range(3000)]
    d = spark.createDataFrame([(1, " ".join(words[-14:] + ["x"] * 3000)), (2, " ".join(["y"] * 3000 + words[:15]))], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    items = b.select("item_id", decontamination.hashed_words("text").alias("th"))
    docs = d.select("doc_id", decontamination.hashed_words("text").alias("th"))
    assert max(len(r.theirs) for r in decontamination._item_seeds(items).collect()) == WINDOW
    assert max(len(r.th) for r in decontamination._near(decontamination._seeds(docs)).collect()) <= WINDOW + SPAN
    broadcast = sorted(overlaps(d, b).collect())
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_SEEDS", 0)
    assert sorted(overlaps(d, b).collect()) == broadcast and {r.doc_id for r in broadcast} == {1, 2}


@pytest.mark.parametrize("limit", [None, "MAX_BROADCAST_SEEDS"])
def test_long_items_and_repeated_words(spark, monkeypatch, limit):
    """Repeated words meet few different seeds; they count as often as they occur."""
    if limit:
        monkeypatch.setattr(decontamination, limit, 0)
    words = [f"w{k}" for k in range(50_000)]
    d = spark.createDataFrame([(1, "again " * 20_000), (2, "x " * 500 + " ".join(words[30_000:30_020])), (3, "clean " * 10)], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(words)), (8, "again " * 20_000)], "item_id long, text string")
    items = b.select("item_id", decontamination.hashed_words("text").alias("th"))
    assert decontamination._item_seeds(items.where("item_id = 8")).count() <= 3 * 5
    got = {(r.doc_id, r.item_id): (r.n_seeds, r.identity) for r in overlaps(d, b).collect()}
    assert set(got) == {(1, 8), (2, 7)} and got[2, 7][1] == 100
    assert got[1, 8][0] > 3 * 19_900**2
