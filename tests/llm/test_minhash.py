import random
import re

from brindle.llm import minhash
from brindle.llm.components import components
from brindle.llm.minhash import near_duplicates, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size=2, percent=80):
    """{doc_id: (n_shingles, component)} by comparing every pair."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, families=12, copies=12):
    """Families of near copies at all distances, with exact copies among them."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 8, 40, 120)))]
        for _ in range(rng.randrange(1, copies)):
            words = list(base)
            for _ in range(int(len(words) * rng.choice((0, 0.02, 0.04, 0.06, 0.1)))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


def check(spark, rows, **kw):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()}
    assert got == brute(rows, kw.get("size", 2))


def test_matches_brute_force(spark):
    check(spark, corpus(1))


def test_large_buckets_match_brute_force(spark, monkeypatch):
    """Every bucket of three goes through the blocks, of few classes each."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    check(spark, corpus(2, families=6, copies=40))


def test_five_word_shingles(spark):
    check(spark, corpus(3, families=8), size=5)


def test_edges(spark):
    rows = [(5, "A b\tc", "x"), (3, "a B c", None), (7, None, "y"), (8, "", "y"), (9, " \n", "z"), (None, "a b c", "q"), (11, "one", "q"), (12, "ONE", "q"), (13, "É é", "q"), (14, "é é", "q"), (3, "a B c", None), (15, "w " * 9000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = near_duplicates(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(map(tuple, out.collect()), key=str)
    want = [(5, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (None, 2, None, True), (11, 1, 11, True), (12, 1, 11, False), (13, 1, 13, True), (14, 1, 14, True), (15, 1, 15, True)]
    assert got == sorted(want, key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_near_the_similarity(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:300]))]
    a, b = sorted(signatures(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    from pyspark.sql import functions as F

    pair = spark.createDataFrame([(a.bits, b.bits)], "a array<long>, b array<long>")
    assert abs(pair.select(minhash.estimate(F.col("a"), F.col("b"))).first()[0] - 299 / 399) < 0.15


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300), (None, 4)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def thue_morse(n):
    """Two different words of ``n`` letters with equal polynomial hashes modulo 2**64."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_equal_polynomial_hashes_are_not_linked(spark):
    rows = [(k, f"{word} one two") for k, word in enumerate([*thue_morse(1024), *thue_morse(4096), *thue_morse(64)])]
    check(spark, rows)
    check(spark, [(k, t.split()[0]) for k, t in rows])


def test_other_bands(spark):
    rows = corpus(5, families=4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n_bands=40, n_rows=4).collect()}
    assert got == brute(rows)


def jobs_of(spark, run):
    """What ``run`` returns, and how many Spark jobs it took."""
    context = spark.sparkContext
    group = f"jobs-{random.random()}"
    context.setJobGroup(group, "")
    try:
        return run(), len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_rounds_and_one_task_find_the_same_components(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 50)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(900, 300), (300, 300), (400, 400), (None, 4)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got, most = {}, 0
    for few in (0, 20, 10_000):
        monkeypatch.setattr("brindle.llm.components.FEW_EDGES", few)
        got[few], n = jobs_of(spark, lambda: {r.id: r.component for r in components(frame).collect()})
        # The fewer rounds, the fewer jobs the driver plans and tells of.
        assert not most or n < most
        most = n
    assert got[0] == got[20] == got[10_000]
    assert got[0][50] == 0 and got[0][900] == got[0][300] == 300 and got[0][400] == 400
    assert components(frame.limit(0)).count() == components(frame.where("a = 400")).count() - 1 == 0


def test_few_links_take_few_jobs(spark):
    """Rounds over a few edges cost the driver as much as rounds over many."""
    frame = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    got, jobs = jobs_of(spark, lambda: components(frame).collect())
    assert {r.component for r in got} == {0} and len(got) == 201
    assert jobs <= 8
