import hashlib
import math

import numpy as np
import pytest

from brindle.llm import ball_kmeans, filtering_lloyd
from brindle.llm.vectors import number_type, shrunk

SCHEMA = "vec_id long, embedding array<float>, label int, code string, cluster long, points int, ids int"
ODD = [
    (None, [0.5] * 8, None),
    (900, None, 1),
    (901, [0.1, None] + [0.0] * 6, 1),
    (902, [0.1, float("nan")] + [0.0] * 6, 2),
    (903, [0.1, float("-inf")] + [0.0] * 6, 2),
    (904, [0.25] * 4, 2),
    (905, [], None),
    (906, [0.25] * 7, 2),
    (3, [-0.0] * 8, None),
    (3, [-0.0] * 8, None),
]


def table(spark, n=300, odd=True, d=8):
    rng = np.random.default_rng(3)
    # Few different values: many ties.
    rows = [(k, [float(x) for x in rng.integers(-6, 6, d) / 16 - 0.0001], k % 5) for k in range(n)] + (ODD if odd else [])
    return rows, spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floors(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def test_codes_match_brute_force(spark):
    rows, df = table(spark)
    kept = [(i, floors(v, 1024), label) for i, v, label in rows if finite(v)]
    coded = [r for r in kept if len(r[1]) == 8]
    order = sorted(coded, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[r[1][2 * p : 2 * p + 2] for r in order] for p in range(4)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v[2 * p : 2 * p + 2], e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(4):
        for p in range(4):
            members = {}
            for r in coded:
                members.setdefault(near(p, r[1])[1], []).append(r[1][2 * p : 2 * p + 2])
            for k, own in members.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    want, by_label = [], {}
    for i, v, label in kept:
        found = [near(p, v) for p in range(4)] if len(v) == 8 else None
        error = sum(x[0] for x in found) if found else None
        want.append((i, "".join(f"{x[1]:02x}" for x in found) if found else None, error, label))
        if error is not None:
            by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = [(i, c, e, by_label.get(label), digest) for i, c, e, label in want]
    got = [tuple(r) for r in filtering_lloyd.compress(df.repartition(3), entries=16).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_walks_find_the_nearest_entry_and_eliminate():
    rng = np.random.default_rng(5)
    centres = rng.integers(-500, 500, (40, 16))
    parts = centres[rng.integers(0, 40, 3000)] + rng.integers(-9, 9, (3000, 16))
    book = np.concatenate([centres, centres[:3], parts[:20]])
    order, low, high, sums = filtering_lloyd.build(parts)
    subtrees, entry = filtering_lloyd.Walk(book).assign(parts[order], low, high)
    nodes = filtering_lloyd.shape(len(parts))
    assert (entry < 0).mean() > 0.3  # whole subtrees
    for node, e in subtrees:
        assert (entry[nodes.first[node] : nodes.last[node]] == -1).all()
        entry[nodes.first[node] : nodes.last[node]] = e
        assert (sums[node] == parts[order][nodes.first[node] : nodes.last[node]].sum(axis=0)).all()
    far = ((parts[order][:, None] - book[None]) ** 2).sum(axis=2)
    assert (entry == far.argmin(axis=1)).all()


def test_no_vectors_and_labels_by_join(spark, monkeypatch):
    _, df = table(spark, 40)
    for none in (df.limit(0), df.where("vec_id in (900, 901)")):
        assert filtering_lloyd.compress(none).count() == 0
    short = filtering_lloyd.compress(df.where("vec_id in (904, 905, 906)"), parts=3).collect()
    assert [r.code for r in short] == [None] * 3
    one = sorted(filtering_lloyd.compress(df, entries=8).collect(), key=str)
    monkeypatch.setattr(filtering_lloyd, "MAX_BROADCAST_LABELS", 0)
    assert sorted(filtering_lloyd.compress(df, entries=8).collect(), key=str) == one
    with pytest.raises(ValueError):
        filtering_lloyd.compress(df, entries=257)


def test_codes_decode(spark):
    _, df = table(spark, 100, odd=False)
    forest = filtering_lloyd.plant(df, entries=32)
    books = filtering_lloyd.fit(forest)
    vectors = {r.vec_id: floors(r.embedding, 1024) for r in df.collect()}
    for r in filtering_lloyd.encode(forest, books).collect():
        assert sum((a - b) ** 2 for a, b in zip(vectors[r.vec_id], books.decode(r.code), strict=True)) == r.error


def test_clusters_match_brute_force(spark):
    rows, df = table(spark)
    kept = [(i, floors(v, 256)) for i, v, _ in rows if finite(v) and len(v) == 8]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:12]
    centroids = [r[1] for r in order]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(5):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        for k, own in members.items():
            centroids[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    total = {k: sum(d for _, d, c in found if c == k) for k in range(12)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    want = [(i, k, d, total[k], sum(total.values()), sha[k]) for i, d, k in found]
    got = [tuple(r) for r in ball_kmeans.clustered(df.repartition(3), k=12, dimension=8).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for none in (df.limit(0), df.where("vec_id > 899")):
        assert ball_kmeans.clustered(none, dimension=8).count() == 0


def test_balls_skip_only_what_cannot_be_nearer():
    rng = np.random.default_rng(9)
    centres = rng.integers(-300, 300, (30, 8))
    points = centres[rng.integers(0, 30, 2000)] + rng.integers(-20, 20, (2000, 8))
    centroids = np.concatenate([centres + rng.integers(-9, 9, centres.shape), centres[:4], centres[:4]])
    cluster = rng.integers(0, len(centroids), 2000)
    far = ((points[:, None] - centroids[None]) ** 2).sum(axis=2)
    for start in (cluster, far.argmin(axis=1)):
        found, distance, compared = ball_kmeans.reassign(points, start, centroids, ball_kmeans.squared(centroids))
        assert (found == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    # From the right clusters, most distances are never taken.
    assert compared < 0.2 * far.size


def test_numbers_are_exact_or_an_error(spark):
    assert shrunk(np.array([-128, 127])).dtype == np.int8 and shrunk(np.array([128])).dtype == np.int16
    assert number_type(16, np.array([1 << 20])) is np.float64 and number_type(16, np.array([1 << 26])) is np.int64
    with pytest.raises(ValueError):
        number_type(16, np.array([1 << 40]))
    big = spark.createDataFrame([(k, [float(k << 12)] * 8) for k in range(40)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.cluster, r.distance) for r in ball_kmeans.clustered(big, dimension=8).collect()}
    assert len({c for c, _ in got.values()}) == 40 and {d for _, d in got.values()} == {0}
