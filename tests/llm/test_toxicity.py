import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model, keep=["doc_id", "lang"]).join(labels, "doc_id").collect()
    return model, rows


def test_held_out_accuracy(scored):
    _, rows = scored
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    english = [r for r in held if r.lang == "en"]
    hits = sum(r.toxicity_score >= toxicity.CUT for r in english if r.toxic)
    false = sum(r.toxicity_score >= toxicity.CUT for r in held if not r.toxic)
    assert hits >= 0.8 * sum(r.toxic for r in english)
    assert false <= 0.03 * len(held)


def test_held_out_matches_crc32(spark):
    df = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", toxicity.held_out("doc_id").alias("h")).collect()}
    assert got == {k: zlib.crc32(b"" if k is None else str(k).encode()) % 4 == 2 for k in [*range(50), None]}


def test_pieces_score_like_whole_texts(scored, monkeypatch):
    """However texts are batched, a filter does not reach into the next one."""
    model, _ = scored
    texts = ["you idiot", None, "", "fine words here that are long enough", "x", "y z", "idiot you"] * 3
    together = model.scores(pa.array(texts, pa.string()))
    alone = np.concatenate([model.scores(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone, atol=1e-6)
    assert together.min() >= 0 and together.max() <= 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a", "en", 0.5), (None, None, None, 1.0), (1, "a", "en", 0.5), (2, "", "de", None), (3, "w " * 30000, "en", 0.0)], "doc_id long, text string, lang string, toxicity_score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == 5
    assert {r.toxicity_score for r in out.collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_best_threshold():
    score, toxic = np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])
    assert toxicity.best_threshold(score, toxic) == pytest.approx(0.5)


@pytest.mark.parametrize("few", [10**6, 0])
def test_thresholds_count_all_labelled_rows_at_their_mix(spark, monkeypatch, few):
    """A sample of few clean rows does not hide the clean rows of equal scores."""
    rows = [(k, "bad idiot words here" if k % 10 == 0 else "bad idiot words" if k % 10 == 1 else "fine words here", "en" if k % 3 else None) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k, *_ in rows], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "MAX_BROADCAST_IDS", few)
    monkeypatch.setattr(toxicity, "calibrate", lambda model, counts: seen.update(counts))
    toxicity.fit(docs, labels, max_positive=20, max_negative=10)
    known = [(lang, int(k % 10 == 0)) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    got = {(lang, t): int(seen[lang][:, t].sum()) for lang in seen for t in (0, 1)}
    assert got == {(lang, t): known.count((lang, t)) for lang in ("en", None) for t in (0, 1)}


def test_small_languages_lean_on_all():
    shape = (2 * toxicity.MOST * toxicity.BINS, 2)
    common, small, large = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    low, high = toxicity._bins(np.array([0.2, 0.7]))
    common[high, 1], common[low, 0] = 500, 4000
    for counts, n in ((small, 1), (large, 900)):
        counts[low, 1], counts[low - 9, 0] = n, 9 * n
    model = toxicity.Model(*[None] * 6)
    toxicity.calibrate(model, {"en": common, "fr": small, "de": large, None: np.zeros(shape)})
    assert set(model.thresholds) == {"en", "fr", "de"}
    assert model.thresholds["de"] < 0.2 < model.thresholds["fr"] < 0.7 and 0.2 < model.thresholds["en"] < 0.7


def test_bins_agree(spark):
    score = [0.0, 1e-9, 0.01, 0.3, 0.5, 0.77, 1 - 1e-9, 1.0]
    df = spark.createDataFrame([(x,) for x in score], "s double").coalesce(1)
    assert [r.b for r in df.select(toxicity._bin(F.col("s")).alias("b")).collect()] == toxicity._bins(np.array(score)).tolist()


def test_scores_match_plain_loops(scored, spark):
    """Every window of every filter, word by word."""
    model, _ = scored
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()] + ["", "one", "one two"]
    for text in texts:
        words = [toxicity.features(pa.array([text], pa.string()))]
        words = next(iter(words[0]), (0, None, np.zeros((3, 0), int)))[2]
        x = [model.word_1[a] + model.word_2[b] + model.prefix[c] for a, b, c in words.T]
        logit = model.intercept
        for i, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = max((sum(float(x[at + k] @ model.filters[i][k, :, f]) for k in range(width) if at + k < len(x)) for at in range(len(x))), default=0.0)
                j = i * toxicity.FILTERS + f
                logit += max(0.0, best + model.bias[j] if len(x) else 0.0) * model.output[j]
        assert model.scores(pa.array([text], pa.string()))[0] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4)


def test_rejecting_keeps_columns_of_any_name(spark):
    rows = [(k, "bad idiot words" if k % 3 == 0 else "fine words here", "en", k / 7, str(k)) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxicity_score double, `toxic` string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)], "doc_id long, toxic int")
    left = toxicity.reject_toxic(docs, labels)
    assert left.dtypes == docs.dtypes
    assert sorted(map(tuple, left.collect())) == [r for r in rows if r[0] % 3]
    assert toxicity.reject_toxic(docs.limit(0), labels).count() == 0
    assert toxicity.reject_toxic(docs, labels.limit(0)).count() == 90


def test_the_sample_is_bounded_in_rows_of_an_id_and_bytes(spark, monkeypatch):
    rows = [(k % 50, f"{'bad idiot' if k % 5 == 0 else 'fine'} words {k // 50}", "en") for k in range(500)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(50)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, *a, **k: seen.append(texts) or toxicity._start(np.random.default_rng(1)))
    toxicity.fit(docs, labels)
    assert len(seen[0]) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(50))
    seen.clear()
    toxicity.fit(docs, labels, max_bytes=100)
    for own in seen[:1]:
        assert sum(t.nbytes for t in own) <= 200
