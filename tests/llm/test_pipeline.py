import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from brindle.llm import toxicity
from brindle.llm.queries import tokenizer_path
from tests.llm.test_decontamination import brute as overlap
from tests.llm.test_minhash import brute as near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it returned."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        got = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, got)
        docs = got
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_columns_and_rows_whole(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.dtypes == before.dtypes, name
        old = by_id(before)
        assert all(old[r.doc_id] == r for r in after.collect()), name


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    import pyarrow as pa

    rows = before.collect()
    scores = model.scores(pa.array([r.text for r in rows], pa.string()))
    want = {r.doc_id for r, s in zip(rows, scores, strict=True) if s < model.thresholds.get(r.lang, model.threshold)}
    assert set(by_id(after)) == want


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    groups = near([(r.doc_id, r.text) for r in before.collect()], size=5)
    assert set(by_id(after)) == {i for i, (_, c) in groups.items() if i == c}


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    items = [split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k + o] for o in (0, 1)) for w in items for k in range(len(w) - 1)}
    bad = set()
    for r in before.collect():
        words = split(r.text)
        if sum(g in grams for g in zip(words, words[1:])) >= 3 and any(overlap(words, x) is not None for x in items if set(x) & set(words)):
            bad.add(r.doc_id)
    assert set(by_id(before)) - set(by_id(after)) == bad


def test_source_mix(stages):
    before, after = stages["source_mix"]
    counts = {}
    for r in after.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 2
    size = {r.doc_id: len((r.text or "").split()) for r in before.collect()}
    total, taken = sum(size.values()), sum(size[i] * n for i, n in counts.items())
    assert 1.3 * total < taken < 1.7 * total


def test_token_ids(stages):
    before, after = stages["token_ids"]
    tok, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for r in sorted(before.collect(), key=lambda r: (r.doc_id, r.text)):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, after.collect()), key=lambda r: r[1]) == want


def test_nulls_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "some few words here", "en", None, 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        if name != "source_mix":
            assert out.count() == 4, name
        else:
            out.count()
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 4


def test_extra_columns_and_very_long_texts(spark):
    """Columns of names that the stages use themselves, and a text of 100,000 words."""
    long_text = " ".join(f"long{k % 700}" for k in range(100_000))
    names = ["toxicity_score", "text_length", "id", "key", "slot", "source_size", "at", "row", "size", "label"]
    rows = [(k, t, "en", s, len(t), *(k + j for j in range(len(names)))) for k, (t, s) in enumerate([(long_text, "a"), ("a few words of a short text", "b"), (long_text + " end", "a"), ("", "b")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        got = {tuple(r) for r in out.collect()}
        assert got <= set(rows), name
        assert got == set(rows) if name in ("toxicity", "decontamination") else len(got) == 3 if name == "near_duplicates" else got, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id: r.n_tokens > 100_000 for r in out.collect()} == {0: True, 1: False, 2: True, 3: False}
