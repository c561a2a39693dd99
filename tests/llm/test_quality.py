import re
from collections import Counter

from brindle.llm.quality import Rule, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {k for i, g in enumerate(grams) if n[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


CASES = [
    (1, "the cat sat on the mat\nthe cat sat on the mat\n\n \n"),
    (2, None),
    (3, ""),
    (4, "a a a a a"),
    (5, "x\x0by\x0cz\x1cq r $$ <b> &amp;\r\n"),
    (6, "ab " * 7000),
    (7, "one two"),
    (8, "é à\té à é à é à"),
    (None, "one two three one two three"),
    (1, "the cat sat on the mat\nthe cat sat on the mat\n\n \n"),
]


def test_counts_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, 9) for i, t in CASES], "doc_id long, text string, n_words int")
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality(df).collect())
    assert got == sorted(brute(t) for _, t in CASES)


def test_counts_match_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality(docs).collect()}
    assert got == want


def test_rules_are_thresholds(spark):
    text = "the plain words of a text that is fine for all rules " * 1
    df = spark.createDataFrame([(1, text), (2, "### " * 12)], "doc_id long, text string")
    rules = (Rule("n_words", least=5), Rule("symbol_ratio", most=0.1))
    rows = {r.doc_id: r for r in quality(df, rules).collect()}
    assert rows[1].failed == [] and rows[1].base_failed and not rows[1].kept
    assert rows[2].failed == ["symbol_ratio"]


def test_empty_table(spark):
    assert quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0
