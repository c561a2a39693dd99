import random
import re
import time
from collections import defaultdict

from brindle.llm.line_templates import drop_recurring_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, min_docs, fixed, depth=3, least=4):
    """{text: (n_lines, n_dropped, text left)} with plain dictionaries."""
    digit = lambda w: bool(re.search(r"[0-9]", w))
    lines = {}
    for text in {t for t in texts if t is not None}:
        for k, raw in enumerate(text.split("\n")):
            w = WORD.findall(raw)
            if len(w) >= least:
                lines[text, k] = w
    leaf = {x: (len(w), tuple("<*>" if digit(v) else v for v in w[:depth])) for x, w in lines.items()}
    docs = defaultdict(set)
    for x, key in leaf.items():
        docs[key].add(x[0])
    lines = {x: w for x, w in lines.items() if len(docs[leaf[x]]) >= min_docs}
    count = defaultdict(int)
    for x, w in lines.items():
        for k, v in enumerate(w):
            count[leaf[x], k, v] += 1
    template, wide = {}, defaultdict(set)
    for x, w in lines.items():
        parts = tuple(v if not digit(v) and (k < depth or count[leaf[x], k, v] >= min_docs) else None for k, v in enumerate(w))
        if sum(p is not None for p in parts) >= fixed * len(parts):
            template[x] = (leaf[x], parts)
            wide[template[x]].add(x[0])
    gone = {x for x, t in template.items() if len(wide[t]) >= min_docs}
    out = {None: (0, 0, None)}
    for text in texts:
        if text is not None:
            own = text.split("\n")
            left = [raw for k, raw in enumerate(own) if (text, k) not in gone]
            out[text] = (sum(bool(WORD.search(raw)) for raw in own), len(own) - len(left), "\n".join(left))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice([f"v{chr(97 + k)}" for k in range(26)])
    texts = []
    for k in range(60):
        own = [" ".join(word() for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(0, 6))]
        if k % 3 == 0:
            own.insert(0, f"User {rng.randrange(99)} logged in from host{rng.randrange(9)} today")
        if k % 4 == 0:
            own.append(f"All rights reserved by {word()} and the other owners")
        own.insert(len(own) // 2, "")
        texts.append("\n".join(own))
    return texts + texts[:5]


def test_matches_brute_force(spark):
    for seed, min_docs in ((1, 4), (2, 8)):
        texts = corpus(seed)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        want = brute(texts, min_docs, 0.6)
        got = drop_recurring_lines(df, min_docs=min_docs).collect()
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == {k: want[t] for k, t in enumerate(texts)}
        assert sum(r.n_dropped for r in got) >= 20


def test_copies_of_one_text_are_no_recurrence(spark):
    text = "a line of some words\nanother line of words here"
    df = spark.createDataFrame([(k, text) for k in range(50)], "doc_id long, text string")
    assert {(r.n_dropped, r.text) for r in drop_recurring_lines(df).collect()} == {(0, text)}


def test_edges(spark):
    line = "the same line of text is here"
    rows = [(k, f"{line}\nown{'x' * k} words of this one text\n\n", "c") for k in range(9)]
    rows += [(None, line, None), (50, None, "c"), (51, "", "c"), (51, "", "c"), (52, f"{line}\n" * 5000, "c"), (0, f"{line}\nown words of this one text\n\n", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    got = drop_recurring_lines(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[None].text == "" and by[None].n_dropped == 1
    assert by[50].text is None and by[51].text == "" and by[51].n_lines == 0
    assert by[52].n_dropped == 5000 and by[52].n_lines == 5000
    assert by[3].text == "ownxxx words of this one text\n\n" and by[3].n_dropped == 1
    assert drop_recurring_lines(df.limit(0)).count() == 0


def test_short_lines_go_where_the_caller_says_so(spark):
    df = spark.createDataFrame([(k, " ".join(chr(97 + k) * n for n in range(2, 9)) + "\nRead more\n") for k in range(9)], "doc_id long, text string")
    assert {r.n_dropped for r in drop_recurring_lines(df).collect()} == {0}
    got = drop_recurring_lines(df, least_words=2).collect()
    assert all("Read more" not in r.text and r.n_dropped == 1 for r in got)


def test_a_text_of_very_many_dropped_lines(spark):
    """Dropping takes time in proportion to the lines, not to their square."""
    n = 60_000
    long = "\n".join(f"alpha beta gamma delta {k}" if k % 2 else f"own{k} line of this text alone x{k}q" for k in range(n))
    rows = [(0, long)] + [(k, f"{'abcdefghi'[k] * 3} begins a short text\nalpha beta gamma delta {k}") for k in range(1, 9)]
    start = time.monotonic()
    got = {r.doc_id: r for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.monotonic() - start < 120
    assert got[0].n_dropped == n // 2 and got[0].text == "\n".join(long.split("\n")[::2])
    assert all(got[k].text == f"{'abcdefghi'[k] * 3} begins a short text" for k in range(1, 9))
