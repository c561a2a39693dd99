"""Personal data by candidate gradient boosting.

Generators of high recall propose spans, which may overlap: mail addresses also
with their signs spelled out, dotted quads also with masked dots, long numbers
and telephone-like numbers in any grouping. Boosted trees score every candidate by
its format and its context, and a threshold for each kind selects what is redacted.

The patterns of :data:`BASE` report every span they match, and they label the
candidates: those within a base span are examples of personal data, those apart from
all are not. So that the trees learn more than the patterns know, base spans are
also rewritten, in the place where they stand, in ways that the patterns do not match
(signs spelled out, other separators, no country prefix) and, as counterexamples,
spoilt (a wrong check digit, a part above 255). The trees learn from a bounded
sample; the thresholds come from all candidates of the corpus, each scored by trees
that did not learn from its half of the texts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.boosting import Trees, train
from brindle.llm.common import cut, scratch_folder
from brindle.llm.vectors import pack, unpack

BASE = ("email", "ip", "card", "phone")
#: Kinds of candidates; the spans that the method adds carry these names.
ADDED = ("mail", "host", "number", "tel")
#: Most examples that the trees learn from, by kind and label.
MAX_EXAMPLES = 2000
#: A kind's threshold is the lowest at which this share of the candidates above it are examples.
PRECISION = 0.95
BINS = 200
#: Characters of context on each side.
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats and the look-behind leave the matches as they are, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = re.compile(r"@|\x20?[\[({<]\x20?at\x20?[\])}>]\x20?|\x20at\x20", re.I)
_SPELLED = re.compile(r"[a-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20)[a-z0-9-]{1,63}+)++", re.I)
_MASKED = re.compile(r"(?<![0-9])[0-9]{1,3}+(?:(?:\.|[\[({]\.[\])}]|[\[({]dot[\])}]|\x20dot\x20)[0-9]{1,3}+){3}(?![0-9])", re.I)
_NUMBER = re.compile(r"[0-9](?:[\x20./-]?[0-9])++")
_TEL = re.compile(r"\(?[0-9](?:[\x20()./-]{0,2}[0-9])++")

_WORDS = (
    re.compile(r"\b(?:tel|phone|call|mobile|cell|fax|telefon|anruf|handy|tél|téléphone|appel|teléfono|móvil|llam\w*)\b", re.I),
    re.compile(r"\b(?:e-?mail|mail|contact|write|reach|kontakt|schreib\w*|courriel|écri\w*|correo|contacto)\b", re.I),
    re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta|account|konto|compte|cuenta|iban)\b", re.I),
    re.compile(r"\b(?:ip|host|server|address|login|adresse|rechner|serveur|servidor|dirección)\b", re.I),
    re.compile(r"\b(?:order|invoice|version|release|isbn|issn|page|line|total|price|id|no|nr|item|date|bestellung|rechnung|seite|commande|facture|pedido|factura)\b", re.I),
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    """Whether a number is 255 at most; it may have any number of digits."""
    part = part.lstrip("0") or "0"
    return len(part) < 4 and int(part) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every base span, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _QUAD.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [(2, m.start(), m.end()) for m in _CHAIN.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in _PLUS.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the generators propose, each kind in order."""
    out = []
    for at in _AT.finditer(text):
        domain = _SPELLED.match(text, at.end())
        if domain:
            start = at.start()
            while start > 0 and at.start() - start < 64 and text[start - 1] in _LOCAL:
                start -= 1
            if start < at.start():
                out.append((0, start, domain.end()))
    out += [(1, m.start(), m.end()) for m in _MASKED.finditer(text)]
    out += [(2, m.start(), m.end()) for m in _NUMBER.finditer(text) if m.end() - m.start() <= 40 and 12 <= len(_digits(m[0])) <= 19]
    out += [(3, m.start(), m.end()) for m in _TEL.finditer(text) if m.end() - m.start() <= 40 and 7 <= len(_digits(m[0])) <= 15]
    return out


def _side(text: str) -> int:
    """What a neighbouring character is: none, white space, digit, letter, other."""
    return 0 if not text else 1 if text.isspace() else 2 if text.isdigit() else 3 if text.isalpha() else 4


def features(kind: int, before: str, span: str, after: str) -> list[int]:
    """Format and context of one candidate, each from 0 to 255."""
    digits, groups = _digits(span), re.findall("[0-9]+", span)
    near = before[-CONTEXT:]
    hints = [0 if not (found := list(w.finditer(near))) else CONTEXT + 1 - min(CONTEXT, len(near) - found[-1].end()) for w in _WORDS]
    marks = {c for c in span if not c.isalnum()}
    out = [
        kind,
        len(span),
        len(digits),
        sum(c.isalpha() for c in span),
        len(groups),
        len(groups[0]) if groups else 0,
        len(groups[-1]) if groups else 0,
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(marks),
        span.count("("),
        span.count("-"),
        span.count("."),
        span.count(" "),
        span.count("/"),
        "@" in span,
        bool(re.search(r"[\[({<]\s?(at|dot|\.)\s?[\])}>]", span, re.I)),
        bool(re.search(r"\s(at|dot)\s", span, re.I)),
        len(digits) >= 12 and luhn(digits),
        len(groups) == 4 and all(map(_small, groups)),
        len(set(digits)),
        int(digits[0]) + 1 if digits else 0,
        len(digits) - len(digits.lstrip("0")),
        len(re.split(r"[^A-Za-z]", span)[-1]),
        _side(before[-1:]),
        _side(after[:1]),
        before[-1:] == "+",
        sum(c.isdigit() for c in near[-20:]),
        sum(c.isdigit() for c in after[:20]),
        *hints,
    ]
    return [min(255, int(x)) for x in out]


FEATURES = len(features(0, "", "", ""))


def variants(kind: int, span: str) -> list[tuple[str, int]]:
    """(rewritten span, label) of one base span: forms that the patterns of BASE do
    not match, and spoilt ones."""
    if kind == 0:
        local, _, domain = span.partition("@")
        word = re.match("[A-Za-z]*", local)[0] or "look"
        return [(f"{local} at {domain.replace('.', ' dot ')}", 1), (f"{local}[at]{domain.replace('.', '[dot]')}", 1), (f"{local} (at) {domain}", 1), (f"{word} at {domain}", 0)]
    if kind == 1:
        parts = span.split(".")
        return [("[.]".join(parts), 1), (" dot ".join(parts), 1), (".".join(["999", *parts[1:]]), 0), ("[.]".join([*parts[:3], "600"]), 0)]
    digits = _digits(span)
    if kind == 2:
        fours = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + 3) % 10)
        return [(".".join(fours), 1), ("/".join(fours), 1), (wrong, 0), (".".join(wrong[k : k + 4] for k in range(0, len(wrong), 4)), 0)]
    national = digits[-10:]
    if len(national) < 10:
        return [(f"00{digits}", 1)]
    a, b, c = national[:3], national[3:6], national[6:]
    return [(f"({a}) {b}-{c}", 1), (f"{a}-{b}-{c}", 1), (f"{a}.{b}.{c}", 1), (f"00{digits[:-10]} {a} {b} {c}", 1), (f"{a}/{b}{c}", 1)]


@dataclass
class Scan:
    """What one text holds. ``about`` has kind, label and features of each candidate;
    label 2: neither an example nor none, as it overlaps a base span in part."""

    base: list[tuple[int, int, int]]
    places: np.ndarray
    about: np.ndarray
    rewritten: np.ndarray


def scan_text(text: str, rewrite: bool = True) -> Scan:
    base, found = base_spans(text), candidates(text)
    starts = np.array([s for _, s, _ in sorted(base, key=lambda x: x[1])], np.int64)
    # The furthest end of the base spans that start so early.
    ends = np.maximum.accumulate(np.array([e for _, _, e in sorted(base, key=lambda x: x[1])], np.int64)) if base else starts
    rows, places = [], []
    for kind, s, e in found:
        inside = int(np.searchsorted(starts, s, "right")) - 1
        label = 0
        if inside >= 0 and ends[inside] >= e:
            label = 1
        elif (at := int(np.searchsorted(starts, e, "left")) - 1) >= 0 and ends[at] > s:
            label = 2
        places.append((s, e))
        rows.append([kind, label, *features(kind, text[max(0, s - CONTEXT) : s], text[s:e], text[e : e + CONTEXT])])
    made, seen = [], set()
    for kind, s, e in base if rewrite else ():
        # Each different span is rewritten where it first stands.
        if e - s > 100 or text[s:e] in seen:
            continue
        seen.add(text[s:e])
        before, after = text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]
        for new, label in variants(kind, text[s:e]):
            for k, ns, ne in candidates(before + new + after):
                if (ns, ne) == (len(before), len(before) + len(new)):
                    made.append([k, label, *features(k, before, new, after)])
    table = lambda x: np.array(x, np.uint8).reshape(-1, 2 + FEATURES)
    return Scan(base, np.array(places, np.int32).reshape(-1, 2), table(rows), table(made))


@dataclass
class Model:
    """Trees and a threshold for each kind; a kind without one adds nothing."""

    trees: Trees | None = None
    thresholds: dict[int, float] = field(default_factory=dict)

    def choose(self, scan: Scan) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the added spans: candidates at or above their
        threshold and apart from all base spans; of overlapping ones the best, then
        the first, then the longest."""
        free = np.flatnonzero(scan.about[:, 1] == 0)
        if self.trees is None or not len(free):
            return []
        score, kinds = self.trees.scores(scan.about[free, 2:]), scan.about[free, 0]
        limit = np.array([self.thresholds.get(k, 2.0) for k in range(len(ADDED))])
        good = [(-score[i], int(s), -int(e), int(kinds[i])) for i, (s, e) in enumerate(scan.places[free]) if score[i] >= limit[kinds[i]]]
        taken: list[tuple[int, int, int]] = []
        starts: list[int] = []
        for _, s, e, k in sorted(good):
            # Those taken lie apart, so only the neighbours need a look.
            at = bisect(starts, s)
            if (at and taken[at - 1][1] > s) or (at < len(starts) and starts[at] < -e):
                continue
            starts.insert(at, s)
            taken.insert(at, (s, -e, k))
        taken = [(k, s, e) for s, e, k in taken]
        return sorted(taken)


def _named(spans: Sequence[tuple[int, int, int]], names: Sequence[str]) -> list[str]:
    return [f"{names[k]}:{s}:{e}" for k, s, e in spans]


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


_COUNTS = tuple(f"n_{k}" for k in BASE)


def scan_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, half, key, counts of base spans, base, places, about, rewritten) of every text,
    written once: texts are read in this one pass, all later steps read candidates.

    ``key`` is a hash of the text and ``half`` one bit of it.
    """
    rows = _texts(df, id_col, text_col)
    schema = T.StructType(
        [rows.schema["id"], T.StructField("key", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("base", T.StringType())]
        + [T.StructField(c, T.BinaryType()) for c in ("places", "about", "rewritten")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in schema.names[1:]]
            for value in batch.column(1):
                text = value.as_py()
                scan = scan_text(text)
                kinds = [k for k, _, _ in scan.base]
                packed = [pack(x) if len(x) else None for x in (scan.places, scan.about, scan.rewritten)]
                key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                for column, x in zip(columns, [key, *(kinds.count(k) for k in range(len(BASE))), ",".join(_named(scan.base, BASE)), *packed], strict=True):
                    column.append(x)
            kinds = [pa.binary(), *[pa.int64()] * len(BASE), pa.string(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], schema.names)

    path = scratch_folder(df.sparkSession, "candidates") + "/scanned"
    rows.mapInArrow(run, schema).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _tables(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    """(key, candidates and rewritten spans) of each text that has any."""
    for key, about, rewritten in zip(batch.column("key"), batch.column("about"), batch.column("rewritten"), strict=True):
        own = [unpack(x.as_py()) for x in (about, rewritten) if x.is_valid]
        if own:
            yield key.as_py(), np.concatenate(own)


def _examples(scanned: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` examples of each kind and label, those of least hash, and the half
    of the texts that each is from. Copies of a text give an example once."""
    schema = "key binary, kind int, label int, half int, row binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for key, table in _tables(batch):
                for k in np.flatnonzero(table[:, 1] < 2):
                    row = (hashlib.blake2b(key + int(k).to_bytes(8, "little"), digest_size=8).digest(), int(table[k, 0]), int(table[k, 1]), key[0] & 1, table[k].tobytes())
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["key", "kind", "label", "half", "row"])

    found = cut(scanned.select("key", "about", "rewritten").where("about is not null or rewritten is not null").mapInArrow(run, schema).dropDuplicates(["key"]))
    picked = [found.where((F.col("kind") == k) & (F.col("label") == label)).orderBy("key").limit(most) for k in range(len(ADDED)) for label in (0, 1)]
    got = reduce(DataFrame.union, picked).select("half", "row").toArrow()
    rows = np.frombuffer(b"".join(got["row"].to_pylist()), np.uint8).reshape(-1, 2 + FEATURES)
    return rows, got["half"].to_numpy().astype(np.int64)


def cuts(counts: np.ndarray, precision: float = PRECISION) -> dict[int, float]:
    """The threshold of each kind from ``counts`` (kinds, bins, labels): the lowest
    bin above which ``precision`` of the candidates are examples, moved down to the
    middle of the empty bins below it."""
    out = {}
    for kind, own in enumerate(counts):
        above = np.cumsum(own[::-1], axis=0)[::-1]
        good = np.flatnonzero((own[:, 1] > 0) & (above[:, 1] >= precision * above.sum(axis=1)))
        if len(good):
            used = np.flatnonzero(own[: good[0]].sum(axis=1))
            out[kind] = (int(good[0]) + (int(used[-1]) + 1 if len(used) else 0)) / 2 / BINS
    return out


def fit(scanned: DataFrame, max_examples: int = MAX_EXAMPLES, precision: float = PRECISION) -> Model:
    """Trees from a bounded sample and thresholds from all candidates of ``scanned``.

    Halves of the texts are scored by trees that learnt from the other half. Where
    a half has no example of both labels, as in small or empty tables, there is no
    model and nothing is added to the base spans.
    """
    rows, half = _examples(scanned, max_examples)
    if any(len(set(rows[half == h, 1].tolist())) < 2 for h in (0, 1)):
        return Model()
    judges = [train(rows[half != h, 2:], rows[half != h, 1]) for h in (0, 1)]
    shared = scanned.sparkSession.sparkContext.broadcast(judges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ADDED), BINS, 2), np.int64)
        for batch in batches:
            tables: tuple[list, list] = ([], [])
            for key, table in _tables(batch):
                tables[key[0] & 1].append(table[table[:, 1] < 2])
            for own, judge in zip(tables, shared.value, strict=True):
                if own:
                    table = np.concatenate(own)
                    bins = np.minimum((judge.scores(table[:, 2:]) * BINS).astype(np.int64), BINS - 1)
                    np.add.at(counts, (table[:, 0], bins, table[:, 1]), 1)
        used = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in used), pa.array(counts[used])], ["kind", "bin", "label", "n"])

    counts = np.zeros((len(ADDED), BINS, 2), np.int64)
    binned = scanned.select("key", "about", "rewritten").mapInArrow(run, "kind int, bin int, label int, n long")
    for r in binned.groupBy("kind", "bin", "label").agg(F.sum("n").alias("n")).collect():
        counts[r.kind, r.bin, r.label] = r.n
    return Model(train(rows[:, 2:], rows[:, 1]), cuts(counts, precision))


def select_spans(scanned: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, counts of base spans, base_spans, spans, n_added), one row a text.

    Spans are ``kind:start:end``, comma-joined, by kind (base kinds first) and start.
    """
    kept = scanned.select("id", *_COUNTS, "base", "places", "about")
    schema = T.StructType([T.StructField(id_col, kept.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])
    shared = scanned.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, added = [], []
            for base, places, about in zip(batch.column("base").to_pylist(), batch.column("places"), batch.column("about"), strict=True):
                chosen = shared.value.choose(Scan([], unpack(places.as_py()), unpack(about.as_py()), None)) if about.is_valid else []
                spans.append(",".join([base, *_named(chosen, ADDED)] if base else _named(chosen, ADDED)))
                added.append(len(chosen))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(spans, pa.string()), pa.array(added, pa.int64())], schema.names)

    return kept.mapInArrow(run, schema)


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """:func:`select_spans` of ``df`` by a model of its own candidates.

    One row per row, repeated rows and null ids included; a null text counts as an
    empty one and has no spans; an empty table gives no rows. Other columns are
    not read, whatever their names. Texts of any length are searched whole, in
    linear time; equal texts get equal spans. Of touching candidates with equal
    scores the first counts, then the longest.
    """
    scanned = scan_corpus(df, id_col, text_col)
    return select_spans(scanned, fit(scanned, **settings), id_col)


def redact(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with every span of its texts replaced by its kind in brackets, such as
    ``[EMAIL]``; where spans overlap, the first stands for all. Null texts stay null.
    Nothing is shuffled and other columns are unchanged."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        scan = scan_text(text, rewrite=False)
        names = (*BASE, *ADDED)
        spans = sorted((s, -e, k) for k, s, e in [*scan.base, *((k + len(BASE), s, e) for k, s, e in shared.value.choose(scan))])
        out, last = [], 0
        for s, e, k in spans:
            if s >= last:
                out += [text[last:s], f"[{names[k].upper()}]"]
            last = max(last, -e)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(x.as_py()) for x in columns[at]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema.set(at, pa.field(text_col, pa.string())))

    return df.mapInArrow(run, T.StructType([T.StructField(text_col, T.StringType()) if i == at else f for i, f in enumerate(df.schema.fields)]))
