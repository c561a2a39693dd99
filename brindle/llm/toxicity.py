"""Toxicity: a small convolutional text classifier, trained here with numpy.

Words are hashed (no vocabulary). A word's vector is the sum of three hashed
embeddings: two independent hashes of the word and one of its first letters, so
one unlucky collision alone does not decide. Only hashes that occur in the training
sample have a row; any other word adds nothing. Filters of several widths slide
over the whole text, each filter keeps its largest response (max pooling), and
a logistic layer turns these into a score.

Training uses a bounded sample of labelled rows on the driver; scoring runs in
Arrow tasks over whole texts of any length, piece by piece. The thresholds come
from counts of all labelled rows by language and score, at their own label mix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import cut, settled, trim
from brindle.llm.tokens import LETTERS, hashed_words

WORD_BITS, PREFIX_BITS, PREFIX_BYTES = 18, 15, 5
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Most labelled rows that training takes, by label.
MAX_POSITIVE, MAX_NEGATIVE = 2000, 3000
#: Most bytes of their hashed words (12 a word) that training takes, by label.
MAX_BYTES = 96 << 20
#: Most labelled ids that are broadcast to the texts.
MAX_BROADCAST_IDS = 1_000_000
#: Batches that a model learns.
STEPS = 825
#: Rows with this remainder of crc32(doc_id as text) modulo 4 are never learnt from.
HELD_OUT = 2
#: Sampled rows are scored for calibration by a model that learnt from the other folds.
FOLDS = 2
#: Calibration counts rows by so many score bins per unit of log-odds, up to these odds.
BINS, MOST = 32, 24
#: A language's counts are blended with those of all languages, worth so many toxic rows.
SHRINK = 20
#: The cut of ``predicted``.
CUT = 0.3
#: Above every score.
NEVER = 2.0
SCORE = "toxicity_score"


def held_out(id_col: str) -> Column:
    """A null id counts as the empty text, which is not held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words of each row, features (3, words)) of parts of a column."""
    low, high = np.uint64((1 << WORD_BITS) - 1), np.uint64(64 - WORD_BITS)
    for part in hashed_words(column, LETTERS, PREFIX_BYTES):
        words = np.empty((3, len(part.hashes)), np.int32)
        words[0] = (part.hashes & low).astype(np.int32)
        words[1] = (part.hashes >> high).astype(np.int32)
        words[2] = (part.prefixes & np.uint64((1 << PREFIX_BITS) - 1)).astype(np.int32)
        yield part.first, part.counts, words


_BITS = (WORD_BITS, WORD_BITS, PREFIX_BITS)


@dataclass
class Model:
    #: For each of the three features, the hashes that have a row, ascending.
    known: list[np.ndarray]
    #: Their rows, from 1 on; row 0, of all other hashes, is 0.
    tables: list[np.ndarray]
    #: For each width, (width, DIM, FILTERS).
    filters: list[np.ndarray]
    bias: np.ndarray
    output: np.ndarray
    intercept: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = CUT

    @cached_property
    def places(self) -> list[np.ndarray]:
        """Of each feature, the row of every hash."""
        out = []
        for bits, known in zip(_BITS, self.known, strict=True):
            place = np.zeros(1 << bits, np.int32)
            place[known] = np.arange(1, len(known) + 1)
            out.append(place)
        return out

    #: The vectors of all hashes, to look at single words.
    word_1 = cached_property(lambda self: self.tables[0][self.places[0]])
    word_2 = cached_property(lambda self: self.tables[1][self.places[1]])
    prefix = cached_property(lambda self: self.tables[2][self.places[2]])

    def __getstate__(self) -> dict:
        # What follows from the rest need not travel.
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}

    def rows(self, words: np.ndarray) -> np.ndarray:
        """(3, words) table rows of features (3, words)."""
        return np.stack([place[w] for place, w in zip(self.places, words, strict=True)])

    def vectors(self, words: np.ndarray) -> np.ndarray:
        a, b, c = self.rows(words)
        return self.tables[0][a] + self.tables[1][b] + self.tables[2][c]

    def responses(self, x: np.ndarray, width: int) -> np.ndarray:
        """Filter outputs at every place; the text is padded by zeros."""
        out = np.zeros((len(x), FILTERS), np.float32)
        for k, w in enumerate(self.filters[WIDTHS.index(width)]):
            out[: len(x) - k] += x[k:] @ w
        return out

    def pooled(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(texts, filters) largest responses; 0 for a text without words."""
        most = np.zeros((len(counts), len(WIDTHS) * FILTERS), np.float32)
        if not words.shape[1]:
            return most
        x = self.vectors(words)
        full = np.flatnonzero(counts)
        ends = np.cumsum(counts)
        starts = (ends - counts)[full]
        for i, width in enumerate(WIDTHS):
            z = np.zeros((len(x), FILTERS), np.float32)
            for k, w in enumerate(self.filters[i]):
                y = x @ w
                if k:
                    # A filter does not reach into the next text.
                    for back in range(1, k + 1):
                        gone = ends[full] - back + k
                        y[gone[(gone < len(y)) & (gone >= 0)]] = 0
                    z[:-k] += y[k:]
                else:
                    z += y
            most[full, i * FILTERS : (i + 1) * FILTERS] = np.maximum.reduceat(z, starts, axis=0)
        return np.maximum(most + self.bias * (counts > 0)[:, None], 0)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for first, counts, words in features(column):
            logit = self.pooled(words, counts).astype(np.float64) @ self.output + self.intercept
            out[first : first + len(counts)] = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        return out


def _start(rng: np.random.Generator, texts: Sequence[np.ndarray] = ()) -> Model:
    normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    known, tables = [], []
    for k, bits in enumerate(_BITS):
        seen = np.zeros(1 << bits, bool)
        for words in texts:
            seen[words[k]] = True
        known.append(np.flatnonzero(seen).astype(np.int32))
        tables.append(np.concatenate([np.zeros((1, DIM), np.float32), normal(len(known[k]), DIM)]))
    filters = [normal(w, DIM, FILTERS) * 3 for w in WIDTHS]
    n = len(WIDTHS) * FILTERS
    return Model(known, tables, filters, np.zeros(n, np.float32), np.abs(normal(n)) * 10)


class _Adagrad:
    """Steps scaled by what each number has moved so far; rows of a table alone."""

    def __init__(self, rate: float) -> None:
        self.rate, self.past = rate, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        past = self.past.setdefault(name, np.full(value.shape, 1e-4, np.float32))
        if rows is None:
            past += grad**2
            value -= self.rate * grad / np.sqrt(past)
            return
        own, place = np.unique(rows, return_inverse=True)
        total = np.zeros((len(own), value.shape[1]), np.float32)
        np.add.at(total, place, grad)
        past[own] += total**2
        value[own] -= self.rate * total / np.sqrt(past[own])


def train(texts: list[np.ndarray], toxic: np.ndarray, steps: int = STEPS, batch: int = 32, rate: float = 0.08, seed: int = 7) -> Model:
    """``texts``: features (3, words) of each row; ``toxic``: 0 or 1 of each.

    The rows are gone through until ``steps`` batches are learnt, so a small
    sample is seen more often.
    """
    rng = np.random.default_rng(seed)
    model, adagrad = _start(rng, texts), _Adagrad(rate)
    n_positive = max(1, int(toxic.sum()))
    weight = np.where(toxic == 1, (len(toxic) - n_positive) / n_positive, 1.0).astype(np.float32)
    for _ in range(max(1, round(steps * batch / len(texts)))):
        order = rng.permutation(len(texts))
        for first in range(0, len(order), batch):
            rows = order[first : first + batch]
            pooled = np.zeros((len(rows), len(model.bias)), np.float32)
            vectors = [model.vectors(texts[r]) for r in rows]
            best = np.zeros(pooled.shape, np.int64)
            for i, x in enumerate(vectors):
                if len(x):
                    z = np.concatenate([model.responses(x, w) for w in WIDTHS], axis=1)
                    best[i] = z.argmax(axis=0)
                    pooled[i] = z[best[i], np.arange(z.shape[1])] + model.bias
            active = pooled > 0
            pooled *= active
            logit = pooled @ model.output + model.intercept
            error = (1 / (1 + np.exp(-logit)) - toxic[rows]) * weight[rows] / len(rows)
            back = error[:, None] * model.output * active
            words, grads = [], []
            filter_grads = [np.zeros_like(f) for f in model.filters]
            for i, x in enumerate(vectors):
                if not len(x):
                    continue
                for j in np.flatnonzero(back[i]):
                    width, f = divmod(int(j), FILTERS)
                    at = best[i, j]
                    for k in range(min(WIDTHS[width], len(x) - at)):
                        filter_grads[width][k, :, f] += back[i, j] * x[at + k]
                        words.append(texts[rows[i]][:, at + k])
                        grads.append(back[i, j] * model.filters[width][k, :, f])
            adagrad.step("output", model.output, pooled.T @ error)
            intercept = np.array([model.intercept], np.float32)
            adagrad.step("intercept", intercept, np.array([error.sum()], np.float32))
            model.intercept = float(intercept[0])
            adagrad.step("bias", model.bias, back.sum(axis=0))
            for k, grad in enumerate(filter_grads):
                adagrad.step(f"filter{k}", model.filters[k], grad)
            if words:
                at, grad = model.rows(np.array(words).T), np.array(grads, np.float32)
                for k, table in enumerate(model.tables):
                    adagrad.step(f"table{k}", table, grad, at[k])
    return model


def best_threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """The cut of best F1, midway in the widest gap among the best cuts."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())
    last = len(f1) - 1 - int(np.argmax(f1[::-1]))
    below = score[order[last + 1]] if last + 1 < len(order) else 0.0
    return float((score[order[last]] + below) / 2)


def _bins(score: np.ndarray) -> np.ndarray:
    """The bin of each score, from 0; :func:`_bin` as a column."""
    p = np.clip(score, 1e-15, 1 - 1e-15)
    return np.clip(np.floor(np.log(p / (1 - p)) * BINS), -MOST * BINS, MOST * BINS - 1).astype(np.int64) + MOST * BINS


def _bin(score: Column) -> Column:
    p = F.least(F.greatest(score, F.lit(1e-15)), F.lit(1 - 1e-15))
    at = F.floor(F.log(p / (1 - p)) * BINS).cast("int")
    return F.least(F.greatest(at, F.lit(-MOST * BINS)), F.lit(MOST * BINS - 1)) + MOST * BINS


def counted_threshold(counts: np.ndarray) -> float:
    """:func:`best_threshold` of ``counts`` (bins, 2): clean and toxic rows by score bin."""
    used = np.flatnonzero(counts.sum(axis=1))[::-1]
    hits = np.cumsum(counts[used, 1])
    f1 = 2 * hits / (np.cumsum(counts[used].sum(axis=1)) + hits[-1])
    last = len(f1) - 1 - int(np.argmax(f1[::-1]))
    edge = lambda at: 1 / (1 + np.exp(MOST - at / BINS))
    below = edge(used[last + 1] + 1) if last + 1 < len(used) else 0.0
    return float((edge(used[last]) + below) / 2)


def calibrate(model: Model, counts: dict[str | None, np.ndarray]) -> None:
    """Set the thresholds from each language's counts (bins, 2); null: no language.

    A language of few toxic rows leans on the counts of all; the more it has,
    the less it does. Without a toxic row the cut stays ``CUT``.
    """
    common = sum(counts.values(), np.zeros((2 * MOST * BINS, 2)))
    if not common[:, 1].any():
        return
    model.threshold = counted_threshold(common)
    model.thresholds = {name: counted_threshold(own + SHRINK / common[:, 1].sum() * common) for name, own in counts.items() if name is not None}


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in settled(batches):
        words = [None] * batch.num_rows
        for first, counts, part in features(batch.column(0)):
            ends = np.cumsum(counts)
            for k, (end, n) in enumerate(zip(ends, counts, strict=True)):
                words[first + k] = part[:, end - n : end].tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns[1:5], pa.array(words, pa.binary())], ["toxic", "part", "lang", "__id", "words"])


def _views(words: pa.ChunkedArray, order: np.ndarray) -> list[np.ndarray]:
    """The features of each row in ``order``, without copying the column."""
    found = [np.frombuffer(x.as_buffer(), np.int32).reshape(3, -1) for chunk in words.chunks for x in chunk]
    return [found[k] for k in order]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, max_bytes: int = MAX_BYTES) -> Model:
    """Train on up to ``max_positive + max_negative`` labelled rows.

    The rows are those of least hash among the labelled ids that are not held
    out, so the sample is the same at every run; of each label they take up to
    ``max_bytes`` of hashed words, and one whole text at least. An id counts once:
    toxic if one of its labels is, with the least of its texts. The thresholds by language
    come from all labelled rows that are not held out: sampled rows are scored
    by models that did not learn from them, the others by the model itself, in
    Spark. The language is not a feature. Rows with a null label or id are left
    out; null and empty texts count as texts without words. Without labelled rows
    of both labels, as in empty tables, every score is 0.5 and nothing is rejected.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("__id").isNotNull() & ~held_out("__id"))
    known = known.groupBy("__id").agg(F.max("toxic").alias("toxic")).withColumn("__rank", F.xxhash64("__id"))
    picked = [known.where(F.col("toxic") == k).orderBy("__rank", "__id").limit(n) for k, n in ((1, max_positive), (0, max_negative))]
    n_known, n_toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    share = n_toxic / n_known if n_toxic else 0.1
    sample = picked[0].unionByName(picked[1]).select("__id", "toxic", F.pmod("__rank", F.lit(FOLDS)).cast("int").alias("part"))
    # The sample is bounded, so it is what is broadcast.
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = own.join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy("__id", "toxic", "part").agg(F.min(F.struct("text", "lang")).alias("row")).select("row.text", "toxic", "part", "row.lang", "__id")
    schema = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("__id", rows.schema["__id"].dataType), T.StructField("words", T.BinaryType())])
    featured = cut(rows.mapInArrow(_featurise, schema))
    fitting, taken = [], {0: 0, 1: 0}
    for r in featured.select("__id", "toxic", F.octet_length("words").alias("n")).orderBy(F.xxhash64("__id"), "__id").collect():
        if not taken[r.toxic] or taken[r.toxic] + r.n <= max_bytes:
            taken[r.toxic] += r.n
            fitting.append(r["__id"])
    # From Arrow: a list of rows would start further Python workers, which stay for a while.
    chosen = spark.createDataFrame(pa.table({"__id": pa.array(fitting)}), T.StructType([T.StructField("__id", rows.schema["__id"].dataType)]))
    # As Arrow: the texts are views of one buffer, not a copy and an object each.
    got = featured.join(F.broadcast(chosen), "__id", "left_semi").select("toxic", "part", "lang", "words").toArrow().combine_chunks()
    trim()
    order = pc.sort_indices(got, sort_keys=[("words", "ascending"), ("toxic", "ascending")]).to_numpy()
    texts = _views(got["words"], order)
    toxic, part = (got[c].to_numpy().astype(np.int64)[order] for c in ("toxic", "part"))
    langs = got["lang"].to_pylist()
    if len(set(toxic.tolist())) < 2:
        model = _start(np.random.default_rng(7))
        model.output[:] = 0
        model.threshold = NEVER
        return model
    # Training weighs both labels alike; move the odds to those of all labels.
    share = min(max(share, 1e-4), 1 - 1e-4)
    odds = float(np.log(share / (1 - share)))
    model = train(texts, toxic)
    model.intercept += odds
    counts: dict[str | None, np.ndarray] = {}
    for fold in range(FOLDS):
        rest, held = np.flatnonzero(part != fold), np.flatnonzero(part == fold)
        judge = model
        # Rows too few for folds are scored by the model itself.
        if len(held) and len(set(toxic[rest].tolist())) == 2:
            judge = train([texts[k] for k in rest], toxic[rest], max(1, STEPS * len(rest) // len(texts)))
            judge.intercept += odds
        for k in held:
            logit = judge.pooled(texts[k], np.array([texts[k].shape[1]])).astype(np.float64) @ judge.output + judge.intercept
            at = _bins(1 / (1 + np.exp(-np.clip(logit, -500, 500))))[0]
            counts.setdefault(langs[order[k]], np.zeros((2 * MOST * BINS, 2)))[at, toxic[k]] += 1
    if n_known > len(texts):
        # Only labelled texts are scored, where they are; ids, languages and bins are shuffled.
        others = cut(known.join(F.broadcast(chosen), "__id", "left_anti").select("__id", "toxic"))
        few = n_known <= MAX_BROADCAST_IDS
        labelled = own.join(F.broadcast(others), F.col("doc_id") == F.col("__id")) if few else own
        kept = ["lang", "toxic"] if few else ["doc_id", "lang"]
        binned = score(labelled, model, keep=kept).select(*kept, _bin(F.col(SCORE)).alias("bin"))
        binned = binned if few else binned.join(others, F.col("doc_id") == F.col("__id"))
        for r in binned.groupBy("lang", "bin", "toxic").agg(F.count("*").alias("n")).collect():
            counts.setdefault(r.lang, np.zeros((2 * MOST * BINS, 2)))[r.bin, r.toxic] += r.n
    calibrate(model, counts)
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] | None = None, score_col: str = SCORE) -> DataFrame:
    """``keep`` (all columns of ``df``, unless given) with ``score_col``, which
    replaces a column of that name.

    A null or empty text has no words; its score is that of the intercept. Texts
    of any length are read whole, piece by piece.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != score_col]
    read = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("string").alias("__brindle_text"))
    # What a fit brought to the driver is free by now; Arrow and the C library would keep it.
    trim()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in settled(batches):
            found = own.scores(batch.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, pa.float64())], [*kept, score_col])

    return read.mapInArrow(run, T.StructType([*read.schema.fields[:-1], T.StructField(score_col, T.DoubleType())]))


def threshold(model: Model, lang_col: str = "lang") -> Column:
    """The calibrated threshold of each row's language."""
    if not model.thresholds:
        return F.lit(model.threshold)
    cuts = F.create_map(*(F.lit(x) for cut in model.thresholds.items() for x in cut))
    return F.coalesce(F.try_element_at(cuts, F.col(lang_col).cast("string")), F.lit(model.threshold))


def reject_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", **columns: str) -> DataFrame:
    """``docs`` without the rows whose score reaches their language's threshold.

    Its columns are unchanged, whatever their names. Every row is judged by its
    own text, so rows of one text and language stay or go together, those with a
    null id too; null and empty texts stay unless the intercept alone reaches the
    threshold. An empty table stays empty, and without labels every row stays.
    """
    model = fit(docs, labels, text_col=text_col, lang_col=lang_col, **columns)
    name = "__brindle_score"
    return score(docs, model, text_col, score_col=name).where(F.col(name) < threshold(model, lang_col)).select(*(F.col(f"`{c}`") for c in docs.columns))
