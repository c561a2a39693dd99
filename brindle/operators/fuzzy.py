"""Fuzzy inference: fuzzify, min/max rules, defuzzify.

Two forms with equal results. The wide form writes degrees and rules as
expressions of one row: no join, no shuffle. The long form reads sets and rules
from tables, for rule bases that are data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.shapes import SHAPES, Shape

#: Most rows of a set table; more are an error.
MAX_SETS = 100_000
#: Most rules that are read to plan by; more are joined, with the same result.
MAX_DRIVER_RULES = 200
#: Most rules that are broadcast as one value.
MAX_VALUE_RULES = 10_000


@dataclass(frozen=True)
class LinguisticSet:
    name: str
    shape: Shape


@dataclass
class Domain:
    """An ordered list of named sets over one number."""

    name: str
    sets: list[LinguisticSet] = field(default_factory=list)

    def add(self, name: str, kind: str, *points: float) -> Domain:
        self.sets.append(LinguisticSet(name, Shape(kind, tuple(map(float, points)))))
        return self

    def __len__(self) -> int:
        return len(self.sets)

    @property
    def names(self) -> list[str]:
        return [s.name for s in self.sets]

    def find(self, name: str) -> LinguisticSet:
        """The first set of that name; an unknown name is an error here, before any job."""
        for s in self.sets:
            if s.name == name:
                return s
        raise KeyError(f"{self.name} has no set {name}")

    def degree(self, x: Column, name: str) -> Column:
        """The degree of a set by name; an unknown name has degree 0."""
        if name not in self.names:
            return F.when(x.isNotNull(), F.lit(0.0))
        return self.find(name).shape.degree(x)

    def degrees(self, x: Column) -> Column:
        """Map from set to degree; of equal names the first counts."""
        first = dict(reversed([(s.name, s) for s in self.sets]))
        return F.create_map(*(c for s in first.values() for c in (F.lit(s.name), s.shape.degree(x))))


@dataclass(frozen=True)
class FuzzyRule:
    """If ``domain_1`` is ``set_1`` and ``domain_2`` is ``set_2`` then the output is ``out_set``."""

    domain_1: str
    set_1: str
    domain_2: str
    set_2: str
    out_set: str


def column_of(domain: str, name: str) -> str:
    return f"{domain}__{name}"


def fuzzify(df: DataFrame, inputs: dict[str, Domain], columns: dict[str, str]) -> DataFrame:
    """One column ``<domain>__<set>`` per set; ``columns``: the input of each domain."""
    return df.withColumns({column_of(d, s.name): s.shape.degree(F.col(columns[d])) for d, domain in inputs.items() for s in domain.sets})


def fuzzify_long(df: DataFrame, inputs: dict[str, Domain], columns: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """``keep``, domain, set_name, position, degree: one row per row and set.

    One pass over ``df`` for all domains.
    """
    each = F.array(
        *(
            F.struct(F.lit(d).alias("domain"), F.lit(s.name).alias("set_name"), F.lit(k).cast("bigint").alias("position"), s.shape.degree(F.col(columns[d])).alias("degree"))
            for d, domain in inputs.items()
            for k, s in enumerate(domain.sets)
        )
    )
    return df.select(*keep, F.explode(each).alias("__e")).select(*keep, "__e.*")


def set_degree(degrees: Column, name: str, value: Column) -> Column:
    """A degree map with one degree replaced; an unknown name changes nothing."""
    return F.transform_values(degrees, lambda k, v: F.when(k == name, value).otherwise(v))


def cleared(degrees: Column) -> Column:
    return F.transform_values(degrees, lambda k, v: F.lit(0.0))


def infer(df: DataFrame, inputs: dict[str, Domain], output: Domain, rules: Sequence[FuzzyRule]) -> DataFrame:
    """One column ``<output>__<set>`` per output set: the largest strength of its
    rules, where a rule's strength is the lesser of its two degrees; 0 without rules.

    A null degree makes the strength null, and a null strength raises no other.
    """
    strengths: dict[str, list[Column]] = {s.name: [F.lit(0.0)] for s in output.sets}
    for rule in rules:
        for domain, name in ((rule.domain_1, rule.set_1), (rule.domain_2, rule.set_2)):
            inputs[domain].find(name)
        output.find(rule.out_set)
        a, b = F.col(column_of(rule.domain_1, rule.set_1)), F.col(column_of(rule.domain_2, rule.set_2))
        strengths[rule.out_set].append(F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)))
    return df.withColumns({column_of(output.name, name): F.greatest(*cols, F.lit(0.0)) for name, cols in strengths.items()})


def defuzzify(output: Domain, normalize: bool = False) -> Column:
    """Sum of typical value times degree; ``normalize`` divides by the sum of degrees."""
    degrees = [F.col(column_of(output.name, s.name)) for s in output.sets]
    value = sum((F.lit(s.shape.typical) * d for s, d in zip(output.sets[1:], degrees[1:], strict=True)), F.lit(output.sets[0].shape.typical) * degrees[0])
    if not normalize:
        return value
    return value / F.nullif(sum(degrees[1:], degrees[0]), F.lit(0.0))


def power(df: DataFrame, inputs: dict[str, Domain], columns: dict[str, str], output: Domain, rules: Sequence[FuzzyRule], name: str, normalize: bool = False) -> DataFrame:
    """The whole chain in the wide form: ``df`` with ``name``."""
    done = infer(fuzzify(df, inputs, columns), inputs, output, rules).withColumn(name, defuzzify(output, normalize))
    return done.select(*(c for c in df.columns if c != name), name)


def set_table(spark: SparkSession, domains: Sequence[Domain]) -> DataFrame:
    """(domain, position, set_name, shape, points, typical): domains as data."""
    rows = [(d.name, k, s.name, s.shape.kind, list(s.shape.points), s.shape.typical) for d in domains for k, s in enumerate(d.sets)]
    return spark.createDataFrame(rows, "domain string, position int, set_name string, shape string, points array<double>, typical double")


def domains_from(table: DataFrame) -> dict[str, Domain]:
    """The domains of a set table, which is read to the driver: a rule base's size.
    One of more than ``MAX_SETS`` rows is an error."""
    rows = table.orderBy("domain", "position").limit(MAX_SETS + 1).collect()
    if len(rows) > MAX_SETS:
        raise ValueError(f"a set table has at most {MAX_SETS} rows")
    out: dict[str, Domain] = {}
    for r in rows:
        out.setdefault(r.domain, Domain(r.domain)).add(r.set_name, r["shape"], *r.points[: SHAPES[r["shape"]].n_points])
    return out


def rule_table(spark: SparkSession, rules: Sequence[FuzzyRule]) -> DataFrame:
    rows = [(r.domain_1, r.set_1, r.domain_2, r.set_2, r.out_set) for r in rules]
    return spark.createDataFrame(rows, "domain_1 string, set_1 string, domain_2 string, set_2 string, out_set string")


def _known_outputs(rules: DataFrame, output: Domain) -> DataFrame:
    """The distinct rules; one with an unknown output set is an error before any result."""
    unknown = rules.select("out_set").where(~F.col("out_set").isin(output.names) | F.col("out_set").isNull()).first()
    if unknown is not None:
        raise KeyError(f"{output.name} has no set {unknown.out_set}")
    return rules.distinct()


def infer_table(df: DataFrame, inputs: dict[str, Domain], columns: dict[str, str], output: Domain, rules: DataFrame, name: str, normalize: bool = False) -> DataFrame:
    """``df`` with ``name`` by a rule table, row by row: no row is shuffled.

    Up to ``MAX_DRIVER_RULES`` rules are read to plan the wide form, which runs in
    generated code. More, up to ``MAX_VALUE_RULES``, are one value that every task
    gets, with degrees as a map of the row. A set that no domain has counts as
    null; results and errors are the same.
    """
    n = rules.count()
    if n <= MAX_DRIVER_RULES:
        parsed = [FuzzyRule(r.domain_1, r.set_1, r.domain_2, r.set_2, r.out_set) for r in _known_outputs(rules, output).collect()]
        has = lambda d, s: d in inputs and s in inputs[d].names
        return power(df, inputs, columns, output, [r for r in parsed if has(r.domain_1, r.set_1) and has(r.domain_2, r.set_2)], name, normalize)
    if n > MAX_VALUE_RULES:
        raise ValueError(f"{n} rules are more than {MAX_VALUE_RULES}: use infer_long")
    sides = F.struct(*(F.concat_ws("\0", f"domain_{k}", f"set_{k}").alias(f"side_{k}") for k in (1, 2)), "out_set")
    value = _known_outputs(rules, output).agg(F.collect_list(sides).alias("rules")).scalar()
    firsts = {column_of(d, s.name): (f"{d}\0{s.name}", s.shape.degree(F.col(columns[d]))) for d, domain in inputs.items() for s in reversed(domain.sets)}
    degrees = F.create_map(*(c for key, degree in firsts.values() for c in (F.lit(key), degree))) if firsts else F.create_map().cast("map<string,double>")
    held = df.withColumn("__rules", value).withColumn("__degrees", degrees)

    def strength(rule: Column) -> Column:
        a, b = (F.try_element_at(F.col("__degrees"), rule[f"side_{k}"]) for k in (1, 2))
        return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))

    held = held.withColumn("__fired", F.transform("__rules", lambda r: F.struct(r["out_set"].alias("out_set"), strength(r).alias("strength"))))
    own = lambda name: F.transform(F.filter("__fired", lambda f: f["out_set"] == name), lambda f: f["strength"])
    outputs = {column_of(output.name, name): F.greatest(F.array_max(own(name)), F.lit(0.0)) for name in output.names}
    done = held.withColumns(outputs).withColumn(name, defuzzify(output, normalize))
    return done.select(*(c for c in df.columns if c != name), name)


def infer_long(memberships: DataFrame, rules: DataFrame, output: Domain, keep: Sequence[str], normalize: bool = False) -> DataFrame:
    """``keep`` and ``power`` from (``keep``, domain, set_name, degree) and a rule table.

    One row an observation, also where no rule names its sets (all degrees 0). A
    rule with an unknown output set is an error. Up to ``MAX_DRIVER_RULES`` rules,
    which are counted first, are read to plan one aggregation by observation: a
    column for each set that a rule names. Longer rule tables are joined; rows,
    values and errors are the same.
    """
    known = _known_outputs(rules, output)
    if rules.count() > MAX_DRIVER_RULES:
        return _infer_joined(memberships, known, output, keep, normalize)
    parsed = [FuzzyRule(r.domain_1, r.set_1, r.domain_2, r.set_2, r.out_set) for r in known.collect()]
    used = sorted({side for r in parsed for side in ((r.domain_1, r.set_1), (r.domain_2, r.set_2))})
    own = lambda d, s: F.max(F.when((F.col("domain") == d) & (F.col("set_name") == s), F.col("degree")))
    wide = memberships.groupBy(*keep).agg(*([own(d, s).alias(column_of(d, s)) for d, s in used] or [F.count("*").alias("__n")]))
    strengths: dict[str, list[Column]] = {s.name: [F.lit(0.0), F.lit(0.0)] for s in output.sets}
    for r in parsed:
        x, y = F.col(column_of(r.domain_1, r.set_1)), F.col(column_of(r.domain_2, r.set_2))
        strengths[r.out_set].append(F.when(x.isNotNull() & y.isNotNull(), F.least(x, y)))
    done = wide.withColumns({column_of(output.name, name): F.greatest(*cols) for name, cols in strengths.items()})
    return done.select(*keep, defuzzify(output, normalize).alias("power"))


def _infer_joined(memberships: DataFrame, rules: DataFrame, output: Domain, keep: Sequence[str], normalize: bool) -> DataFrame:
    """The same by joins: the two degrees of a rule meet by observation and rule."""
    numbered = rules.withColumn("rule", F.struct(*rules.columns))
    side = lambda k: F.struct(F.col(f"domain_{k}").alias("domain"), F.col(f"set_{k}").alias("set_name"), F.lit(k).alias("k"))
    sides = numbered.select("rule", "out_set", F.explode(F.array(side(1), side(2))).alias("__s")).select("rule", "out_set", "__s.*")
    # The outer join keeps the observations that no rule names.
    matched = memberships.join(sides, ["domain", "set_name"], "left")
    degree = lambda k: F.max(F.when(F.col("k") == k, F.col("degree")))
    fired = matched.groupBy(*keep, "rule", "out_set").agg(degree(1).alias("a"), degree(2).alias("b"))
    strength = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.least("a", "b"))
    strongest = lambda s: F.greatest(F.max(F.when(F.col("out_set") == s.name, strength)), F.lit(0.0))
    wide = fired.groupBy(*keep).agg(*(strongest(s).alias(name) for name, s in {column_of(output.name, s.name): s for s in reversed(output.sets)}.items()))
    return wide.select(*keep, defuzzify(output, normalize).alias("power"))


def best_set(df: DataFrame, domain: Domain, column: str, name: str) -> DataFrame:
    """``df`` with the set of highest degree; of equal degrees the first set."""
    x = F.col(column)
    top = F.greatest(*(s.shape.degree(x) for s in domain.sets)) if len(domain) > 1 else domain.sets[0].shape.degree(x)
    return df.withColumn("__top", top).withColumn(name, F.coalesce(*(F.when(s.shape.degree(x) == F.col("__top"), F.lit(s.name)) for s in domain.sets))).drop("__top")
