"""Forward-chaining rules over fact tables.

A fact template is a schema and its facts are a DataFrame. A rule matches one or
more patterns (constants are filters, shared variables are equi-joins), asserts
new facts and may write a message. :class:`Engine` runs all rules to a fixpoint,
semi-naively: in each round a rule must use a fact that the last round made.
:class:`Memory` keeps facts between runs, so that later facts fire only what is new.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import cut, drop_folder, exists

#: Counts the matches that made a fact; no slot may have this name.
SUPPORT = "support"


@dataclass(frozen=True)
class Var:
    """A variable: equal names within a rule must have equal values."""

    name: str


@dataclass(frozen=True)
class Pattern:
    """Facts of ``template`` whose slots equal constants or bind variables.

    ``whole`` binds the fact itself, as a struct, under that name.
    """

    template: str
    slots: dict[str, object] = field(default_factory=dict)
    whole: str | None = None


@dataclass(frozen=True)
class Rule:
    """``asserts``: (template, {slot: value, Var or Column over the bindings})."""

    name: str
    patterns: Sequence[Pattern]
    asserts: Sequence[tuple[str, dict[str, object]]] = ()
    message: Callable[[], Column] | None = None


def _value(x: object) -> Column:
    return F.col(x.name) if isinstance(x, Var) else x if isinstance(x, Column) else F.lit(x)


def match(facts: DataFrame, pattern: Pattern) -> DataFrame:
    """The bindings of one pattern: a column for each variable."""
    tests = [F.col(s) == F.lit(v) for s, v in pattern.slots.items() if not isinstance(v, Var)]
    bound: dict[str, list[str]] = {}
    for slot, v in pattern.slots.items():
        if isinstance(v, Var):
            bound.setdefault(v.name, []).append(slot)
    tests += [F.col(slots[0]) == F.col(s) for slots in bound.values() for s in slots[1:]]
    kept = facts.where(reduce(lambda a, b: a & b, tests)) if tests else facts
    columns = [F.col(slots[0]).alias(name) for name, slots in bound.items()]
    if pattern.whole:
        columns.append(F.struct("*").alias(pattern.whole))
    return kept.select(*columns, *([] if columns else [F.lit(True).alias("__matched")]))


def bindings(rule: Rule, facts: Sequence[DataFrame]) -> DataFrame:
    """The bindings of all patterns of a rule, joined on the variables they share."""
    out = None
    for pattern, own in zip(rule.patterns, facts, strict=True):
        found = match(own, pattern)
        if out is None:
            out = found
            continue
        shared = [c for c in found.columns if c in out.columns and c != "__matched"]
        if not shared:
            raise ValueError(f"{rule.name}: a pattern shares no variable with those before it")
        out = out.join(found, shared)
    return out


def fire(rule: Rule, facts: Sequence[DataFrame], schemas: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """New facts by template, and messages (rule, text), of one rule."""
    found = bindings(rule, facts)
    made: dict[str, DataFrame] = {}
    for template, slots in rule.asserts:
        own = found.select(*(_value(slots.get(c)).cast(t).alias(c) for c, t in schemas[template].dtypes))
        made[template] = made[template].unionByName(own) if template in made else own
    text = found.select(F.lit(rule.name).alias("rule"), rule.message().alias("text")) if rule.message else None
    return made, text


def _without(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of ``new`` that are not in ``old``; nulls equal nulls."""
    names = [f"__old_{c}" for c in old.columns]
    return new.join(old.toDF(*names), reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(o)) for c, o in zip(new.columns, names, strict=True))), "left_anti")


def _closure(spark: SparkSession, template: str, base: DataFrame, rules: Sequence[Rule], known: dict[str, DataFrame], max_depth: int) -> DataFrame:
    """``base`` with all that linear rules make of it, as a recursive query."""
    columns = [f"`{c}`" for c in base.columns]
    frames, steps = {"base": base}, []
    for n, rule in enumerate(rules):
        if sum(p.template == template for p in rule.patterns) > 1:
            raise ValueError(f"{rule.name}: two patterns of {template} are no linear rule: use run")
        joined, bound = "", set()
        # The growing facts first, then what they meet.
        for k, pattern in enumerate(sorted(rule.patterns, key=lambda p: p.template != template)):
            if pattern.template == template:
                slots = {slot: v for slot, v in pattern.slots.items()}
                names = {v.name: slot for slot, v in reversed(slots.items()) if isinstance(v, Var)}
                tests = [f"`{slot}` = {_literal(v)}" for slot, v in slots.items() if not isinstance(v, Var)]
                tests += [f"`{slot}` = `{names[v.name]}`" for slot, v in slots.items() if isinstance(v, Var) and names[v.name] != slot]
                chosen = ", ".join([f"`{slot}` AS `{name}`" for name, slot in names.items()] or ["true AS `__matched`"])
                joined = f"(SELECT {chosen} FROM growing WHERE {' AND '.join(tests) or 'true'})"
            else:
                found = match(known[pattern.template], pattern)
                names = {c: c for c in found.columns}
                frames[f"met_{n}_{k}"] = found
                shared = [c for c in names if c in bound]
                if not shared:
                    raise ValueError(f"{rule.name}: a pattern shares no variable with those before it")
                joined += f" JOIN {{met_{n}_{k}}} USING ({', '.join(f'`{c}`' for c in shared)})"
            if pattern.whole:
                raise ValueError(f"{rule.name}: a whole fact is no variable of a recursive query: use run")
            bound |= set(names)
        for made, slots in rule.asserts:
            if made == template:
                values = [f"CAST({_literal(slots.get(c))} AS {t})" for c, t in base.dtypes]
                steps.append(f"SELECT {', '.join(values)} FROM {joined}")
    # LIMIT ALL: a recursive query otherwise ends with an error at a million rows.
    text = f"WITH RECURSIVE growing({', '.join(columns)}) MAX RECURSION LEVEL {max_depth} AS (SELECT {', '.join(columns)} FROM {{base}} UNION ALL ({' UNION ALL '.join(steps)})) SELECT DISTINCT * FROM (SELECT * FROM growing LIMIT ALL)"
    return spark.sql(text, **frames)


def _literal(x: object) -> str:
    """A variable or constant as SQL."""
    if isinstance(x, Var):
        return f"`{x.name}`"
    if x is None or isinstance(x, (bool, int)):
        return "NULL" if x is None else str(x)
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise ValueError(f"{x!r} is no constant of a recursive query: use run")


@dataclass
class Result:
    """``new``: the facts of this run by template, those inserted included; ``support``:
    a derived fact with the number of matches that made it in this run."""

    facts: dict[str, DataFrame]
    messages: DataFrame
    rounds: int
    new: dict[str, DataFrame]
    support: dict[str, DataFrame]


class Engine:
    """Runs rules over facts until a round makes no new fact.

    With ``distinct_facts`` equal facts are one. Without it a rule's facts are
    kept as often as they are derived; derivations still end, because only facts
    that are new as values start another round.
    """

    def __init__(self, rules: Sequence[Rule], distinct_facts: bool = True, max_rounds: int = 50) -> None:
        self.rules, self.distinct_facts, self.max_rounds = list(rules), distinct_facts, max_rounds

    def run(self, spark: SparkSession, facts: dict[str, DataFrame], new: dict[str, DataFrame] | None = None) -> Result:
        """Fire the rules over ``facts``; with ``new``, only where a match uses one of
        these facts or one made from them: ``facts`` are then known and fired before."""
        known = {t: df.distinct() if self.distinct_facts and new is None else df for t, df in facts.items()}
        if new is None:
            delta = dict(known)
        else:
            delta = {t: cut(_without(df.select(*known[t].columns).distinct(), known[t])) for t, df in new.items()}
            known |= {t: known[t].unionByName(df) for t, df in delta.items()}
        added: dict[str, list[DataFrame]] = {t: [df] for t, df in delta.items()}
        derived: dict[str, list[DataFrame]] = {}
        messages: list[DataFrame] = []
        for turn in range(1, self.max_rounds + 1):
            made: dict[str, list[DataFrame]] = {}
            texts: list[DataFrame] = []
            for rule in self.rules:
                for k, pattern in enumerate(rule.patterns):
                    if pattern.template not in delta:
                        continue
                    # Pattern k uses new facts, those before it old ones: no match twice.
                    own = [delta[p.template] if i == k else self._old(known, delta, p.template) if i < k else known[p.template] for i, p in enumerate(rule.patterns)]
                    if any(x is None for x in own):
                        continue
                    found, text = fire(rule, own, known)
                    for template, df in found.items():
                        made.setdefault(template, []).append(df)
                    if text is not None:
                        texts.append(text)
            # One cut a round for all messages, and one or two a template for its facts.
            if texts:
                messages.append(cut(reduce(DataFrame.unionByName, texts)))
            delta, known, fresh = {}, dict(known), {}
            for template, frames in made.items():
                all_new = reduce(DataFrame.unionByName, frames)
                all_new = all_new if self.distinct_facts else cut(all_new)
                derived.setdefault(template, []).append(all_new)
                novel = cut(_without(all_new.distinct(), known[template]))
                if not novel.isEmpty():
                    fresh[template] = novel
                    known[template] = known[template].unionByName(novel if self.distinct_facts else all_new)
                    added.setdefault(template, []).append(novel)
            if not fresh:
                break
            delta = fresh
        else:
            raise RuntimeError(f"no fixpoint after {self.max_rounds} rounds")
        none = spark.createDataFrame([], "rule string, text string")
        union = lambda frames: reduce(DataFrame.unionByName, frames)
        support = {t: union(frames).groupBy(*known[t].columns).agg(F.count("*").alias(SUPPORT)) for t, frames in derived.items()}
        return Result(known, reduce(DataFrame.unionByName, messages, none), turn, {t: union(frames) for t, frames in added.items()}, support)

    def plan(self, spark: SparkSession, facts: dict[str, DataFrame], max_depth: int = 1000) -> Result:
        """The facts and messages of :meth:`run` as one plan: no rounds, nothing written.

        For rule sets without recursion, or where a template's facts are made from
        facts of the same template by rules with one pattern of it each, which
        assert variables and constants alone: these become a recursive query. Such
        facts must not go round in circles: more than ``max_depth`` steps are an
        error when the result is used. Other rule sets are an error here; they need
        rounds. Equal facts are one.
        """
        makers: dict[str, list[Rule]] = {t: [r for r in self.rules if any(a == t for a, _ in r.asserts)] for t in facts}
        needs = {t: {p.template for r in rules for p in r.patterns} for t, rules in makers.items()}
        known: dict[str, DataFrame] = {}
        while len(known) < len(facts):
            ready = [t for t in facts if t not in known and needs[t] <= {t, *known}]
            if not ready:
                raise ValueError(f"rules on {sorted(set(facts) - set(known))} make facts for each other: use run")
            for t in ready:
                again = [r for r in makers[t] if any(p.template == t for p in r.patterns)]
                made = [fire(r, [known[p.template] for p in r.patterns], facts)[0][t] for r in makers[t] if r not in again]
                base = reduce(DataFrame.unionByName, made, facts[t]).distinct()
                known[t] = _closure(spark, t, base, again, known, max_depth) if again else base
        texts = [fire(r, [known[p.template] for p in r.patterns], facts)[1] for r in self.rules if r.message]
        none = spark.createDataFrame([], "rule string, text string")
        return Result(known, reduce(DataFrame.unionByName, texts, none), 1, known, {})

    @staticmethod
    def _old(known: dict[str, DataFrame], delta: dict[str, DataFrame], template: str) -> DataFrame | None:
        """Facts from before the last round."""
        if template not in delta:
            return known[template]
        return None if delta[template] is known[template] else _without(known[template], delta[template])


class Memory:
    """A working memory that outlives its runs, as a log in a folder.

    Each insert runs the rules on what is new and appends, under its run number, the
    facts that were not known, how often each fact was derived, and the
    messages. The run counts once its mark is written, last of all: what a failed
    insert left behind is not read and is replaced by the next one. One insert runs
    at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, rules: Sequence[Rule], templates: dict[str, str], max_rounds: int = 50) -> None:
        """``templates``: the schema of each, as DDL."""
        self.spark, self.folder, self.templates = spark, folder, dict(templates)
        self.engine = Engine(rules, max_rounds=max_rounds)

    def runs(self) -> int:
        """Finished inserts."""
        number = 0
        while exists(self.spark, f"{self.folder}/marks/{number + 1}"):
            number += 1
        return number

    def _log(self, kind: str, schema: str, runs: int) -> DataFrame:
        """The rows of the finished runs, with ``run``."""
        paths = [p for p in (f"{self.folder}/{kind}/run={k}" for k in range(1, runs + 1)) if exists(self.spark, p)]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, run int")
        return self.spark.read.schema(f"{schema}, run int").option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def facts(self, template: str, run: int | None = None) -> DataFrame:
        """All facts, each once; or those that one run added."""
        log = self._log(f"facts/{template}", self.templates[template], self.runs())
        return (log if run is None else log.where(F.col("run") == run)).drop("run")

    def support(self, template: str) -> DataFrame:
        """Derived facts with the number of matches that made them, over all runs."""
        log = self._log(f"support/{template}", f"{self.templates[template]}, {SUPPORT} long", self.runs())
        return log.groupBy(*(c for c in log.columns if c not in (SUPPORT, "run"))).agg(F.sum(SUPPORT).alias(SUPPORT))

    def messages(self) -> DataFrame:
        """(rule, text, run) of all runs."""
        return self._log("messages", "rule string, text string", self.runs())

    def insert(self, new: dict[str, DataFrame]) -> int:
        """Add facts and fire what follows from them; the number of the run. Facts
        that are known already fire nothing."""
        number = self.runs() + 1
        known = {t: self.facts(t) for t in self.templates}
        empty = {t: self.spark.createDataFrame([], schema) for t, schema in self.templates.items()}
        result = self.engine.run(self.spark, known, {t: new.get(t, df) for t, df in empty.items()})
        write = lambda df, kind: df.write.mode("overwrite").parquet(f"{self.folder}/{kind}/run={number}")
        for t, df in result.new.items():
            write(df, f"facts/{t}")
        for t in self.templates:
            if t in result.support:
                write(result.support[t], f"support/{t}")
            else:
                drop_folder(self.spark, f"{self.folder}/support/{t}/run={number}")
        write(result.messages, "messages")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/marks/{number}")
        return number
