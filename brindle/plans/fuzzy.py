"""Fuzzy queries: quantities, discounts and balances as crisp inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import fuzzy, intervals
from brindle.operators.fuzzy import Domain, FuzzyRule
from brindle.plans.common import Catalogue, r6
from brindle.session import load

catalogue = Catalogue()

QUANTITY = Domain("quantity").add("tiny", "Z", 5, 12).add("small", "Lambda", 5, 14, 23).add("medium", "Pi", 14, 22, 30, 38).add("large", "Lambda", 30, 38, 46).add("huge", "S", 40, 48)
DISCOUNT = Domain("discount").add("none", "Z", 0.01, 0.04).add("some", "Lambda", 0.02, 0.05, 0.08).add("deep", "S", 0.06, 0.09)
EFFORT = Domain("effort").add("low", "Lambda", 0, 10, 20).add("middle", "Lambda", 10, 20, 30).add("high", "S", 20, 40)
BALANCE = Domain("balance").add("debt", "Z", -200, 0).add("modest", "Lambda", -200, 2000, 5000).add("solid", "Pi", 2000, 5000, 7000, 9000).add("rich", "S", 7000, 9500)
RULES = (
    FuzzyRule("quantity", "medium", "discount", "some", "middle"),
    FuzzyRule("quantity", "small", "discount", "deep", "low"),
    FuzzyRule("quantity", "huge", "discount", "deep", "high"),
    FuzzyRule("quantity", "large", "discount", "some", "high"),
)
INPUTS = {"quantity": QUANTITY, "discount": DISCOUNT}
COLUMNS = {"quantity": "l_quantity", "discount": "l_discount"}


def _degree_sql(kind: str, points: tuple[float, ...], x: str) -> str:
    """The textbook definition of each shape, as plain SQL."""
    p = [f"{v!r}::DOUBLE" for v in points]
    up = lambda a, b: f"({x} - {p[a]}) / ({p[b]} - {p[a]})"
    down = lambda a, b: f"({p[b]} - {x}) / ({p[b]} - {p[a]})"
    if kind == "Z":
        return f"CASE WHEN {x} <= {p[0]} THEN 1.0::DOUBLE WHEN {x} <= {p[1]} THEN {down(0, 1)} ELSE 0.0::DOUBLE END"
    if kind == "S":
        return f"CASE WHEN {x} <= {p[0]} THEN 0.0::DOUBLE WHEN {x} <= {p[1]} THEN {up(0, 1)} ELSE 1.0::DOUBLE END"
    if kind == "Lambda":
        return f"CASE WHEN {x} <= {p[0]} OR {x} > {p[2]} THEN 0.0::DOUBLE WHEN {x} <= {p[1]} THEN {up(0, 1)} ELSE {down(1, 2)} END"
    return f"CASE WHEN {x} <= {p[0]} OR {x} > {p[3]} THEN 0.0::DOUBLE WHEN {x} <= {p[1]} THEN {up(0, 1)} WHEN {x} <= {p[2]} THEN 1.0::DOUBLE ELSE {down(2, 3)} END"


def _wide_sql() -> str:
    degrees = ", ".join(f"{_degree_sql(s.shape.kind, s.shape.points, COLUMNS[d])} AS {d}__{s.name}" for d, dom in INPUTS.items() for s in dom.sets)
    strengths = ", ".join(f"least({r.domain_1}__{r.set_1}, {r.domain_2}__{r.set_2}) AS r{k}" for k, r in enumerate(RULES))
    outs = ", ".join("greatest(0.0::DOUBLE, " + ", ".join(f"r{k}" for k, r in enumerate(RULES) if r.out_set == s.name) + f") AS {s.name}" for s in EFFORT.sets)
    return f"WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, {degrees} FROM lineitem), i AS (SELECT *, {strengths} FROM f), o AS (SELECT *, {outs} FROM i)"


_POWER = " + ".join(f"{s.shape.typical!r}::DOUBLE * {s.name}" for s in EFFORT.sets)
_DEGREES = " + ".join(s.name for s in EFFORT.sets)


def _power(spark: SparkSession, sf_dir: str, normalize: bool) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return fuzzy.power(lines, INPUTS, COLUMNS, EFFORT, RULES, "power", normalize)


@catalogue.add(
    "WITH m AS ("
    + " UNION ALL ".join(f"SELECT l_returnflag, '{s.name}' AS set_name, {k}::BIGINT AS position, {_degree_sql(s.shape.kind, s.shape.points, 'l_quantity')} AS degree FROM lineitem" for k, s in enumerate(QUANTITY.sets))
    + ") SELECT l_returnflag, set_name, position, round(avg(degree), 6) AS degree FROM m GROUP BY ALL"
)
def fuzzify_quantity_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = fuzzy.fuzzify_long(load(spark, sf_dir, "lineitem"), {"quantity": QUANTITY}, COLUMNS, ["l_returnflag"])
    return long.groupBy("l_returnflag", "set_name", "position").agg(r6(F.avg("degree")).alias("degree"))


@catalogue.add("SELECT " + ", ".join(f"round(sum({_degree_sql(s.shape.kind, s.shape.points, 'l_discount')}), 6) AS {s.name}_sum" for s in DISCOUNT.sets) + " FROM lineitem")
def fuzzify_discount_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = fuzzy.fuzzify(load(spark, sf_dir, "lineitem"), {"discount": DISCOUNT}, COLUMNS)
    return wide.agg(*(r6(F.sum(fuzzy.column_of("discount", s.name))).alias(f"{s.name}_sum") for s in DISCOUNT.sets))


@catalogue.add(f"{_wide_sql()} SELECT l_linestatus, l_returnflag, " + ", ".join(f"round(avg({s.name}), 6) AS {s.name}, round(max({s.name}), 6) AS {s.name}_max" for s in EFFORT.sets) + " FROM o GROUP BY l_linestatus, l_returnflag")
def fuzzy_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fuzzy.infer(fuzzy.fuzzify(load(spark, sf_dir, "lineitem"), INPUTS, COLUMNS), INPUTS, EFFORT, RULES)
    cols = [(s.name, F.col(fuzzy.column_of("effort", s.name))) for s in EFFORT.sets]
    return done.groupBy("l_linestatus", "l_returnflag").agg(*(x for n, c in cols for x in (r6(F.avg(c)).alias(n), r6(F.max(c)).alias(f"{n}_max"))))


@catalogue.add(f"{_wide_sql()} SELECT l_orderkey, round(sum({_POWER}), 6) AS power FROM o GROUP BY l_orderkey")
def fuzzy_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _power(spark, sf_dir, False).groupBy("l_orderkey").agg(r6(F.sum("power")).alias("power"))


@catalogue.add(f"{_wide_sql()} SELECT l_orderkey, round(sum(({_POWER}) / nullif({_DEGREES}, 0)), 6) AS power FROM o GROUP BY l_orderkey")
def fuzzy_power_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _power(spark, sf_dir, True).groupBy("l_orderkey").agg(r6(F.sum("power")).alias("power"))


@catalogue.add(f"{_wide_sql()} SELECT l_orderkey, round(sum({_POWER}), 6) AS power FROM o GROUP BY l_orderkey")
def fuzzy_rules_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`fuzzy_power` with sets and rules as tables."""
    domains = fuzzy.domains_from(fuzzy.set_table(spark, [QUANTITY, DISCOUNT]))
    done = fuzzy.infer_table(load(spark, sf_dir, "lineitem"), domains, COLUMNS, EFFORT, fuzzy.rule_table(spark, RULES), "power")
    return done.groupBy("l_orderkey").agg(r6(F.sum("power")).alias("power"))


@catalogue.add(
    "WITH d AS (SELECT c_custkey, "
    + ", ".join(f"{_degree_sql(s.shape.kind, s.shape.points, 'c_acctbal')} AS {s.name}" for s in BALANCE.sets)
    + " FROM customer) SELECT c_custkey, CASE "
    + " ".join(f"WHEN {s.name} = greatest({', '.join(BALANCE.names)}) THEN '{s.name}'" for s in BALANCE.sets)
    + " END AS grade FROM d"
)
def fuzzy_customer_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.best_set(load(spark, sf_dir, "customer"), BALANCE, "c_acctbal", "grade").select("c_custkey", "grade")


@catalogue.add(
    "WITH m AS ("
    + " UNION ALL ".join(f"SELECT c_custkey, '{s.name}' AS set_name, {_degree_sql(s.shape.kind, s.shape.points, 'c_acctbal')} AS degree FROM customer" for s in BALANCE.sets)
    + ") SELECT c_custkey, round(sum(CASE WHEN set_name = 'rich' THEN 0.5::DOUBLE WHEN set_name IN ('modest', 'solid') THEN degree END), 6) AS degree FROM m GROUP BY c_custkey"
)
def fuzzy_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fuzzy value as a map: one degree set, degrees read by name."""
    degrees = fuzzy.set_degree(BALANCE.degrees(F.col("c_acctbal")), "rich", F.lit(0.5))
    total = F.element_at("m", "rich") + F.element_at("m", "modest") + F.element_at("m", "solid")
    return load(spark, sf_dir, "customer").select("c_custkey", degrees.alias("m")).select("c_custkey", r6(total).alias("degree"))


@catalogue.add(
    """WITH p AS (SELECT v, lag(v) OVER (ORDER BY v) AS a, lead(v) OVER (ORDER BY v) AS b, row_number() OVER (ORDER BY v) - 1 AS position FROM (SELECT DISTINCT p_retailprice AS v FROM part)),
 x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity * (1 - l_discount) AS x FROM lineitem),
 m AS (SELECT l_orderkey, l_linenumber, position, CASE WHEN x <= v THEN CASE WHEN a IS NULL THEN 1.0::DOUBLE ELSE (x - a) / (v - a) END WHEN b IS NULL THEN 1.0::DOUBLE ELSE (b - x) / (b - v) END AS degree
  FROM x JOIN p ON x BETWEEN coalesce(a, '-Infinity'::DOUBLE) AND coalesce(b, 'Infinity'::DOUBLE)),
 o AS (SELECT * FROM m WHERE degree > 0)
 SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(degree), 6) AS degrees, 'price-' || arg_max(position, (round(degree, 6), -position)) AS best FROM o GROUP BY l_orderkey, l_linenumber"""
)
def fuzzy_set_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted unit prices in a domain with a set for every retail price: the sets
    are a table as long as that of the parts, and are joined by intervals."""
    sets = intervals.partition_sets(load(spark, sf_dir, "part"), "p_retailprice", "price")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity") * (1 - F.col("l_discount"))).alias("x"))
    found = intervals.fuzzify_table(lines, {"price": "x"}, sets, ["l_orderkey", "l_linenumber"])
    best = F.max_by("set_name", F.struct(r6("degree"), -F.col("position")))
    return found.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), r6(F.sum("degree")).alias("degrees"), best.alias("best"))
