"""Rule queries: customers and nations as facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.rules import Engine, Memory, Pattern, Rule, Var
from brindle.plans.common import Catalogue
from brindle.session import load, scratch_folder

catalogue = Catalogue()

#: Facts derived by the rules: which plan suits which customer.
PLAN = "plan string, for_whom string"

_PERSON = """SELECT c_name AS name, CASE WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal >= 0 THEN 'middle' ELSE 'low' END AS balance,
 c_mktsegment AS segment, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_PLANS = f"""WITH p AS ({_PERSON}), r AS (
 SELECT 'large' AS plan, name AS for_whom FROM p WHERE balance = 'high' AND segment = 'BUILDING'
 UNION SELECT 'small', name FROM p WHERE balance = 'low' AND segment = 'BUILDING')"""


def person_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.when(F.col("c_acctbal") >= 5000, "high").when(F.col("c_acctbal") >= 0, "middle").otherwise("low")
    customers, nations = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("name"), balance.alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))


def plan_rule(plan: str, **slots: str) -> Rule:
    pattern = Pattern("person", slots | {"name": Var("who")})
    return Rule(f"{plan}-plan", [pattern], [("plan", {"plan": plan, "for_whom": Var("who")})], lambda: F.format_string("%s should take the %s plan.", F.col("who"), F.lit(plan)))


#: Both slots are tested, or only one: the two dialects of the same rules.
TWO_SLOTS = (plan_rule("large", balance="high", segment="BUILDING"), plan_rule("small", balance="low", segment="BUILDING"))
ONE_SLOT = (plan_rule("large", balance="high"), plan_rule("small", balance="low"))
CASCADE = Rule(
    "cascade",
    [Pattern("plan", {"plan": Var("plan"), "for_whom": Var("who")}), Pattern("person", {"name": Var("who"), "nation": Var("nation")})],
    message=lambda: F.format_string("CASCADE: %s of %s takes a %s plan!", F.col("who"), F.col("nation"), F.col("plan")),
)


def _run(spark: SparkSession, sf_dir: str, rules) -> tuple[dict[str, DataFrame], DataFrame]:
    result = Engine(rules).plan(spark, {"person": person_facts(spark, sf_dir), "plan": spark.createDataFrame([], PLAN)})
    return result.facts, result.messages


@catalogue.add(f"{_PLANS} SELECT plan, for_whom FROM r")
def rule_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, TWO_SLOTS)[0]["plan"]


@catalogue.add(
    f"""{_PLANS} SELECT plan || '-plan' AS rule, for_whom || ' should take the ' || plan || ' plan.' AS text FROM r
 UNION ALL SELECT 'cascade', 'CASCADE: ' || name || ' of ' || nation || ' takes a ' || plan || ' plan!' FROM r JOIN p ON for_whom = name"""
)
def rule_join_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, (*TWO_SLOTS, CASCADE))[1]


@catalogue.add(f"WITH p AS ({_PERSON}) SELECT CASE balance WHEN 'high' THEN 'large' ELSE 'small' END AS plan, name AS for_whom FROM p WHERE balance IN ('high', 'low')")
def rule_height_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ONE_SLOT)[0]["plan"]


FIXPOINT = (
    Rule("in-region", [Pattern("nation", {"nation": Var("n"), "region": Var("r")})], [("within", {"inner": Var("n"), "outer": Var("r")})]),
    Rule("lives-in", [Pattern("customer", {"name": Var("c"), "nation": Var("n")})], [("within", {"inner": Var("c"), "outer": Var("n")})]),
    Rule("further-out", [Pattern("within", {"inner": Var("a"), "outer": Var("b")}), Pattern("nation", {"nation": Var("b"), "region": Var("c")})], [("within", {"inner": Var("a"), "outer": Var("c")})]),
)


@catalogue.add(
    """WITH RECURSIVE base AS (SELECT n_name AS inner_name, r_name AS outer_name FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
 w AS (SELECT * FROM base UNION SELECT w.inner_name, base.outer_name FROM w JOIN base ON w.outer_name = base.inner_name)
 SELECT inner_name AS "inner", outer_name AS "outer" FROM w"""
)
def rule_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment of customers in nations and regions, to the fixpoint: one recursive query."""
    nation, region, customer = (load(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    facts = {
        "nation": nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region")),
        "customer": customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("name"), F.col("n_name").alias("nation")),
        "within": spark.createDataFrame([], "`inner` string, `outer` string"),
    }
    return Engine(FIXPOINT).plan(spark, facts).facts["within"]


#: Facts about nations meet the persons of :data:`TWO_SLOTS`.
ABROAD = Rule(
    "abroad",
    [Pattern("plan", {"plan": Var("plan"), "for_whom": Var("who")}), Pattern("person", {"name": Var("who"), "nation": Var("nation")}), Pattern("nation", {"nation": Var("nation"), "region": Var("region")})],
    [("delivery", {"region": Var("region"), "plan": Var("plan")})],
    lambda: F.format_string("%s of %s gets a %s plan.", F.col("who"), F.col("region"), F.col("plan")),
)


def _second_insert(spark: SparkSession, sf_dir: str) -> Memory:
    """All persons with the nations of some regions, then the other nations."""
    nations = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    late = F.col("region").isin("ASIA", "EUROPE")
    templates = {"person": "name string, balance string, segment string, nation string", "plan": PLAN, "nation": "nation string, region string", "delivery": "region string, plan string"}
    memory = Memory(spark, scratch_folder(spark, "memory"), (*TWO_SLOTS, ABROAD), templates)
    memory.insert({"person": person_facts(spark, sf_dir), "nation": nations.where(~late)})
    memory.insert({"nation": nations.where(late)})
    return memory


@catalogue.add(
    f"""{_PLANS}, n AS (SELECT n_name AS nation, r_name AS region, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 2 ELSE 1 END::INTEGER AS run FROM nation JOIN region ON n_regionkey = r_regionkey)
 SELECT 1::INTEGER AS run, plan || '-plan' AS rule, for_whom || ' should take the ' || plan || ' plan.' AS text FROM r
 UNION ALL SELECT run, 'abroad', name || ' of ' || region || ' gets a ' || plan || ' plan.' FROM r JOIN p ON for_whom = name JOIN n ON n.nation = p.nation"""
)
def rule_second_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by run: later facts fire what they are part of, and nothing again."""
    return _second_insert(spark, sf_dir).messages().select("run", "rule", "text")


@catalogue.add(
    f"""{_PLANS}, n AS (SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)
 SELECT region, plan, count(*) AS support FROM r JOIN p ON for_whom = name JOIN n ON n.nation = p.nation GROUP BY region, plan"""
)
def rule_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived facts with the number of matches behind them, over both inserts."""
    return _second_insert(spark, sf_dir).support("delivery")
