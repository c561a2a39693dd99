import pytest
from pyspark.sql import functions as F

from brindle.operators.rules import Engine, Memory, Pattern, Rule, Var

PERSON = "name string, height string, color string, shape string"
BAG = "size string, for_whom string"


def bag_rule(size, slots):
    return Rule(size, [Pattern("person", slots | {"name": Var("n")})], [("bag", {"size": size, "for_whom": Var("n")})], lambda: F.format_string("%s should carry a %s bag.", F.col("n"), F.lit(size)))


CASCADE = Rule(
    "cascade",
    [Pattern("bag", {"size": Var("s"), "for_whom": Var("n")}), Pattern("person", {"name": Var("n"), "color": Var("c")})],
    message=lambda: F.format_string("CASCADE EFFECT: %s should sport a %s, %s bag!", F.col("n"), F.col("s"), F.col("c")),
)


def facts(spark, people):
    return {"person": spark.createDataFrame(people, PERSON), "bag": spark.createDataFrame([], BAG)}


PEOPLE = [("Ada", "tall", "pink", "rectangular"), ("Bea", "petite", "blue", "rectangular"), ("Cy", "average", "red", "rectangular"), ("Di", "tall", "green", "round")]


def test_two_slots_and_cascade(spark):
    rules = [bag_rule("large", {"height": "tall", "shape": "rectangular"}), bag_rule("small", {"height": "petite", "shape": "rectangular"}), CASCADE]
    result = Engine(rules).run(spark, facts(spark, PEOPLE))
    assert sorted(map(tuple, result.facts["bag"].collect())) == [("large", "Ada"), ("small", "Bea")]
    assert sorted(r.text for r in result.messages.collect()) == [
        "Ada should carry a large bag.",
        "Bea should carry a small bag.",
        "CASCADE EFFECT: Ada should sport a large, pink bag!",
        "CASCADE EFFECT: Bea should sport a small, blue bag!",
    ]


def test_one_slot(spark):
    result = Engine([bag_rule("large", {"height": "tall"})]).run(spark, facts(spark, PEOPLE))
    assert sorted(r.for_whom for r in result.facts["bag"].collect()) == ["Ada", "Di"]


def test_whole_fact_binding(spark):
    rule = Rule("whole", [Pattern("person", {"height": "tall"}, whole="p")], [("bag", {"size": "large", "for_whom": F.col("p.name")})])
    assert Engine([rule]).run(spark, facts(spark, PEOPLE)).facts["bag"].count() == 2


def test_duplicate_facts(spark):
    twice = [PEOPLE[0], PEOPLE[0]]
    rule = bag_rule("large", {"height": "tall"})
    assert Engine([rule]).run(spark, facts(spark, twice)).facts["bag"].count() == 1
    assert Engine([rule], distinct_facts=False).run(spark, facts(spark, twice)).facts["bag"].count() == 2


def edge_rules():
    return [
        Rule("base", [Pattern("edge", {"a": Var("x"), "b": Var("y")})], [("path", {"a": Var("x"), "b": Var("y")})]),
        Rule("step", [Pattern("path", {"a": Var("x"), "b": Var("y")}), Pattern("path", {"a": Var("y"), "b": Var("z")})], [("path", {"a": Var("x"), "b": Var("z")})]),
        Rule("loop", [Pattern("path", {"a": Var("x"), "b": Var("x")})], message=lambda: F.concat(F.lit("loop at "), F.col("x"))),
    ]


def test_cycle_reaches_the_fixpoint(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 1)], "a int, b int")
    result = Engine(edge_rules()).run(spark, {"edge": edges, "path": spark.createDataFrame([], "a int, b int")})
    paths = {tuple(r) for r in result.facts["path"].collect()}
    assert paths == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)} | {(None, b) for b in (1, 2, 3, 4)}
    assert sorted(r.text for r in result.messages.collect()) == ["loop at 1", "loop at 2", "loop at 3"]


def test_round_limit_and_unjoined_patterns(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)], "a int, b int")
    with pytest.raises(RuntimeError):
        Engine(edge_rules(), max_rounds=2).run(spark, {"edge": edges, "path": spark.createDataFrame([], "a int, b int")})
    bad = Rule("bad", [Pattern("edge", {"a": Var("x")}), Pattern("edge", {"b": Var("y")})])
    with pytest.raises(ValueError):
        Engine([bad]).run(spark, {"edge": edges})


TEMPLATES = {"edge": "a int, b int", "path": "a int, b int"}


def test_later_facts_fire_no_old_match(spark, tmp_path):
    memory = Memory(spark, f"{tmp_path}/m", edge_rules(), TEMPLATES)
    first, second = [(1, 2), (2, 3), (5, 5)], [(3, 1), (3, 4), (1, 2)]
    frame = lambda rows: spark.createDataFrame(rows, "a int, b int")
    assert memory.runs() == 0 and memory.facts("path").count() == 0 and memory.messages().count() == 0
    assert memory.insert({"edge": frame(first)}) == 1
    assert [(r.text, r.run) for r in memory.messages().collect()] == [("loop at 5", 1)]
    assert memory.insert({"edge": frame(second)}) == 2
    whole = Engine(edge_rules()).run(spark, {"edge": frame(first + second), "path": frame([])})
    for template in TEMPLATES:
        assert sorted(memory.facts(template).collect()) == sorted(whole.facts[template].collect())
        assert memory.facts(template).distinct().count() == memory.facts(template).count()
    assert sorted(r.text for r in memory.messages().collect()) == sorted(r.text for r in whole.messages.collect())
    assert sorted((r.text, r.run) for r in memory.messages().collect() if r.run == 2) == [(f"loop at {k}", 2) for k in (1, 2, 3)]
    # Every match counts once, whichever run found it.
    assert sorted(memory.support("path").collect()) == sorted(whole.support["path"].collect())
    # Known facts fire nothing; another session goes on from the folder.
    again = Memory(spark, f"{tmp_path}/m", edge_rules(), TEMPLATES)
    assert again.insert({"edge": frame(first), "path": frame([(1, 3)])}) == 3
    assert again.facts("edge", 3).count() == again.facts("path", 3).count() == again.messages().where("run = 3").count() == 0


def test_a_failed_insert_is_not_read(spark, tmp_path):
    memory = Memory(spark, f"{tmp_path}/m", edge_rules(), TEMPLATES)
    frame = lambda rows: spark.createDataFrame(rows, "a int, b int")
    memory.insert({"edge": frame([(1, 2)])})
    # Written, but killed before its mark.
    frame([(7, 8)]).write.parquet(f"{tmp_path}/m/facts/path/run=2")
    frame([(7, 8)]).selectExpr("*", "1L as support").write.parquet(f"{tmp_path}/m/support/path/run=2")
    assert sorted(map(tuple, memory.facts("path").collect())) == [(1, 2)]
    assert memory.insert({"edge": frame([(2, 3)])}) == 2
    assert sorted(map(tuple, memory.facts("path").collect())) == [(1, 2), (1, 3), (2, 3)]
    assert sorted(map(tuple, memory.support("path").collect())) == [(1, 2, 1), (1, 3, 1), (2, 3, 1)]


def linear_rules():
    return [
        Rule("base", [Pattern("edge", {"a": Var("x"), "b": Var("y")})], [("path", {"a": Var("x"), "b": Var("y")})]),
        Rule("step", [Pattern("edge", {"a": Var("y"), "b": Var("z")}), Pattern("path", {"a": Var("x"), "b": Var("y")})], [("path", {"a": Var("x"), "b": Var("z")})]),
        Rule("twin", [Pattern("path", {"a": Var("x"), "b": 4}), Pattern("edge", {"a": Var("x"), "b": Var("y")})], [("path", {"a": Var("x"), "b": 40})]),
        Rule("end", [Pattern("path", {"a": Var("x"), "b": 4})], [("ends", {"a": Var("x"), "note": "it's a \\ end"})], lambda: F.format_string("%s ends", F.col("x"))),
    ]


def test_one_plan_makes_any_number_of_facts(spark):
    facts = {"edge": spark.createDataFrame([(k, k + 1) for k in range(12)], "a int, b int"), "path": spark.createDataFrame([], "a int, b int")}
    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, 20)
    try:
        got = Engine(linear_rules()[:2]).plan(spark, facts).facts["path"].collect()
    finally:
        spark.conf.unset(limit)
    assert sorted(map(tuple, got)) == [(a, b) for a in range(12) for b in range(a + 1, 13)]


def test_one_plan_gives_the_facts_of_the_rounds(spark):
    edges = [(1, 2), (2, 3), (3, 4), (1, 3), (None, 1), (7, 8)]
    facts = {"edge": spark.createDataFrame(edges, "a int, b int"), "path": spark.createDataFrame([(9, 1)], "a int, b int"), "ends": spark.createDataFrame([], "a int, note string")}
    whole, plan = Engine(linear_rules()).run(spark, facts), Engine(linear_rules()).plan(spark, facts)
    for template in facts:
        assert sorted(map(str, plan.facts[template].collect())) == sorted(map(str, whole.facts[template].collect()))
    assert sorted(r.text for r in plan.messages.collect()) == sorted(r.text for r in whole.messages.collect())
    # Without recursion: two rules, and a rule on what they make.
    rules = [bag_rule("large", {"height": "tall", "shape": "rectangular"}), bag_rule("small", {"height": "petite", "shape": "rectangular"}), CASCADE]
    for got in (Engine(rules).run(spark, facts_of(spark)), Engine(rules).plan(spark, facts_of(spark))):
        assert sorted(map(tuple, got.facts["bag"].collect())) == [("large", "Ada"), ("small", "Bea")] and got.messages.count() == 4


def facts_of(spark):
    return facts(spark, PEOPLE)


def test_rule_sets_that_need_rounds(spark):
    empty = {"edge": spark.createDataFrame([(1, 2), (2, 1)], "a int, b int"), "path": spark.createDataFrame([], "a int, b int")}
    with pytest.raises(ValueError, match="two patterns"):
        Engine(edge_rules()).plan(spark, empty)
    there = Rule("there", [Pattern("edge", {"a": Var("x"), "b": Var("y")})], [("path", {"a": Var("x"), "b": Var("y")})])
    back = Rule("back", [Pattern("path", {"a": Var("x"), "b": Var("y")})], [("edge", {"a": Var("y"), "b": Var("x")})])
    with pytest.raises(ValueError, match="each other"):
        Engine([there, back]).plan(spark, empty)
    with pytest.raises(Exception, match="RECURSION_LEVEL"):
        Engine(linear_rules()[:2]).plan(spark, empty, max_depth=20).facts["path"].collect()
