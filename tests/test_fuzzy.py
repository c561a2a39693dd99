import math

import pytest
from pyspark.sql import functions as F

from brindle.functions.shapes import SHAPES, Shape, register_shape
from brindle.operators import fuzzy
from brindle.operators.fuzzy import Domain, FuzzyRule

DISTANCE = Domain("distance").add("too_far", "Z", -5, 0).add("zero", "Lambda", -5, 0, 5).add("close", "Lambda", 0, 5, 10).add("medium", "Lambda", 5, 10, 30).add("far", "S", 10, 30)
ANGLE = Domain("angle").add("neg_big", "Z", -45, -5).add("neg_small", "Lambda", -45, -5, 0).add("zero", "Lambda", -5, 0, 5).add("pos_small", "Lambda", 0, 5, 45).add("pos_big", "S", 5, 45)
with pytest.warns(UserWarning, match="descend"):
    POWER = Domain("power").add("neg_high", "Lambda", -30, -25, -8).add("neg_medium", "Lambda", -25, -8, 0).add("zero", "Lambda", -8, 0, 8).add("pos_medium", "Lambda", 0, 8, 25).add("pos", "Lambda", 8, 25, 20)
RULES = (
    FuzzyRule("distance", "medium", "angle", "pos_small", "pos_medium"),
    FuzzyRule("distance", "medium", "angle", "zero", "zero"),
    FuzzyRule("distance", "far", "angle", "zero", "pos_medium"),
)
INPUTS, COLUMNS = {"distance": DISTANCE, "angle": ANGLE}, {"distance": "distance", "angle": "angle"}


def degrees(spark, shape, xs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double")
    return [r.d for r in df.select("k", shape.degree(F.col("x")).alias("d")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("kind", "points", "want"),
    [
        ("Z", (0, 10), [1, 1, 0.5, 0, 0, 0, None]),
        ("S", (0, 10), [0, 0, 0.5, 1, 1, 1, None]),
        ("Lambda", (0, 5, 10), [0, 0, 1, 0, 0, 0, None]),
        ("Pi", (0, 2, 8, 10), [0, 0, 1, 0, 0, 0, None]),
        ("Z", (0, 0), [1, 1, 0, 0, 0, 0, None]),
        ("S", (0, 0), [0, 0, 1, 1, 1, 1, None]),
        ("Pi", (0, 0, 10, 10), [0, 0, 1, 1, 0, 0, None]),
    ],
)
def test_shapes_at_breakpoints(spark, kind, points, want):
    assert degrees(spark, Shape(kind, points), [-1.0, 0.0, 5.0, 10.0, 11.0, math.nan, None]) == want


def test_typical_values():
    assert [Shape("Z", (1, 2)).typical, Shape("S", (1, 2)).typical, Shape("Lambda", (1, 2, 3)).typical, Shape("Pi", (1, 2, 4, 5)).typical] == [1, 2, 2, 3]
    with pytest.raises(ValueError):
        Shape("Lambda", (1, 2))


def test_malformed_triangle_climbs_and_then_is_zero(spark):
    assert degrees(spark, POWER.find("pos").shape, [8.0, 16.5, 25.0, 26.0]) == [0, 0.5, 1, 0]


def test_own_shape(spark):
    register_shape("Step", lambda x, at: F.when(x >= at, 1.0).otherwise(0.0), 1, lambda at: at)
    try:
        assert degrees(spark, Shape("Step", (3,)), [2.0, 3.0]) == [0, 1]
    finally:
        SHAPES.pop("Step")


@pytest.fixture
def crane(spark):
    return spark.createDataFrame([(1, 12.0, 4.0), (2, None, 4.0)], "id int, distance double, angle double")


def test_crane_wide(spark, crane):
    row = fuzzy.infer(fuzzy.fuzzify(crane, INPUTS, COLUMNS), INPUTS, POWER, RULES).where("id = 1").first()
    assert row.distance__medium == pytest.approx(0.9) and row.distance__far == pytest.approx(0.1)
    assert row.angle__zero == pytest.approx(0.2) and row.angle__pos_small == pytest.approx(0.8)
    assert row.power__pos_medium == pytest.approx(0.8) and row.power__zero == pytest.approx(0.2)
    for normalize in (False, True):
        got = {r.id: r.kw for r in fuzzy.power(crane, INPUTS, COLUMNS, POWER, RULES, "kw", normalize).collect()}
        assert got[1] == pytest.approx(6.4)
        assert got[2] in (None, 0.0)


@pytest.mark.parametrize("most", [200, 0])
def test_crane_long(spark, crane, monkeypatch, most):
    monkeypatch.setattr(fuzzy, "MAX_DRIVER_RULES", most)
    for normalize in (False, True):
        members = fuzzy.fuzzify_long(crane.where("id = 1"), INPUTS, COLUMNS, ["id"])
        got = fuzzy.infer_long(members, fuzzy.rule_table(spark, RULES), POWER, ["id"], normalize).collect()
        assert [r.power for r in got] == [pytest.approx(6.4)]


def test_names(spark, crane):
    with pytest.raises(KeyError):
        fuzzy.infer(fuzzy.fuzzify(crane, INPUTS, COLUMNS), INPUTS, POWER, [FuzzyRule("distance", "nowhere", "angle", "zero", "zero")])
    out = crane.select(DISTANCE.degree(F.col("distance"), "nowhere").alias("d"), fuzzy.cleared(DISTANCE.degrees(F.col("distance"))).alias("m")).first()
    assert out.d == 0.0 and set(out.m.values()) == {0.0}


def test_tables_round_trip(spark):
    back = fuzzy.domains_from(fuzzy.set_table(spark, [DISTANCE, ANGLE]))
    assert back == {"distance": DISTANCE, "angle": ANGLE}


def test_best_set_takes_the_first_of_equals(spark):
    two = Domain("x").add("a", "Lambda", 0, 5, 10).add("b", "Lambda", 0, 5, 10)
    df = spark.createDataFrame([(5.0,), (None,)], "x double")
    assert sorted(str(r.best) for r in fuzzy.best_set(df, two, "x", "best").collect()) == ["None", "a"]


@pytest.mark.parametrize("most", [200, 0])
@pytest.mark.parametrize("normalize", [False, True])
def test_both_ways_to_read_rules_agree(spark, monkeypatch, most, normalize):
    """Unknown sets, rows that no rule names, nulls and a repeated rule, by the plan and by joins."""
    monkeypatch.setattr(fuzzy, "MAX_DRIVER_RULES", most)
    rows = [(k, x, y) for k, (x, y) in enumerate([(12.0, 4.0), (None, 4.0), (-50.0, 90.0), (30.0, 0.0), (8.0, None), (6.0, 1.0)])] + [(None, 12.0, 4.0)]
    obs = spark.createDataFrame(rows, "id int, distance double, angle double")
    rules = [*RULES, RULES[0], FuzzyRule("distance", "medium", "distance", "medium", "zero"), FuzzyRule("distance", "nowhere", "angle", "zero", "pos_medium")]
    table = fuzzy.rule_table(spark, rules)
    members = fuzzy.fuzzify_long(obs, INPUTS, COLUMNS, ["id"])
    got = {r.id: r.power for r in fuzzy.infer_long(members, table, POWER, ["id"], normalize).collect()}
    known = [r for r in rules if r.set_1 != "nowhere"]
    want = {r.id: r.kw for r in fuzzy.power(obs, INPUTS, COLUMNS, POWER, known, "kw", normalize).collect()}
    in_row = {r.id: r.kw for r in fuzzy.infer_table(obs, INPUTS, COLUMNS, POWER, table, "kw", normalize).collect()}
    assert set(got) == set(want) == set(in_row)
    for k, x in want.items():
        assert got[k] == pytest.approx(x) and in_row[k] == pytest.approx(x), k
    alone = members.where("set_name = 'too_far'")
    assert {r.id: r.power for r in fuzzy.infer_long(alone, table, POWER, ["id"], normalize).collect()} == dict.fromkeys(got, None if normalize else 0.0)
    bad = fuzzy.rule_table(spark, [*RULES, FuzzyRule("distance", "far", "angle", "zero", "nowhere")])
    for call in (lambda: fuzzy.infer_long(members, bad, POWER, ["id"]), lambda: fuzzy.infer_table(obs, INPUTS, COLUMNS, POWER, bad, "kw")):
        with pytest.raises(KeyError):
            call()


def test_too_many_sets_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "MAX_SETS", 3)
    with pytest.raises(ValueError):
        fuzzy.domains_from(fuzzy.set_table(spark, [DISTANCE]))
