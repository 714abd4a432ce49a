"""Truth tables: operators by dialect over the awkward cells."""

import pytest
from pyspark.sql import functions as F

from collonade.operators.predicates import Condition, active, where

CELLS = {"none": None, "empty": "", "zero": "0", "five": "5", "five0": "5.0", "mixed": "12abc", "abc": "abc", "ABC": "ABC", "percent": "50% off", "under": "a_b", "nolist": "[]", "one": '["a"]', "two": '["a","b"]', "broken": "{bad", "iso": "2024-05-06T07:08:09Z", "day": "2024-05-06", "long": "Thu Jan 22 2026 19:21:05 GMT+0000 (Coordinated Universal Time)"}


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(list(CELLS.items()), "name string, v string").cache()


def names(cells, *conditions, dialect="public"):
    return {r.name for r in where(cells, [list(conditions)], dialect).collect()}


ALL = set(CELLS)


@pytest.mark.parametrize(
    "operator, value, value2, expected",
    [
        ("is", "ABC", "", {"abc", "ABC"}),
        ("is", "5", "", {"five"}),
        ("contains", "50%", "", {"percent"}),
        ("contains", "a_", "", {"under"}),
        ("starts_with", "A", "", {"abc", "ABC", "under"}),
        ("ends_with", "bc", "", {"mixed", "abc", "ABC"}),
        ("is_empty", "", "", {"none", "empty"}),
        ("is_not_empty", "", "", ALL - {"none", "empty"}),
        ("gt", "5", "", {"mixed", "percent", "iso", "day"}),
        ("gte", "5", "", {"five", "five0", "mixed", "percent", "iso", "day"}),
        ("lt", "nothing", "", set()),
        ("is_before", "2025-01-01", "", {"iso", "day"}),
        ("is_after", "2025-01-01", "", {"long"}),
        ("is_after", "never", "", set()),
        ("is_between", "2024-05-06", "2024-05-06", {"day"}),
        ("is_between", "2024-05-06", "", {"iso", "day", "long"}),
        ("is_between", "", "", set()),
        ("is_one_of", '["a","abc"]', "", {"abc", "one", "two"}),
        ("is_one_of", "bad", "", set()),
        ("is_not_one_of", "bad", "", ALL),
        ("has_items", "", "", ALL - {"none", "empty", "nolist", "zero", "five", "five0"}),
        ("contains_all_of", '["a"]', "", {"one", "two"}),
        ("contains_exactly", '["a"]', "", {"one"}),
        ("contains_exactly", '["a","a"]', "", {"two"}),
        ("item_count", "b", "", {"mixed", "abc", "ABC", "under", "two", "broken"}),
        ("unheard", "off", "", {"percent"}),
    ],
)
def test_public(cells, operator, value, value2, expected):
    assert names(cells, Condition("v", operator, value, value2)) == expected


@pytest.mark.parametrize("negative, positive", [("is_not", "is"), ("does_not_contain", "contains"), ("is_not_one_of", "is_one_of"), ("has_no_items", "has_items")])
@pytest.mark.parametrize("dialect", ["public", "visibility"])
def test_complements(cells, negative, positive, dialect):
    value = '["a"]' if "one_of" in positive else "abc"
    yes = names(cells, Condition("v", positive, value), dialect=dialect)
    no = names(cells, Condition("v", negative, value), dialect=dialect)
    assert yes | no == ALL and not yes & no


@pytest.mark.parametrize(
    "condition, expected",
    [
        (Condition("v", "is", "abc"), {"abc"}),
        (Condition("v", "is", "5", kind="number"), {"five", "five0"}),
        (Condition("v", "is_between", "2024-05-06", ""), set()),
        (Condition("v", "starts_with", "q"), ALL),
        (Condition("v", "unheard", "q"), ALL),
    ],
)
def test_visibility(cells, condition, expected):
    assert names(cells, condition, dialect="visibility") == expected


def test_builder_and_exact(cells):
    assert names(cells, Condition("v", "is_present", "abc"), dialect="builder") == {"mixed", "abc", "ABC"}
    assert names(cells, Condition("v", "is_not", "abc"), dialect="builder") == ALL - {"abc", "ABC"}
    assert names(cells, Condition("v", "", "abc"), dialect="exact") == {"abc"}


def test_groups(cells):
    a, b = Condition("v", "contains", "a"), Condition("v", "contains", "b")
    cnf = where(cells, [[a, b], [Condition("v", "is_not_empty")]], "visibility")
    assert {r.name for r in cnf.collect()} == names(cells, a, dialect="visibility") | names(cells, b, dialect="visibility")
    assert where(cells, [], "public").count() == len(CELLS)
    assert [c.value for c in active([Condition("v", "is"), Condition("v", "is", "x"), Condition("v", "is_empty")])] == ["x", ""]


@pytest.mark.parametrize(
    "table, condition, dialect, pushed",
    [
        ("orders", Condition("o_totalprice", "lt", "1e5"), "public", "LessThan(o_totalprice,100000.0)"),
        ("orders", Condition("o_orderkey", "gte", "5.5"), "public", "GreaterThan(o_orderkey,5)"),
        ("orders", Condition("o_orderkey", "is", "7", kind="number"), "visibility", "EqualTo(o_orderkey,7)"),
        ("events", Condition("ts", "is_before", "2024-01-15"), "public", "LessThan(ts,"),
        ("events", Condition("ts", "is_between", "2024-01-10", "2024-01-20"), "visibility", "GreaterThanOrEqual(ts,"),
        ("nation", Condition("n_name", "is", "FRANCE"), "exact", "EqualTo(n_name,FRANCE)"),
    ],
)
def test_typed_conditions_reach_the_scan(spark, data, table, condition, dialect, pushed):
    df = where(spark.read.parquet(f"{data}/{table}.parquet"), [[condition]], dialect)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan.split("PushedFilters: [", 1)[1].split("ReadSchema")[0]


def test_text_of_whole_numbers(spark):
    df = spark.createDataFrame([(1000.0, 2**53 + 1), (2.5, 2**53), (None, None)], "v double, n bigint")
    count = lambda c, d="public": where(df, [[c]], d).count()
    assert count(Condition("v", "is", "1000")) == 1 and count(Condition("v", "is_one_of", '["1000", "2.5"]')) == 2
    assert count(Condition("v", "is_not", "1000")) == 2
    assert count(Condition("n", "gt", str(2**53))) == 1 and count(Condition("n", "lte", str(2**53))) == 1
    assert count(Condition("n", "lt", "Infinity")) == 2 and count(Condition("n", "gt", "x")) == 0


@pytest.mark.parametrize(
    "groups, pushed",
    [
        ([[Condition("o_orderstatus", "is", "f")]], "In(o_orderstatus, [F,f])"),
        ([[Condition("o_orderpriority", "is", "4-not specified")]], "GreaterThanOrEqual(o_orderpriority,4-NOT SPECIFIED)"),
        ([[Condition("o_custkey", "is", "7")]], "EqualTo(o_custkey,7)"),
        ([[Condition("o_orderstatus", "is_one_of", '["F","P"]')]], "Or(Or(In(o_orderstatus, [F,P]),StringStartsWith(o_orderstatus,[)),StringStartsWith(o_orderstatus"),
        ([[Condition("o_custkey", "is_one_of", '["7","x","9"]')]], "In(o_custkey, [7,9])"),
        ([[Condition("o_orderstatus", "is", "p")], [Condition("o_custkey", "lt", "20"), Condition("o_orderstatus", "is", "o")]], "Or(In(o_orderstatus, [P,p])"),
    ],
)
def test_text_conditions_reach_the_scan(spark, data, groups, pushed):
    plan = where(spark.read.parquet(f"{data}/orders.parquet"), groups)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan, plan


def test_every_spelling_is_found(spark):
    """Listed spellings and ranges keep what lower case does, whatever the letters."""
    texts = ["kilo", "KILO", "Kilo", "\u212ailo", "kil\u0131", "K\u0130LO", "kilogramme and more", "KILOGRAMME AND MORE", "\u212aILOGRAMME and more", "kilogramme and morf", "Stra\u00dfe", "STRA\u00dfE", "strasse", "", " ", "0", "00", "-7", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for want in ["kilo", "KiLo", "kilogramme AND more", "stra\u00dfe", "", "0"]:
        got = {r.v for r in where(df, [[Condition("v", "is", want)]]).collect()}
        assert got == {r.v for r in df.where(F.lower("v") == want.lower()).collect()}
        rest = {r.v for r in where(df, [[Condition("v", "is_not", want)]]).collect()}
        assert rest == set(texts) - got
    numbers = spark.createDataFrame([(7,), (-7,), (0,), (None,)], "v bigint")
    for want, expected in {"7": {7}, "07": set(), "-7": {-7}, "0": {0}, "x": set(), "-0": set()}.items():
        assert {r.v for r in where(numbers, [[Condition("v", "is", want)]]).collect()} == expected
        assert {r.v for r in where(numbers, [[Condition("v", "is_not", want)]]).collect()} == {7, -7, 0, None} - expected
        assert {r.v for r in where(numbers, [[Condition("v", "is_one_of", f'["{want}","y"]')]]).collect()} == expected
