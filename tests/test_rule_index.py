"""Signatures found by the texts they require, against running every pattern."""

import random
import re

import pytest

from trafficlens.operators import rule_index as R
from trafficlens.operators import signatures as S

PATTERNS = {
    "plain": "select", "either": "(union|insert) +into", "late": "a*password=.*x", "optional": "(?:drop )?table", "short": "or", "none": "[0-9]+", "bound": r"\badmin\b",
    "named": "(?P<q>['\"])root(?P=q)", "repeat": "(?:ab){2,}cdef", "mixed": "one(?:two|three)four|fivesix", "bytes": "\\xe9tude", "class": "x[ab]yzzy", "any": "GET .* HTTP",
}


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("abc", ("abc",)), ("ABC.DEFG", ("defg",)), ("abc|abde", ("ab",)), ("foo|barr", ("foo", "barr")), ("(foo|b?)x", ("x",)), ("a*long.*xy", ("long",)), ("[ab]?", None),
        ("(?i)Word", ("word",)), ("a{2,3}bcd", ("bcd",)), ("(?:abcd)?ef", ("ef",)), (r"^\babc$", ("abc",)), ("é", None), ("(", None), ("(?>atom)", ("atom",)), ("(?=look)ab", ("ab",)),
    ],
)
def test_required_literals(pattern, want):
    assert R.required_literals(pattern) == want


def test_every_match_has_a_required_literal():
    rnd = random.Random(1)
    for _ in range(20_000):
        text = "".join(rnd.choice(["select", "union", " ", "into", "ab", "cdef", "one", "two", "four", "x", "a", "yzzy", "'", "root", "GET ", " HTTP", "table", "drop "]) for _ in range(rnd.randrange(9)))
        for p in PATTERNS.values():
            needed = R.required_literals(p)
            if needed and re.search(p.encode(), text.encode(), re.I | re.S):
                assert any(x in text.lower() for x in needed)


def test_index_equals_one_by_one(spark, monkeypatch, rows):
    rnd = random.Random(2)
    bits = ["select", "SELECT", "union into", "Insert  into", " ", "password=1x", "drop table", "or", "7", "admin", "'root'", "ababcdef", "onetwofour", "fivesix", "étude", "xayzzy", "GET / HTTP", "ſ", "abc", "\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(8))) for _ in range(600)] + [None, "", "sel", "select " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "packet_id long, payload string")
    rules = spark.createDataFrame(list(PATTERNS.items()), "name string, pattern string")
    one_by_one = rows(S.matches(df, rules))
    monkeypatch.setattr(S, "INLINE", 0)
    assert rows(S.matches(df, rules)) == one_by_one and len({n for _, n in one_by_one}) >= 10
    monkeypatch.setattr(R, "BROADCAST_BYTES", 0)
    assert rows(S.matches(df, rules)) == one_by_one


def test_index_keeps_the_newest_pattern_and_replaces_built_in_ones(spark, monkeypatch, rows):
    monkeypatch.setattr(S, "INLINE", 0)
    df = spark.createDataFrame([(1, "<script>"), (2, "newest"), (3, "oldest")], "packet_id long, payload string")
    rules = spark.createDataFrame([("xss", "oldest", 1), ("xss", "newest", 2)], "name string, pattern string, id long")
    assert rows(S.matches(df, rules)) == [(2, "xss")]


def test_many_rules_cost_no_more_plan(spark, monkeypatch):
    df = spark.createDataFrame([(1, "rule 77 here")], "packet_id long, payload string")
    plans = []
    for n in (100, 5000):
        rules = spark.createDataFrame([(f"r{k}", f"rule {k} here") for k in range(n)], "name string, pattern string")
        found = S.matches(df, rules, include_builtin=False)
        assert [r["signature"] for r in found.collect()] == ["r77"]
        plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert all("BroadcastHashJoin" in p and "hashpartitioning" not in p for p in plans) and abs(len(plans[0]) - len(plans[1])) < 200


def test_rules_stay_off_the_driver(spark, monkeypatch, rows):
    """Neither the patterns nor what is made of them are collected, however the index is joined."""
    from pyspark.sql.classic.dataframe import DataFrame

    collected, collect = [], DataFrame.collect

    def counted(df):
        out = collect(df)
        collected.append(len(out))
        return out

    monkeypatch.setattr(DataFrame, "collect", counted)
    df = spark.createDataFrame([(1, "rule 77 here"), (1, "rule 77 here"), (2, "RULE 4999 here, rule 5 here"), (None, "rule 7 her"), (3, None)], "packet_id long, payload string")
    rules = spark.range(5000).selectExpr("'r' || id as name", "'rule ' || id || if(id % 2 = 0, ' here', ' (here|there)') as pattern")
    nothing = spark.createDataFrame([(None, "rule"), ("gone", None)], "name string, pattern string")
    for limit in (R.BROADCAST_BYTES, 0):
        monkeypatch.setattr(R, "BROADCAST_BYTES", limit)
        found = S.matches(df, rules.unionByName(nothing), include_builtin=False)
        assert max(collected, default=0) < 1000
        assert rows(found) == [(1, "r77"), (1, "r77"), (2, "r4999"), (2, "r5")]


def test_many_patterns_without_a_text_are_joined(spark, monkeypatch, rows):
    monkeypatch.setattr(S, "INLINE", 0)
    monkeypatch.setattr(S, "TESTED", 1)
    df = spark.createDataFrame([(1, "a7"), (2, "select"), (3, "")], "packet_id long, payload string")
    rules = spark.createDataFrame([("digit", "[0-9]"), ("short", "a."), ("long", "select"), ("xss", "zzzz")], "name string, pattern string")
    assert rows(S.matches(df, rules)) == [(1, "digit"), (1, "short"), (2, "long")]
