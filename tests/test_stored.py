"""Quad tables laid out by predicate and subject, against the same quads without a layout."""

import pytest
from pyspark.sql import functions as F

from quadframe.functions import expr as e
from quadframe.functions import terms as t
from quadframe.operators import patterns
from quadframe.operators.patterns import bgp, graph
from quadframe.sources import stored
from quadframe.sources.mapping import EX, Const, I, L, Object, Quads, Table

B = [Const(t.BLANK, "b0"), Const(t.BLANK, "b1")]
GRAPHS = [Const(t.DEFAULT_GRAPH, ""), I("g1"), I("g2")]
TRIPLES = [
    *[(I(f"s{k}"), I("age"), L(k % 4)) for k in range(12)],
    *[(I(f"s{k}"), I("knows"), I(f"s{(k * 5 + 1) % 12}")) for k in range(12)],
    *[(I(f"s{k}"), I("name"), L(f"n{k}")) for k in range(0, 12, 2)],
    *[(I(f"s{k}"), I("mixed"), x) for k, x in enumerate([L(1), L("01", t.INTEGER), L("1"), L("x", lang="en"), I("s1"), B[0], L("1.50", t.DECIMAL)])],
    (B[0], I("knows"), B[1]), (B[0], I("age"), L(2)), (I("s1"), I("score"), L(1.5)), (I("s2"), I("score"), L("2", t.DOUBLE)),
]
PATTERNS = [
    [("?x", I("age"), "?a"), ("?x", I("name"), "?n")],
    [("?x", I("age"), L(2)), ("?x", I("knows"), "?y"), ("?y", I("age"), "?a")],
    [("?x", I("mixed"), "?m")],
    [("?x", I("mixed"), "?m"), ("?m", I("age"), "?a")],
    [("?x", I("score"), "?v"), ("?x", I("knows"), "?x2")],
    [("?x", "?p", B[1])],
    [(I("s1"), "?p", "?o")],
    [("?x", I("none"), "?y")],
    [("?x", I("knows"), "?x")],
]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    row = lambda c: (c.kind, c.lex, c.dt, c.lang)
    rows = [(*map(row, x), row(g)) for k, x in enumerate(TRIPLES) for g in (GRAPHS[k % 3], GRAPHS[(k * 7 + 1) % 3])]
    rows += [(None, row(I("age")), row(L(1)), row(GRAPHS[0])), (*map(row, TRIPLES[0]), None), (*map(row, TRIPLES[0]), row(GRAPHS[0]))]
    df, path = spark.createDataFrame(rows, t.QUAD), "file://" + str(tmp_path_factory.mktemp("stored") / "quads")
    stored.save(df, path, 4)
    return Quads(df.filter("s is not null and g is not null")), stored.Stored(spark, path), path


def rows(sol):
    return sorted(map(str, sol.terms().collect()))


@pytest.mark.parametrize("k", range(len(PATTERNS)))
def test_patterns_match_the_table(both, k):
    plain, laid, _ = both
    assert rows(bgp(laid, *PATTERNS[k])) == rows(bgp(plain, *PATTERNS[k]))


def test_graphs_and_the_strict_default_match(spark, both):
    plain, laid, path = both
    pattern = [("?x", I("age"), "?a"), ("?x", I("knows"), "?y")]
    distinct = Quads(plain.df.distinct())
    assert rows(graph(laid, "?g", *pattern)) == rows(graph(distinct, "?g", *pattern))
    assert rows(graph(laid, I("g1"), *pattern)) == rows(graph(distinct, I("g1"), *pattern))
    strict = bgp(stored.Stored(spark, path, "strict"), *pattern)
    assert rows(strict) == rows(bgp(Quads(plain.df.distinct(), "strict"), *pattern))
    left = laid.without([I("age").lex, I("mixed").lex])
    assert rows(bgp(left, ("?s", "?p", "?o"))) == rows(bgp(distinct.without([I("age").lex, I("mixed").lex]), ("?s", "?p", "?o")))
    assert sorted(map(str, laid.quads().collect())) == sorted(map(str, distinct.df.collect()))


def test_a_star_is_one_pass_and_typed_filters_reach_the_scan(spark, both):
    _, laid, _ = both
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sol = bgp(laid, ("?x", I("age"), "?a"), ("?x", I("name"), "?n"), ("?x", I("knows"), "?y"))
        sol = sol.filter(e.gt(sol["a"], L(1).column))
        plan = sol.df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "GreaterThan(whole,1)" in plan and "PartitionFilters: [isnotnull(pred" in plan
    assert "ReadSchema: struct<s:string,whole:bigint>" in plan


def test_reopened_tables_and_large_buckets_give_the_same(spark, both, monkeypatch):
    plain, _, path = both
    for table in ("quads", "triples"):
        spark.sql(f"DROP TABLE {stored._name(path, table)}")
    again = stored.Stored(spark, path)
    assert rows(bgp(again, *PATTERNS[1])) == rows(bgp(plain, *PATTERNS[1]))
    monkeypatch.setattr(stored, "LARGE", 0)
    monkeypatch.setattr(stored, "SKEW", 0)
    assert rows(bgp(stored.Stored(spark, path), *PATTERNS[1])) == rows(bgp(plain, *PATTERNS[1]))


def test_no_quads(spark, tmp_path):
    path = "file://" + str(tmp_path / "none")
    stored.save(spark.createDataFrame([], t.QUAD), path)
    assert bgp(stored.Stored(spark, path), ("?x", I("age"), "?a"), ("?x", "?p", "?o")).terms().collect() == []


def test_mapped_tables_are_dealt_as_rows_and_their_quads_are_distinct(spark, tmp_path):
    people = spark.createDataFrame([(1, "a", 2.5), (1, "a", 2.5), (1, "b", 2.5), (2, None, 1.0), (3, None, None), (4, "c", None)], "id bigint, name string, score double")
    more = spark.createDataFrame([(1, "en"), (2, None), (2, "fr")], "id bigint, lang string")
    named = {EX + "name": Object("name"), EX + "score": Object("score", dt=t.DOUBLE)}
    plain = Quads([Table(people, "people", ["id"], named), Table(more, "more", ["id"], {EX + "says": Object("lang", lang="lang")}, subject_of="people")])
    again = Quads([*plain.tables, Table(more, "again", ["id"], {EX + "name": Object("lang")}, subject_of="people")])
    for k, q in enumerate((plain, again)):
        path = f"file://{tmp_path}/{k}"
        stored.save(q, path, 3)
        assert sorted(map(str, stored.Stored(spark, path).quads().collect())) == sorted(map(str, q.quads().distinct().collect()))
        distinct = Quads(q.quads().distinct())
        for pattern in PATTERNS[2:6] + [[("?x", I("name"), "?n"), ("?x", I("score"), "?v")], [("?x", I("says"), "?l")]]:
            assert rows(bgp(stored.Stored(spark, path), *pattern)) == rows(bgp(distinct, *pattern))
    plan = stored._of_table(plain.tables[0], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")


def test_only_numbers_as_they_are_written_are_values(spark):
    texts = ["1.0", "1.00", "-0.0", "1.0E10", "1e10", "NaN", "INF", "-INF", "Infinity", "-Infinity", "+INF", "nan", "1.0d", " 1.0", "x", ""]
    o = t.plain(t.LITERAL, F.col("x"), t.DOUBLE)
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", o.alias("o"))
    got = {r["x"]: str(r["real"]) for r in df.select("x", stored._typed(df["o"])["real"]).collect() if r["real"] is not None}
    assert got == {"1.0": "1.0", "-0.0": "-0.0", "1.0E10": "10000000000.0", "NaN": "nan", "INF": "inf", "-INF": "-inf"}


def test_sides_of_many_rows_are_merged_however_small_their_files_are(both, monkeypatch):
    plain, laid, _ = both
    steps = [("?x", I("knows"), "?y"), ("?y", I("age"), "?a")]
    planned = lambda sol: sol.df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in planned(bgp(laid, *steps))
    monkeypatch.setattr(patterns, "MANY", 12)
    assert "BroadcastHashJoin" not in planned(bgp(laid, *steps)) and "BroadcastHashJoin" not in planned(graph(laid, "?g", *steps))
    assert rows(bgp(laid, *steps)) == rows(bgp(plain, *steps))
    assert "BroadcastHashJoin" in planned(bgp(laid, *steps, ("?y", I("score"), "?n")))
    distinct = Quads(plain.df.distinct())
    assert rows(graph(laid, "?g", *steps)) == rows(graph(distinct, "?g", *steps))
