"""Graph patterns against a naive evaluator over small random graphs, and against DuckDB on the test tables."""

import random
from collections import Counter

import pytest

from quadframe.functions import expr as e
from quadframe.functions import terms as t
from quadframe.operators import paths, post
from quadframe.operators.patterns import Solutions, bgp, graph, values
from quadframe.sources.mapping import I, L, Quads

NODES = [I(f"n{k}") for k in range(4)]
PREDICATES = [I("p"), I("q"), I("r")]


def random_quads(seed, n=24):
    rng = random.Random(seed)
    return sorted({(rng.choice(NODES), rng.choice(PREDICATES), rng.choice(NODES)) for _ in range(n)}, key=str)


def frame(spark, triples, graphs=None):
    row = lambda c: (c.kind, c.lex, c.dt, c.lang)
    default = (t.DEFAULT_GRAPH, "", "", "")
    rows = [(*map(row, x), row(graphs[k]) if graphs and graphs[k] else default) for k, x in enumerate(triples)]
    return Quads(spark.createDataFrame(rows, t.QUAD))


def naive_bgp(triples, *patterns):
    out = [{}]
    for pattern in patterns:
        found = []
        for m in out:
            for triple in triples:
                new = dict(m)
                if all((x == v) if not isinstance(x, str) else new.setdefault(x[1:], v) == v for x, v in zip(pattern, triple)):
                    found.append(new)
        out = found
    return out


def fits(a, b):
    return all(a[k] == b[k] for k in a.keys() & b.keys())


def bag(rows):
    return Counter(frozenset((k, v.lex) for k, v in m.items()) for m in rows)


def got(sol: Solutions):
    return Counter(frozenset((n, r[n]["lex"]) for n in sol.variables if r[n] is not None) for r in sol.terms().collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_operators_match_naive_evaluation(spark, seed):
    triples = random_quads(seed)
    q = frame(spark, triples)
    shapes = {"a": [("?x", PREDICATES[0], "?y")], "b": [("?y", PREDICATES[1], "?z")], "c": [("?x", PREDICATES[2], "?z")]}
    rows = {k: naive_bgp(triples, *p) for k, p in shapes.items()}
    sols = {k: bgp(q, *p) for k, p in shapes.items()}

    def left_join(left, right, keep=lambda m: True):
        out = []
        for a in left:
            pairs = [{**a, **b} for b in right if fits(a, b) and keep({**a, **b})]
            out += pairs or [a]
        return out

    assert got(sols["a"].join(sols["b"])) == bag({**x, **y} for x in rows["a"] for y in rows["b"] if fits(x, y))
    optional, rows_opt = sols["a"].optional(sols["b"]), left_join(rows["a"], rows["b"])
    assert got(optional) == bag(rows_opt)
    assert got(sols["a"].union(sols["b"])) == bag(rows["a"] + rows["b"])
    # z may be unbound on the left now.
    assert got(optional.join(sols["c"])) == bag({**x, **y} for x in rows_opt for y in rows["c"] if fits(x, y))
    assert got(optional.optional(sols["c"])) == bag(left_join(rows_opt, rows["c"]))
    keep = lambda m: m["x"] != m["z"]
    assert got(optional.optional(sols["c"], lambda s: ~e.same_term(s["x"], s["z"]))) == bag(left_join(rows_opt, rows["c"], keep))
    assert got(optional.exists(sols["c"])) == bag(x for x in rows_opt if any(fits(x, y) for y in rows["c"]))
    assert got(optional.not_exists(sols["c"])) == bag(x for x in rows_opt if not any(fits(x, y) for y in rows["c"]))
    lone = bgp(q, ("?z", PREDICATES[0], "?w"))
    rows_lone = naive_bgp(triples, ("?z", PREDICATES[0], "?w"))
    assert got(optional.minus(lone)) == bag(x for x in rows_opt if not any(fits(x, y) and x.keys() & y.keys() for y in rows_lone))
    assert got(sols["a"].minus(bgp(q, ("?u", PREDICATES[1], "?v")))) == bag(rows["a"])


def test_repeated_and_blank_nodes_and_graphs(spark):
    triples = [(NODES[0], PREDICATES[0], NODES[0]), (NODES[0], PREDICATES[0], NODES[1]), (NODES[0], PREDICATES[0], NODES[1]), (NODES[1], PREDICATES[1], NODES[2])]
    q = frame(spark, triples, [None, I("g1"), I("g2"), I("g1")])
    assert got(bgp(q, ("?x", PREDICATES[0], "?x"))) == bag([{"x": NODES[0]}])
    assert got(bgp(q, ("?x", PREDICATES[0], "_:b"), ("_:b", PREDICATES[1], "?y"))) == bag([{"x": NODES[0], "y": NODES[2]}])
    assert got(graph(q, "?g", ("?x", PREDICATES[0], "?y"))) == bag([{"g": g, "x": NODES[0], "y": NODES[1]} for g in (I("g1"), I("g2"))])
    assert got(graph(q, "?g", ("?x", PREDICATES[0], "?y"), ("?y", PREDICATES[1], "?z"))) == bag([{"g": I("g1"), "x": NODES[0], "y": NODES[1], "z": NODES[2]}])
    strict = Quads(q.df, "strict")
    assert got(bgp(strict, ("?x", PREDICATES[0], "?y"))) == bag([{"x": NODES[0], "y": NODES[0]}])
    with pytest.raises(ValueError):
        Quads(q.df, "other")


def test_paths(spark):
    a, b, c, d = NODES
    q = frame(spark, [(a, PREDICATES[0], b), (b, PREDICATES[0], c), (c, PREDICATES[0], a), (c, PREDICATES[1], d)])
    p = paths.link(PREDICATES[0])
    pairs = lambda expr, s="?s", o="?o", **k: {(r["s"]["lex"][-1] if "s" in r else None, r["o"]["lex"][-1]) for r in paths.path(q, s, expr, o, **k).df.collect()}
    assert pairs(paths.plus(p), max_depth=1) == {("0", "1"), ("1", "2"), ("2", "0")}
    assert pairs(paths.plus(p), max_depth=None) == {(x, y) for x in "012" for y in "012"}
    assert ("3", "3") in pairs(paths.star(p)) and ("2", "3") not in pairs(paths.star(p))
    assert pairs(paths.seq(paths.star(p, 0), paths.nps(PREDICATES[0]))) == {("2", "3")}
    assert paths.path(q, I("n9"), paths.star(p), "?o").df.count() == 1
    assert paths.path(q, I("n9"), paths.star(p), I("n9")).df.count() == 1
    assert paths.path(q, a, paths.star(p, 0), b).df.count() == 0
    with pytest.raises(ValueError):
        paths.plus(p, 0)
    with pytest.raises(ValueError):
        paths.path(q, "?s", p, "?o", max_depth=0)


def numbers(spark, *literals):
    return values(spark, ["v"], [[x] for x in literals])


@pytest.mark.parametrize(
    ("given", "aggregate", "want"),
    [
        ([L(9007199254740992), L(1)], post.sum_("v"), ("9007199254740993", t.INTEGER)),
        ([L(10**30), L(2 * 10**30)], post.sum_("v"), (str(3 * 10**30), t.INTEGER)),
        ([L("0.1", t.DECIMAL), L("0.2", t.DECIMAL)], post.avg("v"), ("0.15", t.DECIMAL)),
        ([L(1), L("0.5", t.DECIMAL)], post.sum_("v"), ("1.5", t.DECIMAL)),
        ([L(9007199254740993), L(9007199254740992)], post.max_("v"), ("9007199254740993", t.INTEGER)),
        ([L(9007199254740993), L(9007199254740992)], post.min_("v"), ("9007199254740992", t.INTEGER)),
        ([L(1), L("1.0", t.DECIMAL), L(1)], post.sum_("v", distinct=True), ("2", t.DECIMAL)),
        ([L(1), L("x")], post.sum_("v"), None),
        ([L(1), L("x"), L("x")], post.count("v", distinct=True), ("2", t.INTEGER)),
    ],
)
def test_aggregates_are_exact(spark, given, aggregate, want):
    row = post.group(numbers(spark, *given), n=aggregate).terms().first()["n"]
    assert row is None if want is None else (row["lex"], row["dt"]) == want


def test_empty_group_order_and_slice(spark):
    none = numbers(spark, L(1)).filter(t.F.lit(False))
    out = post.group(none, n=post.count(), s=post.sum_("v"), a=post.avg("v"), m=post.min_("v")).terms().first()
    assert (out["n"]["lex"], out["s"]["lex"], out["a"]["lex"], out["m"]) == ("0", "0", "0", None)
    mixed = numbers(spark, L("b"), L(10), L(9007199254740993), L(9007199254740992), I("x"), None, L("9.5", t.DECIMAL))
    order = [r["v"] and r["v"]["lex"] for r in post.order_by(mixed, "v").terms().collect()]
    assert order == [None, I("x").lex, "9.5", "10", "9007199254740992", "9007199254740993", "b"]
    assert [r["v"]["lex"] for r in post.limit(post.offset(post.order_by(numbers(spark, L(30), L(10), L(20)), "v"), 1), 1).terms().collect()] == ["20"]
    with pytest.raises(ValueError):
        post.order_by(mixed, "nothing")


def test_known_types_reach_the_scan(spark):
    from quadframe.plans.tables import quads

    q = quads(spark, "/root/testdata/sf0.001", "orders", "customer")
    sol = bgp(q, ("?o", I("total"), "?t"), ("?o", I("date"), "?d"), ("?o", I("cust"), "?c"), ("?c", I("customer_name"), "?n"))
    sol = sol.filter(e.gt(sol["t"], L(400000).column) & e.lt(sol["d"], L("1996-01-01T00:00:00Z", t.DATETIME).column))
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(sol.values(n=None)._jdf.queryExecution(), "formatted")
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert any("GreaterThan(o_totalprice,400000.0)" in line and "LessThan(o_orderdate," in line for line in pushed), pushed
    assert not any(word in plan for word in ("lambda", "RLIKE", "concat", "regexp"))


def test_unsure_joins_match_by_what_both_sides_have_bound(spark):
    """Two variables, either of which may be unbound on both sides; every operator against loops over pairs."""
    rng = random.Random(3)
    pick = lambda: {n: v for n in "xy" if (v := rng.choice([None, *NODES]))}
    a, b = [{**pick(), "l": L(k)} for k in range(25)], [{**pick(), "r": L(k)} for k in range(20)]

    def inline(rows, names):
        return values(spark, names, [[row.get(n) for n in names] for row in rows])

    left, right = inline(a, ["x", "y", "l"]), inline(b, ["x", "y", "r"])
    both = lambda m, n: any(k in n for k in m)
    assert got(left.join(right)) == bag({**m, **n} for m in a for n in b if fits(m, n))
    assert got(left.exists(right)) == bag(m for m in a if any(fits(m, n) for n in b))
    assert got(left.minus(right)) == bag(m for m in a if not any(fits(m, n) and both(m, n) for n in b))
    lone = [m for m in a if "x" in m]
    some = inline(lone, ["x", "y", "l"]).optional(right.filter(right["x"].isNotNull()))
    want = [{**m, **n} for m in lone for n in b if "x" in n and fits(m, n)]
    want += [m for m in lone if not any("x" in n and fits(m, n) for n in b)]
    assert got(some) == bag(want)


def test_unsure_joins_read_each_side_once_and_have_no_nested_loop(spark):
    left = values(spark, ["x", "y"], [[NODES[0], None], [NODES[1], NODES[2]], [NODES[2], NODES[2]]])
    right = values(spark, ["x", "y"], [[None, NODES[2]], [NODES[0], NODES[1]], [NODES[1], NODES[2]]])
    out = left.join(values(spark, ["y", "z"], [[NODES[2], L(1)], [NODES[1], L(2)]]))
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    # A row without y is compatible with every partner, which is a product by meaning; all others are keyed.
    assert plan.count("NestedLoop") + plan.count("CartesianProduct") == 1
    keyed = Solutions(left.df.filter("y is not null"), left.certain, left.maybe, left.shapes).join(right.filter(right["y"].isNotNull()))
    assert got(keyed) == Counter({frozenset({("x", NODES[1].lex), ("y", NODES[2].lex)}): 2, frozenset({("x", NODES[2].lex), ("y", NODES[2].lex)}): 1})
    plan = keyed.df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and plan.count("Scan ExistingRDD") == 2
