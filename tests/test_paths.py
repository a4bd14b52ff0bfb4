import random

import duckdb
import pytest

from quadframe.functions import terms as t
from quadframe.operators import paths
from quadframe.operators.patterns import bgp
from quadframe.plans import queries
from quadframe.plans.tables import quads
from quadframe.sources.mapping import EX, I, Quads


def graph_of(spark, edges, **kw):
    node = lambda x: (t.IRI, EX + x, "", "")
    return Quads(spark.createDataFrame([(node(a), node(p), node(b), (t.DEFAULT_GRAPH, "", "", "")) for a, p, b in edges], t.QUAD), **kw)


def walks(edges, most):
    """Pairs that 1 to most steps connect, by breadth-first search."""
    after, out = {}, set()
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for a in after:
        layer, depth = {a}, 0
        while layer and (most is None or depth < most):
            layer = {c for b in layer for c in after.get(b, ())} - {c for x, c in out if x == a}
            out |= {(a, c) for c in layer}
            depth += 1
    return out


@pytest.mark.parametrize("most", [1, 2, 3, None])
def test_closure_of_a_random_graph(spark, most):
    rng = random.Random(most or 9)
    edges = [(str(rng.randint(0, 25)), str(rng.randint(0, 25))) for _ in range(40)] + [("x", "y"), ("y", "z"), ("z", "x"), ("s", "s")]
    q = graph_of(spark, [(a, "p", b) for a, b in edges] * 2)
    got = paths.path(q, "?a", paths.plus(paths.link(I("p")), max_depth=most), "?b")
    rows = [(r["a"].removeprefix(EX), r["b"].removeprefix(EX)) for r in got.values(a=None, b=None).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == walks(edges, most)


def test_between_two_constants(spark):
    rng = random.Random(6)
    edges = [(str(rng.randint(0, 14)), str(rng.randint(0, 14))) for _ in range(16)] + [("x", "y"), ("y", "z"), ("z", "x")]
    q = graph_of(spark, [(a, "p", b) for a, b in edges])
    pairs = [("x", "x"), ("x", "z"), ("nobody", "x"), ("x", "nobody"), ("nobody", "nobody"), *((str(rng.randint(0, 14)), str(rng.randint(0, 14))) for _ in range(5))]
    for most in (2, None):
        want = walks(edges, most)
        for a, b in pairs:
            plus, star = (paths.path(q, I(a), f(paths.link(I("p")), max_depth=most), I(b)).df.count() for f in (paths.plus, paths.star))
            assert plus == ((a, b) in want), (a, b, most)
            assert star == ((a, b) in want or a == b), (a, b, most)


def test_rounds_join_numbers(spark, monkeypatch):
    """No round's plan reads terms: what is saved between the dictionary and the end are pairs of longs."""
    saved = []
    keep = paths.checkpointed
    monkeypatch.setattr(paths, "checkpointed", lambda df: saved.append(df) or keep(df))
    q = quads(spark, "/root/testdata/sf0.001", "conversations")
    paths.path(q, "?s", paths.plus(paths.link(I("next")), max_depth=None), "?o").df.count()
    edges, terms, *rounds = saved
    assert [f.dataType.simpleString() for f in edges.schema] == [t.TERM.simpleString()] * 2 and terms.columns == ["node", "term"]
    assert len(rounds) > 3 and all(r.dtypes == [("a", "bigint"), ("b", "bigint")] for r in rounds)
    assert not any("term" in r._jdf.queryExecution().executedPlan().toString() for r in rounds[1:])


def test_negated_predicates_are_not_read(spark):
    q = quads(spark, "/root/testdata/sf0.001", "supplier")
    got = paths.path(q, "?s", paths.nps(I("supplier_name"), I("supplier_acctbal")), "?o").df
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "s_nationkey" in plan and "s_name" not in plan and "s_acctbal" not in plan
    none = paths.path(q, "?s", paths.nps(*[I(p) for p in ("supplier_name", "supplier_acctbal", "supplier_nation")]), "?o").df
    assert none.count() == 0 and bgp(q, ("?s", "?p", "?o")).df.count() > 0


@pytest.mark.parametrize("turns", [[0, 1, 2], [0, 1, 2, 3, 4], [0, 2, 3, 5], [5], []])
def test_path_to_of_conversations_of_any_length(spark, tmp_path, turns):
    """The query's own SQL, also where the conversation has no turn 3 or lacks others."""
    rows = [(1, n, "user") for n in turns] + [(2, n, "user") for n in range(6)]
    spark.createDataFrame(rows, "conv_id int, turn int, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = duckdb.sql(queries.ORACLE_SQL["path_to"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in queries.QUERIES["path_to"](spark, str(tmp_path)).collect()) == sorted(want)
