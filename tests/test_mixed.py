"""Terms of mixed types: their values beside them, and their order as one binary key."""

import math
import random
import re
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quadframe.functions import expr as e
from quadframe.functions import terms as t
from quadframe.operators import post
from quadframe.operators.patterns import Shape, Solutions
from quadframe.sources.mapping import L

LEXICAL = ["", "0", "-0", "+07", "1", "-1", "12", "-12", "1.5", "-1.50", ".5", "1.", "x", "NaN", "INF", "-INF", "1e3", "-2.5E-3", "4.9e-324", "-1e-310", "1e308", "0.0", "-0.0", "9007199254740993", "9007199254740992",
           "-9007199254740993", "1" * 30, "-" + "1" * 30, "1" * 45, "0.0000000001", "true", "false", "\0", "a\0", "a\0\1", "a", "ab", "é", "😀", "P1D", "PT1H", "-PT90.5S", "P", "PT", "P1DT", "P1DT2H3M4S",
           "1969-12-31T23:59:59.5Z", "2020-01-01T00:00:00Z", "2020-01-01T02:00:00+02:00", "2020-13-01T00:00:00Z", "1969-12-31", "2020-02-29", "2020-02-30", "10:00:00Z", "25:00:00"]
TYPES = [t.INTEGER, t.XSD + "byte", t.DECIMAL, t.FLOAT, t.DOUBLE, t.BOOLEAN, t.STRING, t.DATETIME, t.DATE, t.TIME, t.DURATION, "urn:x", "urn:x\0"]


def some_terms():
    rng = random.Random(3)
    out = [None] * 3 + [(kind, x, "", "") for kind in (t.IRI, t.BLANK) for x in ("a", "a\0", "b", "")] + [(t.LITERAL, x, t.LANG_STRING, g) for x in ("a", "b") for g in ("en", "fr")]
    out += [(t.LITERAL, x, dt, "") for x in LEXICAL for dt in TYPES]
    out += [(t.LITERAL, repr(rng.uniform(-1, 1) * 10 ** rng.randint(-320, 308)), rng.choice([t.DOUBLE, t.FLOAT]), "") for _ in range(200)]
    out += [(t.LITERAL, f"{rng.randint(-(10**k), 10**k)}.{rng.randint(0, 10**9)}", t.DECIMAL, "") for k in range(20) for _ in range(8)]
    out += [(t.LITERAL, str(rng.choice([2**60, -(2**60), 2**53, 10]) + rng.randint(-3, 3)), rng.choice([t.INTEGER, t.DECIMAL, t.DOUBLE]), "") for _ in range(200)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def sol(spark):
    rows = [(k, x) for k, x in enumerate(some_terms())]
    df = spark.createDataFrame(rows, t.T.StructType([t.T.StructField("k", t.T.LongType()), t.T.StructField("v", t.TERM)])).cache()
    return Solutions(df, {"k"}, {"v"}, {"k": Shape(t.LITERAL, t.INTEGER, "", "bigint")})


def read(sol, v):
    return {r["k"]: tuple(r)[1:] for r in sol.df.select("k", *[f(v).alias(n) for n, f in t.READERS.items()]).collect()}


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)


def test_values_are_those_of_the_text(sol):
    plain, decoded = read(sol, sol["v"]), read(sol.decoded(), sol.decoded()["v"])
    terms = dict(sol.df.collect())
    assert [(terms[k], plain[k], decoded[k]) for k in plain if not all(map(same, plain[k], decoded[k]))] == []
    assert sum(x[2] is not None for x in plain.values()) > 300


def place(x, values):
    """The order by plain comparisons: exact ones by whole numbers and fractions."""
    if x is None:
        return (0,)
    if x["kind"] != t.LITERAL:
        return (1 if x["kind"] == t.BLANK else 2, x["lex"].encode(), x["dt"].encode(), x["lang"].encode())
    end = tuple(x[n].encode() for n in ("lex", "dt", "lang"))
    _, whole, exact, double, truth, ts, date, *_ = values
    if double is not None:
        at = (1, 0.0) if math.isnan(double) else (0, double)
        exact = whole if exact is None else exact
        return (3, *at, (0, 0) if exact is None else (1, Fraction(Decimal(exact))), *end)
    return (4, truth, *end) if truth is not None else (5, ts, *end) if ts is not None else (6, date, *end) if date is not None else (7, *end)


def test_byte_order_is_the_order_of_terms(sol):
    values, terms = read(sol, sol["v"]), dict(sol.df.collect())
    want = sorted(terms, key=lambda k: place(terms[k], values[k]))
    for x in (sol["v"], sol.decoded()["v"]):
        got = [r["k"] for r in sol.decoded().df.select("k", t.order_key(x).alias("key")).orderBy("key", "k").collect()]
        assert [terms[k] for k in got] == [terms[k] for k in want]
    ordered = post.order_by(sol, "v", "k")
    assert [terms[r["k"]] for r in ordered.df.collect()] == [terms[k] for k in want] and ordered.df.columns == ["k", "v"]
    plan = post.order_by(sol, ("v", "desc"), "k").df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Sort \[__key0#\d+ DESC NULLS LAST, __key1#\d+ ASC NULLS FIRST\]", plan)
    got = post.group(sol, low=post.min_("v"), high=post.max_("v"), n=post.count("v")).df.first()
    bound = [k for k in want if terms[k] is not None]
    assert (got["low"], got["high"], got["n"]) == (terms[bound[0]], terms[bound[-1]], len(bound))


def test_nested_numbers(sol):
    """-|v + v * 0.5| of exact numbers, against fractions; errors are null."""
    v = sol.decoded()["v"]
    nested = e.minus(e.abs_(e.add(v, e.multiply(v, L("0.5", t.DECIMAL).column))))
    rows = sol.decoded().df.select(t.v_dec(v).alias("x"), t.level(v).alias("n"), t.v_dec(nested).alias("y"), nested["dt"].alias("dt"), e.bound(nested).alias("some")).collect()
    small = [r for r in rows if r["n"] in (0, 1) and r["x"] is not None and abs(r["x"]) < 10**10 and r["x"] * 2 == int(r["x"] * 2)]
    assert len(small) > 20 and all(r["y"] == -abs(r["x"] * 3 / 2) and r["dt"] == t.DECIMAL for r in small)
    assert not any(r["some"] for r in rows if r["n"] is None)


def test_functions_of_decoded_terms(spark):
    given = [L(3), L("2.5", t.DECIMAL), L("x"), L("7", t.DOUBLE), L(True), None]
    s = Solutions(spark.createDataFrame([(k, None if x is None else (x.kind, x.lex, x.dt, x.lang)) for k, x in enumerate(given)], t.T.StructType([t.T.StructField("k", t.T.LongType()), t.T.StructField("v", t.TERM)])), {"k"}, {"v"}, {"k": Shape(t.LITERAL, t.INTEGER, "", "bigint")}).decoded("v")
    v, three = s["v"], L(3).column
    made = {"round": e.round_(v)["lex"], "divide": e.divide(v, L(2).column)["lex"], "if": e.add(e.if_(e.lt(v, three), v, three), L(1).column)["lex"], "coalesce": e.coalesce(e.add(v, three), v)["lex"], "ebv": e.ebv(v), "error": e.ebv(e.divide(v, L(0).column)), "cast": e.to_integer(v)["lex"]}
    got = {n: [r[n] for r in s.df.select("k", *[x.alias(n) for n, x in made.items()]).orderBy("k").collect()] for n in made}
    assert got == {
        "round": ["3", "3", None, "7.0", None, None], "divide": ["1.5", "1.25", None, "3.5", None, None], "if": ["4", "3.5", None, "4", None, None], "coalesce": ["6", "5.5", "x", "10.0", "true", None],
        "ebv": [True, True, True, True, True, None], "error": [None, None, None, True, None, None], "cast": ["3", "2", None, "7", "1", None],
    }


def test_filters_read_text_once(sol):
    s = sol.decoded("v")
    v = s["v"]
    kept = s.filter((e.gt(v, L(3).column) & e.lt(e.multiply(v, v), L(400).column)) | e.ge(v, L("2000-01-01T00:00:00Z", t.DATETIME).column)).bind("w", e.add(v, L(1).column))
    plan = kept.df._jdf.queryExecution().optimizedPlan().toString()
    patterns = re.findall(r"RLIKE\([^,]*, (.*?\\z)\)", plan)
    assert len(patterns) == 6 == len(set(patterns)), patterns
    assert "transform(" not in plan
    values = read(sol, sol["v"])
    low = max(x[5] for x in values.values() if x[5] is not None and x[5].year < 2000)
    want = {k for k, x in values.items() if x[3] is not None and 3 < x[3] and x[3] * x[3] < 400 or x[5] is not None and x[5] > low}
    assert {r["k"] for r in kept.df.collect()} == want
