"""Aggregates, order, slices and query forms over solutions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as t
from ..functions.terms import decimal_text as _decimal_text, double_text as _double_text
from ..sources.mapping import Const
from .patterns import HIDDEN, Shape, Solutions


@dataclass(frozen=True)
class Aggregate:
    kind: str
    var: str | None = None
    distinct: bool = False


def count(var: str | None = None, distinct: bool = False) -> Aggregate:
    """COUNT of a variable's bound values, or of rows."""
    return Aggregate("count", var, distinct)


def sum_(var: str, distinct: bool = False) -> Aggregate:
    return Aggregate("sum", var, distinct)


def avg(var: str, distinct: bool = False) -> Aggregate:
    return Aggregate("avg", var, distinct)


def min_(var: str) -> Aggregate:
    """The least value; DISTINCT makes no difference."""
    return Aggregate("min", var)


def max_(var: str) -> Aggregate:
    return Aggregate("max", var)


def sample(var: str) -> Aggregate:
    return Aggregate("sample", var)


def group_concat(var: str) -> Aggregate:
    """Lexical forms joined by spaces, in their order. The result is one string of the group, so groups must fit in a row."""
    return Aggregate("group_concat", var)


def all_true(var: str) -> Aggregate:
    return Aggregate("all_true", var)


def any_true(var: str) -> Aggregate:
    return Aggregate("any_true", var)


def count_true(var: str) -> Aggregate:
    return Aggregate("count_true", var)


def exists(var: str) -> Aggregate:
    """Whether any value is bound."""
    return Aggregate("exists", var)


def is_empty(var: str) -> Aggregate:
    return Aggregate("is_empty", var)


def _number(x) -> tuple[Column, Column]:
    """Widest level of terms, null if one is bound and not a number; and how many are bound."""
    n = F.count(x.raw if isinstance(x, t.Val) else t.col(x))
    return F.when(F.count(t.level(x)) == n, F.coalesce(F.max(t.level(x)), F.lit(0))), n


def _by_level(x, top: Column, **of) -> Column:
    """The branch of each level that terms can have."""
    known = x.level if isinstance(x, t.Val) else None
    out = None
    for level, made in enumerate(of.values()):
        if known is None or known == level or level == 0:  # without rows the level is 0
            out = F.when(top == level, made()) if out is None else out.when(top == level, made())
    return out


def _value(a: Aggregate, x: t.Val | Column | None, row: Column) -> t.Val | Column:
    plain = x.raw if isinstance(x, t.Val) else t.col(x)
    if a.kind == "count":
        counted = row if x is None else plain
        return t.val(F.count_distinct(counted) if a.distinct else F.count(F.lit(1) if x is None else counted), t.INTEGER)
    if a.kind == "sum":
        if isinstance(x, t.Val) and x.level == 0:
            return t.val(F.when(F.count(plain) == 0, F.lit(0)).otherwise(F.try_sum(t.v_int(x))).cast("decimal(38,0)"), t.INTEGER)
        top, n = _number(x)
        whole = F.coalesce(F.try_sum(t.v_int(x)), F.when(n == 0, F.lit(0).cast("decimal(38,0)")))
        return _by_level(
            x, top,
            integer=lambda: t.lit(whole.cast("decimal(38,0)"), t.INTEGER), decimal=lambda: t.lit(_decimal_text(F.try_sum(t.v_dec(x))), t.DECIMAL),
            float=lambda: t.lit(_double_text(F.sum(t.v_dbl(x)).cast("float")), t.FLOAT), double=lambda: t.lit(_double_text(F.sum(t.v_dbl(x))), t.DOUBLE),
        )
    if a.kind == "avg":
        top, n = _number(x)
        exact = lambda: t.lit(_decimal_text(F.try_divide(F.try_sum(t.v_dec(x).try_cast("decimal(28,10)")), n.cast("decimal(19,0)"))), t.DECIMAL)
        wide = lambda: F.sum(t.v_dbl(x)) / n
        levels = _by_level(x, top, integer=exact, decimal=exact, float=lambda: t.lit(_double_text(wide().cast("float")), t.FLOAT), double=lambda: t.lit(_double_text(wide()), t.DOUBLE))
        return F.when(n == 0, t.lit(0)).otherwise(levels)
    if a.kind in ("min", "max"):
        if isinstance(x, t.Val) and x.kind == t.LITERAL and x.text is None:
            return t.Val(x.kind, x.dt, (F.min if a.kind == "min" else F.max)(plain), ntz=x.ntz)
        known = F.when(x.isNotNull(), t.order_key(x))
        best = (F.min_by if a.kind == "min" else F.max_by)(plain, known)
        return t.Val(x.kind, x.dt, best, prefix=x.prefix) if isinstance(x, t.Val) else best
    if a.kind == "sample":
        some = F.any_value(plain, ignoreNulls=True)
        return t.Val(x.kind, x.dt, some, prefix=x.prefix, ntz=x.ntz) if isinstance(x, t.Val) else some
    if a.kind == "group_concat":
        return t.val(F.array_join(F.array_sort(F.collect_list(x["lex"])), " "), t.STRING)
    if a.kind == "count_true":
        return t.val(F.count_if(t.v_bool(x)), t.INTEGER)
    truth = {
        "all_true": lambda: F.coalesce(F.bool_and(t.v_bool(x)), F.lit(True)),
        "any_true": lambda: F.coalesce(F.bool_or(t.v_bool(x)), F.lit(False)),
        "exists": lambda: F.count(plain) > 0,
        "is_empty": lambda: F.count(plain) == 0,
    }
    return t.val(truth[a.kind](), t.BOOLEAN)


def group(sol: Solutions, keys: Sequence[str] = (), **aggregates: Aggregate) -> Solutions:
    """One row for each group of the keys; without keys one row, also over nothing.

    Aggregates of distinct numbers are computed over distinct terms, each beside the others.
    """
    keys = list(keys)
    unknown = {a.var for a in aggregates.values() if a.var is not None} | set(keys)
    if unknown - set(sol.variables):
        raise ValueError(f"unknown variables: {sorted(unknown - set(sol.variables))}")
    read = {a.var for a in aggregates.values() if a.kind not in ("count", "sample", "group_concat", "exists", "is_empty")} - {None}
    sol = sol.decoded(*sorted(read)) if read else sol
    by = [F.col(f"`{k}`") for k in keys]
    row = F.struct(*[F.col(f"`{v}`") for v in sol.variables]) if sol.variables else F.struct(F.lit(1))
    apart = {n: a for n, a in aggregates.items() if a.distinct and a.kind in ("sum", "avg")}
    made = {n: _value(a, None if a.var is None else sol[a.var], row) for n, a in aggregates.items()}
    raw = {n: (m.raw if isinstance(m, t.Val) else m).alias(n) for n, m in made.items()}
    plain = [c for n, c in raw.items() if n not in apart]
    out = sol.df.groupBy(*by).agg(*plain) if plain or keys and not apart else None
    for n, a in apart.items():
        once = Solutions(sol.df.select(*by, F.col(f"`{a.var}`")).distinct(), {*keys, a.var}, set(), sol.shapes).decoded(a.var)
        one = once.df.groupBy(*by).agg(raw[n])
        if out is None:
            out = one
        elif keys:
            renamed = one.select(*[c.alias(f"{HIDDEN}k_{k}") for k, c in zip(keys, by)], n)
            same = [out[k].eqNullSafe(renamed[f"{HIDDEN}k_{k}"]) for k in keys]
            for s in same[1:]:
                same[0] = same[0] & s
            out = out.join(renamed, same[0]).select(*out.columns, n)
        else:  # one row each
            out = out.crossJoin(one)
    kinds = dict(out.dtypes)
    shapes = {k: s for k, s in sol.shapes.items() if k in keys}
    shapes |= {n: Shape(m.kind, m.dt, m.prefix, kinds[n]) for n, m in made.items() if isinstance(m, t.Val)}
    return Solutions(out, set(keys) & sol.certain, set(aggregates) | set(keys) - sol.certain, shapes)


def first_rows(sol: Solutions, keys: Sequence[str], n: int, *order: str | tuple[str, str]) -> Solutions:
    """The first n rows of each group in the order of terms, for aggregates over the beginning of a sequence."""
    df, ways = _keyed(sol, order)
    window = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*ways)
    df = df.withColumn(f"{HIDDEN}nth", F.row_number().over(window)).filter(F.col(f"{HIDDEN}nth") <= n)
    return Solutions(df.select(*[f"`{v}`" for v in sol.variables]), sol.certain, sol.maybe, sol.shapes)


def _keyed(sol: Solutions, keys) -> tuple[DataFrame, list[Column]]:
    """Rows with a column for each key, so that a key is made once for each row, and the order by them."""
    keys = [(k, "asc") if isinstance(k, str) else k for k in keys]
    for name, _ in keys:
        if name not in sol.variables:
            raise ValueError(f"cannot order by unknown variable {name}")
    if keys:
        sol = sol.decoded(*[name for name, _ in keys])
    df = sol.df.select("*", *[t.order_key(sol[name]).alias(f"{HIDDEN}key{k}") for k, (name, _) in enumerate(keys)])
    return df, [F.col(f"{HIDDEN}key{k}").desc() if way == "desc" else F.col(f"{HIDDEN}key{k}").asc() for k, (_, way) in enumerate(keys)]


def order_by(sol: Solutions, *keys: str | tuple[str, str]) -> Solutions:
    """Keys are variables or (variable, 'asc' or 'desc'); they need not be selected later."""
    df, ways = _keyed(sol, keys)
    return Solutions(df.orderBy(*ways).select(*[f"`{v}`" for v in sol.variables]), sol.certain, sol.maybe, sol.shapes)


def limit(sol: Solutions, n: int) -> Solutions:
    return Solutions(sol.df.limit(n), sol.certain, sol.maybe, sol.shapes)


def offset(sol: Solutions, n: int) -> Solutions:
    return Solutions(sol.df.offset(n), sol.certain, sol.maybe, sol.shapes)


def distinct(sol: Solutions) -> Solutions:
    return Solutions(sol.df.select(*[f"`{v}`" for v in sol.variables]).distinct(), sol.certain, sol.maybe, sol.shapes)


def reduced(sol: Solutions) -> Solutions:
    """Duplicates may stay, and do."""
    return sol


def select(sol: Solutions, *names: str) -> Solutions:
    """Chosen variables, or all that aren't internal; one that isn't in scope is unbound."""
    names = names or tuple(n for n in sol.variables if not n.startswith(HIDDEN))
    columns = [(F.col(f"`{n}`") if n in sol.variables else t.UNBOUND()).alias(n) for n in names]
    return Solutions(sol.df.select(*columns), sol.certain & set(names), set(names) - sol.certain, sol.shapes)


def construct(sol: Solutions, *template: tuple) -> DataFrame:
    """(s, p, o, g): the template's triples for each solution, without those that are unbound, or whose subject is a literal
    or whose predicate is no IRI."""
    term = lambda x: x.struct if isinstance(x, Const) else t.col(sol[x.removeprefix("?")])
    each = F.array(*[F.struct(*[term(x).alias(n) for n, x in zip("spo", triple)]) for triple in template])
    rows = sol.df.select(F.explode(each).alias("q")).select("q.s", "q.p", "q.o")
    good = F.col("s.kind").isin(t.IRI, t.BLANK) & (F.col("p.kind") == t.IRI) & F.col("o").isNotNull()
    return rows.filter(good).distinct().withColumn("g", t.plain(t.DEFAULT_GRAPH, ""))


def ask(sol: Solutions) -> DataFrame:
    """(result): whether there is a solution."""
    return sol.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))


def disclose(sol: Solutions, names: Sequence[str] | None = None) -> Solutions | DataFrame:
    """Chosen variables; with an empty choice only whether there is a solution."""
    return ask(sol) if names is not None and not names else select(sol, *(names or ()))


def negatives(sol: Solutions, expected: Solutions) -> Solutions:
    """Rows of the pattern that an expected result lacks, counting repeats."""
    a, b = select(sol, *expected.variables)._aligned(expected)
    return Solutions(a.df.select(*b.variables).exceptAll(b.df.select(*b.variables)), a.certain, a.maybe, a.shapes)
