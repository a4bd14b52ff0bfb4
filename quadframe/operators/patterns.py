"""Solutions of graph patterns, and the operators between them.

A solution is a row with a column for each variable; unbound is null. A variable whose terms all have one type has a
shape, and its column holds the plain value: a key, a number, a timestamp. Other variables hold terms as structs. Joins of
equal shapes compare plain values.

Solutions know which variables are bound in every row (certain) and which may not be (maybe). Where sides share a certain
variable, a join is one equi-join on those, and what may be unbound is a condition on the pairs that it finds. Without one
both sides are saved with a mask of what is bound in each row, and one equi-join matches rows on what both have bound; only
rows that have nothing bound in common are a product, as their meaning is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t
from ..functions.expr import same_term
from ..sources.mapping import Const, Quads
from ..sources.scratch import checkpointed

HIDDEN = "__"
#: Rows of a side that isn't broadcast.
MANY = 250_000
_MASK = f"{HIDDEN}mask"
_VALUES = f"{HIDDEN}values_"


def _partners(mask: Column, pairs: Sequence[tuple[int, int]]) -> Column:
    """The second numbers of the pairs whose first is the mask, null if there are none."""
    of = {m: [b for a, b in pairs if a == m] for m, _ in pairs}
    return reduce(lambda out, m: out.when(mask == m, F.array(*map(F.lit, of[m]))), of, F.when(F.lit(False), F.array(F.lit(0))))


@dataclass(frozen=True)
class Shape:
    """The one type of a variable's terms; sql is the type of the plain values."""

    kind: int
    dt: str
    prefix: str
    sql: str


class Solutions:
    def __init__(self, df: DataFrame, certain: set[str], maybe: set[str] = frozenset(), shapes: dict[str, Shape] | None = None):
        self.df, self.certain, self.maybe, self.saved = df, set(certain), set(maybe), False
        self.read: set[str] = set()
        #: How many rows there are about, where a layout knows; else 0.
        self.rows = 0
        self.shapes = {n: s for n, s in (shapes or {}).items() if n in self.certain or n in self.maybe}

    @property
    def variables(self) -> list[str]:
        return sorted(self.certain | self.maybe)

    def __getitem__(self, name: str) -> t.Val | t.Mixed | Column:
        """The term of a variable; null for one that isn't bound here."""
        if name not in self.certain and name not in self.maybe:
            return t.UNBOUND()
        shape = self.shapes.get(name)
        if shape is None:
            return t.mixed(F.col(f"`{name}`"), F.col(f"`{_VALUES}{name}`")) if name in self.read else F.col(f"`{name}`")
        return t.Val(shape.kind, shape.dt, F.col(f"`{name}`"), name in self.certain, shape.prefix, ntz=shape.sql == "timestamp_ntz")

    def _with(self, df: DataFrame, certain=None, maybe=None) -> Solutions:
        return Solutions(df, self.certain if certain is None else certain, self.maybe if maybe is None else maybe, self.shapes)

    def decoded(self, *names: str) -> Solutions:
        """Variables of mixed types, by default all of them, with their values read from their text once for each row.

        Filters and bindings keep these values; after another operator, a variable can be decoded again.
        """
        names = [n for n in names or self.variables if n in self.variables and n not in self.shapes and n not in self.read]
        df = self.df
        for n in names:
            # A generator: the optimizer would copy a projected value into each place of a filter that uses it.
            df = df.select("*", F.explode(F.array(t.values_of(F.col(f"`{n}`")))).alias(_VALUES + n))
        out = self._with(df)
        out.read = self.read | set(names)
        return out

    def loosened(self, names: Sequence[str]) -> Solutions:
        """These variables as structs."""
        names = [n for n in names if n in self.shapes]
        if not names:
            return self
        df = self.df.withColumns({n: self[n].column for n in names})
        return Solutions(df, self.certain, self.maybe, {n: s for n, s in self.shapes.items() if n not in names})

    def terms(self) -> DataFrame:
        """All variables as structs."""
        return self.loosened(self.variables).df.select(*self.variables)

    # Row operators

    def filter(self, condition: Column) -> Solutions:
        """Rows whose condition is true; errors drop a row."""
        out = self._with(self.df.filter(condition))
        out.read = self.read
        return out

    def bind(self, name: str, value: t.Val | Column | Const) -> Solutions:
        """A new variable; unbound where the value is an error."""
        if name in self.certain or name in self.maybe:
            raise ValueError(f"{name} is bound already")
        constant = isinstance(value, Const)
        value = value.column if constant else value
        known = isinstance(value, t.Val) and value.text is None
        df = self.df.withColumn(name, value.raw if known else t.col(value))
        shapes = {**self.shapes, name: Shape(value.kind, value.dt, value.prefix, dict(df.dtypes)[name])} if known else self.shapes
        out = Solutions(df, self.certain | ({name} if constant else set()), self.maybe | (set() if constant else {name}), shapes)
        out.read = self.read
        return out

    # Between solutions

    def _aligned(self, other: Solutions) -> tuple[Solutions, Solutions]:
        """Both with the same shapes of shared variables."""
        differ = [n for n in set(self.variables) & set(other.variables) if self.shapes.get(n) != other.shapes.get(n)]
        return self.loosened(differ), other.loosened(differ)

    def _join(self, other: Solutions, at_least: int = 0) -> DataFrame | None:
        """All compatible pairs, merged, of aligned sides that have at least so many variables bound on both sides."""
        shared = sorted(set(self.variables) & set(other.variables))
        unsure = [n for n in shared if n in self.maybe or n in other.maybe]
        sure = [n for n in shared if n not in unsure]
        only = [n for n in other.variables if n not in shared]
        right = other.df.select(*[F.col(f"`{n}`").alias(f"{HIDDEN}r_{n}") for n in other.variables])
        merged = lambda on: [F.coalesce(F.col(f"`{n}`"), F.col(f"`{HIDDEN}r_{n}`")).alias(n) if n in shared and n not in on else F.col(f"`{n}`") for n in self.variables]
        added = [F.col(f"`{HIDDEN}r_{n}`").alias(n) for n in only]
        if sure and at_least <= len(sure):
            fits = [self.df[f"`{n}`"] == right[f"{HIDDEN}r_{n}"] for n in sure]
            fits += [self.df[f"`{n}`"].isNull() | right[f"{HIDDEN}r_{n}"].isNull() | (self.df[f"`{n}`"] == right[f"{HIDDEN}r_{n}"]) for n in unsure]
            return self.df.join(right, reduce(lambda a, b: a & b, fits)).select(*merged(sure), *added)
        if not shared:
            return None if at_least else self.df.crossJoin(right).select(*merged([]), *added)
        (left, mine), (right, theirs) = self._masked(unsure), other._masked(unsure)
        right = right.select(F.col(_MASK).alias(f"{_MASK}_r"), *[F.col(f"`{n}`").alias(f"{HIDDEN}r_{n}") for n in other.variables])
        bits = {n: 1 << k for k, n in enumerate(unsure)}
        pairs = [(m, r) for m in mine for r in theirs if (m & r).bit_count() >= at_least]
        keyed = [(m, r) for m, r in pairs if m & r]
        out = None
        if keyed:
            # Each row once for each kind of partner that occurs; what both sides have bound is the key.
            a = left.withColumn(f"{_MASK}_r", F.explode(_partners(F.col(_MASK), keyed)))
            b = right.withColumn(_MASK, F.explode(_partners(F.col(f"{_MASK}_r"), [(r, m) for m, r in keyed])))
            both = F.col(_MASK).bitwiseAND(F.col(f"{_MASK}_r"))
            keys = lambda c: [F.when(both.bitwiseAND(F.lit(bits[n])) != 0, c(n)) for n in unsure]
            a = a.select("*", *[v.alias(f"{HIDDEN}k{i}") for i, v in enumerate(keys(lambda n: F.col(f"`{n}`")))])
            b = b.select(*[f"`{HIDDEN}r_{n}`" for n in other.variables], F.col(_MASK).alias(f"{HIDDEN}m"), F.col(f"{_MASK}_r").alias(f"{HIDDEN}t"), *[v.alias(f"{HIDDEN}j{i}") for i, v in enumerate(keys(lambda n: F.col(f"`{HIDDEN}r_{n}`")))])
            on = [a[_MASK] == b[f"{HIDDEN}m"], a[f"{_MASK}_r"] == b[f"{HIDDEN}t"]]
            on += [a[f"{HIDDEN}k{i}"].eqNullSafe(b[f"{HIDDEN}j{i}"]) for i in range(len(unsure))]
            out = a.join(b, reduce(lambda x, y: x & y, on)).select(*merged([]), *added)
        for m, r in [x for x in pairs if x not in keyed]:
            got = left.filter(F.col(_MASK) == m).crossJoin(right.filter(F.col(f"{_MASK}_r") == r)).select(*merged([]), *added)
            out = got if out is None else out.unionByName(got)
        if out is None and not at_least:  # a side has no rows
            out = left.crossJoin(right).select(*merged([]), *added).limit(0)
        return out

    def _masked(self, names: Sequence[str]) -> tuple[DataFrame, list[int]]:
        """Rows, saved, with the mask of the names bound in them, and the masks that occur."""
        mask = reduce(lambda a, b: a + b, [F.lit(1 << k) if n in self.certain else F.when(F.col(f"`{n}`").isNotNull(), 1 << k).otherwise(0) for k, n in enumerate(names)])
        rows = self.df.withColumn(_MASK, mask)
        rows = rows if self.saved else checkpointed(rows)
        return rows, sorted(r[0] for r in rows.select(_MASK).distinct().collect())

    def join(self, other: Solutions) -> Solutions:
        a, b = self._aligned(other)
        certain = a.certain | b.certain
        return Solutions(a._join(b), certain, (a.maybe | b.maybe) - certain, {**a.shapes, **b.shapes})

    def union(self, *others: Solutions) -> Solutions:
        """All rows of all branches; a variable that a branch lacks is unbound there."""
        out = self
        for o in others:
            a, b = out._aligned(o)
            certain = a.certain & b.certain
            df = a.df.select(*a.variables).unionByName(b.df.select(*b.variables), allowMissingColumns=True)
            out = Solutions(df, certain, (set(a.variables) | set(b.variables)) - certain, {**a.shapes, **b.shapes})
        return out

    def _same_row(self, other: DataFrame) -> tuple[DataFrame, Column]:
        renamed = other.select(*[F.col(f"`{n}`").alias(f"{HIDDEN}m_{n}") for n in self.variables])
        equal = [self.df[f"`{n}`"] == renamed[f"{HIDDEN}m_{n}"] if n in self.certain else self.df[f"`{n}`"].eqNullSafe(renamed[f"{HIDDEN}m_{n}"]) for n in self.variables]
        return renamed, reduce(lambda a, b: a & b, equal, F.lit(True))

    def _sure(self, other: Solutions) -> list[str] | None:
        """Shared variables if all are certain on both sides."""
        shared = sorted(set(self.variables) & set(other.variables))
        return shared if all(n in self.certain and n in other.certain for n in shared) else None

    def _saved(self) -> Solutions:
        """Written once, where a side without sure keys is read more than once."""
        out = self._with(checkpointed(self.df))
        out.saved = True
        return out

    def _tagged(self) -> Solutions:
        # Equal rows have equal partners, so rows can stand for themselves when the unmatched are found.
        df = self.df.select(*[f"`{n}`" for n in self.variables], F.struct(*[f"`{n}`" for n in self.variables]).alias(f"{HIDDEN}row"))
        out = Solutions(df, self.certain | {f"{HIDDEN}row"}, self.maybe, self.shapes)
        out.saved = self.saved
        return out

    def optional(self, other: Solutions, condition: Callable[[Solutions], Column] | None = None) -> Solutions:
        """Left join; condition sees the variables of both sides. A side without new variables or condition changes nothing."""
        self, other = self._aligned(other)
        new = [n for n in other.variables if n not in self.variables]
        maybe = self.maybe | set(new) | {n for n in other.variables if n in self.maybe}
        shapes = {**self.shapes, **other.shapes}
        shared = self._sure(other)
        if shared:
            right = other.df.select(*[F.col(f"`{n}`").alias(f"{HIDDEN}r_{n}" if n in shared else n) for n in other.variables])
            on = reduce(lambda a, b: a & b, [self.df[f"`{n}`"] == right[f"{HIDDEN}r_{n}"] for n in shared])
            if condition is not None:
                on = on & condition(Solutions(self.df, self.certain | other.certain, self.maybe | other.maybe, shapes))
            return Solutions(self.df.join(right, on, "left").select(*[f"`{n}`" for n in (*self.variables, *new)]), self.certain, maybe - self.certain, shapes)
        self = self._saved() if shared is None else self
        tagged = self._tagged()
        pairs = Solutions(tagged._join(other), tagged.certain | other.certain, tagged.maybe | other.maybe, shapes)
        matched = pairs.df if condition is None else pairs.df.filter(condition(pairs))
        rows, same = self._same_row(matched.select(f"{HIDDEN}row.*").distinct())
        alone = self.df.join(rows, same, "left_anti")
        out = matched.select(*[f"`{n}`" for n in (*self.variables, *new)]).unionByName(alone.select(*[f"`{n}`" for n in self.variables]), allowMissingColumns=True)
        return Solutions(out, self.certain, maybe - self.certain, shapes)

    def _with_partner(self, other: Solutions, how: str, at_least: int = 0) -> Solutions:
        self, other = self._aligned(other)
        shared = self._sure(other)
        if shared:
            keys = other.df.select(*[f"`{n}`" for n in shared])
            return self._with(self.df.join(keys, shared, how).select(*[f"`{n}`" for n in self.variables]))
        if shared == []:
            some = other.df.limit(1).select(F.lit(1).alias(f"{HIDDEN}one"))
            return self._with(self.df.join(F.broadcast(some), F.lit(True), how))
        self = self._saved()
        pairs = self._tagged()._join(other, at_least)
        if pairs is None:
            return self if how == "left_anti" else self._with(self.df.limit(0))
        rows, same = self._same_row(pairs.select(f"{HIDDEN}row.*").distinct())
        return self._with(self.df.join(rows, same, how))

    def exists(self, other: Solutions) -> Solutions:
        return self._with_partner(other, "left_semi")

    def not_exists(self, other: Solutions) -> Solutions:
        return self._with_partner(other, "left_anti")

    def minus(self, other: Solutions) -> Solutions:
        """Rows without a compatible row that shares a bound variable; without shared variables all rows stay."""
        if not set(self.variables) & set(other.variables):
            return self
        return self._with_partner(other, "left_anti", at_least=1)

    def exists_flag(self, other: Solutions, name: str) -> Solutions:
        """Whether exists() would keep the row, as a boolean literal to be used in expressions."""
        a, b = self._aligned(other)
        shared = a._sure(b)
        if shared:  # each row has at most one partner
            right = b.df.select(*[F.col(f"`{n}`").alias(f"{HIDDEN}r_{n}") for n in shared]).distinct().withColumn(f"{HIDDEN}has", F.lit(True))
            on = reduce(lambda x, y: x & y, [a.df[f"`{n}`"] == right[f"{HIDDEN}r_{n}"] for n in shared])
            df = a.df.join(right, on, "left").select(*[f"`{n}`" for n in a.variables], F.coalesce(F.col(f"{HIDDEN}has"), F.lit(False)).alias(name))
            return Solutions(df, a.certain | {name}, a.maybe, {**a.shapes, name: Shape(t.LITERAL, t.BOOLEAN, "", "boolean")})
        has, hasnt = (x.bind(name, t.val(F.lit(v), t.BOOLEAN)) for x, v in ((a.exists(b), True), (a.not_exists(b), False)))
        return has.union(hasnt)

    # What a user reads

    def values(self, **of: Callable[[Column], Column] | None) -> DataFrame:
        """Plain columns: name=function of the variable's term, by default its lexical form."""
        return self.df.select(*[(f or (lambda x: x["lex"]))(self[n]).alias(n) for n, f in of.items()])


def _name(x) -> str | None:
    """Variable name of '?x' or '_:x' (hidden)."""
    if isinstance(x, Const):
        return None
    if x.startswith("?"):
        return x[1:]
    if x.startswith("_:"):
        return f"{HIDDEN}blank_{x[2:]}"
    raise ValueError(f"not a variable, blank node or constant: {x!r}")


def _pattern(quads: Quads, s, p, o, g, after: bool = False) -> Solutions:
    """One pattern. after: others about the same subject come before, and the subject's rows are together."""
    df, terms = quads.places(s, p, o, g)
    first: dict[str, t.Val | Column] = {}
    for place, x in zip("spog", (s, p, o, g)):
        name, here = None if x is None else _name(x), terms[place]
        if name is None:
            continue
        if name in first:
            df = df.filter(same_term(first[name], here))
        else:
            first[name] = here
    if g is not None and not isinstance(g, Const):
        df = df.filter(terms["g"]["kind"] != t.DEFAULT_GRAPH)
    if quads.colocated and isinstance(s, str):
        # What the rows are together by, whatever terms subjects are; the term itself is carried once.
        if after and _name(s) not in [_name(x) for x in (p, o, g) if x is not None]:
            del first[_name(s)]
        first[f"{HIDDEN}subject_{_name(s)}"] = t.Val(t.IRI, "", F.col("s"), sure=True)
    out = _shaped(df, first)
    out.rows = quads.rows(s, p, o)
    return out


def _shaped(df: DataFrame, columns: dict[str, t.Val | Column]) -> Solutions:
    """Variables that are bound in every row, as plain values where their type is known."""
    out = df.select(*[(c.raw if isinstance(c, t.Val) else c).alias(n) for n, c in columns.items()])
    kinds = dict(out.dtypes)
    return Solutions(out, set(columns), set(), {n: Shape(c.kind, c.dt, c.prefix, kinds[n]) for n, c in columns.items() if isinstance(c, t.Val)})


def _star(quads: Quads, subject, patterns: list[tuple], g) -> Solutions | None:
    """Patterns about one subject that one scan of a mapped table answers."""
    table = quads.table_of(patterns[0][1].lex)
    if table is None or g is not None and g != table.graph:
        return None
    df, columns, equal = table.df, {}, []
    if isinstance(subject, Const):
        df = df.filter(table.subject_equals(subject))
    else:
        columns[_name(subject)] = table.subject_val()
    for _, p, o in patterns:
        obj = table.columns[p.lex]
        df = df.filter(F.col(f"`{obj.column}`").isNotNull())
        if isinstance(o, Const):
            df = df.filter(obj.equals(o, table.kinds))
        else:
            here = obj.val(table.kinds)
            here = obj.term(table.kinds) if here is None else here
            if (name := _name(o)) in columns:
                equal.append(same_term(columns[name], here))
            else:
                columns[name] = here
    for e in equal:
        df = df.filter(e)
    return _shaped(df, columns)


def _all(parts: list[Solutions]) -> Solutions:
    """The join of all parts; next is always one that shares a variable, if there is one.

    The size of files, which a broadcast is chosen by, says little of rows: a text in a dictionary takes a byte or two
    there. Where both sides are known to have MANY, they are sorted and merged.
    """
    out, parts = parts[0], parts[1:]
    while parts:
        nth = next((k for k, x in enumerate(parts) if set(x.variables) & set(out.variables)), 0)
        part = parts.pop(nth)
        rows, many = max(out.rows, part.rows), min(out.rows, part.rows) >= MANY
        out = out.join(part._with(part.df.hint("merge")) if many else part)
        out.rows = rows
    return out


def bgp(quads: Quads, *patterns: tuple, graph=None) -> Solutions:
    """All patterns at once. A pattern is (s, p, o) of '?var', '_:blank' and constants; graph: None, a constant or '?var'."""
    if not patterns:
        raise ValueError("a graph pattern needs a triple pattern")
    groups: dict = {}
    for pattern in patterns:
        s, p, _ = pattern
        table = quads.table_of(p.lex) if isinstance(p, Const) else None
        groups.setdefault((s, id(table)) if table else (s, None) if quads.colocated and isinstance(s, str) else id(pattern), []).append(pattern)
    parts: list[Solutions] = []
    for key, group in groups.items():
        star = _star(quads, key[0], group, graph) if isinstance(key, tuple) and key[1] else None
        each = [star] if star else [_pattern(quads, *x, graph, after=n > 0) for n, x in enumerate(group)]
        # Patterns about one subject meet first where its rows are together.
        parts.extend([_all(each)] if quads.colocated and isinstance(key, tuple) else each)
    out = _all(parts)
    shown = [n for n in out.variables if not n.startswith(HIDDEN)]
    return Solutions(out.df.select(*[f"`{n}`" for n in shown]), set(shown), set(), out.shapes) if shown else out


def graph(quads: Quads, name, *patterns: tuple) -> Solutions:
    """GRAPH with a constant or '?var'."""
    return bgp(quads, *patterns, graph=name)


def values(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence[Const | None]]) -> Solutions:
    """Inline data; None is unbound."""
    fields, data, shapes = [], [list(row) for row in rows], {}
    for k, n in enumerate(names):
        column = [row[k] for row in rows if row[k] is not None]
        canonical = all(x.kind == t.LITERAL and x.dt in (t.STRING, t.INTEGER) and x.dt == column[0].dt and (x.dt == t.STRING or str(int(x.lex)) == x.lex and abs(int(x.lex)) < 1 << 63) for x in column)
        if column and canonical:
            of, sql = (str, "string") if column[0].dt == t.STRING else (int, "bigint")
            shapes[n] = Shape(t.LITERAL, column[0].dt, "", sql)
            fields.append(t.T.StructField(n, t.T.StringType() if of is str else t.T.LongType()))
        else:
            of = lambda lex: lex
            fields.append(t.T.StructField(n, t.TERM))
        for row in data:
            x = row[k]
            row[k] = None if x is None else of(x.lex) if n in shapes else (x.kind, x.lex, x.dt, x.lang)
    maybe = {n for k, n in enumerate(names) if any(row[k] is None for row in rows)}
    return Solutions(spark.createDataFrame([tuple(r) for r in data], t.T.StructType(fields)), set(names) - maybe, maybe, shapes)
