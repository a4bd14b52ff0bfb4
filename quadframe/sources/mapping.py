"""Quads: a quad table, or relational tables read as quads.

A mapped table names its subjects by a prefix and key columns, its graph, and a predicate for each of its columns. A
pattern with a constant predicate reads that column of that table only, and constant subjects and objects become
conditions on the columns themselves, so filters and column pruning reach the scan. Only patterns with a variable
predicate read all columns.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t

EX = "http://example.org/"


@dataclass(frozen=True)
class Const:
    """A constant term of a pattern."""

    kind: int
    lex: str
    dt: str = ""
    lang: str = ""

    @property
    def struct(self) -> Column:
        return t.plain(self.kind, self.lex, self.dt, self.lang)

    @property
    def column(self) -> t.Val | Column:
        """Typed where the lexical form is valid for the type, else a struct."""
        if self.kind in (t.IRI, t.BLANK):
            return t.Val(self.kind, "", F.lit(self.lex), sure=True, const=self.lex)
        raw, level = None, t.LEVELS.get(self.dt)
        if self.kind != t.LITERAL or self.lang:
            return self.struct
        if self.dt in t.STRINGS:
            return t.Val(self.kind, self.dt, F.lit(self.lex), sure=True, const=self.lex)
        if level == 0 and re.fullmatch(r"[+-]?[0-9]{1,38}", self.lex):
            raw = F.lit(int(self.lex)) if abs(int(self.lex)) < 1 << 63 else F.lit(Decimal(self.lex))
        elif level == 1 and re.fullmatch(r"[+-]?([0-9]{1,28}(\.[0-9]{0,10})?|\.[0-9]{1,10})", self.lex):
            raw = F.lit(Decimal(self.lex))
        elif level in (2, 3) and re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN", self.lex):
            raw = F.lit(float(self.lex))
        elif self.dt == t.BOOLEAN and self.lex in ("true", "1", "false", "0"):
            raw = F.lit(self.lex in ("true", "1"))
        elif self.dt in (t.DATETIME, t.DATE, t.TIME, t.DURATION):
            raw = {t.DATETIME: t.v_ts, t.DATE: t.v_date, t.TIME: t.v_time, t.DURATION: t.v_dur}[self.dt](self.struct)
        if raw is None:
            return self.struct
        return t.Val(self.kind, self.dt, raw, text=self.lex, const=self.lex)


def I(name: str) -> Const:  # noqa: E743
    """An IRI; a name without a scheme is in the example name space."""
    return Const(t.IRI, name if ":" in name else EX + name)


def L(value, dt: str | None = None, lang: str | None = None) -> Const:
    """A literal, typed as terms.lit types it."""
    if lang is not None:
        return Const(t.LITERAL, value, t.LANG_STRING, lang)
    kind = dt or (t.BOOLEAN if isinstance(value, bool) else t.INTEGER if isinstance(value, int) else t.DOUBLE if isinstance(value, float) else t.STRING)
    return Const(t.LITERAL, str(value).lower() if isinstance(value, bool) else str(value), kind)


@dataclass(frozen=True)
class Object:
    """How a column becomes a term: an IRI with a prefix, or a literal of a datatype."""

    column: str
    prefix: str | None = None
    dt: str = t.STRING
    lang: str | None = None

    def val(self, kinds: dict[str, str], sure: bool = True) -> t.Val | None:
        """The column as a typed term; None if terms of the column differ in type."""
        kind, c = kinds[self.column], F.col(f"`{self.column}`")
        raw = c.cast("bigint") if kind in ("tinyint", "smallint", "int") else c
        if self.prefix is not None:
            return t.Val(t.IRI, "", raw, sure, self.prefix)
        level = t.LEVELS.get(self.dt)
        whole = kind in ("tinyint", "smallint", "int", "bigint")
        fits = (
            whole if level == 0 else kind == "double" if level == 3 else kind == "float" if level == 2 else kind.startswith("decimal") if level == 1
            else kind == "string" if self.dt in t.STRINGS else kind in ("timestamp", "timestamp_ntz") if self.dt == t.DATETIME else (self.dt, kind) in ((t.BOOLEAN, "boolean"), (t.DATE, "date"))
        )
        return t.Val(t.LITERAL, self.dt, raw, sure, ntz=kind == "timestamp_ntz") if fits and self.lang is None else None

    def term(self, kinds: dict[str, str]) -> Column:
        """The term of a column that isn't null."""
        known, c = self.val(kinds), F.col(f"`{self.column}`")
        if known is not None:
            return known.column
        if self.lang is not None:
            lang = F.col(f"`{self.lang}`")
            return t.plain(t.LITERAL, c, F.when(lang.isNull(), t.STRING).otherwise(t.LANG_STRING), F.coalesce(lang, F.lit("")))
        return t.plain(t.LITERAL, c, self.dt)

    def equals(self, const: Const, kinds: dict[str, str]) -> Column:
        """A condition on the column where that says the same, else on the term."""
        c, lex, known = F.col(f"`{self.column}`"), const.lex, self.val(kinds)
        if self.prefix is not None:
            if const.kind != t.IRI or not lex.startswith(self.prefix):
                return F.lit(False)
            lex = lex[len(self.prefix) :]
        elif known is not None and const.kind == t.LITERAL and const.dt == self.dt and isinstance(const.column, t.Val) and self.dt not in t.STRINGS and known.level != 0:
            # The value may be written in other ways; the first part is what a scan can use.
            from ..functions.expr import eq

            return eq(known, const.column) & (known.lex == lex)
        elif known is None or const.kind != t.LITERAL or const.dt != self.dt:
            return self.term(kinds) == const.struct
        if kinds[self.column] == "string":
            return c == lex
        plain = lex.removeprefix("-")
        return c == int(lex) if plain.isascii() and plain.isdigit() and str(int(lex)) == lex else F.lit(False)


@dataclass
class Table:
    """A table read as quads. key: columns of the subject; unique: whether each subject has one row, as its owner declares."""

    df: DataFrame
    name: str
    key: Sequence[str]
    columns: dict[str, Object]
    unique: bool = True
    blank: bool = False
    subject_of: str | None = None
    kinds: dict[str, str] = field(init=False)

    def __post_init__(self):
        self.kinds = dict(self.df.dtypes)
        self.prefix = f"{EX}{self.subject_of or self.name}/"

    @property
    def graph(self) -> Const:
        return Const(t.IRI, f"{EX}g/{self.name}")

    def subject_val(self) -> t.Val:
        if self.blank:
            return t.Val(t.BLANK, "", F.concat(F.lit(self.name[0]), F.sha2(F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in self.key]), 256)), sure=True)
        if len(self.key) == 1:
            return Object(self.key[0], self.prefix).val(self.kinds)
        return t.Val(t.IRI, "", F.concat_ws("/", *[F.col(f"`{k}`").cast("string") for k in self.key]), sure=True, prefix=self.prefix)

    def subject(self) -> Column:
        return self.subject_val().column

    def subject_equals(self, const: Const) -> Column:
        if self.blank or len(self.key) > 1:
            return self.subject() == const.struct
        return Object(self.key[0], self.prefix).equals(const, self.kinds)

    def triples(self, predicate: str) -> DataFrame:
        """(s, p, o, g) of one predicate."""
        o = self.columns[predicate]
        return self.df.filter(F.col(f"`{o.column}`").isNotNull()).select(self.subject().alias("s"), t.plain(t.IRI, predicate).alias("p"), o.term(self.kinds).alias("o"), self.graph.struct.alias("g"))

    def all_triples(self) -> DataFrame:
        """(s, p, o, g) of all columns in one scan."""
        each = F.array(*[F.struct(t.plain(t.IRI, p).alias("p"), F.when(F.col(f"`{o.column}`").isNotNull(), o.term(self.kinds)).alias("o")) for p, o in self.columns.items()])
        return self.df.select(self.subject().alias("s"), F.explode(each).alias("po"), self.graph.struct.alias("g")).select("s", "po.p", "po.o", "g").filter("o is not null")


class Quads:
    """A quad table (s, p, o, g) or mapped tables. default_graph: 'union' of all graphs, or 'strict'.

    triples_differ: declares that no triple of a quad table repeats, in one graph or several; else each union of graphs
    is made distinct.
    """

    #: Whether rows of one subject are in one partition.
    colocated = False

    def __init__(self, source: DataFrame | Sequence[Table], default_graph: str = "union", triples_differ: bool = False):
        self.triples_differ = triples_differ
        if default_graph not in ("union", "strict"):
            raise ValueError("default_graph is 'union' or 'strict'")
        self.tables = None if isinstance(source, DataFrame) else list(source)
        self.df = source if isinstance(source, DataFrame) else None
        self.default_graph = default_graph

    @property
    def spark(self):
        return (self.df if self.df is not None else self.tables[0].df).sparkSession

    def without(self, predicates: Sequence[str]) -> Quads | None:
        """These quads but those of some predicates, whose mapped columns are then not read; None if no predicate is left."""
        if self.df is not None:
            return Quads(self.df.filter(~F.col("p.lex").isin(*predicates)) if predicates else self.df, self.default_graph, self.triples_differ)
        left = [(x, {p: o for p, o in x.columns.items() if p not in predicates}) for x in self.tables]
        left = [Table(x.df, x.name, x.key, columns, x.unique, x.blank, x.subject_of) for x, columns in left if columns]
        return Quads(left, self.default_graph) if left else None

    def quads(self) -> DataFrame:
        """All quads."""
        if self.df is not None:
            return self.df.select("s", "p", "o", "g")
        out = self.tables[0].all_triples()
        for table in self.tables[1:]:
            out = out.unionByName(table.all_triples())
        return out

    def scan(self, s, p, o, g=None) -> DataFrame:
        """(s, p, o, g) of the quads that the constants among the arguments allow; g: None for the default graph."""
        if self.df is not None:
            df = self.df.select("s", "p", "o", "g")
            if g is None and self.default_graph == "strict":
                df = df.filter(F.col("g.kind") == t.DEFAULT_GRAPH)
            for name, x in zip("spog", (s, p, o, g)):
                if isinstance(x, Const):
                    df = df.filter((F.col(f"{name}.kind") == x.kind) & (F.col(f"{name}.lex") == x.lex) & (F.col(f"{name}.dt") == x.dt) & (F.col(f"{name}.lang") == x.lang))
            if g is None and self.default_graph == "union":  # which graph doesn't matter, and isn't carried along
                df = df.select("s", "p", "o")
                df = (df if self.triples_differ else df.distinct()).withColumn("g", F.lit(None).cast(t.TERM))
            return df
        parts = []
        for table in self.tables:
            if isinstance(g, Const) and g != table.graph or g is None and self.default_graph == "strict":
                continue
            base = table.df.filter(table.subject_equals(s)) if isinstance(s, Const) else table.df
            if isinstance(p, Const):
                if p.lex not in table.columns:
                    continue
                obj = table.columns[p.lex]
                base = base.filter(obj.equals(o, table.kinds)) if isinstance(o, Const) else base
                parts.append(Table(base, table.name, table.key, table.columns, table.unique, table.blank, table.subject_of).triples(p.lex))
            else:
                got = Table(base, table.name, table.key, table.columns, table.unique, table.blank, table.subject_of).all_triples()
                parts.append(got.filter(F.col("o") == o.struct) if isinstance(o, Const) else got)
        if not parts:
            spark = self.tables[0].df.sparkSession
            return spark.createDataFrame([], t.QUAD)
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def places(self, s, p, o, g=None) -> tuple[DataFrame, dict[str, t.Val | Column]]:
        """scan(), and the term at each place of its rows."""
        return self.scan(s, p, o, g), {x: F.col(x) for x in "spog"}

    def rows(self, s, p, o) -> int:
        """How many rows a pattern has about, if a layout knows; else 0."""
        return 0

    def table_of(self, predicate: str) -> Table | None:
        """The only table with the predicate, if subjects are unique there."""
        if self.tables is None or self.default_graph == "strict":
            return None
        having = [x for x in self.tables if predicate in x.columns]
        return having[0] if len(having) == 1 and having[0].unique else None
