"""Quad tables laid out for patterns: a folder for each predicate, buckets by subject, values typed.

quads holds each distinct quad once, in folders that tell whether its triple stands in a graph before it too: those that
don't are the distinct triples. One shuffle by subject and one sort make both. predicates says of each predicate which type
its objects have, whether their spelling follows from their value, and how large its largest bucket is. Patterns about one
subject join bucket by bucket, without a shuffle, and what they ask of numbers, times and text reaches the scan.

Rows with a null subject, predicate or object are left out, a null graph is the default graph, predicates are IRIs. A
bucket can't be divided between tasks while it is read as one, so a predicate whose largest bucket is over SKEW times the
mean and over LARGE rows is read file by file, and joins shuffle it; its rows are the same.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import terms as t
from .mapping import Const, Quads, Table

SKEW, LARGE = 8, 10_000_000
_HELD = "__held_"
#: Files that a task of save() writes at once.
WRITERS, _AT_ONCE = 100, "spark.sql.maxConcurrentOutputFileWriters"
#: Typed columns: datatypes, the SQL type of the values.
_TYPED = {"whole": (t.INTEGERS, "bigint"), "real": ((t.DOUBLE,), "double"), "at": ((t.DATETIME,), "timestamp"), "flag": ((t.BOOLEAN,), "boolean")}
_COLUMNS = "p string, s string, o_kind tinyint, o_lex string, o_dt string, o_lang string, whole bigint, real double, at timestamp, flag boolean, g string"


def _folder(predicate: str) -> str:
    return hashlib.md5(predicate.encode()).hexdigest()


def _code(node: Column) -> Column:
    """An IRI as it is, a blank node with _:, the default graph as ''."""
    return F.when(node["kind"] == t.BLANK, F.concat(F.lit("_:"), node["lex"])).otherwise(node["lex"])


def _node(code: Column) -> Column:
    return F.when(code.startswith("_:"), t.plain(t.BLANK, F.substr(code, F.lit(3)))).otherwise(t.plain(t.IRI, code))


def _typed(o: Column) -> dict[str, Column]:
    """Values that are spelled as they would be written; else null."""
    lex, is_of = o["lex"], {n: t.is_literal_of(o, *dts) for n, (dts, _) in _TYPED.items()}
    whole, real = lex.try_cast("bigint"), lex.try_cast("double")
    as_written = {
        "whole": F.when(whole.cast("string") == lex, whole),
        # A text that a cast writes again is a number's, but for the cast's own names of infinity.
        "real": F.when(lex == "INF", float("inf")).when(lex == "-INF", float("-inf")).when((real.cast("string") == lex) & ~lex.endswith("Infinity"), real),
        # Such a text, if it is a time at all, is the one way to write it; year 0 is written otherwise.
        "at": F.when(lex.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z\z") & (lex >= "0001"), lex.try_cast("timestamp")),
        "flag": F.when(lex == "true", True).when(lex == "false", False),
    }
    return {n: F.when(is_of[n], v).alias(n) for n, v in as_written.items()}


def _name(path: str, table: str) -> str:
    return f"quadframe_{_folder(path)}_{table}"


def _flat(df: DataFrame, s: Column, p: Column, o: Column, g: Column, pred: Column) -> DataFrame:
    return df.select(p.alias("p"), s.alias("s"), *[o[x].alias(f"o_{x}") for x in ("kind", "lex", "dt", "lang")], g.alias("g"), pred.alias("pred"))


def _marked(flat: DataFrame) -> DataFrame:
    """Distinct quads, and whether their triple stands in a graph before, of rows that are together by subject."""
    # Within a subject equal quads, and quads of one triple, follow each other.
    triple = ["p", "o_lex", "o_kind", "o_dt", "o_lang"]
    order = Window.partitionBy("s").orderBy(*triple, "g")
    before = F.lag(F.struct(*triple, "g")).over(order)
    again = before.isNotNull() & reduce(lambda a, b: a & b, [before[c].eqNullSafe(F.col(c)) for c in triple])
    marked = flat.select("*", again.alias("again"), F.coalesce(before["g"] == F.col("g"), F.lit(False)).alias("same_g"))
    return marked.filter(~(F.col("again") & F.col("same_g"))).drop("same_g")


def _of_table(table: Table, buckets: int) -> DataFrame:
    """Distinct quads of a mapped table, whose rows are dealt by subject before they become quads.

    Quads of a subject with one row differ, so they aren't compared; those of the others are.
    """
    objects = table.columns.values()
    needed = [F.col(f"`{c}`") for c in dict.fromkeys(c for o in objects for c in (o.column, o.lang) if c is not None)]
    subject = table.subject()
    held = table.df.filter(subject.isNotNull()).select(_code(subject).alias(f"{_HELD}s"), *needed).repartition(buckets, f"{_HELD}s")
    held = held.withColumn(f"{_HELD}n", F.count(F.lit(1)).over(Window.partitionBy(f"{_HELD}s")))
    each = F.array(*[
        F.struct(F.lit(p).alias("p"), F.when(F.col(f"`{o.column}`").isNotNull(), o.term(table.kinds)).alias("o"), F.lit(_folder(p)).alias("pred")) for p, o in table.columns.items()
    ])

    def quads(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(f"{_HELD}s").alias("s"), F.explode(each).alias("q")).filter("q.o is not null")
        return _flat(rows, F.col("s"), F.col("q.p"), F.col("q.o"), F.lit(table.graph.lex), F.col("q.pred"))

    once, more = held.filter(f"{_HELD}n = 1"), held.filter(f"{_HELD}n > 1")
    return quads(once).withColumn("again", F.lit(False)).unionByName(_marked(quads(more)))


def save(quads: DataFrame | Quads, path: str, buckets: int | None = None) -> None:
    """Write (s, p, o, g), or quads, under path. buckets: by default as many as a shuffle has partitions."""
    spark = quads.spark if isinstance(quads, Quads) else quads.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # As many tasks as buckets, so what one holds grows with a bucket only.
    tables = quads.tables if isinstance(quads, Quads) else None
    if tables and len({p for x in tables for p in x.columns}) == sum(len(x.columns) for x in tables):
        distinct = reduce(DataFrame.unionByName, [_of_table(x, buckets) for x in tables])
    else:
        rows = (quads.quads() if isinstance(quads, Quads) else quads).filter("s is not null and p is not null and o is not null")
        flat = _flat(rows, _code(F.col("s")), F.col("p.lex"), F.col("o"), F.coalesce(_code(F.col("g")), F.lit("")), F.md5("p.lex"))
        distinct = _marked(flat.repartition(buckets, "s"))
    o = F.struct(*[F.col(f"o_{x}").alias(x) for x in ("kind", "lex", "dt", "lang")])
    rows = distinct.select("p", "s", *[f"o_{x}" for x in ("kind", "lex", "dt", "lang")], *_typed(o).values(), "g", "pred", "again")
    # A task writes all folders of its bucket at once, so rows aren't sorted again by folder; where there are more folders they are.
    usual = spark.conf.get(_AT_ONCE)
    spark.conf.set(_AT_ONCE, WRITERS)
    try:
        rows.write.format("parquet").partitionBy("pred", "again").bucketBy(buckets, "s").option("parquet.enable.dictionary#s", "false").option("path", f"{path}/quads").saveAsTable(_name(path, "quads"))
    finally:
        spark.conf.set(_AT_ONCE, usual)
    # Counted by what may differ within a predicate; text is compared among the few rows that this leaves.
    kinds = _open(spark, path, "triples", buckets).groupBy(
        "p", F.pmod(F.hash("s"), F.lit(buckets)).alias("bucket"), "o_kind", "o_dt", (F.col("o_lang") != "").alias("lang"), F.col("s").startswith("_:").alias("blank")
    ).agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in _TYPED])
    each = kinds.groupBy("p", "bucket").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _TYPED], *[f(c).alias(f"{c}{k}") for c in ("o_kind", "o_dt", "blank") for k, f in enumerate((F.min, F.max))], F.max("lang").alias("lang")
    )
    same = lambda c: F.when(F.min(f"{c}0") == F.max(f"{c}1"), F.min(f"{c}0"))
    about = each.groupBy("p").agg(
        F.sum("n").alias("n"), F.max("n").alias("largest"), same("o_kind").alias("kind"), same("o_dt").alias("dt"), F.max("lang").alias("lang"), same("blank").alias("blank"),
        F.coalesce(*[F.when(F.sum(c) == F.sum("n"), c) for c in _TYPED]).alias("typed"), F.lit(buckets).alias("buckets"),
    )
    about.write.parquet(f"{path}/predicates")


def _open(spark: SparkSession, path: str, table: str, buckets: int) -> DataFrame:
    """quads, or triples: those of the same files whose triple stands in no graph before."""
    name = _name(path, table)
    if not spark.catalog.tableExists(name):
        where = f"{path}/quads".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({_COLUMNS}, pred string, again boolean) USING parquet PARTITIONED BY (pred, again) CLUSTERED BY (s) INTO {buckets} BUCKETS LOCATION '{where}'")
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return _first(spark.table(name), table)


def _first(df: DataFrame, table: str) -> DataFrame:
    return df.filter(F.col("again").eqNullSafe(False)).drop("g", "again") if table == "triples" else df.drop("again")


class Stored(Quads):
    """Quads that save() has written."""

    colocated = True

    def __init__(self, spark: SparkSession, path: str, default_graph: str = "union", excluded: tuple[str, ...] = ()):
        super().__init__([], default_graph)
        self.tables, self._spark, self.path, self.excluded = None, spark, path, tuple(excluded)
        self.predicates = spark.read.parquet(f"{path}/predicates")
        first = self.predicates.select("buckets").first()
        self.buckets, self._about = first["buckets"] if first else 1, {}

    @property
    def spark(self) -> SparkSession:
        return self._spark

    def without(self, predicates) -> Stored:
        return Stored(self._spark, self.path, self.default_graph, (*self.excluded, *predicates))

    def about(self, predicate: str):
        """What is known of a predicate; None if it has no quads."""
        if predicate not in self._about:
            self._about[predicate] = None if predicate in self.excluded else self.predicates.filter(F.col("p") == predicate).first()
        return self._about[predicate]

    def rows(self, s, p, o) -> int:
        """The triples of a predicate; what constants leave of them isn't known."""
        about = self.about(p.lex) if isinstance(p, Const) and not isinstance(s, Const) and not isinstance(o, Const) else None
        return about["n"] if about else 0

    def _rows(self, p, g) -> DataFrame:
        table = "triples" if g is None and self.default_graph == "union" else "quads"
        about = self.about(p.lex) if isinstance(p, Const) else None
        if about and about["largest"] > max(LARGE, SKEW * about["n"] / self.buckets):
            df = _first(self._spark.read.parquet(f"{self.path}/quads/pred={_folder(p.lex)}"), table)
        else:
            df = _open(self._spark, self.path, table, self.buckets)
            df = df.filter(F.col("pred") == _folder(p.lex)) if isinstance(p, Const) else df
            df = df.filter(~F.col("pred").isin(*map(_folder, self.excluded))) if self.excluded else df
        if g is None:
            return df if table == "triples" else df.filter(F.col("g") == "")
        if isinstance(g, Const):
            return df.filter(F.col("g") == self._constant(g))
        return df.filter(F.col("g") != "")

    @staticmethod
    def _constant(node: Const) -> str:
        return f"_:{node.lex}" if node.kind == t.BLANK else "" if node.kind == t.DEFAULT_GRAPH else node.lex

    def places(self, s, p, o, g=None):
        df = self._rows(p, g)
        if isinstance(s, Const):
            df = df.filter(F.col("s") == self._constant(s)) if s.kind in (t.IRI, t.BLANK) else df.limit(0)
        if isinstance(o, Const):
            is_o = [F.col("o_kind") == o.kind, F.col("o_lex") == o.lex, F.col("o_dt") == o.dt, F.col("o_lang") == o.lang]
            df = df.filter(reduce(lambda a, b: a & b, is_o))
        graph = F.lit(None).cast(t.TERM) if "g" not in df.columns else F.when(F.col("g") == "", t.plain(t.DEFAULT_GRAPH, "")).otherwise(_node(F.col("g")))
        terms = {"s": _node(F.col("s")), "p": t.plain(t.IRI, F.col("p")), "o": t.plain(F.col("o_kind"), F.col("o_lex"), F.col("o_dt"), F.col("o_lang")), "g": graph}
        about = self.about(p.lex) if isinstance(p, Const) else None
        if about is not None:
            kind, dt = about["kind"], about["dt"]
            if about["blank"] is False:
                terms["s"] = t.Val(t.IRI, "", F.col("s"), sure=True)
            if kind == t.LITERAL and about["typed"] is not None and dt is not None:
                terms["o"] = t.Val(kind, dt, F.col(about["typed"]), sure=True)
            elif kind in (t.IRI, t.BLANK) or kind == t.LITERAL and dt in t.STRINGS and not about["lang"]:
                terms["o"] = t.Val(kind, dt, F.col("o_lex"), sure=True)
        return df, terms

    def scan(self, s, p, o, g=None) -> DataFrame:
        df, terms = self.places(s, p, o, g)
        return df.select(*[t.col(terms[x]).alias(x) for x in "spog"])

    def quads(self) -> DataFrame:
        df = _open(self._spark, self.path, "quads", self.buckets)
        df = df.filter(~F.col("pred").isin(*map(_folder, self.excluded))) if self.excluded else df
        o = t.plain(F.col("o_kind"), F.col("o_lex"), F.col("o_dt"), F.col("o_lang"))
        g = F.when(F.col("g") == "", t.plain(t.DEFAULT_GRAPH, "")).otherwise(_node(F.col("g")))
        return df.select(_node(F.col("s")).alias("s"), t.plain(t.IRI, F.col("p")).alias("p"), o.alias("o"), g.alias("g"))
