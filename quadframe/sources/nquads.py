"""N-Quads text: reading into, and writing from, quad tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t

_IRI = r"<[^<>\"{}|^`\x00-\x20]*>"
_NODE = rf"{_IRI}|_:[^\s<>\"]+"
_STRING = r"\"(?:[^\"\\\n\r]++|\\.)*+\""
_LITERAL = rf"({_STRING})(?:\^\^({_IRI})|@([a-zA-Z]+(?:-[a-zA-Z0-9]+)*))?"
#: Groups: subject, predicate, object's node, string, datatype and language, graph. What isn't a quad matches without groups.
_LINE = rf"\A(?:\s*({_NODE})\s*({_IRI})\s*(?:({_NODE})|{_LITERAL})\s*(?:({_NODE})\s*)?\.\s*(?:#.*)?|(?s:.*+))\z"
_BLANK_LINE = r"\A\s*(?:#.*)?\z"


def unescape(lex: Column) -> Column:
    r"""Characters for \t \b \n \r \f \" \' \\ and \uXXXX, \UXXXXXXXX."""
    parts = F.regexp_extract_all(lex, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))
    simple = F.create_map(*[F.lit(x) for pair in ((r"\t", "\t"), (r"\b", "\b"), (r"\n", "\n"), (r"\r", "\r"), (r"\f", "\f"), (r"\"", '"'), (r"\'", "'"), (r"\\", "\\")) for x in pair])

    def one(x: Column) -> Column:
        code = F.conv(F.substring(x, 3, 8), 16, 10).cast("int")
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(x.rlike(r"(?i)\A\\u[0-9a-f]{4,8}\z"), wide).when(x.startswith("\\"), F.coalesce(F.element_at(simple, x), x)).otherwise(x)

    return F.when(lex.contains("\\"), F.array_join(F.transform(parts, one), "")).otherwise(lex)


def escape(lex: Column) -> Column:
    out = lex
    for plain, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def _inside(part: Column) -> Column:
    return F.substr(part, F.lit(2), F.length(part) - F.lit(2))


def _groups(line: Column) -> Column:
    """The groups of _LINE by one match, joined by line feeds, which no term holds."""
    return F.split(F.regexp_replace(line, _LINE, "\n".join(f"${k}" for k in range(1, 8))), "\n", -1)


def parse(line: Column) -> dict[str, Column]:
    """Terms s, p, o, g of a line; all null if the line is null or isn't a quad."""
    return _terms(_groups(line))


def _terms(parts: Column) -> dict[str, Column]:
    s, p, node, string, dt, lang, g = [F.get(parts, F.lit(k)) for k in range(7)]
    ok = p != ""
    of_node = lambda x: F.when(x.startswith("_"), t.bnode(F.substr(x, F.lit(3)))).otherwise(t.iri(unescape(_inside(x))))
    lex = unescape(_inside(string))
    literal = F.when(lang != "", t.term(t.LITERAL, lex, t.LANG_STRING, F.lower(lang))).otherwise(t.term(t.LITERAL, lex, F.when(dt != "", unescape(_inside(dt))).otherwise(t.STRING)))
    graph = F.when(g == "", t.default_graph()).otherwise(of_node(g))
    return {"s": F.when(ok, of_node(s)), "p": F.when(ok, t.iri(unescape(_inside(p)))), "o": F.when(ok, F.when(node != "", of_node(node)).otherwise(literal)), "g": F.when(ok, graph)}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Quads of N-Quads files. Blank lines and comments are left out, and lines that aren't quads, which rejected() gives."""
    # A filter beside the match would be a second match; an array of one or no match isn't.
    quad = F.filter(F.array(_groups(F.col("value"))), lambda parts: F.get(parts, F.lit(1)) != "")
    return spark.read.text(path).select(F.explode(quad).alias("parts")).select(*[c.alias(n) for n, c in _terms(F.col("parts")).items()])


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the lines of N-Quads files that are no quad, blank line or comment."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    quad = F.regexp_replace("value", _LINE, "$2") != ""
    return lines.filter(~quad & ~F.col("value").rlike(_BLANK_LINE))


def spell(term: Column) -> Column:
    """A term as N-Quads; '' for the default graph."""
    string = F.concat(F.lit('"'), escape(term["lex"]), F.lit('"'))
    literal = F.when(term["lang"] != "", F.concat(string, F.lit("@"), term["lang"])).when(term["dt"] == t.STRING, string).otherwise(F.concat(string, F.lit("^^<"), term["dt"], F.lit(">")))
    return F.when(term["kind"] == t.IRI, F.concat(F.lit("<"), term["lex"], F.lit(">"))).when(term["kind"] == t.BLANK, F.concat(F.lit("_:"), term["lex"])).when(term["kind"] == t.LITERAL, literal).otherwise("")


def lines(quads: DataFrame) -> DataFrame:
    """(value): one line for each quad."""
    names = F.array(*[spell(F.col(c)) for c in "spog"])
    return quads.select(F.concat(F.array_join(F.filter(names, lambda x: x != ""), " "), F.lit(" .")).alias("value"))


def strings(quads: DataFrame) -> DataFrame:
    """(subject, predicate, object, graph) as strings."""
    return quads.select(*[spell(F.col(c)).alias(n) for c, n in zip("spog", ("subject", "predicate", "object", "graph"))])


def write(quads: DataFrame, path: str) -> None:
    lines(quads).write.text(path)
