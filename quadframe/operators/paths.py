"""Property paths as edge tables (src, dst).

Paths of one or more steps number their nodes first: one distinct pass over the edges makes a dictionary of terms, rounds
join pairs of 64-bit numbers, and terms come back once at the end. A walk between two constants goes from both ends, the
smaller side first, and holds nodes instead of pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.mapping import Const, Quads
from ..sources.scratch import checkpointed
from .patterns import Solutions, _name

#: A path: from quads, a depth bound, and a constant source or destination or None, to edges between such ends.
Path = Callable[..., DataFrame]


def _ends(edges: DataFrame, src: Const | None, dst: Const | None) -> DataFrame:
    for name, x in (("src", src), ("dst", dst)):
        edges = edges if x is None else edges.filter(F.col(name) == x.struct)
    return edges


def link(p: Const) -> Path:
    def edges(q, _, src=None, dst=None):
        return q.scan(src or "?s", p, dst or "?o").select(F.col("s").alias("src"), F.col("o").alias("dst"))

    return edges


def inv(path: Path) -> Path:
    return lambda q, d, src=None, dst=None: path(q, d, dst, src).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _step(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("src", F.col("dst").alias("mid")), b.select(F.col("src").alias("mid"), "dst")
    return left.join(right, "mid").select("src", "dst")


def seq(*paths: Path) -> Path:
    def edges(q, d, src=None, dst=None):
        last = len(paths) - 1
        out = None
        for k, p in enumerate(paths):
            here = p(q, d, src if k == 0 else None, dst if k == last else None)
            out = here if out is None else _step(out, here)
        return out

    return edges


def alt(*paths: Path) -> Path:
    def edges(q, d, src=None, dst=None):
        out = paths[0](q, d, src, dst)
        for p in paths[1:]:
            out = out.unionByName(p(q, d, src, dst))
        return out

    return edges


def nps(*predicates: Const) -> Path:
    """Edges whose predicate is none of these."""

    def edges(q, _, src=None, dst=None):
        rest = q.without([p.lex for p in predicates])
        scan = q.scan(src or "?s", "?p", dst or "?o").limit(0) if rest is None else rest.scan(src or "?s", "?p", dst or "?o")
        return scan.select(F.col("s").alias("src"), F.col("o").alias("dst"))

    return edges


def nodes(q: Quads, src: Const | None = None, dst: Const | None = None) -> DataFrame:
    """(src, dst): each subject and object of the graph with itself; a constant end, in the graph or not, with itself."""
    end = src or dst
    if end is not None:
        return _ends(q.spark.range(1).select(end.struct.alias("src"), end.struct.alias("dst")), src, dst)
    all_ = q.scan("?s", "?p", "?o")
    each = all_.select(F.explode(F.array("s", "o")).alias("src")).distinct()
    return each.select("src", F.col("src").alias("dst"))


def opt(path: Path) -> Path:
    return lambda q, d, src=None, dst=None: path(q, d, src, dst).unionByName(nodes(q, src, dst)).distinct()


def plus(path: Path, max_depth: int | str | None = "default") -> Path:
    """Distinct pairs over 1 to max_depth steps; None goes on until nothing is new.

    A constant end bounds the walk: it starts there, and only what it reaches is ever kept.
    """
    if isinstance(max_depth, int) and max_depth < 1:
        raise ValueError("one or more steps need a depth of at least 1")

    def edges(q, d, src=None, dst=None):
        if src is None and dst is not None:
            return inv(plus(inv(path), max_depth))(q, d, None, dst)
        most = d if max_depth == "default" else max_depth
        if most == 1:
            return path(q, d, src, dst).distinct()
        step = checkpointed(path(q, d).distinct())
        terms, numbered = _numbered(step)
        of = lambda x: terms.filter(F.col("term") == x.struct).select("node")
        if src is not None and dst is not None:
            met = _meets(of(src), of(dst), numbered, most)
            return step.select("src", "dst").limit(0).unionByName(q.spark.range(int(met)).select(src.struct.alias("src"), dst.struct.alias("dst")))
        first = numbered if src is None else checkpointed(numbered.join(of(src), F.col("a") == F.col("node"), "left_semi"))
        reached = _closure(first, numbered, most)
        named = lambda df, n, c: df.join(terms.select(F.col("node").alias(n), F.col("term").alias(c)), n)
        return named(named(reached, "a", "src"), "b", "dst").select("src", "dst")

    return edges


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, term) of all ends, and the edges (a, b) by number."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("term")).distinct()
    terms = checkpointed(ends.select(F.monotonically_increasing_id().alias("node"), "term"))
    one = lambda n: terms.select(F.col("node").alias(n), F.col("term").alias(f"{n}_term"))
    pairs = edges.join(one("a"), F.col("src") == F.col("a_term")).join(one("b"), F.col("dst") == F.col("b_term"))
    return terms, checkpointed(pairs.select("a", "b"))


def _closure(first: DataFrame, step: DataFrame, most: int | None) -> DataFrame:
    """Distinct (a, b) that first and further steps connect, all in numbers; rounds are saved apart and read together at the end."""
    follow = step.select(F.col("a").alias("b"), F.col("b").alias("c"))
    rounds, depth = [first], 1
    while (most is None or depth < most) and not rounds[-1].isEmpty():
        fresh = rounds[-1].join(follow, "b").select("a", F.col("c").alias("b"), F.lit(True).alias("new"))
        for known in rounds:
            fresh = fresh.unionByName(known.select("a", "b", F.lit(False).alias("new")))
        # One shuffle both makes pairs distinct and leaves out those that are known.
        rounds.append(checkpointed(fresh.groupBy("a", "b").agg(F.bool_and("new").alias("new")).filter("new").select("a", "b")))
        depth += 1
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def _meets(src: DataFrame, dst: DataFrame, step: DataFrame, most: int | None) -> bool:
    """Whether 1 to most steps lead from src to dst, each a table of at most one node; nodes are reached from both ends."""
    ways = [step.select(F.col("a").alias("node"), F.col("b").alias("to")), step.select(F.col("b").alias("node"), F.col("a").alias("to"))]

    def expand(side: int) -> None:
        fresh = layers[side].join(ways[side], "node").select(F.col("to").alias("node")).distinct()
        layers[side] = checkpointed(fresh if seen[side] is None else fresh.join(seen[side], "node", "left_anti"))
        seen[side] = layers[side] if seen[side] is None else seen[side].unionByName(layers[side])
        sizes[side] = layers[side].count()

    dst = checkpointed(dst)
    layers, seen, sizes, length = [src, dst], [None, dst], [1, 1], 1
    expand(0)
    while sizes[0] and sizes[1]:
        if not seen[0].join(seen[1], "node", "left_semi").isEmpty():
            return True
        if length == most:
            return False
        expand(int(sizes[1] < sizes[0]))
        length += 1
    return False


def star(path: Path, max_depth: int | str | None = "default") -> Path:
    """plus() and no step at all; max_depth 0 is no step only."""
    if max_depth == 0:
        return nothing()
    return lambda q, d, src=None, dst=None: plus(path, max_depth)(q, d, src, dst).unionByName(nodes(q, src, dst)).distinct()


def nothing() -> Path:
    """The step of length zero."""
    return lambda q, _, src=None, dst=None: nodes(q, src, dst)


def path(quads: Quads, subject, expr: Path, obj, max_depth: int | None = 4) -> Solutions:
    """Pairs that expr connects. A constant end is part of the walk, and a step of length zero leads from it to itself."""
    if max_depth is not None and max_depth < 1:
        raise ValueError("max_depth is at least 1")
    edges = expr(quads, max_depth, *[x if isinstance(x, Const) else None for x in (subject, obj)])
    names: dict[str, str] = {}
    for place, x in (("src", subject), ("dst", obj)):
        if isinstance(x, Const):
            continue
        if (name := _name(x)) in names:
            edges = edges.filter(F.col(names[name]) == F.col(place))
        else:
            names[name] = place
    shown = {n: c for n, c in names.items() if not n.startswith("__")}
    return Solutions(edges.select(*[F.col(c).alias(n) for n, c in shown.items()]), set(shown))


__all__ = ["Path", "alt", "inv", "link", "nodes", "nothing", "nps", "opt", "path", "plus", "seq", "star"]
