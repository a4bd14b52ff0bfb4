"""Commitments to a dataset: hashed quads in order, a hash tree over them, and membership and absence checks.

Hashes are SHA-256 in lower-case hexadecimals, so their first digits spread rows evenly: places are counted by bucket of
leading digits, never in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as t
from ..sources.scratch import checkpointed

LOW, HIGH = "0" * 64, "f" * 64
#: Leading hexadecimal digits that name a bucket.
DIGITS = 4
#: Levels of the hash tree that one shuffle goes up: a subtree of 2 ** STEP nodes stands in one row.
STEP = 8
#: Tags that keep kinds of hashes apart.
QUAD_TAG, PREFIX_TAG, NODE_TAG = "quad", "prefix", "node"


def special(term: Column) -> Column:
    """Canonical text of a literal's value: 0 or 1, an integer, epoch milliseconds, else the lexical form."""
    return F.coalesce(t.v_bool(term).cast("int").cast("string"), t.v_int(term).cast("string"), F.unix_millis(t.v_ts(term)).cast("string"), term["lex"])


def term_hash(term: Column) -> Column:
    """Over kind, lexical form, value, language and datatype, each with its length."""
    parts = [term["kind"].cast("string"), term["lex"], special(term), term["lang"], term["dt"]]
    return F.sha2(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]), 256)


def quad_hash(*terms: Column) -> Column:
    return F.sha2(F.concat(F.lit(QUAD_TAG), *map(term_hash, terms)), 256)


def prefix_hash(s: Column, p: Column, g: Column) -> Column:
    return F.sha2(F.concat(F.lit(PREFIX_TAG), *map(term_hash, (s, p, g))), 256)


def hashed(quads: DataFrame) -> DataFrame:
    """(h, s, p, o, g): hashes without a commitment."""
    return quads.select(quad_hash(*[F.col(c) for c in "spog"]).alias("h"), *"spog")


def leaves_of(rows: DataFrame) -> DataFrame:
    """rows, which have a hash h, with idx from 1 in the order of h; and sentinels below and above them."""
    bucket = F.substring("h", 1, DIGITS)
    sizes = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # At most 16 ** DIGITS rows.
    before = sizes.select(F.col("bucket").alias("b"), (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    others = [c for c in rows.columns if c != "h"]
    order = Window.partitionBy("bucket").orderBy("h", *others)
    placed = rows.withColumn("bucket", bucket).withColumn("nth", F.row_number().over(order)).join(before, F.col("bucket") == F.col("b"))
    inner = placed.select((F.col("before") + F.col("nth")).alias("idx"), "h", *others)
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in others]
    low = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("idx"), F.lit(LOW).alias("h"), *nothing)
    high = rows.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") + 1).alias("idx"), F.lit(HIGH).alias("h"), *nothing)
    return inner.unionByName(low).unionByName(high)


def leaves(quads: DataFrame) -> DataFrame:
    return leaves_of(hashed(quads))


def prefix_leaves(quads: DataFrame) -> DataFrame:
    """Leaves over the distinct (s, p, g)."""
    return leaves_of(quads.select(prefix_hash(*[F.col(c) for c in "spg"]).alias("h"), *"spg").distinct())


def _parent(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit(NODE_TAG), left, right), 256)


def _height(n: int) -> int:
    return max(0, n - 1).bit_length()


def _subtrees(nodes: DataFrame, step: int) -> DataFrame:
    """(top, t0, ..., tstep) of nodes (idx, h): the hashes of each subtree of that height, by level; top is its root's place."""
    members = F.array_sort(F.collect_list(F.struct("idx", "h")))
    out = nodes.groupBy(F.shiftright("idx", step).alias("top")).agg(members.alias("members")).select("top", F.transform("members", lambda x: x["h"]).alias("t0"))
    for k in range(step):
        below = F.col(f"t{k}")
        places = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int"))
        out = out.withColumn(f"t{k + 1}", F.transform(places, lambda i: _parent(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.get(below, 2 * i)))))  # noqa: B023
    return out


def levels(leaf: DataFrame) -> DataFrame:
    """(level, idx, h) from the leaves at 0 to the root; a node without a sibling is paired with itself. STEP levels a shuffle."""
    nodes = checkpointed(leaf.select("idx", "h"))
    height, base = _height(nodes.count()), 0
    out = nodes.select(F.lit(0).alias("level"), "idx", "h")
    while base < height:
        step = min(STEP, height - base)
        trees = checkpointed(_subtrees(nodes, step))
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"t{k}").alias("t")) for k in range(1, step + 1)])).alias("one")
        rows = trees.select("top", each).select("top", "one.k", F.posexplode("one.t").alias("nth", "h"))
        rows = rows.select((F.col("k") + base).alias("level"), F.expr(f"shiftleft(top, {step} - k) + nth").alias("idx"), "h")
        out = out.unionByName(rows)
        nodes, base = trees.select(F.col("top").alias("idx"), F.col(f"t{step}")[0].alias("h")), base + step
    return out


def root(level: DataFrame) -> DataFrame:
    """(root) of a level table."""
    return level.agg(F.max_by("h", "level").alias("root"))


def _partial_paths(wanted: DataFrame, level: DataFrame, base: int, step: int) -> DataFrame:
    """(idx, h, steps) of wanted nodes (idx, h) of level base: siblings up to level base + step, from one shuffle by subtree."""
    nodes = level.filter((F.col("level") >= base) & (F.col("level") < base + step))
    top = F.expr(f"shiftright(idx, {base + step} - level)")
    nodes = nodes.select(top.alias("top"), F.struct((F.col("level") - base).alias("k"), "idx", "h").alias("node"))
    asked = wanted.select(F.shiftright("idx", step).alias("top"), F.struct(F.lit(-1).alias("k"), "idx", "h").alias("node"))
    both = nodes.unionByName(asked).groupBy("top").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    of = lambda k: F.filter("nodes", lambda x: x["k"] == k)
    both = both.select("top", *[F.transform(of(k), lambda x: x["h"]).alias(f"t{k}") for k in range(step)], of(-1).alias("asked"))

    def of_one(one: Column) -> Column:
        steps = []
        for k in range(step):
            own = F.shiftright(one["idx"] - F.col("top") * (1 << step), k).cast("int")
            sibling = F.coalesce(F.get(F.col(f"t{k}"), own.bitwiseXOR(F.lit(1))), F.get(F.col(f"t{k}"), own))
            steps.append(F.struct(F.lit(base + k).alias("level"), sibling.alias("sibling"), own.bitwiseAND(F.lit(1)).alias("dir")))
        return F.struct(one["idx"].alias("idx"), one["h"].alias("h"), F.array(*steps).alias("steps"))

    # Steps are made before rows multiply, so no row carries the nodes of its subtree along.
    return both.select("top", F.explode(F.transform("asked", of_one)).alias("one")).select("top", "one.*")


def paths(leaf: DataFrame, level: DataFrame) -> DataFrame:
    """(idx, h, path) of some leaves: path is an array of (level, sibling, dir), dir 1 where the sibling is on the left.

    Paths are cut every STEP levels. The lowest part comes from one shuffle of leaves and nodes by subtree; what stands above
    is one part for each subtree, in tables that are 2 ** STEP times smaller each.
    """
    height = level.agg(F.max("level")).first()[0]
    if not height:
        return leaf.select("idx", "h", F.array().cast("array<struct<level:int,sibling:string,dir:int>>").alias("path"))
    out, base = _partial_paths(leaf.select("idx", "h"), level, 0, min(STEP, height)), min(STEP, height)
    while base < height:
        step = min(STEP, height - base)
        here = level.filter(F.col("level") == base).select("idx", "h")
        upper = _partial_paths(here, level, base, step).select(F.col("idx").alias("at"), F.col("steps").alias("more"), F.col("top").alias("next"))
        out = out.join(upper, F.col("top") == F.col("at")).select(F.col("next").alias("top"), "idx", "h", F.concat("steps", "more").alias("steps"))
        base += step
    return out.select("idx", "h", F.col("steps").alias("path"))


def root_of_path(h: Column, path: Column) -> Column:
    """The root that a leaf and its path give; null if a direction isn't 0 or 1."""
    up = F.aggregate(path, h, lambda acc, s: F.when(s["dir"] == 0, _parent(acc, s["sibling"])).when(s["dir"] == 1, _parent(s["sibling"], acc)))
    return up


def index_of_path(path: Column) -> Column:
    """The leaf's place from the directions, lowest bit first."""
    return F.aggregate(F.reverse(path), F.lit(0).cast("long"), lambda acc, s: acc * 2 + s["dir"])


def included(idx: Column, h: Column, path: Column, root_: str) -> Column:
    """Whether a leaf with this path, at this place, belongs to the root."""
    return F.coalesce((root_of_path(h, path) == root_) & (index_of_path(path) == idx), F.lit(False))


def check_inclusion(paths_: DataFrame, root_: str) -> DataFrame:
    """paths_ with ok: whether the leaf, at its place, belongs to the root."""
    return paths_.withColumn("ok", included(F.col("idx"), F.col("h"), F.col("path"), root_))


def check_sentinels(leaf: DataFrame, paths_: DataFrame, root_: str) -> DataFrame:
    """(ok): whether the first and the last place hold the sentinels of the root."""
    last = leaf.agg(F.max("idx")).first()[0]
    ends = check_inclusion(paths_.filter(F.col("idx").isin(0, last)), root_)
    right = F.when(F.col("idx") == 0, F.col("h") == LOW).otherwise(F.col("h") == HIGH)
    return ends.agg((F.coalesce(F.bool_and(F.col("ok") & right), F.lit(False)) & (F.count(F.lit(1)) == 2)).alias("ok"))


def marks_of(leaf: DataFrame) -> DataFrame:
    """(b, least, most): first and last place of each bucket of leading digits; at most 16 ** DIGITS rows."""
    return leaf.groupBy(F.substring("h", 1, DIGITS).alias("b")).agg(F.min("idx").alias("least"), F.max("idx").alias("most"))


def absent(probes: DataFrame, leaf: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """probes, which have a hash h, with the neighbouring leaves' places, where they stand, and whether h is a leaf.

    tag: 0 below all quads, 1 between two, 2 above all, null if present. Probes meet leaves within buckets of leading
    digits, in two running passes of opposite order, so time is linear but for sorting. What a bucket lacks comes from
    marks, one row for each bucket; with marks of all leaves, leaf may be just the buckets of the probes.
    """
    known = leaf.select("idx", "h")
    marks = marks_of(known) if marks is None else marks
    top = marks.agg(F.max("most")).first()[0]
    bucket = F.substring("h", 1, DIGITS)
    asked = probes.select("h").distinct().select("h", F.lit(None).cast("long").alias("idx"))
    both = asked.unionByName(known).withColumn("bucket", bucket)
    passed = lambda order: Window.partitionBy("bucket").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.select("bucket", "h", "idx", F.max("idx").over(passed(F.asc("h"))).alias("low"), F.min("idx").over(passed(F.desc("h"))).alias("high")).filter("idx is null")
    # Neighbours outside the bucket: at most 16 ** DIGITS rows of marks and asked buckets.
    wanted = marks.select("b", "least", "most").unionByName(asked.select(bucket.alias("b")).distinct(), allowMissingColumns=True).groupBy("b").agg(F.max("least").alias("least"), F.max("most").alias("most"))
    before = lambda order: Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    edges = wanted.select("b", F.max("most").over(before(F.asc("b"))).alias("before"), F.min("least").over(before(F.desc("b"))).alias("after"))
    got = placed.join(edges, F.col("bucket") == F.col("b"))
    present = F.coalesce(F.col("low") >= F.col("high"), F.lit(False))
    left_idx = F.coalesce("low", "before")
    right_idx = F.when(present, F.col("low")).otherwise(F.coalesce("high", "after"))
    got = got.select("h", left_idx.alias("left_idx"), right_idx.alias("right_idx"), present.alias("present"))
    tag = F.when(~F.col("present"), F.when(F.col("left_idx") == 0, 0).when(F.col("right_idx") == top, 2).otherwise(1))
    return probes.join(got.withColumn("tag", tag), "h")
