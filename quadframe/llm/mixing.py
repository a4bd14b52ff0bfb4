"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of the wanted total, clamped at ``max_epochs`` times its size; what is cut
off is shared again by weight until no source is above its cap. Sorting the sources by cap / weight makes that fixed
point one pass of prefix sums. A source then takes every document ``floor(target / size)`` times, and once more those
documents that come first in a seeded order, up to the rest of its target.

The prefix of the seeded order is found without sorting a whole source in one task: words are summed by (source, leading
digits of the key), prefix sums run over those sums, and only the one slice that the cut falls into is ordered by row.

Null and empty texts have size 0 and are taken 0 words; a very long text counts by its words like any other, so a source's
total may miss its target by half its longest text. A null source is a source of its own and comes last. Repeated rows are
separate documents; rows of one identifier and size go by a hash of their other columns, so that reruns agree. Columns of
the input may have any names. Without any words all targets are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import Work, word_count

#: Hexadecimal digits of the seeded key that name a slice: at most 65,536 sums a source, whatever its size.
SLICE_DIGITS = 4


def targets(sources: DataFrame, weights: Sequence[float], epochs: float, max_epochs: float) -> DataFrame:
    """One row per (source, source_size): adds weight and target. One row a source, so global windows are small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    df = sources.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    df = df.withColumn("cap", max_epochs * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    df = df.withColumn("wanted", epochs * F.sum("source_size").over(every))
    df = df.withColumn("left", F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    df = df.withColumn("capped", F.col("left") >= F.col("fill") * F.sum("weight").over(rest))
    spare = F.col("wanted") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    share = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(every)
    return df.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * (spare / share))).select(
        "source", "source_size", "weight", "target"
    )


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: float = 1.5, max_epochs: float = 2.0, seed: int = 9, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, times, taken) for each row of docs, and a struct row of the columns
    named in keep, if any.

    times is how often the mix repeats the row, taken the words that makes.
    """
    work = Work(docs.sparkSession, "mix")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    # Rows of one identifier and size go by the other columns; rows equal in all stand for each other.
    tie = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in keep]) if keep else F.lit(0)
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), *[x for x in (kept.alias("row"), tie.alias("tie")) if keep])
    rows = work.save(rows, "rows").withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    slices = work.save(rows.groupBy("source", "slice").agg(F.sum("size").alias("words")), "slices")
    plan = targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = work.save(plan.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "of"), "plan")
    along = Window.partitionBy("source").orderBy("slice")
    cut = (
        slices.withColumn("upto", F.sum("words").over(along))
        .join(plan, F.col("source").eqNullSafe(F.col("of")))
        .filter((F.col("upto") - F.col("words") < F.col("part")) & (F.col("part") <= F.col("upto")))
        .select(F.col("of").alias("cut_of"), F.col("slice").alias("cut"), (F.col("upto") - F.col("words")).alias("start"))
    )
    plan = work.save(plan.join(cut, F.col("of").eqNullSafe(F.col("cut_of")), "left").drop("cut_of"), "cuts")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    inside = F.coalesce(F.col("slice") == F.col("cut"), F.lit(False))
    # Without a cut the rest is 0 words.
    outside = joined.filter(~inside).withColumn("more", F.coalesce((F.col("slice") < F.col("cut")).cast("int"), F.lit(0)))
    order = Window.partitionBy("source").orderBy("key", "size", *["tie"][: bool(keep)]).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("start") + F.sum("size").over(order) - F.col("size") / 2
    within = joined.filter(inside).withColumn("more", (middle < F.col("part")).cast("int"))
    out = outside.unionByName(within).withColumn("times", (F.col("whole") + F.col("more")).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), *["row"][: bool(keep)])


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it; rows taken 0 times go."""
    mixed = mix(docs, keep=docs.columns, **options).filter("times > 0")
    repeated = mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
