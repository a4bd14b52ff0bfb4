"""Near copies by SimHash and exact Jaccard similarity: texts that links of five-word shingle sets with a similarity of 0.8 connect.

The Gray-order index of SimHash fingerprints goes first: what it links within RADIUS bits, one forest of links a node, is
settled by the exact similarity and joined. That radius doesn't reach a similarity of 0.8 (some ten bits of 64 differ), so
an exact way takes the rest, between texts that aren't joined yet. There candidates share a band: 32 bands of 5 least hashes each, so a pair of similarity 0.8 has none in common with a
probability of (1 - 0.8 ** 5) ** 32 = 3e-6, and a closer pair with less. Each set has 256 parities: every hash flips one
of them. Sets whose parities differ in d places differ in d hashes or more, and sets of n and m hashes with a similarity of
0.8 differ in (n + m) / 9 at most, so pairs beyond that are put aside without loss. All others are settled by the exact
similarity of the two sets. Of each band's bucket the first members in the order of their set's name are compared with
all others of other components, then put away; their number grows 32-fold each round until no bucket holds two components.
So a dense group takes about one comparison a member, and no pair goes unseen because a group is large.

Equal sets are one member. Texts of fewer than five words have one shingle, the whole text; texts without words have none
and are copies of each other only. A-Z count as a-z, words end at ASCII white space. Null identifiers come last in the
choice of the document to keep, ties go by the text; rows equal in both stay together. Very long texts are cut into
shingles whole. Columns of the input may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .simhash import components, fingerprint_of, links
from .work import Work

WIDTH, BANDS, ROWS = 5, 32, 5
#: Bits in which fingerprints that the index links may differ.
RADIUS = 4
#: Words of 64 parities that each set has.
PARITIES = 4
#: Members of a bucket that meet all others in one round, at most; the optimizer cuts ranks up to 1,000 before a shuffle.
MOST_FIRST = 1000
#: By so much that number grows from one round to the next.
GROWS = 32
_AT_ONCE = 1 << 12
_rng = np.random.default_rng(17)
_TIMES, _PLUS, _MIX, _BAND = (_rng.integers(0, 1 << 64, n, np.uint64) for n in (BANDS * ROWS, BANDS * ROWS, ROWS, BANDS))
_TIMES |= np.uint64(1)
_MIX |= np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - WIDTH + 1) if words else 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).astype(np.int64) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    return np.unique(np.array([xxhash.xxh3_64_intdigest(line[s:e]) for s, e in zip(starts, ends[min(WIDTH, len(words)) - 1 :].tolist())], np.uint64))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Names of the set's bucket in each band; none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.min([(hashes[at : at + _AT_ONCE, None] * _TIMES + _PLUS).min(axis=0) for at in range(0, len(hashes), _AT_ONCE)], axis=0)
    name = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    return ((name ^ name >> np.uint64(29)) * _MIX[0] + _BAND).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bit b of word w is set if an odd number of hashes fall on it."""
    odd = np.bincount((hashes % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").astype(np.int64)


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, id, n, fp, parity, buckets) for each row of docs; id names the text's set of n shingles, 0 is the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            ids = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) if len(h) else 0 for h in sets], np.uint64).view(np.int64)
            parity, in_bands = (pa.array([f(h) for h in sets], pa.list_(pa.int64())) for f in (parities, buckets))
            n, fp = pa.array([len(h) for h in sets], pa.int32()), pa.array([fingerprint_of(h) for h in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids), n, fp, parity, in_bands], ["doc_id", "text_key", "id", "n", "fp", "parity", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, id long, n int, fp long, parity array<long>, buckets array<long>")


def sets_of(texts: DataFrame) -> DataFrame:
    """(id, shingles) for each (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(t).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (u, v, ...) whose sets have a Jaccard similarity of 0.8 or more, in whole numbers."""
    # v has few pairs; u may have very many, and is joined when rows are long enough to be dealt as skewed.
    both = pairs.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v").join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
    return both.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select(*pairs.columns)


def _renamed(df: DataFrame, new: DataFrame) -> DataFrame:
    """df with its labels replaced where new (node, to) has them."""
    return df.join(new, F.col("label") == F.col("node"), "left").withColumn("label", F.coalesce("to", "label")).select(*df.columns)


def simhash_pairs(rows: DataFrame, work: Work) -> DataFrame:
    """(u, v) of sets (id, n, fp) whose fingerprints the index links, or are equal; v hangs on u."""
    each = rows.filter("n > 0").select("id", "fp").distinct()
    first = work.save(each.groupBy("fp").agg(F.min("id").alias("id")), "first")
    indexing = Work(work.spark, "near-index")
    forest = links(first.select("id", "fp", F.lit(0).cast("long").alias("more")), indexing, RADIUS).select(F.col("v").alias("u"), F.col("u").alias("v"))
    equal = each.join(first.select("fp", F.col("id").alias("u")), "fp").filter("u <> id").select("u", F.col("id").alias("v"))
    pairs = work.save(forest.unionByName(equal).distinct(), "simhash")
    indexing.clear()
    return pairs


def _joined(nodes: DataFrame, members: DataFrame, found: DataFrame, work: Work, step: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and members with one label for what the links found (u, v) between labels connect."""
    linking = Work(work.spark, "near-links")
    new = work.save(components(found, linking).select("node", F.col("label").alias("to")), f"new{step}")
    linking.clear()
    return work.save(_renamed(nodes, new), f"nodes{step}"), _renamed(members, new)


def labels_of(members: DataFrame, nodes: DataFrame, sets: DataFrame, work: Work) -> DataFrame:
    """(id, label) of nodes, label naming what links connect. members: (bucket, id, n, parity, label), at first with id as label."""
    # Sets that differ in too many hashes, by their sizes or parities, can't be so similar.
    differ = " + ".join(f"bit_count(parity[{i}] ^ u_parity[{i}])" for i in range(PARITIES))
    may_link = f"u < id and u_label <> label and 5 * least(n, u_n) >= 4 * greatest(n, u_n) and 9 * ({differ}) <= n + u_n"
    first, step = 1, 0
    while True:
        several = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
        members = work.save(members.join(several, "bucket", "left_semi"), f"members{step}")
        if step:
            work.drop(f"members{step - 1}")
        if members.isEmpty():
            return nodes
        place = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
        heads = members.withColumn("place", place).filter(F.col("place") <= first).select("bucket", F.col("id").alias("u"), F.col("label").alias("u_label"), F.col("n").alias("u_n"), F.col("parity").alias("u_parity"))
        heads = work.save(heads, f"heads{step}")
        pairs = members.join(heads, "bucket").filter(may_link).select("u", F.col("id").alias("v"), "u_label", F.col("label").alias("v_label")).distinct()
        found = alike(work.save(pairs, f"pairs{step}"), sets).select(F.col("u_label").alias("u"), F.col("v_label").alias("v")).distinct()
        found = work.save(found, f"found{step}")
        members = members.join(heads.select("bucket", F.col("u").alias("id")), ["bucket", "id"], "left_anti")
        if not found.isEmpty():
            nodes, members = _joined(nodes, members, found, work, str(step))
        work.drop(f"pairs{step}")
        first, step = min(GROWS * first, MOST_FIRST), step + 1


def grouped(docs: DataFrame, work: Work) -> DataFrame:
    """(doc_id, text_key, label) for each row of docs; equal labels are near copies."""
    rows = work.save(prints(docs), "prints")
    every = rows.select("id", "n", "parity", "buckets").dropDuplicates(["id"]).select(F.explode("buckets").alias("bucket"), "id", "n", "parity")
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = work.save(every.join(shared, "bucket", "left_semi").withColumn("label", F.col("id")), "members")
    pairs = simhash_pairs(rows, work)
    in_pairs = pairs.select(F.explode(F.array("u", "v")).alias("id")).select("id", F.col("id").alias("label"))
    nodes = work.save(members.select("id", "label").unionByName(in_pairs).distinct(), "nodes")
    one = rows.join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.min("text_key").alias("text_key"))
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(one, "text_key").dropDuplicates(["id"])
    sets = work.save(sets_of(texts), "sets")
    found = work.save(alike(pairs, sets), "linked")
    if not found.isEmpty():
        nodes, members = _joined(nodes, members, found, work, "_simhash")
    labels = labels_of(members, nodes, sets, work)
    return rows.join(labels, "id", "left").select("doc_id", "text_key", F.coalesce("label", "id").alias("label"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one text of each group of near copies, that of the smallest doc_id."""
    work = Work(docs.sparkSession, "near")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("kept")
    kept = work.save(grouped(docs, work).groupBy("label").agg(first).select(F.col("kept.doc_id").alias("__id"), F.col("kept.text_key").alias("__key")), "kept")
    work.clear("kept")  # what is read from here on
    here = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col("doc_id").alias("of"), F.xxhash64("text").alias("text_key"))
    first = here.join(kept, F.col("of").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left_semi")
    return first.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
