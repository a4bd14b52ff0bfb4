"""SimHash near-duplicates found through a Gray-order hierarchical index.

Distinct fingerprints are put under upper nodes, each a mask and the bit pattern that its members share under it. The
masks of a level cut the bits that are still free into ``radius + 1`` blocks, so two fingerprints that differ in at most
``radius`` bits share a node of every level; nodes with many members get children until all nodes are small. Inside a
node the members are sorted by Gray rank, and a tree stands over that order: leaves of neighbours, and groups of groups above
them, each with the mask of the bits in which all below agree and their pattern, of which a group keeps what its parent
doesn't have already. Each leaf descends the tree from the root and adds up, group by group, the bits that differ under
both masks; as soon as the sum exceeds ``radius`` the whole group is pruned. Only leaves that remain are compared member by
member. A node emits a spanning forest of its links, never all pairs; connected
components then come from label propagation with pointer jumping.

A wide fingerprint has 128 bits: the first 64 are indexed with ``radius``, and what they bring together must also agree in
all but ``total`` of the 128, which tells texts of a Jaccard similarity of 0.8 from chance. At the defaults (five words,
radius 10, total 24) a pair of similarity 0.9 is linked with an estimated probability of 0.93, and one of 0.5 with 0.02.

Null and empty texts have fingerprint 0 and link like any other; very long ones are cut into shingles whole. Repeated rows
are separate documents. Null identifiers are ignored in the choice of a component's smallest, which is null if there is no
other. Ties can't arise: links and smallest identifiers don't depend on order. An empty table gives an empty result. Other
columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Work

#: Members above which a node of the index gets children.
NODE_SIZE = 8192
#: Neighbours in Gray order that form a leaf, and groups that form a larger one.
LEAF, FAN = 32, 8
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, width: int, wide: bool = False) -> tuple[int, int]:
    """SimHash of the text's word shingles: 64 bits by XXH64, or if wide 64 and 64 more by XXH3, else 0.

    A-Z count as a-z, words end at ASCII white space.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0, 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    ones = np.zeros(128 if wide else 64, np.int64)
    for at in range(0, n, _SHINGLES_AT_ONCE):
        spans = zip(starts[at : at + _SHINGLES_AT_ONCE], ends[at : at + _SHINGLES_AT_ONCE])
        if wide:
            h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(line[s:e], 42) for s, e in spans]), np.uint8)
        else:
            h = np.array([xxhash.xxh64_intdigest(line[s:e], 42) for s, e in spans], dtype="<u8").view(np.uint8)
        ones += np.unpackbits(h.reshape(-1, len(ones) // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    halves = np.packbits(ones * 2 > n, bitorder="little").view("<u8").tolist()
    return halves[0], halves[1] if wide else 0


def fingerprint_of(hashes: np.ndarray) -> int:
    """64 bits, signed, of a text's shingle hashes: each is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SHINGLES_AT_ONCE):
        ones += np.unpackbits(hashes[at : at + _SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int, wide: bool = False) -> DataFrame:
    """(doc_id, text_key, fp, more) for each row of docs; fp and more hold 64 bits each as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width, wide) for t in batch.column(2).to_pylist()], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp[:, 0]), pa.array(fp[:, 1])], ["doc_id", "text_key", "fp", "more"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, fp long, more long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def child_masks(mask: int, radius: int) -> list[int]:
    """mask joined with each of radius + 1 blocks of its free bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << int(b) for b in block) for block in np.array_split(free, radius + 1) if len(block)]


def gray_rank(fp) -> Column:
    """Place of a bit pattern in the reflected Gray code: the xor of all its right shifts."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smaller labels for what the links i-j connect."""
    while len(i):
        a, b = label[i], label[j]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label != (up := label[label])).any():
            label = up
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def _alike(fp: np.ndarray, more: np.ndarray, i: np.ndarray, j: np.ndarray, total: int) -> np.ndarray:
    differing = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64) + np.bitwise_count(more[i] ^ more[j])
    return differing <= total


class GrayTree:
    """Groups of fingerprints in Gray order, from leaves to one root: the pattern that is shared below each, and its mask."""

    def __init__(self, fp: np.ndarray):
        cut = np.arange(0, len(fp), LEAF)
        low, high = np.bitwise_and.reduceat(fp, cut), np.bitwise_or.reduceat(fp, cut)
        self.pattern, self.mask = [low], [~(low ^ high)]
        while len(self.pattern[-1]) > 1:
            cut = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, cut), np.bitwise_or.reduceat(high, cut)
            self.pattern.append(low)
            self.mask.append(~(low ^ high))
        # What a group adds to its parent's mask.
        self.own = [m & ~np.repeat(up, FAN)[: len(m)] for m, up in zip(self.mask, self.mask[1:])] + [self.mask[-1]]
        self.visited = 0

    def leaves_near(self, leaf: int, radius: int) -> np.ndarray:
        """Leaves from this one on that no group above them prunes."""
        mask, pattern = self.mask[0][leaf], self.pattern[0][leaf]
        at, differing = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(len(self.pattern) - 1, -1, -1):
            self.visited += len(at)
            differing = differing + np.bitwise_count((self.pattern[level][at] ^ pattern) & self.own[level][at] & mask)
            stay = differing <= radius
            at, differing = at[stay], differing[stay]
            if level:
                at, differing = (at[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(differing, FAN)
                there = (at < len(self.pattern[level - 1])) & (at >= leaf // FAN ** (level - 1))
                at, differing = at[there], differing[there]
        return at


def forest_of_node(fp: np.ndarray, more: np.ndarray, radius: int, total: int) -> np.ndarray:
    """For each member, in Gray order, the first member that links connect it to."""
    n, label = len(fp), np.arange(len(fp))
    cut = np.arange(0, n, LEAF)
    size, tree = np.diff(np.append(cut, n)), GrayTree(fp)
    for a in range(len(cut)):
        near = tree.leaves_near(a, radius)
        others = np.concatenate([np.arange(cut[b], cut[b] + size[b]) for b in near])
        own = np.arange(cut[a], cut[a] + size[a])
        i, j = np.nonzero(np.bitwise_count(fp[own][:, None] ^ fp[others][None, :]) <= radius)
        i, j = own[i], others[j]
        fresh = (label[i] != label[j]) & _alike(fp, more, i, j, total)
        label = _join(label, i[fresh], j[fresh])
    return label


def forest_of_small_nodes(node: np.ndarray, fp: np.ndarray, more: np.ndarray, radius: int, total: int) -> np.ndarray:
    """As forest_of_node, for many nodes of a few members at once: members are compared lag by lag."""
    label, at, lag = np.arange(len(fp)), np.arange(len(fp)), 0
    while True:
        lag += 1
        at = at[at < len(fp) - lag]
        at = at[node[at] == node[at + lag]]
        if not len(at):
            return label
        i = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= radius]
        fresh = (label[i] != label[i + lag]) & _alike(fp, more, i, i + lag, total)
        label = _join(label, i[fresh], i[fresh] + lag)


def _links(radius: int, total: int):
    def of(mask: np.ndarray, pattern: np.ndarray, fp: np.ndarray, more: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """Links of whole nodes, members in the order of mask, pattern and Gray rank."""
        begins = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))))
        size = np.diff(np.append(begins, len(fp)))
        node, label = np.repeat(np.arange(len(begins)), size), np.arange(len(fp))
        where = np.flatnonzero(np.repeat((size > 1) & (size <= 2 * LEAF), size))
        if len(where):
            label[where] = where[forest_of_small_nodes(node[where], fp[where], more[where], radius, total)]
        for k in np.flatnonzero(size > 2 * LEAF):
            own = slice(begins[k], begins[k] + size[k])
            label[own] = begins[k] + forest_of_node(fp[own], more[own], radius, total)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int64, np.uint64, np.uint64, np.int64)
        left = [np.empty(0, k) for k in kinds]
        for batch in batches:
            left = [np.concatenate((a, c.to_numpy(zero_copy_only=False).view(k))) for a, c, k in zip(left, batch.columns, kinds)]
            mask, pattern = left[:2]
            last = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))
            if len(last):
                cut = last[-1] + 1
                yield of(*[a[:cut] for a in left])
                left = [a[cut:] for a in left]
        if len(left[0]):
            yield of(*left)

    return run


def links(distinct: DataFrame, work: Work, radius: int, total: int = 128, node_size: int = NODE_SIZE) -> DataFrame:
    """Links (u, v) of ids that connect what differing in at most radius bits of fp, and total of both, connects.

    distinct: (id, fp, more), one row for each fingerprint.
    """
    masks, found = child_masks(0, radius), []
    members = distinct.select("id", "fp", "more", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    for level in range(64):
        members = members.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        members = work.save(members, f"level{level}")
        large = members.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > node_size).select("mask", "pattern")
        large = work.save(large, f"large{level}")
        none = large.isEmpty()
        small = members if none else members.join(large, ["mask", "pattern"], "left_anti")
        whole = small.select("mask", "pattern", "fp", "more", "id", gray_rank(F.col("fp")).alias("rank")).repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "rank")
        found.append(work.save(whole.select("mask", "pattern", "fp", "more", "id").mapInArrow(_links(radius, total), "u long, v long").distinct(), f"links{level}"))
        if level:
            work.drop(f"level{level - 1}")
        if none:
            break
        below = {m: child_masks(m, radius) for m in masks}
        masks = sorted({c for children in below.values() for c in children})
        children = F.create_map(*[x for m, cs in below.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(c)) for c in cs]))])
        members = members.join(large, ["mask", "pattern"]).select("id", "fp", "more", F.explode(F.element_at(children, F.col("mask"))).alias("mask"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components(edges: DataFrame, work: Work) -> DataFrame:
    """(node, label) of every node with a link; label is the least node that links connect it to."""
    both = work.save(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = work.save(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels0")
    for step in count(1):  # labels only fall, so rounds end
        seen = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        hooked = work.save(labels.join(seen, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), f"hooked{step}")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("over"))
        new = work.save(hooked.join(up, "label").select("node", F.least("label", "over").alias("label"), "was"), f"labels{step}")
        work.drop(f"labels{step - 1}")
        work.drop(f"hooked{step}")
        labels = new
        if new.filter("label <> was").isEmpty():
            break
    return labels.select("node", "label")


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 10, total: int | None = 24) -> DataFrame:
    """(doc_id, text_key, fp, component_id) for each row of docs; component_id is the smallest doc_id reachable by links.

    total: for wide fingerprints, else None.
    """
    work = Work(docs.sparkSession, "simhash")
    key = F.col("fp") if total is None else F.xxhash64("fp", "more")
    prints = work.save(fingerprints(docs, width, total is not None).withColumn("id", key), "prints")
    distinct = work.save(prints.groupBy("id", "fp", "more").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(links(distinct, work, radius, 128 if total is None else total), work)
    linked = work.save(labels.join(distinct.select(F.col("id").alias("node"), "least"), "node"), "linked")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    of_id = work.save(linked.join(least, "label").select(F.col("node").alias("id"), "component_id"), "components")
    of_all = work.save(distinct.join(of_id, "id", "left").select("id", F.coalesce("component_id", "least").alias("component_id")), "all")
    return prints.join(of_all, "id").select("doc_id", "text_key", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one text of each group of near copies by exact similarity, see near.py."""
    from . import near

    return near.drop_near_copies(docs)


def spell(fp) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
