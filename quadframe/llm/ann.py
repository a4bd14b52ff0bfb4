"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: signs after rotations that are learned on a bounded sample (principal axes, a seeded turn, then
alternating fits of the signs, several turns side by side). Codes are cut into substrings and every substring of every
row is indexed. Entries are probed at growing distances from the query's substrings: 0, 1, 2 bits and so on. By the
pigeonhole principle, entries within d bits hold every code within m (d + 1) - 1 bits of the query, m the number of
substrings; probing ends when at least ``share`` of the block's codes lie within that radius, which are then its nearest.
The sizes of entries come first: as long as they hold fewer rows than wanted, none is fetched. Where looking up or fetching
would take longer than comparing all codes of the block, or has settled few queries so far, many queries' codes are compared
with them at once, 64 bits a step.
Either way the same rows are found. They are ranked by exact inner products in double precision, and the best of all blocks
are merged.

Queries are a stated set and meet the rows in blocks; a block's best ``k`` are all it passes on. Vectors that are null,
zero or hold null or non-finite components take no part, nor do those that differ in length from most. Ties go to the
smaller vec_id; repeated rows of an id are separate candidates. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Rows that the rotations are learned on, at most.
MAX_SAMPLE = 4_000
TURNS, FITS = 4, 12
SUBSTRING_BITS = 16
#: Part of a block's codes that lie within a query's radius, and least number of them.
SHARE, LEAST = 0.05, 64
#: Rows of a block and queries that meet it at once, at most: as few copies of either as a task's memory allows.
BLOCK_ROWS, LEAST_BLOCKS = 131_072, 16
QUERIES_AT_ONCE = 65_536
#: What looking up an entry and its slice of rows costs, in comparisons of a pair of codes; so does about one fetched row.
LOOK_UP = 12
#: Queries of a block that are probed for in any case; others as long as probing has settled a quarter of those before.
TRIED = 256
#: Queries and rows whose codes are compared in one step, so that they stay in a core's cache.
TOGETHER, TILE = 16, 4_096
_ALL = np.arange(1 << SUBSTRING_BITS, dtype=np.uint16)
#: By distance: what a substring is flipped by.
FLIPS = [_ALL[np.bitwise_count(_ALL) == d] for d in range(SUBSTRING_BITS + 1)]


def usable(rows: DataFrame, queries) -> tuple[DataFrame, int, int]:
    """(vec_id, v) of the rows that take part, v an array of floats or doubles; their number, and that of the queries."""
    kept = "array<float>" if rows.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.select("vec_id", F.col("embedding").cast(kept).alias("v")).filter("vec_id is not null and v is not null")
    good = good.filter(finite & F.exists("v", lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(queries).alias("queries")).orderBy(F.desc("rows"), "n").limit(1).collect()
    n, *counts = sizes[0] if sizes else (0, 0, 0)
    return good.filter(F.size("v") == n), *counts


def learn_rotations(sample: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotations side by side, one column a bit."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    rng, out = np.random.default_rng(seed), []
    for _ in range(TURNS):
        turn, _ = np.linalg.qr(rng.normal(size=axes.shape))
        y = x @ axes
        for _ in range(FITS):
            u, _, w = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
            turn = (u @ w).T
        out.append(axes @ turn)
    return mean, np.concatenate(out, axis=1)


def codes(v: np.ndarray, mean: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Substrings of each row's code, as unsigned 16-bit numbers."""
    bits = np.concatenate([np.packbits((v[at : at + TILE] - mean) @ rotations >= 0, axis=1) for at in range(0, max(len(v), 1), TILE)])
    if bits.shape[1] % 2:
        bits = np.pad(bits, ((0, 0), (0, 1)))
    return np.ascontiguousarray(bits).view(np.uint16)


def words(subs: np.ndarray) -> np.ndarray:
    """Codes as 64-bit words, a row for each word."""
    return np.ascontiguousarray(np.ascontiguousarray(np.pad(subs, ((0, 0), (0, -subs.shape[1] % 4)))).view(np.uint64).T)


class Index:
    """The substrings of a block of codes, each with the rows that hold it."""

    def __init__(self, subs: np.ndarray):
        self.subs, self.words, self.entries, self.probed = subs, words(subs), [], 0
        self.radius = 0
        for j in range(subs.shape[1]):
            sizes = np.bincount(subs[:, j], minlength=len(_ALL)).astype(np.int32)
            self.entries.append((sizes, np.argsort(subs[:, j], kind="stable").astype(np.int32)))
        self.ends = [np.cumsum(sizes) for sizes, _ in self.entries]

    def _fetch(self, query: np.ndarray, distance: int) -> np.ndarray:
        """Rows with a substring that differs from the query's in so many bits at most."""
        wanted, found = np.concatenate(FLIPS[: distance + 1]), np.zeros(len(self.subs), bool)
        for j, ((sizes, order), ends) in enumerate(zip(self.entries, self.ends)):
            at = query[j] ^ wanted
            starts = np.repeat(ends[at] - np.cumsum(sizes[at]), sizes[at])
            found[order[starts + np.arange(len(starts))]] = True
        return np.flatnonzero(found)

    def _probe(self, queries: np.ndarray, n: int) -> dict[int, np.ndarray]:
        """By number of the query, for those that growing probes settle in fewer steps than comparing all codes."""
        m, out, rest, held = self.subs.shape[1], {}, np.arange(len(queries)), np.zeros(len(queries), np.int64)
        asked = words(queries)
        for d, flips in enumerate(FLIPS):
            if LOOK_UP * m * len(flips) > len(self.subs) or not len(rest):
                break
            for j, (sizes, _) in enumerate(self.entries):
                held[rest] += sizes[queries[rest, j, None] ^ flips].sum(axis=1)
            rest = rest[held[rest] <= len(self.subs)]
            for i in rest[held[rest] >= n]:
                rows = self._fetch(queries[i], d)
                self.probed += len(rows)
                distance = np.bitwise_count(self.words[:, rows] ^ asked[:, i, None]).sum(axis=0, dtype=np.int64)
                if np.count_nonzero(distance <= m * (d + 1) - 1) >= n:
                    out[int(i)] = rows[distance <= np.partition(distance, n - 1)[n - 1]]
            rest = np.array([i for i in rest if i not in out], np.int64)
        return out

    def _compare(self, queries: np.ndarray, n: int):
        """For each query, from all codes."""
        asked = words(queries)
        distance = np.zeros((len(queries), len(self.subs)), np.uint16)
        for at in range(0, len(self.subs), TILE):
            part = distance[:, at : at + TILE]
            differ, count = np.empty(part.shape, np.uint64), np.empty(part.shape, np.uint8)
            for have, want in zip(self.words, asked):
                np.bitwise_xor(have[at : at + TILE], want[:, None], out=differ)
                part += np.bitwise_count(differ, out=count)
        self.probed += distance.size
        for one in distance:
            counts = (np.count_nonzero(one <= x) for x in range(self.radius - 2, self.radius + 3))  # mostly as for the query before
            step = next((i for i, c in enumerate(counts) if c >= n), 0)
            self.radius = self.radius - 2 + step if step else int(np.searchsorted(np.cumsum(np.bincount(one)), n))
            yield np.flatnonzero(one <= self.radius)

    def nearest_of(self, queries: np.ndarray, n: int):
        """For each query in turn, the n rows of nearest codes and all others at the distance of the last."""
        settled = 0
        for at in range(0, len(queries), TOGETHER):
            some = queries[at : at + TOGETHER]
            near = self._probe(some, n) if at <= TRIED + 4 * settled else {}
            settled += len(near)
            rest = [i for i in range(len(some)) if i not in near]
            compared = self._compare(some[rest], n) if rest else iter(())
            for i in range(len(some)):
                yield near[i] if i in near else next(compared)

    def nearest(self, query: np.ndarray, n: int) -> np.ndarray:
        return next(self.nearest_of(query[None], n))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from the query's in at most radius bits."""
        n, near = self.subs.shape[0], radius // self.subs.shape[1]
        found = np.zeros(n, bool)
        for j, (sizes, order) in enumerate(self.entries):
            probe = np.bitwise_count(_ALL ^ query[j]) <= near
            if probe.all():
                found[:] = True
            else:
                found[order[np.repeat(probe, sizes)]] = True
            if found.all():
                break
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.subs[rows] ^ query).sum(axis=1, dtype=np.int64) <= radius]


def best_of_block(qid: np.ndarray, q: np.ndarray, qs: np.ndarray, ids: np.ndarray, v: np.ndarray, subs: np.ndarray, k: int, share: float):
    """The k best candidates of the block for each query: query ids, ids, scores."""
    index, out = Index(subs), ([], [], [])
    want = min(len(ids), max(LEAST, k + 1, int(share * len(ids))))
    with np.errstate(all="ignore"):  # what is too long or short for this gives nan and is kept
        rough_v = (v / np.sqrt((v * v).sum(axis=1).max())).astype(np.float32)
        rough_q = (q / np.sqrt((q * q).sum(axis=1, keepdims=True))).astype(np.float32)
    rounding = 4 * v.shape[1] * np.finfo(np.float32).eps
    for i, rows in enumerate(index.nearest_of(qs, want)):
        rows = rows[ids[rows] != qid[i]]
        if len(rows) < min(k, len(ids) - 1):  # copies of the query's id stood in the way
            rows = np.flatnonzero(ids != qid[i])
        if len(rows) > k:  # those that rounding can't bring among the best are left
            rough = rough_v.take(rows, axis=0) @ rough_q[i]
            rows = rows[~(rough < np.partition(rough, -k)[-k] - rounding)]
        score = (v[rows] * q[i]).sum(axis=1)
        top = np.lexsort((ids[rows], -score))[:k]
        out[0].append(np.full(len(top), qid[i]))
        out[1].append(ids[rows][top])
        out[2].append(score[top])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def search(rows: DataFrame, queries, k: int = 20, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score). queries: a condition on vec_id that holds for the query rows."""
    spark = rows.sparkSession
    good, n, n_queries = usable(rows, queries)
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MAX_SAMPLE).select("v").collect()
    mean, rotations = learn_rotations(np.array([r["v"] for r in sample]))
    shared = spark.sparkContext.broadcast((mean, rotations))
    blocks, turns = max(LEAST_BLOCKS, -(-n // BLOCK_ROWS)), max(1, -(-n_queries // QUERIES_AT_ONCE))
    hashed = good.withColumn("h", F.xxhash64("vec_id"))
    pairs = F.explode(F.expr(f"sequence(0L, {turns - 1}L)")).alias("turn")
    base = hashed.select("vec_id", "v", F.pmod("h", F.lit(blocks)).alias("block"), pairs)
    asked = hashed.filter(queries).select("vec_id", "v", F.pmod(F.shiftright("h", 20), F.lit(turns)).alias("turn"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mean, rotations = shared.value

        def arrays(t: pa.Table):
            ids = t.column("vec_id").to_numpy().astype(np.int64)
            v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1) if len(ids) else np.empty((0, len(mean)))
            return ids, v, codes(v, mean, rotations)

        ids, v, subs = arrays(left)
        got = best_of_block(*arrays(right), ids, v, subs, k, share) if len(ids) else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.float64())})

    found = base.groupBy("block", "turn").cogroup(asked.groupBy("block", "turn")).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
