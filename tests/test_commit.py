import bisect
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from quadframe.operators import commit
from quadframe.plans.tables import quads
from quadframe.sources import dataset


def parent(a, b):
    return hashlib.sha256(f"node{a}{b}".encode()).hexdigest()


def tree(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        here = out[-1]
        out.append([parent(here[i], here[i + 1] if i + 1 < len(here) else here[i]) for i in range(0, len(here), 2)])
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 513, 66_000])
def test_levels_and_paths(spark, n):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    leaf = spark.range(n).select(F.col("id").alias("idx"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    want = tree(hashes)
    level = commit.levels(leaf)
    if n < 1000:
        assert sorted(map(tuple, level.select("level", "idx", "h").collect())) == [(k, i, h) for k, row in enumerate(want) for i, h in enumerate(row)]
    assert commit.root(level).first()[0] == want[-1][0] and level.count() == sum(map(len, want))
    some = leaf.filter((F.col("idx") % 997 == 0) | (F.col("idx") == n - 1))
    got = {r["idx"]: (r["h"], [tuple(s) for s in r["path"]]) for r in commit.paths(some, level).collect()}
    assert sorted(got) == sorted({*range(0, n, 997), n - 1})
    for i, (h, path) in got.items():
        sibling = lambda k: want[k][(i >> k) ^ 1] if (i >> k) ^ 1 < len(want[k]) else want[k][i >> k]  # noqa: E731, B023
        assert h == hashes[i] and path == [(k, sibling(k), i >> k & 1) for k in range(len(want) - 1)]
    checked = commit.check_inclusion(commit.paths(leaf, level), want[-1][0])
    assert checked.filter("ok").count() == n


def brackets(leaves, probes):
    """By binary search: sorted (h) of the leaves, 0 the first place."""
    out = {}
    for h in probes:
        left, right = bisect.bisect_left(leaves, h), bisect.bisect_right(leaves, h)
        out[h] = (right - 1, right - 1, True, None) if right > left else (left - 1, left, False, 0 if left == 1 else 2 if left == len(leaves) - 1 else 1)
    return out


def test_brackets_against_binary_search(spark):
    rng = random.Random(4)
    near = lambda: rng.choice(["0000", "abcd", "abce", "ffff", "7"]) + "".join(rng.choice("01ef") for _ in range(60))
    inner = sorted(x[:64] for x in (near().ljust(64, "0") for _ in range(800)))
    inner += [inner[5]]  # a repeated leaf
    leaves = [commit.LOW, *sorted(inner), commit.HIGH]
    probes = [*(near().ljust(64, "1")[:64] for _ in range(900)), inner[5], inner[6], "0" * 63 + "1", "f" * 63 + "e", commit.LOW, commit.HIGH]
    leaf = spark.createDataFrame(list(enumerate(leaves)), "idx long, h string").repartition(3)
    asked = spark.createDataFrame([(h, i) for i, h in enumerate(probes)], "h string, own int")
    got = {r["h"]: (r["left_idx"], r["right_idx"], r["present"], r["tag"]) for r in commit.absent(asked, leaf).collect()}
    assert got == brackets(leaves, probes)
    assert commit.absent(asked, leaf).count() == len(probes) and commit.absent(asked.limit(0), leaf).collect() == []


def test_brackets_of_a_million_leaves_in_one_bucket(spark):
    n = 1_000_000
    name = lambda x: F.concat(F.lit("abcd"), F.lpad(F.hex(x), 60, "0"))
    inner = spark.range(n).select((F.col("id") + 1).alias("idx"), name(2 * F.col("id")).alias("h"))
    ends = spark.createDataFrame([(0, commit.LOW), (n + 1, commit.HIGH)], "idx long, h string")
    probes = spark.range(0, 2 * n, 7).select(name(F.col("id")).alias("h"), "id")
    began = time.time()
    got = commit.absent(probes, inner.unionByName(ends))
    right = F.when(F.col("id") % 2 == 0, F.col("present") & (F.col("left_idx") == F.col("id") / 2 + 1) & (F.col("right_idx") == F.col("left_idx")))
    right = right.otherwise(~F.col("present") & (F.col("left_idx") == (F.col("id") + 1) / 2) & (F.col("right_idx") == F.col("left_idx") + 1))
    assert got.agg(F.count(F.lit(1)), F.bool_and(right)).first() == (probes.count(), True)
    assert time.time() - began < 60


def test_brackets_of_all_buckets(spark):
    n = 16**commit.DIGITS
    name = lambda x: F.concat(F.lpad(F.lower(F.hex(x)), commit.DIGITS, "0"), F.lit("8" * (64 - commit.DIGITS)))
    inner = spark.range(0, n, 3).select((F.col("id") / 3 + 1).cast("long").alias("idx"), name(F.col("id")).alias("h"))
    last = inner.count()
    ends = spark.createDataFrame([(0, commit.LOW), (last + 1, commit.HIGH)], "idx long, h string")
    probes = spark.range(1, n, 3).select(name(F.col("id")).alias("h"), "id")
    began = time.time()
    got = commit.absent(probes, inner.unionByName(ends))
    assert got.agg(F.count(F.lit(1)), F.bool_and((F.col("left_idx") == F.floor(F.col("id") / 3) + 1) & (F.col("right_idx") == F.col("left_idx") + 1))).first() == (probes.count(), True)
    assert time.time() - began < 60


def test_look_ups_read_few_folders(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    dataset.save(quads(spark, "/root/testdata/sf0.001", "orders").quads(), path)
    leaf, level = dataset.load(spark, path)
    leaves = [r["h"] for r in leaf.orderBy("idx").collect()]
    assert leaves == sorted(leaves) and leaves[0] == commit.LOW and leaves[-1] == commit.HIGH
    assert dataset.root(spark, path) == tree(leaves)[-1][0] == commit.root(level).first()[0]
    inside = leaves[len(leaves) // 3]
    asked = [inside, inside[:-1] + ("0" if inside[-1] != "0" else "1"), "0" * 63 + "1", "12" + "0" * 62]
    found = dataset.look_up(spark, path, asked)
    assert {r["h"]: (r["left_idx"], r["right_idx"], r["present"], r["tag"]) for r in found.collect()} == brackets(leaves, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [digits" in plan
    got = dataset.members(spark, path, asked).collect()
    assert [(r["h"], r["idx"], r["ok"]) for r in got] == [(inside, leaves.index(inside), True)]


def test_inclusion_check_makes_paths_once(spark):
    """Five checks of one leaf are columns of its row: nothing is joined or made again."""
    from quadframe.plans import queries

    plan = queries.QUERIES["inclusion_check"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
