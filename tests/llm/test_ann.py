import time

import numpy as np
import pytest

from quadframe.llm import ann


def brute(ids, v, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = (v * v[i]).sum(axis=1)
        rows = np.flatnonzero(ids != ids[i])
        top = rows[np.lexsort((ids[rows], -score[rows]))[:k]]
        out[int(ids[i])] = [(int(ids[t]), float(score[t])) for t in top]
    return out


def test_recall_and_scores_on_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = rows.select("vec_id", "embedding").collect()
    want = brute(np.array([r[0] for r in data]), np.array([r[1] for r in data], float), 20)
    got = {}
    for r in ann.search(rows, ann.F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) > 0.93
    true = {(q, i): s for q, x in want.items() for i, s in x}
    assert all(abs(s - true[q, i]) < 1e-12 for q, x in got.items() for i, s in x if (q, i) in true)
    assert all(x == sorted(x, key=lambda p: (-p[1], p[0])) for x in got.values())


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    subs = rng.integers(0, 1 << 16, size=(600, 4), dtype=np.uint16)
    subs[1:40] = subs[0] ^ (np.uint16(1) << rng.integers(0, 16, size=(39, 4)).astype(np.uint16))
    index = ann.Index(subs)
    for radius in (0, 3, 4, 11, 25, 64):
        distance = np.bitwise_count(subs ^ subs[0]).sum(axis=1)
        assert index.within(subs[0], radius).tolist() == np.flatnonzero(distance <= radius).tolist()


def test_growing_probes_find_the_nearest_codes_and_leave_most_rows_of_structured_data():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 16, size=(200, 16), dtype=np.uint16)
    subs = np.repeat(centres, 20, axis=0)
    for _ in range(10):
        subs[np.arange(len(subs)), rng.integers(0, 16, len(subs))] ^= np.uint16(1) << rng.integers(0, 16, len(subs)).astype(np.uint16)
    index = ann.Index(subs)
    for i in range(0, 4000, 400):
        distance = np.bitwise_count(subs ^ subs[i]).sum(axis=1, dtype=np.int64)
        for n in (1, 20, 300):
            index.probed = 0
            assert index.nearest(subs[i], n).tolist() == np.flatnonzero(distance <= np.sort(distance)[n - 1]).tolist()
            assert n > 20 or index.probed < 400


def test_odd_vectors_ties_and_few_rows(spark):
    nan = float("nan")
    rows = [(20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (40, [0.5, 0.5]), (7, None), (8, [0.0, 0.0]), (9, [nan, 1.0]), (10, [None, 1.0]), (11, [float("inf"), 1.0]), (12, [1.0]), (None, [1.0, 1.0]), (60, None), (3, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = [tuple(r) for r in ann.search(df, ann.F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 2, 1.0), (20, 2, 3, 1.0), (20, 3, 3, 1.0), (20, 4, 40, 0.5), (40, 1, 2, 0.5), (40, 2, 3, 0.5), (40, 3, 3, 0.5), (40, 4, 20, 0.5)]
    assert ann.search(df.limit(0), ann.F.col("vec_id") % 20 == 0).collect() == []


def block_of(v, n_queries):
    mean, rotations = ann.learn_rotations(v[:1000])
    ids, subs = np.arange(len(v)), ann.codes(v, mean, rotations)
    return (ids[:n_queries], v[:n_queries], subs[:n_queries], ids, v, subs)


def test_a_block_takes_less_cpu_than_all_exact_products():
    v = np.random.default_rng(7).normal(size=(8192, 64))
    qid, q, qs, ids, v, subs = block_of(v, 128)
    took = {"codes": [], "products": []}
    for _ in range(3):
        began = time.process_time()
        ann.best_of_block(qid, q, qs, ids, v, subs, 20, ann.SHARE)
        took["codes"].append(time.process_time() - began)
        began = time.process_time()
        for x in q:
            score = (v * x).sum(axis=1)
            np.lexsort((ids, -score))[:20]
        took["products"].append(time.process_time() - began)
    assert min(took["codes"]) < 0.5 * min(took["products"])


def test_probes_and_comparisons_find_the_same_rows():
    rng = np.random.default_rng(8)
    group = rng.normal(size=64)
    v = np.concatenate([rng.normal(size=(9000, 64)), group + 0.02 * rng.normal(size=(550, 64)), -group[None]])
    subs = ann.codes(v, *ann.learn_rotations(v[::3]))
    index, asked = ann.Index(subs), np.concatenate([subs[:16], subs[9000:9016], subs[-1:]])
    probed = index._probe(asked, 500)
    assert len(probed) > 8 and min(probed) >= 16 and index.probed < 2000 * len(probed)
    compared = list(index._compare(asked, 500))
    for i, rows in enumerate(index.nearest_of(asked, 500)):
        distance = np.bitwise_count(subs ^ asked[i]).sum(axis=1, dtype=np.int64)
        want = np.flatnonzero(distance <= np.sort(distance)[499]).tolist()
        assert rows.tolist() == compared[i].tolist() == want == probed.get(i, rows).tolist()


@pytest.mark.parametrize(("dims", "scale"), [(2, 1.0), (5, 1e-3), (100, 1.0), (64, 1e200), (64, 1e-200), (64, 1e-20)])
def test_best_of_a_block_are_the_best_of_its_nearest_codes(dims, scale):
    rng = np.random.default_rng(dims)
    v = rng.integers(-3, 4, size=(1500, dims)).astype(float)
    v[::9] = v[1]  # copies, so scores tie
    qid, q, qs, ids, v, subs = block_of(v, 40)
    q, v = q * scale, v * scale
    with np.errstate(over="ignore", invalid="ignore"):
        got = ann.best_of_block(qid, q, qs, ids, v, subs, 20, 0.1)
        for i in range(len(qid)):
            distance = np.bitwise_count(subs ^ qs[i]).sum(axis=1, dtype=np.int64)
            rows = np.flatnonzero(distance <= np.sort(distance)[149])
            rows = rows[rows != i]
            score = (v[rows] * q[i]).sum(axis=1)
            top = np.lexsort((rows, -score))[:20]
            assert got[1][got[0] == i].tolist() == rows[top].tolist()
            assert np.array_equal(got[2][got[0] == i], score[top], equal_nan=True)


def test_several_turns_and_more_blocks_give_each_query_its_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 10)
    v = np.random.default_rng(9).normal(size=(240, 8)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, ann.F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute(np.arange(240), v, 20)
