import random

import numpy as np
import xxhash

from quadframe.llm import simhash
from quadframe.llm.work import Work


def brute_fp(text, width=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for text in [None, "", " \t", "One", "A b\x0bC d", "é à b C d É x", "a a a a a a a a", " ".join(str(i % 37) for i in range(500))]:
        assert simhash.fingerprint(text, 4) == (brute_fp(text), 0), text


def _fps(seed, n):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(2 * n):
        x = rng.choice(fps)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    return list(dict.fromkeys(fps))


def test_forest_of_a_node_connects_what_brute_force_connects():
    fps = _fps(1, 150)
    order = sorted(fps, key=lambda x: x ^ x >> 1)
    label = simhash.forest_of_node(np.array(order, np.uint64), np.zeros(len(order), np.uint64), 4, 128)
    assert label.tolist() == brute_components(order, 4)


def test_tree_prunes_whole_groups_and_loses_no_leaf():
    fps = _fps(5, 2000)
    ranks = np.array(fps, np.uint64)
    rank = ranks.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    fp = ranks[np.argsort(rank)]
    tree, leaves = simhash.GrayTree(fp), -(-len(fp) // simhash.LEAF)
    for a in range(0, leaves, 9):
        tree.visited = 0
        near = set(tree.leaves_near(a, 2).tolist())
        own = fp[a * simhash.LEAF : (a + 1) * simhash.LEAF]
        least = [np.bitwise_count(own[:, None] ^ fp[b * simhash.LEAF : (b + 1) * simhash.LEAF][None, :]).min() for b in range(leaves)]
        assert {b for b in range(a, leaves) if least[b] <= 2} <= near
    # Fingerprints with a common beginning: most groups are left at their top.
    fp = np.sort(np.array([(k // 64 << 52) | random.Random(k).getrandbits(8) for k in range(1 << 14)], np.uint64))
    tree = simhash.GrayTree(fp)
    assert len(tree.leaves_near(0, 0)) < 20 and tree.visited < 120


def test_links_connect_what_brute_force_connects(spark):
    fps = _fps(2, 120)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long").selectExpr("fp", "0L as more", "fp as id")
    for node_size in (8192, 8):
        work = Work(spark, "test")
        labels = simhash.components(simhash.links(df, work, 4, node_size=node_size), work).collect()
        got = {}
        for r in labels:
            got.setdefault(r["label"], set()).add(r["node"])
        want = {}
        for x, k in zip(fps, brute_components(fps, 4)):
            want.setdefault(k, set()).add(simhash.signed(x))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_near_duplicates_of_texts(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base + " tail", None, "", base, "other words here entirely", " "]
    docs = spark.createDataFrame([(9 - i, t, 0) for i, t in enumerate(texts)], "doc_id int, text string, fp int")
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs, 4, 4, None).collect()}
    fps = [brute_fp(t) for t in texts]
    label = brute_components(fps, 4)
    least = {k: min(9 - i for i in range(len(texts)) if label[i] == k) for k in label}
    assert got == {9 - i: (simhash.signed(fps[i]), least[label[i]]) for i in range(len(texts))}
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_wide_fingerprints_link_near_copies_only(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((3 * i, " ".join(words)))
        words[150] = "other"
        rows.append((3 * i + 1, " ".join(words)))
        rows.append((3 * i + 2, " ".join(words[:100] + [f"v{rng.randrange(5000)}" for _ in range(200)])))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, component_id int")
    kept = simhash.drop_near_copies(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns
    assert {i for i in ids if i % 3 == 0} == {3 * i for i in range(60)}
    assert {i for i in ids if i % 3 == 2} == {3 * i + 2 for i in range(60)}
    assert sum(i % 3 == 1 for i in ids) <= 2
