import random

import numpy as np

from quadframe.llm import near, simhash
from quadframe.llm.work import Work


def texts_of(kept):
    return sorted(r["text"] for r in kept.collect())


def test_null_and_repeated_ids_do_not_join_different_texts(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(6)]
    rows = [(None, t) for t in texts[:3]] + [(None, texts[0] + " tail"), (5, texts[3]), (5, texts[4]), (None, texts[5]), (9, texts[5] + " tail")]
    kept = texts_of(simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id int, text string")))
    assert len(kept) == 6
    assert set(texts[1:5]) | {texts[5] + " tail"} <= set(kept)
    assert len({texts[0], texts[0] + " tail"} & set(kept)) == 1


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_kept(texts):
    """Texts whose number is the least of their component by Jaccard similarity, and similarities of edited pairs."""
    sets, label = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i for i in range(len(texts)) if find(i) == i}


def kept_ids(spark, texts):
    return {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}


def test_links_are_those_of_brute_force_jaccard(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 30, 120, 400]))]
        edited = list(words)
        for _ in range(rng.randrange(1 + len(words) // 35 + 1)):
            edited[rng.randrange(len(words))] = "other"
        texts += [" ".join(words), " ".join(edited), " ".join(words[: len(words) * rng.randrange(75, 100) // 100])]
    assert kept_ids(spark, texts) == brute_kept(texts)


def test_dense_group_of_different_copies(spark):
    rng = random.Random(9)
    centre, texts = [f"w{i}" for i in range(200)], []
    for k in range(240):
        words = list(centre)
        for _ in range(rng.randrange(1, 14)):
            words[rng.randrange(200)] = f"v{k}x{rng.randrange(99)}"
        texts.append(" ".join(words))
    assert kept_ids(spark, texts) == brute_kept(texts)


def test_texts_without_words_take_no_short_texts_with_them(spark):
    rng = random.Random(3)
    texts = [None, "", " \t"] + [" ".join(f"w{rng.randrange(9**6)}" for _ in range(6)) for _ in range(400)]
    assert kept_ids(spark, texts) == {0, *range(3, 403)}


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    ruled_out = 0
    for _ in range(3000):
        n, differ = int(rng.integers(1, 400)), rng.random() * 0.4
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) >= differ], rng.integers(0, 1 << 64, int(n * differ), np.uint64))))
        both = len(np.intersect1d(a, b))
        bits = int(np.bitwise_count((near.parities(a) ^ near.parities(b)).view(np.uint64)).sum())
        linked, passes = 5 * both >= 4 * (len(a) + len(b) - both), 9 * bits <= len(a) + len(b)
        assert passes or not linked
        ruled_out += not passes
    assert ruled_out > 1000


def test_simhash_index_links_close_copies_before_bands_do(spark, monkeypatch):
    """Without any band, what fingerprints link and similarity settles are still joined, and nothing else is."""
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(9**6)}" for _ in range(300)]
        texts += [" ".join(words), " ".join([*words, "tail"]), " ".join(words[:120])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    work = Work(spark, "test")
    rows = work.save(near.prints(docs), "prints")
    of = {r["id"]: r["doc_id"] for r in rows.collect()}
    fp = {r["doc_id"]: r["fp"] for r in rows.collect()}
    pairs = {frozenset((of[r["u"]], of[r["v"]])) for r in near.simhash_pairs(rows, work).collect()}
    close = {frozenset((i, j)) for i in fp for j in range(i) if bin((fp[i] ^ fp[j]) & (1 << 64) - 1).count("1") <= near.RADIUS}
    assert pairs == close and len(close) > 50
    assert all(simhash.signed(sum((2 * sum(int(x) >> b & 1 for x in h) > len(h)) << b for b in range(64))) == fp[i] for i in (0, 5) for h in [near.shingles(texts[i])])
    nothing = lambda members, nodes, sets, work: nodes
    monkeypatch.setattr(near, "labels_of", nothing)
    assert kept_ids(spark, texts) == {i for i in range(len(texts)) if frozenset((i, i - 1)) not in close or i % 3 != 1}


def test_sets_of_one_fingerprint_are_all_settled(spark):
    rows = [(1, 7, 5), (2, 9, 5), (3, 9, 5), (4, 9, 6), (5, 9, -1), (0, 0, 5)]
    got = near.simhash_pairs(spark.createDataFrame(rows, "id long, n int, fp long"), Work(spark, "test")).collect()
    assert sorted(sorted(r) for r in got) == [[1, 2], [1, 3], [1, 4]]
