import hashlib
import random

from quadframe.llm import suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for p in range(len(d) - length + 1):
            w = d[p : p + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    letters = "abcdeé 😀\n"
    blank = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [blank(rng.randrange(150, 500)) for _ in range(6)]
    out = [None, "", "x" * 1000, "ab" * 400, "short", blank(199)]
    for _ in range(n):
        t = blank(rng.randrange(0, 600))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            t += p[a : a + rng.randrange(100, 500)] + blank(rng.randrange(0, 300))
        out.append(t)
    out += [out[8], out[9], out[8][:-1] + "!", passages[0], passages[1] * 2]
    return out


def check(spark, given, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)], "doc_id int, text string, h string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs, **options).collect()}
    want = dict(enumerate(brute(given, 200)))
    assert [i for i in want if got[i] != want[i]] == []


def test_matches_brute_force(spark):
    check(spark, texts(1, 40))


def test_hot_starts_are_split_down_to_windows(spark):
    check(spark, texts(2, 40), hot=2)


def test_many_contexts_of_one_line(spark):
    """One line of less than a window between different texts, alone and with equal words on either side."""
    rng = random.Random(11)
    letters = "abcdefghij "
    own = lambda n: "".join(rng.choice(letters) for _ in range(n))
    line, before, after = own(120), own(60), own(60)
    given = []
    for k in range(300):
        a, b = rng.randrange(60), rng.randrange(60)
        given.append(own(200) + before[60 - a :] + line + after[:b] + own(200) if k % 3 else own(100) + line + own(100))
    check(spark, given)
    check(spark, given, hot=20)


def test_repeated_and_null_ids_and_other_columns(spark):
    given = texts(3, 12)
    docs = spark.createDataFrame([(None if i % 3 else 7, t, b"x", i) for i, t in enumerate(given)], "doc_id int, text string, name binary, i int")
    got = sorted(tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted(brute(given, 200))


def test_chunks_of_long_texts(spark, monkeypatch):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdef") for _ in range(5000))
    whole = suffix_dedup.anchors(t.encode(), 200)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 700)
    parts = suffix_dedup.anchors(t.encode(), 200)
    assert set(zip(whole[0].tolist(), whole[1].tolist())) == set(zip(parts[0].tolist(), parts[1].tolist()))
    covered = sorted((a, b) for a, b in zip(parts[2].tolist(), parts[3].tolist()))
    assert covered[0][0] == 0 and covered[-1][1] == 4800 and all(x[1] + 1 == y[0] for x, y in zip(covered, covered[1:]))


def test_merge_gives_order_and_common_prefixes():
    rng = random.Random(6)
    words = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(300)})
    pieces = [[] for _ in range(5)]
    for w in words:
        for k in {rng.randrange(5), rng.randrange(5)}:
            pieces[k].append((w, b""))
    runs = [[x[1:] for x in suffix_dedup.front_code(p, lambda _: 0)] for p in pieces]
    merged = list(suffix_dedup.merge(runs))
    order = [r for _, r, _ in merged]
    assert order == sorted(x[0] for p in pieces for x in p)
    assert all(s == suffix_dedup.common(a, b) for (s, *_), a, b in zip(merged[1:], order, order[1:]))


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id int, text string")).collect() == []
