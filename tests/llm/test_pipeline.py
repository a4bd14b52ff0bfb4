import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quadframe.llm import toxicity
from quadframe.llm.work import Work

SF = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_kept(spark):
    work, docs = Work(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    matcher = toxicity.Matcher(*model[:2])
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = work.save(out, name)
        seen.append(docs.collect())
    raw, clean, exact, near, mixed = seen
    assert sorted(clean) == sorted(r for r in raw if model[2][0] * matcher.strength(r["text"]) + model[2][1] < 0)
    first = {}
    for r in sorted(clean):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r)
    assert sorted(exact) == sorted(first.values())
    assert set(near) <= set(exact) and len(near) >= 0.9 * len(exact)
    times = Counter(mixed)
    assert set(times) <= set(near) and max(times.values()) <= 2
    words = sum(len(r["text"].split()) for r in mixed)
    assert abs(words / (1.5 * sum(len(r["text"].split()) for r in near)) - 1) < 0.1
    packed = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r, n in times.items():
        ids = plain.encode(r["text"], add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            want[r["doc_id"], k, tuple(ids[k : k + 4096])] += n
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in packed) == want
    held = Counter()
    for r in packed:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 4096 and np.mean(list(held.values())) > 3500


def test_run_gives_the_packed_rows(spark):
    assert corpus_pipeline.run(spark, SF).columns[:3] == ["doc_id", "piece", "start"]


ODD = "doc_id long, text string, lang string, source string, n_chars long, tox_score double, score int, label string, `c0` int, `to` string, `row` string, at_file string, `x.y` int"


def odd_rows():
    words = [f"word{k}" for k in range(60)]
    long_ = " ".join(f"long{k}" for k in range(24_000))
    texts = [None, "", " \t ", "one", "one two three", " ".join(words), " ".join(words[:-1] + ["other"]), " ".join(words), " ".join(words).replace(" ", "\n "), long_, long_ + " end", "tie one two three four five", "tie one two three four five"]
    rows = [(i, t, None if i % 3 else "en", [None, "a", "b"][i % 3], None, 0.9, i, "l", i, "t", "r", "f", 1) for i, t in enumerate(texts)]
    rows += [(None, "nobody's text of some words here", *[None] * 11), (None, "another text without any owner at all", *[None] * 11), rows[5], (3, "a repeated identifier with its own text", *rows[3][2:])]
    return rows


def test_stages_take_nulls_ties_repeated_rows_and_any_names(spark):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    every = Counter(docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
        out = Counter(got.collect())
        assert set(out) <= set(every), name
        if name == "toxicity":
            assert out == every
        if name == "exact_dedup":
            of = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
            first = {}
            for r in sorted(every, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
                first.setdefault(of(r), r)
            assert out == Counter(first.values())
        if name == "near_dedup":
            texts = [r["text"] for r in out]
            assert sum(not (t or "").split() for t in texts) == 1 and sum(t == "tie one two three four five" for t in texts) == 1
            assert sum((t or "").startswith("word0") for t in texts) == 1 and sum(len(t or "") > 1000 for t in texts) == 1
            assert sum(r["doc_id"] is None for r in out) == 2
        if name == "mixing":
            assert max(out.values()) <= 4 and Counter(stage(spark, docs, SF).collect()) == out
    packed = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in every.elements())


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], ODD)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.collect() == [], name
        assert name == "packing" or got.columns == docs.columns


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_left_at_a_larger_scale(spark):
    """Recall and precision of the stage by brute force over candidates that share a shingle, on sf0.01."""
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets, holding = {i: shingle_set(t) for i, t in rows.items()}, {}
    for i, s in sets.items():
        for x in s:
            holding.setdefault(x, []).append(i)
    label = {i: i for i in rows}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    pairs = {(a, b) for ids in holding.values() for n, a in enumerate(ids) for b in ids[n + 1 :]} | {(a, b) for a in rows for b in rows if a < b and not sets[a] and not sets[b]}
    for a, b in pairs:
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            x, y = sorted((top(a), top(b)))
            label[y] = x
    want = {min(i for i in rows if top(i) == t) for t in {top(i) for i in rows}}
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    gone, right = set(rows) - got, set(rows) - want
    assert len(right) > 20 and len(gone & right) >= 0.9 * len(right) and gone <= right
