import random

from quadframe.llm import toxicity


def test_fold_homoglyphs_and_digits():
    assert toxicity.fold("Іdі0t, 1D1OT!! x​yz $tup1d 2024 a_b ***") == " idiot idiot xyz stupid 2024 a b "
    assert toxicity.fold(None) == toxicity.fold("") == "  "


def test_matcher_counts_words_and_beginnings_but_not_insides_or_exceptions():
    m = toxicity.Matcher({" clown ": 2.0, " mor": 1.0}, ["clown fish"])
    assert [w for _, w in m.hits(toxicity.fold("clown Moron tumor clowns m0r0n"))] == [2.0, 1.0, 1.0]
    assert m.strength("a clown fish swims") == m.strength("a nice fish swims") == m.strength("")
    assert m.strength("a clown swims") > m.strength("a clown swims" + " on" * 500) > m.strength("")
    assert toxicity.Matcher({}).strength("x") == m.strength(None)


def _tables(spark):
    rng = random.Random(5)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = []
    for i in range(900):
        ws = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        bad = i % 6 == 0
        if bad:
            ws.insert(rng.randrange(len(ws)), rng.choice(["nitwit", "n1twit", "oaf"]))
        elif i % 60 == 1:
            ws += ["oaf", "street"]
        rows.append((i, " ".join(ws), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "x" * 100_000), (3, rows[3][1])], "doc_id int, text string")
    return docs, spark.createDataFrame([(r[0], r[2], "x") for r in rows] + [(None, 1, "x"), (5, None, "x"), (6, 0, "x")], "doc_id int, toxic int, text string"), rows


def test_held_out_accuracy(spark):
    docs, labels, rows = _tables(spark)
    model = toxicity.fit(docs, labels.filter("doc_id is null or doc_id % 5 <> 0"))
    got = {r["doc_id"]: r["tox_score"] for r in toxicity.score(docs, model).collect()}
    assert toxicity.score(docs, model).count() == 904 and all(0 <= x <= 1 for x in got.values())
    held = [(got[i] >= 0.5) == bool(t) for i, _, t in rows if i % 5 == 0]
    assert sum(held) / len(held) > 0.97
    assert got[900] == got[901] < 0.5


def test_without_labels_or_rows(spark):
    docs, labels, _ = _tables(spark)
    model = toxicity.fit(docs, labels.limit(0))
    assert len({r["tox_score"] for r in toxicity.score(docs, model).collect()}) == 1
    assert toxicity.score(docs.limit(0), model).collect() == []
