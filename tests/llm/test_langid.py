import numpy as np

from quadframe.llm import langid


def test_buckets_count_all_ngrams_over_chunks(monkeypatch):
    text = "Ab  \n c😀 abab" * 40
    whole = langid.buckets(text)
    line = " ".join(text.lower().split())
    assert whole.sum() == 3 * len(line) - 3
    monkeypatch.setattr(langid, "_AT_ONCE", 7)
    assert (langid.buckets(text) == whole).all()
    assert langid.buckets("").sum() == 0 and langid.buckets("é").sum() == 1


def test_temperature_finds_overconfidence():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in langid.softmax(logits)])
    assert 0.85 < langid.temperature(logits, labels) < 1.2
    assert 2.5 < langid.temperature(logits * 3, labels) < 3.6


def test_held_out_accuracy_and_defined_results(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    extra = [(1001, None, "en", "x"), (1002, "", "fr", "x"), (1003, "123 !?", "de", None), (1004, "the text without a language", None, "x"), (None, "x", "en", "x")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs.filter("doc_id % 4 <> 2"))).collect()}
    true = {r["doc_id"]: r["lang"] for r in docs.filter("doc_id % 4 = 2 and doc_id < 1000").collect()}
    assert sum(got[i]["lang_pred"] == x for i, x in true.items()) / len(true) > 0.95
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert got[1004]["lang_pred"] in {"en", "de", "fr", "es"} and all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.fit(docs.filter("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), none).collect() == []
