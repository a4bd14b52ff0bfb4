import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quadframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a<|endoftext|>b  <|startoftext|>", "é́ x́ ́a Σας ΣΑΣ İ it's 'll WE'LL ٣ ½ \x1c\x1d a b c\r\nd\te 😀😀", "x" * 5000, "12345", "a,b.C!!", "\x00\x7f~"]


def test_encoder_equals_the_tokenizer(spark):
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    plain, mine = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for t in texts:
        assert np.frombuffer(mine(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_plan_holds_every_piece_once_in_few_sequences():
    rng = random.Random(3)
    counts = Counter(min(4096, max(1, int(rng.lognormvariate(6.5, 1.2)))) for _ in range(20_000))
    plan = packing.plan_for(counts, 4096)
    held = Counter()
    for p, n in plan.items():
        assert sum(p) <= 4096
        for k in p:
            held[k] += n
    assert held == counts
    low = sum(k * n for k, n in counts.items()) / 4096
    assert sum(plan.values()) <= low * 1.002 + 1
    assert packing.plan_for({}, 4096) == {}
    assert sum(packing.plan_for({2049: 10, 2048: 3, 2047: 4, 1: 2}, 4096).values()) == 12


def test_pack_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD + [" ".join(f"word{j % 50}" for j in range(n)) for n in (1, 10, 700, 1500, 2500, 2500)])] + [(None, None), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, part string, rank int").repartition(3)
    got = packing.pack(docs, PATH, with_ids=True).collect()
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            cut = ids[k : k + 4096]
            want[(i, k // 4096, k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()), tuple(cut))] += 1
    assert Counter((*tuple(r)[:5], tuple(r["ids"])) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= sum(r["length"] for r in got) / 4096 * 1.2 + 1
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_latin_words_and_small_caches_give_the_tokenizers_ids(monkeypatch):
    texts = ["Ünïcödé ñandú's ÀÉ2x", "ÆØÞðþß÷× ªº µ² ÿ", "e\u0301te\u0301 ÀÀ\u0300 ŒuvreŸ", "Été," * 30, "", "\xa0é\x85à\tÇ", "Ã©tÃ© ä¸ľ"]
    monkeypatch.setattr(packing, "CACHED", 3)
    encode = packing.Encoder(PATH)
    assert encode.known
    for text in texts * 2:
        assert encode(text) == encode._whole(text)
