import hashlib
import random
import re
from collections import defaultdict

from quadframe.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if holds(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


TEXTS = [
    None, "", "a@b.com", "é😀 a@b.com+x@y.z, 1.2.3.4.5.6.7.8 or 300.1.1.1 and 0255.1.2.3", "4444333322221111 4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (988) 555-2485. +12 +1234567890123456 +1 2 3 4 5 6 7 8 9 (", "x" * 3_000 + "@", "1" * 3_000, "1." * 2_000, "a@" + "b." * 2_000 + "c", "+1" + " (" * 2_000,
    "@@a@b.c..d@e-f.gh 10.0.0.1:80 ٣٤٥ a@b", "4111111111111111@x.org 79927398713 799273987130 049927398716",
]


def test_base_spans_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r["doc_id"]: r["b"] for r in pii.find(docs).select("doc_id", pii.spell(pii.F.col("base")).alias("b")).collect()}
    assert got == {i: base(t) for i, t in enumerate(TEXTS)}


def test_very_long_runs_take_linear_time(spark):
    texts = ["x" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "a@" + "b." * 100_000 + "c", "+1" + " (" * 100_000]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).select("doc_id", pii.F.size("base").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {0: 0, 1: 0, 2: 25_000, 3: 1, 4: 0}


def test_base_spans_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: hashlib.sha256(base(r["text"]).encode()).hexdigest() for r in docs.collect()}
    from quadframe.llm.queries import op8_pii

    got = op8_pii(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: r["base_sha256"] for r in got} == want
    assert len(got) == len(want)


def test_term_that_reveals_an_entity_is_a_span_and_common_words_are_not(spark):
    filler = "some words about nothing much that everybody uses every day in many places"
    rows = [f"{w} Zaphod Beeblebrox writes from zb@heart.org {w} as usual in places" for w in ("monday", "tuesday", "friday", "sunday")]
    rows += [filler] * 200 + ["Zaphod without an address"] * 0
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id int, text string, spans int")
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    hidden = {s["value"].lower() for s in got[0]["spans"] if s["kind"] == "term"}
    assert {"zaphod", "beeblebrox"} <= hidden and not hidden & {"places", "words"}
    assert all(not got[i]["spans"] for i in range(4, 204))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(pii.find(docs).filter("doc_id = 0")).collect()}
    assert clean[0].startswith("monday [TERM] [TERM]") and "zb@heart.org" not in clean[0] and "[EMAIL]" in clean[0]


def hidden_terms(spark, rows):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    return {s["value"].lower() for r in pii.find(docs).collect() for s in r["spans"] if s["kind"] == "term"}


FILLERS = [f"some words about nothing much that everybody uses every day in many places{'x' * i}" for i in range(200)]


def test_copies_of_contexts_change_neither_side(spark):
    rows = [f"{w} Zaphod Beeblebrox writes from zb@heart.org {w} as usual in places" for w in ("monday", "tuesday", "friday", "sunday")]
    hidden = hidden_terms(spark, rows * 50 + FILLERS)
    assert {"zaphod", "beeblebrox"} <= hidden and "some" not in hidden
    assert hidden == hidden_terms(spark, rows + FILLERS)


def test_one_context_is_enough_for_a_term_seen_nowhere_else(spark):
    hidden = hidden_terms(spark, ["Zaphod uses zb@heart.org every day in many words"] + FILLERS)
    assert "zaphod" in hidden and not hidden & {"uses", "every", "day", "many", "words"}


def spans_by_loops(texts, alpha=0.9, left=1.25, z=1.0):
    """All spans of each text: base spans and disclosing terms, counted in loops over distinct texts."""
    terms = lambda x: set(re.findall(r"[^\W\d_]{3,}", x.lower()))
    found = [[x.split(":") for x in base(t).split(",") if x] for t in texts]
    entities = [{t[int(a) : int(b)].lower() for _, a, b in at} for t, at in zip(texts, found)]
    with_term, with_entity, near = defaultdict(set), defaultdict(set), defaultdict(set)
    for t, at in zip(texts, found):
        for w in terms(t):
            with_term[w].add(t)
        for _, a, b in at:
            a, b = int(a), int(b)
            with_entity[t[a:b].lower()].add(t)
            for w in terms(t[max(0, a - 80) : a]) | terms(t[b : b + 80]):
                near[t[a:b].lower(), w].add(t)
    n, told = sum(len(of) for of in with_term.values()), defaultdict(set)
    for (e, w), together in near.items():
        m, p = len(with_term[w]), min(1.0, len(together) / len(with_term[w]))
        low = (p + z * z / m / 2 - (z * z / m * (p * (1 - p) + z * z / m / 4)) ** 0.5) / (1 + z * z / m)
        if low >= max((len(with_entity[e]) / n) ** (1 - alpha), 2**-left):
            told[e].add(w)
    out = []
    for t, at, of in zip(texts, found, entities):
        hidden = set().union(*(told[e] for e in of))
        words = [(m.start(), 4, "term", m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t) if m[0].lower() in hidden]
        spans = sorted([(int(a), list(KINDS).index(k), k, int(b)) for k, a, b in at] + words)
        out.append(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))
    return out


def corpus(seed, background, names=12):
    """Texts of common words; some name a person by two rare words beside an address, in one text or several."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(150)]
    some = lambda k: " ".join(rng.choices(words, [1 / (i + 1) for i in range(150)], k=k))
    planted = {f"zz{chr(97 + i)}first" for i in range(names)} | {f"zz{chr(97 + i)}last" for i in range(names)}
    texts = []
    for i in range(names):
        c = chr(97 + i)
        texts += [f"{some(15)} ZZ{c}first zz{c}last {some(3)} {c}@mail.org {some(15)}" for _ in range(1 + i % 4)]
        texts += [f"{some(30)} help@common.org {some(5)}"] * 2
    texts += [some(40) for _ in range(background)]
    rng.shuffle(texts)
    return texts, planted


def test_term_spans_match_brute_force(spark):
    texts, _ = corpus(1, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["s"] for r in pii.find(docs).select("doc_id", pii.spell(pii.F.col("spans")).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == spans_by_loops(texts)


def test_planted_terms_are_found_and_more_texts_hide_no_more(spark):
    small, planted = corpus(2, 400)
    large = small + ["entirely other words without anybody in them " + "".join(chr(97 + int(d)) for d in str(k)) for k in range(3_000)]
    hidden = [hidden_terms(spark, x) for x in (small, large)]
    assert hidden[0] == hidden[1]
    assert planted <= hidden[0] and len(planted) >= 0.9 * len(hidden[0])


def test_overlapping_spans_are_replaced_once(spark):
    docs = spark.createDataFrame([(1, "4111111111111111@x.org says hello"), (2, None)], "doc_id int, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(pii.find(docs)).collect()}
    assert clean[1].startswith("[EMAIL] ") and "4111" not in clean[1] and clean[2] == ""


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id int, text string")).collect() == []
