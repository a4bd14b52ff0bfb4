import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quadframe.llm import align


def plain(texts):
    """The contract by loops over whole texts."""
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    letters, docs = align._letters(), []
    for text in texts:
        docs.append(([], [], [], []))
        if not text:
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], []
        for i in ids[1]:
            p = b.id_to_piece(i)
            spelled[1].append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        if any(b"".join(s) != (" " + text).encode() for s in spelled):
            continue
        ends = [{e: k for k, e in enumerate(accumulate(map(len, s)))} for s in spelled]
        both, groups, last = sorted(set(ends[0]) & set(ends[1])), [], (0, 0)
        for e in both:
            here = ends[0][e] + 1, ends[1][e] + 1
            groups.append("|".join(",".join(map(str, ids[k][last[k] : here[k]])) for k in (0, 1)))
            last = here
        docs[-1] = (*ids, groups, [(ids[0][ends[0][e]], ids[1][ends[1][e]]) for e in both])
    count, most = Counter(x for d in docs for x in d[3]), defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    digest = [(len(x), len(y), len(g), len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for x, y, g, k in docs]
    return digest, count, most


def odd_texts():
    rng = random.Random(5)
    bits = ["the", "naïve", "Straße", "東京", "😀", "don't", "x1,y", "  ", "\n", "\t ", " \r\n", "▁", "<|endoftext|>", "<s>", " ", "　", "é", "½", "a" * 60, "\x00", "1234567", "--", "'", " 's"]
    made = [rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    return [None, "", " ", "\n", "▁", "a", "  a", "a ", *made, "the the the", "the the the", " ".join(rng.choice(bits[:7]) for _ in range(20_000))]


def test_against_loops(spark):
    texts = odd_texts()
    want, count, most = plain(texts)
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], "doc_id long, text string, block string, packed string, part int").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in align.align(docs, most=2000).collect()}
    assert got == dict(enumerate(want))
    assert sum(w[0] == 0 for w in want) > 4 and sum(w[0] > 0 for w in want) > 100
    found = {(r["a"], r["b"]): (r["links"], r["best"]) for r in align.pairs(docs, most=2000).collect()}
    assert found == {k: (n, n == most[k[1]]) for k, n in count.items()}


def test_heap_merge_of_many_runs():
    rng = random.Random(3)
    each = [Counter((rng.randint(0, 40), rng.randint(0, 30)) for _ in range(rng.randint(1, 300))) for _ in range(20)]
    runs, total = [], Counter()
    for c in each:
        total.update(c)
        keys = sorted(b << align._B | a for a, b in c)
        at = align.np.array(keys, "<i8")
        n = align.np.array([c[k & (1 << align._B) - 1, k >> align._B] for k in keys], "<i8")
        runs.append(align.Run(align.pack(align.np.diff(at, prepend=0), n)))
    got = {(int(p) & (1 << align._B) - 1, int(p) >> align._B): (int(n), bool(x)) for ps, ns, xs in align.merge(runs) for p, n, x in zip(ps, ns, xs)}
    most = {b: max(n for (_, y), n in total.items() if y == b) for _, b in total}
    assert got == {k: (n, n == most[k[1]]) for k, n in total.items()}
    for c, r in zip(each, runs):
        assert {(int(p) & (1 << align._B) - 1, int(p) >> align._B): int(n) for p, n in zip(r.pairs, r.totals)} == {k: total[k] for k in c}


@pytest.mark.parametrize("rows", [[], [(None, None)], [(None, "same"), (None, "same"), (1, "same")]])
def test_null_repeated_and_no_rows(spark, rows):
    got = align.align(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    want, _, _ = plain([t for _, t in rows])
    assert sorted(map(tuple, got), key=str) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)
