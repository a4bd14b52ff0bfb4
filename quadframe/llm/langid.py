"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters of the lower-cased text (white space runs as one space) are hashed to buckets. Inverse
document frequencies come from all training rows; the weights from a bounded sample of them, by follow the regularised
leader with elastic-net penalties, one row after the other; a part of the sample that isn't trained on sets the
temperature of the softmax.

A text that is null or has no letter is ``und`` with score 0, as is every text if no training row has a language. A text
without trained n-grams gets the language that the offsets prefer. Repeated rows are separate documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that the weights are fitted on, at most: those first by a hash of doc_id.
MAX_ROWS = 6_000
BUCKET_BITS = 15
#: Follow the regularised leader: learning rate, smoothing, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.01, 3
_AT_ONCE = 1 << 20


def buckets(text: str) -> np.ndarray:
    """How often each bucket's n-grams are in the text."""
    line = " ".join(text.lower().split())
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    shift = np.uint64(64 - BUCKET_BITS)
    for at in range(0, len(line), _AT_ONCE):
        c = np.frombuffer(line[at : at + _AT_ONCE + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        own = min(len(c), _AT_ONCE)
        gram = np.zeros(len(c), np.uint64)
        for n in range(min(3, len(c))):
            # The first n + 1 characters as one number, spread by a multiplicative hash.
            gram = gram[: len(c) - n] * np.uint64(0x110000) + c[n:]
            h = (gram * np.uint64(0x9E3779B97F4A7C15)) >> shift
            counts += np.bincount(h[:own].astype(np.int64), minlength=len(counts))
    return counts


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their TF-IDF values, of length 1."""
    counts = buckets(text)
    at = np.flatnonzero((counts > 0) & (idf > 0))
    value = (1 + np.log(counts[at])) * idf[at]
    return at, value / max(np.sqrt(value @ value), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Number of texts that hold each bucket, and of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += buckets(t or "") > 0
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *total[at].tolist()], pa.int64())], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    held, n = np.zeros(1 << BUCKET_BITS), 0
    for r in rows:
        if r["bucket"] < 0:
            n = r["n"]
        else:
            held[r["bucket"]] = r["n"]
    return held, n


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket, class) and offsets. rows: buckets, values, class."""
    z, n = np.zeros((1 << BUCKET_BITS, n_classes)), np.zeros((1 << BUCKET_BITS, n_classes))
    z0, n0 = np.zeros(n_classes), np.zeros(n_classes)

    def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        for k in order.permutation(len(rows)):
            at, value, label = rows[k]
            w, w0 = weights(z[at], n[at], L1), weights(z0, n0, 0.0)
            p = softmax((value @ w + w0)[None, :])[0]
            p[label] -= 1
            g = value[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            z0 += p - (np.sqrt(n0 + p * p) - np.sqrt(n0)) / ALPHA * w0
            n0 += p * p
    return weights(z, n, L1), weights(z0, n0, 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss among a geometric grid."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(train: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """The model of train: (doc_id, text, lang); rows without a language don't count."""
    train = train.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("lang is not null")
    held, n = _frequencies(train)
    idf = np.where(held > 0, np.log((1 + n) / (1 + held)) + 1, 0.0)
    shared = train.sparkSession.sparkContext.broadcast(idf)
    some = train.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows numbers are broadcast.
    sample = train.join(F.broadcast(some), "doc_id").filter("text is not null")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t, shared.value) for t in batch.column(0).to_pylist()]
            at, value = pa.array([a for a, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(1), at, value], ["lang", "at", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(y, np.array(a, np.int64), np.array(v)) for b in batches for y, a, v in zip(*(c.to_pylist() for c in b.columns))]
        if not got:
            return
        langs = sorted({y for y, *_ in got})
        rows = [(a, v, langs.index(y)) for y, a, v in got]
        rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes()))  # the same order whatever the tasks
        last = [r for k, r in enumerate(rows) if k % 5 == 4]
        w, w0 = follow_the_leader([r for k, r in enumerate(rows) if k % 5 != 4], len(langs))
        logits = np.array([v @ w[a] + w0 for a, v, _ in last]).reshape(len(last), len(langs))
        t = temperature(logits, np.array([y for *_, y in last], np.int64))
        for k, lang in enumerate(langs):
            at = np.flatnonzero(w[:, k])
            out = [pa.array([lang] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int32()), pa.array([w0[k], *w[at, k]]), pa.array([t] * (len(at) + 1))]
            yield pa.RecordBatch.from_arrays(out, ["lang", "bucket", "weight", "temperature"])

    rows = sample.select("text", "lang").mapInArrow(vectors, "lang string, at array<int>, value array<float>").repartition(1)
    learned = rows.mapInArrow(learn, "lang string, bucket int, weight double, temperature double").collect()
    langs = sorted({r["lang"] for r in learned})
    w, w0 = np.zeros((1 << BUCKET_BITS, len(langs))), np.zeros(len(langs))
    for r in learned:
        if r["bucket"] < 0:
            w0[langs.index(r["lang"])] = r["weight"]
        else:
            w[r["bucket"], langs.index(r["lang"])] = r["weight"]
    return {"langs": langs, "idf": idf, "weights": w, "offsets": w0, "temperature": learned[0]["temperature"] if learned else 1.0}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, scores = [], []
            for t in batch.column(1).to_pylist():
                if not m["langs"] or not has_letter(t):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                at, value = features(t, m["idf"])
                p = softmax(((value @ m["weights"][at] + m["offsets"]) / m["temperature"])[None, :])[0]
                langs.append(m["langs"][int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
