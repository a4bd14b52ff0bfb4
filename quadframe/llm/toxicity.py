"""Toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are folded first: lower case, homoglyphs to Latin letters, digits and signs to the letters they stand for inside
words. The lexicon is learned from labelled texts: words, and beginnings of words, that toxic texts hold and others
don't, weighted by log odds. Phrases of a matched word and its neighbour that labelled clean texts hold are exceptions
and don't count. The sum of weights is divided by a root of the number of words and made a probability by a logistic
curve fitted to the labelled texts. How often and how clearly a term must be toxic is chosen by cross-validation.

Null and empty texts score as texts without a match; very long ones are folded and matched whole, in time in proportion.
Labels may repeat; a text is toxic if one of its labels is. Rows that repeat an identifier or a text each count, up to the
bound; null identifiers are not learned from. Equal settings go by their order. Without toxic labels the lexicon is empty
and every score is the share of toxic labels, smoothed; an empty table gives an empty result. Other columns don't matter;
a column tox_score of the input can't be kept beside the score of that name, but drop_toxic() keeps it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work

#: Labelled rows that the lexicon is learned from, at most: those first by a hash of doc_id.
MAX_LABELLED = 20_000
#: Toxic texts that must hold a term and log odds it must have: the pairs that cross-validation over the labelled rows
#: chooses from; its folds; lengths of the beginnings of words that are tried.
SETTINGS, FOLDS, STEMS = ((6, 2.5), (6, 2.0), (6, 3.0), (3, 2.5), (3, 2.0), (3, 3.0)), 3, (4, 5, 6, 7, 8)
#: Clean texts that make a phrase an exception.
MIN_CLEAN = 3

#: Letters that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ɩ": "i", "ⅰ": "i", "ⅼ": "l", "ｏ": "o", "ａ": "a", "ｅ": "e", "ｉ": "i", "ｓ": "s", "ｔ": "t", "ｒ": "r", "ｎ": "n",
    "​": "", "‌": "", "‍": "", "­": "", "﻿": "",
}
#: Digits and signs written for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
_GLYPHS, _SIGNS = str.maketrans(HOMOGLYPHS), str.maketrans(SIGNS)
#: A whole run of letters and signs, tried where it begins only.
_SIGNED = re.compile(r"(?<![\w@$!|])[^\W\d]*+[0-9@$!|][\w@$!|]*+")
_GAPS = re.compile(r"[\W_]+")


def _unsign(m: re.Match) -> str:
    word = m[0].rstrip("@$!|").lstrip("!|")
    return word.translate(_SIGNS) if any(map(str.isalpha, word)) else word


def fold(text: str | None) -> str:
    """Folded words, each between single spaces."""
    t = (text or "").lower()
    if not t.isascii():
        t = t.translate(_GLYPHS)
    return " " + _GAPS.sub(" ", _SIGNED.sub(_unsign, t)).strip() + " "


def terms_of(folded: str) -> set[str]:
    """' word ' for each word and ' beginning' for each of its beginnings that is shorter."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in STEMS if n < len(w))
    return out


class Matcher:
    """Finds lexicon terms by Aho-Corasick and leaves out exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: Iterable[str] = ()):
        import ahocorasick

        self.find, self.exceptions = ahocorasick.Automaton(), frozenset(exceptions)
        for term, weight in lexicon.items():
            self.find.add_word(term, (term, weight))
        if lexicon:
            self.find.make_automaton()
        self.empty = not lexicon

    def hits(self, folded: str) -> Iterator[tuple[tuple[str, str], float]]:
        """(phrases with the neighbours before and after, weight) of each matched word."""
        if self.empty:
            return
        for end, (term, weight) in self.find.iter(folded):
            start = end - len(term) + 2
            stop = folded.find(" ", start)
            before = folded.rfind(" ", 0, max(start - 1, 0))
            after = folded.find(" ", stop + 1)
            yield (folded[before + 1 : stop], folded[start : after if after > 0 else stop]), weight

    def strength(self, text: str | None) -> float:
        """Logarithm of the matched weight over the root of the number of words."""
        return self.strength_of(fold(text))

    def strength_of(self, folded: str) -> float:
        total = sum(w for phrases, w in self.hits(folded) if not self.exceptions.intersection(phrases))
        return math.log(total / math.sqrt(folded.count(" ") + 20) + 0.01)


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, toxic, fold) of the labelled rows that are learned from, at most one a label; equal texts share a fold."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # At most max_labelled pairs of numbers are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = rows.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64("text").alias("key"))
    return rows.orderBy("key").limit(max_labelled).select("text", "toxic", F.pmod("key", F.lit(FOLDS)).cast("int").alias("fold"))


def _counts(rows: DataFrame, of) -> DataFrame:
    """(term, toxic, fold, n): in how many rows of each label and fold each of of(text, fold) is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], Counter] = defaultdict(Counter)
        for batch in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
                seen[toxic, fold].update(of(text, fold))
        for (toxic, fold), n in seen.items():
            columns = [pa.array(n.keys(), pa.string()), pa.array([toxic] * len(n), pa.int32()), pa.array([fold] * len(n), pa.int32()), pa.array(n.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "toxic", "fold", "n"])

    return rows.select("text", "toxic", "fold").mapInArrow(run, "term string, toxic int, fold int, n long").groupBy("term", "toxic", "fold").agg(F.sum("n").alias("n"))


def lexicon_of(toxic: dict[str, int], clean: dict[str, int], bad: int, good: int, min_toxic: int, min_odds: float) -> dict[str, float]:
    """Terms of enough toxic texts and odds, with the logarithm of their odds. toxic, clean: texts that hold each term."""
    enough = {t: n for t, n in toxic.items() if n >= min_toxic}
    odds = {t: math.log((n + 0.5) / (bad - n + 0.5) * (good - clean.get(t, 0) + 0.5) / (clean.get(t, 0) + 0.5)) for t, n in enough.items()}
    return chosen_terms({t: w for t, w in odds.items() if w >= min_odds}, enough)


def _points(rows: DataFrame, strengths) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By name: strengths, labels and how many texts have them. strengths(text, fold) gives (name, strength) pairs."""
    out: dict[str, list] = defaultdict(list)
    for r in _counts(rows, lambda text, fold: [f"{name}:{x:.1f}" for name, x in strengths(text, fold)]).collect():
        name, x = r["term"].rsplit(":", 1)
        out[name].append((float(x), float(r["toxic"]), float(r["n"])))
    return {name: tuple(np.array(v).T) for name, v in out.items()}


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[dict[str, float], list[str], tuple[float, float]]:
    """Lexicon, exception phrases, and slope and offset of the logistic curve. labels: (doc_id, toxic).

    What a term needs to enter is chosen among SETTINGS by the log loss over folds that a lexicon has not seen.
    """
    work = Work(docs.sparkSession, "toxicity")
    # The bounded rows come sorted in one partition; the passes over them are dealt to many tasks.
    rows = work.save(_labelled(docs, labels, max_labelled).repartition(64), "labelled")
    size = Counter({(r["toxic"], r["fold"]): r["n"] for r in rows.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect()})
    bad, good = (sum(n for (toxic, _), n in size.items() if toxic == k) for k in (1, 0))
    least = min(m for m, _ in SETTINGS)
    toxic: dict[str, list[int]] = {}
    for r in _counts(rows.filter("toxic = 1"), lambda t, _: terms_of(fold(t))).groupBy("term").agg(F.collect_list(F.struct("fold", "n")).alias("by")).filter(F.aggregate("by", F.lit(0).cast("long"), lambda a, x: a + x["n"]) >= least).collect():
        toxic[r["term"]] = [next((x["n"] for x in r["by"] if x["fold"] == f), 0) for f in range(FOLDS)]
    likely = frozenset(toxic)
    clean: dict[str, list[int]] = {t: [0] * FOLDS for t in toxic}
    for r in _counts(rows.filter("toxic = 0"), lambda t, _: terms_of(fold(t)).intersection(likely)).collect():
        clean[r["term"]][r["fold"]] = r["n"]

    def lexicon(setting: tuple[int, float], without: int | None = None) -> dict[str, float]:
        seen = [f for f in range(FOLDS) if f != without]
        total = lambda by: {t: sum(n[f] for f in seen) for t, n in by.items()}
        return lexicon_of(total(toxic), total(clean), sum(size[1, f] for f in seen), sum(size[0, f] for f in seen), *setting)

    setting = SETTINGS[0]
    if bad and good:
        apart = {(s, f): lexicon(s, f) for s in SETTINGS for f in range(FOLDS)}
        matchers: dict = {}

        def unseen(text: str | None, f: int) -> Iterator[tuple[str, float]]:
            folded = fold(text)
            for k, s in enumerate(SETTINGS):
                if (k, f) not in matchers:
                    matchers[k, f] = Matcher(apart[s, f])
                yield str(k), matchers[k, f].strength_of(folded)

        losses = {name: _loss(*xyn) for name, xyn in _points(rows, unseen).items()}
        setting = SETTINGS[int(min(losses, key=lambda k: (round(losses[k], 6), int(k))))]
    chosen = lexicon(setting)
    plain = Matcher(chosen)

    def phrases(text: str | None, _: int) -> set[str]:
        return {p for pair, _ in plain.hits(fold(text)) for p in pair if " " in p}

    seen = _counts(rows, phrases).groupBy("term").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    exceptions = [r["term"] for r in seen.filter((F.col("clean") >= MIN_CLEAN) & (F.col("clean") > F.col("toxic"))).collect()]
    matcher = Matcher(chosen, exceptions)
    points = _points(rows, lambda text, _: [("all", matcher.strength(text))]).get("all", (np.empty(0),) * 3)
    work.drop("labelled")
    return chosen, exceptions, _logistic(*points) if bad else (0.0, math.log((bad + 0.5) / (good + 1.5)))


def chosen_terms(odds: dict[str, float], count: dict[str, int]) -> dict[str, float]:
    """The terms of highest odds, none of which begins another or stands for most of what another stands for."""
    out: dict[str, float] = {}
    below: Counter = Counter()  # toxic texts that accepted longer terms have taken from a beginning
    for t in sorted(odds, key=lambda t: (-odds[t], len(t), t)):
        starts = [t[: n + 1] for n in STEMS if n + 1 < len(t)]
        if below[t] < 0.6 * count[t] and not any(s in out for s in starts):
            out[t] = odds[t]
            for s in starts:
                below[s] += count[t]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a small ridge on both."""
    w, features = np.zeros(2), np.stack([x + 3.0, np.ones_like(x)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w @ features, -30, 30)))
        gradient = features @ (n * (p - y)) + 0.01 * w
        hessian = (features * (n * np.maximum(p * (1 - p), 1e-6))) @ features.T + 0.01 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    return float(w[0]), float(w[1] + 3.0 * w[0])


def _loss(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Mean log loss of the logistic curve of the points."""
    slope, offset = _logistic(x, y, n)
    z = np.clip(slope * x + offset, -30, 30)
    return float((n * (np.log1p(np.exp(z)) - y * z)).sum() / n.sum())


def _scored(docs: DataFrame, model: tuple, keep: list[str]) -> DataFrame:
    """(c0, c1, ..., tox_score) of the columns named in keep, so that these may have any names."""
    lexicon, exceptions, (slope, offset) = model
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, exceptions))
    names = [f"c{i}" for i in range(len(keep))]
    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*shared.value)
        for batch in batches:
            x = [slope * matcher.strength(t) + offset for t in batch.column(at).to_pylist()]
            p = pa.array([1 / (1 + math.exp(-min(max(v, -30.0), 30.0))) for v in x], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], p], [*names, "tox_score"])

    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], *[F.col("text").alias("text_to_score")][: at == len(keep)])
    schema = ", ".join([*[f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names)], "tox_score double"])
    return given.mapInArrow(run, schema)


def score(docs: DataFrame, model: tuple, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, and tox_score (0 to 1), for each row of docs."""
    keep = list(keep)
    return _scored(docs, model, keep).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "tox_score")


def drop_toxic(docs: DataFrame, model: tuple) -> DataFrame:
    """The rows of docs whose text scores below 0.5, with all their columns, whatever these are called."""
    return _scored(docs, model, docs.columns).filter(F.col("tox_score") < 0.5).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
