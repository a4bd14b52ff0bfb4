"""Best-fit packing through a configuration linear program over the length histogram.

Documents become token ids and an end id; only what is longer than a sequence is cut. The histogram of piece lengths (one
number a length, however many documents) is packed on the driver: a configuration is a multiset of lengths that fits into
a sequence, and the linear program asks for the fewest configurations that cover the histogram. It is solved by
multiplicative weights: lengths that are covered less than others gain weight, and a knapsack dynamic program over the
capacity prices the best configurations under the weights. The solution is rounded down; what is then uncovered goes by
best fit, whole classes of equal sequences at a time. Pieces get their place by arithmetic from their rank among pieces
of equal length, so no task sees more than its own pieces.

Null texts count as empty; an empty text is a piece of one end id. Repeated rows are separate documents; an empty table
gives an empty result. Very long texts become many pieces, very long words are encoded but not kept. Among equal lengths
places follow the order in which tasks read. Other columns of the input don't matter. The plan that tasks receive has a few
entries for each different length (4096 at most) and doesn't grow with the documents.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import Work

#: Words, and parts of words, kept with their ids in a worker, and their greatest length; beyond, a cache starts anew and
#: takes over what is met again from the one before.
CACHED, LONGEST = 250_000, 64
#: Words of printable ASCII and Latin-1 letters, and the tokenizer's own cut of them in lower case.
EASY = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Texts whose ids tell whether a tokenizer cuts as PLAIN does.
PROBES = ("It's 2024: the Quick_brown-fox's 3.14% (e.g. re-use), can't!?", "x=1;y->z //a\tb\n\nC++ don'T 'sx ''s a1b2", "naïve Straße — 东京 😀 и", "ab" * 50, "ÀÉÎÕÜ'S ñandú;Çà-và2l'Été d'ÿ ÆØÞðþß ÷×a ªº µ²¼")
#: Rounds of multiplicative weights at most, least distance from the dual bound at which they stop, how fast weights change.
ROUNDS, GAP, RATE = 12, 1e-4, 3.0


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in a row. Words and
    the parts that its pre-tokenizer cuts them into recur, and their ids are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.parts, self.known = {"": b""}, {}, True
        self.old_words, self.old_parts = {}, {}
        # A tokenizer that joins words or cuts them in other ways is asked for whole texts.
        self.known = all(self(t) == self._whole(t) for t in PROBES)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str, spelled: bool = True) -> bytes:
        """spelled: as the model reads it, bytes written as letters. No such spelling of other letters than ASCII is a part of an EASY word."""
        ids = self.parts.get(part)
        if ids is None:
            ids = self.old_parts.get(part)
            if ids is None:
                names = [part] if spelled else [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
                found = [t.id for p in names for t in self.tokenizer.model.tokenize(p)]
                ids = struct.pack(f"<{len(found)}I", *found)
            if len(part) <= LONGEST:
                self.parts[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        t = self.tokenizer
        if "<|" in word:  # special tokens are cut out of the text as it stands
            return self._whole(word)
        if EASY.fullmatch(word):
            return b"".join([self._part(p, p.isascii()) for p in PLAIN.findall(word.lower())])
        return b"".join([self._part(p) for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(word))])

    def __call__(self, text: str) -> bytes:
        if not self.known:
            return self._whole(text)
        if len(self.words) > CACHED:
            self.words, self.old_words = {"": b""}, self.words
        if len(self.parts) > CACHED:
            self.parts, self.old_parts = {}, self.parts
        words, out = self.words, text.replace("\n", " ").split(" ")
        long_ = {}
        for w in set(out).difference(words):
            ids = self.old_words.get(w)
            (words if len(w) <= LONGEST else long_)[w] = self._word(w) if ids is None else ids
        return b"".join([words[w] if w in words else long_[w] for w in out]) if long_ else b"".join(map(words.__getitem__, out))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, with what it has kept from earlier tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank[, ids]): rank counts pieces of a length within a task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *["ids"][: int(with_ids)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, seen, part = encoder(path), Counter(), TaskContext.get().partitionId()
        tail, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                rows, cols = [], [[] for _ in names[1:]]
                for row, ids in enumerate(batch.column(1).to_pylist()):
                    ids = encode(ids or "") + tail
                    for k, b in enumerate(range(0, len(ids), width)):
                        cut = ids[b : b + width]
                        n = len(cut) // 4
                        rows.append(row)
                        for col, x in zip(cols, (k, b // 4, n, zlib.crc32(cut), part, seen[n], np.frombuffer(cut, "<i4"))):
                            col.append(x)
                        seen[n] += 1
                ids = batch.column(0).take(pa.array(rows, pa.int64()))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols, kinds)]], names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best value of each capacity when lengths may repeat, a length of that best (0: none), the capacity it fills. value: by length."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(value)
    worth = value[lengths]
    for c in range(1, capacity + 1):
        n = np.searchsorted(lengths, c, "right")
        if n:
            total = worth[:n] + best[c - lengths[:n]]
            k = int(total.argmax())
            best[c], pick[c] = total[k], lengths[k]
        if best[c] <= best[c - 1]:
            best[c], pick[c] = best[c - 1], -1
    # Where a longer capacity is worth no more, its best is that of the next shorter one.
    down = np.maximum.accumulate(np.where(pick >= 0, np.arange(capacity + 1), 0))
    return best, pick[down], down


def configuration(first: int, pick: np.ndarray, down: np.ndarray, capacity: int) -> tuple[int, ...]:
    """The best configuration that holds the length first."""
    out, c = [first], capacity - first
    while c > 0 and pick[c]:
        out.append(int(pick[c]))
        c = down[c] - int(pick[c])
    return tuple(sorted(out, reverse=True))


def solve(counts: dict[int, int], capacity: int) -> dict[tuple[int, ...], float]:
    """Fractional numbers of configurations by multiplicative weights; lengths are covered about equally often.

    The weights over the best configuration's value are a solution of the dual program, so their total bounds the number
    of sequences from below; rounds end when the cover is near that bound.
    """
    bound = 0.0
    lengths = np.array(sorted(counts))
    wanted = np.array([counts[n] for n in lengths], float)
    place = {int(n): k for k, n in enumerate(lengths)}
    covered, used = np.zeros(len(lengths)), defaultdict(float)
    for _ in range(ROUNDS):
        lag = covered / wanted
        weight = np.zeros(capacity + 1)
        # A length's price: its share of a sequence, more if it is covered less than others.
        weight[lengths] = lengths / capacity * np.exp(-RATE * (lag - lag.mean()) / max(1.0, lag.mean()))
        best, pick, down = knapsack(weight, capacity)
        bound = max(bound, float(weight[lengths] @ wanted) / best[capacity])
        total = sum(used.values())
        if used and total / max((covered / wanted).min(), 1e-9) <= bound * (1 + GAP):
            break
        top = (weight[lengths] + best[capacity - lengths]).max()
        step = np.zeros(len(lengths))
        for k in np.argsort(lag - 1e-6 * lengths, kind="stable"):
            if (lag[k] + step[k] / wanted[k]) >= lag.mean() + 1 / 6 + 0.5:
                continue
            chosen = configuration(int(lengths[k]), pick, down, capacity)
            if sum(weight[n] for n in chosen) < 0.5 * top:
                continue
            need = Counter(place[n] for n in chosen)
            times = min(wanted[i] / a for i, a in need.items()) / 6
            used[chosen] += times
            for i, a in need.items():
                step[i] += a * times
        covered += step
    # As many tokens as there are; rounding leaves out what would cover a length too often.
    scale = (lengths * wanted).sum() / max(sum(x * sum(p) for p, x in used.items()), 1e-9)
    return {p: x * scale for p, x in used.items()}


def best_fit(counts: dict[int, int], plan: dict[tuple[int, ...], int], capacity: int) -> dict[tuple[int, ...], int]:
    """plan with the pieces of counts added, longest first, each to the fullest sequence it fits, else to a new one.

    Equal sequences are one class with a number, so the work follows the different lengths and not the pieces.
    """
    by_gap: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(p: tuple[int, ...], n: int) -> None:
        gap = by_gap[capacity - sum(p)]
        gap[p] = gap.get(p, 0) + n

    for p, n in plan.items():
        put(p, n)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = next((g for g in range(length, capacity) if by_gap.get(g)), None)
            if gap is None:
                fit = capacity // length
                full, rest = divmod(left, fit)
                for n, k in ((full, fit), (1, rest)):
                    if n and k:
                        put((length,) * k, n)
                break
            p, n = next(iter(by_gap[gap].items()))
            take = min(n, left)
            if take == n:
                del by_gap[gap][p]
            else:
                by_gap[gap][p] = n - take
            put((*p, length), take)
            left -= take
    out: Counter = Counter()
    for gap in by_gap.values():
        for p, n in gap.items():
            out[p] += n
    return dict(out)


def plan_for(counts: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """Configurations with their numbers, which hold every piece of the histogram once."""
    left, plan = dict(counts), {}
    full = left.pop(capacity, 0)
    if full:
        plan[(capacity,)] = full
    rest = dict(left)
    if left:
        for p, x in sorted(solve(left, capacity).items(), key=lambda i: (sum(i[0]), i[1], i[0]), reverse=True):
            need = Counter(p)
            n = min(int(x + 0.5), *(left[k] // a for k, a in need.items()))
            if n:
                plan[p] = plan.get(p, 0) + n
                for k, a in need.items():
                    left[k] -= a * n
    # Rounding can cost more than the program gains, so the plan without it is made too.
    whole = {(capacity,): full} if full else {}
    return min((best_fit({k: n for k, n in c.items() if n}, p, capacity) for c, p in ((left, plan), (rest, whole))), key=lambda p: sum(p.values()))


def slots(plan: dict[tuple[int, ...], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """By length: first rank, first sequence and offsets of each configuration that holds it, in the order of ranks."""
    out: dict[int, list] = defaultdict(list)
    base = 0
    for p, n in sorted(plan.items(), reverse=True):
        offsets = np.concatenate(([0], np.cumsum(p)[:-1]))
        for length in set(p):
            out[length].append((n, base, offsets[np.array(p) == length]))
        base += n
    return {length: (np.cumsum([0, *[n * len(o) for n, _, o in rows]])[:-1], np.array([b for _, b, _ in rows]), [o for *_, o in rows]) for length, rows in out.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), one row a piece.

    path: a tokenizer file, found at the same place on all executors.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    work = Work(docs.sparkSession, "pack")
    cut = work.save(pieces(docs, path, capacity, end_id, with_ids), "pieces")
    by_part = work.save(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # A row for each task and length: it grows with the tasks, so it is never broadcast.
    ranked = cut.drop("ids").join(first.hint("merge"), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("place"), "part", "rank")
    where = docs.sparkSession.sparkContext.broadcast(slots(plan_for(counts, capacity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                starts, bases, offsets = where.value[int(n)]
                k = np.searchsorted(starts, rank[own], "right") - 1
                for j in np.unique(k):
                    here, o = own[k == j], offsets[j]
                    t = rank[here] - starts[j]
                    sequence[here], offset[here] = bases[j] + t // len(o), o[t % len(o)]
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset), *batch.columns[6:]]
            yield pa.RecordBatch.from_arrays(columns, [*names, "part", "rank"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, part int, rank long"
    placed = ranked.mapInArrow(run, schema)
    if not with_ids:
        return placed.select(*names)
    # Ids join at the end and never pass through Python again.
    return cut.select("part", "length", "rank", "ids").join(work.save(placed, "placed"), ["part", "length", "rank"]).select(*names, "ids")
