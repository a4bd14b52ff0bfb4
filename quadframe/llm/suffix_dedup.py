"""Repeated passages by a common-prefix-aware distributed merge sort of suffixes.

Every byte that a ``length``-byte string covers which also starts elsewhere is removed. Not all suffixes are sorted. Each
``length``-byte window has an anchor, the place of the least hash among its ``GRAM``-byte strings; equal windows have
anchors at equal places, so only anchors whose string recurs matter. A context is an anchor with the bytes that its
windows reach; contexts that recur whole need no more work, and each different one counts once in what follows.

Windows of a context that begin within ``step`` bytes of each other share ``length - step + 1`` bytes, which begin at a
start; a window can only recur if its start's shared bytes do. So starts are counted by a hash of those bytes, and only the
suffixes at starts that recur are merge sorted across the cluster: a task sorts its own into runs, cuts them at sampled
splitters and sends each piece front coded (length of the prefix shared with the one before, and the rest). The receiver
merges the runs with a loser tree whose players carry the prefix they share with the last winner, so known prefixes are
never compared again, and the order comes with the common prefixes of neighbours. Neighbours that share the bytes of a
start form a group, and equal windows are counted in it by their bytes. Splitters end with the shared bytes, so no group
is cut. A start that more than ``HOT`` contexts share is split into starts of a smaller step, down to single windows,
which need no more than counting. So a group has at most ``HOT`` members, and work is in proportion to the bytes.

Texts are UTF-8 bytes; null counts as empty; matches never cross texts. Repeated rows are separate texts, also if they
repeat or lack an identifier, so a text of at least ``length`` bytes with an exact copy is removed whole. SHA-256 names
texts and BLAKE2b contexts, 128 bits of each. An empty table gives an empty result. Very long texts are cut into chunks
that overlap by a window. Other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work

GRAM = 32
#: Distances between starts: of all, and of those that more than HOT contexts share.
STEPS, HOT = (32, 4, 1), 10_000
#: Suffixes of a run; of a part that one task merges; ranges of the order at most (beyond, parts deal a range by hash).
RUN_ROWS, PART_ROWS, MOST_RANGES = 50_000, 40_000, 4_096
_CHUNK = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_ODD = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0xD1342543DE82EF95
_UP, _DOWN = _powers(_CHUNK + 512, _BASE), _powers(_CHUNK + 512, pow(_BASE, -1, 1 << 64))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each width-byte string of data, equal for equal strings wherever they are."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], dtype=np.uint64)))
    h = (sums[width:] - sums[:-width]) * _DOWN[: len(data) - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(_ODD)
    return h ^ (h >> np.uint64(29))


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor of the text."""
    out, width = [], length - GRAM + 1
    for at in range(0, max(len(text) - length + 1, 0), _CHUNK):
        data = np.frombuffer(text, np.uint8, min(_CHUNK + length - 1, len(text) - at), at)
        h = rolling(data, GRAM)
        # The least hash; of equal ones the leftmost.
        least = sliding_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), width) & _PLACE
        begin = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        end = np.append(begin[1:], len(least)) - 1
        place = least[begin].astype(np.int64)
        out.append((h[place].view(np.int64), place + at, begin + at, end + at))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.empty(0, np.int64) for _ in range(4))


def _find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                got = [anchors(t.encode("utf-8", "surrogatepass"), length) for t in batch.column(1).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]))
                h, place, first, last = (np.concatenate(x) for x in zip(*got))
                small = [pa.array(place.astype(np.int32)), pa.array((place - first).astype(np.int16)), pa.array((last - place + length).astype(np.int16))]
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(row), *small], ["h", "t", "place", "before", "after"])

    return run


def _named(whole: bytes, before: int) -> bytes:
    return hashlib.blake2b(whole, digest_size=16, salt=before.to_bytes(2, "little")).digest()


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that each candidate anchor's windows reach; each different one once a task, then only its name."""
    seen: set[bytes] = set()
    for batch in batches:
        t, texts, found = (batch.column(k) for k in range(3))
        row, names, left, right, rest = [], [], [], [], []
        for k, (text, list_) in enumerate(zip(texts.to_pylist(), found.to_pylist())):
            data = text.encode("utf-8", "surrogatepass")
            for a in list_:
                p, b, e = a["place"], a["before"], a["after"]
                whole = data[p - b : p + e]
                name = _named(whole, b)
                row.append(k)
                names.append(name)
                rest.append((a["h"], p, b, e))
                fresh = name not in seen
                seen.add(name)
                left.append(whole[:b] if fresh else None)
                right.append(whole[b:] if fresh else None)
            if len(seen) > 500_000:
                seen.clear()
        h, p, b, e = np.array(rest, np.int64).reshape(-1, 4).T
        columns = [t.take(pa.array(row, pa.int64())), pa.array(h), pa.array(p.astype(np.int32)), pa.array(b.astype(np.int16)), pa.array(e.astype(np.int16)), pa.array(names, pa.binary()), pa.array(left, pa.binary()), pa.array(right, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["t", "h", "place", "before", "after", "name", "left", "right"])


def starts_of(left: bytes, right: bytes, length: int, step: int, blocks: list[int] | None = None, of: int = 0) -> Iterator[int]:
    """Bytes before the anchor of each start of a context; blocks: only within ``of`` bytes from those."""
    least, most = length - len(right), len(left)
    for low, high in [(least, most)] if blocks is None else [(max(b, least), min(b + of - 1, most)) for b in blocks]:
        yield from range(low // step * step, high + 1, step)


def _find_starts(length: int, step: int, of: int):
    """Starts of (name, left, right, blocks), each with a hash of the bytes that its windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, d, keys = [], [], []
            for k, (left, right, blocks) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                whole, b = left + right, len(left)
                for start in starts_of(left, right, length, step, blocks, of):
                    row.append(k)
                    d.append(start)
                    keys.append(_named(whole[b - start : b - start + length - step + 1], start))
            key = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(d, pa.int32()), pa.array(key[:, 0]), pa.array(key[:, 1])], ["name", "d", "k1", "k2"])

    return run


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be at least at."""
    most = min(len(a), len(b))
    while at < most:
        step = min(most - at, 64)
        if a[at : at + step] == b[at : at + step]:
            at += step
            continue
        while a[at] == b[at]:
            at += 1
        break
    return at


def suffix_at(left: bytes, right: bytes, start: int, step: int, length: int) -> tuple[bytes, bytes]:
    """The suffix at a start, as far as its windows reach, with its step ahead of it; and the bytes before that they reach."""
    whole, at = left + right, len(left) - start
    return bytes([step]) + whole[at : at + length], whole[max(at - step + 1, 0) : at]


def front_code(run: list[tuple], part_of) -> Iterator[tuple]:
    """(part, shared, rest, *others) of sorted (suffix, *others)."""
    part, last = -1, b""
    for suffix, *others in run:
        now = part_of(suffix)
        shared = common(last, suffix) if now == part else 0
        yield now, shared, suffix[shared:], *others
        part, last = now, suffix


class Player:
    """A front-coded run: its current suffix, and the prefix that suffix shares with the last winner of the tree."""

    __slots__ = ("coded", "at", "suffix", "others", "shared")

    def __init__(self, coded: list[tuple]):
        self.coded, self.at, self.suffix = coded, 0, b""
        self.advance()

    def advance(self) -> None:
        if self.at == len(self.coded):
            self.suffix, self.shared = None, -1
            return
        shared, rest, *self.others = self.coded[self.at]
        self.suffix, self.shared = self.suffix[:shared] + rest, shared
        self.at += 1


def play(a: Player, b: Player) -> tuple[Player, Player]:
    """Winner (the smaller) and loser; the loser's shared prefix is then that with the winner, if it was less known."""
    if a.suffix is None or b.suffix is None:
        return (b, a) if a.suffix is None else (a, b)
    if a.shared != b.shared:  # who shares more with the last winner comes first
        return (a, b) if a.shared > b.shared else (b, a)
    n = common(a.suffix, b.suffix, a.shared)
    if a.suffix[n : n + 1] <= b.suffix[n : n + 1]:
        b.shared = n
        return a, b
    a.shared = n
    return b, a


def merge(runs: list[list[tuple]]) -> Iterator[tuple[int, bytes, list]]:
    """(prefix shared with the one before, suffix, others) of all runs in order, by a loser tree."""
    size = 1
    while size < len(runs):
        size *= 2
    players = [Player(r) for r in runs] + [Player([]) for _ in range(size - len(runs))]
    losers: list = [None] * size

    def build(k: int) -> Player:
        if k >= size:
            return players[k - size]
        win, losers[k] = play(build(2 * k), build(2 * k + 1))
        return win

    for p in players:
        p.shared = 0 if p.suffix is not None else -1
    leaf = {id(p): size + k for k, p in enumerate(players)}
    win = build(1)
    shared = 0
    while win.suffix is not None:
        yield shared, win.suffix, win.others
        k = leaf[id(win)] // 2
        win.advance()
        while k:
            win, losers[k] = play(win, losers[k])
            k //= 2
        shared = win.shared


def equal_windows(group: list[tuple[bytes, bytes]], length: int, step: int) -> list[tuple[int, int]]:
    """Least and most bytes before its start at which a window of each (suffix, left) begins that another one has too.

    The suffixes share their first length - step + 1 bytes; (step, -1) where there is none.
    """
    out = [(step, -1)] * len(group)
    for e in range(step):
        having = defaultdict(list)
        for k, (suffix, left) in enumerate(group):
            if length - len(suffix) <= e <= len(left):
                having[left[len(left) - e :] + suffix[length - step + 1 : length - e]].append(k)
        for members in having.values():
            if len(members) > 1:
                for k in members:
                    out[k] = (min(out[k][0], e), e)
    return out


def _settle(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), ("seq", "ascending")])
        runs: dict[int, list[tuple]] = {}
        for r, *rest in zip(*(table.column(c).to_pylist() for c in ("run", "shared", "rest", "left", "name", "d"))):
            runs.setdefault(r, []).append(tuple(rest))
        out: list[tuple] = []

        def close(group: list[tuple]) -> None:
            step = group[0][0][0]
            found = equal_windows([(suffix[1:], left) for suffix, left, *_ in group], length, step)
            out.extend((name, d + least, d + most) for (_, _, name, d), (least, most) in zip(group, found) if most >= 0)

        group: list[tuple] = []
        for shared, suffix, (left, name, d) in merge(list(runs.values())):
            if group and shared < length - suffix[0] + 2:
                if len(group) > 1:
                    close(group)
                group = []
            group.append((suffix, left, name, d))
        if len(group) > 1:
            close(group)
        name, least, most = zip(*out) if out else ([], [], [])
        return pa.table({"name": pa.array(name, pa.binary()), "least": pa.array(least, pa.int32()), "most": pa.array(most, pa.int32())})

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data, kept, n, removed, end = text.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0, 0, 0
            joined: list[list[int]] = []
            for s in sorted((s["begin"], s["end"]) for s in spans):
                if joined and s[0] <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], s[1])
                else:
                    joined.append(list(s))
            for a, b in joined:
                kept.update(data[end:a])
                n, removed, end = n + 1, removed + b - a, b
            kept.update(data[end:])
            out.append((removed, n, kept.hexdigest(), [x for s in joined for x in s]))
        removed, n, sha, joined = zip(*out) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(joined, pa.list_(pa.int32()))],
            ["t", "removed", "spans", "sha", "removed_at"],
        )


def merge_sorted(chosen: DataFrame, work: Work, length: int) -> DataFrame:
    """(name, least, most) of the contexts that share windows. chosen: (name, left, right, starts), starts as (d, step)."""
    n = chosen.agg(F.sum(F.size("starts"))).first()[0] or 0
    parts = max(1, -(-n // PART_ROWS))
    ranges = min(parts, MOST_RANGES)
    deal = -(-parts // ranges)
    # Splitters: a bounded sample of suffixes, a few for each range, cut after the bytes that a group shares.
    ordered = []
    for r in chosen.orderBy("name").limit(4 * ranges if ranges > 1 else 0).collect():
        for d, step in r["starts"]:
            ordered.append(suffix_at(bytes(r["left"]), bytes(r["right"]), d, step, length)[0][: length - step + 2])
    ordered.sort()
    splitters = sorted({ordered[k * len(ordered) // ranges] for k in range(1, ranges)}) if ordered else []

    def part_of(suffix: bytes) -> int:
        shared = suffix[: length - suffix[0] + 2]
        return bisect_right(splitters, shared) * deal + (_named(shared, 0)[0] % deal if deal > 1 else 0)

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run, own = TaskContext.get().partitionId() << 24, []

        def coded() -> pa.RecordBatch:
            own.sort()
            part, shared, rest, left, name, d = zip(*front_code(own, part_of)) if own else [[]] * 6
            columns = [pa.array(part, pa.int32()), pa.array([run] * len(part), pa.int64()), pa.array(range(len(part)), pa.int32()), pa.array(shared, pa.int32()), pa.array(rest, pa.binary()), pa.array(left, pa.binary()), pa.array(name, pa.binary()), pa.array(d, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["part", "run", "seq", "shared", "rest", "left", "name", "d"])

        for batch in batches:
            for name, left, right, starts in zip(*(c.to_pylist() for c in batch.columns)):
                own.extend((*suffix_at(left, right, s["d"], s["step"], length), name, s["d"]) for s in starts)
                if len(own) >= RUN_ROWS:
                    yield coded()
                    run, own = run + 1, []
        yield coded()

    runs = chosen.select("name", "left", "right", "starts").mapInArrow(sort_runs, "part int, run long, seq int, shared int, rest binary, left binary, name binary, d int")
    return work.save(runs.groupBy("part").applyInArrow(_settle(length), "name binary, least int, most int"), "settled")


def repeated_contexts(contexts: DataFrame, work: Work, length: int, hot: int = HOT) -> DataFrame:
    """(name, least, most) of the contexts (name, left, right), all different, that share windows with others."""
    given, chosen, found, of = contexts.withColumn("blocks", F.lit(None).cast("array<int>")), None, None, 0
    for step in STEPS:
        starts = work.save(given.select("name", "left", "right", "blocks").mapInArrow(_find_starts(length, step, of), "name binary, d int, k1 long, k2 long"), f"starts{step}")
        keys = work.save(starts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"keys{step}")
        alive = starts.join(keys, ["k1", "k2"])
        if step == 1:  # the shared bytes are the window
            found = alive.select("name", F.col("d").alias("least"), F.col("d").alias("most"))
            break
        few = alive.filter(F.col("n") <= hot).select("name", "d", F.lit(step).alias("step"))
        chosen = few if chosen is None else chosen.unionByName(few)
        many = keys.filter(F.col("n") > hot)
        if many.isEmpty():
            break
        blocks = starts.join(many, ["k1", "k2"]).groupBy("name").agg(F.collect_list("d").alias("blocks"))
        given, of = contexts.join(blocks, "name"), step
    chosen = chosen.groupBy("name").agg(F.collect_list(F.struct("d", "step")).alias("starts"))
    settled = merge_sorted(work.save(contexts.join(chosen, "name").select("name", "left", "right", "starts"), "chosen"), work, length)
    return settled if found is None else settled.unionByName(found)


def remove_repeats(docs: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed_at) for each row of docs.

    removed_at: begins and ends of the removed runs in turn, as byte places; null if none or all is removed.
    """
    work = Work(docs.sparkSession, "suffix")
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("doc_id", text.alias("text")).withColumn("sha_all", F.sha2("text", 256)).withColumn("t", F.unhex(F.substring("sha_all", 1, 32)))
    rows = work.save(named.select("doc_id", "t", F.octet_length("text").cast("long").alias("n_bytes"), "sha_all"), "rows")
    long_ = named.filter(F.octet_length("text") >= length).select("t", "text")
    found = work.save(long_.mapInArrow(_find_anchors(length), "h long, t binary, place int, before smallint, after smallint"), "anchors")
    where = F.xxhash64("t", "place")
    recurs = work.save(found.groupBy("h").agg(F.min(where).alias("one"), F.max(where).alias("other")).filter("one <> other").select("h"), "recurs")
    candidates = found.join(recurs, "h", "left_semi").groupBy("t").agg(F.collect_set(F.struct("h", "place", "before", "after")).alias("found"))
    candidates = work.save(candidates, "candidates")
    work.drop("anchors")  # tables go as soon as nothing reads them
    # A task sends each text once, however many copies it has.
    held = work.save(long_.groupBy("t").agg(F.first("text").alias("text")).join(candidates, "t").select("t", "text", "found"), "held")
    work.drop("candidates")
    cut = work.save(held.mapInArrow(_cut_contexts, "t binary, h long, place int, before smallint, after smallint, name binary, left binary, right binary"), "contexts")
    often = cut.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("after").alias("after")).filter("n > 1")
    often = often.select("name", (F.lit(length) - F.col("after")).cast("int").alias("least"), F.col("before").cast("int").alias("most"))
    # Anchor strings with one context only have nothing to compare.
    mixed = work.save(cut.groupBy("h").agg(F.min("name").alias("one"), F.max("name").alias("other")).filter("one <> other").select("h"), "mixed")
    different = cut.filter("right is not null").join(mixed, "h", "left_semi").groupBy("name").agg(F.first("left").alias("left"), F.first("right").alias("right"))
    shared = repeated_contexts(work.save(different, "different"), work, length, hot)
    reach = work.save(often.unionByName(shared).groupBy("name").agg(F.min("least").alias("least"), F.max("most").alias("most")), "reach")
    for name in ("different", "chosen", "settled", *[f"{x}{s}" for s in STEPS for x in ("starts", "keys")]):
        work.drop(name)
    span = F.struct((F.col("place") - F.col("most")).alias("begin"), (F.col("place") - F.col("least") + length).alias("end"))
    spans = cut.select("t", "place", "name").join(reach, "name").groupBy("t").agg(F.collect_list(span).alias("spans"))
    done = work.save(held.join(spans, "t").select("t", "text", "spans").mapInArrow(_remove, "t binary, removed long, spans long, sha string, removed_at array<int>"), "done")
    copies = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t", F.lit(True).alias("copied"))
    judged = work.save(rows.join(work.save(copies, "copies"), "t", "left"), "judged").join(done, "t", "left")
    whole = F.col("copied").isNotNull() & (F.col("n_bytes") >= length)
    return judged.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("sha", "sha_all")).alias("kept_sha256"),
        F.when(~whole, F.col("removed_at")).alias("removed_at"),
    )
