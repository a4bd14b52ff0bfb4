"""Alignment of two tokenizers: which tokens end together, and how often each pair of ids does so in the whole corpus.

Counting is external. Each task encodes its documents in blocks of bounded text. A block's pairs, each once with its number,
are radix-partitioned by a hash of the second side's id and sorted into runs, second side first, which are written
compressed by zstd. For each partition a k-way heap goes through its runs in that order: all of one id's entries come
together, which gives the count of each pair and, when the id ends, its greatest count. In the same pass what was found is
streamed back, entry by entry, into a reply to each run, and replies return to their block, whose documents hold
their links as places in the block's pairs. A pair that half of all documents hold is one entry a block, so no id is hot, and
no task sees more than its own block or the runs of one partition.

A text is encoded by the first tokenizer with a space before it, by the second as it is (which adds the space), special
tokens as plain text. Words that follow a single space are encoded apart, and their results kept while they recur; at
load it is checked that neither tokenizer joins across such a space, else texts are encoded whole. Texts that are null or
empty, and those whose tokens don't spell space and text again, have no tokens and zeros. Repeated rows count as often
as they occur; ties for the greatest count are all best. An empty table gives an empty result; identifiers of any type, null
and repeated ones too, are carried along; other columns don't matter. A very long text is a block of its own.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work

#: Characters of text in a block, about; parts that runs are dealt to; words kept in a worker, and their greatest length.
BLOCK, PARTS, CACHED, LONGEST = 24_000_000, 256, 150_000, 48
#: A link's key: part of the second side's id, that id, the first side's id.
_B, _PART = 20, 40
#: A space between words, where no token crosses.
_SPACE = re.compile(r"(?<=[^\s▁]) (?=\S)")
Aligned = tuple[int, int, str, bytes]
DIGEST = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def part_of(b: int) -> int:
    return (b * 0x9E3779B1 & 0xFFFFFFFF) * PARTS >> 32


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Tokens of both tokenizers over a text, cut where both end."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = _letters()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.bytes_a = {i: special.get(i) or bytes(letters[c] for c in t) for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = {i: len(x) for i, x in self.bytes_a.items()}, [len(x) for x in self.bytes_b]
        self.key_b = [part_of(i) << _PART | i << _B for i in range(len(pieces))]
        before = self.a.pre_tokenizer.pre_tokenize_str(" it's x1 ,y")
        self.splits = self.a.normalizer is None and [p for p, _ in before] == ["Ġit", "'s", "Ġx", "1", "Ġ,", "y"] and not any("▁" in p.lstrip("▁") for p in pieces)
        self.words: dict[str, Aligned | None] = {}
        self.old: dict[str, Aligned | None] = {}

    def cut(self, text: str, ids_a: list[int], ids_b: list[int]) -> Aligned | None:
        """Numbers of tokens, groups as text, keys of links as bytes; None unless both spell space and text."""
        want = b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != want or b"".join(map(self.bytes_b.__getitem__, ids_b)) != want:
            return None
        size_a, size_b, key_b, groups, keys, left, right, end_a, end_b, rest = self.size_a, self.size_b, self.key_b, [], [], "", "", 0, 0, iter(ids_b)
        for a in ids_a:
            end_a += size_a[a]
            left = f"{left},{a}" if left else f"{a}"
            while end_b < end_a:
                b = next(rest)
                end_b += size_b[b]
                right = f"{right},{b}" if right else f"{b}"
            if end_a == end_b:
                groups.append(f"{left}|{right}")
                keys.append(key_b[b] | a)
                left = right = ""
        return len(ids_a), len(ids_b), ";".join(groups), struct.pack(f"<{len(keys)}q", *keys)

    def encode(self, texts: list[str]) -> list[Aligned | None]:
        """Of texts as they are, none of them empty."""
        found = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        return [self.cut(t, x.ids, y) for t, x, y in zip(texts, found, self.b.encode(texts, num_threads=1))]

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, str, np.ndarray]]:
        """Numbers of tokens, digest of the groups, and keys of links, one for each group."""
        if len(self.words) > CACHED:
            self.words, self.old = {}, self.words
        words, old, long_ = self.words, self.old, {}
        parts = [_SPACE.split(t) if t and self.splits else [] for t in texts]
        new = []
        for w in set(chain.from_iterable(parts)).difference(words):
            if w in old:
                words[w] = old[w]
            elif w:
                new.append(w)
        for w, x in zip(new, self.encode(new) if new else ()):
            (words if len(w) <= LONGEST else long_)[w] = x
        out = []
        for text, cut in zip(texts, parts):
            got = [words[w] if w in words else long_[w] for w in cut] if long_ else list(map(words.__getitem__, cut))
            if text and (not got or None in got):
                got = self.encode([text])
            if not text or got[0] is None:
                out.append((0, 0, "", np.empty(0, np.int64)))
                continue
            n_a, n_b, groups, keys = zip(*got)
            out.append((sum(n_a), sum(n_b), hashlib.sha256(";".join(groups).encode()).hexdigest(), np.frombuffer(b"".join(keys), "<i8")))
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this Python worker, with what it has kept from earlier tasks."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join([x.tobytes() for x in arrays]))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def blocks(docs: DataFrame, path_a: str, path_b: str, most: int = BLOCK) -> DataFrame:
    """Rows of documents with their links, and of runs (part not null), each with the block they belong to; most: characters of a block."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "block", "part", "n_a", "n_b", "n_groups", "sha", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        align = aligner(path_a, path_b)
        held: list[tuple] = []  # ids, keys and numbers of the block's documents
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            name = uuid.uuid4().hex
            ids = pa.concat_arrays([x[0] for x in held])
            every = np.concatenate([x[1] for x in held])
            pairs, places, counts = np.unique(every, return_inverse=True, return_counts=True)
            ends = np.cumsum([len(x[1]) for x in held])
            places = np.split(places.astype("<u4"), ends[:-1])
            for at in range(0, len(held), 256):
                some = held[at : at + 256]
                n = len(some)
                cols = [ids.slice(at, n), pa.array([name] * n), pa.nulls(n, pa.int32()), *[pa.array([x[k] for x in some], pa.int64()) for k in (2, 3, 4)], pa.array([x[5] for x in some], pa.string()), pa.array([pack(p) for p in places[at : at + n]], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)
            part = pairs >> _PART
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            runs = [pack(np.diff(pairs[s:e], prepend=0).astype("<i8"), counts[s:e].astype("<i8")) for s, e in zip(starts, [*starts[1:], len(pairs)])]
            if runs:
                n = len(runs)
                nothing = [pa.nulls(n, pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([pa.nulls(n, ids.type), pa.array([name] * n), pa.array(part[starts], pa.int32()), *nothing, pa.nulls(n, pa.string()), pa.array(runs, pa.binary())], names)

        for big in batches:
            for first in range(0, big.num_rows, 128):
                batch = big.slice(first, 128)
                texts = batch.column(1).to_pylist()
                for row, (text, (n_a, n_b, sha, keys)) in enumerate(zip(texts, align(texts))):
                    n = len(text or "")
                    if held and size + n > most:
                        yield from block()
                        held, size = [], 0
                    size += n
                    held.append((batch.column(0).slice(row, 1), keys, n_a, n_b, len(keys), sha))
        if held:
            yield from block()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, block string, part int, n_a long, n_b long, n_groups long, sha string, packed binary")


class Run:
    """A sorted run, one id of the second side after the other."""

    def __init__(self, blob: bytes):
        deltas, self.counts = unpack(blob, "<i8", "<i8")
        self.pairs = np.cumsum(deltas)
        b = self.pairs >> _B
        self.starts = np.flatnonzero(np.diff(b, prepend=-1))
        self.ends = np.append(self.starts[1:], len(b))
        self.ids = b[self.starts].tolist()
        self.at = 0
        self.totals, self.best = np.zeros(len(b), np.int64), np.zeros(len(b), np.int8)


def merge(runs: list[Run]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pairs, counts, whether best) of one id of the second side after the other; each run gets its entries' counts."""
    heap = [(r.ids[0], k) for k, r in enumerate(runs) if r.ids]
    heapq.heapify(heap)
    while heap:
        b, here = heap[0][0], []
        while heap and heap[0][0] == b:
            k = heap[0][1]
            run = runs[k]
            here.append((run, slice(run.starts[run.at], run.ends[run.at])))
            run.at += 1
            if run.at < len(run.ids):
                heapq.heapreplace(heap, (run.ids[run.at], k))
            else:
                heapq.heappop(heap)
        pairs, places = np.unique(np.concatenate([r.pairs[s] for r, s in here]), return_inverse=True)
        totals = np.zeros(len(pairs), np.int64)
        np.add.at(totals, places, np.concatenate([r.counts[s] for r, s in here]))
        best, at = totals == totals.max(), 0
        for r, s in here:
            mine = places[at : at + s.stop - s.start]
            r.totals[s], r.best[s], at = totals[mine], best[mine], at + len(mine)
        yield pairs, totals, best


def counted(runs: DataFrame, pairs: bool) -> DataFrame:
    """Of each part: pairs (a, b, links, best), or replies (block, part, packed) to its runs."""

    def run(group: pa.Table) -> pa.Table:
        own = [Run(x) for x in group.column("packed").to_pylist()]
        found = merge(own)
        if pairs:
            keys, totals, best = (np.concatenate(x) for x in zip(*found))
            return pa.table({"a": keys & (1 << _B) - 1, "b": keys >> _B & (1 << _PART - _B) - 1, "links": totals, "best": best})
        for _ in found:
            pass
        return pa.table({"block": group.column("block"), "part": group.column("part"), "packed": pa.array([pack(r.totals, r.best) for r in own], pa.binary())})

    schema = "a long, b long, links long, best boolean" if pairs else "block string, part int, packed binary"
    return runs.groupBy("part").applyInArrow(run, schema)


def returned(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Documents of each block with sums over their links."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        got = [unpack(x, "<i8", "i1") for x in right.column("packed").to_pylist()]
        totals, best = (np.concatenate([x[k] for x in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
        links = [unpack(x, "<u4")[0] for x in left.column("packed").to_pylist()]
        sums = {"n_links": [len(x) for x in links], "n_best": [int(best[x].sum()) for x in links], "count_sum": [int(totals[x].sum()) for x in links]}
        out = {"doc_id": left.column("doc_id")} | {n: left.column(n) for n in ("n_a", "n_b", "n_groups")} | {n: pa.array(x, pa.int64()) for n, x in sums.items()}
        return pa.table(out | {"groups_sha256": left.column("sha")})

    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, f"doc_id {kind}, {DIGEST}")


def _encoded(docs: DataFrame, path_a: str | None, path_b: str | None, most: int) -> tuple[DataFrame, DataFrame, Work]:
    import public_tokenizers

    work = Work(docs.sparkSession, "align")
    paths = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    every = work.save(blocks(docs, *paths, most), "blocks")
    return every.filter("part is null").drop("part"), every.filter("part is not null").select("block", "part", "packed"), work


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, most: int = BLOCK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs (doc_id, text)."""
    rows, runs, work = _encoded(docs, path_a, path_b, most)
    return returned(rows, work.save(counted(runs, pairs=False), "replies"))


def pairs(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, most: int = BLOCK) -> DataFrame:
    """(a, b, links, best): how often ids are linked in the whole corpus, and whether b has no pair with more."""
    return counted(_encoded(docs, path_a, path_b, most)[1], pairs=True)
