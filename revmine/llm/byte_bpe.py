"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern.  First tier: a
minimal perfect hash over the vocabulary (one displacement for each bucket of
keys, as many slots as keys) resolves a pre-token that is itself in the
vocabulary with one probe and one comparison.  Second tier: any other
pre-token is merged byte by byte, over a doubly linked list of pieces with a
heap of mergeable neighbours, lowest rank first and leftmost among equals.

A worker encodes a pre-token once and keeps its ids while its table has room.

Defined results: a null text is empty and has no ids; repeated rows are encoded
alike; very long texts and pre-tokens take time n log n.  Columns beside the
named ones are never read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from revmine.llm.words import chunks, kept, raw, released

_M64 = (1 << 64) - 1
_A, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_KNOWN = 300_000    # pre-tokens whose ids a worker keeps
_WIDTHS = (8, 16, 32, 64)  # bytes of pre-tokens that are merged side by side
_SIDE_BY_SIDE = 8192       # so many of them at a time
_NOTHING = (1 << 31) - 1   # in place of a neighbour that is not there
_SLICE = 2 << 20    # bytes of text encoded together


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash from the keys to their values; other keys give -1."""

    def __init__(self, parts: tuple[int, list[int], list[bytes], list[int]]):
        self.n_buckets, self.shift, self.keys, self.values = parts
        self.n = len(self.keys)

    @classmethod
    def build(cls, table: dict[bytes, int]) -> PerfectHash:
        return cls(_PerfectHashBuilder(table).parts())

    def get(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.n_buckets]
        slot = -1 - d if d < 0 else ((((h ^ (d * _A & _M64)) * _B & _M64) >> 32) % self.n)
        return self.values[slot] if self.keys[slot] == key else -1

    def parts(self) -> tuple[int, list[int], list[bytes], list[int]]:
        """Plain data, to be sent to tasks."""
        return self.n_buckets, self.shift, self.keys, self.values


class _PerfectHashBuilder:
    """Places buckets of keys, largest first, at the least displacement that puts all on free slots."""

    def __init__(self, table: dict[bytes, int]):
        self.n, self.n_buckets = len(table), max(1, len(table) // 4)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(self.n_buckets)]
        for key in table:
            h = xxhash.xxh3_64_intdigest(key)
            buckets[h % self.n_buckets].append((h, key))
        self.shift = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * self.n
        free = np.ones(self.n, bool)
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        singles = iter(())
        for b in order:
            size = len(buckets[b])
            if size > 1:
                slots, d = self._place(np.array([h for h, _ in buckets[b]], np.uint64), free)
                self.shift[b] = d
            elif size == 1:
                if not isinstance(singles, list):  # only single keys are left: any free slot will do, named outright
                    singles = np.flatnonzero(free)[::-1].tolist()
                slots = [singles.pop()]
                self.shift[b] = -1 - slots[0]
            else:
                break
            for (_, key), s in zip(buckets[b], slots, strict=True):
                self.keys[s] = key
                free[s] = False
        self.values = [table[k] for k in self.keys]

    def _place(self, hashes: np.ndarray, free: np.ndarray) -> tuple[list[int], int]:
        begin, step = 0, 64
        while True:
            d = np.arange(begin, begin + step, dtype=np.uint64)[:, None]
            slots = (((hashes ^ (d * np.uint64(_A))) * np.uint64(_B)) >> np.uint64(32)) % np.uint64(self.n)
            distinct = np.sort(slots, axis=1)
            ok = free[slots].all(axis=1) & (distinct[:, 1:] != distinct[:, :-1]).all(axis=1)
            if ok.any():
                k = int(np.argmax(ok))
                return slots[k].tolist(), begin + k
            begin, step = begin + step, min(step * 2, 8192)

    def parts(self) -> tuple[int, list[int], list[bytes], list[int]]:
        return self.n_buckets, self.shift, self.keys, self.values


class PairRanks:
    """Rank of the token that two neighbouring tokens merge to: one sorted array, asked for many pairs at once."""

    def __init__(self, ranks: PerfectHash):
        ids = dict(zip(ranks.keys, ranks.values, strict=True))
        found = {}
        for token, r in ids.items():
            for k in range(1, len(token)):
                left = ids.get(token[:k])
                if left is not None and (right := ids.get(token[k:])) is not None:
                    found[left << 32 | right] = r
        self.one = found
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k] for k in self.keys.tolist()], np.int64)

    def many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where two tokens do not merge."""
        if not len(self.keys):
            return np.full(len(left), -1)
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], -1)


class Merger:
    """Second tier: ids of pre-tokens that are not in the vocabulary.

    A token's id is its rank.  Bytes are linked to their neighbours, and a heap
    holds (rank, position) of every pair that merges.  Many short pre-tokens
    are merged side by side: each has a heap of its own, a tournament whose
    leaves are the positions and whose root is the next merge, and numpy does
    one merge of every pre-token at a time.  A long one has a binary heap.
    """

    def __init__(self, ranks: PerfectHash):
        self.pairs = PairRanks(ranks)
        self.of_byte = np.array([ranks.get(bytes([b])) for b in range(256)], np.int64)
        if self.of_byte.min() < 0:
            raise ValueError("the vocabulary lacks a byte")

    def many(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all keys one after the other, ids in each key)."""
        size = np.array([len(k) for k in keys], np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (keys, their numbers of ids, ids)
        for width in _WIDTHS:
            which = np.flatnonzero((size <= width) & (size > (width // 2 if width > _WIDTHS[0] else 0)))
            for lo in range(0, len(which), _SIDE_BY_SIDE):
                some = which[lo:lo + _SIDE_BY_SIDE]
                parts.append((some, *self._side_by_side([keys[i] for i in some.tolist()], size[some], width)))
        for i in np.flatnonzero(size > _WIDTHS[-1]).tolist():
            ids = self.long(keys[i])
            parts.append((np.array([i]), np.array([len(ids)]), np.array(ids, np.int64)))
        n = np.zeros(len(keys), np.int64)
        for which, count, _ in parts:
            n[which] = count
        begin = np.cumsum(n) - n
        flat = np.zeros(int(n.sum()), np.int64)
        for which, count, ids in parts:
            flat[np.arange(len(ids)) + np.repeat(begin[which] - (np.cumsum(count) - count), count)] = ids
        return flat, n

    def _side_by_side(self, keys: list[bytes], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        m, none = len(keys), np.iinfo(np.int64).max
        data = np.frombuffer(b"".join(keys), np.uint8)
        inside = np.arange(width) < size[:, None]
        wide = width + 2  # two more places: what is after the last byte, and before the first
        piece = np.full((m, wide), _NOTHING)
        piece[:, :width][inside] = self.of_byte[data]
        first = self.pairs.many(piece[:, :width].ravel(), piece[:, 1:width + 1].ravel()).reshape(m, width)
        heap = np.full((m, 2 * width), none)
        heap[:, width:] = np.where(first >= 0, first << 8 | np.arange(width), none)
        k = width
        while k > 1:
            np.minimum(heap[:, k:2 * k:2], heap[:, k + 1:2 * k:2], out=heap[:, k // 2:k])
            k //= 2
        after = np.tile(np.append(np.arange(1, width + 1), [width, width]), (m, 1))
        before = np.tile(np.append(np.arange(-1, width - 1), [width + 1, width + 1]), (m, 1))
        before[:, 0] = width + 1
        alive = inside.copy()
        piece, heap, after, before, alive_ = piece.ravel(), heap.ravel(), after.ravel(), before.ravel(), alive.ravel()
        rows = np.flatnonzero(heap[1::2 * width] != none)
        while len(rows):
            at, tree = rows * wide, rows * (2 * width)
            top = heap[tree + 1]
            i, r = top & 255, top >> 8
            j = after[at + i]
            k, h = after[at + j], before[at + i]
            piece[at + i] = r
            after[at + i] = k
            before[at + k] = i
            alive_[rows * width + j] = False
            right = self.pairs.many(r, piece[at + k])
            left = self.pairs.many(piece[at + h], r)
            heap[tree + width + j] = none
            heap[tree + width + i] = np.where(right >= 0, right << 8 | i, none)
            some = h < width
            h = np.where(some, h, i)
            leaf = tree + width + h
            heap[leaf] = np.where(some, np.where(left >= 0, left << 8 | h, none), heap[leaf])
            for leaf in (i, j, h):  # the winners above each changed leaf, one level after the other
                node = (leaf + width) >> 1
                while node[0]:
                    both = tree + 2 * node
                    heap[tree + node] = np.minimum(heap[both], heap[both + 1])
                    node >>= 1
            rows = rows[heap[tree + 1] != none]
        return alive.sum(axis=1), piece.reshape(m, wide)[:, :width][alive]

    def long(self, key: bytes, push=heapq.heappush, pop=heapq.heappop) -> list[int]:
        n, get = len(key), self.pairs.one.get
        piece = self.of_byte[np.frombuffer(key, np.uint8)]
        start = self.pairs.many(piece[:-1], piece[1:]).tolist()
        piece, rank = piece.tolist(), [*start, -1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            if rank[i] != r:
                continue  # the pair at this position is another one by now
            j = after[i]
            k = after[i] = after[j]
            piece[i] = r
            rank[i] = rank[j] = -1
            if k < n:
                before[k] = i
                t = rank[i] = get(r << 32 | piece[k], -1)
                if t >= 0:
                    push(heap, t << 32 | i)
            h = before[i]
            if h >= 0:
                t = rank[h] = get(piece[h] << 32 | r, -1)
                if t >= 0:
                    push(heap, t << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(piece[i])
            i = after[i]
        return out


class BytePairCodec:
    """Texts <-> ids.

    Texts are cut into units before each single space or line feed that stands
    between two characters that are no white space; no pre-token spans such a
    cut and none depends on what is beyond it.  A slice's distinct units are cut
    into pre-tokens together; ids of pre-tokens are worked out once for each
    worker while its table has room.
    """

    def __init__(self, ranks: PerfectHash, pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.merge = Merger(ranks)
        self._forget()
        tokens = dict(zip(ranks.values, ranks.keys, strict=True))
        top = max(tokens) + 1
        self.size = np.zeros(top, np.int64)
        self.size[list(tokens)] = [len(t) for t in tokens.values()]
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(top)), np.uint8)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # pre-token -> its place in the arrays
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, ids in each) of distinct pre-tokens."""
        keys = [p.encode() for p in fresh]
        get = self.ranks.get
        whole = np.array([get(k) for k in keys], np.int64)
        miss = np.flatnonzero(whole < 0)
        n = np.ones(len(keys), np.int64)
        ids, n[miss] = self.merge.many([keys[i] for i in miss.tolist()])
        flat = np.zeros(int(n.sum()), np.uint32)
        begin = np.cumsum(n) - n
        hit = np.flatnonzero(whole >= 0)
        flat[begin[hit]] = whole[hit]
        own = np.ones(len(flat), bool)
        own[begin[hit]] = False
        flat[own] = ids
        return flat, n

    def pre_tokens(self, pres: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pre-tokens one after the other, ids in each)."""
        known = self.known
        fresh = [p for p in dict.fromkeys(pres) if p not in known]
        if len(known) + len(fresh) > _KNOWN and known:
            self._forget()
            known, fresh = self.known, list(dict.fromkeys(pres))
        if fresh:
            flat, n = self._learn(fresh)
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
            self.ids = np.concatenate([self.ids, flat])
        codes = np.fromiter(map(known.__getitem__, pres), np.int64, len(pres))
        size = np.diff(self.at)
        ids, _ = _gather(self.ids, self.at[:-1], size, codes)
        if len(known) > _KNOWN:  # a slice with more than the table holds
            self._forget()
        return ids, size[codes]

    def units(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units one after the other, ids in each); unit i is data[offs[i]:offs[i + 1]]."""
        n_bytes = np.diff(offs)
        # units with a cut at either end stay cut when they follow each other; others are looked at alone
        plain = n_bytes > 1
        head = offs[:-1][plain]
        plain[plain] = _CUT[data[head]] & _SOLID_START[data[head + 1]] & _solid_end(data)[offs[1:][plain] - 1]
        together = data[np.repeat(plain, n_bytes)]
        try:
            text = together.tobytes().decode()
        except UnicodeDecodeError:  # bytes that are no text
            plain[:] = False
            together, text = together[:0], ""
        out_n = np.zeros(len(n_bytes), np.int64)
        pres = self.pattern.findall(text)
        ids, n = self.pre_tokens(pres)
        pre_ends = np.cumsum(np.fromiter(map(len, pres), np.int64, len(pres)))
        chars = np.concatenate([[0], np.cumsum((together & 0xC0) != 0x80)])
        ends = chars[np.cumsum(n_bytes[plain])]
        upto = np.concatenate([[0], np.cumsum(n)])
        out_n[plain] = np.diff(upto[np.searchsorted(pre_ends, ends) + 1] if len(ends) else ends, prepend=0)
        alone = [self.pattern.findall(data[offs[i]:offs[i + 1]].tobytes().decode("utf-8", "replace")) for i in np.flatnonzero(~plain).tolist()]
        others, n = self.pre_tokens([p for x in alone for p in x])
        upto = np.concatenate([[0], np.cumsum(n)])
        out_n[~plain] = np.diff(upto[np.cumsum([len(x) for x in alone], dtype=np.int64)], prepend=0)
        flat = np.zeros(int(out_n.sum()), np.uint32)
        mine = np.repeat(plain, out_n)
        flat[mine], flat[~mine] = ids, others
        return flat, out_n

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a null-free slice, where each text's begin and the end)."""
        data, offs = raw(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-2] = _CUT[data[1:-1]] & _solid_end(data)[:-2] & _SOLID_START[data[2:]]
        cut[offs] = True
        edges = np.flatnonzero(cut)
        column = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        flat, size = self.units(*raw(column.dictionary))
        codes = column.indices.to_numpy(zero_copy_only=False)
        ids, done = _gather(flat, np.cumsum(size) - size, size, codes)
        return ids, done[np.searchsorted(edges, offs)]

    def decode_ids(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the ids, where each id's begin and the end)."""
        return _gather(self.bytes, self.begin, self.size, ids)

    def encode(self, text: str) -> bytes:
        """One text's ids as little-endian unsigned 32-bit integers."""
        return self.encode_texts(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return self.decode_ids(np.frombuffer(ids, "<u4"))[0].tobytes()


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` that the codes name, one after the other, and their ends."""
    n = size[codes]
    done = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(done[-1]) + np.repeat(begin[codes] - done[:-1], n)], done


_CUTS = (0x20, 0x0A)
_CUT = np.zeros(256, bool)
_CUT[list(_CUTS)] = True
# bytes that begin a character which is surely no white space: visible ASCII, and U+00C0 to U+027F
_SOLID_START = np.zeros(256, bool)
_SOLID_START[0x21:0x7F] = True
_SOLID_START[0xC3:0xCA] = True


def _solid_end(data: np.ndarray) -> np.ndarray:
    """Where such a character ends."""
    out = np.zeros(len(data), bool)
    out |= (data >= 0x21) & (data < 0x7F)
    out[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xCA)
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each whole text as little-endian unsigned 32-bit integers.

    ``ranks_path`` is read on the driver; the vocabulary goes to the tasks, so
    what is sent is as large as that file, whatever the input.
    """
    ranks = read_ranks(ranks_path)
    table = docs.sparkSession.sparkContext.broadcast(PerfectHash.build(ranks).parts())
    name = ("codec", xxhash.xxh3_128_hexdigest(repr(ranks).encode()), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(name, lambda: BytePairCodec(PerfectHash(table.value), pattern))
        for batch in batches:
            for lo, texts in chunks(batch.column("text"), _SLICE):
                ids, at = codec.encode_texts(texts)
                out = [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, len(texts)), pa.array(out, pa.binary())], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(released(run), f"id {kind}, ids binary"))


def digests(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids: (id, n_tokens, ids_sha256, decoded_sha256)."""
    ranks = read_ranks(ranks_path)
    table = docs.sparkSession.sparkContext.broadcast(PerfectHash.build(ranks).parts())
    name = ("codec", xxhash.xxh3_128_hexdigest(repr(ranks).encode()), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(name, lambda: BytePairCodec(PerfectHash(table.value), pattern))
        for batch in batches:
            for lo, texts in chunks(batch.column("text"), _SLICE):
                ids, at = codec.encode_texts(texts)
                ids = ids.astype("<u4")
                data, ends = codec.decode_ids(ids)
                one = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                two = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[at[:-1]], ends[at[1:]], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, len(texts)), pa.array(np.diff(at)), pa.array(one, pa.string()), pa.array(two, pa.string())],
                                                 names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(released(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"))
