"""Vectorised words of a batch of texts (numpy and Arrow, inside Spark tasks).

A text's words are its maximal runs of *word bytes*.  Every separator of the
classes used here is ASCII, so working on UTF-8 bytes never splits a
character.  All functions take any Arrow string array; null is the empty text.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa

#: work arrays are a small multiple of this many bytes of text (one text at least)
CHUNK_BYTES = 1 << 20


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """An object that this Python worker keeps from task to task, made when first asked for.

    Functions travel to workers by value, so module globals do not last; a
    module object of its own does.
    """
    home = sys.modules.setdefault("_revmine_llm_kept", types.ModuleType("_revmine_llm_kept"))
    if key not in home.__dict__.setdefault("objects", {}):
        home.objects.clear()  # one vocabulary at a time
        home.objects[key] = make()
    return home.objects[key]


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; after a task its worker, which stays for other work, returns free memory to the system."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
    return task


@dataclass(frozen=True)
class WordClass:
    """keep[b]: byte b belongs to a word; fold[b]: the byte it counts as."""

    keep: np.ndarray
    fold: np.ndarray


def word_class(separators: list[tuple[int, int]], lower: bool) -> WordClass:
    """Words are runs of bytes outside ``separators`` (inclusive ranges); ``lower`` folds A-Z."""
    keep = np.ones(256, bool)
    for a, b in separators:
        keep[a:b + 1] = False
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        keep[ord("A"):ord("Z") + 1] = True  # classes are stated on the folded text
        fold[ord("A"):ord("Z") + 1] += 32
    return WordClass(keep, fold)


#: [^\x20\x09-\x0D]+
SPACED = word_class([(0x20, 0x20), (0x09, 0x0D)], lower=False)
SPACED_LOWER = word_class([(0x20, 0x20), (0x09, 0x0D)], lower=True)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after folding A-Z
ALNUM_LOWER = word_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], lower=True)


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of consecutive rows with about ``size`` bytes of text each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n, lo = len(texts), 0
    ends = _offsets(texts)[1:]
    while lo < n:
        begin = int(ends[lo - 1]) if lo else int(_offsets(texts)[0])
        hi = max(lo + 1, int(np.searchsorted(ends, begin + size, side="right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a slice, and where each text starts in them (n + 1 entries)."""
    offs = _offsets(texts).astype(np.int64)
    buf = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buf, np.uint8)[offs[0]:offs[-1]] if buf is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


@dataclass(frozen=True)
class Words:
    codes: np.ndarray        # int32, one per word, indexes ``vocabulary``
    first: np.ndarray        # int64, n texts + 1: where each text's words start
    vocabulary: list[bytes]  # distinct words

    def __len__(self) -> int:
        return len(self.codes)


def words(texts: pa.Array, cls: WordClass) -> Words:
    """The words of a null-free slice as codes into the slice's own vocabulary (exact)."""
    data, offs = raw(texts)
    return coded(cls.fold[data], offs, cls.keep[data])


def coded(data: np.ndarray, offs: np.ndarray, inside: np.ndarray, cut: np.ndarray | None = None) -> Words:
    """Words of bytes: maximal runs of ``inside``, also begun at each ``cut`` and at each text's start."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if cut is not None:
        begins |= cut & inside
    at = offs[:-1][offs[:-1] < len(data)]
    begins[at] = inside[at]
    first = np.searchsorted(np.flatnonzero(begins), offs).astype(np.int64)
    compact = data[inside]
    edges = np.append(np.flatnonzero(begins[inside]), len(compact)).astype(np.int32)
    n = len(edges) - 1
    if not n:
        return Words(np.zeros(0, np.int32), first, [])
    column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(compact)])
    found = column.dictionary_encode()
    return Words(found.indices.to_numpy(zero_copy_only=False).astype(np.int32), first, found.dictionary.to_pylist())
