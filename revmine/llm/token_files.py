"""Token ids in a packed binary format.

Every id takes the fewest bits that hold the vocabulary.  A *token file* holds
the ids of consecutive documents, in blocks of ``BLOCK`` ids that start on a
byte; the table of block offsets lets a reader unpack any range of ids with a
few numpy operations and without touching other blocks.

Layout (little-endian)::

    magic "TIDS", u16 version, u16 bits, u32 ids a block, u32 0, u64 documents, u64 ids
    i64 document ids | u8 1 where the id is not null | u64 first id of each document, and the end
    u64 byte offset of each block in the payload, and the end | payload

Files are made in tasks and stored by Spark as one binary column, so they reach
any file system that Spark writes to and a lost executor costs its tasks alone;
``export_files`` copies them to plain ``.bin`` files in a mounted folder, for
``numpy.memmap``.  Documents are in ascending id order over all files.

Defined results: a null text is empty and has the end id alone; rows with a null
id come first; repeated ids are kept, ordered by a hash of the text; an empty
table gives no file.  Columns beside the named ones are never read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from revmine.llm.common import stored
from revmine.llm.words import SPACED, Words, chunks, coded, kept, raw

BLOCK = 16_384
SLICE = 4 << 20  # bytes of text in a file
_HEAD = "<4sHHIIQQ"
_CACHE = 600_000  # units that a worker keeps


def bits_for(vocabulary_size: int) -> int:
    """Fewest bits that hold ids below ``vocabulary_size``."""
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` as consecutive fields of ``bits`` bits, low bits first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(fields.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: np.ndarray, bits: int, first: int, n: int) -> np.ndarray:
    """Fields ``first`` to ``first + n`` of packed bytes (bits up to 56)."""
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    if not n:
        return np.zeros(0, np.uint32)
    lo = int(at[0] >> 3)
    part = np.concatenate([data[lo:int((at[-1] + bits + 7) >> 3)], np.zeros(8, np.uint8)])
    byte = (at >> 3) - lo
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word |= part[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (word >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def token_file(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """The bytes of one token file."""
    blocks = [pack(ids[i:i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join([
        struct.pack(_HEAD, b"TIDS", 1, bits, BLOCK, 0, len(doc_ids), len(ids)),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(), bytes(i is not None for i in doc_ids),
        starts.astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Random access to a token file: bytes, or a ``numpy.memmap`` of one."""

    def __init__(self, data: bytes | np.ndarray):
        self.data = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray, memoryview)) else data
        magic, version, self.bits, self.block, _, self.n_docs, self.n_ids = struct.unpack(_HEAD, self.data[:struct.calcsize(_HEAD)].tobytes())
        if magic != b"TIDS" or version != 1:
            raise ValueError("not a token file")
        at = struct.calcsize(_HEAD)
        self.doc_ids, at = self._take(at, "<i8", self.n_docs)
        self.valid, at = self._take(at, "u1", self.n_docs)
        self.starts, at = self._take(at, "<u8", self.n_docs + 1)
        self.offsets, at = self._take(at, "<u8", -(-self.n_ids // self.block) + 1)
        self.payload = self.data[at:]

    def _take(self, at: int, kind: str, n: int) -> tuple[np.ndarray, int]:
        end = at + np.dtype(kind).itemsize * n
        return np.frombuffer(self.data[at:end].tobytes(), kind), end

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids ``a`` to ``b`` of the file, reading only their blocks."""
        b = self.n_ids if b is None else b
        out = []
        while a < b:
            k = a // self.block
            end = min(b, (k + 1) * self.block)
            inside = self.payload[int(self.offsets[k]):int(self.offsets[k + 1])]
            out.append(unpack(inside, self.bits, a - k * self.block, end - a))
            a = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


_LETTER = np.zeros(256, bool)
_LETTER[ord("a"):ord("z") + 1] = _LETTER[ord("A"):ord("Z") + 1] = True
_MARK = np.array([0x21 <= b <= 0x7E and not chr(b).isalnum() for b in range(256)])


def units(texts: pa.Array) -> Words:
    """Stretches of a null-free slice whose ids do not depend on what is around them.

    For tokenizers that drop white space, fold case and never join an ASCII
    letter with an ASCII mark after it: texts are cut at ASCII white space and
    between such a letter and mark.  A-Z is folded here already, except before
    a non-ASCII character, which may be an accent that composes with the letter.
    """
    data, offs = raw(texts)
    plain_next = np.append(data[1:] < 0x80, True) if len(data) else np.zeros(0, bool)
    folded = np.where((data >= 65) & (data <= 90) & plain_next, data + 32, data).astype(np.uint8)
    cut = np.zeros(len(data), bool)
    cut[1:] = _LETTER[data[:-1]] & _MARK[data[1:]]
    return coded(folded, offs, SPACED.keep[data], cut)


class _Encoder:
    """Ids of texts.  With ``by_unit`` the tokenizer is asked once for each distinct
    unit while there is room; else for each text."""

    def __init__(self, tokenizer_json: str, end_id: int, by_unit: bool):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.end, self.by_unit = end_id, by_unit
        self.divider = self._lists(["\x01"])[0] if by_unit else []
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.size = np.array([self.end], np.uint32), np.ones(1, np.int64)  # the end id comes first

    def _lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Encode units many at a time, parted by a character that has an id of its own."""
        alone = [u for u in new if b"\x01" in u] if len(self.divider) == 1 else new
        rest = [u for u in new if b"\x01" not in u] if len(self.divider) == 1 else []
        parts, sizes = [self.flat], [self.size]
        for i in range(0, len(rest), 4000):
            some = rest[i:i + 4000]
            ids = np.array(self._lists([(b" \x01 ".join(some) + b" \x01").decode("utf-8", "replace")])[0], np.uint32)
            at = np.flatnonzero(ids == self.divider[0])
            if len(at) != len(some):
                raise ValueError("the tokenizer does not keep units apart; use by_unit=False")
            sizes.append(np.diff(at, prepend=-1) - 1)
            parts.append(np.delete(ids, at))
        for x in self._lists([u.decode("utf-8", "replace") for u in alone]):
            parts.append(np.array(x, np.uint32))
            sizes.append(np.array([len(x)]))
        self.place.update(zip(rest + alone, range(len(self.size), len(self.size) + len(new)), strict=True))
        self.flat, self.size = np.concatenate(parts), np.concatenate(sizes)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by the end id; starts, n texts + 1)."""
        if not self.by_unit:
            lists = [[*x, self.end] for x in self._lists(texts.to_pylist())]
            return np.array([i for x in lists for i in x], np.uint32), np.cumsum([0, *map(len, lists)])
        u = units(texts)
        if len(self.place) > _CACHE:
            self._forget()
        self._learn([v for v in u.vocabulary if v not in self.place])
        where = np.array([self.place[v] for v in u.vocabulary], np.int64)
        stream = np.insert(where[u.codes], u.first[1:], 0)
        begin = np.cumsum(self.size) - self.size
        n = self.size[stream]
        done = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(done[-1]) + np.repeat(begin[stream] - done[:-1], n)
        return self.flat[at], done[u.first + np.arange(len(u.first))]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, *, id_col: str = "doc_id",
                      text_col: str = "text", by_unit: bool = True) -> DataFrame:
    """Encode ``docs`` and store token files: (part, seq, n_docs, n_ids, image).

    ``tokenizer_path`` is read on the driver.  ``by_unit`` is for tokenizers of
    the kind that ``units`` names.  Files ordered by (part, seq) hold the
    documents in ascending id order.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id + 1)
    bits = bits_for(size)
    name = ("encoder", xxhash.xxh3_128_hexdigest(tokenizer_json.encode()), end_id, by_unit)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(name, lambda: _Encoder(tokenizer_json, end_id, by_unit))
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, texts in chunks(batch.column("text"), SLICE):
                ids, starts = encoder(texts)
                image = token_file(batch.column("id").slice(lo, len(texts)).to_pylist(), starts, ids, bits)
                yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(texts), "n_ids": len(ids), "image": image}],
                                                 schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())]))
                seq += 1

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
               .withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie"))
    return stored(ordered.select("id", "text").mapInArrow(encode, "part int, seq int, n_docs long, n_ids long, image binary"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: (doc_id, start, n_tokens, ids_crc32).

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over
    the ids as little-endian unsigned 32-bit integers.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "image")), strict=True):
                f = TokenFile(image)
                ids, starts = f.ids().astype("<u4"), f.starts.astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                n = f.n_docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(f.doc_ids, mask=f.valid == 0),
                     pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = files.select("part", "seq", "image").mapInArrow(read, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # first id of each file: running sums inside a part, and over the parts (one row for each range partition)
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        F.col("part").alias("_part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    bases = (files.select("part", "seq", "n_ids").withColumn("_before", before).join(parts, F.col("part") == F.col("_part"))
             .select(F.col("part").alias("_p"), F.col("seq").alias("_s"), (F.col("_before") + F.col("_base")).alias("_first")))
    return (rows.join(bases, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s")))
            .select("doc_id", (F.col("inside") + F.col("_first")).alias("start"), "n_tokens", "ids_crc32"))


def export_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each token file as ``part-seq.bin`` into a folder that all executors mount.

    A file appears under its name only when whole, so a repeated task does no harm.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for part, seq, image in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "image")), strict=True):
                path = os.path.join(folder, f"{part:06d}-{seq:06d}.bin")
                with open(f"{path}.{TaskContext.get().taskAttemptId()}", "wb") as f:
                    f.write(image)
                os.replace(f.name, path)
                names.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    os.makedirs(folder, exist_ok=True)
    return files.select("part", "seq", "image").mapInArrow(write, "path string")
