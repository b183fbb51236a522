"""Importance resampling towards a target, with hashed n-gram features.

A text's features are its words and its pairs of adjacent words joined by one
space; a feature's bucket is the CRC-32 of its bytes modulo the number of
buckets.  An Aho-Corasick automaton over words between two delimiters carries
each word's CRC and length; one scan of a slice of texts emits these payloads in
word order, and the CRC of a pair is composed of two adjacent payloads (CRC-32
is linear: ``crc(a b) = shift(crc(a + " "), len(b)) ^ crc(b)``), so no pair is
ever spelled out.  The dictionary holds the target's words and the commonest
words of a sample of the documents, ``max_words`` at most; a word outside it
shows as a delimiter without a payload, and its CRC is taken from its bytes, so
the dictionary's size changes the speed and never a result.

Buckets are worked out once and stored (two bytes a feature).  Counts over all
texts are summed in tasks before they are shuffled, at most ``n_buckets`` rows
a task; the driver and each task see one table of ``n_buckets`` gains.  Gumbel
noise from a hash of the id makes the highest scores a draw without
replacement; ranks are counted in range slices, no task sorts all scores.

Defined results: null and empty texts have no words, weight 0 and are never
drawn; a row with a null id takes the hash of the empty id; rows with one id
are scored by their own text and ranked in any order among equal scores; very
long texts take linear time.  Without documents the result is empty; without a
target all its counts are 0.  Columns beside the named ones are never read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from revmine.llm.common import stored
from revmine.llm.words import ALNUM_LOWER, chunks, kept, raw, released
from revmine.operators.ranks import position_in_group

N_BUCKETS = 10_000
#: words of the dictionary, at most
MAX_WORDS = 50_000
#: documents that the dictionary's common words are taken from, the first by a hash of the id
SAMPLE_DOCS = 2_000
SLICE = 2 << 20


def _tables() -> np.ndarray:
    """tables[n, k, v]: what byte k with value v of a CRC becomes after n zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    out = np.zeros((_DIRECT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _DIRECT + 1):
        out[n] = one[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


_DIRECT = 64
_SHIFT = _tables()


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs after ``n`` zero bytes each, without the register's initial and final inversion."""
    out = crc.astype(np.uint32)
    left = n.copy()
    while True:
        k = np.minimum(left, _DIRECT)
        out = _SHIFT[k, 0, out & 255] ^ _SHIFT[k, 1, (out >> 8) & 255] ^ _SHIFT[k, 2, (out >> 16) & 255] ^ _SHIFT[k, 3, out >> 24]
        left = left - k
        if not left.any():
            return out
        if left.max() > 64 * _DIRECT:  # very long words: by the powers of two of their length
            return _shift_far(out, left)


def _shift_far(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    table, k, out = _SHIFT[1], 0, crc.copy()
    while (n >> k).any():
        use = (n >> k) & 1 == 1
        out[use] = _applied(table, out[use])
        table = _applied(table, table)  # twice as many zero bytes
        k += 1
    return out


def _applied(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0, crc & 255] ^ table[1, (crc >> 8) & 255] ^ table[2, (crc >> 16) & 255] ^ table[3, crc >> 24]


_SPACE = zlib.crc32(b" ")


class Dictionary:
    """Automaton over words between delimiters; a payload is length << 32 | CRC."""

    def __init__(self, words: list[bytes]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for w in words:
            self.automaton.add_word(f" {w.decode('latin-1')} ", len(w) << 32 | zlib.crc32(w))
        self.empty = not words
        if words:
            self.automaton.make_automaton()

    def payloads(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(CRC, length, first): of every word of a null-free slice, and where each text's words begin."""
        data, offs = raw(texts)
        inside = ALNUM_LOWER.keep[data]
        line = np.where(inside, ALNUM_LOWER.fold[data], np.uint8(0x20))
        # one delimiter more before each text and after the last
        line = np.insert(line, offs, np.uint8(0x20))
        word = line != 0x20
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.searchsorted(begin, offs + np.arange(len(offs)))
        spelled = line.tobytes()
        got = np.zeros((0, 2), np.int64)
        if not self.empty:
            scan = self.automaton.iter(spelled.decode("latin-1"))
            got = np.fromiter(itertools.chain.from_iterable(scan), np.int64).reshape(-1, 2)
        payload = np.full(len(begin), -1, np.int64)
        payload[np.searchsorted(end, got[:, 0])] = got[:, 1]  # a match ends at the delimiter behind its word
        for i in np.flatnonzero(payload < 0).tolist():
            w = spelled[begin[i]:end[i]]
            payload[i] = len(w) << 32 | zlib.crc32(w)
        return (payload & 0xFFFFFFFF).astype(np.uint32), payload >> 32, first

    def features(self, texts: pa.Array, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets of all features, where each text's begin and the end, words in each text)."""
        crc, length, first = self.payloads(texts)
        n = np.diff(first)
        both = np.zeros((len(crc), 2), np.int64)
        both[:, 0] = crc % np.uint32(n_buckets) if n_buckets < 1 << 32 else crc
        head = shift(crc, np.ones(len(crc), np.int64)) ^ np.uint32(_SPACE)
        both[:-1, 1] = (shift(head[:-1], length[1:]) ^ crc[1:]) % np.uint32(n_buckets)
        use = np.ones((len(crc), 2), bool)
        use[first[1:][n > 0] - 1, 1] = False  # no pair reaches over a text's end
        at = np.concatenate([[0], np.cumsum(np.maximum(2 * n - 1, 0))])
        return both[use], at, n


def dictionary(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text: str, max_words: int, sample_docs: int) -> list[bytes]:
    """Distinct words of the target, then the commonest of a sample of the documents, ``max_words`` at most."""
    def words_of(df: DataFrame, col: str) -> DataFrame:
        lower = F.translate(F.col(col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        w = df.select(F.explode(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))).alias("w"))
        return w.groupBy("w").agg(F.count("*").alias("n"))

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).where(F.col("_id").isNotNull())
    chosen = rows.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    sample = rows.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("t").alias("t"))  # sample_docs ids
    counted = words_of(sample, "t").select("w", "n", F.lit(1).alias("side")).unionByName(words_of(target, target_text).select("w", "n", F.lit(0).alias("side")))
    rows = (counted.where(F.octet_length("w") <= 64).groupBy("w").agg(F.min("side").alias("side"), F.sum("n").alias("n"))
            .orderBy("side", F.desc("n"), "w").limit(max_words).select("w").collect())
    return [r["w"].encode() for r in rows]


def buckets(df: DataFrame, words: list[bytes], *, id_col: str | None, text_col: str, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets) of every row; ``buckets``: unsigned integers of 2 bytes (4 beyond 65,536 buckets)."""
    if not 0 < n_buckets < 1 << 31:
        raise ValueError("n_buckets is out of range")
    sent = df.sparkSession.sparkContext.broadcast(words)  # max_words words of at most 64 bytes
    name = ("crc dictionary", xxhash.xxh3_128_hexdigest(b" ".join(words)))
    size = _bytes_of(n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = kept(name, lambda: Dictionary(sent.value))
        for batch in batches:
            for lo, texts in chunks(batch.column("text"), SLICE):
                flat, at, n = found.features(texts, n_buckets)
                packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((at * np.dtype(size).itemsize).astype(np.int32)), pa.py_buffer(flat.astype(size))])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, len(texts)), pa.array(n), pa.array(np.diff(at)), packed],
                                                 names=["id", "n_words", "n_features", "buckets"])

    ident = F.col(id_col) if id_col else F.lit(None).cast("long")
    rows = df.select(ident.alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, buckets binary")


def _bytes_of(n_buckets: int) -> str:
    return "<u2" if n_buckets <= 1 << 16 else "<u4"


def _flat(column: pa.Array, size: str) -> tuple[np.ndarray, np.ndarray]:
    """(all buckets of a batch, where each row's begin and the end)."""
    data, offs = raw(column)
    return np.frombuffer(data.tobytes(), size), offs // np.dtype(size).itemsize


def totals(found: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(bucket, n): features in each bucket over all rows; a task adds up its own before they are shuffled."""
    size = _bytes_of(n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(n_buckets, np.int64)
        for batch in batches:
            count += np.bincount(_flat(batch.column("buckets"), size)[0], minlength=n_buckets)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(released(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket, B of them; ``n_buckets`` rows reach the driver."""
    spark = source.sparkSession
    both = (spark.range(n_buckets).withColumnRenamed("id", "bucket")
            .join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
            .select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    got = both.toArrow()
    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    s[got["bucket"].to_numpy()], t[got["bucket"].to_numpy()] = got["s"].to_numpy(), got["t"].to_numpy()
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n_buckets) / ((s + 1) * (t.sum() + n_buckets)))).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of a row's features, 0 without any."""
    sent = found.sparkSession.sparkContext.broadcast(gain)
    size = _bytes_of(n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _flat(batch.column("buckets"), size)
            upto = np.concatenate([[0], np.cumsum(sent.value[flat])])
            n = np.diff(at)
            weight = np.where(n > 0, (upto[at[1:]] - upto[at[:-1]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_words", "n_features")), pa.array(weight)],
                                             names=["id", "n_words", "n_features", "weight"])

    schema = f"id {found.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long"
    return found.mapInArrow(released(run), schema)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             n_buckets: int = N_BUCKETS, percent: int = 25, min_words: int = 20, seed: int = 7,
             max_words: int = MAX_WORDS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document.

    Of the N documents with at least ``min_words`` words the floor(percent * N /
    100) highest scores are drawn and ranked from 1, ties to the smaller id;
    others have no rank.
    """
    words = dictionary(docs, target, id_col, text_col, target_text, max_words, sample_docs)
    found = stored(buckets(docs, words, id_col=id_col, text_col=text_col, n_buckets=n_buckets), "features")
    wanted = buckets(target, words, id_col=None, text_col=target_text, n_buckets=n_buckets)
    gain = gains(totals(found, n_buckets), totals(wanted, n_buckets), n_buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = stored(weights(found, gain, n_buckets).withColumn("score", F.col("weight") + noise), "scores")
    able = scored.where(F.col("n_words") >= min_words)
    n_drawn = percent * able.count() // 100
    placed = position_in_group(able, [], [F.desc("score"), F.asc("id")], out="rank")
    rank = F.when(F.col("rank") <= n_drawn, F.col("rank")).cast(LongType())
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).unionByName(rest)
