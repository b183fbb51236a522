"""URL filters over a sorted array of digests.

A list of entries (``host`` and the start of a path, like ``example.net/en/``)
is kept as a sorted array of 64-bit xxhash digests, which tasks memory-map and
probe with a vectorised binary search; the full string stored beside each
digest confirms a hit, so equal digests of different strings do no harm.

A url is probed with every entry it could match: each suffix of its host by
whole labels, with the first characters of its path in each length that some
entry has.  Rules (allow or block) win over the block list, the longest rule
over shorter ones (by the whole string, then by the host); without a rule the
verdict is block if the block list has an entry for it or it has no host,
else allow.

Index files are made once on the driver and handed out by
``SparkContext.addFile``: every executor, also one that joins later, gets its
own copy.  Lists beyond ``max_index_bytes``, rules or block list, are matched by
``judge_by_join`` instead, which broadcasts nothing.

Defined results: a null url and one without ``://`` have an empty host and
path, no rule, verdict block.  Repeated rows are judged alike; an entry listed
twice counts once, and as block if the verdicts differ.  An empty list matches
nothing.  Columns beside the named ones are never read.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class DigestIndex:
    """Where executors find an index, and the path lengths of its entries."""

    name: str
    lengths: tuple[int, ...]
    n: int

    def open(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.n:
            return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint8)
        return tuple(np.load(SparkFiles.get(f"{self.name}-{k}.npy"), mmap_mode="r") for k in ("keys", "ends", "strings"))


def path_length(entry: str) -> int:
    """Characters from the first ``/`` on."""
    return len(entry) - entry.find("/") if "/" in entry else 0


def build_index(spark: SparkSession, entries: Iterable[str], max_index_bytes: int = 256 << 20) -> DigestIndex:
    """Write the sorted digests and strings of ``entries`` and hand them out."""
    distinct = sorted({(xxhash.xxh3_64_intdigest(e.encode()), e) for e in entries})
    strings = [e.encode() for _, e in distinct]
    size = sum(map(len, strings)) + 16 * len(strings)
    if size > max_index_bytes:
        raise ValueError(f"an index of {size} bytes is larger than max_index_bytes; use judge_by_join")
    index = DigestIndex(f"digests-{uuid.uuid4().hex}", tuple(sorted({path_length(e) for _, e in distinct})), len(distinct))
    if distinct:
        folder = tempfile.mkdtemp(prefix="digests-")  # only the driver reads it: addFile sends copies, also to executors that join later
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        for kind, data in (("keys", np.array([d for d, _ in distinct], np.uint64)), ("ends", np.cumsum([0, *map(len, strings)])),
                           ("strings", np.frombuffer(b"".join(strings), np.uint8))):
            path = os.path.join(folder, f"{index.name}-{kind}.npy")
            np.save(path, data)
            spark.sparkContext.addFile(path)
    return index


def probe(index: tuple[np.ndarray, np.ndarray, np.ndarray], wanted: list[str]) -> np.ndarray:
    """Whether each string is an entry: binary search on digests, confirmed on the strings."""
    keys, ends, strings = index
    found = np.zeros(len(wanted), bool)
    if not len(keys) or not wanted:
        return found
    data = [w.encode() for w in wanted]
    digest = np.array([xxhash.xxh3_64_intdigest(d) for d in data], np.uint64)
    at = np.searchsorted(keys, digest)
    for i in np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == digest):
        k = int(at[i])
        while k < len(keys) and keys[k] == digest[i] and not found[i]:  # entries with equal digests lie side by side
            found[i] = strings[int(ends[k]):int(ends[k + 1])].tobytes() == data[i]
            k += 1
    return found


def suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    out = [host] if host else []
    while "." in host:
        host = host[host.index(".") + 1:]
        if host:
            out.append(host)
    return out


def _candidates(hosts: list[str], paths: list[str], lengths: tuple[int, ...]) -> tuple[np.ndarray, list[str]]:
    rows, keys = [], []
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        for s in suffixes(h):
            for n in lengths:
                if n <= len(p):
                    rows.append(i)
                    keys.append(s + p[:n])
    return np.array(rows, np.int64), keys


def _merged(rules: Iterable[tuple[str, str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    for entry, verdict in rules:
        out[entry] = "block" if "block" in (verdict, out.get(entry)) else verdict
    return out


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], blocked: Iterable[str] = (), *, id_col: str = "page_id",
          url_col: str = "url", max_index_bytes: int = 256 << 20) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    ``rules``: (entry, ``allow`` or ``block``); ``blocked``: entries of the block list.
    """
    spark = pages.sparkSession
    verdicts = _merged(rules)
    allow = build_index(spark, (r for r, v in verdicts.items() if v == "allow"), max_index_bytes)
    block = build_index(spark, (r for r, v in verdicts.items() if v == "block"), max_index_bytes)
    listed = build_index(spark, blocked, max_index_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [(x.open(), x.lengths) for x in (allow, block, listed)]
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            best: list[tuple[int, int, str, str] | None] = [None] * len(hosts)
            verdict = ["allow" if h else "block" for h in hosts]
            for (index, lengths), said in zip(opened, ("allow", "block", None), strict=True):
                rows, keys = _candidates(hosts, paths, lengths)
                for k in np.flatnonzero(probe(index, keys)):
                    i, entry = int(rows[k]), keys[k]
                    if said is None:
                        verdict[i] = "block"
                    elif best[i] is None or (len(entry), len(entry) - path_length(entry)) > best[i][:2]:
                        best[i] = (len(entry), len(entry) - path_length(entry), entry, said)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("host"), batch.column("path"), pa.array([b and b[2] for b in best], pa.string()),
                 pa.array([b[3] if b else v for b, v in zip(best, verdict, strict=True)], pa.string())],
                names=["id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col).cast("string")
    return (pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
            .mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string"))


def judge_by_join(pages: DataFrame, rules: DataFrame, blocked: DataFrame | None = None, *, id_col: str = "page_id",
                  url_col: str = "url") -> DataFrame:
    """``judge`` for tables of any size: candidate strings joined with the entries.

    ``rules``: (entry, verdict); ``blocked``: (entry) of the block list, used
    only where no rule fits.  Rows are told apart by their position, so
    repeated ids are fine.
    """
    entries = rules.select("entry", "verdict", F.lit(False).alias("listed"))
    if blocked is not None:
        entries = entries.unionByName(blocked.select("entry", F.lit(None).cast("string").alias("verdict"), F.lit(True).alias("listed")))
    entries = entries.groupBy("entry").agg(F.max("verdict").alias("rule_verdict"), F.bool_or("listed").alias("listed"))  # block is after allow
    cut = F.when(F.contains("entry", F.lit("/")), F.length("entry") - F.instr("entry", "/") + 1).otherwise(0)
    lengths = [r[0] for r in entries.select(cut.alias("n")).distinct().collect()]  # as many as a path has characters at most
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sizes = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    keys = urls.select("host", "path", F.explode(F.array_distinct(parents)).alias("suffix")).where("suffix <> ''").select(
        "host", "path", F.explode(F.filter(sizes, lambda n: n <= F.length("path"))).alias("n"), "suffix").select(
        "host", "path", F.concat("suffix", F.substring("path", F.lit(1), F.col("n"))).alias("entry"))
    size = F.when(F.col("rule_verdict").isNotNull(), F.struct(F.length("entry"), F.length("entry") - cut))  # max_by passes over nulls
    best = keys.join(entries, "entry").groupBy("host", "path").agg(
        F.max_by("entry", size).alias("rule"), F.max_by("rule_verdict", size).alias("rule_verdict"), F.bool_or("listed").alias("listed"))
    default = F.when((F.col("host") == "") | F.col("listed"), "block").otherwise("allow")
    return rows.join(best, ["host", "path"], "left").select("id", "host", "path", "rule", F.coalesce("rule_verdict", default).alias("verdict"))
