"""Benchmark decontamination over a positional inverted index.

The index is divided by documents: each *segment* holds the words of some
consecutive documents (about 4 MB of text) as term -> postings, a posting being
a word position.  Segments are built in tasks without any shuffle and stored in
the shared folder, in row groups of two or three segments, so that memory does
not grow with a task's share of the documents.  A phrase is looked up inside each segment: the postings of
its rarest term there, less the term's offset, are the candidate starts; the
offset-adjusted postings of the other terms, rarest first, are intersected with
them.  What is left are exact occurrences.  Proximity matches take the rarest
term's postings in the same way and ask for all other terms nearby.

Test items go to the tasks in blocks of ``block_bytes`` of text, so a broadcast
is bounded whatever the number of items; there is one pass over the index for
each block.

Words: A-Z lower-cased, maximal runs of ASCII digits, letters and non-ASCII
characters.  Defined results: a null or empty text has no words and no match; an
item of fewer than ``window`` words is one phrase, an item without words
matches nothing; items with a null id are left out, items that share an id are
one item; repeated documents are judged alike.  Without documents the result
is empty; without items nothing matches.  Other columns are never read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from revmine.llm.common import LONG_ROWS, free_name, if_small, scratch, stored
from revmine.llm.words import ALNUM_LOWER, chunks, released, words

WINDOW = 13
SLICE = 4 << 20  # bytes of text in a segment
#: candidate starts that a task looks at together
CANDIDATES = 1 << 18


def _planes(a: np.ndarray) -> bytes:
    """32-bit integers byte plane by byte plane (high planes are mostly 0, which Parquet's codec shrinks)."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the segments: (segment, ids, first, terms, counts, gaps).

    ``first``: position of each document's first word, and the end; ``terms``
    with ``counts`` postings each; ``gaps``: the postings term by term, each as
    its distance from the one before it (the first from 0).
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in chunks(batch.column("text"), SLICE):
                w = words(texts, ALNUM_LOWER)
                order = np.argsort(w.codes, kind="stable")
                counts = np.bincount(w.codes, minlength=len(w.vocabulary))
                gaps = np.diff(order, prepend=0)
                begin = (np.cumsum(counts) - counts)
                gaps[begin] = order[begin]
                yield pa.RecordBatch.from_arrays(
                    [_one(batch.column("id").slice(lo, len(texts))), _one(pa.array(w.first)), _one(pa.array(w.vocabulary, pa.binary())),
                     _one(pa.array(counts.astype(np.int32))), pa.array([_planes(gaps)], pa.binary())],
                    names=["ids", "first", "terms", "counts", "gaps"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(released(build), f"ids array<{kind}>, first array<long>, terms array<binary>, counts array<int>, gaps binary"))
    return stored(rows.withColumn("segment", F.monotonically_increasing_id()), "phrase-index", **LONG_ROWS)


def _one(values: pa.Array) -> pa.ListArray:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class _Segment:
    """A segment's postings, with its own codes for the terms of a query."""

    def __init__(self, row: dict):
        self.first = np.asarray(row["first"], np.int64)
        self.terms = pa.array(row["terms"], pa.binary())
        self.counts = np.asarray(row["counts"], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])
        gaps = _unplanes(row["gaps"])
        total = np.cumsum(gaps)
        ahead = np.repeat(total[self.begin[:-1]] - gaps[self.begin[:-1]], self.counts) if len(gaps) else 0
        self.postings = total - ahead
        self.n = len(self.postings)
        # (term, position) in ascending order, for membership by binary search
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * (self.n + 1) + self.postings
        self.document = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def codes(self, vocabulary: pa.Array) -> np.ndarray:
        found = pc.index_in(vocabulary, value_set=self.terms)
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * (self.n + 1) + position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key

    def phrases(self, q: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index into ``at``, start) of all occurrences of the phrases q[at:at + length]."""
        if not self.n or not len(at):
            return
        absent = np.concatenate([[0], np.cumsum(q < 0)])
        use = np.flatnonzero(absent[at + length] == absent[at])
        if not len(use):
            return
        spans = q[at[use][:, None] + np.arange(length)]
        order = np.argsort(self.counts[spans], axis=1, kind="stable")  # rarest term first
        rare = order[:, 0]
        term = spans[np.arange(len(use)), rare]
        upto = np.cumsum(self.counts[term])
        lo = 0
        while lo < len(use):
            done = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, done + CANDIDATES, side="right")))
            n = self.counts[term[lo:hi]]
            which = np.repeat(np.arange(lo, hi), n)
            pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[term[lo:hi]], n)
            start = self.postings[pick] - rare[which]
            ok = (start >= 0) & (start + length <= self.n)
            which, start = which[ok], start[ok]
            ok = self.document[start] == self.document[start + length - 1]
            which, start = which[ok], start[ok]
            for k in range(1, length):
                if not len(which):
                    break
                o = order[which, k]
                ok = self.has(spans[which, o], start + o)
                which, start = which[ok], start[ok]
            yield use[which], start
            lo = hi


class Items:
    """The words of a block of test items and where their phrases begin."""

    def __init__(self, ids: list, texts: list[str], window: int):
        w = words(pa.array(texts, pa.string()), ALNUM_LOWER)
        self.ids, self.vocabulary, self.codes, self.first, self.window = ids, w.vocabulary, w.codes.astype(np.int64), w.first, window

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, items) of all phrases of one length."""
        n = np.diff(self.first)
        long = np.flatnonzero(n >= self.window)
        m = n[long] - self.window + 1
        starts = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.first[long], m)
        yield self.window, starts, np.repeat(long, m)
        for length in range(1, self.window):
            short = np.flatnonzero(n == length)
            if len(short):
                yield length, self.first[short], short


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of all items in blocks of about ``block_bytes`` of text, one block at a time on the driver.

    The items are dealt to blocks and written once, a folder for each block; a
    single item longer than ``block_bytes`` is a block of its own size.
    """
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).distinct()
    rows = stored(rows.withColumn("size", F.octet_length("text").cast("long")), "items")
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = -(-total // block_bytes)
    path = scratch(items.sparkSession, "item-blocks")
    if n:
        rows.select("id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(n)).alias("block")).write.partitionBy("block").parquet(path)
        dealt = items.sparkSession.read.schema(rows.select("id", "text", F.lit(0).cast("long").alias("block")).schema).parquet(path)
    for k in range(n):
        got = dealt.where(F.col("block") == k).select("id", "text").toArrow()
        order = sorted(zip(got.column("id").to_pylist(), got.column("text").to_pylist(), strict=True))
        if order:
            yield [i for i, _ in order], [t for _, t in order]


def phrase_matches(index: DataFrame, items: DataFrame, *, item_id: str = "item_id", item_text: str = "text",
                   window: int = WINDOW, block_bytes: int = 4 << 20) -> DataFrame:
    """Exact occurrences of the items' phrases: (segment, ordinal, item, begin, end).

    ``ordinal``: the document's place in its segment; ``begin`` and ``end``:
    words of the document, overlapping occurrences of one item joined.
    """
    spark = index.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    schema = f"segment long, ordinal int, item {kind}, begin int, end int"
    return _by_blocks(index, items, item_id, item_text, block_bytes, lambda sent: _phrase_task(sent, window), schema)


def _by_blocks(index: DataFrame, items: DataFrame, item_id: str, item_text: str, block_bytes: int, task, schema: str) -> DataFrame:
    """Matches of all blocks, each stored before the next one is read; one block (about ``block_bytes``) is broadcast at a time."""
    spark = index.sparkSession
    parts = []
    for block in item_blocks(items, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(block)
        parts.append(stored(index.mapInArrow(released(task(sent)), schema), "matches"))
        sent.destroy()
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _phrase_task(sent, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(*sent.value, window)
        vocabulary = pa.array(block.vocabulary, pa.binary())
        for batch in batches:
            for row in _rows(batch):
                seg = _Segment(row)
                q = seg.codes(vocabulary)[block.codes] if len(block.codes) and seg.n else np.full(len(block.codes), -1)
                found = []
                for length, at, item in block.phrases():
                    for which, start in seg.phrases(q, at, length):
                        found.append(np.stack([seg.document[start], item[which], start, start + length]))
                hits = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
                hits = hits[:, np.lexsort((hits[2], hits[1], hits[0]))]
                doc, item, begin, end = _joined(*hits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), row["segment"])), pa.array(doc.astype(np.int32)), pa.array([block.ids[i] for i in item.tolist()]).cast(_kind(block.ids)),
                     pa.array((begin - seg.first[doc]).astype(np.int32)), pa.array((end - seg.first[doc]).astype(np.int32))],
                    names=["segment", "ordinal", "item", "begin", "end"])
    return run


def _kind(ids: list) -> pa.DataType:
    return pa.array(ids).type


def _joined(doc: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join overlapping spans of one document and item (sorted; of an item all phrases have one length or few)."""
    if not len(doc):
        return doc, item, begin, end
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])
    at = np.flatnonzero(new)
    return doc[at], item[at], begin[at], np.maximum.reduceat(end, at)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: (v.values if isinstance(v := batch.column(name)[i], pa.ListScalar) else v.as_py()) for name in batch.schema.names}


def proximity_matches(index: DataFrame, items: DataFrame, *, span: int, item_id: str = "item_id", item_text: str = "text",
                      block_bytes: int = 4 << 20) -> DataFrame:
    """Places where all distinct words of an item lie, in any order, inside ``span`` words.

    (segment, ordinal, item, begin, end): the shortest such stretch around each
    occurrence of the item's rarest word in the segment, once.  Null ids and
    texts, items without words and an index without rows match nothing.
    """
    kind = items.schema[item_id].dataType.simpleString()
    schema = f"segment long, ordinal int, item {kind}, begin int, end int"
    return _by_blocks(index, items, item_id, item_text, block_bytes, lambda sent: _proximity_task(sent, span), schema)


def _near(x: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Entries of ``x`` less than ``span`` from one of ``at`` (both sorted)."""
    lo, hi = np.searchsorted(x, at - span + 1), np.searchsorted(x, at + span)
    if int((hi - lo).sum()) >= len(x):
        return x[np.searchsorted(at, x - span + 1) < np.searchsorted(at, x + span)]
    lo = np.maximum(lo, np.concatenate([[0], hi[:-1]]))  # stretches that overlap are taken once
    n = np.maximum(hi - lo, 0)
    return x[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)]


def _stretches(lists: list[np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Shortest stretches with an entry of each list around each entry of the first, as (begin, end), once each.

    One pass over the merged postings: from each posting on, the stretch that
    ends where every word has come; the shortest through a place is then a
    minimum over the postings up to ``span`` before it.
    """
    at = lists[0]
    for x in lists[1:]:  # some occurrence near enough, rarest terms first
        at = at[np.searchsorted(x, at - span + 1) < np.searchsorted(x, at + span)]
    if not len(at):
        return at, at
    lists = [at] + [_near(x, at, span) for x in lists[1:]]
    begin = np.unique(np.concatenate(lists))
    far = np.iinfo(np.int64).max // 4
    end = begin.copy()
    for x in lists:
        end = np.maximum(end, np.append(x, far)[np.searchsorted(x, begin)])
    # a place with all begins below it whose stretch ends before it: the last of them, stretched to the place
    here = np.searchsorted(begin, at)
    done = np.searchsorted(end, at, side="right") - 1
    low, high = np.minimum(done, here), here
    best_begin, best_end = begin[np.maximum(low, 0)], at.copy()
    best = np.where(low >= 0, at - best_begin, far)
    # or a begin after that and up to the place: the least length, of equal ones the last begin
    length = end - begin
    n, level = high - np.maximum(done, -1), 0
    table = np.arange(len(begin))
    left = np.maximum(done, -1) + 1
    pick = np.full(len(at), -1)
    while n.max(initial=0) >> level:
        use = np.flatnonzero((n > 0) & (np.frexp(n.astype(np.float64))[1] - 1 == level))
        if len(use):
            pick[use] = _least(length, table[left[use]], table[high[use] - (1 << level) + 1])
        step = 1 << level
        if len(table) > step:
            table = _least(length, table[:-step], table[step:])
        level += 1
    other = pick >= 0
    shorter = other & (np.where(other, length[pick], far) <= best)  # the later begin among equals
    best_begin = np.where(shorter, begin[pick], best_begin)
    best_end = np.where(shorter, end[pick], best_end)
    ok = (best_end - best_begin < span) & (best_end < far)
    both = np.unique(np.stack([best_begin[ok], best_end[ok]]), axis=1)
    return both[0], both[1] + 1


def _least(length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two places each the one with the lesser length, b among equals (b lies behind a)."""
    return np.where(length[b] <= length[a], b, a)


def _proximity_task(sent, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(*sent.value, 1)
        vocabulary = pa.array(block.vocabulary, pa.binary())
        for batch in batches:
            for row in _rows(batch):
                seg = _Segment(row)
                local = seg.codes(vocabulary) if len(vocabulary) and seg.n else np.full(len(vocabulary), -1)
                out = []
                for i, (a, b) in enumerate(zip(block.first[:-1], block.first[1:], strict=True)):
                    terms = np.unique(local[block.codes[a:b]])
                    if not len(terms) or terms[0] < 0:
                        continue
                    terms = terms[np.argsort(seg.counts[terms], kind="stable")]
                    # documents lie ``span`` apart here, so that no stretch reaches over an end
                    lists = [(x := seg.postings[seg.begin[t]:seg.begin[t + 1]]) + seg.document[x].astype(np.int64) * span for t in terms]
                    begin, end = _stretches(lists, span)
                    if len(begin):
                        starts = seg.first[:-1] + np.arange(len(seg.first) - 1, dtype=np.int64) * span
                        d = np.searchsorted(starts, begin, side="right") - 1
                        out += [(row["segment"], int(k), block.ids[i], int(lo), int(hi)) for k, lo, hi in zip(d, begin - starts[d], end - starts[d], strict=True)]
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), _kind(block.ids), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["segment", "ordinal", "item", "begin", "end"])
    return run


def documents_of(index: DataFrame) -> DataFrame:
    """(segment, ordinal, doc_id, n_words) of every document in the index."""
    sizes = F.transform(F.sequence(F.lit(1), F.size("ids")), lambda i: F.element_at("first", i + 1) - F.element_at("first", i))
    rows = F.arrays_zip(F.col("ids").alias("id"), sizes.alias("n"))
    return index.select("segment", F.posexplode(rows).alias("ordinal", "d")).select(
        "segment", "ordinal", F.col("d.id").alias("doc_id"), F.col("d.n").alias("n_words"))


def proximity_counts(index: DataFrame, matches: DataFrame) -> DataFrame:
    """Per document: (doc_id, n_words, n_near_items), the items with a proximity match in it.

    Unlike the stretches, which go by the rarest word of a segment, the items do
    not depend on how documents are dealt to segments.
    """
    per_doc = matches.groupBy("segment", "ordinal").agg(F.count_distinct("item").alias("near"))
    rows = documents_of(index).join(per_doc, ["segment", "ordinal"], "left")
    return rows.select("doc_id", "n_words", F.coalesce("near", F.lit(0).cast("long")).alias("n_near_items"))


def verdicts(index: DataFrame, matches: DataFrame, min_share: int = 20) -> DataFrame:
    """Per document: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    ``n_hit`` counts words inside any occurrence; contaminated: n_hit > 0 and
    ``min_share * n_hit >= n_words``.
    """
    spans = F.array_sort(F.collect_list(F.struct("begin", "end")))  # of one document
    per_doc = matches.groupBy("segment", "ordinal").agg(
        spans.alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("reach"))
    covered = F.aggregate("spans", start, lambda acc, s: F.struct(
        (acc["hit"] + F.greatest(s["end"] - F.greatest(s["begin"], acc["reach"]), F.lit(0))).alias("hit"),
        F.greatest(acc["reach"], s["end"]).alias("reach")), lambda acc: acc["hit"])
    hit = per_doc.select("segment", "ordinal", covered.alias("hit"), F.size("items").cast("long").alias("items_n"),
                         F.sha2(F.array_join("items", ","), 256).alias("sha"))
    none = F.sha2(F.lit(""), 256)
    rows = documents_of(index).join(hit, ["segment", "ordinal"], "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items_n", F.lit(0).cast("long")).alias("n_items"),
                       F.coalesce("sha", none).alias("items_sha256"), ((n_hit > 0) & (min_share * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", nulls_apart: bool = False) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, columns unchanged; an id with a contaminated row goes whole.

    With ``nulls_apart`` a null id names no document: each row with one is
    judged by its own text, as ``near_dup.deduplicate`` keeps such rows apart.
    """
    # a row's own text, for rows that no id names
    own = F.when(docs[id_col].isNull(), F.sha2(docs[text_col].cast("string").cast("binary"), 256)) if nulls_apart else F.lit(None).cast("string")
    keyed = docs.select(F.struct(docs[id_col].alias("id"), own.alias("own")).alias("key"), docs[text_col].alias("text"))
    index = build_index(keyed, id_col="key", text_col="text")
    found = verdicts(index, phrase_matches(index, items, item_id=item_id, item_text=item_text))
    bad = found.where("contaminated").select(F.col("doc_id.id").alias(bad_id := free_name(docs, "_bad_id")), F.col("doc_id.own").alias(bad_own := free_name(docs, "_bad_own"))).distinct()
    out = if_small(stored(bad, "contaminated"))
    return docs.join(out, docs[id_col].eqNullSafe(out[bad_id]) & own.eqNullSafe(out[bad_own]), "left_anti")
