"""MinHash near-dedup: one-permutation hashing, banded buckets, star edges.

A document's set holds its distinct 5-word shingles (64-bit hashes).  One hash
of each shingle serves all ``BANDS * ROWS`` bins: its high bits choose the bin,
the least hash of a bin is the bin's value, and an empty bin copies the value
of a full bin drawn at random in an order that depends on the bin alone
(optimal densification).  ``ROWS`` bins make a band, equal bands a bucket.

Documents with equal sets form one class; only classes are compared.  In a
bucket, edges run from members to hubs and not between all pairs:

1. every class proposes one edge, to the least hub over its buckets; edges are
   confirmed on the full sets, and confirmed ones make the first components;
2. in a bucket that still holds several components, the classes outside its
   largest component are hubs for members of other components, if they are
   ``HUBS`` at most;
3. the members of the remaining buckets (texts around a passage that many
   share) are dealt into finer buckets by the rarest quarter of their shingles,
   which no similar pair escapes, and there up to ``ROUND_HUBS`` such classes a round
   are hubs, until no bucket holds two components.

So each pair in a bucket is compared or already connected, and a group of n
copies costs about n edges.  A pair of similarity 0.75 shares no bucket with
probability 1e-4 (0.8: 5e-7); pairs below 0.75 are never linked.

Words: A-Z lower-cased, runs without ASCII white space; texts of fewer words
than a shingle have the whole sequence as their one element.  Defined results:
null and empty texts and those without words have an empty set and are linked
with nothing; a row with a null id is linked with nothing and has a null
component; rows that share an id are one document, linked through any of their
texts; an empty table gives an empty result.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from revmine.llm.common import free_name, if_small, stored
from revmine.llm.words import SPACED_LOWER, chunks, released, words

SHINGLE = 5
BANDS, ROWS = 48, 6
HUBS = 16           # more classes outside the largest component make a bucket crowded
ROUND_HUBS = 1024   # of a fine bucket in one round
SAMPLE_SHINGLES = 1 << 20  # of the sample that orders shingles, 16 bytes each; any order gives the same links
MIN_PERCENT = 75  # 100 * intersection >= MIN_PERCENT * union

_ODD = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a null-free slice."""
    w = words(texts, SPACED_LOWER)
    known = np.array([xxhash.xxh3_64_intdigest(v) for v in w.vocabulary], np.uint64)
    seq = known[w.codes] if len(w) else np.zeros(0, np.uint64)
    m = len(seq) - SHINGLE + 1
    if m > 0:
        full = np.full(m, SHINGLE, np.uint64)
        for k in range(SHINGLE):
            full = (full + seq[k:k + m]) * _ODD[k]
            full ^= full >> np.uint64(31)
        full = _mix(full)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(full[a:b - SHINGLE + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for k in range(a, b):
                h = _mix((h + seq[k:k + 1]) * _ODD[k - a])[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def orders_of(bins: int) -> np.ndarray:
    """For each bin, the random order in which it asks the other bins for a value."""
    return np.random.default_rng(5).permuted(np.tile(np.arange(bins, dtype=np.uint16), (bins, 1)), axis=1)


def signature(hashes: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """One-permutation MinHash with optimal densification of a sorted, non-empty set."""
    bins = len(orders)
    bin_of = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)  # ascending with the hash
    first = np.flatnonzero(np.diff(bin_of, prepend=-1))
    values = np.zeros(bins, np.uint64)
    full = bin_of[first]
    values[full] = hashes[first]
    if len(full) < bins:
        empty = np.ones(bins, bool)
        empty[full] = False
        at = np.flatnonzero(empty)
        values[at] = values[full[orders[np.ix_(at, full)].argmin(axis=1)]]
    return values


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, different for equal values in different bands."""
    v = values.reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64) * _ODD[40]
    for k in range(rows):
        h = _mix((h ^ v[:, k]) * _ODD[41 + k])
    return h.view(np.int64)


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, key, bands) of every row; ``key`` names the set, null for an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = orders_of(bands * rows)
        for batch in batches:
            for lo, texts in chunks(batch.column("text")):
                sets = shingle_sets(texts)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                found = [band_keys(signature(s, orders), bands, rows) if len(s) else np.zeros(0, np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))], names=["id", "n_shingles", "key", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(released(run), f"id {kind}, n_shingles long, key binary, bands array<long>"))


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = MIN_PERCENT) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; ``texts``: (rep, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, left in chunks(batch.column("text_a"), 1 << 20):
                part = batch.slice(lo, len(left))
                right = part.column("text_b").dictionary_encode()  # hubs come often
                right = right.combine_chunks() if isinstance(right, pa.ChunkedArray) else right
                a, b = shingle_sets(left), shingle_sets(right.dictionary)
                ok = []
                for x, k in zip(a, right.indices.to_pylist(), strict=True):
                    y = b[k]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    one, two = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(released(run), f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): connected components of undirected, stored edges (a, b), by contraction.

    Each round every node points to its least neighbour (or itself), pointers
    are followed once more, and edges are carried over to the nodes pointed to.
    Every node with an edge loses at least its partner, so rounds are
    logarithmic; star-shaped edges take one.
    """
    edges = edges.select("a", "b").where("a <> b")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = None
    while True:
        down = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to"))
        second = down.select(F.col("a").alias("_m"), F.col("to").alias("_t"))
        point = stored(down.join(second, F.col("to") == F.col("_m"), "left").select("a", F.coalesce("_t", "to").alias("to")), "pointers")
        if label is None:
            label = point.select(F.col("a").alias("node"), F.col("to").alias("comp"))
        else:
            label = stored(label.join(point, F.col("comp") == F.col("a"), "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        left = point.select(F.col("a").alias("_a"), F.col("to").alias("_p"))
        right = point.select(F.col("a").alias("_b"), F.col("to").alias("_q"))
        both = stored(both.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
                      .where("_p <> _q").select(F.col("_p").alias("a"), F.col("_q").alias("b")).distinct(), "edges")
        if both.isEmpty():
            break
    least = label.groupBy("comp").agg(F.min("node").alias("_least"))
    return label.join(least, "comp").select("node", F.col("_least").alias("comp"))


def _relabelled(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, comp) after confirmed links between nodes; nodes not listed are their own."""
    if comp.isEmpty():
        return stored(components(links), "components")
    known = comp.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))

    def lifted(col: str) -> DataFrame:
        return links.join(known, F.col(col) == F.col("_n"), "left").withColumn(col, F.coalesce("_c", col)).select("a", "b")

    links = lifted("a")
    merged = components(stored(lifted("b"), "links"))
    up = merged.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    old = comp.join(up, F.col("comp") == F.col("_n"), "left").select("node", F.coalesce("_c", "comp").alias("comp"))
    return stored(old.unionByName(merged).groupBy("node").agg(F.min("comp").alias("comp")), "components")


def _prefix(hashes: np.ndarray, common: np.ndarray, times: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the order (times seen, hash), so many that any
    two sets of ``percent`` similarity share one of them."""
    n = len(hashes)
    seen = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        seen = np.where(common[at] == hashes, times[at], 0)
    return hashes[np.lexsort((hashes, seen))[:n - -(-n * percent // 100) + 1]]


def frequent(texts: DataFrame, sample_rows: int = 10_000, most: int = SAMPLE_SHINGLES) -> DataFrame:
    """(h, times): shingles in more than two of ``sample_rows`` texts (rep, text), the ``most`` frequent ones.

    The sample is drawn by id alone and counted in many tasks, so neither a task
    nor the driver grows with the length of its texts.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in chunks(batch.column("text")):
                h, times = np.unique(np.concatenate([*shingle_sets(part), np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times)], names=["h", "times"])

    chosen = stored(texts.select("rep").orderBy(F.xxhash64("rep"), "rep").limit(sample_rows), "sample")
    rows = texts.join(F.broadcast(chosen), "rep", "left_semi").select("text")  # sample_rows ids
    return (rows.mapInArrow(released(count), "h long, times long").groupBy("h").agg(F.sum("times").alias("times"))
            .where("times > 2").orderBy(F.desc("times"), "h").limit(most))


def refined(texts: DataFrame, percent: int = MIN_PERCENT, sample_rows: int = 10_000) -> DataFrame:
    """Buckets (bucket, rep, n, pos) by shingle that no similar pair of ``texts`` (rep, text) escapes.

    Under any one order of all shingles, two sets of ``percent`` similarity
    share a shingle among the first n - ceil(n * percent / 100) + 1 of each,
    and from the first shared one on (``pos`` in either set) both are long
    enough for the overlap that they need.  The order puts shingles last that ``sample_rows`` of the texts often hold,
    so passages that many texts share seldom make a bucket; the sample decides
    how large buckets get, never which pairs meet.
    """
    got = frequent(texts, sample_rows).toArrow()  # SAMPLE_SHINGLES at most
    common, times = (got.column(c).to_numpy() for c in ("h", "times"))
    order = np.argsort(common.view(np.uint64))
    sent = texts.sparkSession.sparkContext.broadcast((common.view(np.uint64)[order], times[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = sent.value
        for batch in batches:
            for lo, part in chunks(batch.column("text")):
                sets = shingle_sets(part)
                first = [_prefix(s, common, times, percent) for s in sets]
                n = [len(f) for f in first]
                rep = batch.column("rep").slice(lo, len(part)).take(pa.array(np.repeat(np.arange(len(part)), n)))
                pos = np.concatenate([np.arange(k) for k in n])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(first).view(np.int64)), rep, pa.array(np.repeat([len(s) for s in sets], n)), pa.array(pos)],
                    names=["bucket", "rep", "n", "pos"])

    kind = texts.schema["rep"].dataType.simpleString()
    return texts.select("rep", "text").mapInArrow(released(run), f"bucket long, rep {kind}, n long, pos long")


def _open(left: DataFrame, comp: DataFrame) -> DataFrame:
    """(bucket, rep, n, pos, comp, main, others): the rows of buckets that hold several components,
    with the largest of these and the number of rows outside it."""
    known = comp.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    placed = left.join(known, F.col("rep") == F.col("_n"), "left").select("bucket", "rep", "n", "pos", F.coalesce("_c", "rep").alias("comp"))
    counts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
    several = counts.groupBy("bucket").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), (F.sum("m") - F.max("m")).alias("others"))
    return stored(placed.join(several.where("others > 0"), "bucket"), "open-buckets")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS,
                    hubs: int = HUBS, percent: int = MIN_PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; see the module's text."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    sig = stored(signatures(docs, id_col=id_col, text_col=text_col, bands=bands, rows=rows), "signatures")
    linkable = sig.where("id is not null and key is not null")
    classes = stored(linkable.groupBy("key").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    # rows that share an id are linked, whatever their texts
    same_id = (linkable.groupBy("id").agg(F.min("key").alias("k1"), F.max("key").alias("k2")).where("k1 <> k2").select("id"))
    ties = (linkable.join(same_id, "id", "left_semi").select("id", "key").join(classes.select("key", "rep"), "key")
            .select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b"))
    comp = spark.createDataFrame([], f"node {kind}, comp {kind}")
    ties = stored(ties, "ties")
    if not ties.isEmpty():
        comp = _relabelled(comp, ties)

    members = classes.select(F.explode("bands").alias("bucket"), "rep", "n")
    crowded = members.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("_top")).where("hub <> _top").select("bucket", "hub")
    # (bucket, rep, n, hub) of the buckets that several classes share
    members = stored(members.join(if_small(stored(crowded, "crowded")), "bucket"), "buckets")
    involved = if_small(stored(members.select("rep").distinct(), "involved"))
    texts = stored(docs.select(F.col(id_col).alias("rep"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
                   .join(involved, "rep", "left_semi"), "texts")

    # 1. one edge for each class, to its least hub
    first = members.groupBy("rep").agg(F.min("hub").alias("hub")).where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    tested = stored(first, "pairs")
    links = stored(confirm(tested, texts, percent), "links")
    if not links.isEmpty():
        comp = _relabelled(comp, links)

    # 2. buckets with a few rows outside their largest component: these rows are the hubs
    left = _open(members.select("bucket", "rep", "n", F.lit(0).cast("long").alias("pos")), comp)
    crowds = stored(left.where(F.col("others") > hubs).select("rep").distinct(), "crowds")
    comp, tested = _round(left.where(F.col("others") <= hubs), left.where((F.col("others") <= hubs) & (F.col("comp") != F.col("main"))),
                          comp, tested, texts, percent)

    # 3. members of the other buckets meet again in finer ones
    if not crowds.isEmpty():
        left = refined(texts.join(if_small(crowds), "rep", "left_semi"), percent)
        while True:
            left = _open(left, comp)
            if left.isEmpty():
                break
            # the first so many in each bucket; tasks keep no more of a bucket before the shuffle
            nth = F.row_number().over(Window.partitionBy("bucket").orderBy("rep"))
            chosen = stored(left.where("comp <> main").withColumn("_nth", nth).where(F.col("_nth") <= ROUND_HUBS).drop("_nth"), "hubs")
            comp, tested = _round(left, chosen, comp, tested, texts, percent)
            done = chosen.select(F.col("bucket").alias("_b"), F.col("rep").alias("_h"))
            left = left.join(done, (F.col("bucket") == F.col("_b")) & (F.col("rep") == F.col("_h")), "left_anti").select("bucket", "rep", "n", "pos")

    known = comp.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    of = classes.select("key", "rep").join(known, F.col("rep") == F.col("_n"), "left").select(F.col("key").alias("_key"), F.coalesce("_c", "rep").alias("_comp"))
    own = F.when(F.col("id").isNotNull(), F.coalesce("_comp", "id"))
    out = sig.select("id", "n_shingles", "key").join(of, F.col("key") == F.col("_key"), "left").select("id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _round(rows: DataFrame, chosen: DataFrame, comp: DataFrame, tested: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Compare hubs with the rows of their buckets in other components: (components, pairs tested so far)."""
    hub = chosen.select("bucket", F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"), F.col("comp").alias("hub_comp"))
    # what the two sets can share from here on must reach the least overlap of a link
    room = F.least(F.col("n") - F.col("pos"), F.col("hub_n") - F.col("hub_pos"))
    near = (F.col("comp") != F.col("hub_comp")) & ((100 + percent) * room >= percent * (F.col("n") + F.col("hub_n")))
    # of two hubs in one bucket the pair is made once
    once = (F.col("comp") == F.col("main")) | (F.col("rep") > F.col("hub"))
    pairs = (rows.join(hub, "bucket").where(near & once)
             .select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct())
    pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    links = stored(confirm(pairs, texts, percent), "links")
    if not links.isEmpty():
        comp = _relabelled(comp, links)
    return comp, tested.unionByName(pairs)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near duplicates, columns unchanged.

    Rows that share an id are one document, of which one row stays; rows with a
    null id stay.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    out = stored(found.select("id", "kept"), "verdicts")
    key = free_name(docs, "_gone")
    gone = if_small(stored(out.where("not kept").select(F.col("id").alias(key)).distinct(), "gone"))
    rest = docs.join(gone, docs[id_col] == gone[key], "left_anti")
    again = out.where("kept and id is not null").groupBy("id").count().where("count > 1")
    if again.isEmpty():
        return rest
    return rest.where(F.col(id_col).isNull()).unionByName(rest.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
