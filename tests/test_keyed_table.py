"""Update-mode stream into a keyed table: changed rows only, replays, compaction, recovery."""

import os

from revmine.sources.reviews import parse_review_block  # noqa: F401
from revmine.streaming.keyed_table import KeyedTable
from revmine.streaming.review_stats import stream_review_updates

SCHEMA = "k string, n bigint"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def content(table, **kw):
    return {r["k"]: r["n"] for r in table.read(**kw).collect()}


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_last_epoch_of_a_key_counts_and_replays_change_nothing(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k", SCHEMA)
    assert content(t) == {}
    t.merge(rows(spark, ("a", 1), ("b", 1)), 0)
    t.merge(rows(spark, ("a", 2), (None, 7)), 1)
    want = {"a": 2, "b": 1, None: 7}
    assert content(t) == want and content(t, upto=0) == {"a": 1, "b": 1}
    for epoch, got in ((1, [("a", 2), (None, 7)]), (0, [("a", 1), ("b", 1)])):
        t.merge(rows(spark, *got), epoch)
        assert content(t) == want


def test_compaction_and_replay_of_an_epoch_it_holds(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k", SCHEMA, least_rows=4)
    t.merge(rows(spark, ("a", 1), ("b", 1)), 0)
    t.merge(rows(spark, ("a", 2), ("c", 1)), 1)  # four changed rows: a base
    assert t.bases() == [1] and t.deltas() == [] and content(t) == {"a": 2, "b": 1, "c": 1}
    t.merge(rows(spark, ("a", 99)), 1)  # replayed late
    assert content(t) == {"a": 2, "b": 1, "c": 1}
    for e in range(2, 9):
        t.merge(rows(spark, ("a", e), (f"k{e}", e)), e)
    assert content(t) == {"a": 8, "b": 1, "c": 1, **{f"k{e}": e for e in range(2, 9)}}
    assert len(t.bases()) <= 2  # the last and the one before


def test_a_failed_compaction_or_epoch_is_not_read(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k", SCHEMA)
    t.merge(rows(spark, ("a", 1)), 0)
    for broken in ("base/upto=0", "delta/epoch=1"):
        rows(spark, ("a", 77)).write.parquet(f"{tmp_path}/{broken}")
        os.remove(f"{tmp_path}/{broken}/_SUCCESS")  # ended before the commit
    assert content(t) == {"a": 1}
    t.merge(rows(spark, ("a", 2)), 1)
    t.compact()
    assert content(t) == {"a": 2} and t.bases() == [1]


def test_bytes_follow_the_changed_keys(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k", SCHEMA)
    many = spark.range(5_000).selectExpr("concat('key', id) as k", "id as n")
    t.merge(many, 0)
    first = sum(os.path.getsize(f) for f in files(tmp_path))
    t.merge(rows(spark, ("key3", 0)), 1)
    assert sum(os.path.getsize(f) for f in files(tmp_path / "delta" / "epoch=1")) < first / 20


def block(*pairs):
    return "\n\n".join(f"beer_id: {k}\noverall: {v}" for k, v in pairs) + "\n\n"


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    folder, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    folder.mkdir()

    def run():
        q, sink = stream_review_updates(spark, str(folder), checkpoint=ckpt, output_path=out, name="updates_test", files_per_epoch=1)
        q.awaitTermination()
        return {r["beer_id"]: (r["review_count"], r["avg_overall"]) for r in sink.read().collect()}, sink

    (folder / "a.txt").write_text(block(("x", 2), ("x", 4), ("y", 5)))
    assert run()[0] == {"x": (2, 3.0), "y": (1, 5.0)}
    (folder / "b.txt").write_text(block(("x", 6), ("z", 1)))
    got, sink = run()
    assert got == {"x": (3, 4.0), "y": (1, 5.0), "z": (1, 1.0)}
    assert sink.deltas() == [0, 1]
    changed = spark.read.parquet(f"{out}/delta/epoch=1").collect()
    assert sorted(r["beer_id"] for r in changed) == ["x", "z"]  # y did not change
    assert run()[0] == got  # no new file
