"""Key-value review files: blocks, casts, simple loader, list text."""

import datetime as dt

from pyspark.sql import functions as F

import pytest

from revmine.sources import reviews as RV
from revmine.sources import tables as ST

BLOCKS = (
    "beer_name: A: the sequel\nrating: 2.5\nuser_id: 7\ntext: nice text: here\nrating: 3.5\n"
    "\n\n\n"
    "beer_name: B\nrating: nan\nuser_id: 8\ntext: \nbroken line\n"
    "\n"
    "beer_name: C\nrating: 1.5\nuser_id: 9\ntext: last one"
)


def test_block_parser_rules(spark, tmp_path):
    path = tmp_path / "reviews.txt"
    path.write_text(BLOCKS, encoding="utf-8")
    df = RV.read_review_blocks(spark, str(path), ["beer_name", "rating", "user_id", "text"])
    got = {r["beer_name"]: r for r in df.collect()}
    assert set(got) == {"A: the sequel", "B", "C"}          # first ": " splits, last record kept
    assert got["A: the sequel"]["rating"] == 3.5           # repeated key: last wins
    assert got["B"]["rating"] is None                      # "nan" -> NULL
    assert got["B"]["_corrupt"] == ["broken line"]
    assert got["B"]["text"] == ""


def test_simple_loader_half_even(spark, tmp_path):
    path = tmp_path / "reviews.txt"
    path.write_text(BLOCKS, encoding="utf-8")
    df = RV.read_simple_reviews(spark, str(path))
    got = {r["beer_name"]: (r["score"], r["review"], r["user_id"]) for r in df.collect()}
    assert got["A: the sequel"] == (4, "nice here", 7)      # last rating 3.5 -> 4; every "text: " removed
    assert got["C"][0] == 2                                # 1.5 -> 2


def test_casts(spark):
    df = spark.createDataFrame([("1600000000", "bad", "True", "nan")], "date string, abv string, review string, overall string")
    r = RV.cast_review_fields(df).first()
    assert r["date"] == dt.datetime(2020, 9, 13, 12, 26, 40)
    assert r["abv"] is None and r["review"] is True and r["overall"] is None
    raw = RV.cast_review_fields(df, do_cast=False).first()
    assert raw["abv"] == "bad"


def test_list_text(spark):
    df = spark.createDataFrame([("['a', \"b's\"]",), ("[]",)], "l string")
    got = [r["l"] for r in ST.parse_list_column(df, ["l"]).collect()]
    assert got == [["a", "b's"], []]


def test_render_roundtrip(spark):
    df = spark.createDataFrame([(1, "x: y")], "id int, v string")
    b = df.select(RV.render_review_block({"id": F.col("id"), "v": F.col("v")}).alias("b"))
    p = RV.parse_review_block(b, "b", ["id", "v"]).first()
    assert (p["id"], p["v"]) == ("1", "x: y")


def test_max_reviews_keeps_file_order(spark, tmp_path):
    path = tmp_path / "reviews.txt"
    path.write_text(BLOCKS, encoding="utf-8")
    got = [r["beer_name"] for r in RV.read_review_blocks(spark, str(path), ["beer_name"], max_reviews=2).collect()]
    assert got == ["A: the sequel", "B"]


def test_stream_stats_to_parquet(spark, tmp_path):
    from revmine.streaming.review_stats import latest_epoch, stream_review_stats

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("beer_id: 1\noverall: 4\n\nbeer_id: 1\noverall: 2\n\nbeer_id: 2\noverall: 5\n")
    out = str(tmp_path / "out")
    q = stream_review_stats(spark, str(folder), checkpoint=str(tmp_path / "ckpt"), output_path=out)
    q.awaitTermination()
    got = sorted((r["beer_id"], r["review_count"], r["avg_overall"]) for r in latest_epoch(spark, out).collect())
    assert got == [("1", 2, 3.0), ("2", 1, 5.0)]


def test_load_dimensions(spark, tmp_path):
    (tmp_path / "beers.csv").write_text(
        "beer_id,beer_name,brewery_id,brewery_name,style,abv\n1,A,10,Br,IPA,5.0\n2,B,99,Bx,Stout,8.0\n")
    (tmp_path / "breweries.csv").write_text('id,location,name,nbr_beers\n10,"United States, Oregon",Br,3\n')
    (tmp_path / "users.csv").write_text("user_id,user_name,joined,location,nbr_ratings,nbr_reviews\n7,u,1600000000,Belgium,1,1\n")
    beers, breweries, users = ST.load_dimensions(spark, str(tmp_path))
    got = {r["beer_id"]: r["location"] for r in beers.collect()}
    assert got == {"1": "United States, Oregon", "2": None} and "brewery_name" not in beers.columns
    assert str(users.first()["joined"]) == "2020-09-13 12:26:40"


def test_windows_line_ends_and_strict(spark, tmp_path):
    unix, windows = tmp_path / "u.txt", tmp_path / "w.txt"
    unix.write_bytes(BLOCKS.encode())
    windows.write_bytes(BLOCKS.replace("\n", "\r\n").encode())
    keys = ["beer_name", "text", "rating"]
    a = RV.read_review_blocks(spark, str(unix), keys, None).collect()
    b = RV.read_review_blocks(spark, str(windows), keys, None, line_end="\r\n").collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) > 1
    bad = tmp_path / "bad.txt"
    bad.write_text("beer_name: A\nno separator here\n\nbeer_name: B\n")
    assert sorted(r["beer_name"] for r in RV.read_review_blocks(spark, str(bad), ["beer_name"]).collect()) == ["A", "B"]
    with pytest.raises(Exception, match="without a separator"):
        RV.read_review_blocks(spark, str(bad), ["beer_name"], strict=True).collect()


def test_scratch_folders_are_new_for_each_call(spark):
    from revmine.plans.io_paths import scratch_path

    assert scratch_path(spark, "x", "n") != scratch_path(spark, "x", "n")


def test_blocks_survive_file_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    blocks = [f"beer_id: {i}\ntext: review number {i}: fine\nrating: {i % 5}.5" for i in range(4000)]
    path.write_text("\n\n".join(blocks) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = RV.read_review_blocks(spark, str(path), ["beer_id", "text", "rating"])
        assert df.rdd.getNumPartitions() > 4
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 4000
    assert sorted(int(r["beer_id"]) for r in got) == list(range(4000))
    assert all(r["text"] == f"review number {r['beer_id']}: fine" and not r["_corrupt"] for r in got)


def test_checkpoints_go_to_the_configured_folder(spark):
    import glob

    from revmine.session import _path, cut_lineage, ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert folder == configured
    in_use = spark.sparkContext.getCheckpointDir()
    assert _path(in_use).startswith(_path(folder).rstrip("/"))
    assert ensure_checkpoint_dir(spark) == folder and spark.sparkContext.getCheckpointDir() == in_use
    assert cut_lineage(spark.range(10)).count() == 10
    assert glob.glob(_path(in_use) + "/rdd-*")
