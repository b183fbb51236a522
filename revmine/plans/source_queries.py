"""Sources and sinks (S1-S11) as round trips over data derived from the tables.

Files are written under the shared checkpoint folder (overwrite mode, so a
retried job rewrites the same output) and read back with our readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmine.functions import lexicon as L
from revmine.functions import text as X
from revmine.operators import aggregate as A
from revmine.plans import catalog as C
from revmine.plans import sqlfrag as S
from revmine.plans.io_paths import scratch_path
from revmine.plans.registry import register
from revmine.sources import reviews as RV
from revmine.sources import tables as ST
from revmine.plans.scoring_queries import _w as _scored_w

ONE_LINE = "replace(text, chr(10), ' ')"


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """documents rendered as review records; ``lang`` repeated (last wins) and
    one line without separator per record."""
    d = C.table(spark, sf, "documents")
    block = RV.render_review_block({
        "doc_id": F.col("doc_id"), "source": F.col("source"), "lang": F.col("lang"),
        "n_chars": F.col("n_chars"), "text": F.replace(F.col("text"), F.lit("\n"), F.lit(" ")),
    })
    block = F.concat(block, F.lit("\nlang: "), F.upper("lang"), F.lit("\nno separator on this line"))
    return d.select("doc_id", block.alias("block"))


@register("parse_review_block", f"""
SELECT doc_id, source, upper(lang) AS lang, n_chars, CAST(length({ONE_LINE}) AS BIGINT) AS text_len,
       1 AS n_corrupt FROM documents""")
def q_parse_review_block(spark: SparkSession, sf: str) -> DataFrame:
    """Key-value blocks parsed back (first ': ' splits, last repeat wins, bad lines kept apart)."""
    p = RV.parse_review_block(_blocks(spark, sf).drop("doc_id"), "block", ["doc_id", "source", "lang", "n_chars", "text"])
    return p.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang",
                    F.col("n_chars").cast("bigint").alias("n_chars"),
                    F.length("text").cast("bigint").alias("text_len"), F.size("_corrupt").alias("n_corrupt"))


def _cast_blocks(spark: SparkSession, sf: str) -> DataFrame:
    d = C.table(spark, sf, "documents")
    return d.select(RV.render_review_block({
        "doc_id": F.col("doc_id"),
        "date": F.col("n_chars"),
        "rating": (F.col("n_chars") / 100).cast("string"),
        "overall": F.when(F.col("n_chars") < 1000, F.lit("nan")).otherwise((F.col("n_chars") / 1000).cast("string")),
        "abv": F.when(F.col("lang") == "de", F.lit("n/a")).otherwise(F.lit("5.5")),
        "review": F.when(F.col("lang") == "en", F.lit("True")).otherwise(F.lit("False")),
    }).alias("block"))


@register("cast_review_fields", """
SELECT doc_id, make_timestamp(n_chars * 1000000) AS date, n_chars / 100 AS rating,
       CASE WHEN n_chars < 1000 THEN NULL ELSE n_chars / 1000 END AS overall,
       CASE WHEN lang = 'de' THEN NULL ELSE CAST(5.5 AS DOUBLE) END AS abv, lang = 'en' AS review FROM documents""")
def q_cast_review_fields(spark: SparkSession, sf: str) -> DataFrame:
    """S3: the cast table (bad number -> NULL, "nan" -> NULL, "True" -> true, seconds -> timestamp)."""
    keys = ["doc_id", "date", "rating", "overall", "abv", "review"]
    p = RV.parse_review_block(_cast_blocks(spark, sf), "block", keys)
    c = RV.cast_review_fields(p, L.REVIEW_CASTS)
    return c.select(F.col("doc_id").cast("bigint").alias("doc_id"), "date", "rating", "overall", "abv", "review")


def _write_blocks(spark: SparkSession, sf: str, name: str, rows: DataFrame) -> str:
    path = scratch_path(spark, sf, name)
    rows.write.mode("overwrite").text(path)
    return path


@register("read_review_blocks", "SELECT doc_id, source, upper(lang) AS lang, n_chars FROM documents")
def q_read_review_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Review records written as a text file (one or two blank lines
    between records), read back with the blank-line record separator."""
    b = _blocks(spark, sf)
    sep = F.when(F.col("doc_id") % 2 == 0, F.lit("\n")).otherwise(F.lit("\n\n"))
    path = _write_blocks(spark, sf, "review_blocks", b.select(F.concat("block", sep).alias("value")))
    r = RV.read_review_blocks(spark, path, ["doc_id", "source", "lang", "n_chars"])
    return r.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang",
                    F.col("n_chars").cast("bigint").alias("n_chars"))


@register("add_review_columns", f"""
SELECT i.beer_id, i.beer_name, s.review_count, round(s.avg_overall, 6) AS avg_overall
FROM ({C.ITEMS_SQL}) i JOIN (SELECT l_partkey AS beer_id, count(*) AS review_count, avg(l_quantity) AS avg_overall
                             FROM lineitem GROUP BY l_partkey) s ON i.beer_id = s.beer_id""")
def q_add_review_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Entry A end to end: a key-value review file (rendered from the ratings)
    read with the block reader and casts (S1, S3), counted and averaged per beer
    in one aggregate, inner-joined onto the beer table (A1, A2, J2)."""
    from revmine.operators import joins as J

    ratings = C.item_ratings(spark, sf)
    block = RV.render_review_block({"beer_id": F.col("beer_id"), "user_id": F.col("user_id"),
                                    "overall": F.col("overall"), "text": F.lit("fine")})
    path = _write_blocks(spark, sf, "rating_blocks", ratings.select(F.concat(block, F.lit("\n")).alias("value")))
    reviews = RV.read_review_blocks(spark, path, ["beer_id", "overall"])
    reviews = reviews.withColumn("beer_id", F.col("beer_id").cast("bigint"))
    out = J.enrich_with_review_stats(C.items(spark, sf).select("beer_id", "beer_name"), reviews, "beer_id")
    return out.select("beer_id", "beer_name", "review_count", F.round("avg_overall", 6).alias("avg_overall"))


@register("read_simple_reviews", f"""
SELECT replace(replace('text: ' || {ONE_LINE}, 'text: ', ''), 'â\u0080\u0099', '''') AS review,
       CAST(round_even(floor(n_chars / 500) / 2.0, 0) AS INTEGER) AS score, source AS beer_name,
       doc_id AS user_id FROM documents""")
def q_read_simple_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Review, half-even rounded score, beer name and user per record."""
    d = C.table(spark, sf, "documents")
    block = RV.render_review_block({
        "beer_name": F.col("source"), "user_id": F.col("doc_id"),
        "rating": (F.floor(F.col("n_chars") / 500) / 2.0).cast("string"),
        "text": F.replace(F.col("text"), F.lit("\n"), F.lit(" ")),
    })
    path = _write_blocks(spark, sf, "simple_reviews", d.select(F.concat(block, F.lit("\n")).alias("value")))
    return RV.read_simple_reviews(spark, path)


@register("parse_list_column", f"""
SELECT doc_id, {S.tokens(S.clean('text'))} AS words FROM documents""")
def q_parse_list_column(spark: SparkSession, sf: str) -> DataFrame:
    """Python-literal list text (single or double quotes) parsed back to arrays."""
    d = C.table(spark, sf, "documents")
    words = X.tokenise(X.clean_for_tokens("text"))
    q = F.when(F.col("doc_id") % 2 == 0, F.lit("'")).otherwise(F.lit('"'))
    txt = F.concat(F.lit("["), F.array_join(F.transform(words, lambda w: F.concat(q, w, q)), ", "), F.lit("]"))
    return ST.parse_list_column(d.select("doc_id", txt.alias("words")), ["words"])


@register("write_ignored_users", """
SELECT md5(text) AS h FROM documents GROUP BY h HAVING count(*) > 1""")
def q_write_ignored_users(spark: SparkSession, sf: str) -> DataFrame:
    """Keys seen more than once written out and read back."""
    path = scratch_path(spark, sf, "ignored")
    ST.write_ignored_users(C.table(spark, sf, "documents").select(F.md5("text").alias("h")), path, "h")
    return spark.read.parquet(path)


@register("read_dim_csv", f"SELECT CAST(id AS VARCHAR) AS id, location, nbr_beers FROM ({C.MAKERS_SQL}) m")
def q_read_dim_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A brewery dimension written as CSV (header, quoting) and read with a fixed schema."""
    path = scratch_path(spark, sf, "breweries_csv")
    mk = C.makers(spark, sf).select("id", "location", F.concat(F.lit('Maker "'), F.col("id"), F.lit('"\nline'))
                                    .alias("name"), "nbr_beers")
    ST.write_table(mk, path, "csv")
    return ST.read_dim_csv(spark, path, ST.BREWERIES_SCHEMA).select("id", "location", "nbr_beers")


@register("read_result_csv", f"""
SELECT beer_id, count(*) AS review_count FROM ({C.ITEM_RATINGS_SQL}) r GROUP BY beer_id""")
def q_read_result_csv(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate table written by one stage and read by the next."""
    path = scratch_path(spark, sf, "review_counts_csv")
    ST.write_table(A.review_counts_by(C.item_ratings(spark, sf), "beer_id"), path, "csv")
    return ST.read_result_csv(spark, path, "beer_id bigint, review_count bigint")


@register("read_country_dim", "SELECT n_name AS SOVEREIGNT, n_regionkey FROM nation")
def q_read_country_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Country dimension keyed by SOVEREIGNT (no geometry)."""
    path = scratch_path(spark, sf, "countries") + ".parquet"
    ST.write_table(C.table(spark, sf, "nation").select(F.col("n_name").alias("SOVEREIGNT"), "n_regionkey"), path)
    return ST.read_country_dim(spark, path)


@register("read_scored_sentences", _scored_w("SELECT max_feel, count(*) AS n FROM scored GROUP BY max_feel"))
def q_read_scored_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Per-sentence scores written as parquet and read back."""
    from revmine.plans.scoring_queries import scored_sentences

    path = scratch_path(spark, sf, "scored_sentences")
    ST.write_table(scored_sentences(spark, sf), path)
    return ST.read_scored_sentences(spark, path).groupBy("max_feel").agg(F.count("*").alias("n"))
