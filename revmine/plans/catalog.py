"""How the review concepts map onto the driver's tables.

| concept                         | table / column                                   |
|---------------------------------|--------------------------------------------------|
| review text, entity, language   | documents.text, documents.source, documents.lang |
| expert review (weight 5)        | labels.quality = 1                               |
| rating used for text splits     | documents.n_chars                                |
| item ratings (beer reviews)     | lineitem: l_partkey = item, l_suppkey = reviewer |
| item / maker / user dimensions  | part, supplier (+nation), customer (+nation)     |
| emotion category x score        | events.event_type x bucket of events.value       |
| vectors for the classifier      | embeddings.embedding, embeddings.label           |

Readers select only the columns a query needs so the parquet scan prunes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

ENTITY = "source"
EXPERT_WEIGHT = 5


TEXT_TABLE_KEYS = {"documents": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as its files have it.

    A file of a single row group is read by one task.  A session that knows its
    text files are like that may set ``revmine.documents.partitions``; the text
    table is then dealt out by its key.  Unset (the default), nothing is moved.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get("revmine.documents.partitions", None)
    if n and name in TEXT_TABLE_KEYS:
        df = df.repartition(int(n), TEXT_TABLE_KEYS[name])
    return df


def expert_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written by experts (labels.quality = 1), one row per doc."""
    return table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id").distinct()


def reviews(spark: SparkSession, sf_dir: str, lang: str | None = "en") -> DataFrame:
    """Review-shaped view of ``documents``: doc_id, source, text, lang, rating, expert.

    The expert flag is a left join on the distinct expert doc ids; AQE
    broadcasts that side when its runtime size is small and keeps a
    shuffled join otherwise.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    if lang is not None:
        docs = docs.where(F.col("lang") == lang)
    exp = expert_docs(spark, sf_dir).withColumn("expert", F.lit(True))
    return (docs.join(exp, "doc_id", "left")
            .select("doc_id", "source", "text", "lang", F.col("n_chars").cast("double").alias("rating"),
                    F.coalesce(F.col("expert"), F.lit(False)).alias("expert")))


# SQL twin of ``reviews`` used by the oracles.
REVIEWS_SQL = """
SELECT d.doc_id, d.source, d.text, d.lang, CAST(d.n_chars AS DOUBLE) AS rating,
       (e.doc_id IS NOT NULL) AS expert
FROM documents d
LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) e ON d.doc_id = e.doc_id
WHERE d.lang = 'en'
"""


def item_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beer-review-shaped view of ``lineitem``: one row per rating.

    beer_id = l_partkey, user_id = l_suppkey, overall = l_quantity,
    rating = l_discount * 100, aspects = quantity / tax / discount / price.
    """
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("review_id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("beer_id"), F.col("l_suppkey").alias("user_id"),
        F.col("l_quantity").alias("overall"), (F.col("l_discount") * 100).alias("rating"),
        (F.col("l_tax") * 100).alias("appearance"), (F.col("l_discount") * 50).alias("aroma"),
        (F.col("l_extendedprice") / 1000).alias("palate"), (F.col("l_quantity") / 10).alias("taste"),
        F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("date"))


ITEM_RATINGS_SQL = """
SELECT l_orderkey AS review_id, l_linenumber AS line, l_partkey AS beer_id, l_suppkey AS user_id,
       l_quantity AS overall, l_discount * 100 AS rating, l_tax * 100 AS appearance,
       l_discount * 50 AS aroma, l_extendedprice / 1000 AS palate, l_quantity / 10 AS taste,
       l_returnflag AS flag, l_shipdate AS date
FROM lineitem
"""


def makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brewery-shaped view of ``supplier``: id, location (nation name), nbr_beers."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    nbr = li.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("nbr_beers"))
    # nation has 25 rows by definition of the schema: a bounded broadcast.
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left")
            .join(nbr, s.s_suppkey == nbr.l_suppkey, "left")
            .select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("location"),
                    F.coalesce(F.col("nbr_beers"), F.lit(0)).alias("nbr_beers")))


MAKERS_SQL = """
SELECT s.s_suppkey AS id, n.n_name AS location, COALESCE(b.nbr_beers, 0) AS nbr_beers
FROM supplier s
LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS nbr_beers FROM lineitem GROUP BY l_suppkey) b
  ON s.s_suppkey = b.l_suppkey
"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beer-shaped view of ``part``: beer_id, beer_name, brewery_id, style, abv.

    ``part`` carries no supplier key, so the maker reference is the small
    integer column ``p_size`` read as a supplier id (it matches some of them,
    which exercises the LEFT join of J1 both ways).
    """
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("beer_id"), F.col("p_name").alias("beer_name"),
                    F.col("p_size").cast("bigint").alias("brewery_id"), F.col("p_type").alias("style"),
                    (F.col("p_retailprice") / 100).alias("abv"), F.col("p_brand").alias("brewery_name"))


ITEMS_SQL = """
SELECT p_partkey AS beer_id, p_name AS beer_name, CAST(p_size AS BIGINT) AS brewery_id,
       p_type AS style, p_retailprice / 100 AS abv, p_brand AS brewery_name
FROM part
"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-shaped view of ``customer``: user_id, joined, location, nbr_reviews."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = table(spark, sf_dir, "orders").select("o_custkey")
    nrev = o.groupBy("o_custkey").agg(F.count("*").alias("nbr_reviews"))
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")
            .join(nrev, c.c_custkey == nrev.o_custkey, "left")
            .select(F.col("c_custkey").alias("user_id"),
                    (F.lit(1_600_000_000) + F.col("c_custkey") * 3600).alias("joined"),
                    F.col("n_name").alias("location"),
                    F.coalesce(F.col("nbr_reviews"), F.lit(0)).alias("nbr_reviews")))


USERS_SQL = """
SELECT c.c_custkey AS user_id, 1600000000 + c.c_custkey * 3600 AS joined, n.n_name AS location,
       COALESCE(o.nbr_reviews, 0) AS nbr_reviews
FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS nbr_reviews FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
"""


# Home-country locations for the location operators: customers of the AMERICA
# region live in "United States, <state>" (state picked by nation key from the
# fixed state list), everybody else in their nation.
def _state_names():
    from revmine.functions.lexicon import STATE_CODES

    return list(STATE_CODES)


def user_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, location, nbr_reviews, avg_overall`` with US-style locations."""
    from revmine.functions.lexicon import HOME_COUNTRY

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    stats = o.groupBy("o_custkey").agg(F.count("*").alias("nbr_reviews"),
                                       (F.avg("o_totalprice") / 10000).alias("avg_overall"))
    states = F.array(*[F.lit(s) for s in _state_names()])
    # nation (25 rows) and region (5 rows) are bounded by the schema
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        "n_nationkey",
        F.when(F.col("r_name") == "AMERICA",
               F.concat(F.lit(HOME_COUNTRY + ", "), F.try_element_at(states, F.col("n_nationkey") + 1)))
        .otherwise(F.col("n_name")).alias("location"))
    return (c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey, "left")
            .join(stats, c.c_custkey == stats.o_custkey, "left")
            .select(F.col("c_custkey").alias("user_id"), "location",
                    F.coalesce("nbr_reviews", F.lit(0)).alias("nbr_reviews"), "avg_overall"))


def user_locations_sql() -> str:
    states = "[" + ", ".join("'" + s + "'" for s in _state_names()) + "]"
    return f"""
SELECT c.c_custkey AS user_id, g.location, COALESCE(s.nbr_reviews, 0) AS nbr_reviews, s.avg_overall
FROM customer c
LEFT JOIN (SELECT n.n_nationkey,
                  CASE WHEN r.r_name = 'AMERICA' THEN 'United States, ' || {states}[n.n_nationkey + 1]
                       ELSE n.n_name END AS location
           FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey) g ON c.c_nationkey = g.n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS nbr_reviews, avg(o_totalprice) / 10000 AS avg_overall
           FROM orders GROUP BY o_custkey) s ON c.c_custkey = s.o_custkey
"""


def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item ratings with an integer 0-5 ``score`` = half-even round of overall / 10."""
    return item_ratings(spark, sf_dir).withColumn("score", F.bround(F.col("overall") / 10, 0).cast("int"))


ITEM_SCORES_SQL = f"""
SELECT *, CAST(round_even(overall / 10, 0) AS INTEGER) AS score FROM ({ITEM_RATINGS_SQL}) ir
"""
