"""Dimension tables, result tables and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEERS_SCHEMA = T.StructType([
    T.StructField("beer_id", T.StringType()), T.StructField("beer_name", T.StringType()),
    T.StructField("brewery_id", T.StringType()), T.StructField("brewery_name", T.StringType()),
    T.StructField("style", T.StringType()), T.StructField("abv", T.DoubleType()),
    T.StructField("overall_score", T.DoubleType()), T.StructField("style_score", T.DoubleType()),
    T.StructField("zscore", T.DoubleType()), T.StructField("nbr_matched_valid_ratings", T.LongType()),
    T.StructField("avg_matched_valid_ratings", T.DoubleType()),
])
BREWERIES_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("location", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("nbr_beers", T.LongType()),
])
USERS_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("user_name", T.StringType()),
    T.StructField("joined", T.DoubleType()), T.StructField("location", T.StringType()),
    T.StructField("nbr_ratings", T.LongType()), T.StructField("nbr_reviews", T.LongType()),
])


# S5 / S7 / S11
def read_dim_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with header, quoted multi-line fields, explicit schema (no inference)."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("mode", "PERMISSIVE").csv(path))


def read_result_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An aggregate table written by an earlier stage (CSV or parquet by suffix)."""
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    return read_dim_csv(spark, path, schema)


def read_country_dim(spark: SparkSession, path: str, key: str = "SOVEREIGNT") -> DataFrame:
    """Country dimension keyed by ``key`` (no geometry)."""
    reader = spark.read.parquet if path.endswith(".parquet") else (
        lambda p: spark.read.option("header", True).csv(p))
    return reader(path).select(key, *[c for c in reader(path).columns if c != key])


# S6
def read_scored_sentences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# S8
def parse_list_column(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Python-literal list text ("['a', \\"b's\\"]") -> array<string>, no eval."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.from_json(F.col(c), "array<string>", {"allowSingleQuotes": "true"}))
    return out


# S9 / S10 sinks
def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite-mode sink; jobs are idempotent, so a retried job rewrites the same output."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    w.save(path)


def write_ignored_users(df: DataFrame, path: str, user: str, fmt: str = "parquet") -> None:
    """Ids of users occurring more than once."""
    ids = df.groupBy(user).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(user)
    write_table(ids, path, fmt)


def write_topics(topics: DataFrame, path: str, model=None) -> None:
    """Topic table as parquet (+ the fitted model next to it when given)."""
    write_table(topics, f"{path.rstrip('/')}/topics")
    if model is not None:
        model.write().overwrite().save(f"{path.rstrip('/')}/model")


def load_dimensions(spark: SparkSession, data_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three dimension tables of a review site in one call.

    beers (``beers.csv``) LEFT JOIN breweries' location, ``brewery_name``
    dropped (J1, F1); breweries as read; users with ``joined`` seconds turned
    into a timestamp (F2).  Ids are strings, as in the files.
    """
    from revmine.operators.clean import drop_columns, epoch_to_timestamp
    from revmine.operators.joins import attach_location

    base = data_path.rstrip("/")
    beers = read_dim_csv(spark, f"{base}/beers.csv", BEERS_SCHEMA)
    breweries = read_dim_csv(spark, f"{base}/breweries.csv", BREWERIES_SCHEMA)
    users = read_dim_csv(spark, f"{base}/users.csv", USERS_SCHEMA)
    beers = attach_location(drop_columns(beers, ["brewery_name"]), breweries, "brewery_id", "id")
    return beers, breweries, epoch_to_timestamp(users, "joined")
