"""Relational queries: ratings, dimensions, locations (A, J, F, W, K, U rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmine.functions import lexicon as L
from revmine.functions import text as X
from revmine.operators import aggregate as A
from revmine.operators import clean as CL
from revmine.operators import joins as J
from revmine.operators import window as W
from revmine.plans import catalog as C
from revmine.plans.registry import register

IR = f"({C.ITEM_RATINGS_SQL})"
IS = f"({C.ITEM_SCORES_SQL})"
ITEMS = f"({C.ITEMS_SQL})"
MAKERS = f"({C.MAKERS_SQL})"
USERS = f"({C.USERS_SQL})"
ULOC = f"({C.user_locations_sql()})"
HOME = L.HOME_COUNTRY


def r6(c: str, alias: str | None = None):
    return F.round(F.col(c), 6).alias(alias or c)


# --- aggregations -------------------------------------------------------------

@register("review_counts_by", f"""
SELECT beer_id, count(*) AS review_count FROM {IR} r WHERE beer_id IS NOT NULL GROUP BY beer_id""")
def q_review_counts_by(spark: SparkSession, sf: str) -> DataFrame:
    """A1: reviews per beer."""
    return A.review_counts_by(C.item_ratings(spark, sf), "beer_id")


@register("review_avg_by", f"""
SELECT user_id, round(avg(overall), 6) AS avg_overall FROM {IR} r WHERE user_id IS NOT NULL GROUP BY user_id""")
def q_review_avg_by(spark: SparkSession, sf: str) -> DataFrame:
    """A2: mean overall per user."""
    out = A.review_avg_by(C.item_ratings(spark, sf), "user_id", "overall")
    return out.select("user_id", r6("avg_overall"))


@register("aspect_means", f"""
SELECT beer_id, {", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in L.ASPECTS)}
FROM {IR} r WHERE beer_id IS NOT NULL GROUP BY beer_id""")
def q_aspect_means(spark: SparkSession, sf: str) -> DataFrame:
    """A3: mean of the six aspects per beer."""
    out = A.aspect_means(C.item_ratings(spark, sf), "beer_id")
    return out.select("beer_id", *[r6(f"avg_{c}") for c in L.ASPECTS])


@register("duplicate_count", """
SELECT CAST(COALESCE(sum(copies), 0) AS BIGINT) AS duplicate_rows, count(*) AS duplicated_keys
FROM (SELECT md5(text) AS h, count(*) AS copies FROM documents GROUP BY h HAVING count(*) > 1) d""")
def q_duplicate_count(spark: SparkSession, sf: str) -> DataFrame:
    """A4: documents whose exact text occurs more than once (all copies)."""
    docs = C.table(spark, sf, "documents").select(F.md5("text").alias("h"))
    return CL.duplicate_count(docs, "h")


@register("null_counts", f"""
UNPIVOT (SELECT count(CASE WHEN beer_id IS NULL THEN 1 END) AS beer_id, count(CASE WHEN brewery_id IS NULL THEN 1 END) AS brewery_id,
                count(CASE WHEN location IS NULL THEN 1 END) AS location
         FROM (SELECT i.beer_id, i.brewery_id, m.location FROM {ITEMS} i LEFT JOIN {MAKERS} m
               ON i.brewery_id = m.id) x)
ON beer_id, brewery_id, location INTO NAME "column" VALUE nulls""")
def q_null_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A5: NULLs per column after the beer/brewery left join."""
    joined = J.attach_location(C.items(spark, sf), C.makers(spark, sf)).select("beer_id", "brewery_id", "location")
    return CL.null_counts(joined)


@register("missing_token_counts", """
UNPIVOT (SELECT count(CASE WHEN CAST(text AS VARCHAR) IN ('', 'nan') THEN 1 END) AS text,
                count(CASE WHEN CAST(lang AS VARCHAR) IN ('', 'nan') THEN 1 END) AS lang,
                count(CASE WHEN CAST(source AS VARCHAR) IN ('', 'nan') THEN 1 END) AS source FROM documents)
ON text, lang, source INTO NAME "column" VALUE missing""")
def q_missing_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Raw '' / 'nan' values per text column."""
    docs = C.table(spark, sf, "documents")
    return CL.missing_token_counts(docs, ["text", "lang", "source"], ["", "nan"])


@register("dataset_shape", "SELECT count(*) AS rows, 11 AS columns FROM lineitem")
def q_dataset_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and columns of lineitem."""
    return CL.dataset_shape(C.table(spark, sf, "lineitem"))


@register("us_vs_other_users", f"""
SELECT count(CASE WHEN COALESCE(contains(location, '{HOME}'), false) THEN 1 END) AS home,
       count(*) - count(CASE WHEN COALESCE(contains(location, '{HOME}'), false) THEN 1 END) AS other FROM {ULOC} u""")
def q_us_vs_other_users(spark: SparkSession, sf: str) -> DataFrame:
    """Users at home vs elsewhere (NULL locations count as elsewhere)."""
    return CL.us_vs_other_users(C.user_locations(spark, sf))


@register("beers_by_location_category", f"""
SELECT "Location", CAST(sum(nbr_beers) AS BIGINT) AS "Total Beers"
FROM (SELECT CASE WHEN location IS NULL THEN NULL WHEN contains(location, 'NATION_1') THEN 'NATION_1'
                  ELSE 'Other Countries' END AS "Location", nbr_beers FROM {MAKERS} m) x
WHERE "Location" IS NOT NULL GROUP BY "Location" """)
def q_beers_by_location_category(spark: SparkSession, sf: str) -> DataFrame:
    """Beers per maker location class (home = NATION_1, which also matches NATION_1x)."""
    return A.beers_by_location_category(C.makers(spark, sf), home="NATION_1")


@register("reviews_per_entity_sum", """
SELECT entity_id, CAST(count(*) AS BIGINT) AS total_reviews, 'lineitem' AS site FROM
  (SELECT l_partkey AS entity_id FROM lineitem) a GROUP BY entity_id
UNION ALL
SELECT entity_id, CAST(count(*) AS BIGINT) AS total_reviews, 'orders' AS site FROM
  (SELECT o_custkey AS entity_id FROM orders) b GROUP BY entity_id""")
def q_reviews_per_entity_sum(spark: SparkSession, sf: str) -> DataFrame:
    """A10/U4: reviews per entity on two "sites", stacked."""
    li = C.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.lit(1).alias("n"))
    od = C.table(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), F.lit(1).alias("n"))
    return A.reviews_per_entity_sum({"lineitem": li, "orders": od}, "entity_id", "n")


@register("percentile_value", f"""
SELECT round(quantile_cont(rating, 0.1), 6) AS percentile FROM {IR} r""")
def q_percentile_value(spark: SparkSession, sf: str) -> DataFrame:
    """Exact 10th percentile of the rating."""
    return A.percentile_value(C.item_ratings(spark, sf), "rating", 10).select(r6("percentile"))


@register("count_above_percentile", """
SELECT count(CASE WHEN value > (SELECT quantile_cont(value, 0.5) FROM events) THEN 1 END) AS n_above FROM events""")
def q_count_above_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """Events strictly above the median value."""
    return A.count_above_percentile(C.table(spark, sf, "events"), "value", 50)


def _hist_sql(src: str, col: str, bins: int, extra: str = "") -> str:
    return f"""
WITH v AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))),
b AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v),
i0 AS (SELECT x, lo, hi, least(greatest(CAST(floor((x - lo) * ({float(bins)} / (hi - lo))) AS INTEGER), 0), {bins - 1}) AS i
       FROM v CROSS JOIN b),
i1 AS (SELECT x, lo, hi, CASE WHEN x < lo + CAST(i AS DOUBLE) * ((hi - lo) / {float(bins)}) THEN i - 1 ELSE i END AS i FROM i0),
i2 AS (SELECT CASE WHEN x >= lo + CAST(i + 1 AS DOUBLE) * ((hi - lo) / {float(bins)}) AND i <> {bins - 1}
                   THEN i + 1 ELSE i END AS bin FROM i1),
c AS (SELECT bin, count(*) AS cnt FROM i2 GROUP BY bin),
e AS (SELECT CAST(g.bin AS INTEGER) AS bin, lo + CAST(g.bin AS DOUBLE) * ((hi - lo) / {float(bins)}) AS bin_start,
             CASE WHEN g.bin = {bins - 1} THEN hi ELSE lo + CAST(g.bin + 1 AS DOUBLE) * ((hi - lo) / {float(bins)}) END AS bin_end
      FROM range({bins}) g(bin) CROSS JOIN b)
SELECT e.bin, round(bin_start, 6) AS bin_start, round(bin_end, 6) AS bin_end,
       CAST(COALESCE(cnt, 0) AS BIGINT) AS count{extra}
FROM e LEFT JOIN c ON e.bin = c.bin"""


@register("histogram", _hist_sql("events", "value", 20))
def q_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """20 equal-width bins of events.value."""
    h = A.histogram(C.table(spark, sf, "events"), "value", 20)
    return h.select("bin", r6("bin_start"), r6("bin_end"), "count")


@register("percentile_histogram_report", _hist_sql(
    ULOC, "nbr_reviews", 10,
    f""", round((SELECT quantile_cont(nbr_reviews, 0.5) FROM {ULOC} u), 6) AS percentile,
       (SELECT count(CASE WHEN nbr_reviews > (SELECT quantile_cont(nbr_reviews, 0.5) FROM {ULOC} u2) THEN 1 END) FROM {ULOC} u3) AS n_above"""))
def q_percentile_histogram_report(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of reviews per user with the median and the count above it."""
    rep = A.percentile_histogram_report(C.user_locations(spark, sf), "nbr_reviews", 50, 10)
    return rep.select("bin", r6("bin_start"), r6("bin_end"), "count", r6("percentile"), "n_above")


@register("avg_rating_by_location", f"""
SELECT location, round(avg(avg_overall), 6) AS avg_overall FROM
  (SELECT CASE WHEN starts_with(location, '{HOME}') THEN '{L.HOME_COUNTRY_MAP_NAME}' ELSE location END AS location,
          avg_overall FROM {ULOC} u WHERE location IS NOT NULL AND avg_overall IS NOT NULL) x
GROUP BY location""")
def q_avg_rating_by_location(spark: SparkSession, sf: str) -> DataFrame:
    """A15 (+F4): mean user rating per country, US states folded into one."""
    out = A.avg_rating_by_location(C.user_locations(spark, sf), "location", "avg_overall")
    return out.select("location", r6("avg_overall"))


@register("axis_range", """
SELECT min(v) AS min, max(v) AS max FROM
  (SELECT CAST(c AS BIGINT) AS v FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_suppkey) a
   UNION ALL SELECT CAST(c AS BIGINT) FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey) b) u""")
def q_axis_range(spark: SparkSession, sf: str) -> DataFrame:
    """Common min/max of reviews per user over two sites."""
    a = C.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("v"))
    b = C.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("v"))
    return A.axis_range([a.select("v"), b.select("v")], "v")


ABV_EDGES = [9.0, 9.25, 9.5, 9.75, 10.0]


@register("abv_bins", f"""
SELECT bin, count(*) AS count, round(avg(abv), 6) AS avg_abv FROM
  (SELECT abv, CASE WHEN abv < 9.25 THEN 0 WHEN abv < 9.5 THEN 1 WHEN abv < 9.75 THEN 2
                    WHEN abv IS NOT NULL THEN 3 END AS bin
   FROM {ITEMS} i) x GROUP BY bin""")
def q_abv_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Beers per abv interval (first and last open, NULL apart)."""
    out = A.abv_bins(C.items(spark, sf), "abv", ABV_EDGES, "abv")
    return out.select(F.col("bin").cast("int").alias("bin"), "count", r6("avg_abv"))


@register("distinct_values", "SELECT DISTINCT event_type FROM events")
def q_distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct event types."""
    return A.distinct_values(C.table(spark, sf, "events"), "event_type")


# --- joins ---------------------------------------------------------------------

@register("attach_location", f"""
SELECT i.beer_id, i.beer_name, i.brewery_id, m.location FROM {ITEMS} i LEFT JOIN {MAKERS} m ON i.brewery_id = m.id""")
def q_attach_location(spark: SparkSession, sf: str) -> DataFrame:
    """Beers LEFT JOIN breweries(location)."""
    out = J.attach_location(C.items(spark, sf), C.makers(spark, sf))
    return out.select("beer_id", "beer_name", "brewery_id", "location")


@register("enrich_with_review_stats", f"""
SELECT i.beer_id, i.beer_name, i.style, s.review_count, round(s.avg_overall, 6) AS avg_overall
FROM {ITEMS} i JOIN (SELECT beer_id, count(*) AS review_count, avg(overall) AS avg_overall
                     FROM {IR} r WHERE beer_id IS NOT NULL GROUP BY beer_id) s ON i.beer_id = s.beer_id""", bench=True)
def q_enrich_with_review_stats(spark: SparkSession, sf: str) -> DataFrame:
    """J2 (+A1, A2): beers with review count and mean overall (inner)."""
    out = J.enrich_with_review_stats(C.items(spark, sf), C.item_ratings(spark, sf), "beer_id")
    return out.select("beer_id", "beer_name", "style", "review_count", r6("avg_overall"))


@register("join_aspect_means", f"""
SELECT i.beer_id, i.style, {", ".join(f"round(a.avg_{c}, 6) AS avg_{c}" for c in L.ASPECTS)}
FROM {ITEMS} i JOIN (SELECT beer_id, {", ".join(f"avg({c}) AS avg_{c}" for c in L.ASPECTS)}
                     FROM {IR} r WHERE beer_id IS NOT NULL GROUP BY beer_id) a ON i.beer_id = a.beer_id""")
def q_join_aspect_means(spark: SparkSession, sf: str) -> DataFrame:
    """Beers joined with their six aspect means."""
    means = A.aspect_means(C.item_ratings(spark, sf), "beer_id")
    out = J.join_aspect_means(C.items(spark, sf).select("beer_id", "style"), means, "beer_id")
    return out.select("beer_id", "style", *[r6(f"avg_{c}") for c in L.ASPECTS])


@register("attach_entity_percentile", f"""
SELECT r.review_id, r.line, r.beer_id, r.rating, round(p.percentile, 6) AS percentile
FROM {IR} r JOIN (SELECT beer_id, quantile_cont(rating, 0.1) AS percentile FROM {IR} r2
                  WHERE beer_id IS NOT NULL GROUP BY beer_id) p ON r.beer_id = p.beer_id""")
def q_attach_entity_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """Each rating with its beer's 10th percentile."""
    ir = C.item_ratings(spark, sf).select("review_id", "line", "beer_id", "rating")
    out = J.attach_entity_percentile(ir, "beer_id", "rating", 10)
    return out.select("review_id", "line", "beer_id", "rating", r6("percentile"))


@register("popular_entities", f"""
WITH c AS (SELECT beer_id, count(*) AS review_count FROM {IR} r WHERE beer_id IS NOT NULL GROUP BY beer_id)
SELECT beer_id, review_count FROM c WHERE review_count > (SELECT quantile_cont(review_count, 0.9) FROM c)""")
def q_popular_entities(spark: SparkSession, sf: str) -> DataFrame:
    """beers with more reviews than the 90th percentile."""
    return CL.popular_entities(C.item_ratings(spark, sf), "beer_id", q=90)


@register("expert_users", f"""
WITH c AS (SELECT user_id, count(*) AS review_count FROM {IR} r WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT user_id, review_count FROM c WHERE review_count > (SELECT quantile_cont(review_count, 0.95) FROM c)""")
def q_expert_users(spark: SparkSession, sf: str) -> DataFrame:
    """users in the top 5 % by review count."""
    return CL.expert_users(C.item_ratings(spark, sf), "user_id", 95)


@register("restrict_to_entities", f"""
WITH c AS (SELECT beer_id, count(*) AS review_count FROM {IR} r WHERE beer_id IS NOT NULL GROUP BY beer_id),
p AS (SELECT beer_id FROM c WHERE review_count > (SELECT quantile_cont(review_count, 0.9) FROM c))
SELECT review_id, line, beer_id, overall FROM {IR} r WHERE beer_id IN (SELECT beer_id FROM p)""")
def q_restrict_to_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings of the popular beers only (semi-join)."""
    ir = C.item_ratings(spark, sf)
    keep = CL.popular_entities(ir, "beer_id", q=90)
    return J.restrict_to_entities(ir.select("review_id", "line", "beer_id", "overall"), keep, "beer_id")


@register("ignore_users", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal < 0)""")
def q_ignore_users(spark: SparkSession, sf: str) -> DataFrame:
    """Drop every order of the ignored users (negative balance)."""
    ignored = C.table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"))
    orders = C.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return J.ignore_users(orders, ignored, "o_custkey")


@register("join_country", f"""
SELECT n.n_name AS SOVEREIGNT, round(a.avg_overall, 6) AS avg_overall
FROM nation n LEFT JOIN (SELECT location, avg(avg_overall) AS avg_overall FROM {USERS} u
                         JOIN (SELECT o_custkey, avg(o_totalprice) / 10000 AS avg_overall FROM orders GROUP BY 1) o
                         ON u.user_id = o.o_custkey WHERE location IS NOT NULL GROUP BY location) a
ON n.n_name = a.location""")
def q_join_country(spark: SparkSession, sf: str) -> DataFrame:
    """Country dimension LEFT JOIN mean rating per location."""
    o = C.table(spark, sf, "orders").groupBy("o_custkey").agg((F.avg("o_totalprice") / 10000).alias("avg_overall"))
    u = C.users(spark, sf).join(o, F.col("user_id") == F.col("o_custkey"))
    per = A.avg_rating_by_location(u, "location", "avg_overall")
    world = C.table(spark, sf, "nation").select(F.col("n_name").alias("SOVEREIGNT"))
    return J.join_country(world, per).select("SOVEREIGNT", r6("avg_overall"))


# --- filters / projections -----------------------------------------------------

@register("drop_columns", f"SELECT beer_id, beer_name, brewery_id, style, abv FROM {ITEMS} i")
def q_drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    """drop brewery_name from the beer table."""
    return CL.drop_columns(C.items(spark, sf), ["brewery_name"])


@register("epoch_to_timestamp", f"SELECT user_id, make_timestamp(CAST(joined AS BIGINT) * 1000000) AS joined FROM {USERS} u")
def q_epoch_to_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    """user joined seconds -> timestamp."""
    return CL.epoch_to_timestamp(C.users(spark, sf).select("user_id", "joined"), "joined")


@register("classify_location", f"""
SELECT user_id, CASE WHEN location IS NULL THEN NULL WHEN contains(location, '{HOME}') THEN '{HOME}'
                     ELSE 'Other Countries' END AS location_category FROM {ULOC} u""")
def q_classify_location(spark: SparkSession, sf: str) -> DataFrame:
    """home country vs other countries."""
    u = C.user_locations(spark, sf)
    return u.select("user_id", CL.classify_location("location").alias("location_category"))


@register("normalise_country", f"""
SELECT user_id, CASE WHEN starts_with(location, '{HOME}') THEN '{L.HOME_COUNTRY_MAP_NAME}' ELSE location END AS location
FROM {ULOC} u WHERE location IS NOT NULL""")
def q_normalise_country(spark: SparkSession, sf: str) -> DataFrame:
    """fold "United States, <state>" into the map label."""
    return CL.normalise_country(C.user_locations(spark, sf).select("user_id", "location"), "location")


def _state_map_sql() -> str:
    keys = ", ".join(f"'{k}'" for k in L.STATE_CODES)
    vals = ", ".join(f"'{v}'" for v in L.STATE_CODES.values())
    return f"map([{keys}], [{vals}])"


@register("state_from_location", f"""
SELECT user_id, location, COALESCE(starts_with(location, '{HOME}'), false) AS is_state,
       CASE WHEN starts_with(location, '{HOME}') THEN trim(string_split(location, ',')[2]) END AS state,
       CASE WHEN starts_with(location, '{HOME}') THEN {_state_map_sql()}[trim(string_split(location, ',')[2])] END AS state_code
FROM {ULOC} u""")
def q_state_from_location(spark: SparkSession, sf: str) -> DataFrame:
    """state and two-letter code of home-country locations."""
    return CL.state_from_location(C.user_locations(spark, sf).select("user_id", "location"), "location")


@register("filter_language", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def q_filter_language(spark: SparkSession, sf: str) -> DataFrame:
    """F8: English documents."""
    return CL.filter_language(C.table(spark, sf, "documents").select("doc_id", "source", "lang"), "en").drop("lang")


def _detect_sql() -> str:
    from revmine.plans import sqlfrag as S

    langs = ["en", "fr", "de", "es"]
    counts = ", ".join(
        f"len(list_filter(w, lambda x: x IN {S.in_list(CL.language_stop_words(c))})) AS n_{c}" for c in langs)
    arr = "[" + ", ".join(f"n_{c}" for c in langs) + "]"
    return f"""
WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents),
c AS (SELECT doc_id, lang, {counts} FROM t)
SELECT doc_id, lang, CASE WHEN list_max({arr}) > 0 THEN {str(langs)}[list_position({arr}, list_max({arr}))] END
       AS lang_guess FROM c"""


@register("detect_language_stop_words", _detect_sql())
def q_detect_language_stop_words(spark: SparkSession, sf: str) -> DataFrame:
    """F8 without a language column: the language whose stop words occur most."""
    d = C.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return CL.detect_language_by_stop_words(d, "text").select("doc_id", "lang", "lang_guess")


MAX_GRAMS = 50_000


@register("detect_language", f"""
WITH t AS (SELECT doc_id, lang, trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) AS w FROM documents),
p AS (SELECT doc_id, lang, CASE WHEN w = '' OR w IS NULL THEN '' ELSE ' ' || w || ' ' END AS w FROM t),
ch AS (SELECT doc_id, lang, string_split(w, '') AS c FROM p WHERE w <> ''),
cu AS (SELECT doc_id, lang, unnest(c) AS a, generate_subscripts(c, 1) AS i FROM ch),
ld AS (SELECT doc_id, lang, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c, lead(a, 3) OVER w AS d FROM cu WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, lang, a AS gram FROM ld UNION ALL SELECT doc_id, lang, a || b FROM ld WHERE b IS NOT NULL
      UNION ALL SELECT doc_id, lang, a || b || c FROM ld WHERE c IS NOT NULL UNION ALL SELECT doc_id, lang, a || b || c || d FROM ld WHERE d IS NOT NULL),
dc AS (SELECT doc_id, lang, gram, count(*) AS n FROM g GROUP BY ALL),
tr AS (SELECT lang, gram, sum(n) AS n FROM dc WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY ALL),
voc AS (SELECT gram FROM tr GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT {MAX_GRAMS}),
la AS (SELECT lang, count(*) AS docs FROM ch WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY lang),
tot AS (SELECT lang, sum(n) AS n FROM tr JOIN voc USING (gram) GROUP BY lang),
lw AS (SELECT la.lang, voc.gram, ln(coalesce(tr.n, 0) + 1) - ln(tot.n + (SELECT count(*) FROM voc)) AS lw
       FROM voc CROSS JOIN la JOIN tot USING (lang) LEFT JOIN tr ON tr.gram = voc.gram AND tr.lang = la.lang),
sc AS (SELECT dc.doc_id, lw.lang AS guess, sum(dc.n * lw.lw) AS s FROM dc JOIN lw USING (gram) GROUP BY ALL),
every AS (SELECT ch.doc_id, la.lang AS guess, ln(la.docs / (SELECT sum(docs) FROM la)) + coalesce(s, 0) AS s
          FROM ch CROSS JOIN la LEFT JOIN sc ON sc.doc_id = ch.doc_id AND sc.guess = la.lang),
best AS (SELECT doc_id, arg_max(guess, s) AS lang_guess FROM every GROUP BY doc_id)
SELECT p.doc_id, p.lang, lang_guess FROM p LEFT JOIN best USING (doc_id)""")
def q_detect_language(spark: SparkSession, sf: str) -> DataFrame:
    """F8 without a language column: naive Bayes over character n-grams, learnt on four fifths of the documents."""
    d = C.table(spark, sf, "documents").select("doc_id", "lang", "text")
    model = CL.fit_language_model(d.where(F.col("doc_id") % 5 != 0), max_grams=MAX_GRAMS)
    return CL.detect_language(d, "text", model).select("doc_id", "lang", "lang_guess")


@register("rating_band_filter", f"SELECT review_id, line, score FROM {IS} s WHERE score IN (0, 1, 2)")
def q_rating_band_filter(spark: SparkSession, sf: str) -> DataFrame:
    """ratings with score 0-2."""
    return CL.rating_band_filter(C.item_scores(spark, sf).select("review_id", "line", "score"), "score")


@register("round_half_even", f"SELECT review_id, line, overall, score FROM {IS} s")
def q_round_half_even(spark: SparkSession, sf: str) -> DataFrame:
    """Half-even rounding of overall / 10 (2.5 -> 2)."""
    ir = C.item_ratings(spark, sf)
    return ir.select("review_id", "line", "overall",
                     X.round_half_even(F.col("overall") / 10).cast("int").alias("score"))


@register("rename_columns", f"SELECT id AS brewery_id, location AS brewery_location, nbr_beers FROM {MAKERS} m")
def q_rename_columns(spark: SparkSession, sf: str) -> DataFrame:
    """rename output columns."""
    return CL.rename_columns(C.makers(spark, sf), {"id": "brewery_id", "location": "brewery_location"})


# --- windows / ranks -----------------------------------------------------------

@register("drop_all_duplicates", """
SELECT doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) = 1)""")
def q_drop_all_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text has no exact copy (every copy dropped)."""
    docs = C.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return CL.drop_all_duplicates(docs, "h").select("doc_id")


@register("average_rank", f"""
SELECT user_id, nbr_reviews,
       rank() OVER (ORDER BY nbr_reviews) + (count(*) OVER (PARTITION BY nbr_reviews) - 1) / 2.0 AS nbr_reviews_rank
FROM {ULOC} u""")
def q_average_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of reviews-per-user with ties averaged."""
    u = C.user_locations(spark, sf).select("user_id", "nbr_reviews")
    return W.average_rank(u, "nbr_reviews")


@register("rank_within_group", f"""
SELECT beer_id, review_id, line, CAST(row_number() OVER (PARTITION BY beer_id ORDER BY rating DESC, review_id, line)
       AS INTEGER) AS rank
FROM {IR} r WHERE beer_id IS NOT NULL""")
def q_rank_within_group(spark: SparkSession, sf: str) -> DataFrame:
    """Position of each rating within its beer (best first)."""
    ir = C.item_ratings(spark, sf).where(F.col("beer_id").isNotNull())
    ir = ir.select("beer_id", "review_id", "line", (-F.col("rating")).alias("_neg_rating"))
    rk = W.position_in_group(ir, ["beer_id"], ["_neg_rating", "review_id", "line"], "rank")
    return rk.select("beer_id", "review_id", "line", "rank")


@register("most_negative_reviews", f"""
SELECT review_id, line, rating FROM {IR} r ORDER BY rating DESC, review_id, line LIMIT 5""")
def q_most_negative_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """K1: the five highest-scored rows (ties by key)."""
    ir = C.item_ratings(spark, sf).select("review_id", "line", "rating")
    return ir.orderBy(F.col("rating").desc(), "review_id", "line").limit(5)


@register("top_locations", f"""
SELECT location, count(*) AS total FROM {ULOC} u WHERE location IS NOT NULL
GROUP BY location ORDER BY total DESC, location LIMIT 10""")
def q_top_locations(spark: SparkSession, sf: str) -> DataFrame:
    """K2: the ten most frequent user locations."""
    return A.top_locations(C.user_locations(spark, sf), "location", 10)


@register("sample_first_n", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def q_sample_first_n(spark: SparkSession, sf: str) -> DataFrame:
    """K3: first 100 documents by id (explicit order)."""
    return W.sample_first_n(C.table(spark, sf, "documents").select("doc_id", "source"), 100, "doc_id")


@register("select_styles", f"SELECT beer_id, style FROM {ITEMS} i WHERE style IN ('ECONOMY', 'PROMO', 'SMALL')")
def q_select_styles(spark: SparkSession, sf: str) -> DataFrame:
    """K6: rows of chosen styles (by name, not position)."""
    return W.select_styles(C.items(spark, sf).select("beer_id", "style"), ["ECONOMY", "PROMO", "SMALL"])


@register("pos_neg_partition", f"""
SELECT review_id, line, rating,
       CASE WHEN round(rating, 9) <= round(t, 9) THEN 'negative' WHEN round(rating, 9) > round(t, 9) THEN 'positive' END
       AS polarity
FROM {IR} r CROSS JOIN (SELECT quantile_cont(rating, 0.1) AS t FROM {IR} r2) q""")
def q_pos_neg_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Complementary split at the global 10th percentile of the rating."""
    ir = C.item_ratings(spark, sf).select("review_id", "line", "rating")
    thr = A.percentile_scalar(ir, "rating", 10)
    return W.pos_neg_partition(ir.withColumn("_t", thr), "rating", "_t").drop("_t")


@register("compare_sites", f"""
SELECT 'parts' AS site, round(avg(overall), 6) AS mean_rating, count(*) AS n FROM {IR} r
UNION ALL SELECT 'orders' AS site, round(avg(o_totalprice) / 10000, 6), count(*) FROM orders""")
def q_compare_sites(spark: SparkSession, sf: str) -> DataFrame:
    """U4: the same metric on two datasets, stacked with a site column."""
    a = C.item_ratings(spark, sf).agg(F.round(F.avg("overall"), 6).alias("mean_rating"), F.count("*").alias("n"))
    b = C.table(spark, sf, "orders").agg(F.round(F.avg("o_totalprice") / 10000, 6).alias("mean_rating"),
                                         F.count("*").alias("n"))
    return W.compare_sites({"parts": a, "orders": b}).select("site", "mean_rating", "n")
