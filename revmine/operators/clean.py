"""Projections, filters and data-quality operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revmine.functions import lexicon as L
from revmine.operators.language import LanguageModel, detect_language, fit_language_model, letters  # noqa: F401  (F8)


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# F1
def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


# F2
def epoch_to_timestamp(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Seconds since the epoch -> timestamp (UTC session time zone)."""
    return df.withColumn(out or col, F.timestamp_seconds(F.col(col)))


# F3
def classify_location(col, home: str = L.HOME_COUNTRY, other: str = L.OTHER_COUNTRIES) -> Column:
    """NULL -> NULL; contains ``home`` -> ``home``; else "Other Countries"."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(None).cast("string")).when(c.contains(home), F.lit(home)).otherwise(F.lit(other))


# F4
def normalise_country(df: DataFrame, location: str = "location", home: str = L.HOME_COUNTRY,
                      map_name: str = L.HOME_COUNTRY_MAP_NAME, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with NULLs in ``subset`` (default: location), then rename the
    home country (prefix match) to its map label."""
    out = df.dropna(subset=list(subset or [location]))
    return out.withColumn(location, F.when(F.col(location).startswith(home), F.lit(map_name))
                          .otherwise(F.col(location)))


# F5
def state_codes_map(codes: Mapping[str, str] = L.STATE_CODES) -> Column:
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])


def state_from_location(df: DataFrame, location: str = "location", home: str = L.HOME_COUNTRY,
                        codes: Mapping[str, str] = L.STATE_CODES) -> DataFrame:
    """Home-country rows get ``state`` = second comma part (trimmed) and its code
    (unknown -> NULL); other rows keep NULLs.  ``is_state`` tells them apart."""
    part = F.trim(F.get(F.split(F.col(location), ","), 1))
    is_state = F.col(location).startswith(home)
    return (df.withColumn("is_state", F.coalesce(is_state, F.lit(False)))
            .withColumn("state", F.when(F.col("is_state"), part))
            .withColumn("state_code", F.when(F.col("is_state"), F.element_at(state_codes_map(codes), part))))


# F6 / F7
def popular_entities(df: DataFrame, entity: str, q: float | None = None, min_count: int | None = None,
                     count_col: str = "review_count") -> DataFrame:
    """Entities whose count is strictly above the ``q``-th percentile of counts
    (or above ``min_count``).  Returns ``(entity, review_count)``.

    The percentile is an exact scalar subquery over the per-entity counts.
    """
    from revmine.operators.ranks import percentile_by_rank

    counts = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias(count_col))
    if q is not None:
        thr = percentile_by_rank(counts, count_col, q / 100.0).select("percentile").scalar()
        return counts.where(F.col(count_col) > thr)
    return counts.where(F.col(count_col) > F.lit(min_count))


def expert_users(df: DataFrame, user: str, q: float = 95.0) -> DataFrame:
    """users in the top (100 - q) % by review count (strictly above the percentile)."""
    return popular_entities(df, user, q=q)


# F8
LANGUAGE_LISTS = {"en": "english", "fr": "french", "de": "german", "es": "spanish", "it": "italian",
                  "nl": "dutch", "pt": "portuguese"}


def language_stop_words(code: str) -> list[str]:
    """Letters-only entries of Spark's stop list for a language code."""
    from revmine.operators.text import spark_stop_list

    return sorted({w for w in spark_stop_list(LANGUAGE_LISTS[code]) if w.isalpha()})


def _in(words: Sequence[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(words)


def language_scores(words, languages=("en", "fr", "de", "es")) -> list[Column]:
    """Per language, the number of ``words`` (lowercase, an array) in its stop list."""
    return [F.size(F.filter(_c(words), _in(language_stop_words(code)))).alias(f"_lang_{code}") for code in languages]


def detect_language_by_stop_words(df: DataFrame, text: str, languages=("en", "fr", "de", "es"), out: str = "lang_guess") -> DataFrame:
    """Language with the most stop-word hits (first listed on ties; none -> NULL).

    Words are split once, those in any list are kept and looked up in each
    list's hash set.  Each step is a one-row ``inline``, so nothing that uses its
    result runs it again.
    """
    languages = list(languages)
    every = sorted({w for code in languages for w in language_stop_words(code)})
    words = df.select("*", F.inline(F.array(F.struct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), 0).alias("_words")))))
    listed = words.select(*df.columns, F.inline(F.array(F.struct(F.filter("_words", _in(every)).alias("_words")))))
    cnt = listed.select(*df.columns, F.inline(F.array(F.struct(*language_scores("_words", languages)))))
    arr = F.array(*[F.col(f"_lang_{c}") for c in languages])
    best = F.array_position(arr, F.array_max(arr)).cast("int")
    guess = F.when(F.array_max(arr) > 0, F.element_at(F.array(*[F.lit(c) for c in languages]), best))
    return cnt.withColumn(out, guess).drop(*[f"_lang_{c}" for c in languages])


def filter_language(df: DataFrame, lang: str = "en", lang_col: str | None = "lang", text: str | None = None,
                    model: LanguageModel | None = None) -> DataFrame:
    """Keep rows in one language: by a language column, or (``lang_col=None``)
    by what ``model`` (of :func:`fit_language_model`) makes of ``text``."""
    if lang_col is not None:
        return df.where(F.col(lang_col) == lang)
    if model is None or text is None:
        raise ValueError("without a language column a text column and a fitted model are needed")
    return df.where(model.guess()(letters(text)) == lang)


# F9
def rating_band_filter(df: DataFrame, score: str, values: Sequence[int] = L.NEGATIVE_SCORES) -> DataFrame:
    return df.where(F.col(score).isin(list(values)))


# F10
def emotion_filter(df: DataFrame, emotion: str, feel: str = "max_feel", entity: str | None = None,
                   entity_value=None, n: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows whose arg-max label is ``emotion`` [of one entity] [first ``n`` in ``order``]."""
    out = df.where(F.col(feel) == emotion)
    if entity is not None:
        out = out.where(F.col(entity) == entity_value)
    if n is not None:
        if not order:
            raise ValueError("first n rows need an explicit order")
        out = out.orderBy(*_list(order)).limit(n)
    return out


# F11
def exclude_zero_polarity(df: DataFrame, polarity: str = "polarity") -> DataFrame:
    return df.where(F.col(polarity) != 0)


# F12
def assert_no_column_collision(df: DataFrame, names: Sequence[str]) -> None:
    clash = set(df.columns) & set(names)
    if clash:
        raise ValueError(f"columns already present: {sorted(clash)}")


# F14
def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


# W1
def drop_all_duplicates(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Drop *every* copy of a duplicated key (pandas ``keep=False``).

    Implemented as an anti-join against the duplicated keys (a partial
    aggregate), not a window, so a hot key never lands in one task whole.
    """
    keys = _list(key)
    dups = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(*keys)
    return df.join(dups, keys, "left_anti")


def duplicated_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """S9 input: keys that occur more than once."""
    keys = _list(key)
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


# A4
def duplicate_count(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs more than once (all copies counted) -> one row."""
    d = duplicated_keys(df, key)
    return d.agg(F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("duplicate_rows"),
                 F.count("*").alias("duplicated_keys"))


# A5
def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column as a long table ``(column, nulls)``."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "nulls")


# A6
def missing_token_counts(df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = ("",)) -> DataFrame:
    """Per column, count of values equal to one of ``tokens`` (raw strings)."""
    cols = list(cols)
    wide = df.agg(*[F.count_if(F.col(c).cast("string").isin(list(tokens))).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "missing")


# A7
def dataset_shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and columns."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


# A8
def us_vs_other_users(df: DataFrame, location: str = "location", home: str = L.HOME_COUNTRY) -> DataFrame:
    """Count of rows whose location contains ``home``; other = total - that (NULLs are "other")."""
    home_n = F.count_if(F.coalesce(F.col(location).contains(home), F.lit(False)))
    return df.agg(home_n.alias("home"), (F.count("*") - home_n).alias("other"))

