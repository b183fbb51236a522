"""F8 without a language column: naive Bayes over character n-grams.

A text is its lowercase letters, words between single spaces (one before the
first and one behind the last).  Its n-grams of 1 to 4 characters are counted
in Arrow tasks and added up by Spark; the model keeps the ``max_grams`` most
frequent (ties by the gram) with add-one log probabilities for each language,
and is fitted on at most ``max_docs`` labelled texts, the first by a hash of
the text.  Scoring looks n-grams up by vectorised binary search, so a text costs
one pass and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_GRAM = 4
#: bytes of text that a task looks at together (one text at least)
SLICE = 1 << 20
_BITS = 15  # a character's number in a key; four of them and a gram's length fit 63 bits


def letters(text: str | Column) -> Column:
    """The text that n-grams are taken of; empty without a letter."""
    c = F.col(text) if isinstance(text, str) else text
    words = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}]+", " "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each begins and the end)."""
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.concatenate([[0], np.cumsum(size)])


def _keys(numbers: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of every n-gram; ``numbers``: 1 to 2^15 - 1 for a known character, else 0, which no gram holds."""
    if len(numbers) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, whole = np.full(len(numbers) - n + 1, n, np.int64), np.ones(len(numbers) - n + 1, bool)
    for k in range(n):
        part = numbers[k:len(numbers) - n + 1 + k]
        key = key << _BITS | part
        whole &= part > 0
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole &= text[:len(key)] == text[n - 1:]
    return key[whole], text[:len(key)][whole]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > SLICE:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, gram, n)`` over all texts; each task adds up a slice's grams before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = (batch.column(c).to_pylist() for c in ("lang", "text"))
            for one in sorted(set(langs)):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == one]
                for lo, hi in _slices(mine):
                    points, at = _characters(mine[lo:hi])
                    alphabet, numbers = np.unique(points, return_inverse=True)
                    if len(alphabet) >= 1 << _BITS:
                        raise ValueError("a slice of text has too many different characters")
                    for n in range(1, MAX_GRAM + 1):
                        key, times = np.unique(_keys(numbers + 1, at, n)[0], return_counts=True)
                        parts = [(key >> _BITS * (n - 1 - k)) & ((1 << _BITS) - 1) for k in range(n)]
                        chars = alphabet[np.stack(parts, axis=1) - 1] if len(key) else np.zeros((0, n), "<u4")
                        spelled = [r.tobytes().decode("utf-32-le", "surrogatepass") for r in chars.astype("<u4")]
                        yield pa.RecordBatch.from_arrays([pa.array([one] * len(key), pa.string()), pa.array(spelled, pa.string()), pa.array(times, pa.int64())],
                                                         names=["lang", "gram", "n"])

    rows = df.select(F.col(lang).cast("string").alias("lang"), letters(text).alias("text")).where("lang is not null and text <> ''")
    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageModel:
    """Languages in name order, their log priors, and log probabilities of the grams that the model knows."""

    languages: list[str]
    prior: np.ndarray
    alphabet: np.ndarray  # code points
    keys: np.ndarray      # of the grams, ascending
    weights: np.ndarray   # a row for each gram, a column for each language

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log probability of each text and language, up to a constant."""
        out = np.tile(self.prior, (len(texts), 1))
        for lo, hi in _slices(texts):
            points, at = _characters(texts[lo:hi])
            where = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
            numbers = np.where(self.alphabet[where] == points, where + 1, 0)
            for n in range(1, MAX_GRAM + 1):
                key, text = _keys(numbers, at, n)
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[i] == key
                for k in range(len(self.languages)):
                    out[lo:hi, k] += np.bincount(text[known], weights=self.weights[i[known], k], minlength=hi - lo)
        return out

    def guess(self) -> Callable[[Column], Column]:
        """Column function: the likeliest language of a prepared text, NULL for an empty one."""
        model = self

        @F.pandas_udf("string")
        def likeliest(texts: pd.Series) -> pd.Series:
            plain = texts.fillna("").tolist()
            best = model.scores(plain).argmax(axis=1) if plain else []
            return pd.Series([model.languages[b] if t else None for t, b in zip(plain, best, strict=True)], dtype=object)

        return likeliest


def fit_language_model(df: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = 20_000, max_grams: int = 50_000) -> LanguageModel:
    """Naive Bayes model of the labelled texts; texts without letters and without a language are left out.

    ``max_docs`` texts at most are counted; ``max_grams`` rows for each language
    reach the driver and are later sent to the tasks.
    """
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where((letters("text") != "") & F.col("lang").isNotNull())
    cut = rows.select(F.xxhash64("text", "lang").alias("h")).orderBy("h").limit(max_docs).agg(F.max("h")).scalar()
    sample = rows.where(F.xxhash64("text", "lang") <= cut)
    docs = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}  # a row for each language
    if not docs:
        raise ValueError("no labelled text to learn a language from")
    languages = sorted(docs)
    counts = gram_counts(sample, "text", "lang")
    known = (counts.groupBy("gram").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))  # a row for each language
             .orderBy(F.desc("total"), "gram").limit(max_grams).select("gram", *[F.coalesce(F.try_element_at("by", F.lit(x)), F.lit(0)).alias(f"n{i}") for i, x in enumerate(languages)]))
    got = known.toPandas()
    grams = got["gram"].tolist()
    points, at = _characters(grams)
    alphabet = np.unique(points)
    if len(alphabet) >= 1 << _BITS:
        raise ValueError("the model has too many different characters; lower max_grams")
    numbers = np.searchsorted(alphabet, points) + 1
    key = np.array([_key(numbers[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
    n = got[[f"n{i}" for i in range(len(languages))]].to_numpy(np.float64)
    weights = np.log(n + 1) - np.log(n.sum(axis=0) + len(grams))
    order = np.argsort(key)
    prior = np.log(np.array([docs[x] for x in languages]) / sum(docs.values()))
    return LanguageModel(languages, prior, alphabet, key[order], weights[order])


def _key(numbers: np.ndarray) -> int:
    key = len(numbers)
    for k in numbers.tolist():
        key = key << _BITS | k
    return key


def detect_language(df: DataFrame, text: str, model: LanguageModel, out: str = "lang_guess") -> DataFrame:
    """Adds the likeliest language of each text (first name on ties); NULL for a text without letters.

    A text of letters that the model never saw takes the commonest language.
    """
    return df.withColumn(out, model.guess()(letters(text)))
