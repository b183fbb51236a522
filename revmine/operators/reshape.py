"""Reshapes (P1-P6) and word chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revmine.functions import text as X
from revmine.operators.text import doc_term_long, melt_attributes, pivot_ranks  # noqa: F401  (P1, P2, P5)


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# P3
def explode_topics(df: DataFrame, topics: str = "topics", keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, topic): ``keep..., topic, prob``."""
    return df.select(*_list(keep), F.inline(F.col(topics)))


# P4
def explode_sentences(df: DataFrame, text: str, keep: Sequence[str] = (), out: str = "sentence",
                      index: str = "sentence_idx") -> DataFrame:
    """One row per ``; . ? !`` chunk (empty chunks kept, like the original)."""
    return df.select(*_list(keep), F.posexplode(X.split_sentences(F.col(text))).alias(index, out))


# P6
def collect_by_entity(df: DataFrame, entity: str, order: str, keep: Sequence[str] = ()) -> DataFrame:
    """Reviews "grouped by entity" kept flat: ``entity, order, keep..., position``.

    The original built a dict of lists; one list per entity would put a hot
    entity into one row, so the grouping is a position within the entity.
    """
    from revmine.operators.window import position_in_group

    return position_in_group(df.select(entity, order, *_list(keep)), [entity], [order], "position")


# X20
def chunk_words(df: DataFrame, text: str, n: int = 750, max_chars: int | None = None,
                keep: Sequence[str] = (), out: str = "chunk") -> DataFrame:
    """Split a text into chunks of ``n`` whitespace words (joined by a space);
    ``max_chars`` cuts each chunk, for scorers with an input limit."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(n))).otherwise(
        F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda s: F.array_join(F.slice(words, s, n), " "))
    if max_chars is not None:
        chunks = F.transform(chunks, lambda c: F.substring(c, 1, max_chars))
    return df.select(*_list(keep), F.posexplode(chunks).alias("chunk_idx", out))
