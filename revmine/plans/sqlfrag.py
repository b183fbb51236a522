"""SQL fragments shared by the DuckDB oracles (the SQL twins of our columns)."""

from __future__ import annotations

from collections.abc import Sequence

from revmine.functions import lexicon as L


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def values(words: Sequence[str], col: str = "term") -> str:
    """``(VALUES ('a'), ('b')) AS t(col)`` for a word list."""
    rows = ", ".join(f"({q(w)})" for w in sorted(set(words)))
    return f"(SELECT * FROM (VALUES {rows}) AS v({col}))"


def in_list(words: Sequence[str]) -> str:
    return "(" + ", ".join(q(w) for w in sorted(set(words))) + ")"


def normalise(expr: str) -> str:
    """Apostrophe repair + "ipa" rule."""
    fixed = f"replace({expr}, {q(L.MOJIBAKE_APOSTROPHE)}, {q(L.RIGHT_QUOTE)})"
    return f"regexp_replace({fixed}, {q(L.IPA_PATTERN)}, 'ipa', 'g')"


def clean(expr: str) -> str:
    """T1 -> lower -> NFKD accent strip -> drop non-ASCII."""
    return f"regexp_replace(strip_accents(lower({normalise(expr)})), '[^\\x00-\\x7F]', '', 'g')"


def tokens(expr: str, pattern: str = L.THREE_LETTERS) -> str:
    return f"regexp_extract_all({expr}, {q(pattern)})"
