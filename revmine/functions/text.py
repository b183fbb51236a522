"""Column-level text functions (JVM-side expressions unless noted).

Every function takes and returns ``Column`` objects so it can be used inside
``select``/``withColumn`` and stays inside whole-stage code generation.
"""

from __future__ import annotations

import functools
import string
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from revmine.functions import lexicon as L

#: texts that an accent-stripping task holds as Python strings at a time
STRIP_ROWS = 64
#: bytes of stripped texts that it hands on together
STRIP_BYTES = 1 << 20


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# X1
def fix_mojibake_apostrophe(col, to: str = L.RIGHT_QUOTE) -> Column:
    """Replace the broken UTF-8 apostrophe with ``to`` (’ in the corpus, ' in the simple loader)."""
    return F.replace(_c(col), F.lit(L.MOJIBAKE_APOSTROPHE), F.lit(to))


# X2
def collapse_ipa(col, rules=None) -> Column:
    """Apply ``(pattern, replacement)`` rewrites; default: words containing "ipa" -> "ipa".

    Like the original this also rewrites words such as "municipal".  The
    default rule only runs the regex on texts that contain "ipa" at all, and the
    match may only start at a word start, so no text is scanned quadratically.
    """
    c = _c(col)
    if rules is None:
        rewritten = F.regexp_replace(c, L.IPA_PATTERN_ANCHORED, "ipa")
        return F.when(F.lower(c).contains("ipa"), rewritten).otherwise(c)
    for pattern, repl in rules:
        c = F.regexp_replace(c, pattern, repl)
    return c


# T1
def normalise_text(col) -> Column:
    """Apostrophe repair followed by the "ipa" rule (X1 + X2)."""
    return collapse_ipa(fix_mojibake_apostrophe(col))


@functools.lru_cache(maxsize=1)
def _fold():
    return L.accent_fold_tables()


# X3
def strip_accents_ascii(col, method: str = "arrow") -> Column:
    """NFKD-then-ASCII accent stripping.

    ``method="arrow"`` (default) runs ``unicodedata`` in an Arrow-batched
    pandas UDF that gets only texts with a non-ASCII character: exact for every
    plane and, measured on the driver's documents, about 3x faster than the
    JVM variant.  ``method="jvm"`` stays inside the
    JVM (no Python worker) and is exact for the Basic Multilingual Plane.
    """
    if method == "arrow":
        # ASCII texts never reach Python
        c = _c(col)
        return F.coalesce(strip_accents_exact(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)
    return _strip_accents_jvm(col)


def _strip_accents_jvm(col) -> Column:
    """NFKD-then-ASCII accent stripping, JVM-side.

    ``translate`` folds every code point whose NFKD form keeps one ASCII
    character; rows that contain one of the rare code points folding to
    several characters (ligatures, "…", fractions) take a per-character map
    lookup (evaluated only for those rows); finally every remaining non-ASCII
    character is dropped.  Equal to ``unicodedata.normalize('NFKD', s)
    .encode('ascii', 'ignore')`` for all Basic Multilingual Plane text.
    """
    src, dst, multi = _fold()
    c = F.translate(_c(col), src, dst)
    if multi:
        has_multi = F.length(F.translate(c, "".join(multi), "")) < F.length(c)
        lookup = F.create_map(*[F.lit(x) for kv in multi.items() for x in kv])
        slow = F.array_join(
            F.transform(F.regexp_extract_all(c, F.lit("(?s)(.)"), 1),
                        lambda ch: F.coalesce(F.element_at(lookup, ch), ch)), "")
        c = F.when(has_multi, slow).otherwise(c)
    return F.regexp_replace(c, r"[^\x00-\x7F]+", "")


def _strip_accents_py(s: str | None) -> str | None:
    if s is None:
        return None
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")


def strip_accents_exact(col) -> Column:
    """Arrow-batched Python twin of :func:`strip_accents_ascii` (all planes).

    The default accent strip; the JVM variant is tested against it.  The UDF is
    made with each call: Spark keeps a handle of the JVM in a used one, and this
    module goes to Python workers by value.  A batch is converted ``STRIP_ROWS``
    texts at a time and handed on in pieces of about ``STRIP_BYTES``.
    """
    @F.arrow_udf("string")
    def stripped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            held, size = [], 0
            for lo in range(0, len(texts), STRIP_ROWS):
                held.append(pa.array([_strip_accents_py(t) for t in texts.slice(lo, STRIP_ROWS).to_pylist()], pa.string()))
                size += held[-1].nbytes
                if size >= STRIP_BYTES:
                    yield pa.concat_arrays(held)
                    held, size = [], 0
            if held or not len(texts):
                yield pa.concat_arrays([pa.array([], pa.string()), *held])

    return stripped(_c(col))


# X4
def lowercase(col) -> Column:
    return F.lower(_c(col))


# X5
def tokenise(col, pattern: str = L.THREE_LETTERS) -> Column:
    """All matches of ``pattern`` as an array (apply after lowercasing and X3)."""
    return F.regexp_extract_all(_c(col), F.lit(pattern), 0)


def clean_for_tokens(col) -> Column:
    """The corpus chain before tokenising: T1, lowercase, accent strip."""
    return strip_accents_ascii(F.lower(normalise_text(col)))


# X6
def split_sentences(col, pattern: str = L.SENTENCE_SPLIT) -> Column:
    """Split on ``; . ? !``; empty pieces (also trailing ones) are kept."""
    return F.split(_c(col), pattern, -1)


# X7
def split_sentences_regexp(col) -> Column:
    """Sentences with their trailing delimiter run (word-cloud preprocessing).

    A final "." is appended first, as the original does.
    """
    return F.regexp_extract_all(F.concat(_c(col), F.lit(".")), F.lit(L.SENTENCE_WITH_DELIMS), 0)


# X8
def word_count(col) -> Column:
    """``len(text.split())``: number of whitespace-separated words."""
    return F.size(F.filter(F.split(_c(col), r"\s+"), lambda w: w != ""))


# X9
def char_length_guard(col, limit: int = 500) -> Column:
    return F.length(_c(col)) < limit


# X10
PUNCTUATION_BUT_APOSTROPHE = string.punctuation.replace("'", "")


def remove_punctuation(col, keep: str = "'") -> Column:
    chars = "".join(ch for ch in string.punctuation if ch not in keep)
    return F.translate(_c(col), chars, " " * len(chars))


# X11
def isalpha_min_len(arr, n: int = 3, stop: list[str] | None = None) -> Column:
    """Keep alphabetic tokens of at least ``n`` letters not in ``stop``."""
    pat = r"^\p{L}{%d,}$" % n
    if stop:
        return F.filter(_c(arr), lambda x: x.rlike(pat) & ~x.isin(sorted(set(stop))))
    return F.filter(_c(arr), lambda x: x.rlike(pat))


# X14
def take_first_k(arr, k: int = 5) -> Column:
    return F.slice(_c(arr), 1, k)


# X15
def join_terms(arr, sep: str = ", ") -> Column:
    return F.array_join(_c(arr), sep)


# X16
def location_label(place, rating, attrs: list[str], sep: str = ", ") -> Column:
    """Place, rating with two decimals and the attributes that are not null, as plain text."""
    shown = F.when(_c(rating).isNotNull(), F.format_string("%.2f", _c(rating)))
    return F.concat_ws(sep, _c(place), shown, *[F.col(a) for a in attrs])


# X17
def round_half_even(col) -> Column:
    """Python's ``round``: half to even (2.5 -> 2)."""
    return F.bround(_c(col), 0)


# X18
def ngrams(arr, lo: int = 1, hi: int = 1) -> Column:
    """All n-grams for n in [lo, hi], joined by a space, within one token array.

    Order: all 1-grams, then all 2-grams, ...  Arrays shorter than n give none.
    """
    a = _c(arr)
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(a)
            continue
        m = F.size(a) - n + 1
        idx = F.when(m > 0, F.sequence(F.lit(1), F.greatest(m, F.lit(1)))).otherwise(
            F.array().cast("array<int>"))
        parts.append(F.transform(idx, lambda i: F.array_join(F.slice(a, i, n), " ")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


# X19
def capitalise(col) -> Column:
    """Python ``str.capitalize``: first letter upper, rest lower."""
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


# X12
def label_argmax(cols: list[str], labels: list[str] | None = None) -> Column:
    """Label of the largest score; ties -> leftmost; all zero -> first label."""
    labels = labels or cols
    scores = F.array(*[F.col(c).cast("double") for c in cols])
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]),
                            F.array_position(scores, F.array_max(scores)).cast("int"))
