"""Secret scan that links the parts of a credential.

Strong patterns (``BASE``) are reported wherever they match.  Weak ones
(``WEAK``) are too common to be reported alone: a login name, a value after a
vague label, an endpoint, an opaque token.  Each part has a role (identifier,
secret or endpoint) and an interval of code points, and parts are joined by
their intervals: a weak identifier needs a secret, a weak secret an identifier,
an endpoint both, within ``REACH`` code points and within one scope, the text
between two blank lines.  A weak part that overlaps a strong one, or a weak one
of an earlier kind, is that part's and not reported.

The join makes no pairs: partners that overlap [a, b) are those that begin
before b less those that end up to a, two binary searches in sorted bounds.  A
text is one row, so its parts are joined where it is read, without a shuffle.
Documents are first sieved by Arrow's linear-time expressions; only those with
a match of a kind are searched for its places.

Defined results: a null or empty text has no spans; repeated rows are judged
alike; places are code points of the whole text, end exclusive, ordered by
begin, then by kind as listed; very long texts take time n log n.  Without rows
the result is empty.  Columns beside the named ones are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from revmine.llm.words import chunks, released

IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"
#: code points between two parts of a credential, at most
REACH = 200
SLICE = 4 << 20
#: ends of a scope
BLANK_LINE = r"\n[\x20\t\r]*\n"


def _any_case(words: str) -> str:
    """Letters of an expression in either case."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


def _assigned(labels: str, value: str) -> str:
    return rf"""({_any_case(labels)})["']?\x20*[:=]\x20*["']?({value})"""


@dataclass(frozen=True)
class Kind:
    """A pattern; ``least`` characters of ``group`` (0: the whole match) make a match a part."""

    name: str
    role: str
    pattern: str
    group: int = 0
    least: int = 1
    mixed: bool = False  # the match has a capital, a small letter and a digit


BASE = (
    Kind("assign", SECRET, _assigned("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]+"), 2, 6),
    Kind("access", IDENTIFIER, "AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", SECRET, "[0-9a-f]+", 0, 24),
)
WEAK = (
    Kind("login", IDENTIFIER, _assigned("user_?name|user_?id|user|login|account|client_?id|access_?key_?id|access_?key", "[A-Za-z0-9@._+-]+"), 2, 3),
    Kind("phrase", SECRET, _assigned("pwd|pass|passphrase|credential|private_?key|signature|auth", "[A-Za-z0-9+/_.=!@#$%^&*-]+"), 2, 4),
    Kind("endpoint", ENDPOINT, r"""(https?|ftps?|sftp|ssh|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]+"""),
    Kind("opaque", SECRET, "[A-Za-z0-9+/_-]+", 0, 20, mixed=True),
)
KINDS = (*BASE, *WEAK)
ORDER = {k.name: i for i, k in enumerate(KINDS)}


def _found(kind: Kind, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap, less those that fail the kind's condition."""
    pattern = kind.pattern
    if not kind.group and kind.pattern.endswith("+"):  # a whole run: shorter ones need not be found first
        pattern = _least(kind)
    for m in re.finditer(pattern, text):
        a, b = m.span(kind.group)
        if b - a >= kind.least and (not kind.mixed or _mixed(m[0])):
            yield m.span()


def _least(kind: Kind) -> str:
    """The pattern with its last run as long as the least match asks for."""
    head = kind.pattern[:-1]
    fixed = len(head) - len(head[head.index("["):])
    return f"{head}{{{max(1, kind.least - fixed)},}}"


def _mixed(s: str) -> bool:
    return any(c.isupper() for c in s) and any(c.islower() for c in s) and any(c.isdigit() for c in s)


def _overlap(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of the intervals (bounds sorted apart) overlap each [begin, end)."""
    return np.searchsorted(starts, end, side="left") - np.searchsorted(ends, begin, side="right")


def linked(kind: np.ndarray, begin: np.ndarray, end: np.ndarray, edges: np.ndarray, reach: int) -> np.ndarray:
    """Which parts to report: all of ``BASE``, and of ``WEAK`` those whose complement is near.

    ``edges``: ascending ends of scopes; no part reaches over one.
    """
    strong = kind < len(BASE)
    mine = strong.copy()
    for k in range(len(BASE), len(KINDS)):
        weak = kind == k
        before = kind < k
        mine[weak] = _overlap(np.sort(begin[before]), np.sort(end[before]), begin[weak], end[weak]) == 0
    role = np.array([k.role for k in KINDS])[kind]
    scope = np.searchsorted(edges, begin, side="right")
    bounds = np.concatenate([[0], edges, [np.iinfo(np.int64).max]])
    low, high = np.maximum(begin - reach, bounds[scope]), np.minimum(end + reach, bounds[scope + 1])
    near = {}
    for r in (IDENTIFIER, SECRET):
        part = mine & (role == r)
        near[r] = _overlap(np.sort(begin[part]), np.sort(end[part]), low, high) > 0
    needs = np.where(role == IDENTIFIER, near[SECRET], np.where(role == SECRET, near[IDENTIFIER], near[IDENTIFIER] & near[SECRET]))
    return strong | (mine & needs)


def _slice_spans(texts: pa.Array, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, begin, end) of the reported parts of a null-free slice, ordered by row, begin and kind."""
    rows, kinds, begins, ends = [], [], [], []
    texts_of: dict[int, str] = {}
    for k, kind in enumerate(KINDS):
        sieve = pc.match_substring_regex(texts, _least(kind) if not kind.group and kind.pattern.endswith("+") else kind.pattern)
        for i in np.flatnonzero(sieve.to_numpy(zero_copy_only=False)).tolist():
            text = texts_of.get(i)
            if text is None:
                text = texts_of[i] = texts[i].as_buffer().to_pybytes().decode("utf-8", "replace")
            for a, b in _found(kind, text):
                rows.append(i)
                kinds.append(k)
                begins.append(a)
                ends.append(b)
    row, kind, begin, end = (np.array(x, np.int64) for x in (rows, kinds, begins, ends))
    # all texts on one line, further apart than a part can reach; a text's end is a scope's
    where = np.unique(row)
    room = np.array([len(texts_of[i]) for i in where.tolist()], np.int64) + 1
    at = np.cumsum(room) - room
    shift = at[np.searchsorted(where, row)]
    edges = [int(a) + m.end() for i, a in zip(where.tolist(), at, strict=True) for m in re.finditer(BLANK_LINE, texts_of[i])]
    edges = np.sort(np.concatenate([np.array(edges, np.int64), at + room]))
    ok = linked(kind, begin + shift, end + shift, edges, reach)
    order = np.flatnonzero(ok)[np.lexsort((kind[ok], begin[ok], row[ok]))]
    return row[order], kind[order], begin[order], end[order]


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(id, spans): array of (kind, begin, end) of each whole text, one row for each row."""
    kind_of_id = docs.schema[id_col].dataType.simpleString()
    names = pa.array([k.name for k in KINDS])
    struct = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in chunks(batch.column("text"), SLICE):
                row, kind, begin, end = _slice_spans(texts, reach)
                values = pa.StructArray.from_arrays([names.take(pa.array(kind)), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], fields=list(struct))
                first = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, len(texts)), pa.ListArray.from_arrays(pa.array(first), values)], names=["id", "spans"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(released(run), f"id {kind_of_id}, spans array<struct<kind string, begin int, end int>>"))


def _written(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) of the rows of ``spans``."""
    base = F.filter("spans", lambda s: s["kind"].isin([k.name for k in BASE]))
    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(k.name) for k in BASE]
    return found.select("id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size(base)).cast("long").alias("n_linked"))
