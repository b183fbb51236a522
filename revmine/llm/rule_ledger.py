"""Quality rules: a ledger of rule bits and measurements (DataFrame functions only).

Every rule is evaluated once for each text.  The ledger keeps the measurements
and one bit for each rule that a text fails.  A *policy* is a versioned set of
rules, held as a bit mask, so any policy is applied to a stored ledger by one
bitwise AND, and ablations (what a policy would keep without one of its rules)
are sums over bits, without reading a text again.

Words are runs without ASCII white space.  A word is *repeated* if it lies in a
window of five words that the text holds twice or more; windows are compared by
64-bit hashes.  Defined results: a null or empty text has no words, every
measurement is 0 and the rule ``few_words`` fails; shares of nothing do not
fail; repeated rows have a ledger row each; an empty table gives an empty
ledger.  Columns beside the named ones are never read by a rule, and filtering
returns the input's columns whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 5
_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"

#: rule -> (bit, whether a text with the measurements m fails it)
RULES = {
    "few_words": (0, lambda m: m["n_words"] < 10),
    "repeated_words": (1, lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    "symbols": (2, lambda m: 100 * m["n_symbols"] > 10 * m["word_chars"]),
    "repeated_lines": (3, lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    "short_words": (4, lambda m: m["word_chars"] < 2 * m["n_words"]),
    "long_words": (5, lambda m: m["word_chars"] > 30 * m["n_words"]),
}


@dataclass(frozen=True)
class Policy:
    """A version and the rules it applies."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in self.rules)

    def accepts(self, bits: Column) -> Column:
        return bits.bitwiseAND(F.lit(self.mask).cast("long")) == 0


BASE = Policy("base-1", ("few_words", "repeated_words"))
PRODUCTION = Policy("production-1", tuple(RULES))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column) -> Column:
    """One hash for each window of five words, in text order (empty for fewer words)."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashed = _let(F.transform(words, lambda w: F.xxhash64(w)),
                  lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    return F.when(F.size(words) >= WINDOW, hashed).otherwise(F.array().cast("array<long>"))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more (called for texts that have some)."""
    ranked = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    again = _let(ranked, lambda s: F.array_sort(F.transform(
        F.filter(s, lambda x, k: (x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"])), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(again, start, lambda a, i: F.struct(
        (a["n"] + i + WINDOW - F.greatest(i, a["reach"])).alias("n"), (i + WINDOW).alias("reach")), lambda a: a["n"])


def measured(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with a struct column ``out`` of the measurements of ``text_col``."""
    w, v = f"{out}_w", f"{out}_v"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    step = docs.withColumn(w, words)
    step = step.withColumn(v, _windows(F.col(w)))
    repeated = F.when(F.size(F.array_distinct(v)) < F.size(v), _covered(F.col(v))).otherwise(0)
    m = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"))
    return step.withColumn(out, m).drop(w, v)


def fail_bits(m: Column) -> Column:
    """One bit for each failed rule."""
    out = F.lit(0).cast("long")
    for bit, fails in RULES.values():
        out = out + F.when(fails(m), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
    return out


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, fail_bits) of every row; store it to apply policies later."""
    rows = measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "m")
    rows = rows.select("id", "m").withColumn("fail_bits", fail_bits(F.col("m")))
    return rows.select("id", "m.*", "fail_bits")


def verdicts(rows: DataFrame, policy: Policy, base: Policy = BASE) -> DataFrame:
    """A ledger with ``base_failed`` and ``kept`` under a policy (kept needs both)."""
    bits = F.col("fail_bits")
    return rows.withColumn("base_failed", ~base.accepts(bits)).withColumn("kept", base.accepts(bits) & policy.accepts(bits))


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does: (version, rule, n_failed, n_only, n_kept, n_kept_without).

    ``n_only``: rows rejected by this rule alone, which the policy would keep without it.
    """
    held = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(held == 0).alias("kept")]
    for r in policy.rules:
        bit = F.lit(1 << RULES[r][0]).cast("long")
        sums += [F.count_if(held.bitwiseAND(bit) != 0).alias(f"f_{r}"), F.count_if(held == bit).alias(f"o_{r}")]
    one = rows.agg(*sums)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only")) for r in policy.rules])
    return one.select("kept", F.inline(each)).select(
        F.lit(policy.version).alias("version"), "rule", "n_failed", "n_only", F.col("kept").alias("n_kept"), (F.col("kept") + F.col("n_only")).alias("n_kept_without"))


def accept(docs: DataFrame, policy: Policy = PRODUCTION, *, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the policy (and the base) keeps, columns unchanged, judged where they are."""
    name = "_rules"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = "_" + name
    bits = fail_bits(F.col(name))
    rows = measured(docs, text_col, name).where(policy.accepts(bits) & BASE.accepts(bits))
    return rows.select(*[f"`{c.replace('`', '``')}`" for c in docs.columns])
