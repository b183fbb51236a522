"""Array-valued column functions: smoothing (M4, M5), arg-max."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _divide_each(arr: Column, by: Column) -> Column:
    """Element-wise ``arr / by`` without nesting lambdas (``by`` is computed
    outside the lambda body, so no lambda variable can be captured twice)."""
    return F.zip_with(arr, F.array_repeat(by, F.size(arr)), lambda x, t: F.try_divide(x, t))


# M4
def circular_pair_smooth(arr) -> Column:
    """In-place pass ``d[i] = (d[i] + d[i+1]) / 2`` for i = 0..n-1, where the
    last element pairs with the *already updated* d[0]; then divide by the sum.

    Elements 0..n-2 use original neighbours; the last uses new d[0] =
    (d0 + d1) / 2.  A single element stays itself (then 1.0 after the division).
    """
    a = _c(arr)
    n = F.size(a)
    first_new = F.when(n > 1, (F.try_element_at(a, F.lit(1)) + F.try_element_at(a, F.lit(2))) / 2.0).otherwise(
        F.try_element_at(a, F.lit(1)))
    nxt = F.concat(F.slice(a, 2, F.greatest(n - 1, F.lit(0))), F.array(first_new))
    sm = F.zip_with(a, nxt, lambda x, y: (x + y) / 2.0)
    total = F.aggregate(sm, F.lit(0.0), lambda acc, x: acc + x)
    return _divide_each(sm, total)


# M5
def circular_triple_smooth(arr) -> Column:
    """``(d[i-1] + d[i] + d[i+1]) / 3`` with circular neighbours, then / max."""
    a = _c(arr)
    n = F.size(a)
    prev = F.concat(F.slice(a, -1, 1), F.slice(a, 1, F.greatest(n - 1, F.lit(0))))
    nxt = F.concat(F.slice(a, 2, F.greatest(n - 1, F.lit(0))), F.slice(a, 1, 1))
    sm = F.zip_with(F.zip_with(prev, a, lambda x, y: x + y), nxt, lambda s, z: (s + z) / 3.0)
    return _divide_each(sm, F.array_max(sm))


# X13
def dominant_topic(topics, id_field: str = "topic", prob_field: str = "prob") -> Column:
    """Id of the (topic, prob) struct with the highest prob; first on ties."""
    t = _c(topics)
    probs = F.transform(t, lambda s: s[prob_field])
    return F.try_element_at(t, F.array_position(probs, F.array_max(probs)).cast("int"))[id_field]
