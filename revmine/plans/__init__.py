"""Named queries over the driver's tables, each paired with a DuckDB oracle."""

from revmine.plans import (  # noqa: F401  (importing registers the queries)
    function_queries,
    named_queries,
    relational_queries,
    scoring_queries,
    source_queries,
    split_queries,
    stream_queries,
    text_queries,
    topic_queries,
    vector_queries,
)
from revmine.plans.registry import BENCH, ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "BENCH"]
