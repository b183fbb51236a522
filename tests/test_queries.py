"""Registered queries: smoke at sf0.001 and a DuckDB oracle sample at sf0.01."""

import duckdb
import pytest

import __spark_entry__ as E
from revmine.plans.catalog import TABLES

from conftest import SF001, SF01
from tools.check_oracle import norm as _norm, same_type

ORACLE_SAMPLE = ["top_terms_per_entity", "criticisms_per_entity", "enrich_with_review_stats", "histogram",
                 "spearman", "score_emotions", "read_review_blocks", "topic_emotion_distribution",
                 "stream_review_stats", "top_attributes_by"]


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    out = df.collect()
    assert len(out) > 0 and df.columns == ["source", "rank", "term", "tfidf"]


def test_every_query_has_an_oracle_or_is_known():
    rows_only = {"lda_topics", "lda_topic_terms", "write_topics",
                 "complaints_by_topic", "stem",
                 "lemmatise_in_context", "clean_tokens_in_context", "word_classes", "classify_terms",
                 "topics_of_unseen"}
    missing = set(E.QUERIES) - set(E.ORACLES)
    assert missing == rows_only


def _duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def duck():
    return _duck(SF01)


@pytest.fixture(scope="module")
def small_duck():
    return _duck(SF001)


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_oracle_sample(spark, duck, name):
    df = E.queries()[name](spark, SF01)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(E.QUERIES) - set(ORACLE_SAMPLE)))
def test_query_equals_its_oracle_at_smoke_scale(spark, small_duck, name):
    """Values, names and types of every query (rows alone for the few without SQL)."""
    df = E.QUERIES[name](spark, SF001)
    got = [tuple(r) for r in df.collect()]
    if name not in E.ORACLES:
        return
    rel = small_duck.sql(E.ORACLES[name])
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert sorted(df.columns) == sorted(rel.columns)
    assert [(c, k, kinds[c]) for c, k in df.dtypes if not same_type(k, kinds[c])] == []
    assert _canon(df.columns, got) == _canon(rel.columns, rel.fetchall())


def test_lda_is_seeded_deterministic(spark):
    from revmine.operators import topics as TP
    from revmine.plans import catalog as C

    docs = C.reviews(spark, SF01, "en").select("source", "text")

    def run():
        t, _ = TP.lda_topics(docs, "source", "text", k=3, max_iter=5, seed=7)
        return sorted((r["source"], tuple((x["topic"], round(x["prob"], 6)) for x in r["topics"])) for r in t.collect())

    a, b = run(), run()
    assert a == b and len(a) == 20
    assert all(abs(sum(p for _, p in mix) - 1.0) < 0.05 for _, mix in a)


def test_import_needs_no_session():
    """pyspark from its zip and no session, as a driver may have it."""
    import glob
    import os
    import subprocess
    import sys

    import pyspark

    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    path = [*sorted(glob.glob(os.path.join(lib, "*.zip")), reverse=True), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]
    code = "import pyspark, __spark_entry__ as e; assert 'zip' in pyspark.__file__; assert len(e.queries()) > 150 and len(e.oracle_sql()) > 140"
    subprocess.run([sys.executable, "-c", code], check=True, env={**os.environ, "PYTHONPATH": os.pathsep.join(path)})


def test_no_shared_folder_on_a_cluster(spark):
    from revmine import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
