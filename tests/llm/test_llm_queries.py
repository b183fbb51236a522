"""Registered queries against their SQL, and the entry module with and without the subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from llm_fixtures import SF001, SF01, no_docs, odd  # noqa: F401
from revmine.llm import queries as Q

TABLES = "documents pages benchmark labels conversations".split()
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("sf", [SF001, SF01])
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = Q.QUERIES[name](spark, sf)
    rel = con.sql(Q.ORACLES[name])
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert sorted((c, kinds[k]) for c, k in df.dtypes) == sorted(zip(rel.columns, map(str, rel.types), strict=True))
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(rel.columns, rel.fetchall())


def test_all_operators_are_registered():
    names = E.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names


def test_the_rest_imports_without_the_subpackage(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 100 and not any(k.startswith('op1_') or k == 'pipeline' for k in n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})


def test_a_library_that_only_the_subpackage_needs_may_be_missing():
    hide = "import sys; sys.modules.update({'public_tokenizers': None, 'xxhash': None, 'regex': None, 'tokenizers': None, 'ahocorasick': None});"
    code = hide + "import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; n = e.queries(); assert len(n) > 100 and 'pipeline' not in n and set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, env={**os.environ, "PYTHONPATH": REPO})
