"""Every registered query against its SQL twin on the same tables."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from registry.queries import QUERIES
from registry.sql import SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    yield con
    con.close()


def _cell(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def _sorted(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in records)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    result = duck.execute(contract.oracle_sql()[name])
    types = {c[0]: str(c[1]) for c in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    assert _sorted(df.columns, [tuple(r) for r in df.collect()]) == _sorted(list(types), result.fetchall())


@pytest.mark.parametrize("pipeline_stays", [False, True])
def test_contract_loads_without_the_corpus_operators(tmp_path, pipeline_stays):
    root = Path(contract.__file__).parent
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline_stays else ["corpus_pipeline.py"]))
    shutil.copytree(root, tmp_path / "repo", ignore=left_out)
    code = "import __spark_entry__ as e, tests.test_plans; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": "."})
    assert done.stdout.split() == [str(len(QUERIES))] * 2, done.stderr


def test_entry_has_rows_and_stable_schema(spark):
    first, second = contract.entry(spark), contract.entry(spark)
    assert first.schema == second.schema
    assert first.limit(1).count() == 1
