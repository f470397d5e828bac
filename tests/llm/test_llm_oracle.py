"""Every query of the subpackage that SQL can express, against DuckDB."""

import importlib.util
import os

import pytest

from rankflow.llm import queries

_spec = importlib.util.spec_from_file_location("engine_oracle", os.path.join(os.path.dirname(__file__), "..", "test_oracle.py"))
_engine = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_engine)


@pytest.mark.skipif(not os.path.isdir(_engine.DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    _engine.held_against_sql(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name])
