"""All queries of this subpackage."""

from rankflow.llm import queries_free, queries_native

QUERIES = {**queries_native.QUERIES, **queries_free.QUERIES}
ORACLE_SQL = {**queries_native.ORACLE_SQL, **queries_free.ORACLE_SQL}
