"""All registered queries of the analytics operators and their SQL."""

from __future__ import annotations

from . import call_queries, detail_queries, ledger_queries, stream_queries, table_queries, tree_queries

FLAGSHIP = "bill_reconciliation"
_ALL = {**call_queries.QUERIES, **ledger_queries.QUERIES, **table_queries.QUERIES, **tree_queries.QUERIES, **detail_queries.QUERIES, **stream_queries.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
