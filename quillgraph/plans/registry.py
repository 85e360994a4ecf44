"""Registered queries of the engine and the SQL that each is compared with."""

from __future__ import annotations

from functools import wraps

from quillgraph.operators.tables import steady
from quillgraph.plans import graph_queries, retrieval_queries, vector_queries

_MODULES = (vector_queries, graph_queries, retrieval_queries)
FLAGSHIP = "q03_vector_answer"


def _steady(run):
    @wraps(run)
    def query(spark, sf_dir):
        return run(steady(spark), sf_dir)

    return query


QUERIES = {name: _steady(run) for m in _MODULES for name, run in m.QUERIES.items()}
SQL: dict[str, str] = {name: text for m in _MODULES for name, text in m.SQL.items()}
