"""Registered queries against their SQL on the smallest tables; the driver compares all of them on larger ones."""

import glob
import os

import duckdb
import pytest

from quillgraph.plans import registry

DATA = "/root/testdata/sf0.001"
QUICK = ("q01_vector_topk", "q04_chunk_documents", "q12_identifier_parts", "q14_rrf_fusion", "q24_expand_1hop", "q31_offline_extract_edges", "q43_hierarchy_select", "q53_drift_candidates", "q61_compare_stats", "q62_evidence_matrix", "q69_trace_branches")


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    cur = tables.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall())


def test_every_query_is_callable_and_sql_has_a_query():
    assert registry.FLAGSHIP in registry.QUERIES
    assert set(registry.SQL) <= set(registry.QUERIES)
