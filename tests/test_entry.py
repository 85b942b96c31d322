import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from textloom import catalog

ROOT = Path(__file__).resolve().parents[1]


def test_registered_queries_have_their_oracles():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(catalog.queries()) > 55


def test_nothing_else_imports_the_training_data_operators():
    for f in ROOT.glob("textloom/**/*.py"):
        if "llm" in f.parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(part == "llm" for n in names for part in n.split(".")), f


@pytest.mark.parametrize("name", ["merge_upsert", "vector_topk", "fuse_quota_diversity", "link_ladder", "rate_limit_accept", "hybrid_rrf"])
def test_against_the_oracle(spark, data, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in Path(data).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    r = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(repr(tuple(r(x[c]) for c in cols)) for x in df.collect())
    want = sorted(repr(tuple(r(v) for v in x)) for x in con.sql(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall())
    assert got == want


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
