"""Registered queries against their DuckDB oracles, on the smallest tables."""

from __future__ import annotations

import math
import sys

import duckdb
import pytest

import __spark_entry__
from linekin.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()



def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["src", "rank", "dst", "score", "mtype"]
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


def test_entry_without_the_training_data_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("linekin.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "linekin.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(SQL)


def test_references_that_are_cut_off_stay(spark, tmp_path):
    pages = [(1, "<title>the&&&amp</title>&amp;lt; &nbsp;"), (2, "?a=1&copy=2 &copy; &amp;copy; &am"), (3, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted((r.page_id, r.n_chars, r.text_md5) for r in QUERIES["html_decode"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(SQL["html_decode"]).fetchall())


def test_names_with_many_copies_match_the_sql(spark, tmp_path, monkeypatch):
    """200 copies of 3 names and single ones that tie; names are compared once, not each copy."""
    from linekin.operators import dense

    seen = []
    exact = dense.exact_neighbours
    monkeypatch.setattr(dense, "exact_neighbours", lambda rows, *a, **b: seen.append(rows.count()) or exact(rows, *a, **b))
    names = [["steel bolt", "steel  Bolt", "steel bolts", "brass ring", "copper wire"][i % 5] if i < 200 else f"steel bolt {i % 40}" for i in range(300)]
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    got = sorted((r.src, r["rank"], r.dst, round(r.score, 6)) for r in QUERIES["bigram_topk"](spark, str(tmp_path)).collect())
    assert got == sorted((a, b, c, round(d, 6)) for a, b, c, d in con.sql(SQL["bigram_topk"]).fetchall())
    assert seen == [len({" ".join(n.lower().split()) for n in names})]
