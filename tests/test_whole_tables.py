"""Registered queries on small tables that a cut of tokens, rows or draws would show on."""

from __future__ import annotations

import pytest

from linekin.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """One line in each of 80 documents, beside 30 lines of rare words: 80 is under 5 % of the lines."""
    path = str(tmp_path_factory.mktemp("copied"))
    rows = [(d, "\n".join(["lantern harbour meadow thistle"] + [f"w{d}x{i} v{d}x{i}" for i in range(30)]), "en", "web", 0) for d in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["rrf_neighbors", "translation_topk"])
def test_lines_with_many_copies_have_neighbours(spark, copied, name):
    assert QUERIES[name](spark, copied).select("src").distinct().count() == 80


def test_lists_of_lines_with_many_copies_are_compared(spark, copied):
    assert [r["n"] for r in QUERIES["list_overlap"](spark, copied).collect()] == [80]


def test_every_name_has_bigram_neighbours(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(i, f"steel bolt {i}") for i in range(1, 9)], "p_partkey long, p_name string").write.parquet(f"{path}/part.parquet")
    got = {(r.src, r.dst) for r in QUERIES["bigram_topk"](spark, path).collect()}
    assert got == {(str(a), str(b)) for a in range(1, 9) for b in range(1, 9) if a != b}


def test_baseline_has_the_references_200_draws(spark, sf_dir):
    assert QUERIES["theme_shuffle"](spark, sf_dir).select("rep").distinct().count() == 200
