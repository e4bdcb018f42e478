"""The registered line dedup's own edit threshold."""

from __future__ import annotations

from linekin.llm import lines


def test_lines_two_edits_apart_are_repeats(spark):
    line = "The council met on the 14th of March to vote on the harbour plan"
    texts = [line, line.replace("14th", "25th"), line.replace("14th", "9th") + "!!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_removed"] for r in lines.without_repeats(docs).orderBy("doc_id").collect()] == [0, 1, 0]
