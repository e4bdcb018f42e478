"""Nearest vectors of tables with repeated rows and with skewed lengths, against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from linekin.llm import ann


def recall(spark, rows, ids, x):
    table = spark.createDataFrame([(int(i), v) for i, v in rows], "vec_id long, embedding array<double>")
    by = {}
    for g in ann.nearest(table, F.col("vec_id") % 20 == 0, 20).collect():
        by.setdefault(g.query_id, []).append(g.vec_id)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q].T
        s = np.array([s[ids == i].max() if i != q else -np.inf for i in np.unique(ids)])
        want = set(np.unique(ids)[np.lexsort((np.unique(ids), -s))[:20]].tolist())
        assert len(by[q]) == len(set(by[q])) == 20
        hits += len(want & set(by[q]))
        total += 20
    return hits / total


def test_repeated_rows_take_one_place(spark):
    x = np.random.default_rng(3).standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(1000)
    assert recall(spark, [*zip(ids, x.tolist(), strict=True)] * 20, ids, x) >= 0.95


def test_longer_vectors_are_found(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 100
    ids = np.arange(2000)
    assert recall(spark, list(zip(ids, x.tolist(), strict=True)), ids, x) >= 0.95
    x *= np.exp(0.5 * r.standard_normal((2000, 1)))
    assert recall(spark, list(zip(ids, x.tolist(), strict=True)), ids, x) >= 0.95


def test_ids_that_repeat_or_are_null(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.8]), (None, [5.0, 5.0]), (3, [0.0, 0.2]), (3, [0.3, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(table, F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(x.query_id, x["rank"], x.vec_id, round(x.score, 9)) for x in got] == [(0, 1, 1, 0.9), (0, 2, 2, 0.8), (0, 3, 3, 0.3)]
