"""Approximate nearest neighbours by cross-polytope hashing, for the largest inner product.

Index. Vectors are dealt in ranges by norm, each ``RATIO`` of the one before, the last one open; a range hashes directions
only, so no length has to be hidden in a coordinate. Each of ``TABLES`` tables turns them by three rounds of random signs and
fast Walsh-Hadamard transforms and takes the nearest signed axis as the bucket. All vectors are indexed.

Search. First the ``FIRST`` nearest buckets of one table in each range give each query a lower bound for the score of its
last neighbour. A vector of a range reaches that bound only from some cosine on, the bound over the query's norm and the
range's largest. Each range is then probed by as many axes, ``PROBES`` at least, as find a pair of that cosine with
``CHANCE`` (drawn for random pairs, in ``probes_for``); a range whose vectors cannot reach the bound is left out, and one for
which every axis is due, or a query without a bound, is compared whole in one table. Buckets are packed into parts of at most
about ``PART`` vectors, a larger bucket is split by a hash of the id, so no task holds an unbounded group. Every part
hands on at most ``k`` candidates a query, only those that reach the bound. Candidates are ranked by the inner
product of the original vectors in double precision, ties by the smaller id.

Recall against brute force, measured on the test tables: see the README; the parameters are those it was measured with.

Vectors that are null, zero or hold null or non-finite components take no part (see ``valid_vectors``): as queries they
have no rows, nor have ids that are null. A query with fewer candidates than k has fewer rows. Repeated ids are one query
each, and one of the k places each; rows of one id that differ are one query and one candidate with the best of their scores. Extra columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linekin.llm.common import stored
from linekin.llm.vectors import unpacked, valid_vectors

TABLES, PROBES, FIRST = 6, 24, 4
#: Ranges of norm, the factor between them, and the wanted chance to find a vector that just reaches the bound.
RANGES, RATIO, CHANCE = 32, 1.25, 0.98
PART = 4096
#: Queries whose scores against a part are held at once.
QUERY_ROWS = 1024
SLACK = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def turned(x: np.ndarray, table: int) -> np.ndarray:
    draw = np.random.default_rng(9000 + table)
    for _ in range(3):
        x = hadamard(x * draw.choice([-1.0, 1.0], x.shape[1]))
    return x


def directions(x: np.ndarray) -> np.ndarray:
    """Rows of length one, filled up to a power of two."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = x / np.abs(x).max(1)[:, None]  # squares of very long or short rows stay finite
    return np.pad(x / np.sqrt((x * x).sum(1))[:, None], ((0, 0), (0, width - x.shape[1])))


def probes_for(width: int, tables: int, pairs: int = 2000) -> np.ndarray:
    """For cosines 0, 0.02 ... 1: how many axes a query probes to find a vector of that cosine with ``CHANCE``."""
    draw = np.random.default_rng(77)
    x, n = draw.standard_normal((2, pairs, width))
    x /= np.sqrt((x * x).sum(1))[:, None]
    n -= (n * x).sum(1)[:, None] * x
    n /= np.maximum(np.sqrt((n * n).sum(1)), 1e-12)[:, None]
    out = []
    for c in np.linspace(0, 1, 51):
        code = axes(c * x + np.sqrt(1 - c * c) * n, 1)[:, 0]
        held = np.concatenate([x, -x], 1)
        before = (held > held[np.arange(pairs), code][:, None]).sum(1)
        out.append(int(np.quantile(before, 1 - (1 - CHANCE) ** (1 / tables), method="higher")) + 1)
    return np.maximum.accumulate(np.array(out)[::-1])[::-1]


def axes(x: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` signed axes nearest to each row, nearest first: k, or k + width for the negative axis."""
    both = np.concatenate([x, -x], 1)
    if count == 1:
        return both.argmax(1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :count]


def parts(sizes: dict[tuple[int, int], int], tables: int, buckets: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(first part, number of parts) of each (table, bucket); tables never share a part."""
    out, number = {}, 0
    for t in range(tables):
        filled = 0
        for b in range(buckets):
            size = sizes.get((t, b), 0)
            if size > PART:
                number += filled > 0
                split = -(-size // PART)
                out[t, b] = (number, split)
                number, filled = number + split, 0
                continue
            if filled + size > PART:
                number, filled = number + 1, 0
            out[t, b] = (number, 1)
            filled += size
        number += 1
    return out


def nearest(table: DataFrame, is_query: Column, k: int = 20, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` holds."""
    valid = valid_vectors(table, column)
    known = valid.agg(F.max("norm").alias("top"), F.max("dims").alias("dims")).first()
    if known["dims"] is None:
        return valid.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("norm").alias("score"))
    top, dims = float(known["top"]), int(known["dims"])
    width = 1 << max(1, (dims - 1).bit_length())
    steps = F.floor((F.log(F.lit(top)) - F.log("norm")) / F.log(F.lit(RATIO)))
    valid = valid.withColumn("range", F.least(F.greatest(steps, F.lit(0)), F.lit(RANGES - 1)).cast("int"))
    # At most RANGES rows: ranges that hold vectors, numbered from the longest on.
    found_ranges = valid.groupBy("range").agg(F.max("norm").alias("most")).orderBy("range").collect()
    number = {r["range"]: i for i, r in enumerate(found_ranges)}
    most = np.array([r["most"] for r in found_ranges])
    axes_all, buckets = 2 * width, 2 * width * len(most)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.array([number[r] for r in batch.column(2).to_pylist()], np.int64) * axes_all
            x = directions(unpacked(batch.column(1), dims)) if batch.num_rows else None
            for t in range(TABLES if batch.num_rows else 0):
                codes = first + axes(turned(x, t), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(codes, pa.int32()), batch.column(0), batch.column(1)], names=["t", "bucket", "vec_id", "vec"])

    index = stored(valid.dropDuplicates(["vec_id", "vec"]).select("vec_id", "vec", "range").mapInArrow(hashed, "t int, bucket int, vec_id long, vec binary"), "buckets")
    # At most TABLES * RANGES * 2 * width counts come to the driver.
    sizes = {(r["t"], r["bucket"]): r["count"] for r in index.groupBy("t", "bucket").count().toLocalIterator()}
    place = parts(sizes, TABLES, buckets)
    at = F.col("t") * buckets + F.col("bucket") + 1

    def looked_up(which: int) -> Column:
        numbers = ",".join(str(place[t, b][which]) for t in range(TABLES) for b in range(buckets))
        return F.element_at(F.split(F.lit(numbers), ",").cast("array<int>"), at)  # one literal, folded once

    index = index.withColumn("part", looked_up(0) + F.pmod(F.xxhash64("vec_id"), looked_up(1)).cast("int")).select("part", "t", "bucket", "vec_id", "vec")
    queries = valid.where(is_query).dropDuplicates(["vec_id", "vec"])
    due = np.minimum(np.maximum(probes_for(width, TABLES), PROBES), axes_all)

    def probing(tables: int, probes: int | None):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = directions(unpacked(batch.column(1), dims))
                if probes is None:
                    # The least cosine of a vector of each range that reaches the bound; over one: none does.
                    least = batch.column(2).to_numpy()[:, None] / batch.column(3).to_numpy()[:, None] / most
                    count = np.where(least < 0, axes_all, due[np.clip(np.floor(least * 50), 0, 50).astype(int)])
                    count[least > 1 + 1e-6] = 0
                else:
                    count = np.full((len(x), len(most)), min(probes, axes_all))
                to: dict[int, list[int]] = {}
                wanted: dict[int, list[list[int]]] = {}
                for t in range(tables):
                    for q, near in enumerate(axes(turned(x, t), axes_all if probes is None else probes).tolist()):
                        by_part: dict[int, list[int]] = {}
                        for r, n in enumerate(count[q].tolist()):
                            if n == axes_all and t:
                                continue  # the first table has compared the whole range
                            for b in near[:n]:
                                b += r * axes_all
                                if (t, b) not in sizes:
                                    continue
                                first, split = place[t, b]
                                for p in range(first, first + split):
                                    by_part.setdefault(p, []).append(b)
                        for p, some in by_part.items():
                            to.setdefault(p, []).append(q)
                            wanted.setdefault(p, []).append(some)
                for p, rows in to.items():
                    take = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.int32()), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(wanted[p], pa.list_(pa.int32()))], names=["part", "query_id", "vec", "bound", "near"])

        return run

    def search(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and asked.num_rows:
            bucket = vectors.column("bucket").to_numpy()
            order = np.argsort(bucket, kind="stable")
            bucket, ids, x = bucket[order], vectors.column("vec_id").to_numpy()[order], unpacked(vectors.column("vec"), dims)[order]
            by_id = np.argsort(ids, kind="stable")
            id_starts = np.flatnonzero(np.append(True, ids[by_id][1:] != ids[by_id][:-1]))
            for first in range(0, asked.num_rows, QUERY_ROWS):
                some = asked.slice(first, QUERY_ROWS)
                names, q, bound = some.column("query_id").to_numpy(), unpacked(some.column("vec"), dims), some.column("bound").to_numpy()
                near = some.column("near").to_pylist()
                by_bucket: dict[int, list[int]] = {}
                for row, own in enumerate(near):
                    for b in own:
                        by_bucket.setdefault(b, []).append(row)
                score = np.full((len(q), len(x)), -np.inf)
                for b, rows in by_bucket.items():
                    lo, hi = np.searchsorted(bucket, b, "left"), np.searchsorted(bucket, b, "right")
                    if hi > lo:
                        score[rows, lo:hi] = q[rows] @ x[lo:hi].T
                score[names[:, None] == ids[None]] = -np.inf
                best = np.maximum.reduceat(score[:, by_id], id_starts, axis=1)  # the k places count ids, not rows
                if best.shape[1] > k:
                    last = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k]
                else:
                    last = np.full(len(q), -np.inf)
                row, col = np.nonzero((score >= np.maximum(last, bound)[:, None] - SLACK) & (score > -np.inf))
                exact = (q[row] * x[col]).sum(1)
                order2 = np.lexsort((ids[col], -exact, row))
                row, col, exact = row[order2], col[order2], exact[order2]
                once = np.lexsort((-exact, ids[col], row))  # the best row of each id
                again = np.zeros(len(row), bool)
                again[once[1:]] = (row[once][1:] == row[once][:-1]) & (ids[col[once]][1:] == ids[col[once]][:-1])
                row, col, exact = row[~again], col[~again], exact[~again]
                place_in = np.arange(len(row)) - np.searchsorted(row, row, "left")
                keep = place_in < k
                out.append((names[row[keep]], ids[col[keep]], exact[keep]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    probed_kind = "part int, query_id long, vec binary, bound double, near array<int>"
    found_kind = "query_id long, vec_id long, score double"

    def ranked(asked: DataFrame, tables: int, probes: int | None) -> DataFrame:
        probed = asked.select("vec_id", "vec", "bound", "norm").mapInArrow(probing(tables, probes), probed_kind)
        own = index.where(F.col("t") < tables)
        found = own.groupBy("part").cogroup(probed.groupBy("part")).applyInArrow(search, found_kind)
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    bounds = stored(ranked(queries.withColumn("bound", F.lit(float("-inf"))), 1, FIRST).where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("_bound")), "bounds")
    asked = queries.join(bounds, F.col("vec_id") == F.col("_id"), "left").withColumn("bound", F.coalesce("_bound", F.lit(float("-inf"))))
    return ranked(asked, TABLES, None).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
