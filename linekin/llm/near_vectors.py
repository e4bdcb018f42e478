"""Near-duplicate vectors: PCA-ordered tiled comparison with early stopping.

Equal vectors collapse to one with a count first. Unit vectors are rotated onto principal axes (of a bounded sample;
any rotation keeps products, so the sample only affects speed) and dealt to blocks by median cuts of their leading
coordinates; a block that the cuts leave too large, as of vectors that agree there, is split by a hash. Two blocks are
compared only if the boxes of their leading coordinates come within the distance that the threshold allows. Inside a pair of blocks, tiles accumulate the leading dimensions first; a product cannot grow by more than the product of
the suffix norms, so a tile, and then each pair, stops once its cosine cannot reach the threshold. What survives is
confirmed with the cosine of the original vectors in double precision.

A task hands on, for each of its vectors, the number of links and one edge to the smallest vector it is connected
with there; linked pairs themselves are never emitted, so a group of n near copies gives about n rows a task.

Vectors that are null, zero or hold null or non-finite components link with nothing (see ``valid_vectors``); ids name
vectors: rows that repeat an id share its links; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linekin.llm.common import mixed, stored
from linekin.operators.graph import components
from linekin.llm.vectors import unpacked, valid_vectors

COSINE = 0.95
BLOCK, TILE = 4096, 1024
#: Leading coordinates that blocks are cut by.
LEADING = 8
#: Vectors that the principal axes are fitted on, at most about.
SAMPLE = 20_000
#: Allowance for rounding in rotated products; survivors are confirmed exactly.
SLACK = 1e-7
#: Share of a tile's pairs up to which the survivors go on one by one rather than as a matrix.
SPARSE = 0.02


def principal_axes(units: np.ndarray) -> np.ndarray:
    """Orthonormal columns, those with the most of the rows' energy first."""
    _, axes = np.linalg.eigh(units.T @ units)
    return axes[:, ::-1]


def cuts_of(z: np.ndarray, share: int) -> list[tuple[int, float, int, int]]:
    """A tree of cuts (axis, value, node below, node from the value on; a leaf has axis -1 and its number) of sampled coordinates.

    Each cut is at the median of the axis with the largest spread, until a leaf holds ``share`` sampled rows or agrees.
    """
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        if len(rows) > share:
            axis = int(np.argmax(rows.max(0) - rows.min(0)))
            value = float(np.median(rows[:, axis]))
            below = rows[:, axis] < value
            if below.any():
                nodes[at] = (axis, value, grow(rows[below]), grow(rows[~below]))
                return at
        nodes[at] = (-1, 0.0, leaves, 0)
        leaves += 1
        return at

    grow(z)
    return nodes


def leaf_of(z: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The leaf of each row."""
    out = np.zeros(len(z), np.int32)
    stack = [(0, np.arange(len(z)))]
    while stack:
        node, rows = stack.pop()
        axis, value, left, right = nodes[node]
        if axis < 0:
            out[rows] = left
        elif len(rows):
            below = z[rows, axis] < value
            stack += [(left, rows[below]), (right, rows[~below])]
    return out


class Side:
    """The vectors of one block: originals, norms, rotated units and their suffix norms at each stop."""

    def __init__(self, x: np.ndarray, axes: np.ndarray, stops: list[int]) -> None:
        self.x = x
        self.norm = np.sqrt((x * x).sum(1))
        self.z = (x / self.norm[:, None]) @ axes
        self.tail = [np.sqrt(np.maximum((self.z[:, s:] ** 2).sum(1), 0)) for s in stops]


def linked_pairs(a: Side, b: Side, rows: slice, cols: slice, stops: list[int], least: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the blocks) of the pairs of a tile whose cosine is at least ``least``."""
    za, zb = a.z[rows], b.z[cols]
    dims = za.shape[1]
    total = np.zeros((len(za), len(zb)))
    done, i, j = 0, None, None
    for k, stop in enumerate(stops):
        total += za[:, done:stop] @ zb[:, done:stop].T
        done = stop
        alive = total + a.tail[k][rows][:, None] * b.tail[k][cols][None] >= least - SLACK
        left = int(np.count_nonzero(alive))
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left <= SPARSE * alive.size:
            i, j = np.nonzero(alive)
            break
    if i is None:
        if done < dims:
            total += za[:, done:] @ zb[:, done:].T
        i, j = np.nonzero(total >= least - SLACK)
    else:
        part = total[i, j]
        for k in range(stops.index(done) + 1, len(stops)):
            part = part + (za[i, done : stops[k]] * zb[j, done : stops[k]]).sum(1)
            done = stops[k]
            keep = part + a.tail[k][rows][i] * b.tail[k][cols][j] >= least - SLACK
            i, j, part = i[keep], j[keep], part[keep]
    i, j = i + rows.start, j + cols.start
    good = np.zeros(len(i), bool)
    for s in range(0, len(i), 200_000):
        p, q = i[s : s + 200_000], j[s : s + 200_000]
        good[s : s + 200_000] = (a.x[p] * b.x[q]).sum(1) / (a.norm[p] * b.norm[q]) >= least
    return i[good], j[good]


def join_roots(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Hooks the roots of x and y together, the larger under the smaller, until all pairs agree."""
    while True:
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        p, q = parent[x], parent[y]
        differ = p != q
        if not differ.any():
            return
        np.minimum.at(parent, np.maximum(p, q)[differ], np.minimum(p, q)[differ])


def near_vectors(table: DataFrame, column: str = "embedding", least: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    kind = "vec_id long, key binary, vec binary"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [hashlib.blake2b(v, digest_size=16).digest() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1)], names=["vec_id", "key", "vec"])

    valid = valid_vectors(table, column)
    rows = stored(valid.select("vec_id", "vec").mapInArrow(keyed, kind), "keyed").dropDuplicates(["vec_id", "key"])
    reps = stored(rows.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")), "distinct")
    n = reps.count()
    every = table.select(F.col("vec_id").cast("long").alias("vec_id"))
    if not n:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    part = min(1.0, SAMPLE / n)
    sample = reps.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) <= int(part * (1 << 20))).select("vec").toPandas()["vec"]
    dims = len(reps.select("vec").first()[0]) // 8
    some = np.frombuffer(b"".join(sample), np.float64).reshape(-1, dims) if len(sample) else np.eye(dims)
    axes = principal_axes(some / np.sqrt((some * some).sum(1))[:, None])
    stops = sorted({max(1, dims // 4), max(1, dims // 2), max(1, 3 * dims // 4)})

    lead = min(LEADING, dims)
    share = max(1, int(len(some) * min(1.0, BLOCK / n)))
    nodes = cuts_of((some / np.sqrt((some * some).sum(1))[:, None]) @ axes[:, :lead], share)

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column(2), dims)
            z = (x @ axes[:, :lead]) / np.sqrt((x * x).sum(1))[:, None] if len(x) else np.zeros((0, lead))
            values = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), lead).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of(z, nodes)), values], names=["rep", "copies", "vec", "leaf", "z"])

    placed = stored(reps.select("rep", "copies", "vec").mapInArrow(coordinates, "rep long, copies long, vec binary, leaf int, z array<double>"), "placed")
    # A row of 2 * LEADING + 2 numbers a leaf, one leaf for about BLOCK vectors.
    bounds = [f(F.col("z")[k]).alias(f"{name}{k}") for name, f in (("lo", F.min), ("hi", F.max)) for k in range(lead)]
    boxes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *bounds).orderBy("leaf").collect()
    number = {r["leaf"]: i for i, r in enumerate(boxes)}
    low, high = (np.array([[r[f"{name}{k}"] for k in range(lead)] for r in boxes]) for name in ("lo", "hi"))
    parts = np.array([-(-r["n"] // BLOCK) for r in boxes])
    base = np.concatenate([[0], np.cumsum(parts)])
    reach = (float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK) ** 2

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block meets those whose boxes lie within reach of its own leaf's box.
        for batch in batches:
            leaf = np.array([number[k] for k in batch.column(3).to_pylist()], np.int64)
            own = base[leaf] + mixed(batch.column(0).to_numpy().view(np.uint64), 5).astype(np.int64) % parts[leaf] if len(leaf) else leaf
            for block in np.unique(own):
                some = batch.filter(pa.array(own == block))
                k = int(np.searchsorted(base, block, "right")) - 1
                apart = np.maximum(0, np.maximum(low - high[k], low[k] - high))
                near = np.flatnonzero((apart * apart).sum(1) <= reach)
                for other in np.concatenate([np.arange(base[j], base[j + 1]) for j in near]):
                    i, j = min(block, other), max(block, other)
                    m = some.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, i), pa.int32()), pa.array(np.full(m, j), pa.int32()), pa.array(np.full(m, block), pa.int32()), *some.columns[:3]], names=["i", "j", "block", "rep", "copies", "vec"])

    pairs = placed.select("rep", "copies", "vec", "leaf").mapInArrow(dealt, "i int, j int, block int, rep long, copies long, vec binary")

    def compare(t: pa.Table) -> pa.Table:
        block, rep, copies = (t.column(c).to_numpy() for c in ("block", "rep", "copies"))
        x = unpacked(t.column("vec"), dims)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        # Tiles of neighbours on the first axis stop early as a whole.
        a = Side(x[left], axes, stops)
        b = a if i == j else Side(x[right], axes, stops)
        links, parent = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for r in range(0, len(left), TILE):
            for c in range(r if i == j else 0, len(right), TILE):
                p, q = linked_pairs(a, b, slice(r, min(r + TILE, len(left))), slice(c, min(c + TILE, len(right))), stops, least)
                if i == j and len(p):
                    above = p < q
                    p, q = p[above], q[above]
                if len(p):
                    p, q = left[p], right[q]
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    join_roots(parent, p, q)
        found = np.flatnonzero(links)
        return pa.table({"rep": rep[found], "head": rep[parent[found]], "links": links[found]})

    found = stored(pairs.groupBy("i", "j").applyInArrow(compare, "rep long, head long, links long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    top = components(found.select(F.col("rep").alias("a"), F.col("head").alias("b"))).withColumnRenamed("node", "rep")
    by_key = reps.select("key", "rep", "copies").join(counts, "rep", "left").join(top, "rep", "left")
    known = rows.select("vec_id", "key").join(by_key, "key")
    known = known.groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.min(F.coalesce("component", "rep")).alias("_component"))
    out = every.join(known.withColumnRenamed("vec_id", "_id"), F.col("vec_id") == F.col("_id"), "left")
    out = out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
