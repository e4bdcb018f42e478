"""Connected components of a link table, by contraction, with nothing gathered on the driver and no more than ``FEW`` links in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linekin.plans.storage import drop_stored, stored

#: So few links that are left are followed in one task, whatever the input's size was.
FEW = 1 << 17


def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, head) of all links (a, b), which come in one task; nodes that links reach share a head."""
    top: dict = {}

    def find(x: object) -> object:
        while (up := top.setdefault(x, x)) != x:
            top[x] = top[up]
            x = top[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            top[find(a)] = find(b)
        kind = batch.schema.field(0).type
    if top:
        yield pa.RecordBatch.from_arrays([pa.array(list(top), kind), pa.array([find(x) for x in list(top)], kind)], names=["node", "head"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b) links; ``component`` is the smallest node that links reach.

    In each round every node joins the one that comes first, in a hash order that changes by round, among itself and
    its neighbours; the joined nodes become the next round's nodes. At least about half go in a round, also on
    long chains. Each round is one aggregate and two joins over the links that are left and is written to the shared folder. The
    last ``FEW`` links are followed at once.
    """
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    kind = links.schema["a"].dataType.simpleString()
    levels: list[DataFrame] = []
    left = edges.count()
    while left:
        if left <= FEW:
            levels.append(stored(edges.coalesce(1).mapInArrow(followed, f"node {kind}, head {kind}"), f"heads{len(levels)}"))
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(levels))).alias("h"), F.col(c).alias("v"))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        into = first.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].cast(kind).alias("head"))
        into = stored(into, f"heads{len(levels)}")
        levels.append(into)
        a, b = into.toDF("a", "ha"), into.toDF("b", "hb")
        nexts = stored(edges.join(a, "a").join(b, "b").where("ha <> hb").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct(), "links")
        drop_stored(edges)
        edges = nexts
        left = edges.count()
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = levels[-1]
    for level in reversed(levels[:-1]):
        up = found.select(F.col("node").alias("head"), F.col("head").alias("_top"))
        found = level.join(up, "head", "left").select("node", F.coalesce("_top", "head").alias("head"))
    found = stored(found, "tops")
    names = found.groupBy("head").agg(F.min("node").alias("component"))
    return found.join(names, "head").select("node", F.col("component").cast(kind).alias("component"))
