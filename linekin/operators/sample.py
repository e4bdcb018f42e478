"""Samples that are the same on every run: rows in the order of a hash of their key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linekin.operators.order import placed


def hashed(key: str, seed: int = 42) -> Column:
    """A hash that other engines have too."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def uniform(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(hashed(key, seed), key).limit(n)


def stratified(rows: DataFrame, key: str, stratum: Column, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """Up to ``sizes[s]`` rows of each stratum s."""
    want = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("stratum"))
    out = rows.withColumn("stratum", stratum).withColumn("_r", F.row_number().over(Window.partitionBy("stratum").orderBy(hashed(key, seed), F.col(key))))
    return out.where(F.col("_r") <= want).drop("_r")


def by_size_halves(clusters: DataFrame, each: int = 50, seed: int = 42) -> DataFrame:
    """``each`` clusters of the smaller half by (size, cluster_id) and of the larger one."""
    n = clusters.agg(F.count(F.lit(1)).alias("_n"))
    out = placed(clusters, F.asc("size"), F.asc("cluster_id"), name="_p").crossJoin(F.broadcast(n))
    out = out.withColumn("half", F.when((F.col("_p") + 1) * 2 <= F.col("_n"), "small").otherwise("large"))
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("half").orderBy(hashed("cluster_id", seed), "cluster_id"))).where(F.col("_r") <= each).drop("_r", "_p", "_n")


def examples(members: DataFrame, sampled: DataFrame, per_side: int = 5) -> DataFrame:
    """(cluster_id, lang, vids): up to ``per_side`` members of each language of the sampled clusters, by vid."""
    rows = members.join(sampled.select("cluster_id"), "cluster_id", "left_semi")
    return rows.groupBy("cluster_id", "lang").agg(F.slice(F.sort_array(F.collect_list("vid")), 1, per_side).alias("vids"))


def first_of_each(rows: DataFrame, bucket: str, key: str, n: int = 8) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(bucket).orderBy(key))).where(F.col("_r") <= n).drop("_r")
