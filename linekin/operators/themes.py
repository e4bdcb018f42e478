"""Themes of song types: enrichment against expected counts, sharing across sides, keyword audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linekin.functions.text import type_name


def incidences(members: DataFrame, types: DataFrame, themes: DataFrame) -> DataFrame:
    """Distinct (cluster_id, poem_id, side, type, theme) of clusters' members; poems without a type are left out."""
    rows = members.select("cluster_id", "poem_id", "side").distinct().join(types.select("poem_id", "type"), "poem_id")
    return rows.join(themes.select("type", "theme"), "type", "left").withColumn("theme", F.coalesce("theme", F.lit("unknown")))


def observed(inc: DataFrame) -> DataFrame:
    return inc.groupBy("theme").agg(F.count(F.lit(1)).alias("obs"))


def expected(corpus: DataFrame, totals: DataFrame, by_side: bool = True, weight: str | None = None) -> DataFrame:
    """(theme, exp) of incidences from corpus rows (side, theme, weight): shares of each side (or pooled) times its total (side, n)."""
    w = F.col(weight) if weight else F.lit(1)
    rows = corpus.withColumn("_side", F.col("side") if by_side else F.lit("all"))
    n = totals.groupBy((F.col("side") if by_side else F.lit("all")).alias("_side")).agg(F.sum("n").alias("n"))
    share = rows.groupBy("_side", "theme").agg(F.sum(w).alias("w")).withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("_side")))
    return share.join(n, "_side").groupBy("theme").agg(F.sum(F.col("share") * F.col("n")).alias("exp"))


def enrichment(obs: DataFrame, exp: DataFrame) -> DataFrame:
    """(theme, obs, exp, obs_rate, exp_rate, ratio), every theme of either side."""
    out = exp.join(obs, "theme", "full").select("theme", F.coalesce("obs", F.lit(0)).alias("obs"), F.coalesce("exp", F.lit(0.0)).alias("exp"))
    whole = Window.partitionBy()
    total = F.sum("obs").over(whole)
    return out.withColumn("obs_rate", F.col("obs") / total).withColumn("exp_rate", F.col("exp") / total).withColumn("ratio", F.when(F.col("exp") > 0, F.col("obs") / F.col("exp")))


def chi_square(table: DataFrame, least: float = 5.0) -> DataFrame:
    """(chi2, df, kept) over the themes with at least ``least`` observed and expected."""
    kept = table.where((F.col("obs") >= least) & (F.col("exp") >= least))
    return kept.agg(F.coalesce(F.sum(F.pow(F.col("obs") - F.col("exp"), 2) / F.col("exp")), F.lit(0.0)).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"), F.count(F.lit(1)).alias("kept"))


def verse_counts(verses: DataFrame) -> DataFrame:
    return verses.groupBy("poem_id").agg(F.count(F.lit(1)).alias("verses"))


def sharing(inc: DataFrame, left: str, right: str, catch_all: Sequence[str] = ()) -> DataFrame:
    """(cluster_id, any, substantive): whether both sides share a theme, and one that is not a catch-all."""
    side = lambda s: F.collect_set(F.when(F.col("side") == s, F.col("theme")))
    by = inc.groupBy("cluster_id").agg(side(left).alias("l"), side(right).alias("r")).where("size(l) > 0 and size(r) > 0")
    both = F.array_intersect("l", "r")
    loose = F.array(*map(F.lit, catch_all)) if catch_all else F.array().cast("array<string>")
    return by.select("cluster_id", (F.size(both) > 0).alias("any"), (F.size(F.array_except(both, loose)) > 0).alias("substantive"))


def sharing_rates(shared: DataFrame) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return shared.agg(F.count(F.lit(1)).alias("n"), rate("any").alias("any_rate"), rate("substantive").alias("substantive_rate"), F.avg((F.col("any") & ~F.col("substantive")).cast("double")).alias("only_catch_all_rate"))


def shuffled(pairs: DataFrame, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(rep, rate): share of equal themes of (id, left, right) when the right side is dealt out anew in hash order.

    Each replicate is a group of its own, so replicates run side by side.
    """
    reps = pairs.sparkSession.range(replicates).withColumnRenamed("id", "rep")
    rows = pairs.crossJoin(F.broadcast(reps))
    h = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("rep").cast("string"), F.lit(str(seed))))
    a = rows.select("rep", "left", F.row_number().over(Window.partitionBy("rep").orderBy("id")).alias("k"))
    b = rows.select("rep", "right", F.row_number().over(Window.partitionBy("rep").orderBy(h, "id")).alias("k"))
    return a.join(b, ["rep", "k"]).groupBy("rep").agg(F.avg((F.col("left") == F.col("right")).cast("double")).alias("rate"))


def shared_type_names(inc: DataFrame, names: DataFrame, left: str, right: str) -> DataFrame:
    """(cluster_id, name): translated type names, in normal form, that both sides of a cluster have."""
    rows = inc.select("cluster_id", "side", "type").distinct().join(names.select("type", type_name(F.col("english")).alias("name")), "type")
    by = rows.where(F.col("side").isin(left, right)).groupBy("cluster_id", "name").agg(F.countDistinct("side").alias("n"))
    return by.where("n = 2").select("cluster_id", "name")


def keyword_audit(inc: DataFrame, keyword: str, theme: str) -> DataFrame:
    """(side, type, n, in_theme): types whose name has the keyword, and whether they are themed that way."""
    rows = inc.where(F.lower("type").rlike(keyword) | (F.col("theme") == theme))
    return rows.groupBy("side", "type").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("theme") == theme).alias("in_theme"))
