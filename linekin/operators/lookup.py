"""Look-ups of metadata and corrections, with the checks that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linekin.operators.sample import hashed


def with_fallback(members: DataFrame, verse_meta: DataFrame, poem_meta: DataFrame) -> DataFrame:
    """Adds (lang, place) of a verse, or else of its poem (the first row of the poem by vid), or else 'unknown'.

    Members are (vid, poem_id, ...), verse_meta (vid, lang, place), poem_meta (poem_id, vid, lang, place).
    """
    own = verse_meta.select("vid", F.col("lang").alias("_l1"), F.col("place").alias("_p1"))
    poem = poem_meta.groupBy("poem_id").agg(F.min_by(F.struct("lang", "place"), "vid").alias("_m"))
    out = members.join(own, "vid", "left").join(poem, "poem_id", "left")
    lang = F.coalesce("_l1", "_m.lang", F.lit("unknown"))
    return out.withColumn("lang", lang).withColumn("place", F.coalesce("_p1", "_m.place", F.lit(""))).drop("_l1", "_p1", "_m")


def poem_languages(members: DataFrame, left: str, right: str) -> DataFrame:
    """(languages, poems): poems by the languages of their verses: one, the other, mixed, unknown."""
    side = lambda s: F.bool_or(F.coalesce(F.col("lang") == s, F.lit(False)))
    by = members.groupBy("poem_id").agg(side(left).alias("l"), side(right).alias("r"))
    name = F.when(F.col("l") & F.col("r"), "mixed").when(F.col("l"), left).when(F.col("r"), right).otherwise("unknown")
    return by.groupBy(name.alias("languages")).agg(F.count(F.lit(1)).alias("poems"))


def corrected(rows: DataFrame, corrections: DataFrame, key: str, size: str, columns: list[str]) -> DataFrame:
    """Rows with the corrected columns, each with a ``problem``: no correction, no row, another size, or null."""
    c = corrections.select(F.col(key).alias("_k"), F.col(size).alias("_s"), *[F.col(x).alias(f"_{x}") for x in columns])
    out = rows.join(c, F.col(key) == F.col("_k"), "full")
    problem = F.when(F.col("_k").isNull(), "no correction").when(F.col(key).isNull(), "no row").when(F.col(size) != F.col("_s"), "size differs")
    keep = [F.coalesce(key, "_k").alias(key), F.coalesce(size, "_s").alias(size)]
    return out.select(*keep, *[F.coalesce(f"_{x}", x).alias(x) for x in columns], problem.alias("problem"))


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(missing, extra): ids that only a has and that only b has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").agg(F.count(F.lit(1)).alias("missing")).crossJoin(y.join(x, key, "left_anti").agg(F.count(F.lit(1)).alias("extra")))


def random_pairs(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """(a, b): n pairs of different ids: the i-th of the first 2n ids in hash order with the one n places later."""
    from pyspark.sql import Window

    some = rows.select(key).distinct().orderBy(hashed(key, seed), key).limit(2 * n)
    some = some.withColumn("i", F.row_number().over(Window.orderBy(hashed(key, seed), F.col(key))) - 1)
    half = some.agg(F.floor(F.count(F.lit(1)) / 2).alias("h"))
    some = some.crossJoin(half)
    a = some.where("i < h").select(F.col(key).alias("a"), "i")
    return a.join(some.where("i >= h").select(F.col(key).alias("b"), (F.col("i") - F.col("h")).alias("i")), "i").select("a", "b")


def lowered_min_df(min_df: int, limit: int | None) -> int:
    """The least document frequency; trial runs on few verses take 2."""
    return min(min_df, 2) if limit is not None and limit < 5000 else min_df
