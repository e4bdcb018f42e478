"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Targets. Sources in code-point order (null last) get the weights in turn; ``share`` times all words is split by
weight, no source above ``cap`` times its own words, and what a capped source leaves goes to the others by weight.
With the sources ordered by cap over weight, the capped ones are a prefix, so one pass over the small table of
sources finds the level.

What is taken. A source's documents stand in a fixed pseudo-random order (md5 of the id, then size and a hash of the
text). The target is so many full passes and a rest; the rest takes documents in that order as long as their words end
within it, then the smallest of the others fill the gap up to the nearest word count. Texts are taken whole.

Positions. Source s has the weight schedule 1 + a_s (2t - 1) over training time t in [0, 1]. Its integral
t + a_s (t^2 - t) is the part of the source's demand met by t; inverting it at the place that each pass of a document has
in the source's cumulative words, over all passes, gives that pass's training position. The output is range-sorted by position.

Prefix sums run in two levels (sums of hash slices, then inside a slice), so a source with a third of all rows is
spread over ``SLICES`` tasks.

Null or empty texts have size 0 and are never taken; a null source is a source; rows that repeat an id, source and
text count apart in ``mix``, and ``mixed_documents`` gives them with the columns of the least of them; extra columns are
carried, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linekin.llm.common import small, stored

WEIGHTS = (5, 2, 1)
#: Target words over all words, as a fraction.
SHARE = (3, 2)
CAP = 2
#: Words of a partition of the mix, about.
PART_WORDS = 4_000_000
#: Slices of a source's order, from the first hex digits of the md5.
SLICES, _DIGITS, _HEX = 256, 2, 16
#: Slopes of the weight schedules, in turn: early, late, flat.
SLOPES = (-0.5, 0.5, 0.0)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null is 0.

    Every run of white space becomes one space, so words are spaces between words plus one.
    """
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return F.when(one == "", F.lit(0)).otherwise(F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit(""))) + 1).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, slope) from (source, size) rows. One row a source: the windows are over those."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")).cast("long")
    by = by.withColumn("_i", F.row_number().over(order) - 1).withColumn("_w", weight)
    by = by.withColumn("_cap", F.lit(CAP) * F.col("source_size"))
    # Sources sorted by cap / weight; before a source lie those that are capped if it is not.
    run = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_i")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    by = by.withColumn("_below", F.coalesce(F.sum("_cap").over(run), F.lit(0)))
    by = by.withColumn("_wleft", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(run), F.lit(0)))
    by = by.withColumn("_need", F.lit(SHARE[0]) * F.sum("source_size").over(whole) - F.lit(SHARE[1]) * F.col("_below"))
    by = by.withColumn("_open", F.col("_need") * F.col("_w") < F.lit(SHARE[1]) * F.col("_cap") * F.col("_wleft"))
    # The level is that of the first source that is not capped.
    first = F.min(F.when(F.col("_open"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_i").alias("i"), F.col("_need").alias("n"), F.col("_wleft").alias("w")))).over(whole)
    by = by.withColumn("_level", first)
    open_ = F.col("_level").isNotNull() & (F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_i").alias("i")) >= F.struct(F.col("_level.r").alias("r"), F.col("_level.i").alias("i")))
    target = F.when(open_, (F.col("_w") * F.col("_level.n")).cast("double") / (F.lit(SHARE[1]) * F.col("_level.w")).cast("double")).otherwise(F.col("_cap").cast("double"))
    slope = F.element_at(F.array(*[F.lit(float(a)) for a in SLOPES]), (F.col("_i") % len(SLOPES) + 1).cast("int"))
    return by.select("source", "source_size", F.least(target, F.col("_cap").cast("double")).alias("target"), slope.alias("slope"))


def _prefix(df: DataFrame, key: list[str], slice_: str, order: list[Column], amount: Column, out: str) -> DataFrame:
    """Adds the sum of ``amount`` over the rows before a row in its key's order (slice, then ``order``)."""
    parts = df.groupBy(*key, slice_).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*key).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(slice_).alias("_ks"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)] + [F.col(slice_) == F.col("_ks")]
    inside = Window.partitionBy(*key, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(parts, cond).withColumn(out, F.col("_off") + F.col("_in")).drop("_off", "_in", "_ks", *[f"_k{i}" for i in range(len(key))])


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, text_hash, source_size, target, passes, taken, positions), a row for each row of ``docs``.

    ``passes`` is how often the document is taken, ``positions`` the training position of each pass.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    rows = rows.withColumn("_h", F.coalesce(F.substring(F.md5(F.col("doc_id").cast("string")), 1, _HEX), F.lit("")))
    rows = stored(rows.withColumn("_s", F.substring("_h", 1, _DIGITS)), "mix-sizes")
    targets = source_targets(rows, weights).withColumnRenamed("source", "_src")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    order = [F.col("_h"), F.col("size"), F.col("text_hash")]
    rows = stored(_prefix(rows, ["source"], "_s", order, F.col("size"), "_cum"), "mix-order")
    goal = F.round("target").cast("long")
    rows = rows.withColumn("_full", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
    rows = rows.withColumn("_rest", goal - F.col("_full") * F.col("source_size"))
    rows = rows.withColumn("_whole", (F.col("size") > 0) & (F.col("_cum") + F.col("size") <= F.col("_rest")))
    # The gap that whole documents leave is under the size of the one at its edge; the smallest others fill it.
    gaps = rows.groupBy("source").agg(F.min(F.col("_rest") - F.when(F.col("_whole"), F.col("_cum") + F.col("size")).otherwise(0)).alias("_gap")).withColumnRenamed("source", "_src")
    rows = rows.join(gaps, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    rows = rows.withColumn("_fits", ~F.col("_whole") & (F.col("size") > 0) & (F.col("size") < 2 * F.col("_gap")))
    fill = rows.where("_fits").groupBy("source", "size").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("source", "_src").withColumnRenamed("size", "_size")
    below = Window.partitionBy("_src").orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    fill = fill.withColumn("_before", F.coalesce(F.sum(F.col("_n") * F.col("_size")).over(below), F.lit(0))).drop("_n")
    rows = rows.join(fill, F.col("_fits") & F.col("source").eqNullSafe(F.col("_src")) & (F.col("size") == F.col("_size")), "left")
    # Of documents of one size: by hash, as many as bring the words nearest to the gap.
    rows = rows.withColumn("_more", F.when(F.col("_fits"), F.floor((F.col("_gap") - F.col("_before")) / F.col("size") + F.lit(0.5))).otherwise(0))
    rows = _prefix(rows, ["source", "size", "_fits"], "_s", order, F.lit(1), "_rank")
    rows = rows.withColumn("_extra", F.col("_fits") & (F.col("_rank") < F.col("_more")))
    passes = F.col("_full") + (F.col("_whole") | F.col("_extra")).cast("long")
    rows = rows.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(0).cast("long"))
    # Words of the source before the middle of a pass: whole passes run in the source's order, those that fill the gap come last.
    half = F.col("size") / F.lit(2.0)
    filled = F.col("_full") * F.col("source_size") + F.col("_rest") - F.col("_gap") + F.coalesce("_before", F.lit(0)) + F.col("_rank") * F.col("size") + half
    demand = F.greatest(F.col("target"), F.lit(1.0))

    def position(p: Column) -> Column:
        words = F.when((p <= F.col("_full")) | F.col("_whole"), (p - 1) * F.col("source_size") + F.col("_cum") + half).otherwise(filled)
        return schedule_time(F.least(words / demand, F.lit(1.0)), F.col("slope"))

    positions = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest("passes", F.lit(1))), position)).otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", "source", "size", "text_hash", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"), positions.alias("positions"))


def schedule_time(met: Column, slope: Column) -> Column:
    """t with t + slope (t^2 - t) = met: the time by which a source has met that part of its demand."""
    half = (F.lit(1.0) - slope) / 2
    return F.when(slope == 0, met).otherwise((F.sqrt(half * half + slope * met) - half) / F.when(slope == 0, F.lit(1.0)).otherwise(slope))


def ordered(mixed: DataFrame) -> DataFrame:
    """The mix range-sorted by the position of the first pass, documents that are not taken last."""
    first = F.get(F.col("positions"), F.lit(0)).asc_nulls_last()
    return mixed.repartitionByRange(first, F.col("doc_id")).sortWithinPartitions(first, "doc_id")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The documents of the mix with their columns, once for each pass, range-sorted by training position.

    The ranges come from the narrow table of positions, so the texts are shuffled once.
    """
    rows = stored(mix(docs, weights).where("passes > 0").select("doc_id", "source", "text_hash", "size", "positions"), "mix-picked")
    words = rows.agg(F.sum(F.col("size") * F.size("positions"))).first()[0]
    if not words:
        return docs.limit(0)
    count = -(-words // PART_WORDS)
    picks = rows.select("doc_id", "source", "text_hash", F.explode("positions").alias("at"))
    cuts = picks.approxQuantile("at", [k / count for k in range(1, count)], 0.1 / count) if count > 1 else []
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    part = F.size(F.filter(bounds, lambda c: c <= F.col("at")))
    key = ["doc_id", "source", "text_hash"]
    names = [f"_k{i}" for i in range(len(key))]
    picks = stored(picks.withColumn("part", part).toDF(*names, "at", "part"), "mix-picks")
    whole = docs.select(*[F.col(c).alias(n) for c, n in zip(key[:2], names, strict=False)], F.xxhash64("text").alias(names[2]), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # Rows that agree in all of these are one row here; its picks are those of all of them.
    again = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key).toDF(*(f"_r{i}" for i in range(len(key)))), "mix-repeats")
    same = [F.col(n).eqNullSafe(F.col(f"_r{i}")) for i, n in enumerate(names)]
    if not again.isEmpty():
        repeats = small(again)
        single = whole.join(repeats, same, "left_anti")
        once = whole.join(repeats, same, "left_semi").groupBy(*names).agg((F.first if "map<" in docs.schema.simpleString() else F.min)("row").alias("row"))
        whole = single.union(once)
    # Few rows go to every task; more are joined by a shuffle of the texts.
    narrow = small(picks, 1_000_000).toDF("_a", "_b", "_c", "at", "part")
    out = whole.join(narrow, F.col("_k2").eqNullSafe(F.col("_c")) & F.col("_k0").eqNullSafe(F.col("_a")) & F.col("_k1").eqNullSafe(F.col("_b")))
    out = out.repartitionById(count, F.col("part")).sortWithinPartitions("at", "_k0")
    return out.select("row.*")
