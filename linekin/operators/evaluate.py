"""Evaluation against labelled pairs: precision and recall, reasons of misses, significance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame) -> DataFrame:
    """One row from (positive, predicted): tp, fp, fn, tn, precision, recall, f1; 0 where a denominator is 0."""
    p, q = F.col("positive"), F.col("predicted")
    c = rows.agg(F.count_if(p & q).alias("tp"), F.count_if(~p & q).alias("fp"), F.count_if(p & ~q).alias("fn"), F.count_if(~p & ~q).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def text_matches(gold_texts: DataFrame, verses: DataFrame) -> DataFrame:
    """(text, vid) of verses whose normal form equals a gold text's (``norm`` in both)."""
    return gold_texts.select("norm").distinct().join(verses.select("norm", "vid"), "norm").withColumnRenamed("norm", "text")


def co_members(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Adds ``predicted`` (any common cluster of the two items) to (id1, id2, ...) pairs; clusters are (item, cluster_id)."""
    a, b = clusters.toDF("id1", "c"), clusters.toDF("id2", "c")
    hit = pairs.select("id1", "id2").distinct().join(a, "id1").join(b, ["id2", "c"]).select("id1", "id2", F.lit(True).alias("_hit")).distinct()
    return pairs.join(hit, ["id1", "id2"], "left").withColumn("predicted", F.coalesce("_hit", F.lit(False))).drop("_hit")


def single_mode(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """The older rule: the first cluster of each item must be the same."""
    first = clusters.toDF("item", "c").groupBy("item").agg(F.min("c").alias("c"))
    out = pairs.join(first.toDF("id1", "c1"), "id1", "left").join(first.toDF("id2", "c2"), "id2", "left")
    return out.withColumn("predicted", F.coalesce(F.col("c1") == F.col("c2"), F.lit(False))).drop("c1", "c2")


def miss_buckets(pairs: DataFrame, known: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id1, id2, bucket) of missed positives: A an item is not in the corpus, B not in a cluster, C only in other clusters."""
    k = known.select(F.col("item"), F.lit(True).alias("k")).distinct()
    c = clusters.select(F.col("item"), F.lit(True).alias("c")).distinct()
    rows = pairs.where("positive and not predicted")
    for i in ("1", "2"):
        rows = rows.join(k.toDF(f"id{i}", f"k{i}"), f"id{i}", "left").join(c.toDF(f"id{i}", f"c{i}"), f"id{i}", "left")
    bucket = F.when(F.col("k1").isNull() | F.col("k2").isNull(), "A").when(F.col("c1").isNull() | F.col("c2").isNull(), "B").otherwise("C")
    return rows.select("id1", "id2", bucket.alias("bucket"))


def language_pairs(pairs: DataFrame, langs: DataFrame) -> DataFrame:
    """(languages, pairs) of positives; the two languages sorted, '?' for an unknown one."""
    out = pairs.where("positive").join(langs.toDF("id1", "l1"), "id1", "left").join(langs.toDF("id2", "l2"), "id2", "left")
    name = F.array_join(F.array_sort(F.array(F.coalesce("l1", F.lit("?")), F.coalesce("l2", F.lit("?")))), "-")
    return out.groupBy(name.alias("languages")).agg(F.count(F.lit(1)).alias("pairs"))


def mcnemar(rows: DataFrame) -> DataFrame:
    """(b, c, chi2) of (positive, predicted_a, predicted_b): pairs that only one gets right, with continuity correction."""
    right = lambda q: F.col("positive") == F.col(q)
    d = rows.agg(F.count_if(right("predicted_a") & ~right("predicted_b")).alias("b"), F.count_if(~right("predicted_a") & right("predicted_b")).alias("c"))
    n = F.col("b") + F.col("c")
    return d.withColumn("chi2", F.when(n > 0, F.pow(F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)), 2) / n).otherwise(0.0))


def chi2_p(chi2: float) -> float:
    """Upper tail for one degree of freedom."""
    return math.erfc(math.sqrt(max(chi2, 0.0) / 2))


def bootstrap(rows: DataFrame, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """(measure, low, high): 2.5 and 97.5 percentiles of precision, recall and F1 over resamples of (positive, predicted).

    Only the four cell counts matter, so each replicate is one multinomial draw, seeded by its number, on the executors.
    """
    cells = confusion(rows).select("tp", "fp", "fn", "tn").first()
    counts = np.array([cells["tp"], cells["fp"], cells["fn"], cells["tn"]], float)
    total = int(counts.sum())
    spark = rows.sparkSession
    share = (counts / total).tolist() if total else [0.25] * 4

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i in part["id"]:
                tp, fp, fn, _ = np.random.default_rng([seed, int(i)]).multinomial(total, share)
                p, r = tp / max(tp + fp, 1), tp / max(tp + fn, 1)
                out.append((p, r, 2 * p * r / (p + r) if p + r else 0.0))
            yield pd.DataFrame(out, columns=["precision", "recall", "f1"])

    made = spark.range(replicates).mapInPandas(draw, "precision double, recall double, f1 double")
    long_ = made.select(F.explode(F.create_map(*[x for c in ("precision", "recall", "f1") for x in (F.lit(c), F.col(c))])).alias("measure", "value"))
    return long_.groupBy("measure").agg(F.expr("percentile(value, 0.025)").alias("low"), F.expr("percentile(value, 0.975)").alias("high"))


def paired_bootstrap(rows: DataFrame, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """(mean, low, high, share_above) of F1(b) - F1(a) over resamples of (positive, predicted_a, predicted_b)."""
    cells = rows.groupBy("positive", "predicted_a", "predicted_b").count().collect()  # at most eight rows
    total = sum(r["count"] for r in cells)
    share = [r["count"] / total for r in cells] if total else [1.0]
    flags = np.array([[r["positive"], r["predicted_a"], r["predicted_b"]] for r in cells], bool).reshape(-1, 3)
    spark = rows.sparkSession

    def f1(n: np.ndarray, pred: np.ndarray) -> float:
        tp, fp, fn = n[flags[:, 0] & pred].sum(), n[~flags[:, 0] & pred].sum(), n[flags[:, 0] & ~pred].sum()
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i in part["id"]:
                n = np.random.default_rng([seed, int(i)]).multinomial(total, share)
                out.append(f1(n, flags[:, 2]) - f1(n, flags[:, 1]) if len(flags) else 0.0)
            yield pd.DataFrame({"d": out})

    made = spark.range(replicates).mapInPandas(draw, "d double")
    return made.agg(F.avg("d").alias("mean"), F.expr("percentile(d, 0.025)").alias("low"), F.expr("percentile(d, 0.975)").alias("high"), F.avg((F.col("d") > 0).cast("double")).alias("share_above"))
