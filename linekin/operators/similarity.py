"""Vocabulary, weights, token self-joins and ranked neighbour lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linekin.functions.text import match_type, words
from linekin.plans.storage import stored

#: Token sets of a block; two blocks meet in one task. Rows of the one block that are compared at once.
BLOCK, ROWS = 4096, 128


def tokens(verses: DataFrame, extract: Column | None = None, least: int = 2) -> DataFrame:
    """(vid, token): the distinct tokens of each verse with at least ``least`` of them. ``extract`` gives a verse's token array."""
    found = words(F.col("text")) if extract is None else extract
    rows = verses.select("vid", found.alias("tokens")).where(F.size("tokens") >= least)
    return rows.select("vid", F.explode("tokens").alias("token"))


def document_frequency(toks: DataFrame) -> DataFrame:
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(toks: DataFrame, min_df: int = 5, max_share: float = 0.05) -> DataFrame:
    """(token, df, idf) of the tokens with min_df <= df <= floor(max_share * verses); idf is ln(verses / df)."""
    n = toks.select(F.countDistinct("vid").alias("n"))
    kept = document_frequency(toks).crossJoin(F.broadcast(n))
    kept = kept.where((F.col("df") >= min_df) & (F.col("df") <= F.floor(F.col("n") * max_share)))
    return kept.select("token", "df", F.ln(F.col("n") / F.col("df")).alias("idf"))


def vocabulary_statistics(toks: DataFrame, min_df: int = 5, max_share: float = 0.05) -> DataFrame:
    n = toks.select(F.countDistinct("vid").alias("n"))
    top = F.floor(F.col("n") * max_share)
    df = document_frequency(toks).crossJoin(F.broadcast(n))
    return df.agg(F.count_if(F.col("df") > top).alias("too_common"), F.count_if(F.col("df") < min_df).alias("too_rare"), F.count_if((F.col("df") >= min_df) & (F.col("df") <= top)).alias("kept"))


def weighted(toks: DataFrame, vocab: DataFrame) -> DataFrame:
    """(vid, token, idf) of the tokens in the vocabulary."""
    return toks.join(vocab.select("token", "idf"), "token").select("vid", "token", "idf")


def token_sets(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, tokens, idf) of each distinct token set, named by its least verse, and (rep, vid) of all verses.

    Verses of one set have equal scores with everything, so only the sets are compared; tokens are 64-bit hashes.
    """
    rows = weights.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("token").alias("h"), "idf"))).alias("t"))
    rows = stored(rows.select("vid", F.col("t.h").alias("tokens"), F.col("t.idf").alias("idf")), "token-sets")
    reps = stored(rows.groupBy("tokens").agg(F.min("vid").alias("rep"), F.first("idf").alias("idf")), "distinct-sets")
    return reps, stored(rows.select("vid", "tokens").join(reps.select("tokens", "rep"), "tokens").select("rep", "vid"), "set-members")


#: Measures of two token sets and their published floors.
FLOORS = {"jaccard": 0.2, "jaccard_idf": 0.2, "cosine": 0.15}


def set_pairs(weights: DataFrame, measures: Sequence[str] = ("jaccard",), floors: Mapping[str, float] = FLOORS, min_shared: int = 2, adaptive: bool = False, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(measure, src, dst, score, shared) of all ordered pairs of distinct token sets that reach a measure's floor, and (rep, vid).

    Sets are dealt to blocks; two blocks meet in one task, which multiplies their sparse rows for all measures at once, so no pair
    leaves a task that does not reach a floor, and nothing is cut off: the work is that of the sparse product. A set
    that several verses have is its own neighbour with a score of 1. Jaccard pairs share ``min_shared`` tokens, or with
    ``adaptive`` no more than the source has. ``most`` bounds what a task hands on for a source to its best, which are enough for
    lists of as many.
    """
    reps, members = token_sets(weights)
    n = reps.count()
    count = max(1, -(-n // BLOCK))
    own = F.pmod(F.xxhash64("rep"), F.lit(count)).cast("int")
    rows = reps.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    rows = rows.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "tokens", "idf")
    kind = "measure string, src string, dst string, score double, shared long"
    names = list(measures)
    least = {m: float(floors[m]) for m in names}

    def compare(t: pa.Table) -> pa.Table:
        own = t.column("own").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        rep = np.array(t.column("rep").to_pylist(), dtype=object)
        lists = t.column("tokens").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        weights_ = t.column("idf").combine_chunks()
        weights_ = weights_ if isinstance(weights_, pa.Array) else pa.concat_arrays(weights_.chunks)
        token, idf = lists.flatten().to_numpy(), weights_.flatten().to_numpy()
        size = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(rep)), size)
        total = np.bincount(owner, idf, len(rep))
        norm = np.sqrt(np.bincount(owner, idf * idf, len(rep)))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        # Posting lists of the right block.
        place = np.full(len(rep), -1)
        place[right] = np.arange(len(right))
        inside = place[owner] >= 0
        order = np.argsort(token[inside], kind="stable")
        posted, postings = token[inside][order], place[owner[inside]][order]
        known, first = np.unique(posted, return_index=True)
        length = np.diff(np.append(first, len(posted)))
        starts = np.concatenate([[0], np.cumsum(size)])
        found: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(0, len(left), ROWS) if len(right) else ():
            some = left[k : k + ROWS]
            entries = np.concatenate([np.arange(starts[x], starts[x + 1]) for x in some]) if len(some) else np.zeros(0, int)
            line = np.repeat(np.arange(len(some)), size[some])
            at = np.searchsorted(known, token[entries])
            hit = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == token[entries])
            at, line, w = at[hit], line[hit], idf[entries][hit]
            times = length[at]
            to = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[at], times)
            cell = np.repeat(line, times) * len(right) + postings[to]
            shape = (len(some), len(right))
            shared = np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape)
            enough = shared >= (1 if adaptive else min_shared)
            if i == j:
                enough &= some[:, None] != right[None]
            for m in names:
                if m == "jaccard":
                    score = shared / np.maximum(size[some][:, None] + size[right][None] - shared, 1)
                    good = enough & (score >= least[m])
                elif m == "jaccard_idf":
                    both = np.bincount(cell, np.repeat(w, times), shape[0] * shape[1]).reshape(shape)
                    score = both / np.maximum(total[some][:, None] + total[right][None] - both, 1e-300)
                    good = enough & (score >= least[m])
                else:
                    dot = np.bincount(cell, np.repeat(w * w, times), shape[0] * shape[1]).reshape(shape)
                    score = dot / np.maximum(norm[some][:, None] * norm[right][None], 1e-300)
                    good = (shared > 0) & (score >= least[m])
                    if i == j:
                        good &= some[:, None] != right[None]
                a, b = np.nonzero(good)
                found.append((m, some[a], right[b], score[a, b], shared[a, b]))
        out: list[pa.Table] = []
        for m in names:
            own_rows = [f[1:] for f in found if f[0] == m]
            a, b, score, shared = (np.concatenate(c) for c in zip(*own_rows, strict=True)) if own_rows else (np.zeros(0, int),) * 4
            for x, y in ((a, b),) if i == j else ((a, b), (b, a)):
                keep = np.ones(len(x), bool)
                if adaptive and m != "cosine":
                    keep = shared >= np.minimum(min_shared, size[x])
                x, y, s, c = x[keep], y[keep], score[keep], shared[keep]
                if most is not None and len(x):
                    rank = np.argsort(np.argsort(rep[y].astype(str), kind="stable"), kind="stable")
                    order = np.lexsort((rank, -np.round(s, 9), x))
                    x, y, s, c = x[order], y[order], s[order], c[order]
                    keep = np.arange(len(x)) - np.searchsorted(x, x, "left") < most
                    x, y, s, c = x[keep], y[keep], s[keep], c[keep]
                out.append(pa.table({"measure": pa.array([m] * len(x), pa.string()), "src": pa.array(rep[x].tolist(), pa.string()), "dst": pa.array(rep[y].tolist(), pa.string()), "score": pa.array(s, pa.float64()), "shared": pa.array(c, pa.int64())}))
        return pa.concat_tables(out)

    pairs = rows.groupBy("i", "j").applyInArrow(compare, kind)
    # A set of several verses, which are each other's neighbours.
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    alike = reps.join(several, "rep").select("rep", F.size("tokens").cast("long").alias("shared"))
    for m in names:
        enough = F.col("shared") >= (1 if adaptive or m == "cosine" else min_shared)
        pairs = pairs.union(alike.where(enough).select(F.lit(m), "rep", F.col("rep").alias("dst"), F.lit(1.0), "shared"))
    return pairs, members


def bigram_vocabulary(verses: DataFrame, normal: Column, size: int = 200, count: Column | None = None) -> DataFrame:
    """The ``size`` most frequent character bigrams of the verses' normal form; ties by bigram. A row stands for ``count`` verses."""
    from linekin.functions.text import char_ngrams

    rows = verses.select(F.explode(char_ngrams(normal, 2)).alias("token"), (F.lit(1) if count is None else count).cast("long").alias("n"))
    return rows.groupBy("token").agg(F.sum("n").alias("df")).orderBy(F.desc("df"), "token").limit(size)


def described(verses: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, vid, poem_id, idx, lang, folded): members with what ranking needs; ``folded`` stands for the lower-cased text."""
    v = verses.select("vid", "poem_id", "idx", "lang", F.struct(F.xxhash64(F.lower("text")).alias("h"), F.length("text").alias("n")).alias("folded"))
    return members.join(v, "vid").select("rep", "vid", "poem_id", "idx", "lang", "folded")


def top_neighbours(pairs: DataFrame, members: DataFrame, k: int = 50, dedup: bool = True, exclude_same_poem: bool = False, exclude_adjacent: bool = False, exclude_first: bool = True, over: int = 5) -> DataFrame:
    """(src, rank from 0, dst, score, mtype): the k best verses of each verse, ties by id, from pairs of sets.

    ``members`` are as from ``described``. With ``dedup`` the best ``over * k`` come first and of equal folded texts only the best
    stays. Exclusions apply before that (``exclude_first``) or to the final k.
    """
    gone = F.lit(False)
    if exclude_same_poem:
        gone = gone | (F.col("mtype") == "w")
    if exclude_adjacent:
        gone = gone | ((F.col("mtype") == "w") & (F.abs(F.col("idx_a") - F.col("idx_b")) <= 1))
    best = [F.desc(F.round("score", 9)), F.col("dst")]  # sums in another order differ in the last digits
    a = members.drop("folded").toDF("a", "src", "poem_a", "idx_a", "lang_a")
    b = members.toDF("b", "dst", "poem_b", "idx_b", "lang_b", "folded")
    rows = pairs.select(F.col("src").alias("a"), F.col("dst").alias("b"), "score").join(b, "b")
    if dedup and not (exclude_first and (exclude_same_poem or exclude_adjacent)):
        # One more than is looked at, as a verse is not its own neighbour.
        rows = rows.withColumn("_p", F.row_number().over(Window.partitionBy("a").orderBy(*best))).where(F.col("_p") <= over * k + 1)
    rows = rows.join(a, "a").where("src <> dst")
    rows = rows.withColumn("mtype", match_type(F.col("poem_a"), F.col("poem_b"), F.col("lang_a"), F.col("lang_b")))
    rows = rows.where(~gone) if exclude_first else rows
    if dedup:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy(*best))).where(F.col("_r") <= over * k)
        rows = rows.withColumn("_t", F.row_number().over(Window.partitionBy("src", "folded").orderBy("_r"))).where("_t = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(*best))).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
    if not exclude_first:
        rows = rows.where(~gone).withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("rank")) - 1)
    return rows.select("src", "rank", "dst", "score", "mtype")
