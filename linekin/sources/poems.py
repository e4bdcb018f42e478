"""Readers of poem chunks, translations, neighbour lists, memberships, glosses, lexicons and labelled pairs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linekin.functions.text import PREFIX_RULES, is_positive, language, stripped
from linekin.functions.unicode import html_unescape, nfc

POEM = T.MapType(T.StringType(), T.StructType([T.StructField(n, k) for n, k in (("v", T.ArrayType(T.StringType())), ("p", T.ArrayType(T.StringType())), ("y", T.StringType()), ("text", T.StringType()), ("places", T.ArrayType(T.StringType())), ("year", T.StringType()))]))
NEIGHBOUR = "_header boolean, v string, g int, m array<array<string>>"
MEMBERSHIP = "cluster_id long, size int, members array<string>"


def split_verses(text: Column) -> Column:
    """Verses of one text: cut at ' / ', else at line breaks, else whole; trimmed, blanks dropped."""
    parts = F.when(F.contains(text, F.lit(" / ")), F.split(text, " / ")).otherwise(F.split(text, "\n"))
    return F.filter(F.transform(parts, stripped), lambda v: v != "")


def verses(texts: DataFrame, poem_id: str, verses_: Column, *keep: str) -> DataFrame:
    """(vid, poem_id, idx, text) and kept columns, a row for each verse; ``vid`` is the poem's id, a colon, the place."""
    poem = F.col(poem_id).cast("string")
    rows = texts.select(poem.alias("poem_id"), *keep, F.posexplode(verses_).alias("idx", "text"))
    return rows.withColumn("vid", F.concat_ws(":", "poem_id", F.col("idx").cast("string")))


def read_poems(spark: SparkSession, path: str) -> DataFrame:
    """Poem chunks (``poems_chunk_*.json``) of either shape as (vid, poem_id, idx, text, places, year).

    Ids are HTML-decoded and texts composed (NFC) here, once, so that ids meet across lists and words compare as they should.

    The old shape maps ids to ``{v, p, y}``, the new one has them under ``poems`` as ``{text, places, year}``.
    """
    raw = spark.read.text(path if path.endswith(".json") else f"{path}/poems_chunk_*.json", wholetext=True)
    new = F.from_json("value", T.StructType([T.StructField("poems", POEM)]))["poems"]
    rows = raw.select(F.coalesce(new, F.from_json("value", POEM)).alias("poems")).select(F.explode("poems").alias("poem_id", "poem"))
    rows = rows.where("poem_id <> 'metadata' and poem is not null")
    own = F.coalesce(F.filter(F.transform("poem.v", stripped), lambda v: v != ""), split_verses(F.col("poem.text")))
    rows = rows.select(html_unescape(F.col("poem_id")).alias("poem_id"), own.alias("verses"), F.coalesce("poem.p", "poem.places").alias("places"), F.coalesce("poem.y", "poem.year").alias("year"))
    return verses(rows, "poem_id", F.col("verses"), "places", "year").withColumn("text", nfc(F.col("text")))


def poem_of(vid: Column) -> Column:
    """The poem's id of a verse id, which ends at the last colon."""
    return F.regexp_extract(vid, r"^(.*):([0-9]+)$", 1)


def registry(translations: DataFrame, wanted_poems: DataFrame) -> DataFrame:
    """(vid, text, reason) of translated lines (poem_id, t, f); ``reason`` is null for those that go on.

    A poem must be in the index (poem_id); flagged and blank lines are rejected, each with its reason.
    """
    known = wanted_poems.select("poem_id", F.lit(True).alias("known")).distinct()
    rows = translations.join(known, "poem_id", "left").select("poem_id", "known", F.posexplode(F.arrays_zip("t", "f")).alias("idx", "line"))
    reason = F.when(F.col("known").isNull(), "poem not in index").when(F.col("line.f") != 0, "flagged").when(F.coalesce(stripped(F.col("line.t")), F.lit("")) == "", "blank")
    return rows.select(F.concat_ws(":", "poem_id", F.col("idx").cast("string")).alias("vid"), stripped(F.col("line.t")).alias("text"), reason.alias("reason"))


def read_neighbours(spark: SparkSession, path: str, algo: str) -> DataFrame:
    """(algo, src, rank, dst, score) of a neighbour list, plain or gzipped JSON lines; the header line is left out."""
    rows = spark.read.schema(NEIGHBOUR).json([f"{path}.jsonl"] if _exists(spark, f"{path}.jsonl") else [f"{path}.jsonl.gz"] if not path.endswith((".jsonl", ".gz")) else [path])
    rows = rows.where("_header is null").select(F.col("v").alias("src"), F.posexplode("m").alias("rank", "n"))
    return rows.select(F.lit(algo).alias("algo"), "src", "rank", F.col("n")[0].alias("dst"), F.col("n")[1].cast("double").alias("score"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_membership(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(cluster_id, vid) of a membership file, optionally only of the wanted vids."""
    rows = spark.read.schema(MEMBERSHIP).json(path).select("cluster_id", F.explode("members").alias("vid"))
    return rows if wanted is None else rows.join(wanted.select("vid"), "vid", "left_semi").select("cluster_id", "vid")


def first_cluster(membership: DataFrame) -> DataFrame:
    """(vid, cluster_id): the first cluster of each verse."""
    return membership.groupBy("vid").agg(F.min("cluster_id").alias("cluster_id"))


def with_language(rows: DataFrame, to_left: Iterable[str] = (), to_right: Iterable[str] = (), left: str = "fi", right: str = "et", rules: Sequence[tuple[str, str, str]] = PREFIX_RULES) -> DataFrame:
    """Adds (corpus, lang) by id prefix; the listed poems get ``left`` or ``right`` whatever their prefix (left first)."""
    corpus, lang = language(F.col("poem_id"), rules)
    a, b = [F.col("poem_id").isin(list(x)) if list(x) else F.lit(False) for x in (list(to_left), list(to_right))]
    return rows.withColumn("corpus", corpus).withColumn("lang", F.when(a, left).when(b, right).otherwise(lang))


def read_overrides(spark: SparkSession, path: str, field: str = "finnish_pids") -> DataFrame:
    """(poem_id) of a JSON document whose ``field`` lists objects with a ``pid``."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"{field} array<struct<pid: string>>")[field].alias("l"))
    return rows.select(F.explode("l.pid").alias("poem_id")).distinct()


def flipped(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Metadata (poem_id, lang, ...) with overrides (poem_id, from_lang, to_lang): flips only where from_lang is stored."""
    o = F.broadcast(overrides.select(F.col("poem_id").alias("_p"), "from_lang", "to_lang")) if overrides.count() <= 10_000 else overrides.select(F.col("poem_id").alias("_p"), "from_lang", "to_lang")
    out = rows.join(o, (F.col("poem_id") == F.col("_p")) & (F.col("lang") == F.col("from_lang")), "left")
    return out.withColumn("lang", F.coalesce("to_lang", "lang")).drop("_p", "from_lang", "to_lang")


def gloss(entries: DataFrame, include_fallback: bool = False) -> DataFrame:
    """(wordform, english, pos, reason) of (wordform, entry array); the reason why an entry is left out, or null."""
    e = F.col("entry")
    text = stripped(F.get(e, F.lit(1)))
    reason = F.when(e.isNull() | (F.size(e) < 2), "malformed").when((F.size(e) >= 5) & F.lit(not include_fallback), "fallback").when(F.coalesce(text, F.lit("")) == "", "empty").when(text == "—", "dash")
    return entries.select("wordform", text.alias("english"), F.get(e, F.lit(2)).alias("pos"), reason.alias("reason"))


def lexicon(entries: DataFrame) -> DataFrame:
    """(wordform, place, l, c, e, s, j) of (l, c, e, s, j, w array, place) entries; word forms in lower case."""
    return entries.select(F.explode("w").alias("wordform"), "place", "l", "c", "e", "s", "j").withColumn("wordform", F.lower("wordform"))


def gold_pairs(sample: DataFrame, results: DataFrame) -> DataFrame:
    """(id1, id2, text1, text2, positive) of sampled pairs with a class 's' or 'd'."""
    return sample.join(results.where(F.col("class").isin("s", "d")), ["id1", "id2"]).select("id1", "id2", "text1", "text2", is_positive(F.col("class")).alias("positive"))


def majority(votes: DataFrame, least: int = 2) -> DataFrame:
    """(id1, id2, votes, positive): positive if at least ``least`` annotators say so."""
    return votes.groupBy("id1", "id2").agg(F.sum(F.col("positive").cast("long")).alias("votes")).withColumn("positive", F.col("votes") >= least)


def external_clusters(spark: SparkSession, path: str, clustering: str = "0") -> DataFrame:
    """(text, cluster_id) of a TSV of (clustering, text, cluster)."""
    rows = spark.read.csv(path, sep="\t", schema="clustering string, text string, cluster_id string", quote="")
    return rows.where((F.col("clustering") == clustering) & F.col("cluster_id").isNotNull()).select("text", "cluster_id")


def suspects(rows: DataFrame, runos: Sequence[str] = ("KR 50", "KR 53")) -> DataFrame:
    """Rows whose poem_id, up to its first colon, is one of the runos."""
    return rows.where(F.substring_index("poem_id", ":", 1).isin(list(runos)))


def last_write_wins(batches: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several batches, a later batch replacing a key's row of an earlier one."""
    every = None
    for i, b in enumerate(batches):
        b = b.withColumn("_batch", F.lit(i))
        every = b if every is None else every.unionByName(b)
    last = every.groupBy(key).agg(F.max_by(F.struct(*[c for c in every.columns if c not in (key, "_batch")]), "_batch").alias("_row"))
    return last.select(key, "_row.*")
