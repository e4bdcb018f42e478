"""The library's registered queries over the test tables, each with its DuckDB oracle where SQL can say it.

Documents are poems and their lines verses; parts of an order, or of a supplier, stand for clusters of verses.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linekin.functions import text as X
from linekin.operators import ablation, cluster, compare, cross, dense, evaluate, fuse, lookup, neighbours, sample, stats, themes
from linekin.operators import similarity as S
from linekin.plans.storage import stored
from linekin.sources.poems import split_verses, verses

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- verses, tokens, vocabulary -------------------------------------------------------------------------------------

_SPACE = r"'^\s+|\s+$', '', 'g'"
V = rf"""verses AS (
  SELECT CAST(doc_id AS VARCHAR) AS poem_id, CAST(i AS INT) AS idx, l[i + 1] AS text, lang, source, CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR) AS vid
  FROM (SELECT doc_id, lang, source, list_filter(list_transform(CASE WHEN contains(text, ' / ') THEN string_split(text, ' / ') ELSE string_split(text, chr(10)) END,
          lambda x: regexp_replace(x, {_SPACE})), lambda x: x <> '') AS l FROM documents) d, unnest(range(len(l))) AS u(i))"""
T = rf"""{V},
words AS (SELECT DISTINCT vid, w AS token FROM (SELECT vid, unnest(list_transform(regexp_split_to_array(text, '\s+'),
          lambda x: regexp_replace(regexp_replace(lower(x), {_SPACE}), '[.,;:!?"''„“”‘’«»\-–—()\[\]{{}}]', '', 'g'))) AS w FROM verses) WHERE length(w) >= 2),
toks AS (SELECT * FROM words WHERE vid IN (SELECT vid FROM words GROUP BY vid HAVING count(*) >= 2)),
n AS (SELECT count(DISTINCT vid) AS n FROM toks),
freq AS (SELECT token, count(*) AS df FROM toks GROUP BY token),
vocab AS (SELECT token, df, ln(n.n / df) AS idf FROM freq, n WHERE df >= 5 AND df <= floor(n.n * 0.05)),
wt AS (SELECT t.vid, t.token, v.idf FROM toks t JOIN vocab v ON v.token = t.token)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verses(table(spark, sf_dir, "documents"), "doc_id", split_verses(F.col("text")), "lang", "source")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted tokens of the lines; written once, as they are read several times."""
    toks = stored(S.tokens(lines(spark, sf_dir)), "tokens")
    return stored(S.weighted(toks, S.vocabulary(toks)), "weights")


@query(f"WITH {V} SELECT vid, poem_id, idx, text FROM verses")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("vid", "poem_id", "idx", "text")


@query(f"WITH {V} SELECT vid, idx FROM verses ORDER BY vid LIMIT 500")
def line_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("vid", "idx").orderBy("vid").limit(500)


@query(f"WITH {T} SELECT vid, token FROM toks")
def line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tokens(lines(spark, sf_dir))


@query(f"WITH {T} SELECT token, df, round(idf, 9) AS idf FROM vocab")
def vocab_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vocabulary(S.tokens(lines(spark, sf_dir))).select("token", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {T} SELECT count(*) FILTER (df > floor(n.n * 0.05)) AS too_common, count(*) FILTER (df < 5) AS too_rare, count(*) FILTER (df >= 5 AND df <= floor(n.n * 0.05)) AS kept FROM freq, n")
def vocab_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vocabulary_statistics(S.tokens(lines(spark, sf_dir)))


@query(f"WITH {T} SELECT vid, count(*) AS n, round(sqrt(sum(idf * idf)), 9) AS norm, round(sum(idf), 9) AS total FROM wt GROUP BY vid")
def weight_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weights(spark, sf_dir)
    return w.groupBy("vid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.sum(F.col("idf") * F.col("idf"))), 9).alias("norm"), F.round(F.sum("idf"), 9).alias("total"))


@query(f"WITH {T} SELECT vid, token FROM words WHERE token NOT IN ({', '.join(repr(w) for w in X.STOPWORDS)})")
def stopword_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tokens(lines(spark, sf_dir), X.words(F.col("text"), exclude_stopwords=True), least=1)


_CASES = " ".join(f"WHEN starts_with(id, '{p}') THEN '{c}|{g}'" for p, c, g in X.PREFIX_RULES)
_CASES += " ".join([""] + [f"WHEN starts_with(lower(id), '{p}') THEN '{c}|{g}'" for p, c, g in X.FOLDED_RULES])
_CASES += " WHEN starts_with(id, 'Vana kannel') THEN 'Vana_kannel|et' WHEN regexp_matches(id, '^[0-9]') THEN 'numeric|et'"
_IDS = "SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'SKVR I' WHEN 1 THEN 'JR 03705' WHEN 2 THEN 'KR 50' WHEN 3 THEN 'Kalevipoeg 3' WHEN 4 THEN 'Kanteletar' WHEN 5 THEN 'Polén 3' WHEN 6 THEN 'H II' WHEN 7 THEN 'era 1' WHEN 8 THEN 'Vana kannel' WHEN 9 THEN '60878/9' WHEN 10 THEN '' ELSE p_name END AS id FROM part"


@query(f"SELECT p_partkey, id, split_part(r, '|', 1) AS corpus, split_part(r, '|', 2) AS lang FROM (SELECT *, CASE WHEN id = '' THEN 'other|other' {_CASES} ELSE 'other|other' END AS r FROM ({_IDS}))")
def lang_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("linekin_part")
    ids = spark.sql(_IDS.replace("FROM part", "FROM linekin_part"))
    corpus, lang = X.language(F.col("id"))
    return ids.select("p_partkey", "id", corpus.alias("corpus"), lang.alias("lang"))


# ---- similarity legs --------------------------------------------------------------------------------------------------


def _pairs(idf: bool, shared: str = "count(*) >= 2") -> str:
    w = "idf" if idf else "1.0::DOUBLE"
    return f"""sz AS (SELECT vid, count(*) AS n, sum({w}) AS total FROM wt GROUP BY vid),
pr AS (SELECT a.vid AS src, b.vid AS dst, count(*) AS shared, sum(a.{'idf' if idf else 'one'}) AS both_ FROM (SELECT *, 1.0::DOUBLE AS one FROM wt) a JOIN wt b ON a.token = b.token AND a.vid <> b.vid GROUP BY 1, 2 HAVING {shared}),
pairs AS (SELECT src, dst, shared, both_ / (x.total + y.total - both_) AS score, x.n AS n_src FROM pr JOIN sz x ON x.vid = src JOIN sz y ON y.vid = dst WHERE both_ / (x.total + y.total - both_) >= 0.2)"""


_COS = """nm AS (SELECT vid, sqrt(sum(idf * idf)) AS norm FROM wt GROUP BY vid), un AS (SELECT wt.vid, token, idf / norm AS u FROM wt JOIN nm ON nm.vid = wt.vid WHERE norm > 0),
pairs AS (SELECT a.vid AS src, b.vid AS dst, sum(a.u * b.u) AS score FROM un a JOIN un b ON a.token = b.token AND a.vid <> b.vid GROUP BY 1, 2 HAVING sum(a.u * b.u) >= 0.15)"""


def _top(k: int = 50, before: str = "true", after: str = "true", dedup: bool = True, src: str = "pairs") -> str:
    first = "r <= %d" % (5 * k) if dedup else "true"
    t = "t = 1" if dedup else "true"
    return f"""ds AS (SELECT p.src, p.dst, p.score, a.poem_id AS pa, b.poem_id AS pb, a.idx AS ia, b.idx AS ib, lower(b.text) AS folded,
  CASE WHEN a.poem_id = b.poem_id THEN 'w' WHEN a.lang <> b.lang AND a.lang <> 'other' AND b.lang <> 'other' THEN 'x' ELSE 's' END AS mtype
  FROM {src} p JOIN verses a ON a.vid = p.src JOIN verses b ON b.vid = p.dst),
d1 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) AS r FROM ds WHERE {before}),
d2 AS (SELECT *, row_number() OVER (PARTITION BY src, folded ORDER BY r) AS t FROM d1 WHERE {first}),
d3 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) - 1 AS rk FROM d2 WHERE {t}),
top AS (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY rk) - 1 AS INT) AS rank, dst, score, mtype FROM d3 WHERE rk < {k} AND {after})"""


_TOP_ = _top()
_OUT = "SELECT src, rank, dst, round(score, 6) AS score, mtype FROM top"


def _rows(top: DataFrame) -> DataFrame:
    return top.select("src", F.col("rank").cast("int").alias("rank"), "dst", F.round("score", 6).alias("score"), "mtype")


def legs(verses_: DataFrame, w: DataFrame, measures: tuple[str, ...], k: int = 50, adaptive: bool = False, **options: bool) -> dict[str, DataFrame]:
    """Ranked lists of the verses by several measures of their weighted tokens, from one product."""
    found = stored(neighbours.neighbour_lists(verses_, w, measures, k, adaptive=adaptive, **options), "lists")
    return {m: found.where(F.col("measure") == m).drop("measure") for m in measures}


def line_legs(spark: SparkSession, sf_dir: str, measures: tuple[str, ...], k: int = 50, extract: Column | None = None, weigh: Query = weights, **options: bool) -> dict[str, DataFrame]:
    """``legs`` of the lines from their bags of tokens, which ``extract`` gives.

    Where documents share an id, or lack one, so do lines; then their tokens are joined by id, as ``weigh`` does.
    """
    ids = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    if ids["n"] != ids["ids"]:
        return legs(lines(spark, sf_dir), weigh(spark, sf_dir), measures, k, **options)
    found = stored(neighbours.bag_lists(neighbours.bags(lines(spark, sf_dir), extract), measures, k, **options), "lists")
    return {m: found.where(F.col("measure") == m).drop("measure") for m in measures}


def _leg(spark: SparkSession, sf_dir: str, measure: str, **options: bool) -> DataFrame:
    return line_legs(spark, sf_dir, (measure,), **options)[measure]


@query(f"WITH {T}, {_pairs(False)}, {_top()} {_OUT}")
def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_leg(spark, sf_dir, "jaccard"))


@query(f"WITH {T}, {_pairs(True)}, {_top()} {_OUT}")
def jaccard_idf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_leg(spark, sf_dir, "jaccard_idf"))


@query(f"WITH {T}, {_pairs(False, 'true').replace('>= 0.2)', '>= 0.2 AND shared >= least(2, x.n))')}, {_top()} {_OUT}")
def jaccard_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_leg(spark, sf_dir, "jaccard", adaptive=True))


_SAME = "pa <> pb"


@query(f"WITH {T}, {_pairs(False)}, {_top(before=_SAME)} {_OUT}")
def jaccard_exclude_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_leg(spark, sf_dir, "jaccard", exclude_same_poem=True))


@query(f"WITH {T}, {_pairs(False)}, {_top(before='NOT (pa = pb AND abs(ia - ib) <= 1)')} {_OUT}")
def jaccard_exclude_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_leg(spark, sf_dir, "jaccard", exclude_adjacent=True))


@query(f"WITH {T}, {_COS}, {_top()} {_OUT}")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_leg(spark, sf_dir, "cosine"))


@query(f"WITH {T}, {_COS}, {_top(after=_SAME)} {_OUT}")
def tfidf_exclude_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_leg(spark, sf_dir, "cosine", exclude_same_poem=True, exclude_first=False))


@query(f"WITH {T}, {_pairs(False)}, {_top()} SELECT mtype, count(*) AS pairs, count(DISTINCT src) AS verses FROM top GROUP BY mtype")
def match_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mtype_counts(_leg(spark, sf_dir, "jaccard"))


_BG = r"""bg AS (SELECT p_partkey, s, unnest(list_distinct(list_transform(range(1, length(s)), lambda i: substring(s, i, 2)))) AS token FROM
  (SELECT p_partkey, regexp_replace(lower(p_name), '\s+', ' ', 'g') AS s FROM part) WHERE length(s) >= 2),
bv AS (SELECT token, count(*) AS df FROM bg GROUP BY token ORDER BY df DESC, token LIMIT 200)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.regexp_replace(F.lower("p_name"), r"\s+", " ")
    return p.select(F.col("p_partkey").cast("string").alias("vid"), name.alias("text")).where(F.length("text") >= 2)


@query(f"WITH {_BG} SELECT token, df FROM bv")
def bigram_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bigram_vocabulary(_names(spark, sf_dir), F.col("text"))


@query(f"""WITH {_BG}, k AS (SELECT CAST(p_partkey AS VARCHAR) AS vid, bg.token FROM bg JOIN bv ON bv.token = bg.token), c AS (SELECT vid, count(*) AS n FROM k GROUP BY vid),
p AS (SELECT a.vid AS src, b.vid AS dst, count(*) / sqrt(x.n * y.n) AS score FROM k a JOIN k b ON a.token = b.token AND a.vid <> b.vid JOIN c x ON x.vid = a.vid JOIN c y ON y.vid = b.vid GROUP BY a.vid, b.vid, x.n, y.n HAVING count(*) / sqrt(x.n * y.n) >= 0.6)
SELECT src, CAST(r AS INT) AS rank, dst, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) - 1 AS r FROM p) WHERE r < 50""")
def bigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names have few bigrams, so this table of names stands in blocks rather than in posting lists; equal names are compared once."""
    names = _names(spark, sf_dir)
    vocab = S.bigram_vocabulary(names, F.col("text")).agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    groups = names.groupBy("text").agg(F.sort_array(F.collect_list("vid")).alias("ids"))
    groups = stored(groups.select(F.col("ids")[0].alias("rep"), "ids", "text"), "equal-names")
    rows = groups.crossJoin(F.broadcast(vocab))
    grams = X.char_ngrams(F.col("text"), 2)
    rows = rows.select("rep", F.transform("tokens", lambda t: F.array_contains(grams, t).cast("double")).alias("vec"))
    vectors = stored(dense.normalized(rows), "name-vectors")
    near = stored(dense.exact_neighbours(vectors, "rep", min_score=0.6), "name-lists")
    groups = groups.join(vectors.select("rep"), "rep", "left_semi").select("rep", "ids")
    return dense.of_copies(near, groups).select("src", "rank", "dst", F.round("score", 6).alias("score"))


_E = """ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
mean AS MATERIALIZED (SELECT list(m ORDER BY k) AS m FROM (SELECT k, avg(x) AS m FROM (SELECT unnest(e) AS x, unnest(range(len(e))) AS k FROM ev) GROUP BY k)),
ce AS MATERIALIZED (SELECT vec_id, list_transform(list_zip(e, m), lambda z: z[1] - z[2]) AS c FROM ev, mean),
nc AS MATERIALIZED (SELECT vec_id, c, sqrt(list_dot_product(c, c)) AS norm FROM ce),
un AS MATERIALIZED (SELECT vec_id, list_transform(c, lambda x: x / norm) AS u FROM nc WHERE norm > 0),
pe AS MATERIALIZED (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.u, b.u) AS score FROM un a JOIN un b ON a.vec_id <> b.vec_id),
te AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) - 1 AS rank FROM pe) WHERE rank < 50)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.centred(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec")))


@query(f"WITH {_E} SELECT vec_id AS vid, round(u[1], 9) AS first, round(u[64], 9) AS last FROM un")
def embed_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vid", F.round(F.col("vec")[0], 9).alias("first"), F.round(F.col("vec")[63], 9).alias("last"))


@query(f"WITH {_E} SELECT src, CAST(rank AS INT) AS rank, dst, round(score, 6) AS score FROM te")
def embed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.exact_neighbours(stored(_vectors(spark, sf_dir), "centred")).select("src", "rank", "dst", F.round("score", 6).alias("score"))


@query(f"""WITH {_E}, h AS (SELECT * FROM te WHERE score >= 0.05), lo AS (SELECT src, count(*) AS n, avg(score) + 2 * stddev_pop(score) AS f FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 9), dst) AS r FROM h) WHERE r <= 10 GROUP BY src)
SELECT h.src, CAST(rank AS INT) AS rank, dst, round(score, 6) AS score FROM h JOIN lo ON lo.src = h.src WHERE score >= CASE WHEN n >= 10 AND f > 0.05 THEN f ELSE 0.05 END""")
def embed_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = dense.exact_neighbours(stored(_vectors(spark, sf_dir), "centred"))
    return dense.adaptive_floor(top, hard=0.05).select("src", "rank", "dst", F.round("score", 6).alias("score"))


@query()
def embed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the cell-based search against the exact lists."""
    v = stored(_vectors(spark, sf_dir), "centred")
    return dense.recall(dense.cell_neighbours(v, k=20), dense.exact_neighbours(v, k=20))


# ---- fusion and clusters ------------------------------------------------------------------------------------------------

def _lists(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("jaccard", "jaccard_idf", "tfidf")) -> dict[str, DataFrame]:
    measure = {"jaccard": "jaccard", "jaccard_idf": "jaccard_idf", "tfidf": "cosine"}
    found = line_legs(spark, sf_dir, tuple(measure[n] for n in names))
    return {n: found[measure[n]] for n in names}


def _three(which: tuple[int, ...] = (0, 1, 2)) -> str:
    legs = [(_pairs(False), 0, "jaccard"), (_pairs(True), 1, "jaccard_idf"), (_COS, 2, "tfidf")]
    parts, names = [], []
    for i, (body, no, name) in enumerate(legs):
        if i not in which:
            continue
        parts.append(f"l{i} AS (WITH {body}, {_top()} SELECT '{name}' AS algo, {len(names)} AS no, src, rank, dst FROM top)")
        names.append(f"SELECT * FROM l{i}")
    return ", ".join(parts) + f", every AS ({' UNION ALL '.join(names)}), " + """fz AS (SELECT src, dst, sum(1.0::DOUBLE / (60 + rank)) AS rrf, count(DISTINCT algo) AS n_algos, min(no * 1000 + rank) AS f FROM every WHERE rank < 30 GROUP BY src, dst HAVING count(DISTINCT algo) >= 2 AND sum(1.0::DOUBLE / (60 + rank)) >= 0.033),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(rrf, 12) DESC, f, dst) - 1 AS rank FROM fz) WHERE rank < 20)"""


_FUSED = "SELECT src, CAST(rank AS INT) AS rank, dst, round(rrf, 9) AS rrf, n_algos FROM fu"


def _fused_rows(fused: DataFrame) -> DataFrame:
    return fused.select("src", F.col("rank").cast("int").alias("rank"), "dst", F.round("rrf", 9).alias("rrf"), "n_algos")


@query(f"WITH {T}, {_three()} {_FUSED}")
def rrf_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused_rows(fuse.fused(fuse.union_lists(_lists(spark, sf_dir))))


@query(f"WITH {T}, {_three((0, 2))} {_FUSED}")
def rrf_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused_rows(fuse.fused(fuse.union_lists(_lists(spark, sf_dir, ("jaccard", "tfidf")))))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(fuse.fused(fuse.union_lists(_lists(spark, sf_dir))), "fused")


@query()
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.clusters(_fused(spark, sf_dir))


@query()
def clusters_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.merged(stored(cluster.clusters(_fused(spark, sf_dir)), "clusters"))


@query()
def cluster_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fused(spark, sf_dir)
    return stats.cohesion(stored(cluster.clusters(f), "clusters"), f)


# ---- statistics of clusters: parts of an order, against parts of a supplier --------------------------------------------------

M = """m AS (SELECT DISTINCT l_orderkey AS cluster_id, l_partkey AS vid FROM lineitem), b AS (SELECT DISTINCT l_suppkey AS cluster_id, l_partkey AS vid FROM lineitem),
pm AS (SELECT m.cluster_id, m.vid, CASE p_size % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'r' ELSE 'other' END AS lang, p_name AS text, p_brand AS poem_id, p_type AS source FROM m JOIN part ON p_partkey = vid),
s AS (SELECT cluster_id, count(*) AS size FROM m GROUP BY cluster_id)"""


def membership(spark: SparkSession, sf_dir: str, by: str = "l_orderkey") -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col(by).alias("cluster_id"), F.col("l_partkey").alias("vid")).distinct()


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    lang = F.when(F.col("p_size") % 3 == 0, "l").when(F.col("p_size") % 3 == 1, "r").otherwise("other")
    p = p.select(F.col("p_partkey").alias("vid"), lang.alias("lang"), F.col("p_name").alias("text"), F.col("p_brand").alias("poem_id"), F.col("p_type").alias("source"))
    return membership(spark, sf_dir).join(p, "vid").select("cluster_id", "vid", "lang", "text", "poem_id", "source")


@query(f"WITH {M} SELECT CASE WHEN size = 5 THEN '5' WHEN size <= 10 THEN '6-10' WHEN size <= 20 THEN '11-20' WHEN size <= 50 THEN '21-50' WHEN size <= 100 THEN '51-100' WHEN size <= 500 THEN '101-500' ELSE '500+' END AS bin, count(*) AS clusters FROM s GROUP BY 1")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size_histogram(membership(spark, sf_dir))


@query(f"WITH {M}, g AS (SELECT cluster_id, bool_or(lang = 'l') AS l, bool_or(lang = 'r') AS r FROM pm GROUP BY cluster_id) SELECT CASE WHEN l AND r THEN 'mixed' WHEN l THEN 'l-only' WHEN r THEN 'r-only' ELSE 'other' END AS composition, count(*) AS clusters FROM g GROUP BY 1")
def cluster_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.composition(members(spark, sf_dir), "l", "r")


@query(f"WITH {M} SELECT count(*) AS n, round(1 + count(*) / sum(ln(size / 1.5)), 9) AS alpha FROM s WHERE size >= 2")
def cluster_powerlaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.power_law(membership(spark, sf_dir)).select("n", F.round("alpha", 9).alias("alpha"))


@query(f"""WITH {M}, c AS (SELECT count(DISTINCT vid) AS covered FROM m), t AS (SELECT count(*) AS n FROM part)
SELECT count(*) AS clusters, CAST(sum(size) AS BIGINT) AS assignments, any_value(covered) AS covered, round(any_value(covered) / any_value(n), 9) AS coverage, round(sum(size) / any_value(covered), 9) AS clusters_per_verse, min(size) AS min_size, max(size) AS max_size, round(avg(size), 9) AS mean_size, quantile_cont(size, 0.5) AS median_size FROM s, c, t""")
def cluster_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.coverage(membership(spark, sf_dir), table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n")))
    return reduce(lambda d, c: d.withColumn(c, F.round(c, 9)), ("coverage", "clusters_per_verse", "mean_size"), out)


@query(f"""WITH {M}, t AS (SELECT cluster_id, size, row_number() OVER (ORDER BY size DESC, cluster_id) AS cluster_rank FROM s QUALIFY cluster_rank <= 20),
r AS (SELECT pm.*, t.size, t.cluster_rank, row_number() OVER (PARTITION BY pm.cluster_id ORDER BY vid) AS place FROM pm JOIN t ON t.cluster_id = pm.cluster_id),
q AS (SELECT cluster_rank, lang, count(*) AS n FROM r GROUP BY ALL), mo AS (SELECT cluster_rank, min(lang) AS modal_lang FROM (SELECT *, max(n) OVER (PARTITION BY cluster_rank) AS top FROM q) WHERE n = top GROUP BY 1)
SELECT CAST(r.cluster_rank AS INT) AS cluster_rank, cluster_id, size, list_sort(list_distinct(list(lang) FILTER (place <= 20))) AS languages, list_sort(list_distinct(list(source) FILTER (place <= 20))) AS sources, any_value(modal_lang) AS modal_lang, list(text ORDER BY place) FILTER (place <= 5) AS examples
FROM r JOIN mo ON mo.cluster_rank = r.cluster_rank GROUP BY r.cluster_rank, cluster_id, size""")
def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_report(members(spark, sf_dir))


@query(f"WITH {M} SELECT cluster_id, count(*) AS size, list(vid ORDER BY vid) AS members FROM m GROUP BY cluster_id")
def membership_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linekin.sources.sinks import membership_rows

    return membership_rows(membership(spark, sf_dir)).withColumn("size", F.col("size").cast("long"))


X_ = """x AS (SELECT cluster_id, count(*) AS size, count(*) FILTER (lang = 'l') AS n_left, count(*) FILTER (lang = 'r') AS n_right, count(*) FILTER (lang = 'l') * count(*) FILTER (lang = 'r') AS pair_count FROM pm GROUP BY cluster_id HAVING n_left > 0 AND n_right > 0)"""


@query(f"WITH {M}, {X_} SELECT * FROM x")
def cross_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross.cross_clusters(members(spark, sf_dir), "l", "r")


@query(f"WITH {M} SELECT a.cluster_id, a.vid AS left_vid, b.vid AS right_vid FROM pm a JOIN pm b ON a.cluster_id = b.cluster_id AND a.lang = 'l' AND b.lang = 'r'")
def cluster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross.cluster_pairs(members(spark, sf_dir), "l", "r")


@query(f"""WITH {M}, {X_}, o AS (SELECT pm.* FROM pm SEMI JOIN x ON x.cluster_id = pm.cluster_id)
SELECT (SELECT CAST(sum(pair_count) AS BIGINT) FROM x) AS pairs, (SELECT count(*) FROM x) AS clusters, count(DISTINCT CASE WHEN lang = 'l' THEN vid END) AS left_verses, count(DISTINCT CASE WHEN lang = 'r' THEN vid END) AS right_verses, count(DISTINCT poem_id) AS poems FROM o""")
def cross_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross.pair_counts(members(spark, sf_dir), "l", "r")


def _gram(n: int) -> str:
    g = lambda s: f"CASE WHEN length({s}) >= {n} THEN list_distinct(list_transform(range(1, length({s}) - {n - 2}), lambda i: substring({s}, i, {n}))) ELSE [] END"
    return f"(CASE WHEN len(list_distinct(list_concat({g('ls')}, {g('rs')}))) > 0 THEN len(list_intersect({g('ls')}, {g('rs')})) / len(list_distinct(list_concat({g('ls')}, {g('rs')}))) ELSE 0 END)"


FM = rf"""{X_}, pl AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, lang ORDER BY vid) AS place FROM pm WHERE lang IN ('l', 'r')),
wd AS (SELECT DISTINCT cluster_id, lang, w FROM (SELECT cluster_id, lang, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM pl WHERE place <= 10) WHERE w <> ''),
st AS (SELECT cluster_id, coalesce(list(w ORDER BY w) FILTER (lang = 'l'), []) AS lw, coalesce(list(w ORDER BY w) FILTER (lang = 'r'), []) AS rw FROM wd GROUP BY cluster_id),
ss AS (SELECT *, array_to_string(lw, ' ') AS ls, array_to_string(rw, ' ') AS rs FROM st),
an AS (SELECT x.*, {_gram(1)} AS j1, {_gram(2)} AS j2, {_gram(3)} AS j3, len(list_intersect(lw, rw)) / greatest(len(list_distinct(list_concat(lw, rw))), 1) AS jw FROM x JOIN ss ON ss.cluster_id = x.cluster_id)"""


@query(f"WITH {M}, {FM} SELECT cluster_id, size, n_left, n_right, pair_count, round(j1, 9) AS char_unigram_jaccard, round(j2, 9) AS char_bigram_jaccard, round(j3, 9) AS char_trigram_jaccard, round(jw, 9) AS word_jaccard, CASE WHEN j1 > 0.4 THEN 'form_based' ELSE 'meaning_based' END AS category FROM an")
def form_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cross.analysed(members(spark, sf_dir), "l", "r")
    return reduce(lambda d, c: d.withColumn(c, F.round(c, 9)), [c for c in out.columns if c.endswith("jaccard")], out)


@query(f"WITH {M}, {FM}, f AS (SELECT *, CAST(j1 > 0.4 AS DOUBLE) AS form FROM an) SELECT round(avg(form), 9) AS by_cluster, round(sum(form * size) / sum(size), 9) AS by_size, round(sum(form * pair_count) / sum(pair_count), 9) AS by_pairs FROM f")
def weighted_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cross.weighted_ratios(cross.analysed(members(spark, sf_dir), "l", "r"))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


P = """na AS (SELECT cluster_id, count(*) AS n FROM m GROUP BY 1), nb AS (SELECT cluster_id, count(*) AS n FROM b GROUP BY 1),
ov AS (SELECT m.cluster_id, b.cluster_id AS base_id, count(*) AS c FROM m JOIN b ON b.vid = m.vid GROUP BY 1, 2),
pv AS (SELECT na.cluster_id, coalesce(max(c / (na.n + nb.n - c)), 0.0) AS best FROM na LEFT JOIN ov ON ov.cluster_id = na.cluster_id LEFT JOIN nb ON nb.cluster_id = ov.base_id GROUP BY 1)"""


@query(f"WITH {M}, {P} SELECT cluster_id, round(best, 9) AS best, CASE WHEN best >= 0.7 THEN 'retained' WHEN best >= 0.3 THEN 'expanded' ELSE 'novel' END AS provenance FROM pv")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cross.provenance(membership(spark, sf_dir), membership(spark, sf_dir, "l_suppkey"))
    return out.withColumn("best", F.round("best", 9))


@query(f"WITH {M}, {P}, {FM} SELECT CASE WHEN best >= 0.7 THEN 'retained' WHEN best >= 0.3 THEN 'expanded' ELSE 'novel' END AS provenance, count(*) AS clusters, round(avg(CAST(j1 > 0.4 AS DOUBLE)), 9) AS form_share FROM pv JOIN an ON an.cluster_id = pv.cluster_id GROUP BY 1")
def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cross.provenance_counts(cross.provenance(membership(spark, sf_dir), membership(spark, sf_dir, "l_suppkey")), cross.analysed(members(spark, sf_dir), "l", "r"))
    return out.withColumn("form_share", F.round("form_share", 9))


@query("SELECT CAST(least(floor(l_discount * 10 * 20), 19) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross.histogram(table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("score")))


@query("SELECT count(*) AS n, round(avg(l_tax), 9) AS mean, round(quantile_cont(l_tax, 0.5), 9) AS median, round(stddev_pop(l_tax), 9) AS std, min(l_tax) AS min, max(l_tax) AS max FROM lineitem")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cross.summary(table(spark, sf_dir, "lineitem").select(F.col("l_tax").alias("score")))
    return reduce(lambda d, c: d.withColumn(c, F.round(c, 9)), ("mean", "median", "std"), out)


@query("""WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) AS total FROM customer),
h AS (SELECT CAST(least(floor((c_acctbal - lo) / (hi - lo) * 50), 49) AS INT) AS bin, count(*) AS n FROM customer, e GROUP BY 1),
r AS (SELECT bin, lo, hi, total, sum(n) OVER w AS w0, sum(n * (lo + (bin + 0.5) * (hi - lo) / 50)) OVER w AS m0, sum(n * (lo + (bin + 0.5) * (hi - lo) / 50)) OVER () AS mt FROM h, e WINDOW w AS (ORDER BY bin)),
v AS (SELECT *, w0 / total * (total - w0) / total * pow(m0 / w0 - (mt - m0) / (total - w0), 2) AS variance FROM r WHERE total > w0)
SELECT round(lo + (bin + 1) * (hi - lo) / 50, 6) AS threshold, round(variance, 3) AS variance, CAST(w0 AS BIGINT) AS n_below, CAST(total - w0 AS BIGINT) AS n_above, CASE WHEN least(w0, total - w0) < 10 THEN 'weak' ELSE 'bimodal' END AS note FROM v ORDER BY round(variance, 6) DESC, bin LIMIT 1""")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cross.otsu(table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("score")))
    return out.withColumn("threshold", F.round("threshold", 6)).withColumn("variance", F.round("variance", 3))


FT = """sz AS (SELECT cluster_id, count(*) AS size FROM b GROUP BY 1), lo AS (SELECT DISTINCT l_orderkey AS cluster_id, l_partkey AS vid FROM lineitem WHERE l_quantity <= 20),
al AS (SELECT cluster_id, count(*) AS survivors FROM b WHERE vid IN (SELECT vid FROM lo) GROUP BY 1), k AS (SELECT cluster_id, count(*) FILTER (n >= 2) AS k2 FROM (SELECT b.cluster_id, lo.cluster_id AS o, count(*) AS n FROM b JOIN lo ON lo.vid = b.vid GROUP BY 1, 2) GROUP BY 1),
ft AS (SELECT sz.cluster_id, size, coalesce(survivors, 0) AS survivors, coalesce(k2, 0) AS k2, CASE WHEN coalesce(survivors, 0) < 2 THEN 'dissolved' WHEN coalesce(k2, 0) = 0 THEN 'scattered' WHEN k2 = 1 THEN 'preserved' ELSE 'fragmented' END AS fate FROM sz LEFT JOIN al ON al.cluster_id = sz.cluster_id LEFT JOIN k ON k.cluster_id = sz.cluster_id)"""


def _fewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity <= 20").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("vid")).distinct()


@query(f"WITH {M}, {FT} SELECT * FROM ft")
def cluster_fate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation.fates(membership(spark, sf_dir, "l_suppkey"), _fewer(spark, sf_dir))


@query(f"WITH {M}, {FT} SELECT fate, count(*) AS clusters, round(avg(size), 9) AS mean_size, round(avg(CAST(size <= 4 AS DOUBLE)), 9) AS share_small, CAST(sum(CASE WHEN fate = 'fragmented' THEN k2 - 1 ELSE 0 END) AS BIGINT) AS surplus FROM ft GROUP BY fate")
def fate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ablation.fate_counts(ablation.fates(membership(spark, sf_dir, "l_suppkey"), _fewer(spark, sf_dir)))
    return out.withColumn("mean_size", F.round("mean_size", 9)).withColumn("share_small", F.round("share_small", 9))


@query("""WITH b AS (SELECT DISTINCT l_suppkey AS cluster_id, l_partkey AS vid FROM lineitem WHERE l_quantity <= 20), o AS (SELECT DISTINCT l_orderkey AS cluster_id, l_partkey AS vid FROM lineitem),
k AS (SELECT cluster_id, bool_and(vid IN (SELECT vid FROM b)) AS a FROM o GROUP BY 1), h AS (SELECT cluster_id, max(n) AS most FROM (SELECT o.cluster_id, b.cluster_id AS c, count(*) AS n FROM o JOIN b ON b.vid = o.vid GROUP BY 1, 2) GROUP BY 1)
SELECT k.cluster_id, CASE WHEN NOT a THEN 'with_new' WHEN coalesce(most, 0) >= 2 THEN 'piece' ELSE 'regrouped' END AS origin FROM k LEFT JOIN h ON h.cluster_id = k.cluster_id""")
def cluster_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "lineitem").where("l_quantity <= 20").select(F.col("l_suppkey").alias("cluster_id"), F.col("l_partkey").alias("vid")).distinct()
    return ablation.origins(base, membership(spark, sf_dir))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_quantity <= 20), b AS (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_quantity > 10)
SELECT (SELECT count(*) FROM a WHERE v NOT IN (SELECT v FROM b)) AS dropped, (SELECT count(*) FROM b WHERE v NOT IN (SELECT v FROM a)) AS gained""")
def verses_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("vid"), "l_quantity")
    return ablation.moved(li.where("l_quantity <= 20"), li.where("l_quantity > 10"))


@query("""WITH c AS (SELECT 'full' AS config, count(DISTINCT l_orderkey) AS cl, count(DISTINCT l_partkey) AS v FROM lineitem UNION ALL SELECT 'low', count(DISTINCT l_orderkey), count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity <= 20 UNION ALL SELECT 'high', count(DISTINCT l_orderkey), count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity > 45),
f AS (SELECT * FROM c WHERE config = 'full'), t AS (SELECT count(*) AS n FROM part)
SELECT c.config, c.cl AS cl_clusters, c.v AS covered, round(c.v * 100.0 / n, 6) AS coverage_pct, f.cl - c.cl AS clusters_lost, round((f.v - c.v) * 100.0 / n, 6) AS coverage_lost_pct FROM c, f, t""")
def ablation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cut = {"full": "true", "low": "l_quantity <= 20", "high": "l_quantity > 45"}
    rows = [li.where(w).agg(F.countDistinct("l_orderkey").alias("cl_clusters"), F.countDistinct("l_partkey").alias("covered")).withColumn("config", F.lit(c)) for c, w in cut.items()]
    total = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("total"))
    out = ablation.deltas(reduce(DataFrame.unionByName, rows).crossJoin(total), "full")
    return out.withColumn("coverage_pct", F.round("coverage_pct", 6)).withColumn("coverage_lost_pct", F.round("coverage_lost_pct", 6))


# ---- comparing lists ------------------------------------------------------------------------------------------------------


def _two() -> str:
    return f"{T}, ja AS (WITH {_pairs(False)}, {_top(20)} SELECT * FROM top), tf AS (WITH {_COS}, {_top(20)} SELECT * FROM top)"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = line_legs(spark, sf_dir, ("jaccard", "cosine"), k=20)
    return found["jaccard"], found["cosine"]


OV = """c AS (SELECT DISTINCT ja.src FROM ja SEMI JOIN tf ON tf.src = ja.src), u AS (SELECT coalesce(j.src, t.src) AS src, j.src IS NOT NULL AND t.src IS NOT NULL AS hit FROM (SELECT * FROM ja SEMI JOIN c ON c.src = ja.src) j FULL JOIN (SELECT * FROM tf SEMI JOIN c ON c.src = tf.src) t ON j.src = t.src AND j.dst = t.dst),
o AS (SELECT src, sum(CAST(hit AS INT)) / count(*) AS jaccard FROM u GROUP BY src)"""


@query(f"WITH {_two()}, {OV} SELECT count(*) AS n, round(avg(jaccard), 9) AS mean, round(quantile_cont(jaccard, 0.5), 9) AS median, round(quantile_cont(jaccard, 0.1), 9) AS p10, round(quantile_cont(jaccard, 0.25), 9) AS p25, round(quantile_cont(jaccard, 0.75), 9) AS p75, round(quantile_cont(jaccard, 0.9), 9) AS p90 FROM o")
def list_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.overlap_figures(compare.overlaps(*_both(spark, sf_dir)))
    return out.select("n", *[F.round(c, 9).alias(c) for c in out.columns if c != "n"])


@query(f"WITH {_two()}, {OV} SELECT CAST(floor(jaccard * 10) AS INT) AS bin, count(*) AS n FROM o WHERE jaccard < 1 GROUP BY 1")
def overlap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.overlap_histogram(compare.overlaps(*_both(spark, sf_dir)))


@query(f"WITH {_two()} SELECT tf.src, tf.dst, round(tf.score, 6) AS score FROM tf WHERE mtype = 'x' AND src IN (SELECT src FROM ja) AND NOT EXISTS (SELECT 1 FROM ja WHERE ja.src = tf.src AND ja.dst = tf.dst)")
def novel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _both(spark, sf_dir)
    return compare.only_in(b, a).select("src", "dst", F.round("score", 6).alias("score"))


@query(f"WITH {_two()}, r AS (SELECT src, dst, score, rank() OVER (PARTITION BY src ORDER BY round(score, 9) DESC) AS rank FROM tf) SELECT ja.src, ja.dst, round(r.score, 6) AS score, CAST(r.rank AS INT) AS rank FROM ja LEFT JOIN r ON r.src = ja.src AND r.dst = ja.dst")
def rank_in_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _both(spark, sf_dir)
    return compare.rank_in(a, b).select("src", "dst", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"WITH {_two()} SELECT count(*) AS directed, count(DISTINCT least(src, dst) || '|' || greatest(src, dst)) AS undirected FROM ja")
def undirected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.undirected(_both(spark, sf_dir)[0])


@query(f"WITH {_two()} SELECT CASE WHEN s >= 0.9 THEN '>=0.9' WHEN s >= 0.8 THEN '>=0.8' WHEN s >= 0.7 THEN '>=0.7' WHEN s >= 0.6 THEN '>=0.6' WHEN s >= 0.5 THEN '>=0.5' WHEN s >= 0.3 THEN '>=0.3' END AS bucket, count(*) AS pairs, count(*) FILTER (mtype = 'x') AS cross_pairs, round(avg(s), 6) AS mean FROM (SELECT *, round(score, 9) AS s FROM ja) GROUP BY 1")
def score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = line_legs(spark, sf_dir, ("jaccard",), k=20)["jaccard"]
    return compare.score_buckets(top.withColumn("score", F.round("score", 9))).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_E} SELECT count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.99), 6) AS p99, round(min(score), 6) AS min, round(max(score), 6) AS max FROM te")
def score_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.score_figures(dense.exact_neighbours(stored(_vectors(spark, sf_dir), "centred")))
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


# ---- evaluation ---------------------------------------------------------------------------------------------------------------

G = """g AS (SELECT a.vec_id AS id1, b.vec_id AS id2, a.label = b.label AS positive FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND b.vec_id - a.vec_id <= 25),
cl AS (SELECT vec_id AS item, vec_id % 7 AS cluster_id FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id, 100 + label FROM embeddings WHERE vec_id % 3 = 0), kn AS (SELECT vec_id AS item FROM embeddings WHERE vec_id % 11 <> 0),
pd AS (SELECT g.*, EXISTS (SELECT 1 FROM cl a JOIN cl b ON a.cluster_id = b.cluster_id WHERE a.item = id1 AND b.item = id2) AS predicted FROM g)"""


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = e.select(F.col("vec_id").alias("id1"), F.col("label").alias("l1"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 25)).alias("id2"))
    pairs = near.join(e.toDF("id2", "l2"), "id2").select("id1", "id2", (F.col("l1") == F.col("l2")).alias("positive"))
    cl = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("item"), (F.col("vec_id") % 7).alias("cluster_id")).union(e.where("vec_id % 3 = 0").select("vec_id", (F.lit(100) + F.col("label")).cast("long")))
    return pairs, cl, e.where("vec_id % 11 <> 0").select(F.col("vec_id").alias("item"))


def _prf(t: str) -> str:
    return f"SELECT tp, fp, fn, tn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (SELECT count(*) FILTER (positive AND predicted) AS tp, count(*) FILTER (NOT positive AND predicted) AS fp, count(*) FILTER (positive AND NOT predicted) AS fn, count(*) FILTER (NOT positive AND NOT predicted) AS tn FROM {t}))"


def _rounded(out: DataFrame) -> DataFrame:
    return reduce(lambda d, c: d.withColumn(c, F.round(c, 9)), ("precision", "recall", "f1"), out)


@query(f"WITH {G} {_prf('pd')}")
def prf_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, cl, _ = _gold(spark, sf_dir)
    return _rounded(evaluate.confusion(evaluate.co_members(pairs, cl)))


@query(f"WITH {G}, f AS (SELECT item, min(cluster_id) AS c FROM cl GROUP BY 1), sp AS (SELECT g.*, coalesce(a.c = b.c, false) AS predicted FROM g LEFT JOIN f a ON a.item = id1 LEFT JOIN f b ON b.item = id2) {_prf('sp')}")
def prf_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, cl, _ = _gold(spark, sf_dir)
    return _rounded(evaluate.confusion(evaluate.single_mode(pairs, cl)))


@query(f"WITH {G}, bk AS (SELECT id1, id2, CASE WHEN id1 NOT IN (SELECT item FROM kn) OR id2 NOT IN (SELECT item FROM kn) THEN 'A' WHEN id1 NOT IN (SELECT item FROM cl) OR id2 NOT IN (SELECT item FROM cl) THEN 'B' ELSE 'C' END AS bucket FROM pd WHERE positive AND NOT predicted) SELECT id1, id2, bucket FROM bk")
def fn_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, cl, known = _gold(spark, sf_dir)
    return evaluate.miss_buckets(evaluate.co_members(pairs, cl), known, cl)


@query(f"WITH {G}, l AS (SELECT vec_id AS item, CASE label % 3 WHEN 0 THEN 'et' WHEN 1 THEN 'fi' ELSE 'other' END AS lang FROM embeddings WHERE vec_id % 4 <> 0), j AS (SELECT coalesce(a.lang, '?') AS x, coalesce(b.lang, '?') AS y FROM g LEFT JOIN l a ON a.item = id1 LEFT JOIN l b ON b.item = id2 WHERE positive) SELECT least(x, y) || '-' || greatest(x, y) AS languages, count(*) AS pairs FROM j GROUP BY 1")
def gold_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _, _ = _gold(spark, sf_dir)
    lang = F.when(F.col("label") % 3 == 0, "et").when(F.col("label") % 3 == 1, "fi").otherwise("other")
    return evaluate.language_pairs(pairs, table(spark, sf_dir, "embeddings").where("vec_id % 4 <> 0").select("vec_id", lang))


@query(f"WITH {G}, f AS (SELECT item, min(cluster_id) AS c FROM cl GROUP BY 1), mc AS (SELECT positive, predicted AS pb, coalesce(a.c = b.c, false) AS pa FROM pd LEFT JOIN f a ON a.item = id1 LEFT JOIN f b ON b.item = id2), d AS (SELECT count(*) FILTER (positive = pa AND positive <> pb) AS b, count(*) FILTER (positive <> pa AND positive = pb) AS c FROM mc) SELECT b, c, round(CASE WHEN b + c > 0 THEN pow(greatest(abs(b - c) - 1, 0), 2) / (b + c) ELSE 0 END, 9) AS chi2 FROM d")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mcnemar(_models(spark, sf_dir)).withColumn("chi2", F.round("chi2", 9))


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, cl, _ = _gold(spark, sf_dir)
    one = evaluate.single_mode(pairs, cl).withColumnRenamed("predicted", "predicted_a")
    return evaluate.co_members(one, cl).withColumnRenamed("predicted", "predicted_b")


@query("WITH v AS (SELECT doc_id, min(CAST(quality = 1 AS INT)) AS a, count(*) AS n FROM labels GROUP BY 1), w AS (SELECT doc_id, sum(CAST(x AS INT)) AS votes FROM (SELECT doc_id, quality = 1 AS x FROM labels UNION ALL SELECT doc_id, toxic = 0 FROM labels UNION ALL SELECT doc_id, doc_id % 2 = 0 FROM labels) GROUP BY 1) SELECT doc_id AS id1, doc_id AS id2, CAST(votes AS BIGINT) AS votes, votes >= 2 AS positive FROM w")
def gold_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linekin.sources.poems import majority

    la = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id1"), F.col("doc_id").alias("id2"), "quality", "toxic")
    votes = [la.select("id1", "id2", c.alias("positive")) for c in (F.col("quality") == 1, F.col("toxic") == 0, F.col("id1") % 2 == 0)]
    return majority(reduce(DataFrame.unionAll, votes))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, cl, _ = _gold(spark, sf_dir)
    return evaluate.bootstrap(evaluate.co_members(pairs, cl))


@query()
def bootstrap_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.paired_bootstrap(_models(spark, sf_dir))


@query(rf"""WITH {V}, q AS (SELECT vid, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM verses),
bl AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(x), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark)) SELECT q.norm AS text, vid FROM bl JOIN q ON q.norm = bl.norm""")
def benchmark_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).select(X.gold_text(F.col("line")).alias("norm"))
    return evaluate.text_matches(gold, lines(spark, sf_dir).select("vid", X.gold_text(F.col("text")).alias("norm")))


# ---- themes: event types of users, as types of poems ---------------------------------------------------------------------------

H = """tp AS (SELECT c_custkey AS poem_id, c_mktsegment AS type, CASE WHEN c_nationkey % 2 = 0 THEN 'et' ELSE 'fi' END AS side, c_acctbal FROM customer),
th AS (SELECT DISTINCT c_mktsegment AS type, upper(substr(c_mktsegment, 1, 1)) AS theme FROM customer),
ic AS (SELECT DISTINCT o.o_orderpriority || CAST(o_orderkey % 97 AS VARCHAR) AS cluster_id, o_custkey AS poem_id, side, tp.type, theme FROM orders o JOIN tp ON tp.poem_id = o_custkey JOIN th ON th.type = tp.type),
ob AS (SELECT theme, count(*) AS obs FROM ic GROUP BY theme), tot AS (SELECT side, count(*) AS n FROM ic GROUP BY side),
sh AS (SELECT side, theme, count(*) AS w FROM tp JOIN th ON th.type = tp.type GROUP BY 1, 2), sr AS (SELECT side, theme, w / sum(w) OVER (PARTITION BY side) AS share FROM sh),
ex AS (SELECT theme, sum(share * n) AS exp FROM sr JOIN tot ON tot.side = sr.side GROUP BY theme)"""


def _themes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    tp = c.select(F.col("c_custkey").alias("poem_id"), F.col("c_mktsegment").alias("type"), F.when(F.col("c_nationkey") % 2 == 0, "et").otherwise("fi").alias("side"))
    th = c.select(F.col("c_mktsegment").alias("type"), F.upper(F.substring("c_mktsegment", 1, 1)).alias("theme")).distinct()
    o = table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", (F.col("o_orderkey") % 97).cast("string")).alias("cluster_id"), F.col("o_custkey").alias("poem_id"))
    inc = themes.incidences(o.join(tp.select("poem_id", "side"), "poem_id"), tp, th)
    return inc, tp.join(th, "type")


def _expected(spark: SparkSession, sf_dir: str, **options: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    inc, corpus = _themes(spark, sf_dir)
    totals = inc.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    return inc, themes.observed(inc), themes.expected(corpus, totals, **options)  # type: ignore[arg-type]


@query(f"WITH {H}, t AS (SELECT ex.theme, coalesce(obs, 0) AS obs, exp, (SELECT sum(obs) FROM ob) AS n FROM ex LEFT JOIN ob ON ob.theme = ex.theme) SELECT theme, obs, round(exp, 6) AS exp, round(obs / n, 9) AS obs_rate, round(exp / n, 9) AS exp_rate, round(obs / exp, 9) AS ratio FROM t")
def theme_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, obs, exp = _expected(spark, sf_dir)
    out = themes.enrichment(obs, exp)
    return out.select("theme", "obs", F.round("exp", 6).alias("exp"), *[F.round(c, 9).alias(c) for c in ("obs_rate", "exp_rate", "ratio")])


@query(f"WITH {H} SELECT round(sum(pow(obs - exp, 2) / exp), 6) AS chi2, count(*) - 1 AS df, count(*) AS kept FROM ex JOIN ob ON ob.theme = ex.theme WHERE obs >= 5 AND exp >= 5")
def theme_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, obs, exp = _expected(spark, sf_dir)
    return themes.chi_square(themes.enrichment(obs, exp)).withColumn("chi2", F.round("chi2", 6))


@query(f"WITH {H}, pl AS (SELECT theme, count(*) AS w FROM tp JOIN th ON th.type = tp.type GROUP BY 1), pe AS (SELECT theme, w / sum(w) OVER () * (SELECT sum(n) FROM tot) AS exp FROM pl) SELECT round(sum(pow(obs - exp, 2) / exp), 6) AS chi2, count(*) - 1 AS df, count(*) AS kept FROM pe JOIN ob ON ob.theme = pe.theme WHERE obs >= 5 AND exp >= 5")
def theme_chi2_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, obs, exp = _expected(spark, sf_dir, by_side=False)
    return themes.chi_square(themes.enrichment(obs, exp)).withColumn("chi2", F.round("chi2", 6))


@query(f"WITH {H}, g AS (SELECT cluster_id, list_distinct(list(theme) FILTER (side = 'et')) AS l, list_distinct(list(theme) FILTER (side = 'fi')) AS r FROM ic GROUP BY 1), s AS (SELECT list_intersect(l, r) AS b FROM g WHERE len(l) > 0 AND len(r) > 0) SELECT count(*) AS n, round(avg(CAST(len(b) > 0 AS DOUBLE)), 9) AS any_rate, round(avg(CAST(len(list_filter(b, lambda x: x <> 'M')) > 0 AS DOUBLE)), 9) AS substantive_rate, round(avg(CAST(len(b) > 0 AND len(list_filter(b, lambda x: x <> 'M')) = 0 AS DOUBLE)), 9) AS only_catch_all_rate FROM s")
def theme_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = themes.sharing_rates(themes.sharing(_themes(spark, sf_dir)[0], "et", "fi", ["M"]))
    return out.select("n", *[F.round(c, 9).alias(c) for c in out.columns if c != "n"])


@query(f"""WITH {H}, p AS (SELECT cluster_id AS id, min(theme) FILTER (side = 'et') AS l, min(theme) FILTER (side = 'fi') AS r FROM ic GROUP BY 1 HAVING l IS NOT NULL AND r IS NOT NULL), x AS (SELECT p.*, rep FROM p, range(200) AS t(rep)),
a AS (SELECT rep, l, row_number() OVER (PARTITION BY rep ORDER BY id) AS k FROM x), c AS (SELECT rep, r, row_number() OVER (PARTITION BY rep ORDER BY md5(id || ':' || CAST(rep AS VARCHAR) || ':42'), id) AS k FROM x) SELECT a.rep, round(avg(CAST(l = r AS DOUBLE)), 9) AS rate FROM a JOIN c ON c.rep = a.rep AND c.k = a.k GROUP BY a.rep""")
def theme_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc, _ = _themes(spark, sf_dir)
    side = lambda s: F.min(F.when(F.col("side") == s, F.col("theme")))
    pairs = inc.groupBy(F.col("cluster_id").alias("id")).agg(side("et").alias("left"), side("fi").alias("right")).where("left is not null and right is not null")
    return themes.shuffled(pairs).withColumn("rate", F.round("rate", 9))


@query(f"WITH {H} SELECT side, type, count(*) AS n, bool_or(theme = 'B') AS in_theme FROM ic WHERE regexp_matches(lower(type), 'ma|bu') OR theme = 'B' GROUP BY 1, 2")
def theme_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.keyword_audit(_themes(spark, sf_dir)[0], "ma|bu", "B")


# ---- samples, lemmas, scalar functions ------------------------------------------------------------------------------------------

_H5 = "md5(CAST(cluster_id AS VARCHAR) || ':42')"


@query(f"WITH {M}, {FM}, r AS (SELECT cluster_id, CASE WHEN j1 > 0.6 THEN 'high' WHEN j1 > 0.4 THEN 'mid' ELSE 'low' END AS stratum FROM an), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_H5}, cluster_id) AS p FROM r) SELECT cluster_id, stratum FROM k WHERE p <= CASE stratum WHEN 'high' THEN 34 ELSE 33 END")
def sample_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = cross.analysed(members(spark, sf_dir), "l", "r")
    j = F.col("char_unigram_jaccard")
    return sample.stratified(a, "cluster_id", F.when(j > 0.6, "high").when(j > 0.4, "mid").otherwise("low"), {"high": 34, "mid": 33, "low": 33}).select("cluster_id", "stratum")


@query(f"WITH {M}, o AS (SELECT *, row_number() OVER (ORDER BY size, cluster_id) AS p, count(*) OVER () AS n FROM s), h AS (SELECT cluster_id, size, CASE WHEN p * 2 <= n THEN 'small' ELSE 'large' END AS half FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY half ORDER BY {_H5}, cluster_id) AS q FROM h) SELECT cluster_id, size, half FROM k WHERE q <= 50")
def sample_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.by_size_halves(stats.sizes(membership(spark, sf_dir))).select("cluster_id", "size", "half")


@query(f"WITH {M}, q AS (SELECT cluster_id FROM s ORDER BY {_H5}, cluster_id LIMIT 100), r AS (SELECT pm.* FROM pm SEMI JOIN q ON q.cluster_id = pm.cluster_id) SELECT cluster_id, lang, list_slice(list(vid ORDER BY vid), 1, 5) AS vids FROM r GROUP BY 1, 2")
def sample_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir)
    return sample.examples(m, sample.uniform(stats.sizes(membership(spark, sf_dir)), "cluster_id", 100))


@query("SELECT a.p_partkey AS id1, b.p_partkey AS id2, round(1 - levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(length(a.p_name), length(b.p_name)), 9) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def lev_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("id2"), F.col("p_name").alias("other"))
    return p.join(b, "p_partkey").select(F.col("p_partkey").alias("id1"), "id2", F.round(X.levenshtein_similarity(F.col("p_name"), F.col("other")), 9).alias("similarity"))


@query("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r <= 8")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return sample.first_of_each(by, "event_type", "user_id")




# ---- look-ups -----------------------------------------------------------------------------------------------------------------

_META = """vm AS (SELECT p_partkey AS vid, 'v' || CAST(p_size % 5 AS VARCHAR) AS lang, p_type AS place FROM part WHERE p_partkey % 3 <> 0), qm AS (SELECT p_brand AS poem_id, p_partkey AS vid, 'p' || CAST(p_size % 5 AS VARCHAR) AS lang, p_name AS place FROM part WHERE p_partkey % 7 = 1)"""


@query(f"WITH {M}, {_META}, f AS (SELECT poem_id, arg_min(lang, vid) AS lang, arg_min(place, vid) AS place FROM qm GROUP BY 1) SELECT cluster_id, pm.vid, coalesce(vm.lang, f.lang, 'unknown') AS lang, coalesce(vm.place, f.place, '') AS place FROM pm LEFT JOIN vm ON vm.vid = pm.vid LEFT JOIN f ON f.poem_id = pm.poem_id")
def metadata_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    own = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("vid"), F.concat(F.lit("v"), (F.col("p_size") % 5).cast("string")).alias("lang"), F.col("p_type").alias("place"))
    poem = p.where("p_partkey % 7 = 1").select(F.col("p_brand").alias("poem_id"), F.col("p_partkey").alias("vid"), F.concat(F.lit("p"), (F.col("p_size") % 5).cast("string")).alias("lang"), F.col("p_name").alias("place"))
    return lookup.with_fallback(members(spark, sf_dir).select("cluster_id", "vid", "poem_id"), own, poem).select("cluster_id", "vid", "lang", "place")


@query(f"WITH {M}, g AS (SELECT poem_id, bool_or(lang = 'l') AS l, bool_or(lang = 'r') AS r FROM pm GROUP BY 1) SELECT CASE WHEN l AND r THEN 'mixed' WHEN l THEN 'l' WHEN r THEN 'r' ELSE 'unknown' END AS languages, count(*) AS poems FROM g GROUP BY 1")
def poem_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.poem_languages(members(spark, sf_dir), "l", "r")


@query("""WITH a AS (SELECT s_suppkey AS id, s_nationkey AS size, s_name AS name FROM supplier WHERE s_suppkey % 5 <> 0), b AS (SELECT s_suppkey AS id, s_nationkey + CAST(s_suppkey % 4 = 0 AS INT) AS size, 'new' AS name FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.size, b.size) AS size, coalesce(b.name, a.name) AS name, CASE WHEN b.id IS NULL THEN 'no correction' WHEN a.id IS NULL THEN 'no row' WHEN a.size <> b.size THEN 'size differs' END AS problem FROM a FULL JOIN b ON a.id = b.id""")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    a = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("size"), F.col("s_name").alias("name"))
    b = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") + (F.col("s_suppkey") % 4 == 0).cast("int")).alias("size"), F.lit("new").alias("name"))
    return lookup.corrected(a, b, "id", "size", ["name"])


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer)) AS missing, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS extra")
def id_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return lookup.same_ids(o, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@query(f"WITH {_E}, o AS (SELECT vec_id, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id) - 1 AS i FROM embeddings QUALIFY i < 400), h AS (SELECT count(*) // 2 AS h FROM o) SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(u.u, v.u), 6) AS score FROM o x JOIN h ON x.i < h.h JOIN o y ON y.i = x.i + h.h JOIN un u ON u.vec_id = x.vec_id JOIN un v ON v.vec_id = y.vec_id")
def random_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stored(_vectors(spark, sf_dir), "centred")
    pairs = lookup.random_pairs(v, "vid", 200)
    out = pairs.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b")
    return out.select("a", "b", F.round(dense.dot(F.col("va"), F.col("vb")), 6).alias("score"))


@query(f"WITH {V} SELECT poem_id, count(*) AS verses FROM verses GROUP BY poem_id")
def verses_per_poem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.verse_counts(lines(spark, sf_dir))


from linekin.plans import exchange  # noqa: E402, F401  registers its queries here
