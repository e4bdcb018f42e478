"""The registered queries of the training-data operators and, where SQL can say it, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linekin.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from linekin.llm.mixing import mix, ordered

    found = ordered(mix(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "size", "source_size", "target", "taken", "passes", F.transform("positions", lambda t: F.round(t, 9)).alias("positions"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         coalesce(substr(md5(CAST(doc_id AS VARCHAR)), 1, 16), '') AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS BIGINT) AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS i, 2 * source_size AS cap FROM s),
r AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio,
        CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below,
        CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS wleft,
        CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
o AS (SELECT *, 3 * total - 2 * below AS need FROM r),
l AS (SELECT need AS n, wleft AS lw, ratio AS lr, i AS li FROM o WHERE need * w < 2 * cap * wleft ORDER BY ratio, i LIMIT 1),
t AS (SELECT o.source, source_size, o.i - 1 AS i,
        CASE WHEN l.n IS NOT NULL AND (o.ratio > l.lr OR (o.ratio = l.lr AND o.i >= l.li))
             THEN least(CAST(o.w * l.n AS DOUBLE) / CAST(2 * l.lw AS DOUBLE), CAST(cap AS DOUBLE)) ELSE CAST(cap AS DOUBLE) END AS target
      FROM o LEFT JOIN l ON true),
a AS (SELECT d.*, t.source_size, t.target, t.i, CAST(round(t.target) AS BIGINT) AS goal,
        CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS full_passes FROM a),
c AS (SELECT *, goal - full_passes * source_size AS rest, size > 0 AND cum + size <= goal - full_passes * source_size AS whole FROM b),
g AS (SELECT *, min(rest - CASE WHEN whole THEN cum + size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM c),
f AS (SELECT *, NOT whole AND size > 0 AND size < 2 * gap AS fits FROM g),
e AS (SELECT *, row_number() OVER (PARTITION BY source, size, fits ORDER BY h) - 1 AS rank,
        coalesce(sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source ORDER BY size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
        - coalesce(sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source, size), 0) AS before FROM f),
p AS (SELECT *, CASE WHEN size > 0 THEN full_passes + CAST(whole OR (fits AND rank < floor(CAST(gap - before AS DOUBLE) / size + 0.5)) AS BIGINT) ELSE 0 END AS passes FROM e),
m AS (SELECT *, [-0.5, 0.5, 0.0][CAST(i % 3 + 1 AS BIGINT)]::DOUBLE AS slope,
        list_transform(range(1, passes + 1), lambda k: least(CAST(CASE WHEN k <= full_passes OR whole THEN (k - 1) * source_size + cum + size / 2.0::DOUBLE
          ELSE full_passes * source_size + rest - gap + before + rank * size + size / 2.0::DOUBLE END AS DOUBLE) / greatest(target, 1.0::DOUBLE), 1.0::DOUBLE)) AS met FROM p)
SELECT doc_id, size, source_size, target, CAST(passes * size AS BIGINT) AS taken, CAST(passes AS BIGINT) AS passes,
  list_transform(met, lambda x: round(CASE WHEN slope = 0 THEN x ELSE (sqrt(((1 - slope) / 2) * ((1 - slope) / 2) + slope * x) - (1 - slope) / 2) / slope END, 9)) AS positions FROM m
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linekin.llm.quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linekin.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linekin.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linekin.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


#: The vocabulary files are installed on every machine; the path is a parameter of the operators.
def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from linekin.llm.lines import without_repeats

    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", "n_near", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linekin.llm.sstable import read_back, written

    return read_back(written(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linekin.llm.pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from linekin.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linekin.llm.near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


OP9_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT p.a, r.c FROM r JOIN p ON p.b = r.a),
k AS (SELECT a, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, k.component_id, e.vec_id = k.component_id AS kept
FROM embeddings e JOIN k ON k.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


#: Components by recursion over links (a, b): the smallest id that is reachable.
_REACH = "r AS (SELECT k AS a, k AS c FROM nodes UNION SELECT p.a, r.c FROM r JOIN p ON p.b = r.a), top AS (SELECT a, min(c) AS c FROM r GROUP BY a)"

OP1_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS l FROM d),
n AS (SELECT doc_id, len(l) AS n FROM s), f AS (SELECT doc_id, unnest(l) AS x FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n u ON u.doc_id = a.doc_id JOIN n v ON v.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, u.n, v.n HAVING 100 * count(*) >= 75 * (u.n + v.n - count(*))),
nodes AS (SELECT doc_id AS k FROM documents), {_REACH}
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, top.c AS component_id, n.doc_id = top.c AS kept FROM n JOIN top ON top.a = n.doc_id
"""

#: Lines within two edits have counts of any characters that differ by four in all at most; levenshtein decides.
_FEW_LETTERS = " etaoinsr"
_LETTERS = ", ".join(f"length(line) - length(replace(line, '{c}', '')) AS q{i}" for i, c in enumerate(_FEW_LETTERS))
_APART = " + ".join(f"abs(a.q{i} - b.q{i})" for i in range(len(_FEW_LETTERS)))

OP5_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents),
o AS (SELECT doc_id, i AS pos, x[i + 1] AS line, doc_id::HUGEINT * 4294967296 + i AS loc FROM t, unnest(range(len(x))) AS q(i) WHERE length(x[i + 1]) >= 20),
u AS MATERIALIZED (SELECT line, length(line) AS n, min(loc) AS k, {_LETTERS} FROM o GROUP BY line),
p AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.k <> b.k AND {_APART} <= 4 AND levenshtein(a.line, b.line) <= 2),
nodes AS (SELECT k FROM u), {_REACH},
deg AS (SELECT DISTINCT a FROM p),
v AS (SELECT o.doc_id, o.pos, o.loc <> top.c AS gone, deg.a IS NOT NULL AS near FROM o JOIN u ON u.line = o.line JOIN top ON top.a = u.k LEFT JOIN deg ON deg.a = u.k),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (near) AS n_near, list(pos) FILTER (gone) AS gone FROM v GROUP BY doc_id),
w AS (SELECT t.doc_id, n_lines, n_removed, n_near, CASE WHEN n_removed > 0 THEN coalesce(array_to_string(list_transform(list_filter(range(len(x)), lambda i: NOT list_contains(s.gone, i)), lambda i: x[i + 1]), chr(10)), '') ELSE text END AS text FROM t LEFT JOIN s ON s.doc_id = t.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_near, 0) AS n_near, length(text) AS n_chars, md5(text) AS text_md5 FROM w
"""


QUERIES: dict[str, Query] = {"op4_mix_sources": op4_mix_sources, "op10_quality": op10_quality, "op2_pii": op2_pii, "op8_html_text": op8_html_text, "op1_near_duplicates": op1_near_duplicates, "op3_nearest_vectors": op3_nearest_vectors, "op9_near_vectors": op9_near_vectors, "op7_sentencepiece": op7_sentencepiece, "op6_token_shards": op6_token_shards, "op5_line_dedup": op5_line_dedup}
SQL: dict[str, str] = {"op4_mix_sources": OP4_SQL, "op9_near_vectors": OP9_SQL, "op1_near_duplicates": OP1_SQL, "op5_line_dedup": OP5_SQL}

