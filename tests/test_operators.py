"""Operators against brute-force versions, properties and hand-made frames."""

from __future__ import annotations

import hashlib
import itertools
import math
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linekin.functions.text import ET_OVERRIDES
from linekin.operators import ablation, cluster, cross, dense, encode, evaluate, fuse, lemma, order, sample, stats, themes
from linekin.operators import similarity as S
from linekin.operators.graph import components
from linekin.operators.lookup import lowered_min_df
from linekin.sources import poems, sinks


def random_fused(r, n=60, links=90):
    out = {}
    for _ in range(links):
        a, b = r.sample(range(n), 2)
        out.setdefault(f"v{a:03d}", []).append(f"v{b:03d}")
    return {k: sorted(set(v)) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(20))
def test_greedy_runs_component_by_component(seed):
    r = random.Random(seed)
    near = random_fused(r)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, bs in near.items():
        for b in bs:
            parent[find(a)] = find(b)
    whole = {(s, tuple(m)) for s, m in cluster.greedy_clusters(near.items(), 0.3)}
    parts = set()
    for top in {find(a) for a in near}:
        parts |= {(s, tuple(m)) for s, m in cluster.greedy_clusters([(a, b) for a, b in near.items() if find(a) == top], 0.3)}
    assert whole == parts


def test_greedy_steps():
    assert cluster.greedy_clusters([("a", ["b", "c"]), ("b", ["a", "c"]), ("x", ["y"])], 0.3) == [("a", ["a", "b", "c"]), ("x", ["x", "y"])]
    assert cluster.greedy_clusters([("a", ["b", "c"]), ("d", ["b", "e", "f", "g"])], 0.3) == [("d", ["b", "d", "e", "f", "g"]), ("a", ["a", "b", "c"])]


def test_clusters_of_a_graph(spark):
    near = random_fused(random.Random(5))
    rows = [(a, b) for a, bs in near.items() for b in bs]
    got = cluster.clusters(spark.createDataFrame(rows, "src string, dst string")).collect()
    want = [(s, m) for s, m in cluster.greedy_clusters(near.items(), 0.3) if len(m) >= 2]
    want.sort(key=lambda x: (-len(x[1]), -len(near[x[0]]), x[0]))
    assert {(x.cluster_id, x.vid) for x in got} == {(i, v) for i, (_, m) in enumerate(want) for v in m}


def test_merging(spark):
    items = [(0, {"a", "b", "c"}), (1, {"c", "d"}), (2, {"d", "e"}), (3, {"x", "y"})]
    assert cluster.merge_sets(items, 0.1) == {0: 0, 1: 0, 2: 0, 3: 3}
    df = spark.createDataFrame([(i, v) for i, m in items for v in m], "cluster_id long, vid string")
    assert {x.cluster_id for x in cluster.merged(df).collect()} == {0, 3}


def test_merging_is_among_all_clusters(spark):
    def plain(items, least):
        into, live = {i: i for i, _ in items}, [(i, set(m)) for i, m in items]
        for k, (i, own) in enumerate(live):
            for j, other in live[k + 1 :] if into[i] == i else []:
                if into[j] == j and len(own & other) / min(len(own), len(other)) >= least:
                    own |= other
                    into[j] = i
        return into

    r = random.Random(3)
    for least in (0.1, 0.3, 0.5, 1.0):
        for n in (5, 40, 120):
            items = [(3 * i, {f"v{x}" for x in r.sample(range(n), r.randint(1, 5))}) for i in range(n)]
            assert cluster.merge_sets(items, least) == plain(items, least)
    pairs = spark.range(5004).select(F.col("id").alias("cluster_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    vid = F.concat(F.lit("v"), (F.when(F.col("cluster_id") == 5003, 5001).when(F.col("cluster_id") == 5001, 4).otherwise(F.col("cluster_id")) + F.col("i") * 10_000).cast("string"))
    got = cluster.merged(pairs.select("cluster_id", vid.alias("vid")))
    assert {x.cluster_id for x in got.select("cluster_id").distinct().collect()} == set(range(5004)) - {5001}


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    names = list(range(400))
    rows = [(names[i], names[i + 1]) for i in range(250)] + [(399, k) for k in range(300, 399)] + [(270, 270)]
    r.shuffle(rows)
    got = {x.node: x.component for x in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(251)} | {k: 300 for k in range(300, 400)}


@pytest.mark.parametrize("case", [((0, 0), True), ((0, 1), True), ((0, 2), False), ((1, 1), False), ((29, 29, 29), True), ((0,), False)])
def test_fusion_threshold(spark, case):
    ranks, passes = case
    lists = {f"l{i}": spark.createDataFrame([("a", r, "b")], "src string, rank int, dst string") for i, r in enumerate(ranks)}
    assert (fuse.fused(fuse.union_lists(lists)).count() == 1) == passes
    with pytest.raises(ValueError, match="no such list"):
        fuse.union_lists(lists, ["nothing"])


def verses_of(spark, texts):
    return spark.createDataFrame([(f"p{i}:0", f"p{i // 2}", i, t, "et" if i % 2 else "fi") for i, t in enumerate(texts)], "vid string, poem_id string, idx int, text string, lang string")


def test_text_dedup_keeps_the_best_of_equal_texts(spark):
    v = verses_of(spark, ["aa bb", "aa bb", "aa bb cc", "AA bb cc", "aa dd"])
    toks = S.tokens(v)
    pairs, members = S.set_pairs(S.weighted(toks, S.vocabulary(toks, min_df=1, max_share=1.0)), floors={"jaccard": 0.1}, min_shared=1)
    members = S.described(v, members)
    top = S.top_neighbours(pairs, members)
    own = [(x.dst, x["rank"]) for x in top.where("src = 'p0:0'").orderBy("rank").collect()]
    assert own == [("p1:0", 0), ("p2:0", 1), ("p4:0", 2)]
    near = S.top_neighbours(pairs, members, exclude_same_poem=True)
    assert near.where("mtype = 'w'").count() == 0
    assert top.where("src = dst").count() == 0


@pytest.mark.parametrize(("block", "adaptive", "most"), [(4096, False, None), (7, False, None), (7, True, None), (9, False, 3)])
def test_set_pairs_match_brute_force(spark, monkeypatch, block, adaptive, most):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "ROWS", 4)
    r = random.Random(2)
    texts = [" ".join(r.choice("aa bb cc dd ee ff gg hh".split()) for _ in range(r.randint(1, 6))) for _ in range(60)]
    v = verses_of(spark, texts)
    toks = S.tokens(v, least=1)
    w = S.weighted(toks, S.vocabulary(toks, min_df=2, max_share=1.0))
    sets = {}
    for x in w.collect():
        sets.setdefault(x.vid, {})[x.token] = x.idf
    want = {}
    for a, b in itertools.permutations(sets, 2):
        x, y = sets[a], sets[b]
        both = x.keys() & y.keys()
        enough = len(both) >= (min(2, len(x)) if adaptive else 2)
        total = sum(x.values()) + sum(y.values()) - sum(x[t] for t in both)
        cosine = sum(x[t] ** 2 for t in both) / math.sqrt(sum(i * i for i in x.values()) * sum(i * i for i in y.values()))
        for m, score, good in (("jaccard", len(both) / len(x.keys() | y.keys()), enough), ("jaccard_idf", sum(x[t] for t in both) / total, enough), ("cosine", cosine, bool(both))):
            if good and score >= S.FLOORS[m]:
                want[m, a, b] = score
    pairs, members = S.set_pairs(w, tuple(S.FLOORS), adaptive=adaptive, most=most)
    of = {}
    for x in members.collect():
        of.setdefault(x.rep, []).append(x.vid)
    got = {(x.measure, a, b): x.score for x in pairs.collect() for a in of[x.src] for b in of[x.dst] if a != b}
    if most is None:
        assert got.keys() == want.keys()
    assert got.keys() <= want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    for m, a in {(m, a) for m, a, _ in want}:
        # The best of each verse are there whatever a task leaves out.
        best = sorted(((-round(s, 9), b) for (n, c, b), s in want.items() if (n, c) == (m, a)))[: (most or 3) - 1]
        assert all((m, a, b) in got for _, b in best)


def test_exact_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 16)
    r = random.Random(5)
    x = [[r.gauss(0, 1) for _ in range(4)] for _ in range(70)] + [[1.0, 0.0, 0.0, 0.0]] * 6
    df = spark.createDataFrame(list(enumerate(x)), "vid long, vec array<double>")
    got = {(g.src, g["rank"]): g.dst for g in dense.exact_neighbours(df, k=5, min_score=0.1).collect()}
    want = {}
    for i, a in enumerate(x):
        best = sorted((-round(s, 9), j) for j, b in enumerate(x) if j != i and (s := sum(p * q for p, q in zip(a, b, strict=True))) >= 0.1)
        want |= {(i, k): j for k, (_, j) in enumerate(best[:5])}
    assert got == want


def test_adaptive_floor(spark):
    few = [("a", f"d{i}", 0.31 + i / 100) for i in range(9)]
    many = [("b", f"d{i:02d}", 0.30 + i / 50) for i in range(30)]
    flat = [("c", f"d{i:02d}", 0.30) for i in range(12)]
    got = dense.adaptive_floor(spark.createDataFrame(few + many + flat, "src string, dst string, score double"))
    low = [0.30 + i / 50 for i in range(10)]
    mean = sum(low) / 10
    floor = mean + 2 * (sum((x - mean) ** 2 for x in low) / 10) ** 0.5
    n = {x.src: x["count"] for x in got.groupBy("src").count().collect()}
    assert n == {"a": 9, "b": sum(s >= floor for _, _, s in many), "c": 12}


def test_exact_neighbours_in_blocks(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(40)]
    got = dense.exact_neighbours(spark.createDataFrame(rows, "vid int, vec array<double>"), k=5).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for i, v in rows:
        want = sorted((j for j, _ in rows if j != i), key=lambda j: (-round(dot(v, rows[j][1]), 9), j))[:5]
        assert [x.dst for x in sorted((g for g in got if g.src == i), key=lambda g: g["rank"])] == want


def test_cluster_statistics(spark):
    m = spark.createDataFrame([(c, f"v{c}-{i}") for c, n in ((0, 3), (1, 5), (2, 12)) for i in range(n)], "cluster_id long, vid string")
    assert {x.bin: x.clusters for x in stats.size_histogram(m).collect()} == {"6-10": 1, "5": 1, "11-20": 1}
    assert {x.bin: x.clusters for x in stats.size_histogram(m, legacy=False).collect()} == {"2-4": 1, "5": 1, "11-20": 1}
    assert stats.power_law(m.where("cluster_id = 0")).first().alpha is None


def test_label_threshold_is_strict(spark):
    # Unigrams of 'ab cd' and 'ab e': {a,b,c,d,space} and {a,b,e,space}: 3 of 6; 'abcd' and 'ab' + others at exactly 0.4.
    rows = [(1, "l", "abcd", "x1"), (1, "r", "abe", "x2"), (2, "l", "abcd", "x3"), (2, "r", "abc", "x4")]
    m = spark.createDataFrame(rows, "cluster_id int, lang string, text string, vid string")
    got = {x.cluster_id: (x.char_unigram_jaccard, x.category) for x in cross.analysed(m, "l", "r").collect()}
    assert got == {1: (0.4, "meaning_based"), 2: (0.75, "form_based")}
    g = spark.createDataFrame([("abcd", "word"), ("abe", "word")], "wordform string, english string")
    assert {x.cluster_id: x.shared_translations for x in cross.analysed(m, "l", "r", glosses=g).collect()} == {1: ["word"], 2: []}


def test_provenance_keeps_clusters_without_a_partner(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "cluster_id int, vid string")
    b = spark.createDataFrame([(9, "a"), (9, "b"), (9, "c"), (9, "d")], "cluster_id int, vid string")
    assert {x.cluster_id: (x.best, x.provenance) for x in cross.provenance(a, b).collect()} == {1: (0.5, "expanded"), 2: (0.0, "novel")}


def test_fates_and_origins(spark):
    base = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "e"), (3, "f"), (4, "g"), (4, "h"), (4, "i"), (4, "j")], "cluster_id int, vid string")
    other = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"), (5, "g"), (5, "h"), (6, "i"), (6, "j"), (7, "new"), (7, "a")], "cluster_id int, vid string")
    assert {x.cluster_id: x.fate for x in ablation.fates(base, other).collect()} == {1: "preserved", 2: "scattered", 3: "dissolved", 4: "fragmented"}
    got = {x.cluster_id: x.origin for x in ablation.origins(base, other).collect()}
    assert got == {1: "piece", 2: "regrouped", 3: "regrouped", 4: "regrouped", 5: "piece", 6: "piece", 7: "with_new"}
    m = ablation.moved(base, other).first()
    assert (m.dropped, m.gained) == (1, 1)


def test_confusion_is_safe_at_zero(spark):
    none = spark.createDataFrame([(False, False)], "positive boolean, predicted boolean")
    x = evaluate.confusion(none).first()
    assert (x.tn, x.precision, x.recall, x.f1) == (1, 0.0, 0.0, 0.0)
    assert evaluate.mcnemar(none.select("positive", F.col("predicted").alias("predicted_a"), F.col("predicted").alias("predicted_b"))).first().chi2 == 0.0
    assert abs(evaluate.chi2_p(3.841459) - 0.05) < 1e-4


def test_bootstrap_is_repeatable(spark):
    rows = spark.createDataFrame([(i % 3 > 0, i % 4 > 0) for i in range(200)], "positive boolean, predicted boolean")
    a, b = ({x.measure: (x.low, x.high) for x in evaluate.bootstrap(rows, 200).collect()} for _ in range(2))
    assert a == b and all(lo <= hi for lo, hi in a.values())
    two = rows.select("positive", F.col("predicted").alias("predicted_a"), F.col("positive").alias("predicted_b"))
    assert evaluate.paired_bootstrap(two, 200).first().share_above == 1.0


def test_chi_square_drops_rare_themes(spark):
    t = spark.createDataFrame([("a", 10, 5.0), ("b", 5, 10.0), ("c", 4, 50.0), ("d", 50, 4.0)], "theme string, obs long, exp double")
    x = themes.chi_square(t).first()
    assert (x.chi2, x.df, x.kept) == (7.5, 1, 2)


def test_lemma_cascade(spark):
    lex = [("w", 0, "aa", 5, 1, 0, 0), ("w", 1, "bb", 9, 0, 1, 0), ("x", 0, "xx", 1, 1, 0, 0), ("y", 0, "yy", 1, 1, 0, 0), ("y", 1, "zz", 2, 1, 0, 0)]
    entries = spark.createDataFrame(lex, "wordform string, place int, l string, c int, e int, s int, j int")
    for dist, want in (([("w", "aa", 5, 0), ("w", "bb", 1, 0)], "aa"), ([("w", "aa", 5, 1), ("w", "bb", 1, 2)], "bb"), ([("w", "aa", 5, 2), ("w", "bb", 1, 2)], "aa"), ([("w", "aa", 5, 0), ("w", "bb", 1, 1), ("w", "cc", 0, 9)], "aa")):
        d = spark.createDataFrame(dist, "wordform string, lemma string, corpus_n int, llm_n int")
        got = {x.wordform: x.lemma for x in lemma.resolved(entries, d).collect()}
        assert got == {"w": want, "x": "xx", "y": "zz"}


def test_samples_are_stable(spark):
    rows = spark.range(100).select(F.col("id").alias("cluster_id"), (F.col("id") % 7).alias("size"))
    a = {x.cluster_id for x in sample.uniform(rows, "cluster_id", 10).collect()}
    b = {x.cluster_id for x in sample.uniform(rows.repartition(7), "cluster_id", 10).collect()}
    assert a == b and len(a) == 10
    assert sample.by_size_halves(rows, 10).groupBy("half").count().count() == 2


def test_poem_chunks_of_both_shapes(spark, tmp_path):
    (tmp_path / "poems_chunk_1.json").write_text(json.dumps({"A:1": {"v": [" one ", "", "two"], "p": ["x"], "y": "1880"}}))
    (tmp_path / "poems_chunk_2.json").write_text(json.dumps({"metadata": {"n": 1}, "poems": {"KR 50": {"text": "a / b", "places": ["y"], "year": "1900"}, "B": {"text": "c\nd"}}}))
    rows = {(x.vid, x.text, x.year) for x in poems.read_poems(spark, str(tmp_path)).collect()}
    assert rows == {("A:1:0", "one", "1880"), ("A:1:1", "two", "1880"), ("KR 50:0", "a", "1900"), ("KR 50:1", "b", "1900"), ("B:0", "c", None), ("B:1", "d", None)}
    assert spark.createDataFrame([("A:1:3",)], "v string").select(poems.poem_of(F.col("v"))).first()[0] == "A:1"


def test_registry_counts_rejects(spark):
    t = spark.createDataFrame([("p", ["a", " ", "c"], [0, 0, 1]), ("q", ["x"], [0])], "poem_id string, t array<string>, f array<int>")
    got = {(x.vid, x.reason) for x in poems.registry(t, spark.createDataFrame([("p",)], "poem_id string")).collect()}
    assert got == {("p:0", None), ("p:1", "blank"), ("p:2", "flagged"), ("q:0", "poem not in index")}


def test_glosses_and_overrides(spark):
    g = spark.createDataFrame([("a", ["1", "word", "N"]), ("b", ["1"]), ("c", ["1", "x", "N", "", ""]), ("d", ["1", "—"]), ("e", ["1", " "])], "wordform string, entry array<string>")
    assert {x.wordform: x.reason for x in poems.gloss(g).collect()} == {"a": None, "b": "malformed", "c": "fallback", "d": "dash", "e": "empty"}
    rows = spark.createDataFrame([("p", "fi"), ("q", "et")], "poem_id string, lang string")
    o = spark.createDataFrame([("p", "fi", "et"), ("q", "fi", "et")], "poem_id string, from_lang string, to_lang string")
    assert {x.poem_id: x.lang for x in poems.flipped(rows, o).collect()} == {"p": "et", "q": "et"}
    named = poems.with_language(spark.createDataFrame([("KR 1",), ("JR 2",)], "poem_id string"), to_right=["JR 2"])
    assert {x.poem_id: x.lang for x in named.collect()} == {"KR 1": "fi", "JR 2": "et"}
    both = poems.last_write_wins([rows, spark.createDataFrame([("p", "xx")], "poem_id string, lang string")], "poem_id")
    assert {x.poem_id: x.lang for x in both.collect()} == {"p": "xx", "q": "et"}


def test_files_round_trip(spark, tmp_path):
    lists = spark.createDataFrame([("a", 0, "b", 0.5, "s"), ("a", 1, "c", 0.4, "x")], "src string, rank int, dst string, score double, mtype string")
    sinks.write_neighbours(lists, str(tmp_path / "n"), "jaccard", {"k": 2})
    back = poems.read_neighbours(spark, str(tmp_path / "n" / "*.gz"), "jaccard")
    assert [(x.src, x["rank"], x.dst, x.score) for x in back.orderBy("rank").collect()] == [("a", 0, "b", 0.5), ("a", 1, "c", 0.4)]
    m = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "cluster_id long, vid string")
    sinks.membership_rows(m).write.json(str(tmp_path / "m"))
    got = poems.read_membership(spark, str(tmp_path / "m"), spark.createDataFrame([("a",), ("c",)], "vid string"))
    assert {(x.cluster_id, x.vid) for x in got.collect()} == {(1, "a"), (2, "c")}
    sinks.write_report({"n": 1}, str(tmp_path / "r"), spark)
    assert sinks.file_digests(spark, str(tmp_path / "r" / "*.txt")).count() == 1
    sinks.replaced(m, str(tmp_path / "t"))
    sinks.replaced(m.where("cluster_id = 1"), str(tmp_path / "t"))
    assert sinks.current(spark, str(tmp_path / "t")).count() == 2
    long_ = m.selectExpr("cluster_id", "vid", "'c' AS category", "'et' AS lang", "'x' AS place", "vid AS poem_id", "concat('T/', vid) AS text")
    an = long_.selectExpr("cluster_id", "category", "0.5 AS char_unigram_jaccard", "0.25 AS word_jaccard").distinct()
    made = sinks.views(long_, an, "et", "fi")
    assert {k: d.count() for k, d in made.items()} == {"nested": 2, "members": 3, "clusters": 2}
    assert [(x.cluster_id, x.size, x.left_count, x.unknown_count, x.left_example_poem) for x in made["clusters"].orderBy("cluster_id").collect()] == [(1, 2, 2, 0, "a"), (2, 1, 1, 0, "c")]
    sinks.write_views(made, str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v" / "membership")).count() == 2
    assert sinks.tagged("a/b.json.gz", "x") == "a/b_x.json.gz" and sinks.tagged("/b.json", None) == "/b.json" and sinks.tagged("b.json", "t") == "b_t.json"
    figures = spark.createDataFrame([(0.05, 7)], "mean double, pairs long")
    verdicts = sinks.judged(figures, [("mean < 0.1", "mean", "< 0.1"), ("pairs > 9", "pairs", "> 9"), ("review", "pairs", None)])
    said = sinks.text_report("REPORT", [("figures", figures)], verdicts)
    assert "[ PASS   ] mean < 0.1" in said and "[ FAIL   ] pairs > 9" in said and "[ REVIEW ] review" in said and "mean: 0.050000" in said
    d = sinks.file_digests(spark, str(tmp_path / "r" / "*.txt"))
    assert [(x.change, x.delta) for x in sinks.digest_changes(d, d).collect()] == [("same", 0)]
    assert [x.change for x in sinks.digest_changes(d, d.limit(0)).collect()] == ["gone"]
    sinks.write_cluster_csvs(long_, str(tmp_path / "c"), 1)
    assert [p.name for p in (tmp_path / "c").glob("cluster=*")] == ["cluster=0001_T_a"]


def test_override_lists(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"finnish_pids": [{"pid": "ERA 1", "x": 1}, {"pid": "H 2"}]}))
    assert {x.poem_id for x in poems.read_overrides(spark, str(tmp_path / "o.json")).collect()} == {"ERA 1", "H 2"}
    assert len(set(ET_OVERRIDES)) == 35 and "JR 03705" in ET_OVERRIDES and lowered_min_df(5, 100) == 2 and lowered_min_df(5, None) == 5


def test_places_are_dealt_in_ranges(spark):
    rows = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)], "k long, v string").repartition(5)
    got = order.placed(rows, F.desc("k"))
    assert {(x.k, x.place) for x in got.collect()} == {(k, 100 - k) for k in range(101)}
    assert order.placed(rows.limit(0), F.asc("k")).count() == 0


def test_encoders(spark):
    v = spark.createDataFrame([("a", "aa bb bb"), ("b", ""), ("c", None), ("d", "cc")], "vid string, text string")
    letters = lambda texts: np.array([[t.count("a"), t.count("b")] for t in texts], float)
    got = {x.vid: x.vec for x in encode.encoded(v, letters).collect()}
    assert got.keys() == {"a"} and np.allclose(got["a"], np.array([2, 4]) / math.sqrt(20))
    vec = {x.vid: x.vec for x in v.select("vid", encode.hashed_words(F.col("text"), 8).alias("vec")).where("text is not null").collect()}
    want = [0.0] * 8
    for w in ("aa", "bb"):
        h = hashlib.md5(w.encode()).hexdigest()
        want[int(h[:6], 16) % 8] += 1.0 if int(h[6], 16) < 8 else -1.0
    assert vec["a"] == want and vec["b"] == [0.0] * 8


def test_lemma_cascade_by_hand(spark):
    entries = [("kala", 0, "kala", 9, 9, 0, 0), ("tule", 0, "tulema", 5, 5, 0, 0), ("tule", 1, "tuli", 7, 0, 4, 3), ("maa", 0, "maa", 3, 3, 0, 0), ("maa", 1, "maata", 4, 0, 4, 0), ("laul", 0, "laul", 2, 1, 1, 0), ("laul", 1, "laulma", 2, 1, 1, 0)]
    counts = [("tule", "tulema", 10, 1), ("tule", "tuli", 2, 5), ("maa", "maa", 6, 0), ("maa", "maata", 1, 0), ("laul", "laul", 4, 2), ("laul", "laulma", 4, 5)]
    found = lemma.resolved(spark.createDataFrame(entries, "wordform string, place int, l string, c int, e int, s int, j int"), spark.createDataFrame(counts, "wordform string, lemma string, corpus_n int, llm_n int"))
    assert {x.wordform: x.lemma for x in found.collect()} == {"kala": "kala", "tule": "tuli", "maa": "maa", "laul": "laulma"}


def test_five_lists_match_plain_ones(spark, tmp_path):
    """Character bigrams and sentence vectors of the lines of a small table, and the fusion of all five lists."""
    from linekin.plans.catalog import QUERIES

    r = random.Random(12)
    vocabulary = "river mountain story window garden council evening market village season letter".split()
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 6))) for _ in range(12)]
    texts = ["\n".join(r.choice(base) + r.choice(["", " again", " once"]) for _ in range(r.randint(1, 4))) for _ in range(24)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    v = {f"{i}:{k}": line for i, t in enumerate(texts) for k, line in enumerate(t.split("\n"))}
    grams = {a: {t[k : k + 2] for k in range(len(t) - 1)} for a, t in v.items()}
    df = {}
    for g in grams.values():
        for x in g:
            df[x] = df.get(x, 0) + 1
    kept = set(sorted(df, key=lambda x: (-df[x], x))[:200])
    grams = {a: g & kept for a, g in grams.items()}
    want = {}
    for a in grams:
        best = sorted((-round(s, 9), b) for b in grams if b != a and (s := len(grams[a] & grams[b]) / math.sqrt(len(grams[a]) * len(grams[b]))) >= 0.6)
        want |= {(a, k): b for k, (_, b) in enumerate(best[:50])}
    got = QUERIES["charbigram_topk"](spark, str(tmp_path)).collect()
    assert {(x.src, x["rank"]): x.dst for x in got} == want
    sent = QUERIES["sentence_topk"](spark, str(tmp_path)).collect()
    assert all(x.src.split(":")[0] != x.dst.split(":")[0] and x.score >= 0.3 - 1e-6 for x in sent)
    from linekin.plans import exchange

    lists = {n: d.collect() for n, d in exchange._five(spark, str(tmp_path)).items()}
    assert list(lists) == ["jaccard", "tfidf", "translation", "charbigram", "sentence"]
    total = {}
    for no, (_, rows) in enumerate(lists.items()):
        for x in rows:
            total.setdefault((x.src, x.dst), []).append((no, x["rank"]))
    passed = {p: sum(1 / (60 + k) for _, k in t) for p, t in total.items() if len(t) >= 2 and sum(1 / (60 + k) for _, k in t) >= 0.033}
    fused = {(x.src, x.dst): x.rrf for x in QUERIES["rrf_five"](spark, str(tmp_path)).collect()}
    assert fused and all(abs(passed[p] - s) < 1e-8 for p, s in fused.items())
    for a in {a for a, _ in passed}:
        assert sum(p[0] == a for p in fused) == min(20, sum(p[0] == a for p in passed))


def test_cells_with_all_probes_are_exact(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(80)], "vid long, vec array<double>")
    exact = dense.exact_neighbours(rows, k=7)
    found = dense.cell_neighbours(rows, k=7, cells=4, probes=4)
    assert {(x.src, x["rank"], x.dst) for x in found.collect()} == {(x.src, x["rank"], x.dst) for x in exact.collect()}
    assert [(x.queries, x.recall) for x in dense.recall(found, exact).collect()] == [(80, 1.0)]
    few = dense.recall(dense.cell_neighbours(rows, k=7, cells=4, probes=1), exact).first()
    assert 0.2 < few.recall < 1.0


def test_cohesion_matches_a_plain_version(spark):
    r = random.Random(7)
    names = [f"v{i:02d}" for i in range(30)]
    member = {c: sorted(r.sample(names, r.randint(2, 9))) for c in range(6)}
    score = {(a, b): round(r.random(), 3) for a in names for b in r.sample(names, 6) if a != b}
    got = stats.cohesion(spark.createDataFrame([(c, v) for c, m in member.items() for v in m], "cluster_id long, vid string"), spark.createDataFrame([(a, b, s) for (a, b), s in score.items()], "src string, dst string, rrf double"), reach=3, heads=2).first()
    means = []
    for m in member.values():
        own = [score.get((m[i], m[j]), score.get((m[j], m[i]), 0.0)) for i in range(len(m)) for j in range(i + 1, min(i + 3, len(m)))]
        means.append(sum(own) / len(own))
    out = [s for m in member.values() for v in m[:2] for (a, b), s in score.items() if a == v and b not in m]
    assert abs(got.intra_mean - np.mean(means)) < 1e-9 and abs(got.intra_median - np.median(means)) < 1e-9 and abs(got.inter_mean - np.mean(out)) < 1e-9
    assert abs(got.ratio - np.mean(means) / np.mean(out)) < 1e-9


def test_cohesion_counts_all_clusters_pairs_and_members(spark):
    r = random.Random(8)
    names = [f"v{i:02d}" for i in range(60)]
    member = {c: sorted(r.sample(names, 30 if c < 2 else 2)) for c in range(1003)}
    score = {(a, b): round(r.random(), 3) for a in names for b in r.sample(names, 9) if a != b}
    got = stats.cohesion(spark.createDataFrame([(c, v) for c, m in member.items() for v in m], "cluster_id long, vid string"), spark.createDataFrame([(a, b, s) for (a, b), s in score.items()], "src string, dst string, rrf double")).first()
    means = [np.mean([score.get((a, b), score.get((b, a), 0.0)) for i, a in enumerate(m) for b in m[i + 1 :]]) for m in member.values()]
    out = [s for m in member.values() for (a, b), s in score.items() if a in m and b not in m]
    assert abs(got.intra_mean - np.mean(means)) < 1e-9 and abs(got.intra_median - np.median(means)) < 1e-9 and abs(got.inter_mean - np.mean(out)) < 1e-9


def test_links_are_followed_in_rounds_and_at_once(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, i + 1) for i in range(90)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)] + [(500, 500)]
    links = spark.createDataFrame(rows, "a long, b long")
    found = []
    for few in (1 << 17, 40, 0):
        monkeypatch.setattr("linekin.operators.graph.FEW", few)
        found.append({(x.node, x.component) for x in components(links).collect()})
    assert found[0] == found[1] == found[2] and {(i, 0) for i in range(91)} <= found[0]


def test_small_components_share_a_group(spark):
    assert cluster.dealt(spark.range(10_000).select(F.col("id").cast("string").alias("component"))).select("group").distinct().count() <= 2048


@pytest.mark.parametrize(("name", "measures"), [("rrf_leave_one_out", ["jaccard", "cosine"]), ("score_buckets", ["jaccard"])])
def test_only_lists_that_are_asked_for_are_made(spark, sf_dir, monkeypatch, name, measures):
    from linekin.operators import neighbours
    from linekin.plans.catalog import QUERIES

    made, lists = [], neighbours.bag_lists
    monkeypatch.setattr(neighbours, "bag_lists", lambda rows, m, *a, **b: made.extend(m) or lists(rows, m, *a, **b))
    QUERIES[name](spark, sf_dir).count()
    assert made == measures


def test_bootstrap_matches_plain_resamples(spark):
    rows = spark.createDataFrame([(True, True)] * 30 + [(True, False)] * 10 + [(False, True)] * 5 + [(False, False)] * 55, "positive boolean, predicted boolean")
    plain = []
    for i in range(300):
        tp, fp, fn, _ = np.random.default_rng([42, i]).multinomial(100, [0.3, 0.05, 0.1, 0.55])
        p, q = tp / max(tp + fp, 1), tp / max(tp + fn, 1)
        plain.append((p, q, 2 * p * q / (p + q) if p + q else 0.0))
    want = {m: tuple(np.quantile([x[k] for x in plain], [0.025, 0.975])) for k, m in enumerate(("precision", "recall", "f1"))}
    for x in evaluate.bootstrap(rows, 300).collect():
        assert np.allclose((x.low, x.high), want[x.measure])
    assert abs(evaluate.chi2_p(3.841459) - 0.05) < 1e-6


@pytest.mark.parametrize("options", [{}, {"exclude_same_poem": True}, {"exclude_adjacent": True}, {"exclude_same_poem": True, "exclude_first": False}, {"dedup": False}])
def test_neighbour_lists_match_pairs_that_are_ranked_whole(spark, monkeypatch, options):
    """Several groups and chunks, many copies and ties; only as many sets as a list needs are kept for each."""
    from linekin.operators import neighbours as N

    monkeypatch.setattr(N, "GROUP", 16)
    monkeypatch.setattr(N, "CHUNK", 8)
    draw = random.Random(4)
    words = [f"w{i}" for i in range(14)]
    texts = [" ".join(draw.sample(words, draw.randint(2, 6))) for _ in range(60)] * 2
    rows = [(f"p{i // 6}:{i % 6}", f"p{i // 6}", i % 6, t.upper() if i % 3 else t, "en" if i % 2 else None) for i, t in enumerate(texts)]
    v = spark.createDataFrame(rows, "vid string, poem_id string, idx int, text string, lang string")
    toks = S.tokens(v)
    w = S.weighted(toks, S.vocabulary(toks, min_df=1, max_share=1.0))
    pairs, members = S.set_pairs(w, tuple(S.FLOORS))
    members = S.described(v, members)
    got = N.neighbour_lists(v, w, tuple(S.FLOORS), k=5, over=2, **options)
    for m in S.FLOORS:
        want = S.top_neighbours(pairs.where(F.col("measure") == m), members, k=5, over=2, **options)
        plain = lambda df: sorted((r.src, r["rank"], r.dst, round(r.score, 9), r.mtype) for r in df.collect())
        assert plain(got.where(F.col("measure") == m)) == plain(want)


def test_lists_of_lines_write_no_table_of_pairs(spark, monkeypatch):
    from linekin.plans import catalog as C
    from linekin.plans import storage

    written: list[int] = []
    new_path = storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda s, what: written.append(new_path(s, what)) or written[-1])
    rows = [(f"{d}:{i}", str(d), i, f"moon river stone a{d % 5} b{i}", "en") for d in range(60) for i in range(4)]
    v = spark.createDataFrame(rows, "vid string, poem_id string, idx int, text string, lang string")
    toks = S.tokens(v)
    top = C.legs(v, S.weighted(toks, S.vocabulary(toks, min_df=1, max_share=1.0)), ("jaccard",), k=3, exclude_same_poem=True)["jaccard"]
    assert top.count() == 240 * 3
    assert max(spark.read.parquet(p).count() for p in written) <= 240 * 3


def test_cells_are_compared_in_blocks_and_not_in_a_join(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 3)
    draw = np.random.default_rng(3)
    x = draw.standard_normal((90, 5))
    x /= np.sqrt((x * x).sum(1))[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vid long, vec array<double>")
    found = dense.cell_neighbours(rows, k=7, cells=4, probes=4)
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan
    want = [(i, r, int(j)) for i in range(90) for r, j in enumerate(np.argsort(-np.where(np.arange(90) == i, -9, x @ x[i]), kind="stable")[:7])]
    assert sorted((r.src, r["rank"], r.dst) for r in found.collect()) == want


def test_groups_of_lists_read_the_sets_without_a_shuffle_and_each_in_its_own_task(spark, monkeypatch):
    from linekin.operators import neighbours as N

    monkeypatch.setattr(N, "GROUP", 16)
    rows = [(f"{d}:0", str(d), 0, f"moon river stone{d} a{d % 5}", "en") for d in range(80)]
    v = spark.createDataFrame(rows, "vid string, poem_id string, idx int, text string, lang string")
    toks = S.tokens(v)
    lists = N.neighbour_lists(v, S.weighted(toks, S.vocabulary(toks, min_df=1, max_share=1.0)), ("jaccard",), k=3)
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    by_task = lists.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("src").alias("n")).collect()
    assert len(by_task) == 5 and sum(r.n for r in by_task) == 80


def _documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["jaccard_exclude_same", "jaccard_exclude_adjacent", "jaccard_topk", "jaccard_idf_topk", "list_overlap"])
def test_lists_of_lines_write_no_table_of_tokens(spark, tmp_path, monkeypatch, name):
    from linekin.plans import storage
    from linekin.plans.catalog import QUERIES

    draw = random.Random(2)
    rows = [(d, "\n".join(" ".join(f"w{d % 9}x{draw.randrange(40)}" for _ in range(8)) for _ in range(4)), "en", "web", 0) for d in range(60)]
    path = _documents(spark, tmp_path, rows)
    written: list[int] = []

    def counted(df, what, *options):
        written.append(df.count())
        return stored(df, what, *options)

    stored = storage.stored
    monkeypatch.setattr("linekin.operators.neighbours.stored", counted)
    monkeypatch.setattr("linekin.plans.catalog.stored", lambda df, what, *o: (stored if what == "lists" else counted)(df, what, *o))
    QUERIES[name](spark, path).collect()
    assert written and max(written) <= 240


def test_lines_of_documents_that_share_an_id_have_lists(spark, tmp_path):
    from linekin.plans.catalog import line_legs

    texts = [f"moon river stone{i % 3} glass{i % 4}\nbridge river cloud{i % 2}" for i in range(60)]
    rare = "\n".join(f"q{i} z{i}" for i in range(2000))
    path = _documents(spark, tmp_path, [(i // 2, t, "en", "web", 0) for i, t in enumerate(texts)] + [(99, rare, "en", "web", 0)])
    assert {r.src.split(":")[0] for r in line_legs(spark, path, ("jaccard",), k=3)["jaccard"].collect()} == {str(i) for i in range(30)}


@pytest.mark.parametrize("measure", list(S.FLOORS))
@pytest.mark.parametrize("words", [40, 4000])
def test_sums_of_shared_tokens_choose_all_that_reach_the_floor(measure, words):
    """Few and many postings a set, from two chunks, against sets that are compared one by one."""
    from linekin.operators import neighbours as N

    draw = np.random.default_rng(words)
    idf = np.sort(draw.uniform(0.5, 6, words))[::-1].copy()
    sets = [np.unique(draw.integers(0, words, draw.integers(2, 30))).astype(np.int32) for _ in range(500)]
    sets += [np.unique(np.append(draw.choice(t, max(2, len(t) - 3)), draw.integers(0, words, 2))).astype(np.int32) for t in sets]
    names = [f"{i:04d}" for i in range(len(sets))]
    own = N._Sets([measure], S.FLOORS, idf, 2, False)
    own.tokens, own.reps, own.most = sets, names, [30] * len(sets)
    for a in (0, 600):
        part = sets[a : a + 600]
        own.meet(np.concatenate(part), np.array([len(t) for t in part]), pa.array(names[a : a + 600]))
    w = own.weight[measure]
    for r in range(0, len(sets), 7):
        every = []
        for j, t in enumerate(sets):
            shared = np.intersect1d(sets[r], t)
            both = w[shared].sum()
            score = both / math.sqrt(w[sets[r]].sum() * w[t].sum()) if measure == "cosine" else both / (w[sets[r]].sum() + w[t].sum() - both)
            if score >= S.FLOORS[measure] and len(shared) >= (1 if measure == "cosine" else 2):
                every.append((-round(score, 9), names[j]))
        scores, places = own.best[measure][r]
        assert sorted((-round(float(s), 9), own.name(int(p))) for s, p in zip(scores, places, strict=True)) == sorted(every)[:30]


@pytest.mark.parametrize("measure", list(S.FLOORS))
def test_several_sets_are_compared_at_once(monkeypatch, measure):
    from linekin.operators import neighbours as N

    calls = []
    compare = N._Sets._compare
    monkeypatch.setattr(N._Sets, "_compare", lambda self, *a: (calls.append(1), compare(self, *a))[1])
    sets = [np.array([i // 2, 200 + i // 4], np.int32) for i in range(400)]
    own = N._Sets([measure], S.FLOORS, np.linspace(6, 3, 400), 2, False)
    own.tokens, own.reps, own.most = sets, [f"{i:04d}" for i in range(400)], [30] * 400
    own.meet(np.concatenate(sets), np.full(400, 2), pa.array(own.reps))
    assert all(len(own.best[measure][r][0]) >= 2 for r in range(400))
    assert len(calls) <= 40


@pytest.mark.parametrize("sets, parts", [(300, 20), (1 << 20, 4096)])
@pytest.mark.parametrize("plain", [True, False])
def test_sums_by_sorting_find_all_places_that_reach_a_bound(sets, parts, plain):
    """Places and parts that fit 32 bits together, and such that do not."""
    from linekin.operators.neighbours import _summed

    draw = np.random.default_rng(parts)
    mass = np.sort(draw.uniform(3, 60, sets))
    weight = np.ones(parts, np.float32) if plain else np.sort(draw.uniform(1, 9, parts))[::-1].astype(np.float32)
    cells = [np.sort(draw.choice(sets, 60, replace=False) if sets < 1000 else draw.integers(0, 4000, 1) + np.arange(0, 240, 4)).astype(np.int32) for _ in range(parts)]
    total = np.bincount(np.concatenate(cells), np.repeat(weight, 60), sets)
    for asked in (0.05, 0.2, 0.6, 2.0):
        found, got = _summed(np.concatenate(cells), weight, np.full(parts, 60), mass, asked, 5.0, (mass[0] + 5) * asked, plain)
        good = np.flatnonzero(total >= asked * (mass + 5) * (1 + 1e-5))
        assert np.isin(good, found).all() and len(np.unique(found)) == len(found)
        assert np.allclose(got, total[found], rtol=1e-4)
