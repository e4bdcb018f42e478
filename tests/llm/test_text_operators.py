"""Near-duplicates, line dedup, mixing and quality against brute-force versions and on odd tables."""

from __future__ import annotations

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linekin.llm import lines, minhash, mixing, quality
from linekin.llm.queries import OP4_SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def shingle_set(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


class Sets:
    def __init__(self):
        self.p = {}

    def find(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.p[max(x, y)] = min(x, y)


def brute_near(texts):
    sets, u = [shingle_set(t) for t in texts], Sets()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                u.join(i, j)
    return {i: (len(s), u.find(i)) for i, s in enumerate(sets)}


def edited(r, words, share):
    return [r.choice("αβγδε") + str(r.randrange(999)) if r.random() < share else w for w in words]


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "SPLIT", 20)
    monkeypatch.setattr(minhash, "SALTS", 3)
    texts = [None, "", " \t\n", "One", "one", "ONE two", "one two three four", "É é", "the " * 400]
    for _ in range(25):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([5, 6, 9, 30, 200]))]
        texts += [" ".join(edited(r, base, s)) for s in (0, 0, 0.01, 0.03, 0.05)]
    hot = [f"h{k}" for k in range(120)]
    texts += [" ".join(edited(r, hot, r.choice([0, 0.01, 0.02, 0.03, 0.05]))) for _ in range(120)]
    texts.append(" ".join(f"long{k}" for k in range(60_000)))
    want = brute_near(texts)
    rows = minhash.near_duplicates(docs_of(spark, texts)).collect()
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in rows}
    assert len(rows) == len(texts)
    assert got == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in rows)


def test_near_duplicates_odd_tables(spark):
    none = minhash.near_duplicates(docs_of(spark, []))
    assert none.columns == ["doc_id", "n_shingles", "component_id", "kept"] and none.count() == 0
    same = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f")], "doc_id long, text string")
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in minhash.near_duplicates(same).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, 3, True)], key=str)


def test_sketch_estimates():
    r = np.random.default_rng(0)
    x = np.unique(r.integers(1, 2**63, 4000, dtype=np.uint64))
    a, b = np.sort(x[:3000]), np.sort(x[500:3500])
    s = minhash.sketches(np.concatenate([a, b]), np.array([0, 3000, 6000]))
    guess, sigma = minhash.estimate(s[:1], s[1:], np.array([3000]), np.array([3000]))
    assert abs(guess[0] - 2500 / 3500) < 4 * sigma[0]


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def mutated(r, s, k):
    for _ in range(k):
        i, c = r.randrange(len(s) + 1), r.choice("abé ")
        s = r.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]])
    return s


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_edit_distance(spark, edits):
    r = random.Random(edits)
    pairs = [(s, mutated(r, s, r.randint(0, 5))) for s in ("".join(r.choice("abé ") for _ in range(r.randint(1, 30))) for _ in range(250))]
    pairs = [p for p in pairs if all(p)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.edit_distance(F.col("a"), F.col("b"), edits).alias("d")).collect()
    assert all(min(x.d, edits + 1) == min(distance(x.a, x.b), edits + 1) for x in got)


def brute_lines(docs, edits, least):
    occ = [(d, p, x) for d, t in docs if t for p, x in enumerate(t.split("\n")) if len(x) >= least]
    every, u = sorted({x for _, _, x in occ}), Sets()
    near = set()
    for i, x in enumerate(every):
        for y in every[:i]:
            if abs(len(x) - len(y)) <= edits and distance(x, y) <= edits:
                near |= {x, y}
                u.join(x, y)
    first = {}
    for d, p, x in sorted(occ):
        first.setdefault(u.find(x), (d, p))
    out = {}
    for d, t in docs:
        kept, n, gone, close = [], 0, 0, 0
        for p, x in enumerate(t.split("\n") if t is not None else []):
            if len(x) >= least:
                n, close = n + 1, close + (x in near)
                if first[u.find(x)] != (d, p):
                    gone += 1
                    continue
            kept.append(x)
        out[d] = (None if t is None else "\n".join(kept), n, gone, close)
    return out


@pytest.mark.parametrize(("edits", "hot"), [(1, 3), (2, 5000), (2, 12)])
def test_line_dedup_matches_brute_force(spark, monkeypatch, edits, hot):
    monkeypatch.setattr(lines, "MIN_CHARS", 8)
    monkeypatch.setattr(lines, "HOT", hot)
    r = random.Random(hot)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(8, 24))) for _ in range(40)]
    pool = base + [mutated(r, r.choice(base), r.randint(0, 3)) for _ in range(120)] + [f"common half of it {i:02d}" for i in range(20 if edits == 1 else 4)]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 8)))) for i in range(70)] + [(70, None), (71, ""), (72, "\n\n")]
    got = lines.without_repeats(spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, n_near string"), edits).collect()
    assert {x.doc_id: (x.text, x.n_lines, x.n_removed, x.n_near) for x in got} == brute_lines(docs, edits, 8)


def test_line_dedup_odd_tables(spark):
    assert lines.without_repeats(docs_of(spark, [])).count() == 0
    long_ = "x" * 30_000
    got = lines.without_repeats(docs_of(spark, [long_, long_, "y" * 25, None])).orderBy("doc_id").collect()
    assert [x.text for x in got] == [long_, "", "y" * 25, None] and [x.source for x in got] == ["a"] * 4


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_matches_sql(spark, seed):
    r = random.Random(seed)
    sources = [None, "é", "b", "a", "Z", "c"]
    texts = [r.choice([None, "", " \t ", "w " * r.choice([1, 3, 50, 900]), "a b\nc"]) for _ in range(200)]
    own = [sources[min(5, int(r.expovariate(0.7)))] for _ in texts]
    df = docs_of(spark, texts, own)
    got = mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken", "passes").toPandas()
    documents = df.toPandas()  # noqa: F841  DuckDB reads it by name
    want = duckdb.sql(OP4_SQL).df()
    key = ["doc_id"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    for c in a.columns:
        assert (a[c].astype(float) - b[c].astype(float)).abs().max() < 1e-9, c
    assert (got["taken"] <= 2 * got["size"]).all()
    by = got.assign(source=[own[i] or "" for i in got["doc_id"]]).groupby("source").agg({"taken": "sum", "target": "first", "size": "max"})
    assert ((by["taken"] - by["target"]).abs() <= by["size"] / 2 + 1).all()


def test_mixing_odd_tables(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert mixing.mixed_documents(docs_of(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, "a b", None), (1, "a b", None), (None, "c d e", "s")], "doc_id long, text string, source string")
    got = mixing.mix(twice).collect()
    assert len(got) == 3 and all(x.taken <= 2 * x.size for x in got)
    out = mixing.mixed_documents(docs_of(spark, ["a b c"] * 30, ["a", "b", "c"] * 10))
    assert out.columns == DOCS.replace(",", "").split()[::2] and out.count() == 45


def test_schedule_is_inverted(spark):
    rows = spark.createDataFrame([(m / 20, s) for m in range(21) for s in (-0.5, 0.0, 0.5)], "met double, slope double")
    for x in rows.select("met", "slope", mixing.schedule_time(F.col("met"), F.col("slope")).alias("t")).collect():
        assert 0 <= x.t <= 1 and abs(x.t + x.slope * (x.t * x.t - x.t) - x.met) < 1e-9


def test_quality_held_out_accuracy(spark):
    d, la = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scored(d, la).join(la.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.97
    assert rows.loc[rows["quality"] == 1, "predicted"].mean() > 0.99
    assert rows["score"].between(0, 1).all()


def test_quality_split_and_odd_tables(spark):
    la = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    d = docs_of(spark, [None, "", "word " * 50_000, "a\n\n.", "é"])
    rows = quality.scored(d, la).collect()
    assert [x.held_out for x in sorted(rows, key=lambda x: x.doc_id)] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(5)]
    assert {x.score for x in rows} == {0.5}
    assert quality.scored(docs_of(spark, []), la).count() == 0
    assert quality.kept_documents(d, la).columns == d.columns


def test_statistics_do_not_depend_on_chunks():
    import pyarrow as pa

    from linekin.llm import common

    texts = pa.array(["A b.\nc  c", "", None, "###\n.", "é É", "x" * 50, "\n.\n"])
    whole = quality.chunk_statistics(texts)
    parts = np.concatenate([quality.statistics(raw, at) for _, raw, at in common.text_chunks(texts, 1)])
    assert np.allclose(whole, parts)
