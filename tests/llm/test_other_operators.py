"""PII, vectors, token shards, pieces, HTML and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linekin.llm import ann, html_text, near_vectors, pieces, pii, sstable
from linekin.llm.bpe import Encoder

BPE, SPM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- PII


def plain_spans(t):
    o = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    o += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and pii._luhn(d):
            o.append((*m.span(), "card"))
    o += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(o, key=lambda s: (s[0], pii._RANK[s[2]]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "1", "25", "-", " ", "+", "(", ")", "4111111111111111", "é", "0", "%", "555"]), max_size=40))
def test_base_spans_are_the_plain_matches(parts):
    t = "".join(parts)
    assert pii.base_spans(t) == plain_spans(t)


def test_crf_learns_its_table_and_adds_spans():
    chain = pii.train()
    rows = pii.labelled_sentences()
    got = chain.decode([pii.tests(w) for w, _ in rows])
    assert all(list(p) == y for (_, y), p in zip(rows, got, strict=True))
    t = 'é key: token = "0123456789abcdef0123456789abcdef01234567" and 219-09-9999. The year 1998.'
    spans = pii.added_spans([t], [pii.base_spans(t)], chain)[0]
    assert {(t[a:b], k) for a, b, k in spans} >= {("0123456789abcdef0123456789abcdef01234567", "secret"), ("219-09-9999", "ssn")}


def test_personal_data_table(spark):
    texts = [None, "", "é a@b.co x", "1.2.3.4 +1 (443) 555-5793", "9" * 100_000, "a@b.co"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "a@b.co", "z")], "doc_id long, text string, n_email string")
    rows = {x.doc_id: x for x in pii.personal_data(df).collect()}
    assert rows[2].spans == "email:2:8" and rows[2].n_email == 1
    assert rows[2].base_sha256 == hashlib.sha256(b"email:2:8").hexdigest()
    assert rows[0].base_sha256 == rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (rows[3].n_ip, rows[3].n_phone) == (1, 1) and rows[None].n_email == 1
    assert pii.personal_data(df.limit(0)).count() == 0


# ---- vectors


def table_of(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")


def odd_vectors(r, d):
    nan, inf = float("nan"), float("inf")
    return [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [nan] * d, [inf] + [0.0] * (d - 1), [1.0, 2.0]]


def test_near_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 64)
    monkeypatch.setattr(near_vectors, "TILE", 32)
    r = np.random.default_rng(0)
    x = r.standard_normal((150, 16))
    x = np.vstack([x, x[:40] * 3, x[40:80] + 0.2 * r.standard_normal((40, 16)), np.tile(x[100], (30, 1)), x[101] + 0.15 * r.standard_normal((60, 16))]).astype(np.float32)
    rows = [*x.tolist(), *odd_vectors(r, 16)]
    got = {k.vec_id: (k.n_links, k.component_id, k.kept) for k in near_vectors.near_vectors(table_of(spark, rows)).collect()}
    y = x.astype(float)
    u = y / np.linalg.norm(y, axis=1)[:, None]
    link = u @ u.T >= 0.95
    comp = np.arange(len(x))
    while True:
        new = np.where(link, comp[None], len(x)).min(1)
        if (new == comp).all():
            break
        comp = new
    want = {i: (int(link[i].sum()) - 1, int(comp[i]), bool(comp[i] == i)) for i in range(len(x))}
    want |= {len(x) + i: (0, len(x) + i, True) for i in range(len(rows) - len(x))}
    assert got == want


def test_near_vectors_that_agree_in_all_leading_coordinates(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    monkeypatch.setattr(near_vectors, "LEADING", 1)
    x = [[1.0, 0.01 * i, 0.0] for i in range(60)] + [[0.0, 0.0, 1.0 + i] for i in range(40)]
    got = {k.vec_id: (k.n_links, k.component_id) for k in near_vectors.near_vectors(table_of(spark, x)).collect()}
    u = np.array(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.95
    assert got == {i: (int(link[i].sum()) - 1, 0 if i < 60 else 60) for i in range(100)}


def test_nearest_recall_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 100)
    r = np.random.default_rng(1)
    centres = r.standard_normal((10, 32))
    x = (centres[r.integers(0, 10, 900)] + r.standard_normal((900, 32))) * r.uniform(0.5, 2, (900, 1))
    x[500:560] = x[500]
    rows = [*x.astype(np.float32).tolist(), *odd_vectors(r, 32)]
    got = ann.nearest(table_of(spark, rows), F.col("vec_id") % 20 == 0, 20).collect()
    y = np.array(x, np.float32).astype(float)
    hits = total = 0
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append(g)
    for q in range(0, 900, 20):
        s = y @ y[q]
        s[q] = -np.inf
        want = set(np.lexsort((np.arange(900), -s))[:20])
        own = sorted(by[q], key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == list(range(1, 21))
        assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in itertools.pairwise(own))
        assert all(abs(g.score - y[q] @ y[g.vec_id]) < 1e-9 for g in own)
        hits += len(want & {g.vec_id for g in own})
        total += 20
    assert hits / total >= 0.9 and set(by) == set(range(0, 900, 20))
    assert ann.nearest(table_of(spark, rows[:5]), F.col("vec_id") % 20 == 0, 20).count() == 4
    assert ann.nearest(table_of(spark, []), F.col("vec_id") % 20 == 0, 20).count() == 0


# ---- token ids


def test_remembered_cuts_are_the_librarys_ids():
    own, lib = Encoder(BPE), Tokenizer.from_file(BPE)
    r = random.Random(2)
    parts = ["the", " ", "  ", "\n", "'s", "'", "é", "don't", "\t", "12", "!!", "B", "ß", "　", "日", "\x1f", "\x85", "\xa0", "\xad", "<|endoftext|>", "²", "ª", "\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["a" * 3000, ""]
    for a, b in zip(own.encode(texts), lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert a.tolist() == b.ids


def test_shards_round_trip(spark):
    texts = {7: "Hello there", -3: "", 2: None, 5: "é " * 40_000, 9: "same", 10: "same", 11: "a <|endoftext|> b"}
    rows = [*texts.items(), (None, "no id"), (7, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    shards = sstable.written(df, BPE)
    lib = Tokenizer.from_file(BPE)
    start = 0
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    got = sorted(sstable.read_back(shards).collect(), key=lambda x: x.start)
    assert len(got) == len(rows)
    for (i, t), g in zip(order, got, strict=True):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2])
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        start += len(ids)
    for s in shards.collect():
        reader = sstable.Reader(s.file)
        for key, ids in list(reader.scan()):
            assert any((ids == f).all() for f in reader.get(key) if len(f) == len(ids))
        assert reader.get(sstable.key_of(123456)) == []
    assert sstable.read_back(sstable.written(df.limit(0), BPE)).count() == 0


def test_shard_with_many_blocks(tmp_path):
    path = tmp_path / "x.sst"
    with path.open("wb") as out:
        w = sstable.Writer(out, 2)
        for i in range(5000):
            w.add(sstable.key_of(3 * i), np.arange(i % 90))
        w.close()
    r = sstable.Reader(f"file://{path}")
    assert len(r.blocks) > 3 and r.entries == 5000
    assert all(len(r.get(sstable.key_of(3 * i))[0]) == i % 90 for i in range(0, 5000, 37))
    assert sum(r.may_hold(sstable.key_of(3 * i + 1)) for i in range(5000)) < 200
    data = bytearray(path.read_bytes())
    data[-sstable._FOOTER.size - 5] ^= 255
    path.write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        sstable.Reader(f"file://{path}")


# ---- pieces


def test_pieces_are_the_librarys():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=SPM), pieces.Pieces(SPM)
    r = random.Random(3)
    names = list(own.ids)
    texts = ["".join(r.choice(names) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    texts += ["".join(r.choice("abcdehilnorstu  \nÉé.,東▁0119") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["", " ", "▁", "the" * 3000, "a" * 5000, "日本語" * 500, "".join(r.choice("etaoin") for _ in range(8000))]
    for t in texts:
        ids = own.encode(t)
        assert ids.tolist() == lib.encode(t)
        assert own.decode(ids).decode()[1:] == t.replace("▁", " ")


def test_streaming_commits_early(monkeypatch):
    own, lib, seen = pieces.Pieces(SPM), sentencepiece.SentencePieceProcessor(model_file=SPM), []
    r = random.Random(8)
    own.search(" " + "".join(r.choice("etaoinshr") for _ in range(20_000)), lambda ids: seen.append(len(ids)))
    assert len(seen) > 50 and max(seen) < 400
    monkeypatch.setattr(pieces, "SLICE", 50)
    texts = ["".join(r.choice("etaoin  日,\n") for _ in range(r.randint(0, 3000))) for _ in range(60)] + [" " * 500, "x" * 500, "a  b " * 300]
    for t in texts:
        parts = list(own.blocks(t))
        assert "".join(p for p, _ in parts) == (" " + t if t else "") and own.encode(t).tolist() == lib.encode(t)
        assert max((len(p) for p, _ in parts), default=0) <= 50 + max(map(len, re.split("(?<=[^ ])(?= )", " " + t)))


def test_models_of_more_pieces_have_wider_ids():
    own = pieces.Pieces(SPM)
    own.code, own.dtype, own.memo = "I", np.dtype("I"), {}
    assert own.encode("hello world").dtype == np.uint32


def test_round_trip_table(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "a b\tc", "k"), (3, "a b\tc", "k"), (None, "x" * 50_000, "k")], "doc_id long, text string, same string")
    rows = pieces.round_trip(df, SPM).collect()
    assert all(x.same for x in rows) and len(rows) == 5
    back = pieces.decoded(pieces.encoded(df, SPM), SPM)
    assert {(x.doc_id, x.text) for x in back.collect()} == {(1, ""), (2, ""), (3, "a b\tc"), (None, "x" * 50_000)}
    assert pieces.round_trip(df.limit(0), SPM).count() == 0


# ---- HTML

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1><p>tagline here.</p></header>
<div id="cookie-consent">We use cookies on this site. Accept?</div><div class="container"><div class="sidebar"><p>About this blog, a longer text that reads well.</p></div>
<div class="post-content"><h2>Title here</h2><p>First para &amp; more&nbsp;&#233;.<br>Line<p>unclosed <b>bold</b>er
text</p><script>var a = "<p>no</p>";</script><div class="ad">Buy this now. It is good.</div><ul><li>one</li><li>two <a href=x>link</a></li></ul>
<!-- <p>comment</p> --><aside><p>Related stuff.</p></aside><p>Short</p></div>
<section id="comments"><article class="comment"><p>Great post, I really liked reading it a lot!</p></article></section>
<form><label>Name</label><input><button>Go</button></form></div><nav><a href=a>Home</a></nav><footer>foo. bar.</footer>"""
TEXT = "Title here\nFirst para & more é. Line\nunclosed bolder text\none\ntwo link\nShort"


def test_main_text_of_a_page():
    weights = html_text.train()
    assert html_text.extract(PAGE, weights) == TEXT
    assert html_text.extract(None, weights) == html_text.extract("", weights) == ""
    assert html_text.extract("< <<p", weights) is not None


def test_main_text_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "<article>" + "<p>word here.</p>" * 3000, 5)], "page_id long, url string, html string, n_chars int")
    rows = sorted(html_text.main_text(df).collect(), key=lambda x: x.page_id)
    assert [x.text for x in rows[:3]] == [TEXT, TEXT, ""] and rows[0].n_chars == len(TEXT)
    assert rows[3].text == "\n".join(["word here."] * 3000)
    assert html_text.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(150))
def test_cut_is_minimal(seed):
    r = random.Random(seed)
    n = r.randint(1, 9)
    prices = [r.randint(-200, 200) for _ in range(n)]
    joins = [(i - 1, i, r.choice([15, 30, 60, 200])) for i in range(1, n)] + [(a, b, 30) for a, b in [(r.randrange(n), r.randrange(n))] if a != b]

    def cost(keep):
        return sum(p for p, k in zip(prices, keep, strict=True) if p > 0 and not k) + sum(-p for p, k in zip(prices, keep, strict=True) if p < 0 and k) + sum(c for a, b, c in joins if keep[a] != keep[b])

    assert cost(html_text.content_side(prices, joins)) == min(map(cost, itertools.product([False, True], repeat=n)))


# ---- pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    from linekin.llm.common import stored, table

    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "test")
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    assert counts[0] > counts[1] == counts[2] >= counts[3] and counts[4] > 0 and counts[5] == counts[4]
    lib = sentencepiece.SentencePieceProcessor(model_file=SPM)
    mixed = {x.doc_id: x.ids for x in docs.collect()}
    texts = {x.doc_id: x.text for x in table(spark, sf_dir, "documents").collect()}
    whole = [i for i, ids in mixed.items() if ids == lib.encode(texts[i])]
    assert len(whole) > len(mixed) / 2  # those that lost no line
