"""Token ids of texts that hold an added token, against the library as it opens the vocabulary."""

from __future__ import annotations

import json
import random

import public_tokenizers
from tokenizers import Tokenizer

from linekin.llm.bpe import Encoder

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_are_the_librarys_ids():
    own, lib = Encoder(BPE), Tokenizer.from_file(BPE)
    assert own.encode(["x <|endoftext|> y"])[0].tolist() == [87, 220, 50256, 331]
    r = random.Random(6)
    parts = ["the", " ", "  ", "\n", "'s", " and", "é", "日", "12", "<|endoftext|>", "<|endof", "text|>", "|", "<", ">"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(2000)] + ["", "<|endoftext|>", "<|endoftext|>" * 3]
    for a, b in zip(own.encode(texts), lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert a.tolist() == b.ids


def test_files_that_cut_another_way_go_to_the_library(tmp_path):
    file = json.loads(Tokenizer.from_file(BPE).to_str())
    texts = ["hello world, it's 12  o'clock", " a", "", "x\n\ny"]
    changes = [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}]
    for i, change in enumerate(changes):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(file | change))
        own, lib = Encoder(str(path)), Tokenizer.from_file(str(path))
        assert [x.tolist() for x in own.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_worker_that_waits_keeps_one_generation_of_stretches(spark):
    """The pipeline's first stage shares executors with workers that the last stage of the run before has left."""
    import public_tokenizers

    from linekin.llm import pieces as P

    assert 2 * P.REMEMBERED <= 500_000
    model = P.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    before = model.encode("moon river stone").tolist()
    model.old, model.pairs[1] = {"x": b""}, True
    model.rest()
    assert not model.old and not model.pairs and model.encode("moon river stone").tolist() == before
