"""Byte-level BPE by the tokenizers library, with the encodings of word pieces remembered.

The library's own pre-tokenizer cuts a text by a fixed pattern and encodes each cut on its own, so ids of a cut do not
depend on its neighbours. Cuts of plain Latin text are made here by the same pattern and looked up; a cut that is not known
yet goes to the library. Texts with other characters, whose classes may differ between two pattern engines, and texts that
hold an added token, which the library finds before it cuts, go to the library whole. So do all texts where the vocabulary
file names another normalizer, another way to cut, truncation or padding.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

#: Fixed value: the pattern that the byte-level pre-tokenizer cuts by; L, N and S stand for letters, numbers, white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"""
#: Characters for which pattern engines agree on letters, numbers and white space.
PLAIN = r"[\x09-\x0D\x20-\x7E\xA1-\xAC\xAE-ɏ]*"


def pattern() -> str:
    """The pattern with the classes of plain characters written out."""
    plain = [chr(c) for c in range(0x250)]
    kinds = {k: [c for c in plain if unicodedata.category(c)[0] == k] for k in "LN"} | {"S": list("\t\n\v\f\r ")}
    return PATTERN.format(**{k: "".join(f"\\u{ord(c):04x}" for c in chars) for k, chars in kinds.items()})


#: Cuts of one generation of the memory (the one before is kept beside it), and the longest.
REMEMBERED, SHORT = 900_000, 40


def known(file: dict) -> bool:
    """Whether a vocabulary file cuts texts by the pattern above and encodes each cut on its own."""
    cut, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    by_pattern = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    plain = file.get("normalizer") is None and file.get("truncation") is None and file.get("padding") is None
    return bool(by_pattern and plain and model.get("type") == "BPE" and not model.get("dropout"))


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)").search
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.cuts = re.compile(pattern()).findall
        self.plain = re.compile(PLAIN if known(json.loads(self.model.to_str())) else r"(?!)").fullmatch
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.kind = np.dtype(f"<u{self.width}")

    def _learn(self, cuts: list[str]) -> None:
        """Encodes cuts by the library. A space and letters are cut alike when they stand in a row, which is quicker."""
        worded = [c for c in cuts if c[0] == " " and c[1:2].isalpha()]
        rest = [c for c in cuts if not (c[0] == " " and c[1:2].isalpha())]
        for some, joined in [(worded[k : k + 4000], True) for k in range(0, len(worded), 4000)] + [(rest[k : k + 4000], False) for k in range(0, len(rest), 4000)]:
            joined = joined and not self.added("".join(some))
            found = self.model.encode("".join(some) if joined else some, is_pretokenized=not joined, add_special_tokens=False)
            words = np.array(found.word_ids)
            if words[-1] + 1 != len(some):
                raise ValueError("the library cuts this text another way")
            data, start = np.array(found.ids, self.kind).tobytes(), 0
            ends = (np.searchsorted(words, np.arange(len(some)), "right") * self.width).tolist()
            for cut, end in zip(some, ends, strict=True):
                self.memo[cut] = data[start:end]
                start = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without added ids."""
        out: list[np.ndarray | None] = [None] * len(texts)
        rest: list[int] = []
        if len(self.memo) > REMEMBERED:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        cut: dict[int, list[str]] = {}
        every: set[str] = set()
        for i, text in enumerate(texts):
            if not self.plain(text) or self.added(text):
                rest.append(i)
                continue
            cut[i] = own = self.cuts(text)
            every.update(own)
        # The cuts of these texts in a dictionary of their own: it is small, so its look-ups stay in the CPU's cache.
        near = {c: memo.get(c) for c in every}
        new = [c for c, ids in near.items() if ids is None]
        near.update((c, memo.setdefault(c, old[c])) for c in new if c in old)
        new = [c for c in new if near[c] is None]
        self._learn(new)
        near.update((c, memo[c]) for c in new)
        for i, own in cut.items():
            out[i] = np.frombuffer(b"".join(map(near.__getitem__, own)), self.kind)
        for c in new:
            if len(c) > SHORT:
                del memo[c]
        if rest:
            for i, found in zip(rest, self.model.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = np.array(found.ids, self.kind)
        return out  # type: ignore[return-value]


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The tokenizer at a path, opened once in a process. Vocabulary files are installed on every machine."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
