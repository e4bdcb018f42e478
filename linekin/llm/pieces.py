"""SentencePiece encoding and decoding: a streaming Viterbi over the pieces of a given model.

The model is a BPE one, whose encoding is not the best sum of scores but the result of merging neighbours by rank. A
sequence of pieces is that result exactly if each pair of neighbours is (merging the pair's own characters never
crosses its boundary), so the search keeps, for each place in the text, the one last piece whose step from an earlier place
is allowed: survivors and backpointers as in Viterbi decoding, with a step that is allowed or not in place of a score.

Streaming: a place only depends on those up to the longest piece before it. Whenever the backpointer paths of all places
in that window meet in one boundary, the ids before it are final and are handed on; what is kept is the window and
the ids since the last boundary, whatever the text's length. Pieces never hold a space after another character, so all paths
meet before such a space: the search hands on what it has and starts there again with an empty window. Characters that the model
lacks are byte pieces and end the window too.

A long text is worked on in slices of about ``SLICE`` characters that begin at such a space, so memory is bounded by the
slice and, within one stretch without spaces, by the window. What the search found for short stretches is remembered
up to a bound, so that frequent words are searched once a worker.

Null and empty texts have no ids; decoding gives the text back, with U+2581 as a space (the model writes both alike);
repeated rows each give a row; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Remembered stretches of one generation (the one before is kept beside it), and their longest; remembered pairs, at most.
REMEMBERED, SHORT, PAIRS = 250_000, 40, 250_000
#: Characters of a slice of a text, about.
SLICE = 1 << 16
#: Places between two looks for a common boundary.
LOOK = 64
_UNIT = re.compile(r" +[^ ]*")
_BOUNDARY = re.compile(r"(?<=[^ ]) ")


class Pieces:
    """The model's pieces, the allowed pairs and the search."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        self.ids = {names[i].replace(SPACE, " "): i for i in range(n) if plain[i]}
        self.texts = {i: t for t, i in self.ids.items()}
        # Merges run from the highest score; characters are merged from nothing and come before all.
        order = sorted((i for i in self.texts if len(self.texts[i]) > 1), key=lambda i: -model.get_score(i))
        self.rank = dict.fromkeys(self.texts, -1) | {i: k for k, i in enumerate(order)}
        self.longest = max(map(len, self.ids))
        self.bytes_ = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        written = [names[i].replace(SPACE, " ").encode() if plain[i] else b"" for i in range(n)]
        for b, i in enumerate(self.bytes_):
            written[i] = bytes([b])
        self.blob = np.frombuffer(b"".join(written), np.uint8)
        self.lengths = np.array([len(w) for w in written])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.code = "H" if n <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.trie: dict = {}
        for text, i in self.ids.items():
            node = self.trie
            for c in text:
                node = node.setdefault(c, {})
            node[0] = i
        self.sizes = {i: len(t) for i, t in self.texts.items()}
        self.known = re.compile("[" + "".join(re.escape(c) for c in self.trie) + "]*")
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def rest(self) -> None:
        """Between tasks: gives back what may be large, as a worker that waits keeps its memory beside the workers of other queries."""
        self.old = {}
        self.pairs.clear()

    def split(self, piece: int) -> tuple[int, int] | None:
        """The two pieces of the last merge that makes a piece; None for a character, or if merging never makes it."""
        if piece not in self.splits:
            parts = list(self.texts[piece])
            found = None
            while len(parts) > 1:
                ranks = [self.rank.get(self.ids.get(a + b, -1), 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
                k = ranks.index(min(ranks))
                if ranks[k] == 1 << 30:
                    break
                found = (self.ids[parts[k]], self.ids[parts[k + 1]]) if len(parts) == 2 else None
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.splits[piece] = found if len(parts) == 1 else None
        return self.splits[piece]

    def whole(self, piece: int) -> bool:
        """Whether merging a piece's characters gives that piece."""
        return len(self.texts[piece]) == 1 or self.split(piece) is not None

    def allowed(self, left: int, right: int) -> bool:
        """Whether no merge crosses the boundary: merges are undone from the last to the first, looking across each time.

        ``limit`` is the rank of the merge that was undone last: only an earlier merge across the boundary would have come
        before it (of equal ranks the left one comes first).
        """
        if not (self.whole(left) and self.whole(right)):
            return False
        rank, ids, texts = self.rank, self.ids, self.texts
        limit = (1 << 30, 0)
        while True:
            joined = ids.get(texts[left] + texts[right])
            if joined is not None and (rank[joined], 1) < limit:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                limit = (rank[left], 0)
                left = self.split(left)[1]
            else:
                limit = (rank[right], 2)
                right = self.split(right)[0]

    def search(self, text: str, hand_on) -> None:  # noqa: ANN001
        """Streams the ids of a stretch whose characters are all pieces; ``hand_on`` gets lists of final ids.

        ``last`` holds, for the places of the window from ``base`` on, the piece that ends there (-1: none yet).
        """
        n, longest, trie, pairs = len(text), self.longest, self.trie, self.pairs
        base, last = 0, [-1] * (min(n, LOOK + 2 * longest) + 1)
        for at in range(n):
            i = at - base
            if i >= LOOK + longest and at % LOOK == 0:
                base = self._commit(last, base, at, hand_on)
                i = at - base
            if i + longest >= len(last) and base + len(last) <= n:
                last.extend([-1] * (min(n - base + 1, i + longest + LOOK + 1) - len(last)))
            own = last[i]
            shifted = own << 20
            node, to = trie, i
            for c in text[at : at + longest]:
                node = node.get(c)
                if node is None:
                    break
                to += 1
                if last[to] < 0 and 0 in node:
                    piece = node[0]
                    if at:
                        good = pairs.get(shifted | piece)
                        if good is None:
                            good = pairs[shifted | piece] = self.allowed(own, piece)
                    else:
                        good = self.whole(piece)
                    if good:
                        last[to] = piece
        path, size = [], self.sizes
        i = n - base
        while i:
            piece = last[i]
            path.append(piece)
            i -= size[piece]
        path.reverse()
        hand_on(path)

    def _commit(self, last: list[int], base: int, at: int, hand_on) -> int:  # noqa: ANN001
        """Hands on the ids up to the boundary in which all paths of the window meet, if they do; the new base.

        Later places step from ``at`` or after it, or are already known ones, whose paths count too.
        """
        size = self.sizes
        heads = {k for k in range(at - base, len(last)) if last[k] >= 0}
        while len(heads) > 1:
            far = max(heads)
            heads.remove(far)
            far -= size[last[far]]
            if far <= 0:
                return base
            heads.add(far)
        meet = heads.pop()
        path, k = [], meet
        while k > 0:
            path.append(last[k])
            k -= size[last[k]]
        hand_on(path[::-1])
        del last[:meet]
        return base + meet

    def encode_unit(self, unit: str) -> bytes:
        """The ids of a stretch of spaces with what follows, packed."""
        out: list[bytes] = []

        def hand_on(ids: list[int]) -> None:
            out.append(array(self.code, ids).tobytes())

        if self.known.fullmatch(unit):
            self.search(unit, hand_on)
            return b"".join(out)
        known, start = self.trie, 0
        for k, c in enumerate(unit):
            if c not in known:
                if k > start:
                    self.search(unit[start:k], hand_on)
                hand_on([self.bytes_[b] for b in c.encode("utf-8", "surrogatepass")])
                start = k + 1
        if start < len(unit):
            self.search(unit[start:], hand_on)
        return b"".join(out)

    def blocks(self, text: str) -> Iterator[tuple[str, np.ndarray]]:
        """Slices of a text, each from a boundary to the next one after ``SLICE`` characters, with their ids.

        The first slice has the space that stands before every text.
        """
        if not text:
            return
        text = " " + text.replace(SPACE, " ")
        at, n = 0, len(text)
        while at < n:
            cut = _BOUNDARY.search(text, at + SLICE) if at + SLICE < n else None
            end = cut.start() if cut else n
            part = text[at:end] if at or cut else text
            yield part, self._slice(_UNIT.findall(part))
            at = end

    def _slice(self, units: list[str]) -> np.ndarray:
        memo = self.memo
        try:
            return np.frombuffer(b"".join(map(memo.__getitem__, units)), self.dtype)
        except KeyError:
            pass
        if len(memo) > REMEMBERED:
            self.old, self.memo = memo, {}
            memo = self.memo
        old = self.old
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        out = []
        for unit in units:
            ids = memo.get(unit)
            if ids is None:
                ids = old.get(unit)
                if ids is None:
                    ids = self.encode_unit(unit)
                if len(unit) <= SHORT:
                    memo[unit] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), self.dtype)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        found = [ids for _, ids in self.blocks(text)]
        return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, self.dtype), *found])

    def decode(self, ids: np.ndarray) -> bytes:
        """The utf-8 text of ids, with the space that stands before every text."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(self.starts[ids] - (ends - size), size) + np.arange(total)
        return self.blob[place].tobytes()


_OPEN: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model at a path, opened once in a process. Vocabulary files are installed on every machine."""
    if path not in _OPEN:
        _OPEN[path] = Pieces(path)
    return _OPEN[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row; ids are the model's, without begin or end ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = [model.encode(t or "") for t in part.column(1).to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                flat = np.concatenate(rows).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["doc_id", "ids"])
        model.rest()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) rows; byte pieces that are no utf-8 become U+FFFD."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [model.decode(flat[at[i] : at[i + 1]])[1:].decode("utf-8", "replace") for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, n_chars, same): each text encoded and decoded again in one pass.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers, ``same`` whether decoding gives the text back.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                columns: list[list] = [[], [], [], []]
                for t in part.column(1).to_pylist():
                    tokens = crc = chars = 0
                    same = True
                    for written, ids in model.blocks(t or ""):
                        back = model.decode(ids)
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        tokens += len(ids)
                        chars += len(back.decode("utf-8", "replace"))
                        same = same and back == written.encode()
                    for column, value in zip(columns, (tokens, crc, max(chars - 1, 0), same), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "n_chars", "same"])
        model.rest()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, n_chars long, same boolean")
