"""Token ids in sorted-string-table shards: one file a range of document ids, for look-up by binary search.

A file holds, one after the other:

- data blocks: entries in key order, each ``varint shared | varint rest | varint value bytes | rest of key | value``, where
  ``shared`` bytes are those of the key before it (0 at every ``RESTART``-th entry); a block ends with the little-endian
  32-bit places of its restarts and their number, and is compressed with zstandard
- the sparse index: for each block ``varint key bytes | last key | varint place | varint bytes``
- a Bloom filter over the keys: ``BLOOM_BITS`` bits a key, ``BLOOM_HASHES`` hashes
- a footer of fixed size: places and sizes of index and filter, numbers of entries and ids, bytes of an id, the CRC-32
  of index and filter, a magic number

Keys are ids as eight big-endian bytes with the sign turned, so byte order is number order; a null id is the empty key. An
id that occurs again is another entry beside it. Values are the ids of one document, two bytes each where the
vocabulary allows.

Documents are dealt by ranges of their id before they are encoded, so only ids are sampled; a task streams its
range into one file, block by block, under a name of its own attempt, and renames it when it is complete: a task that
runs again writes the same file. Files go where driver and executors both reach, through ``pyarrow.fs``.

Null texts count as empty and have the end id only; texts are encoded whole; extra columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linekin.llm.bpe import Encoder, encoder
from linekin.llm.common import new_path, stored

BLOCK_BYTES, RESTART = 64 << 10, 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"SSTTOK01"
_FOOTER = struct.Struct("<QQQQQQBI8s")
END_ID = 2
GROUP_CHARS = 2_000_000


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


def open_fs(path: str):  # noqa: ANN201
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """Streams entries in key order into an open file."""

    def __init__(self, out, width: int) -> None:  # noqa: ANN001
        self.out, self.width = out, width
        self.place = self.entries = self.ids = 0
        self.index, self.hashes = bytearray(), bytearray()
        self.pack = zstandard.ZstdCompressor(level=1)
        self._open()
        self.last = b""

    def _open(self) -> None:
        self.block, self.restarts, self.held = bytearray(), [], 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype(f"<u{self.width}").tobytes()
        shared = 0
        if self.held % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.held += 1
        self.entries += 1
        self.ids += len(ids)
        self.hashes += xxhash.xxh3_128_digest(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        tail = struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        data = self.pack.compress(bytes(self.block) + tail)
        self.index += _varint(len(self.last)) + self.last + _varint(self.place) + _varint(len(data))
        self.out.write(data)
        self.place += len(data)
        self._open()

    def close(self) -> None:
        self._flush()
        bits = max(64, self.entries * BLOOM_BITS)
        filter_ = np.zeros(-(-bits // 8), np.uint8)
        both = np.frombuffer(bytes(self.hashes), ">u8").reshape(-1, 2)  # high half first
        a, b = both[:, 1].astype(object), (both[:, 0] | np.uint64(1)).astype(object)
        for i in range(BLOOM_HASHES):
            at = ((a + i * b) % bits).astype(np.int64) if len(a) else np.zeros(0, np.int64)
            np.bitwise_or.at(filter_, at >> 3, (1 << (at & 7)).astype(np.uint8))
        index, bloom = bytes(self.index), filter_.tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(_FOOTER.pack(self.place, len(index), self.place + len(index), len(bloom), self.entries, self.ids, self.width, zlib.crc32(index + bloom), MAGIC))


class Reader:
    """A shard: ``get`` by key through filter, index and one block; ``scan`` of all entries in order."""

    def __init__(self, path: str) -> None:
        files, name = open_fs(path)
        self.file = files.open_input_file(name)
        size = self.file.size()
        if size < _FOOTER.size:
            raise ValueError(f"{path}: too short")
        foot = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        at, n, bloom_at, bloom_n, self.entries, self.ids, self.width, crc, magic = foot
        if magic != MAGIC:
            raise ValueError(f"{path}: not a shard")
        index, self.bloom = self.file.read_at(n, at), self.file.read_at(bloom_n, bloom_at)
        if zlib.crc32(index + self.bloom) != crc:
            raise ValueError(f"{path}: index or filter is damaged")
        self.keys: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        k = 0
        while k < n:
            length, k = _read_varint(index, k)
            self.keys.append(index[k : k + length])
            place, k = _read_varint(index, k + length)
            length, k = _read_varint(index, k)
            self.blocks.append((place, length))
        self.unpack = zstandard.ZstdDecompressor()

    def may_hold(self, key: bytes) -> bool:
        bits = max(64, self.entries * BLOOM_BITS)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits))

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        place, length = self.blocks[k]
        data = self.unpack.decompress(self.file.read_at(length, place))
        count = struct.unpack_from("<I", data, len(data) - 4)[0]
        end = len(data) - 4 - 4 * count
        return data[:end], list(struct.unpack_from(f"<{count}I", data, end))

    def _entries(self, data: bytes, at: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def get(self, key: bytes) -> list[np.ndarray]:
        """The values of all entries with a key."""
        out: list[np.ndarray] = []
        if not self.entries or not self.may_hold(key):
            return out
        k = bisect_left(self.keys, key)
        while k < len(self.blocks):
            data, restarts = self._block(k)
            lo, hi = 0, len(restarts)  # the last restart whose key is below the wanted one
            while hi - lo > 1:
                mid = (lo + hi) // 2
                if next(self._entries(data, restarts[mid]))[0] < key:
                    lo = mid
                else:
                    hi = mid
            for found, ids in self._entries(data, restarts[lo]):
                if found == key:
                    out.append(ids)
                elif found > key:
                    return out
            k += 1
        return out

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self._entries(self._block(k)[0], 0)


def encoded(coder: Encoder, texts: list[str]) -> Iterator[np.ndarray]:
    """Ids of the texts, encoded in groups of about ``GROUP_CHARS`` characters: a longer text is a group of its own."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > GROUP_CHARS:
            yield from coder.encode(group)
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield from coder.encode(group)


def written(docs: DataFrame, path: str) -> DataFrame:
    """Encodes the documents with the tokenizer at ``path``, writes the shards and returns their list:
    (shard, file, first_id, last_id, n_docs, n_ids), after the files are complete."""
    folder = new_path(docs.sparkSession, "shards")
    if folder.startswith("/"):
        folder = f"file://{folder}"
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = f"file://{folder[5:]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        task = TaskContext.get()
        shard = task.partitionId()
        files, top = open_fs(folder)
        files.create_dir(top, recursive=True)
        # Each attempt writes a file of its own; the list of shards, which holds those of the attempts that counted, is what readers open.
        own = f"shard-{shard:06d}-{task.taskAttemptId()}.sst"
        first = last = None
        with files.open_output_stream(f"{top}/{own}") as out:
            writer = Writer(out, coder.width)
            for batch in batches:
                names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for name, ids in zip(names, encoded(coder, texts), strict=True):
                    if not writer.entries:
                        first = name
                    last = name
                    writer.add(key_of(name), np.append(ids, np.uint32(END_ID)))
            writer.close()
        if not writer.entries:
            files.delete_file(f"{top}/{own}")
            return
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [f"{folder}/{own}"], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64()), "n_docs": pa.array([writer.entries], pa.int64()), "n_ids": pa.array([writer.ids], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The text orders rows that share an id, so a second run writes the same files.
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(rows.mapInArrow(run, "shard int, file string, first_id long, last_id long, n_docs long, n_ids long"), "shard-list")


def read_back(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry, from the files; ``start`` counts the ids of all entries before it."""
    # One row a file: the running sum is over the list of files.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("file", "n_docs", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, count, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, starts, sizes, sums = [], [], [], []
                seen = 0
                for key, ids in Reader(file).scan():
                    names.append(id_of(key))
                    starts.append(start)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    start += len(ids)
                    seen += 1
                    if len(names) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (names, starts, sizes, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        names, starts, sizes, sums = [], [], [], []
                if seen != count:
                    raise ValueError(f"{file}: {seen} entries of {count}")
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (names, starts, sizes, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    count = max(1, shards.count())
    return placed.repartition(count, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
