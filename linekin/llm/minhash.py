"""Near-duplicate documents by HyperMinHash sketches.

A document's set is its distinct 5-word shingles (as 64-bit hashes). A sketch has ``GROUPS`` hash functions of
``BUCKETS`` buckets; a bucket keeps its smallest hash in a compressed register: the count of leading zeros and the first
``MANTISSA`` bits behind them. Documents with equal sets collapse to their smallest id first. ``BANDS`` bands of
``ROWS`` registers, taken from different hash functions, give the bucket keys of a representative; a band that no
shingle reaches gives none.

Candidates. A bucket's hub is the member that shares most bucket places with others; every member is compared with
its hub, which is linear in the bucket however large it is; a hub of many members is sent to several tasks, each with some
of them. Verified links are contracted to components; only buckets that still hold several components are compared
further, in tiles of sketches and texts: a tile's task verifies the pairs of different components that pass the
estimate, joins components as it finds links, and hands on only the links that joined two. No cap: every pair that shares a
bucket ends up in one component or is compared.

Comparison. The share of equal registers, less the expected number of chance collisions of compressed registers,
estimates the Jaccard similarity; a pair that may reach the threshold (``MARGIN`` standard deviations) is verified on the
full shingle sets of both texts, in whole numbers.

Null and empty texts, and texts without words, have an empty set and link with nothing; with fewer than five words
the whole sequence is the one shingle; repeated rows are copies; a repeated id is one node; extra columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linekin.llm.common import mixed, small, stored, text_chunks, word_bounds, word_hashes
from linekin.operators.graph import components

WORDS = 5
#: Similarity of a link: 100 * intersection >= PERCENT * union.
PERCENT = 75
GROUPS, BUCKETS, MANTISSA = 8, 32, 10
REGISTERS = GROUPS * BUCKETS
#: Buckets of the finer sketches that large and tangled buckets are compared by.
FINE = 64
BANDS, ROWS = 25, 5
MARGIN = 3.2
#: Constant of the expected chance collisions of a HyperMinHash sketch, as published.
COLLISIONS = 0.169919487159739093975315012348630288992889
#: Members of a block of a bucket, and their shingles; two blocks are compared in one task.
TILE, TILE_SHINGLES = 512, 1 << 20
#: A hub with more members than this goes to ``SALTS`` tasks.
SPLIT, SALTS = 1024, 32


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts of a chunk, sorted in each text, and the offsets of the texts."""
    n = len(at) - 1
    starts, ends = word_bounds(raw, at)
    codes = word_hashes(raw, starts, ends)
    first = np.searchsorted(starts, at)
    words = np.diff(first)
    count = np.where(words >= WORDS, words - WORDS + 1, (words > 0).astype(np.int64))
    owner = np.repeat(np.arange(n), count)
    begin = np.concatenate([[0], np.cumsum(count)])
    head = first[:-1][owner] + np.arange(begin[-1]) - begin[:-1][owner]
    size = np.minimum(words[owner], WORDS)
    total = np.zeros(len(head), np.uint64)
    for k in range(WORDS):
        have = size > k
        part = codes[np.where(have, head + k, 0)] if len(codes) else np.zeros(0, np.uint64)
        total = np.where(have, total * np.uint64(0x9FB21C651E98DF25) + part + np.uint64(k + 1), total)
    total = mixed(total, 11)
    out = np.empty_like(total)
    keep = np.ones(len(total), bool)
    for i in range(n):
        a, b = begin[i], begin[i + 1]
        out[a:b] = np.sort(total[a:b])
        if b - a > 1:
            keep[a + 1 : b] = out[a + 1 : b] != out[a : b - 1]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[begin]


def _leading_zeros(v: np.ndarray) -> np.ndarray:
    """Leading zeros of 64-bit values; the values are never 0."""
    n = np.zeros(len(v), np.int64)
    v = v.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = v < (np.uint64(1) << np.uint64(64 - step))
        n += low * step
        v = np.where(low, v << np.uint64(step), v)
    return n


def sketches(values: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """16-bit registers (leading zeros and mantissa, plus one; 0: no shingle) of each set."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    registers = GROUPS * buckets
    lows = np.full(n * registers, np.iinfo(np.uint64).max, np.uint64)
    bits = np.uint64(buckets.bit_length() - 1)
    for g in range(GROUPS):
        h = mixed(values, 101 + g)
        place = owner * registers + g * buckets + (h >> (np.uint64(64) - bits)).astype(np.int64)
        np.minimum.at(lows, place, (h << bits) | np.uint64(8))
    found = lows != np.iinfo(np.uint64).max
    v = lows[found]
    zeros = np.minimum(_leading_zeros(v), 62)
    mantissa = (v << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out = np.zeros(len(lows), np.uint16)
    out[found] = (zeros << MANTISSA).astype(np.uint16) + mantissa.astype(np.uint16) + np.uint16(1)
    return out.reshape(n, registers)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A key for each band, 0 where no register of the band is filled; its registers lie in different hash functions."""
    rows = registers[:, 2 * (np.arange(BANDS)[:, None] + BANDS * np.arange(ROWS))].astype(np.uint64)
    total = np.full(rows.shape[:2], 0, np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        total = mixed(total * np.uint64(65599) + rows[:, :, k], 3)
    return np.where(rows.any(2), total | np.uint64(1), np.uint64(0))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers and their standard deviation at the threshold."""
    either = ((a > 0) | (b > 0)).sum(-1)
    equal = ((a == b) & (a > 0)).sum(-1)
    ratio = np.maximum(na, nb) / np.maximum(np.minimum(na, nb), 1)
    chance = COLLISIONS * a.shape[-1] / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2
    either = np.maximum(either, 1)
    return np.maximum(equal - chance, 0) / either, np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / either)


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    guess, sigma = estimate(a, b, na, nb)
    sizes = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
    return sizes & (guess + MARGIN * sigma + 1e-9 >= PERCENT / 100)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, registers, bands): k1 and k2 are two sums over the set that stand for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, at in text_chunks(batch.column(1)):
                n = len(at) - 1
                values, bounds = shingles(raw, at)
                registers = sketches(values, bounds)
                sums = []
                for seed in (21, 22):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(values, seed), dtype=np.uint64)])
                    sums.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)))
                keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(registers).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                packed = pa.array([r.tobytes() for r in registers], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(bounds)), *sums, packed, keys], names=["doc_id", "n_shingles", "k1", "k2", "registers", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, k1 long, k2 long, registers binary, bands array<long>")


def _registers(column: pa.Array, count: int = REGISTERS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, count)


def _estimated(pairs: DataFrame) -> DataFrame:
    """The (a, b) pairs whose sketches may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, na, nb, ra, rb = batch.columns
                keep = may_reach(_registers(ra), _registers(rb), na.to_numpy(), nb.to_numpy())
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _met(pairs: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(a, b) pairs with columns of both from ``table`` (rep, ...), named like {column: prefix}; b is a hub.

    Members are joined by their own id. The hubs of more than ``SPLIT`` pairs are repeated ``SALTS`` times, and their pairs dealt
    among the copies, so no task holds all members of a hub.
    """
    one = lambda c: table.select(F.col("rep").alias(c), *[F.col(k).alias(f"{v}{c}") for k, v in columns.items()])
    hot = stored(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select(F.col("b").alias("hot")), "hot-hubs")
    salted = pairs.withColumn("salt", F.lit(0))
    hubs = one("b").withColumn("salt", F.lit(0))
    if not hot.isEmpty():
        few = small(hot)
        dealt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).otherwise(0)
        salted = pairs.join(few, F.col("b") == F.col("hot"), "left").withColumn("salt", dealt).drop("hot")
        copies = F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        hubs = one("b").join(few, F.col("b") == F.col("hot"), "left").withColumn("salt", F.explode(copies)).drop("hot")
    return salted.join(one("a"), "a").join(hubs, ["b", "salt"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that reach the threshold on the full sets of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sets = []
                for c in (2, 3):
                    own: list[np.ndarray] = []
                    for _, raw, at in text_chunks(part.column(c)):
                        values, bounds = shingles(raw, at)
                        own += [values[bounds[i] : bounds[i + 1]] for i in range(len(at) - 1)]
                    sets.append(own)
                for i, (x, y) in enumerate(zip(*sets, strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k + i] = both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return _met(pairs, texts, {"text": "t"}).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _tiled(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between different components of a bucket's members, enough to join all components that are linked there.

    Two blocks of a bucket meet in one task. Of the buckets that a pair shares, the one with the least key compares it.
    """
    # Blocks are dealt on ids; sketches and texts come to the tiles by the members' own ids.
    members = stored(members.join(texts.select("rep", "n_shingles"), "rep").select("key", "rep", "component", "n_shingles"), "tile-members")
    sums = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"))
    blocks = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("m") / TILE_SHINGLES)).cast("int")
    sums = small(stored(sums.select("key", blocks.alias("blocks")), "tile-blocks"))
    rows = members.drop("n_shingles").join(sums, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component")
    rows = rows.join(texts, "rep").select("key", "i", "j", "block", "rep", "component", "n_shingles", "fine", "bands", "text")

    def run(t: pa.Table) -> pa.Table:
        block, rep, comp, size = (t.column(c).to_numpy() for c in ("block", "rep", "component", "n_shingles"))
        regs = _registers(t.column("fine"), GROUPS * FINE)
        keys = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rep), BANDS)
        key, i, j = (t.column(c)[0].as_py() for c in ("key", "i", "j"))
        texts = t.column("text")
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sets: dict[int, np.ndarray] = {}
        parent: dict[int, int] = {}

        def own(x: int) -> np.ndarray:
            if x not in sets:
                raw = np.frombuffer(texts[x].as_py().encode(), np.uint8)
                sets[x] = shingles(raw, np.array([0, len(raw)]))[0]
            return sets[x]

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        out: list[tuple[int, int]] = []
        for x in left.tolist():
            some = right[(comp[right] != comp[x]) & ((rep[right] > rep[x]) | (i != j))]
            if len(some):
                shared = (keys[some] == keys[x]) & (keys[x] != 0) & (keys[x] < key)
                some = some[~shared.any(1)]
            if len(some):
                some = some[may_reach(regs[x][None], regs[some], size[x], size[some])]
            for y in some.tolist():
                a, b = root(comp[x]), root(comp[y])
                if a == b:
                    continue
                both = len(np.intersect1d(own(x), own(y), assume_unique=True))
                if both and 100 * both >= PERCENT * (size[x] + size[y] - both):
                    parent[max(a, b)] = min(a, b)
                    out.append((rep[x], rep[y]))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``; ``doc_id`` is a whole number."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(sketched(docs), "sketches")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    # Copies: one representative for each set.
    reps = stored(full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers"), F.first("bands").alias("bands")), "sets")
    places = reps.select("rep", F.explode("bands").alias("key")).where("key <> 0")
    # A bucket is its key, size and an order-free signature of its members; buckets with equal members count once.
    buckets = places.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1))).alias("sign"), F.min("rep").alias("least")).where("n > 1")
    buckets = buckets.groupBy("n", "sign", "least").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("bands"))
    members = stored(places.join(buckets.select("key", "n", "bands"), "key"), "members")
    weight = members.groupBy("rep").agg(F.sum(F.col("n") * F.col("bands")).alias("weight"))
    weighed = members.join(weight, "rep")
    hub = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("top")).select("key", (-F.col("top.rep")).alias("hub"))
    first = stored(members.join(hub, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "hub-pairs")
    first = stored(_estimated(_met(first, reps, {"n_shingles": "n", "registers": "r"})), "pairs")
    involved = members.select("rep").distinct()
    texts = stored(_texts(docs, involved), "texts")
    links = stored(_verified(first, texts), "verified")
    known = stored(components(links), "known")
    # What the hubs left: members of one bucket in different components.
    labelled = members.join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ = labelled.drop("bands").join(split, "key").where("n > 2").select("key", "rep", "component")
    links = links.union(stored(_tiled(open_, texts), "tile-links"))
    top = components(links)
    by_set = reps.select("k1", "k2", "n_shingles", "rep").join(top.withColumnRenamed("node", "rep"), "rep", "left")
    by_set = by_set.select("k1", "k2", F.col("n_shingles").alias("_n"), F.coalesce("component", "rep").alias("_component"))
    out = rows.select("doc_id", "n_shingles", "k1", "k2").join(by_set, ["k1", "k2"], "left").where("_n is null or _n = n_shingles")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("_component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: Ids that may be sent to every task, by count.
FEW = 200_000


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, text, n_shingles, fine sketch, bands) of the wanted ids. Up to ``FEW`` ids go to every task, more are joined by a shuffle."""
    ids = stored(ids, "wanted")
    wanted = ids.withColumnRenamed("rep", "doc_id")
    wanted = small(wanted, FEW)
    # Copies of a row count once; an id with several texts keeps them all, and links by any.
    found = docs.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text", F.xxhash64("text").alias("h"))
    found = found.dropDuplicates(["rep", "h"]).select("rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, at in text_chunks(batch.column(1)):
                values, bounds = shingles(raw, at)
                fine = pa.array([r.tobytes() for r in sketches(values, bounds, FINE)], pa.binary())
                keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(sketches(values, bounds)).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                part = batch.slice(first, len(at) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(bounds)), fine, keys], names=["rep", "text", "n_shingles", "fine", "bands"])

    return found.mapInArrow(run, "rep long, text string, n_shingles long, fine binary, bands array<long>")
