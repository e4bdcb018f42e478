"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics are counts over the whole text (kinds of characters, word lengths, lines, sentences, repeated words), put in
ratios. ``FEATURES`` cosines of random projections approximate a Gaussian kernel over the standardised statistics.
The labelled rows' normal equations are summed inside each partition, the sums of the few partitions of the bounded
sample are added on the driver and solved with a ridge, and pool-adjacent-violators over out-of-fold scores turns a
ridge score into a probability.

``SAMPLE`` bounds the labelled documents that the fit reads (by a hash of the id, so the same ones each time); every
document is scored. Null texts count as empty; labels with a null id or quality are left out; each distinct label of a
document counts once, and of rows that repeat a document's id one is read; no usable label at all gives every document the
score 0.5, and n labels of one class alone give all documents (n y + 0.5) / (n + 1). Repeated rows each give a row; extra
columns are not read by ``scored`` and carried by ``kept_documents``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linekin.llm.common import stored, text_chunks, word_bounds, word_hashes

#: Most labelled documents that the fit reads, about.
SAMPLE = 30_000
FEATURES = 192
RIDGE = 3e-3
#: Width of the Gaussian kernel over standardised statistics.
WIDTH = 5.0
FOLDS = 5
#: Documents with a lower score are rejected.
KEEP = 0.3

#: Kinds of bytes: other, lower, upper, digit, space, newline, full stop, comma, !?;:, symbols, pipe and slashes, quotes
#: and brackets, lead byte of a longer character, continuation byte.
_KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".", b",", b"!?;:", b"#$%&*+=@^_~-", b"|/\\<>", b"\"'`()[]{}")):
    _KIND[list(_chars)] = _k
_KIND[0xC0:] = 12
_KIND[0x80:0xC0] = 13
_KINDS = 14
_LETTER = np.isin(_KIND, (1, 2, 12, 13))

#: Names of the statistics, in their order.
NAMES = [*(f"kind{k}" for k in range(_KINDS)), "mean_word", "short", "long", "bare_words", "all_upper", "distinct", "top_repeat", "log_words", "words_per_line", "words_per_stop", "line_end_stop", "capital_start", "runs", "echo"]


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of statistics for each text of a chunk."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    kind = _KIND[raw]
    counts = np.bincount(owner * np.int32(_KINDS) + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    size = np.maximum(counts.sum(1) - counts[:, 13], 1)
    starts, ends = word_bounds(raw, at)
    length = ends - starts
    word_of = owner[starts] if len(starts) else np.zeros(0, np.int32)
    words = np.bincount(word_of, minlength=n).astype(float)
    per = np.maximum(words, 1)
    by_word = lambda w: np.bincount(word_of, weights=w, minlength=n)
    letters = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(_LETTER[raw], out=letters[1:])
    uppers = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(kind == 2, out=uppers[1:])
    inner = letters[ends] - letters[starts]
    upper = uppers[ends] - uppers[starts]
    out = np.zeros((n, len(NAMES)))
    out[:, :_KINDS] = counts / size[:, None]
    out[:, 13] = counts[:, 13] / size
    if len(starts):
        first = kind[starts]
        out[:, 14] = by_word(length) / per / 10
        out[:, 15] = by_word(inner <= 3) / per
        out[:, 16] = by_word(inner >= 12) / per
        out[:, 17] = by_word(inner == length) / per
        out[:, 18] = by_word((upper == inner) & (inner > 1)) / per
        codes = word_hashes(raw, starts, ends)
        order = np.lexsort((codes, word_of))
        new = np.ones(len(order), bool)
        new[1:] = (codes[order][1:] != codes[order][:-1]) | (word_of[order][1:] != word_of[order][:-1])
        group = np.flatnonzero(new)
        out[:, 19] = np.bincount(word_of[order][group], minlength=n) / per
        np.maximum.at(out[:, 20], word_of[order][group], np.diff(np.append(group, len(order))))
        out[:, 20] /= per
        out[:, 25] = by_word((first == 2) & (upper < inner)) / per
        ends_line = np.flatnonzero(kind == 5)
        before = (kind[np.maximum(ends_line - 1, 0)] == 6) & (owner[np.maximum(ends_line - 1, 0)] == owner[ends_line])
        lines = counts[:, 5] + 1
        out[:, 24] = np.bincount(owner[ends_line], weights=before, minlength=n) / lines
        out[:, 22] = np.log1p(words / lines) / 5
        out[:, 23] = np.log1p(words / (counts[:, 6] + 1)) / 5
        same = np.zeros(len(raw), bool)
        same[1:] = (raw[1:] == raw[:-1]) & ~_LETTER[raw[1:]] & (owner[1:] == owner[:-1])
        out[:, 26] = np.bincount(owner, weights=same, minlength=n) / size
        echo = np.zeros(len(starts), bool)
        echo[1:] = (codes[1:] == codes[:-1]) & (word_of[1:] == word_of[:-1])
        out[:, 27] = by_word(echo) / per
    out[:, 21] = np.log1p(words) / 10
    return out


def chunk_statistics(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(NAMES))), *(statistics(raw, at) for _, raw, at in text_chunks(texts))])


class Model:
    """Standardised statistics -> random Fourier features -> ridge -> isotonic steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, steps: tuple[np.ndarray, np.ndarray]) -> None:
        self.mean, self.scale, self.weights, self.steps = mean, scale, weights, steps

    def features(self, x: np.ndarray) -> np.ndarray:
        return features((x - self.mean) / self.scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, *self.steps)


def features(z: np.ndarray) -> np.ndarray:
    """Cosines of random projections of standardised rows (far values are drawn in), and a constant."""
    draw = np.random.default_rng(20)
    z = np.clip(z, -6, 6)
    way = draw.standard_normal((z.shape[1], FEATURES)) / WIDTH
    turn = draw.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ way + turn), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators of y in the order of x: knots for linear interpolation, means pulled slightly inwards."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, sum of x
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, c, t = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + c, pools[-1][2] + t]
    at = np.array([t / c for _, c, t in pools])
    mean = np.array([(s + 0.5) / (c + 1) for s, c, _ in pools])
    return at, np.maximum.accumulate(mean)


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            stats = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
            yield stats, batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).to_numpy(zero_copy_only=False)


def fit(labelled: DataFrame) -> Model | None:
    """Fits on (stats, quality, fold) rows, at most about ``SAMPLE``; None without a usable label.

    Each partition sends one set of sums; the sample is spread over few partitions, so the driver gets a few MB.
    """
    labelled = labelled.coalesce(12)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(NAMES)))
        for x, _, _ in _stat_rows(batches):
            total += np.stack([np.full(x.shape[1], len(x)), x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    n, s, q = sum((np.frombuffer(r[0]).reshape(3, -1) for r in labelled.mapInArrow(moments, "sums binary").collect()), np.zeros((3, len(NAMES))))
    if not n[0]:
        return None
    mean = s / n
    scale = np.sqrt(np.maximum(q / n - mean * mean, 0))
    scale[scale < 1e-9] = 1.0
    width = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, width, width + 1))
        for x, y, fold in _stat_rows(batches):
            phi = features((x - mean) / scale)
            for k in range(FOLDS):
                own = phi[fold == k]
                total[k, :, :-1] += own.T @ own
                total[k, :, -1] += own.T @ y[fold == k]
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    sums = np.zeros((FOLDS, width, width + 1))
    for row in labelled.mapInArrow(equations, "sums binary").toLocalIterator():
        sums += np.frombuffer(row[0]).reshape(sums.shape)

    def solve(t: np.ndarray) -> np.ndarray:
        return np.linalg.solve(t[:, :-1] + RIDGE * n[0] / width * np.eye(width), t[:, -1])

    whole = solve(sums.sum(0))
    held = [solve(sums.sum(0) - sums[k]) for k in range(FOLDS)]

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, fold in _stat_rows(batches):
            phi = features((x - mean) / scale)
            own = np.choose(fold, [phi @ w for w in held])
            yield pa.RecordBatch.from_pydict({"x": own, "y": y})

    pairs = labelled.mapInArrow(out_of_fold, "x double, y double").toPandas()
    return Model(mean, scale, whole, isotonic(pairs["x"].to_numpy(), pairs["y"].to_numpy()))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model from the labelled documents outside the held-out fifth, at most about ``SAMPLE`` label rows."""
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out())
    usable = usable.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_quality")).distinct()
    n = usable.select("_id").distinct().count()
    parts = 1 << 20
    usable = usable.where(F.pmod(F.xxhash64("_id"), F.lit(parts)) < int(parts * min(1.0, SAMPLE / max(n, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = chunk_statistics(batch.column(1))
                values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), values, batch.column(2)], names=["id", "stats", "hash"])

    # The labelled ids are bounded by SAMPLE, so they are sent to every task.
    ids = usable.select("_id").distinct()
    rows = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), F.xxhash64("text").alias("_hash"))
    rows = rows.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select("_id", "_text", "_hash")
    kind = ids.schema["_id"].dataType.simpleString()
    stats = stored(rows.mapInArrow(run, f"id {kind}, stats array<double>, hash long"), "quality-statistics")
    stats = stats.groupBy("id").agg(F.min_by("stats", "hash").alias("stats"))
    folds = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold")
    return fit(stored(stats.join(F.broadcast(usable), F.col("id") == F.col("_id")).select("stats", F.col("_quality").alias("quality"), folds), "quality-sample"))


def _scores(model: Model | None, texts: pa.Array) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    x = chunk_statistics(texts)
    return np.clip(np.concatenate([np.zeros(0), *(model.score(x[k : k + 4096]) for k in range(0, len(x), 4096))]), 0.0, 1.0)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; ``predicted`` is 1 from a score of ``KEEP`` on."""
    model = fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1)))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns; one pass over the texts, no shuffle."""
    model = fitted(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at)) >= KEEP))

    return docs.mapInArrow(run, docs.schema)
