"""Vector tables: which vectors take part, and their packed form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linekin.llm.common import stored


def valid_vectors(table: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, dims, vec, norm) of the vectors that take part; ``vec`` is packed little-endian doubles.

    A vector that is null, empty, zero or holds null or non-finite components takes no part, nor does one whose id is
    null, nor one whose length is not the most common one (of two as common, the longer): no product is defined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, packed, norms = [], [], [], []
            lists = batch.column(1)
            flat = np.asarray(lists.values.cast(pa.float64()).fill_null(np.nan) if lists.values.null_count else lists.values.cast(pa.float64()), np.float64)
            at = np.asarray(lists.offsets)
            for i, (key, have) in enumerate(zip(batch.column(0).to_pylist(), lists.is_valid().to_pylist(), strict=True)):
                v = flat[at[i] : at[i + 1]]
                if key is None or not have or not len(v) or not np.isfinite(v).all() or not v.any():
                    continue
                norm = float(np.sqrt((v * v).sum()))
                if not 0 < norm < np.inf:
                    continue
                ids.append(key)
                dims.append(len(v))
                packed.append((v + 0.0).tobytes())
                norms.append(norm)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "dims", "vec", "norm"])

    rows = stored(table.select(F.col("vec_id").cast("long").alias("vec_id"), column).mapInArrow(run, "vec_id long, dims int, vec binary, norm double"), "vectors")
    common = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    return rows.where(F.col("dims") == common[0]["dims"]) if common else rows


def unpacked(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)
