"""Arrow batches to matrices and back, and matrices of bounded size for broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.storage import stage

BROADCAST_BYTES = 256 * 1024 * 1024
BLOCK_BYTES = 64 * 1024 * 1024


def to_matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a 2-D array of doubles; all rows must have the same width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, dim or 0))
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    want = int(dim if dim is not None else widths[0])
    if column.null_count or (widths != want).any():
        raise ValueError(f"vectors of width {widths.min()} to {widths.max()}, expected {want}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), want).astype(np.float64)


def to_lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), type=kind))


def map_batches(
    df: DataFrame,
    keep: Sequence[str],
    vector: str,
    new: T.StructType,
    compute: Callable[[pa.RecordBatch], dict[str, pa.Array]],
) -> DataFrame:
    """Add computed columns to ``keep``; only the needed columns reach Python."""
    source = df.select(*dict.fromkeys([*keep, vector]))
    schema = T.StructType([source.schema[c] for c in keep] + list(new.fields))
    names = [f.name for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            made = compute(batch)
            columns = [batch.column(c) for c in keep] + [made[n] for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return source.mapInArrow(run, schema)


SPREAD_BYTES = 256 * 1024 * 1024
PIECE_BYTES = 256 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Deal out a small input evenly, for costly work per row.

    A file can't be split below a row group, so a small input may keep a single
    core busy. An input over ``SPREAD_BYTES`` by Catalyst's estimate is left as
    it is.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES:
        return df
    pieces = size // PIECE_BYTES + 1
    return df.repartition(min(pieces, df.sparkSession.sparkContext.defaultParallelism))


@dataclass(frozen=True)
class Block:
    """Rows of a table collected for a broadcast: ids, vectors and other columns.

    What is broadcast are the ``parts``: plain arrays, which executors can read
    without this package.
    """

    ids: np.ndarray
    matrix: np.ndarray
    extra: dict[str, list]

    @property
    def parts(self) -> tuple:
        return self.ids, self.matrix, self.extra


def _collect(df: DataFrame, id_col: str, vector: str, extra: Sequence[str]) -> Block:
    table = df.select(id_col, vector, *extra).toArrow()
    ids = table.column(id_col).to_numpy()
    order = np.argsort(ids, kind="stable")
    matrix = to_matrix(table.column(vector))[order]
    columns = {c: table.column(c).take(pa.array(order)).to_pylist() for c in extra}
    return Block(ids[order], matrix, columns)


def bounded_blocks(
    df: DataFrame,
    id_col: str,
    vector: str,
    extra: Sequence[str] = (),
    max_bytes: int = BROADCAST_BYTES,
) -> Iterator[Block]:
    """The table as matrices of about ``max_bytes`` each, one at a time.

    The size is measured first. A table within the bound gives one block. A
    larger one is staged in hash slices, and each slice is read on its own.
    """
    rows, width = df.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    if not rows:
        return
    slices = -(-rows * max(width, 1) * 8 // max_bytes)
    if slices == 1:
        yield _collect(df, id_col, vector, extra)
        return
    slice_of = F.pmod(F.xxhash64(id_col), F.lit(slices)).cast("int").alias("_slice")
    staged = stage(df.select(id_col, vector, *extra, slice_of), ["_slice"])
    for number in range(slices):
        block = _collect(staged.where(F.col("_slice") == number), id_col, vector, extra)
        if len(block.ids):
            yield block


def over_blocks(
    spark: SparkSession,
    blocks: Iterator[Block],
    run: Callable[[Broadcast], DataFrame],
) -> list[DataFrame]:
    """The result of ``run`` for the broadcast of every block.

    A single block gives a lazy result. With more, each result is staged and
    its broadcast given up before the next block but one is collected, so their
    number has no bearing on memory.
    """
    blocks = iter(blocks)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        return []
    context = spark.sparkContext
    if following is None:
        return [run(context.broadcast(block.parts))]
    results = []
    while block is not None:
        shared = context.broadcast(block.parts)
        results.append(stage(run(shared)))
        shared.destroy()
        block, following = following, next(blocks, None)
    return results


def bounded_block(df: DataFrame, id_col: str, vector: str, extra: Sequence[str] = (),
                  max_bytes: int = BROADCAST_BYTES) -> Block:
    """The whole table as one block, or an error if it is over the bound."""
    rows, width = df.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    size = rows * (width or 0) * 8
    if size > max_bytes:
        raise ValueError(f"{size} bytes of vectors are over the bound of {max_bytes}")
    return _collect(df, id_col, vector, extra)
