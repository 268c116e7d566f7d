"""What the operators on vectors share: packing vectors in blocks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """False for a vector that is null, empty, or holds null or non-finite components."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce((F.size(x) > 0) & ~bad, F.lit(False))


def as_bytes(name: str, kind: str):
    """For mapInArrow: turns the column `name` of vectors into their components' bytes; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, x = batch.schema.names.index(name), batch.column(name)
            # components are all there, as finite() has it
            flat, ends = x.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            there = x.is_valid().to_numpy(zero_copy_only=False)
            yield batch.set_column(i, name, pa.array([flat[e - n : e].tobytes() if ok else None for e, n, ok in zip(ends, np.diff(ends, prepend=0), there, strict=True)], pa.binary()))

    return run


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's column of vectors of one length -> float64[n, d]."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Batches that are sorted by keys (integers) -> (key, its rows). Holds one group at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(k)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[a].tolist())
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def in_cells(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Deals df by keys and sorts each partition by them, for grouped()."""
    return df.repartition(parts, *keys).sortWithinPartitions(*keys)
