"""NPY and NPZ matrices, read from binary files; raw signals from Parquet."""

import io
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def _rows(name: str | None, width: int | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    found = np.load(io.BytesIO(content), allow_pickle=False)
                    x = found[name] if name else found
                except (ValueError, KeyError, OSError, EOFError):
                    continue  # a file that can't be read is left out, as is one of another width
                if x.ndim == 2 and (width is None or x.shape[1] == width):
                    for lo in range(0, len(x), 1024):
                        yield pd.DataFrame({"path": path, "ord": np.arange(lo, min(lo + 1024, len(x))), "features": list(x[lo : lo + 1024].astype(np.float32))})

    return run


def read_matrices(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """Folder of .npy files, and .npz files with `features` -> path, ord, features; only those of width 20 k + 1 if k is given."""
    width = None if k is None else 20 * k + 1
    out = None
    for pattern, name in (("*.npz", "features"), ("*.npy", None)):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
        got = files.mapInPandas(_rows(name, width), "path string, ord long, features array<float>")
        out = got if out is None else out.unionByName(got)
    return out


def list_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """name, path, size of the files of a folder, not its subfolders, with this suffix."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    return files.selectExpr("element_at(split(path, '/'), -1) as name", "path", "length as size")


def _save(folder: str, name: str, piece: int, form: str, rows: list[pa.RecordBatch]) -> tuple[str, int]:
    """Rows of one file; its name is the same in each run, so a task that runs again writes the same file."""
    table = pa.Table.from_batches(rows)
    matrix = np.stack([np.asarray(x, np.float32) for c in table.column("features").chunks for x in _lists(c)])
    stem = name.replace("/", "_") + (f".part{piece}" if piece else "")
    target, draft = os.path.join(folder, f"{stem}.{form}"), os.path.join(folder, f".{stem}.{TaskContext.get().taskAttemptId()}.tmp")
    os.makedirs(folder, exist_ok=True)
    with open(draft, "wb") as f:
        if form == "npy":
            np.save(f, matrix)
        else:
            info = np.frombuffer("".join(table.column("info").to_pylist()).encode(), np.uint8).reshape(len(matrix), -1)
            np.savez(f, site_infos=info, features=matrix)
    os.replace(draft, target)
    return target, len(matrix)


def _lists(column: pa.Array):
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (values[a:b] for a, b in zip(ends, ends[1:], strict=False))


def _files(folder: str, form: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, piece, rows, n = None, 0, [], 0

        def done():
            path, count = _save(folder, name, piece, form, rows)
            return pa.RecordBatch.from_pydict({"file_name": [name], "path": [path], "rows": [count]}, pa.schema([("file_name", pa.string()), ("path", pa.string()), ("rows", pa.int64())]))

        for batch in batches:
            names = np.asarray(batch.column("_file").to_pylist(), object)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                while lo < hi:
                    if rows and (names[lo] != name or n == most):
                        yield done()
                        piece, rows, n = (piece + 1 if names[lo] == name else 0), [], 0
                    name = names[lo]
                    take = min(hi - lo, most - n)
                    rows.append(batch.slice(lo, take))
                    lo, n = lo + take, n + take
        if rows:
            yield done()

    return run


def write_matrices(rows: DataFrame, folder: str, file_column: str, order: list[str], form: str = "npy", most: int = 65_536) -> DataFrame:
    """Writes features (array<float>, one width) of each value of file_column to folder/<value>.npy, or with info (strings of one length, as
    bytes) to <value>.npz; the folder is one that the executors share. A file has `most` rows at most: more go to <value>.part1.npy and on, so
    a task holds no more than that. Rows stand in `order`, which should tell them apart. Returns file_name, path, rows of each file; a null
    value is the file `none`."""
    keep = ["features", "info"] if form == "npz" else ["features"]
    named = rows.withColumn("_file", F.coalesce(F.col(file_column).cast("string"), F.lit("none")))
    dealt = named.repartition("_file").sortWithinPartitions("_file", *order)
    return dealt.select("_file", F.col("features").cast("array<float>").alias("features"), *keep[1:]).mapInArrow(_files(folder, form, most), "file_name string, path string, rows long")


def write_npz(features: DataFrame, folder: str, partition_column: str = "file_name", most: int = 65_536) -> DataFrame:
    """write_matrices() of rows of file_name, info, features: an .npz of site_infos and features for each signal file, by its name without
    `.pod5`."""
    return write_matrices(features.withColumn(partition_column, F.regexp_replace(partition_column, r"\.pod5$", "")), folder, partition_column, ["info"], "npz", most)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Raw reads from Parquet, the engine's own form of them."""
    return spark.read.schema(schemas.RAW_READS).parquet(path)
