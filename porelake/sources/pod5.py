"""POD5 files of raw signals, read in splits and written: Arrow tables one after the other, found by a footer at the end.

A file holds a table of reads (whose `signal` lists rows of the signal table), a table of signal rows (each a piece of one read's
samples, as VBZ or as plain numbers) and one of run information. A split is a range of reads; it maps the file into memory and touches
the batches of signal rows that its reads name."""

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from . import vbz

# The file's first and last bytes, the footer's first, and the numbers of the tables' kinds.
SIGNATURE, FOOTER = b"\x8bPOD\r\n\x1a\n", b"FOOTER\0\0"
READS, SIGNALS, RUNS = 0, 1, 4
_OUT = pa.schema([("file_name", pa.string()), ("read_id", pa.string()), ("signal", pa.list_(pa.int16())), ("offset", pa.float32()), ("scale", pa.float32())])
#: Samples of a batch that goes to Spark.
_SAMPLES = 2_000_000


def _field(b: bytes, table: int, number: int) -> int | None:
    """Where a flatbuffer table's field stands; none if it has its default value."""
    fields = table - struct.unpack_from("<i", b, table)[0]
    at = 4 + 2 * number
    off = struct.unpack_from("<H", b, fields + at)[0] if at < struct.unpack_from("<H", b, fields)[0] else 0
    return table + off if off else None


def footer(path: str) -> dict[int, tuple[int, int]]:
    """Kind of table -> its place and length in the file."""
    with open(path, "rb") as f:
        size = f.seek(0, 2)
        if size < 48:
            raise ValueError(f"{path}: not a POD5 file")
        f.seek(size - 32)
        tail = f.read(32)
        n = struct.unpack_from("<q", tail)[0]
        f.seek(0)
        if f.read(8) != SIGNATURE or tail[24:] != SIGNATURE or not 0 < n <= size - 48:
            raise ValueError(f"{path}: not a POD5 file, or not one that was closed")
        f.seek(size - 32 - n)
        b = f.read(n)
    found, at = {}, _field(b, struct.unpack_from("<I", b)[0], 3)
    if at is not None:
        at += struct.unpack_from("<I", b, at)[0]
        for i in range(struct.unpack_from("<I", b, at)[0]):
            entry = at + 4 + 4 * i
            table = entry + struct.unpack_from("<I", b, entry)[0]
            get = lambda number, kind, t=table: 0 if (x := _field(b, t, number)) is None else struct.unpack_from(kind, b, x)[0]
            found[get(3, "<h")] = (get(0, "<q"), get(1, "<q"))
    if not {READS, SIGNALS} <= found.keys():
        raise ValueError(f"{path}: no table of reads or of signals")
    return found


def _footer_of(tables: list[tuple[int, int, int]], name: str) -> bytes:
    """(kind, place, length) of the tables -> the footer's flatbuffer."""

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack("<I", len(raw)) + raw + b"\0" * (4 - len(raw) % 4)

    # the root, its fields' table before it; then the strings and the vector, each at a multiple of 4
    out = bytearray(struct.pack("<I", 16) + struct.pack("<6H", 12, 20, 4, 8, 12, 16) + struct.pack("<i", 12) + bytes(16))
    for i, s in enumerate((name, "porelake", "0.3.0")):
        struct.pack_into("<I", out, 20 + 4 * i, len(out) - (20 + 4 * i))
        out += text(s)
    struct.pack_into("<I", out, 32, len(out) - 32)
    at = len(out) + 4
    out += struct.pack("<I", len(tables)) + bytes(4 * len(tables))
    for i, (kind, place, length) in enumerate(tables):
        while (len(out) + 12) % 8 != 4:  # so that the numbers of 8 bytes stand at multiples of 8
            out += b"\0"
        fields = len(out)
        out += struct.pack("<6H", 12, 24, 4, 12, 20, 22)
        struct.pack_into("<I", out, at + 4 * i, len(out) - (at + 4 * i))
        out += struct.pack("<i", len(out) - fields) + struct.pack("<qqhh", place, length, 0, kind)
    return bytes(out) + b"\0" * (-len(out) % 8)


class File:
    """A file's tables, mapped into memory."""

    def __init__(self, path: str):
        self.path, places = path, footer(path)
        self.map = pa.memory_map(path)
        whole = self.map.read_buffer()
        self.reads, self.signals = (pa.ipc.open_file(whole.slice(*places[k])) for k in (READS, SIGNALS))
        self.signal_bytes = places[SIGNALS][1]
        self.rows = [self.reads.get_batch(i).num_rows for i in range(self.reads.num_record_batches)]
        # all batches of signal rows but the last are of one size
        self.per = self.signals.get_batch(0).num_rows if self.signals.num_record_batches else 1
        self.at, self.batch = -1, None

    def samples(self, row: int, read_id: bytes) -> np.ndarray:
        if row // self.per != self.at:
            self.at = row // self.per
            self.batch = self.signals.get_batch(self.at)
        i = row % self.per
        if _plain(self.batch.column("read_id"))[i].as_py() != read_id:
            raise ValueError(f"{self.path}: signal row {row} is another read's")
        signal = _plain(self.batch.column("signal"))
        if pa.types.is_large_binary(signal.type) or pa.types.is_binary(signal.type):
            return vbz.unpack(signal[i].as_buffer(), self.batch.column("samples")[i].as_py())
        return np.asarray(signal[i].values, np.int16)

    def records(self, first: int, end: int) -> Iterator[tuple[str, np.ndarray, float, float]]:
        """read_id, signal, offset, scale of reads first to end - 1."""
        start = 0
        for i, n in enumerate(self.rows):
            lo, hi = max(first - start, 0), min(end - start, n)
            start += n
            if lo >= hi:
                continue
            b = self.reads.get_batch(i).slice(lo, hi - lo)
            ids, signal = _plain(b.column("read_id")).to_pylist(), b.column("signal").to_pylist()
            for read_id, rows, offset, scale in zip(ids, signal, b.column("calibration_offset").to_pylist(), b.column("calibration_scale").to_pylist(), strict=True):
                parts = [self.samples(r, read_id) for r in rows or []]
                yield str(uuid.UUID(bytes=read_id)), np.concatenate(parts) if parts else np.zeros(0, np.int16), offset, scale


def _plain(column: pa.Array) -> pa.Array:
    return column.storage if isinstance(column, pa.ExtensionArray) else column


def splits(path: str, size: int) -> list[tuple[int, int]]:
    """Ranges of a file's reads with about `size` bytes of packed signals each."""
    f = File(path)
    n = sum(f.rows)
    parts = max(1, min(n, -(-f.signal_bytes // size)))
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts) if n]


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self):
        files = [os.path.join(self.path, f) for f in sorted(os.listdir(self.path)) if f.endswith(".pod5")] if os.path.isdir(self.path) else [self.path]
        return [InputPartition((f, *s)) for f in files for s in splits(f, self.size)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        path, first, end = partition.value
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            ids, signals, offsets, scales = zip(*rows, strict=True)
            ends = np.cumsum([0, *map(len, signals)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(signals)))
            return pa.RecordBatch.from_arrays([pa.array([os.path.basename(path)] * len(rows)), pa.array(ids), lists, pa.array(offsets, pa.float32()), pa.array(scales, pa.float32())], schema=_OUT)

        for r in File(path).records(first, end):
            rows.append(r)
            held += len(r[1])
            if held >= _SAMPLES or len(rows) == 1024:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class Pod5Source(DataSource):
    """spark.read.format("pod5").load(path): a file, or a folder's .pod5 files, on storage that the executors mount. Option `split`: about how
    many bytes of packed signals a partition reads (64 MB). A file that isn't POD5, or that was never closed, is an error."""

    @classmethod
    def name(cls):
        return "pod5"

    def schema(self):
        return schemas.RAW_READS

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("split", 64 << 20)))


def read_pod5(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(Pod5Source)
    return spark.read.format("pod5").option("split", split).load(path)


_SIGNAL = pa.schema([
    pa.field("read_id", pa.binary(16), metadata={"ARROW:extension:name": "minknow.uuid", "ARROW:extension:metadata": ""}),
    pa.field("signal", pa.large_binary(), metadata={"ARROW:extension:name": "minknow.vbz", "ARROW:extension:metadata": ""}), ("samples", pa.uint32()),
])
_READ = pa.schema([
    _SIGNAL.field("read_id"), ("signal", pa.list_(pa.uint64())), ("read_number", pa.uint32()), ("num_samples", pa.uint64()), ("calibration_offset", pa.float32()),
    ("calibration_scale", pa.float32()), ("run_info", pa.dictionary(pa.int16(), pa.string())),
])


class Writer:
    """One file: signal rows go out in batches of `per`, each read cut into pieces of `piece` samples; what is held of a read after that
    is its row of the table of reads."""

    def __init__(self, path: str, per: int = 100, piece: int = 102_400, reads_per: int = 1000):
        self.f, self.per, self.piece, self.reads_per = open(path, "wb"), per, piece, reads_per  # noqa: SIM115
        self.section, self.tables = uuid.uuid5(uuid.NAMESPACE_OID, os.path.basename(path)).bytes, []
        self.f.write(SIGNATURE + self.section)
        self.start, self.rows, self.reads, self.row = self.f.tell(), [], [], 0
        self.metadata = {"MINKNOW:file_identifier": str(uuid.UUID(bytes=self.section)), "MINKNOW:software": "porelake", "MINKNOW:pod5_version": "0.3.0"}
        self.out = pa.ipc.new_file(pa.PythonFile(self.f, "w"), _SIGNAL.with_metadata(self.metadata))

    def _flush(self) -> None:
        if self.rows:
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*self.rows, strict=True), _SIGNAL, strict=True)], schema=self.out_schema))
            self.rows = []

    @property
    def out_schema(self) -> pa.Schema:
        return _SIGNAL.with_metadata(self.metadata)

    def add(self, read_id: str, signal: np.ndarray, offset: float, scale: float) -> None:
        name, at = uuid.UUID(read_id).bytes, []
        for lo in range(0, len(signal), self.piece):
            part = signal[lo : lo + self.piece]
            self.rows.append((name, vbz.pack(part), len(part)))
            at.append(self.row)
            self.row += 1
            if len(self.rows) == self.per:
                self._flush()
        self.reads.append((name, at, len(self.reads), len(signal), offset, scale, "run"))

    def _close_table(self, kind: int) -> None:
        self.tables.append((kind, self.start, self.f.tell() - self.start))
        self.f.write(b"\0" * (-self.f.tell() % 8) + self.section)
        self.start = self.f.tell()

    def close(self) -> None:
        self._flush()
        self.out.close()
        self._close_table(SIGNALS)
        run = pa.table({"acquisition_id": ["run"]}).replace_schema_metadata(self.metadata)
        reads = pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*self.reads, strict=True), _READ, strict=True)] if self.reads else [pa.array([], t.type) for t in _READ], schema=_READ.with_metadata(self.metadata))
        for kind, table, per in ((RUNS, run, 1), (READS, reads.unify_dictionaries(), self.reads_per)):
            with pa.ipc.new_file(pa.PythonFile(self.f, "w"), table.schema) as out:
                out.write_table(table, per)
            self._close_table(kind)
        raw = _footer_of(self.tables, self.metadata["MINKNOW:file_identifier"])
        self.f.write(FOOTER + raw + struct.pack("<q", len(raw)) + self.section + SIGNATURE)
        self.f.close()


def _write(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, piece, reads, samples, writer, draft = None, 0, 0, 0, None, ""
        os.makedirs(folder, exist_ok=True)

        def target() -> str:
            stem = name.removesuffix(".pod5").replace("/", "_")
            return os.path.join(folder, stem + (f".part{piece}" if piece else "") + ".pod5")

        def done() -> pa.RecordBatch:
            writer.close()
            os.replace(draft, target())  # a task that runs again writes the same files
            return pa.RecordBatch.from_pydict({"file_name": [name], "path": [target()], "reads": [reads], "samples": [samples]})

        for batch in batches:
            signal, ends = batch.column("signal").values.to_numpy(zero_copy_only=False), batch.column("signal").offsets.to_numpy()
            for i, (file, read_id, offset, scale) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_file", "read_id", "offset", "scale")), strict=True)):
                if writer and (file != name or samples >= most):
                    yield done()
                    piece, reads, samples, writer = (piece + 1 if file == name else 0), 0, 0, None
                if writer is None:
                    name = file
                    draft = target() + f".{TaskContext.get().taskAttemptId()}.tmp"
                    writer = Writer(draft)
                x = signal[ends[i] : ends[i + 1]]
                writer.add(read_id, x, offset, scale)
                reads, samples = reads + 1, samples + len(x)
        if writer:
            yield done()

    return run


def write_pod5(raw_reads: DataFrame, folder: str, most: int = 1 << 31) -> DataFrame:
    """Writes raw reads as folder/<file_name>.pod5, on storage that the executors share; read_id is a UUID's text. A file takes no more reads
    once it has `most` samples: the rest are in <file_name>.part1.pod5 and on. Reads stand by read_id; a null signal is an empty one, a null
    file_name the file `none`. Returns file_name, path, reads, samples of each file."""
    named = raw_reads.select(
        F.coalesce("file_name", F.lit("none")).alias("_file"), "read_id", F.coalesce(F.col("signal"), F.array().cast("array<smallint>")).alias("signal"),
        F.coalesce("offset", F.lit(0.0)).cast("float").alias("offset"), F.coalesce("scale", F.lit(1.0)).cast("float").alias("scale"),
    )
    dealt = named.repartition("_file").sortWithinPartitions("_file", "read_id")
    return dealt.mapInArrow(_write(folder, most), "file_name string, path string, reads long, samples long")
