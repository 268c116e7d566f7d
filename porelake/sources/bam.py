"""BAM as a Python data source: records are decoded to Arrow batches. A file is read in splits: with an index beside it at records that
the index names, else from the first block and the first record behind any byte. The sinks write sorted, indexed files, one for each range
of places or one in all."""

import glob
import os
import re
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.cigar import OPS
from . import bamcols, bgzf
from .bamcols import _NIBBLE, _PAIR
from .bamcols import TAGS as _TAGS
from .sam import COLUMNS, derive

# Struct formats of tag types.
_KINDS = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
RAW = (
    "read_id string, flag int, chr string, mapq int, pos0 int, cigar array<struct<op: tinyint, len: int>>, rnext string, pnext int, tlen bigint, seq string, qual string, "
    "file_name string, trim_start int, num_samples int, nm int, md string, parent_read string, split int, mv array<int>"
)
_ARROW = pa.schema([
    ("read_id", pa.string()), ("flag", pa.int32()), ("chr", pa.string()), ("mapq", pa.int32()), ("pos0", pa.int32()),
    ("cigar", pa.list_(pa.struct([("op", pa.int8()), ("len", pa.int32())]))), ("rnext", pa.string()), ("pnext", pa.int32()), ("tlen", pa.int64()), ("seq", pa.string()),
    ("qual", pa.string()), ("file_name", pa.string()), ("trim_start", pa.int32()), ("num_samples", pa.int32()), ("nm", pa.int32()), ("md", pa.string()),
    ("parent_read", pa.string()), ("split", pa.int32()), ("mv", pa.list_(pa.int32())), ("record", pa.binary()),
])


def _tags(b: bytes) -> dict:
    out, i = {}, 0
    while i + 3 <= len(b):
        name, kind = b[i : i + 2].decode("ascii", "replace"), chr(b[i + 2])
        i += 3
        if kind in "ZH":
            end = b.index(0, i)
            out[name], i = b[i:end].decode("utf-8", "replace"), end + 1
        elif kind == "B":
            sub, n = chr(b[i]), struct.unpack_from("<i", b, i + 1)[0]
            form = np.dtype(_KINDS[sub]).newbyteorder("<")
            out[name], i = np.frombuffer(b, form, n, i + 5), i + 5 + n * form.itemsize
        else:
            out[name] = struct.unpack_from("<" + _KINDS[kind], b, i)[0]
            i += struct.calcsize(_KINDS[kind])
    return out


def decode_record(b: bytes, names: list[str]) -> dict:
    """One alignment record, without its length -> a row of RAW."""
    tid, pos, name_len, mapq, _, n_ops, flag, n, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", b)
    i = 32 + name_len
    ops = np.frombuffer(b, "<u4", n_ops, i)
    i += 4 * n_ops
    seq = _PAIR[np.frombuffer(b, np.uint8, (n + 1) // 2, i)].ravel()[:n].tobytes().decode()
    i += (n + 1) // 2
    qual = np.frombuffer(b, np.uint8, n, i)
    qual = None if not n or qual[0] == 255 else (qual + 33).tobytes().decode("latin-1")
    t = _tags(b[i + n :])
    name = lambda k: names[k] if k >= 0 else None
    return {
        "read_id": b[32 : 32 + name_len - 1].decode("utf-8", "replace"), "flag": flag, "chr": name(tid), "mapq": mapq, "pos0": pos,
        "cigar": [{"op": int(o & 15), "len": int(o >> 4)} for o in ops], "rnext": name(mate), "pnext": mate_pos, "tlen": tlen, "seq": seq or None, "qual": qual,
        "file_name": t.get("fn"), "trim_start": t.get("ts"), "num_samples": t.get("ns"), "nm": t.get("NM", -1), "md": t.get("MD"), "parent_read": t.get("pi"),
        "split": t.get("sp"), "mv": None if t.get("mv") is None else t["mv"].astype(np.int32),
    }


def read_head(stream: bgzf.Reader) -> tuple[bytes, list[tuple[str, int]]]:
    """The header's text, names and lengths of the references; the stream then stands at the first record."""
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = stream.read(struct.unpack("<i", stream.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        name = stream.read(struct.unpack("<i", stream.read(4))[0])[:-1].decode()
        names.append((name, struct.unpack("<i", stream.read(4))[0]))
    return text.rstrip(b"\0"), names


def read_header(stream: bgzf.Reader) -> list[tuple[str, int]]:
    return read_head(stream)[1]


#: Bytes before a record's name, with the length before them; the most that a record may have; and how many records in a row must be plausible.
_FIXED, _MOST, _CHAIN = 36, 1 << 28, 4


def _plausible(head: bytes, names: list[tuple[str, int]]) -> int | None:
    """Size of the record, with its length, whose first bytes these are; none if it can't be one."""
    if len(head) < _FIXED + 1:
        return None
    size, tid, pos, name_len, _, _, n_ops, _, n, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", head)
    known = lambda t, p: t == -1 and p >= -1 or 0 <= t < len(names) and -1 <= p < max(names[t][1], 1)
    if not (32 <= size <= _MOST and name_len and n >= 0 and known(tid, pos) and known(mate, mate_pos) and 32 + name_len + 4 * n_ops + (n + 1) // 2 + n <= size):
        return None
    name = head[_FIXED : _FIXED + name_len]
    if len(name) < name_len or name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
        return None
    ops = head[_FIXED + name_len : _FIXED + name_len + 4 * min(n_ops, 8)]
    return 4 + size if all(o & 15 < len(OPS) for o in struct.unpack_from(f"<{len(ops) // 4}I", ops)) else None


def first_record(f: BinaryIO, names: list[tuple[str, int]], at: int, end: int) -> int | None:
    """Virtual offset of the first record that begins in a block of [at, end) of the file, none if there is none: where _CHAIN records in a
    row, or all up to the file's end, are plausible."""
    block = bgzf.next_block(f, at, end)
    while block is not None and block < end:
        stream = bgzf.Reader(f, block << 16)
        data, after = stream.data, stream.next
        # what follows, as far as a record's head may reach into it
        more = bgzf.Reader(f, after << 16).read(_FIXED + 255 + 32) if data else b""
        whole = data + more
        for i in range(len(data)):
            size = _plausible(whole[i : i + _FIXED + 255 + 32], names)
            if size is not None and _chain(f, block << 16 | i, size, names):
                return block << 16 | i
        if after == block:
            return None
        block = after if after < f.seek(0, 2) else None
    return None


def _chain(f: BinaryIO, at: int, size: int, names: list[tuple[str, int]]) -> bool:
    stream = bgzf.Reader(f, at)
    for _ in range(_CHAIN - 1):
        if len(stream.read(size)) < size:
            return False  # cut off
        here = bgzf.Reader(f, stream.tell())
        head = here.read(_FIXED + 255 + 32)
        if not head:
            return True
        if (size := _plausible(head, names)) is None:
            return False
        stream = bgzf.Reader(f, stream.tell())
    return True


def index_of(path: str) -> bgzf.Index | None:
    """The index beside a file; none if there is none."""
    stem = os.path.splitext(path)[0]
    for name in (path + ".bai", stem + ".bai", path + ".csi", stem + ".csi"):
        if os.path.exists(name):
            with open(name, "rb") as f:
                raw = f.read() if name.endswith(".bai") else bgzf.Reader(f).read(1 << 40)
            return bgzf.Index.load(raw)
    return None


def splits(path: str, size: int) -> list[tuple[str, int, int | None]]:
    """How a file is read: ranges of about `size` bytes each. A range begins and ends `at` a record that the index beside the file names, or at the
    first record `near` a byte: without an index, and where the index names none for long (reads without a place, or many at one place).
    Kinds name both ends, as `at-near`."""
    index = index_of(path)
    with open(path, "rb") as f:
        whole = f.seek(0, 2)
        stream = bgzf.Reader(f)
        read_head(stream)
        first = stream.tell()
    cuts = [("at", first)]
    for at in [*(index.starts() if index else []), None]:
        end = whole if at is None else at >> 16
        last = cuts[-1][1] >> 16
        if at is None or end - last >= size and at > first:
            cuts += [("near", b << 16) for b in range(last + size, end - size // 2, size)]
            cuts += [("at", at)] if at is not None else []
    return [(f"{a}-{b}", x, y) for (a, x), (b, y) in zip(cuts, [*cuts[1:], ("at", None)], strict=True)]


#: Bytes of a file between two ranges of a region that are read as one.
_NEAR = 1 << 17


def over(path: str, size: int, region: str) -> list[tuple[str, int, int | None]]:
    """The parts of an indexed file in which the records over `name:start-end` (from 0, end left out) begin, in pieces at records; those with less than
    a block or two between them are one."""
    index = index_of(path)
    if index is None:
        raise ValueError(f"{path}: a region needs an index beside the file")
    name, start, end = parse_region(region)
    with open(path, "rb") as f:
        names = [n for n, _ in read_header(bgzf.Reader(f))]
    out: list[tuple[int, int]] = []
    for a, b in index.chunks(names.index(name), start, end) if name in names else []:
        if out and (a >> 16) - (out[-1][1] >> 16) <= _NEAR:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [("at-at", a, b) for a, b in out]


def parse_region(region: str) -> tuple[str, int, int]:
    name, _, places = region.rpartition(":")
    start, _, end = places.partition("-")
    return name, int(start), int(end)


def read_part(path: str, kind: str, start: int, end: int | None, columns: list[str], region: str | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of one of splits() or over()."""
    schema = pa.schema([_ARROW.field(c) for c in columns])
    begins, ends = kind.split("-")
    with open(path, "rb") as f:
        heads = read_header(bgzf.Reader(f))
        names, whole = [n for n, _ in heads], f.seek(0, 2)
        # the part before ends where this one begins: both look for the same record
        start = first_record(f, heads, start >> 16, whole) if begins == "near" else start
        end = first_record(f, heads, end >> 16, whole) if ends == "near" else end
        if start is None or end is not None and start >= end:
            return
        wanted = parse_region(region) if region else None
        for data, at, size in bamcols.spans(bgzf.Reader(f, start), end):
            done = False
            if wanted:
                tid, a, b = bamcols.places(np.frombuffer(data, np.uint8), at)
                own = names.index(wanted[0])
                done = bool(tid[-1] < 0 or tid[-1] > own or tid[-1] == own and a[-1] >= wanted[2])  # an indexed file is sorted
                keep = (tid == own) & (a < wanted[2]) & (b > wanted[1])
                at, size = at[keep], size[keep]
            if len(at):
                yield _rows(data, at, size, names, columns, schema)
            if done:
                return


def _rows(data: bytes, at: np.ndarray, size: np.ndarray, names: list[str], columns: list[str], schema: pa.Schema) -> pa.RecordBatch:
    try:
        return bamcols.decode(data, at, size, names, columns, schema)
    except bamcols.Odd:
        rows = []
        for i, n in zip(at.tolist(), size.tolist(), strict=True):
            row = decode_record(body := data[i : i + n], names)
            rows.append({c: body if c == "record" else row[c] for c in columns})
        return pa.RecordBatch.from_pylist(rows, schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], size: int, region: str | None = None):
        self.path, self.columns, self.size, self.region = path, columns, size, region

    def partitions(self):
        files = sorted(glob.glob(os.path.join(self.path, "*.bam"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        parts = [(f, *s) for f in files for s in (over(f, self.size, self.region) if self.region else splits(f, self.size))]
        return [InputPartition(p) for p in parts] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is not None:
            yield from read_part(*partition.value, self.columns, self.region)


class BamSource(DataSource):
    """spark.read.format("bam").load(path): a file, a pattern, or a folder of .bam files on storage that the executors mount. Options:
    `split`, about the bytes of a split (64 MB); `region`, as chr1:1000-2000 (from 0, the end left out), of files with an index: only its
    parts are read; `record`, `true` for the records' own bytes in a further column."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return RAW + (", record binary" if self.options.get("record") == "true" else "")

    def reader(self, schema):
        return _Reader(self.options["path"], list(schema.names), int(self.options.get("split", 64 << 20)), self.options.get("region"))


def read_bam(spark: SparkSession, path: str, split: int = 64 << 20, region: str | None = None) -> DataFrame:
    spark.dataSource.register(BamSource)
    source = spark.read.format("bam").option("split", split)
    return _alignments((source.option("region", region) if region else source).load(path))


def _alignments(raw: DataFrame) -> DataFrame:
    from ..functions.signal import move_table

    rows = derive(raw).withColumn("_m", F.when(F.col("mv").isNotNull(), move_table(F.col("mv"))))
    return rows.withColumn("stride", F.col("_m.stride")).withColumn("moves", F.col("_m.moves")).select(COLUMNS)


def _split_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                local = re.sub(r"^file:(//)?(?=/)", "", path)
                kinds, starts, ends = zip(*splits(local, size), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([local] * len(kinds)), pa.array(kinds), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["path", "kind", "first", "last"])

    return run


def _read_rows(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from read_part(path, kind, first, last, columns)

    return run


def alignments_of(files: DataFrame, split: int = 64 << 20, parts: int | None = None) -> DataFrame:
    """files(path) -> the alignments of these BAM files, in batch or as a stream: each file's splits are dealt over `parts` partitions."""
    rows = files.select("path").mapInArrow(_split_rows(split), "path string, kind string, first long, last long")
    dealt = rows.repartition(*([parts] if parts else []), "path", "first")
    return _alignments(dealt.mapInArrow(_read_rows([f.name for f in _ARROW if f.name != "record"]), RAW))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """read_id, flag, chr, pos0 and record, the alignment's own bytes, for write_sorted()."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("record", "true").load(path).select("read_id", "flag", "chr", "pos0", "record")


def heads_of(path: str) -> tuple[bytes, list[tuple[str, int]]]:
    """The first file's header text, and names and lengths of the references of a file, or of all files of a folder or pattern, which must
    agree."""
    found = []
    for name in sorted(glob.glob(os.path.join(path, "*.bam") if os.path.isdir(path) else path)):
        with open(name, "rb") as f:
            found.append(read_head(bgzf.Reader(f)))
    if not found or any(h[1] != found[0][1] for h in found):
        raise ValueError("no BAM files, or files of different references")
    return found[0]


def header_of(path: str) -> list[tuple[str, int]]:
    return heads_of(path)[1]


def _head(names: list[tuple[str, int]], text: bytes = b"") -> bytes:
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names))
    return out + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in names)


def _append(out: bgzf.Writer, index: bgzf.Index, records: pa.Array, before: int = 0, framed: bool = False) -> int:
    """Writes records (framed: that have their lengths), and adds them to the index, `before` further on."""
    n, rows = 0, max(1, int((4 << 20) / max(1, records.nbytes / max(1, len(records)))))
    for lo in range(0, len(records), rows):
        data, at, size = (bamcols.with_lengths if framed else bamcols.framed)(records.slice(lo, rows))
        first, after = out.write_all(data, size + 4)
        index.add_all(*bamcols.places(np.frombuffer(data, np.uint8), at), first + before, after + before)
        n += len(at)
    return n


def _part(folder: str, names: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        target, draft = os.path.join(folder, f"part-{task.partitionId():05d}.bam"), f".{task.taskAttemptId()}.tmp"
        os.makedirs(folder, exist_ok=True)
        n, index = 0, bgzf.Index(len(names))
        with open(target + draft, "wb") as f:
            out = bgzf.Writer(f)
            out.write(_head(names, b"@HD\tVN:1.6\tSO:coordinate\n"))
            out.flush()
            for batch in batches:
                n += _append(out, index, batch.column("record"))
            out.close()
        with open(target + ".bai" + draft, "wb") as f:
            f.write(index.dump())
        os.replace(target + draft, target)  # a task that runs again writes the same files
        os.replace(target + ".bai" + draft, target + ".bai")
        yield pa.RecordBatch.from_pydict({"path": [target], "rows": [n]})

    return run


def write_sorted(raw: DataFrame, names: list[tuple[str, int]], folder: str, parts: int | None = None) -> DataFrame:
    """Writes rows of read_raw() as sorted BAM files with indexes to a folder that the executors share: a file for each range of
    (reference, start), reads without a place last. References stand in the header's order. Returns path and rows of each file.

    Ranges are cut on the record's hash as well, so reads that pile up at one place are spread over files."""
    return _in_order(raw, names, parts).mapInArrow(_part(folder, names), "path string, rows long")


def _ref(names: list[tuple[str, int]], none: int) -> Column:
    """The number of a read's reference, `none` without a place."""
    order = F.create_map(*(F.lit(v) for i, (n, _) in enumerate(names) for v in (n, i))) if names else F.create_map().cast("map<string,int>")
    return F.coalesce(F.when(F.col("pos0") >= 0, F.try_element_at(order, F.col("chr"))), F.lit(none))


def _in_order(raw: DataFrame, names: list[tuple[str, int]], parts: int | None) -> DataFrame:
    rows = raw.select(_ref(names, 2**31 - 1).alias("_ref"), F.col("pos0").alias("_at"), F.xxhash64("record").alias("_h"), "record")
    keys = ["_ref", "_at", "_h"]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys, "record").select("record")


#: Added to a run's own virtual offsets, of which none is then 0, as for windows without a record.
_BEFORE = 1 << 16
_RUN = "part int, path string, size long, rows long, unplaced long, chunks array<struct<tid: int, bin: int, first: long, last: long>>, windows array<struct<tid: int, window: int, at: long>>"


def _run(folder: str, refs: int, depth: int, framed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        target = os.path.join(folder, f"{part:05d}.{task.taskAttemptId()}")
        os.makedirs(folder, exist_ok=True)
        n, index = 0, bgzf.Index(refs, depth)
        with open(target, "wb") as f:
            out = bgzf.Writer(f)
            for batch in batches:
                n += _append(out, index, batch.column("record"), _BEFORE, framed)
            while out.data:
                out.flush()
            size = f.tell()
        chunks = [{"tid": t, "bin": b, "first": x, "last": y} for t, bins in enumerate(index.bins) for b, own in bins.items() for x, y in own]
        windows = [{"tid": t, "window": w, "at": x} for t, own in enumerate(index.windows) for w, x in enumerate(own) if x]
        yield pa.RecordBatch.from_pylist([{"part": part, "path": target, "size": size, "rows": n, "unplaced": index.unplaced, "chunks": chunks, "windows": windows}], _RUN_ARROW)

    return run


_RUN_ARROW = pa.schema([
    ("part", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("rows", pa.int64()), ("unplaced", pa.int64()),
    ("chunks", pa.list_(pa.struct([("tid", pa.int32()), ("bin", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))),
    ("windows", pa.list_(pa.struct([("tid", pa.int32()), ("window", pa.int32()), ("at", pa.int64())]))),
])


def _placed(target: str):
    """Copies parts into the file, each to its own place; a task that runs again writes the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist(), strict=True):
                with open(path, "rb") as part, open(target, "r+b") as whole:
                    whole.seek(at)
                    while piece := part.read(1 << 22):
                        whole.write(piece)
                        done += len(piece)
        yield pa.RecordBatch.from_pydict({"bytes": [done]})

    return run


def sorted_text(text: bytes) -> bytes:
    """A header's text with the order of places stated in its first line; the other lines stay."""
    lines = [x for x in text.split(b"\n") if x]
    head = [x for x in lines if x.startswith(b"@HD")][:1] or [b"@HD\tVN:1.6"]
    fields = [x for x in head[0].split(b"\t") if not x.startswith((b"SO:", b"GO:", b"SS:"))] + [b"SO:coordinate"]
    return b"".join(x + b"\n" for x in [b"\t".join(fields), *(x for x in lines if not x.startswith(b"@HD"))])


def write_one(raw: DataFrame, names: list[tuple[str, int]], path: str, text: bytes = b"", parts: int | None = None) -> int:
    """Writes rows of read_raw() as one sorted BAM file with an index beside it (.bai, or .csi if a reference is longer than 512 Mb), on
    storage that driver and executors share; `text` is the header's. Returns the number of records.

    Tasks write ranges of (reference, start, hash) as runs of blocks without a header; the runs' sizes, added up, say where each goes
    in the file, and tasks copy them there side by side, so none passes all bytes. The runs' indexes come to the driver, shifted by these
    places: a few chunks a bin and run, and 8 bytes for each 16 kb of a reference."""
    return _write(_in_order(raw, names, parts), names, path, text)


#: Quantiles of the places that ranges are cut at, and their accuracy; rows of a range.
_CUTS, _ACCURACY, _RANGE = 1024, 5000, 400_000


def write_alignments(alignments: DataFrame, names: list[tuple[str, int]], path: str, text: bytes = b"", parts: int | None = None) -> int:
    """write_one() of encode(alignments), but each is encoded once: ranges are cut at quantiles of the places, for which chr, ref_start and is_mapped
    alone are read, about _RANGE rows each (_CUTS ranges at most). Reads that pile up at one place are spread by their records' sums."""
    a = _prepared(alignments)
    key = _ref(names, len(names)).cast("long") * F.lit(1 << 32) + F.col("pos0")
    at = F.percentile_approx(key, [i / _CUTS for i in range(1, _CUTS)], _ACCURACY)
    n, found = a.agg(F.count(F.lit(1)), at).first()
    if parts is None:
        parts = 1 + max(n // _RANGE, min(n // 20_000, a.sparkSession.sparkContext.defaultParallelism - 1))
    parts = min(parts, _CUTS)
    cuts = [found[i * _CUTS // parts - 1] for i in range(1, parts)] if n else []
    rows = a.select([c for c in a.columns if c in alignments.columns or c == "pos0"]).mapInArrow(_encoded(names, cuts), "part int, place long, h long, record binary")
    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("place", "h", "record")
    return _write(dealt.select("record"), names, path, text, True)


def _write(rows: DataFrame, names: list[tuple[str, int]], path: str, text: bytes, framed: bool = False) -> int:
    """Writes records that stand in order, over partitions as well; framed: they have their lengths."""
    spark, folder, draft = rows.sparkSession, path + ".runs", path + ".draft"
    depth = bgzf.depth_for(max((n for _, n in names), default=0))
    runs = sorted(rows.mapInArrow(_run(folder, len(names), depth, framed), _RUN).collect(), key=lambda r: r.part)
    index = bgzf.Index(len(names), depth)
    with open(draft, "wb") as f:
        out = bgzf.Writer(f)
        out.write(_head(names, sorted_text(text)))
        while out.data:
            out.flush()
        at, places = f.tell(), []
        for r in runs:
            index.merge([tuple(c) for c in r.chunks], [tuple(w) for w in r.windows], r.unplaced, at - (_BEFORE >> 16))
            places.append((r.path, at))
            at += r.size
        f.seek(at)
        f.write(bgzf.EOF)
    if places:
        spark.createDataFrame(places, "path string, at long").repartition(len(places)).mapInArrow(_placed(draft), "bytes long").agg(F.sum("bytes")).collect()
    os.replace(draft, path)
    for name in os.listdir(folder) if runs else []:
        os.remove(os.path.join(folder, name))
    if runs:
        os.rmdir(folder)
    for old in (path + ".bai", path + ".csi"):
        if os.path.exists(old):
            os.remove(old)
    with open(path + (".bai" if depth == 5 else ".csi"), "wb") as f:
        if depth == 5:
            f.write(index.dump())
        else:
            packed = bgzf.Writer(f)
            packed.write(index.dump_csi())
            packed.close()
    return sum(r.rows for r in runs)


def encode_record(r: dict, ids: dict[str, int]) -> bytes:
    """A row of read_id, flag, chr, pos0, mapq, cigar [(op's number, len)], seq, qual, tags [(name, kind, value)] -> the record, without its length."""
    seq, name = r.get("seq") or "", (r.get("read_id") or "*").encode()
    nibbles = _NIBBLE[np.frombuffer((seq + "=" * (len(seq) % 2)).encode("latin-1", "replace"), np.uint8)]
    mate = {"=": r["chr"], "*": None}.get(r.get("rnext"), r.get("rnext"))
    at = lambda p: -1 if p is None else p
    out = [struct.pack("<iiBBHHHiiii", ids.get(r["chr"], -1), at(r["pos0"]), len(name) + 1, r.get("mapq") or 0, 0, len(r.get("cigar") or ()), r["flag"], len(seq), ids.get(mate, -1), at(r.get("pnext")), r.get("tlen") or 0)]
    out += [name, b"\0", np.array([n << 4 | o for o, n in r.get("cigar") or ()], "<u4").tobytes(), (nibbles[::2] << 4 | nibbles[1::2]).tobytes()]
    out.append((np.frombuffer(r["qual"].encode("latin-1"), np.uint8) - np.uint8(33)).tobytes() if r.get("qual") and len(r["qual"]) == len(seq) else b"\xff" * len(seq))
    for tag, kind, value in r.get("tags") or ():
        if value is None:
            continue
        out.append(tag.encode() + kind[:1].encode())
        if kind == "Z":
            out.append(value.encode() + b"\0")
        elif kind[0] == "B":
            out.append(kind[1].encode() + struct.pack("<i", len(value)) + np.asarray(value, np.dtype(_KINDS[kind[1]]).newbyteorder("<")).tobytes())
        else:
            out.append(struct.pack("<" + _KINDS[kind], value))
    return b"".join(out)


def _dealt(batch: pa.RecordBatch, made: pa.Array, ids: dict[str, int], cuts: np.ndarray) -> pa.RecordBatch:
    """Records with their part, place and sum. Of k cuts at one place, the sums there are cut into k + 1 stretches of equal length."""
    pos = batch.column("pos0").to_numpy(zero_copy_only=False).astype(np.int64)
    ref = pc.fill_null(pc.index_in(batch.column("chr"), value_set=pa.array([*ids], pa.string())), -1).to_numpy(zero_copy_only=False)
    place = (np.where((ref >= 0) & (pos >= 0), ref, len(ids)).astype(np.int64) << 32) + pos
    buf, at, size = bamcols.bytes_of(made)
    raw = memoryview(buf)
    h = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)), np.int64, len(at))
    first = np.searchsorted(cuts, place)
    part = first + (h * (np.searchsorted(cuts, place, "right") - first + 1) >> 32)
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(place), pa.array(h), made], ["part", "place", "h", "record"])


def _filled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """With null columns for those that weren't sent."""
    columns = dict(zip(batch.schema.names, batch.columns, strict=True))
    for c in _KEPT:
        if c not in columns:
            columns[c] = pa.nulls(batch.num_rows, _ARROW.field(c).type if c in _ARROW.names else pa.list_(pa.int32()) if c == "moves" else pa.int32())
    return pa.RecordBatch.from_pydict(columns)


def _encoded(names: list[tuple[str, int]], cuts: list[int] | None = None):
    """Rows of read_raw(); with cuts, records with their lengths and parts."""
    ids = {n: i for i, (n, _) in enumerate(names)}

    def one_by_one(batch: pa.RecordBatch) -> list[bytes]:
        made = []
        for r in batch.to_pylist():
            tags = [(tag, kind, r[c]) for tag, kind, c in _TAGS if not (c == "nm" and r[c] == -1)]
            if r["moves"] is not None and r["stride"] is not None:  # as 0 and 1 for each stride
                mv = np.zeros(max(r["moves"], default=0) + 1, np.int8)
                mv[r["moves"][:-1]] = 1
                mv = mv[:-1]
                tags.append(("mv", "Bc", [r["stride"], *mv.tolist()]))
            made.append(encode_record(r | {"tags": tags, "cigar": [(c["op"], c["len"]) for c in r["cigar"] or ()]}, ids))
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in map(_filled, batches):
            rows = max(1, int((4 << 20) / max(1, whole.nbytes / max(1, whole.num_rows))))
            for batch in (whole.slice(lo, rows) for lo in range(0, whole.num_rows, rows)):
                try:
                    made = bamcols.encode(batch, [n for n, _ in names], 0 if cuts is None else 4)
                except bamcols.Odd:
                    made = one_by_one(batch)
                    made = pa.array(made if cuts is None else [struct.pack("<i", len(r)) + r for r in made], pa.binary())
                if cuts is not None:
                    yield _dealt(batch, made, ids, np.array(cuts, np.int64))
                    continue
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("read_id", "flag", "chr", "pos0")), made], ["read_id", "flag", "chr", "pos0", "record"])

    return run


def encode(alignments: DataFrame, names: list[tuple[str, int]]) -> DataFrame:
    """Alignments -> rows of read_raw(), for write_one() and write_sorted(): each with its BAM record, of the columns and the tags that they
    came from. A chromosome that isn't one of the references is none; a quality of another length than the sequence is left out."""
    return _prepared(alignments).mapInArrow(_encoded(names), "read_id string, flag int, chr string, pos0 int, record binary")


_KEPT = ["read_id", "flag", "chr", "pos0", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", *(c for _, _, c in _TAGS), "stride", "moves"]


def _prepared(alignments: DataFrame) -> DataFrame:
    a = alignments.withColumn("pos0", F.when(F.col("ref_start") >= 0, F.col("ref_start")).otherwise(-1)).withColumn("chr", F.when(F.col("is_mapped"), F.col("chr")))
    there = [F.col(c) if c in a.columns else F.lit(None).cast(_KIND_OF.get(c, "int")).alias(c) for c in _KEPT]
    return a.select(*there)


_KIND_OF = dict.fromkeys(("read_id", "chr", "rnext", "seq", "qual", "file_name", "md", "parent_read"), "string") | {"tlen": "bigint", "moves": "array<int>"}


def write_bam(path: str, names: list[tuple[str, int]], rows: list[dict]) -> None:
    """A small BAM file, for fixtures: rows of read_id, flag, chr, pos0, mapq, cigar [(op, len)], seq, qual, tags {name: (kind, value)}."""
    ids = {n: i for i, (n, _) in enumerate(names)}
    with open(path, "wb") as f:
        stream = bgzf.Writer(f)
        stream.write(_head(names))
        for r in rows:
            tags = [(k, *v) for k, v in r.get("tags", {}).items()]
            record = encode_record(r | {"cigar": [(OPS.index(o), n) for o, n in r["cigar"]], "tags": tags}, ids)
            stream.write(struct.pack("<i", len(record)) + record)
        stream.close()
