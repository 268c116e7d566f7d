"""Site features: one kernel for training and calling, a read at a time in Arrow batches, after all native gates and joins."""

import os
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..functions import signal as sg
from ..functions import text
from ..sources import refstore
from . import reads

PER_BASE = 4 + sg.POINTS
_CODES = np.full(256, -1, np.int32)
_CODES[[ord(c) for c in sq.ALPHABET]] = np.arange(len(sq.ALPHABET))
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[[ord(c) for c in sq.PAIRS[0]]] = [ord(c) for c in sq.PAIRS[1]]
OUT = "read_id string, ref_start int, ref_end int, chr string, pos int, strand string, file_name string, kmer array<int>, signal array<float>"


def motif_places(ref: np.ndarray, kind: str, loc: int) -> np.ndarray:
    """Offsets of a motif in a sequence of ASCII codes."""
    n, hit = len(sq.motif_set(kind)[0]), None
    for m in sq.motif_set(kind):
        same = np.ones(max(len(ref) - n + 1, 0), bool)
        for j, c in enumerate(m):
            same &= ref[j : len(ref) - n + 1 + j] == ord(c)
        hit = same if hit is None else hit | same
    return np.flatnonzero(hit) + loc


def read_features(r, k: int, kind: str, loc: int, wanted: np.ndarray | None, round_digits: int | None, std_mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """pos[n], kmer[n, k], signal[n, k * 19] of the sites of one read whose window lies inside its reference. A read whose moves, signal
    or letters don't fit its alignment has none."""
    ref = np.frombuffer(r.ref_seq.encode("latin-1", "replace"), np.uint8)
    ref = ref if r.is_forward else _COMPLEMENT[ref[::-1]]
    half = (k - 1) // 2
    at = motif_places(ref, kind, loc)
    at = at[(at >= half) & (at + half < len(ref))]
    pos = r.ref_start + at if r.is_forward else r.ref_end - 1 - at
    if wanted is not None:
        keep = np.isin(pos, wanted)
        at, pos = at[keep], pos[keep]
    codes = _CODES[ref]
    if not len(at) or (codes < 0).any():
        return None
    x = sg.np_normalise(np.asarray(r.signal), r.offset, r.scale)
    if r.is_split:
        x = x[int(r.split) : int(r.split) + int(r.num_samples)]
    x = x[int(r.trim_start or 0) :]
    moves = np.asarray(r.moves)
    if len(x) < sg.POINTS or moves[-1] * r.stride > len(x):
        return None
    group, length = sg.np_regroup(x, moves, int(r.stride))
    qual = (np.frombuffer((r.qual or "").encode("latin-1"), np.uint8).astype(np.float32) - 33) / np.float32(60)
    qual = qual if r.is_forward else qual[::-1]
    start = r.q_start if r.is_forward else len(r.seq) - r.q_end
    query = sg.np_ref_to_query(r.ops, r.lens, r.is_forward)[:-1] + start
    if len(query) != len(ref) or (len(query) and query.max() >= min(len(group), len(qual))):
        return None
    signal, mean = group[query], group.mean(1, dtype=np.float32)[query]
    std = mean if std_mode == "compat" else group.std(1, dtype=np.float32)[query]
    stats = np.concatenate([mean[:, None], std[:, None], length[query, None].astype(np.float32), qual[query, None], signal], 1, dtype=np.float32)
    window = at[:, None] + np.arange(-half, half + 1)
    rows = stats[window].reshape(len(at), -1)
    rows = np.round(rows, round_digits) if round_digits is not None else rows
    return pos, codes[window].astype(np.int32), rows.astype(np.float32)


def _slices(column: pa.Array, field: str | None = None):
    """i -> the i-th list of a column as an array."""
    ends, values = column.offsets.to_numpy(), column.values.field(field) if field else column.values
    values = values.to_numpy(zero_copy_only=False)
    return lambda i: values[ends[i] : ends[i + 1]]


def _lists(rows: np.ndarray) -> pa.Array:
    """An array [n, width] as n lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


_PLAIN = ("read_id", "ref_start", "ref_end", "chr", "is_forward", "file_name", "ref_seq", "seq", "qual", "q_start", "q_end", "stride", "offset", "scale", "is_split", "split", "num_samples", "trim_start")


_LEDGER = pa.schema([("read_id", pa.string()), ("file_name", pa.string()), ("reason", pa.string())])


def _kernel(k, kind, loc, round_digits, std_mode, labelled, ledger=None, store=None):
    """ledger: a folder for the reads that come to nothing, a file a task; without one they are let go. store: a folder of refstore.write(), if
    the reads don't bring their reference along."""
    kept = ("read_id", "ref_start", "ref_end", "chr")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost: list[tuple] = []
        bases = refstore.Store(store) if store else None
        for batch in batches:
            signal, moves, ops, lens = (_slices(batch.column(c), f) for c, f in (("signal", None), ("moves", None), ("cigar", "op"), ("cigar", "len")))
            wanted = _slices(batch.column("wanted")) if labelled else None
            gone = batch.column("dropped").to_pylist() if ledger else None
            for i, plain in enumerate(batch.select([c for c in _PLAIN if c in batch.schema.names]).to_pylist()):
                why = gone[i] if gone else None
                if bases and not why:
                    plain["ref_seq"] = bases.cut(plain["chr"], plain["ref_start"], plain["ref_end"])
                    why = None if plain["ref_seq"] else "no reference"
                if why:
                    lost.append((plain["read_id"], plain["file_name"], why))
                    continue
                r = SimpleNamespace(**plain, signal=signal(i), moves=moves(i), ops=ops(i), lens=lens(i))
                made = read_features(r, k, kind, loc, wanted(i) if labelled else None, round_digits, std_mode)
                if made is not None and len(made[0]):
                    pos, kmer, rows = made
                    same = [pa.array([plain[c]] * len(pos), batch.schema.field(c).type) for c in kept]
                    more = [pa.array(pos.astype(np.int32)), pa.array(["+" if r.is_forward else "-"] * len(pos)), pa.array([r.file_name] * len(pos), pa.string())]
                    yield pa.RecordBatch.from_arrays([*same, *more, _lists(kmer), _lists(rows)], [*kept, "pos", "strand", "file_name", "kmer", "signal"])
                elif ledger:
                    lost.append((plain["read_id"], plain["file_name"], "kernel" if _has_site(r, k, kind, loc) else "no site"))
        if lost and ledger:
            _write_ledger(ledger, lost)

    return run


def _has_site(r, k: int, kind: str, loc: int) -> bool:
    """Whether a read's reference has a site with a whole window."""
    ref, half = np.frombuffer(r.ref_seq.encode("latin-1", "replace"), np.uint8), (k - 1) // 2
    at = motif_places(ref if r.is_forward else _COMPLEMENT[ref[::-1]], kind, loc)
    return bool(((at >= half) & (at + half < len(ref))).any())


def _write_ledger(folder: str, lost: list[tuple]) -> None:
    """One file for the task's partition, whichever attempt writes it."""
    task = TaskContext.get()
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, f"part-{task.partitionId():05d}.parquet")
    pq.write_table(pa.Table.from_arrays([pa.array(c, pa.string()) for c in zip(*lost, strict=True)], schema=_LEDGER), draft := f"{folder}/.{task.taskAttemptId()}.tmp")
    os.replace(draft, target)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """read_id, file_name, reason of the reads that site_features() has written aside."""
    return spark.read.schema("read_id string, file_name string, reason string").parquet(folder)


def site_features(
    alignments: DataFrame, raw_reads: DataFrame, reference: DataFrame | str, motif: str = "CG", loc: int = 0, k: int = 51, labels: DataFrame | None = None,
    round_digits: int | None = None, std_mode: str = "compat", exclude_flags: int = 0, match_ops: tuple[int, ...] = (0,), gates: dict | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """Features of each (read, motif site): k base codes, and for each of k bases mean, "std" (the mean again in the mode `compat`), samples,
    quality, 15 samples.

    With labels (chr, pos, label), only their sites, and a label; reads without any are dropped before anything else is joined. Sites meet
    the reads' places (chr, ref_start, ref_end) alone, in bins of about a read's length, and the reads then get the list of theirs.
    Gates run before the joins; the kernel sees a read once and returns its sites. reference: a table, or the folder of refstore.write(), from which
    the kernel cuts each read's bases itself.

    With a ledger (a folder that the executors share; not with labels), each read that has no features is written there with the reason, one of
    reads.REASONS, by the tasks that make the features, in the same pass; kept and dropped reads are then all of the input's."""
    sq.check_odd(k)
    sq.motif_set(motif)
    store = reference if isinstance(reference, str) else None
    plain = [c for c in _PLAIN if c != "ref_seq" or not store]
    if ledger:
        if labels is not None:
            raise ValueError("a ledger is kept without labels only")
        whole = reads.join_all(reads.dropped(alignments, exclude_flags, match_ops=match_ops, **(gates or {})), raw_reads, None if store else reference)
        return whole.select(*plain, "signal", "moves", "cigar", "dropped").mapInArrow(_kernel(k, motif, loc, round_digits, std_mode, False, ledger, store), OUT)
    a = reads.quality_gate(reads.with_moves(reads.usable(alignments, exclude_flags)), match_ops=match_ops, **(gates or {}))
    if labels is not None:
        a = a.hint("merge").join(wanted_sites(a, labels), ["chr", "ref_start", "ref_end"])
    joined = reads.join_signals(a if store else reads.join_reference(a, reference), raw_reads)
    needed = [*plain, "signal", "moves", "cigar", *(["wanted"] if labels is not None else [])]
    made = joined.filter("signal is not null and cigar is not null").select(needed).mapInArrow(_kernel(k, motif, loc, round_digits, std_mode, labels is not None, None, store), OUT)
    return made if labels is None else reads.label_sites(made, labels)


def wanted_sites(a: DataFrame, labels: DataFrame, span: int = 16_384) -> DataFrame:
    """chr, ref_start, ref_end of alignments, each place once -> the same with wanted, the positions of labels (chr, pos) on it; places
    without any are left out."""
    places = a.select("chr", "ref_start", "ref_end").distinct()
    bins = places.withColumn("_bin", F.explode(F.sequence(F.expr(f"ref_start div {span}"), F.expr(f"ref_end div {span}"))))
    spots = labels.select(F.col("chr"), F.col("pos").alias("_pos"), F.expr(f"pos div {span}").alias("_bin")).distinct()
    hit = bins.hint("merge").join(spots, ["chr", "_bin"]).filter("_pos >= ref_start and _pos < ref_end")
    return hit.groupBy("chr", "ref_start", "ref_end").agg(F.collect_list("_pos").alias("wanted"))


def training_matrix(features: DataFrame, chr_width: int) -> DataFrame:
    """file_name, info (fixed width), features: base codes, signal, label in one array."""
    info = text.fixed_site_info(F.col("read_id"), F.col("ref_start"), F.col("ref_end"), F.col("chr"), F.col("pos"), F.col("strand"), chr_width)
    return features.select("file_name", info.alias("info"), F.concat(F.col("kmer").cast("array<float>"), "signal", F.array(F.col("label").cast("float"))).alias("features"))


def split_features(matrix: DataFrame, k: int) -> DataFrame:
    """features of 20 k + 1 values -> kmer, signal (k * 19), label."""
    f = F.col("features")
    return matrix.filter(F.size("features") == 20 * k + 1).withColumns({"kmer": F.slice(f, 1, k).cast("array<int>"), "signal": F.slice(f, k + 1, 19 * k), "label": F.element_at(f, -1).cast("int")})


def crop_features(matrix: DataFrame, k: int, k_new: int) -> DataFrame:
    """Rows of k bases -> rows of their k_new middle bases."""
    cut = (k - k_new) // 2
    f = F.col("features")
    return matrix.withColumn("features", F.concat(F.slice(f, cut + 1, k_new), F.slice(f, k + cut * PER_BASE + 1, k_new * PER_BASE), F.slice(f, -1, 1)))
