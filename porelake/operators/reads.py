"""Reads: gates, and joins with signals, reference and truth sites."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..sources import fasta

MIN_MAPQ, MIN_COVERAGE, MIN_IDENTITY = 20, 0.8, 0.8


def strand(is_forward: Column) -> Column:
    return F.when(is_forward, "+").otherwise("-")


def read_start(is_forward: Column, q_start: Column, q_end: Column, seq_len: Column) -> Column:
    """Where the aligned part starts, in the order of sequencing."""
    return F.when(is_forward, q_start).otherwise(seq_len - q_end)


def absolute_position(is_forward: Column, ref_start: Column, ref_end: Column, offset: Column) -> Column:
    return F.when(is_forward, ref_start + offset).otherwise(ref_end - 1 - offset)


def usable(a: DataFrame, exclude_flags: int = 0) -> DataFrame:
    """Mapped reads with a sequence; exclude_flags also leaves out reads with any of these flag bits."""
    a = a.filter(F.col("is_mapped") & F.col("chr").isNotNull() & (F.length("seq") > 0))
    return a.filter(F.col("flag").bitwiseAND(exclude_flags) == 0) if exclude_flags else a


def _good(mapq: int, coverage: float, identity: float) -> Column:
    """Whether a row with _sums (matches, aligned) is of enough mapping quality, coverage and identity."""
    match, aligned, q_len, nm = F.col("_sums.s0").cast("double"), F.col("_sums.s1").cast("double"), F.col("q_len"), F.coalesce("nm", F.lit(-1))
    covered = F.when(q_len == 0, -1.0).otherwise(F.try_divide(match, q_len.cast("double")))
    alike = F.when(nm == -1, 0.0).otherwise(F.coalesce(F.try_divide(match - nm, aligned), F.lit(-1.0)))
    return (F.col("mapq") >= mapq) & (covered >= coverage) & (alike >= identity)


def _with_sums(a: DataFrame, match_ops: tuple[int, ...]) -> DataFrame:
    return a.select("*", F.inline(F.array(F.struct(cg.op_sums(F.col("cigar"), match_ops, tuple({*match_ops, 1, 2})).alias("_sums")))))


def quality_gate(a: DataFrame, mapq: int = MIN_MAPQ, coverage: float = MIN_COVERAGE, identity: float = MIN_IDENTITY, match_ops: tuple[int, ...] = (0,)) -> DataFrame:
    """Reads of enough mapping quality, coverage and identity. Native expressions, so the filter goes below joins, that of the mapping
    quality into the scan; compared in double precision. Alignments with nothing aligned have no identity and are left out.

    The cigar's sums come out of a generator of one row: a filter isn't pushed below it, and so doesn't repeat what makes the cigar."""
    return _with_sums(a.filter(F.col("mapq") >= mapq), match_ops).filter(_good(mapq, coverage, identity)).drop("_sums")


#: Why a read has no features, in the order in which it is looked at.
REASONS = ("unmapped", "no sequence", "excluded flag", "low quality", "no moves", "no reference", "no file", "no read", "empty signal", "kernel", "no site")


def dropped(a: DataFrame, exclude_flags: int = 0, mapq: int = MIN_MAPQ, coverage: float = MIN_COVERAGE, identity: float = MIN_IDENTITY, match_ops: tuple[int, ...] = (0,)) -> DataFrame:
    """All alignments, with `dropped`: which of the gates a read doesn't pass, null if it passes all."""
    moves = F.col("stride").isNotNull() & (F.col("stride") != -1) & (F.size("moves") > 0)
    fails = lambda c: ~F.coalesce(c, F.lit(False))
    why = F.when(fails(F.col("is_mapped") & F.col("chr").isNotNull()), REASONS[0]).when(fails(F.length("seq") > 0), REASONS[1]).when(F.col("flag").bitwiseAND(exclude_flags) != 0, REASONS[2])
    return _with_sums(a, match_ops).withColumn("dropped", why.when(fails(_good(mapq, coverage, identity) & F.col("cigar").isNotNull()), REASONS[3]).when(fails(moves), REASONS[4])).drop("_sums")


def join_all(a: DataFrame, raw_reads: DataFrame, reference: DataFrame | None) -> DataFrame:
    """dropped() alignments, all of them, with ref_seq and signal where there are any, and the reason where there is none. The joins are those
    of join_reference() and join_signals(), but outer: rows that are dropped already meet nothing, under keys of their own. Without a reference, only the signals are joined."""
    live = F.col("dropped").isNull()
    a = a if reference is None else join_reference(a, reference, keep=True).withColumn("dropped", F.when(live & (F.length(F.coalesce("ref_seq", F.lit(""))) == 0), REASONS[5]).otherwise(F.col("dropped")))
    files = raw_reads.select(F.col("file_name").alias("_file")).distinct().withColumn("_known", F.lit(True))
    raw = raw_reads.select(F.col("file_name").alias("_file"), F.col("read_id").alias("_read"), "signal", "offset", "scale", F.lit(True).alias("_found"))
    own = lambda c, other: F.when(live, c).otherwise(F.concat(F.lit("\0"), other))
    keyed = signal_key(a).withColumn("_read", own(F.col("signal_read_id"), F.coalesce("read_id", F.lit("")))).withColumn("_file", F.when(live, F.col("file_name")).otherwise(F.coalesce("file_name", F.lit(""))))
    met = keyed.join(raw, ["_file", "_read"], "left").join(files, "_file", "left")
    why = F.when(F.col("dropped").isNotNull(), F.col("dropped")).when(F.col("_known").isNull(), REASONS[6]).when(F.col("_found").isNull(), REASONS[7])
    return met.withColumn("dropped", why.when(F.coalesce(F.size("signal"), F.lit(0)) <= 0, REASONS[8])).drop("_file", "_read", "_known", "_found")


def with_moves(a: DataFrame) -> DataFrame:
    return a.filter(F.col("stride").isNotNull() & (F.col("stride") != -1) & (F.size("moves") > 0))


def signal_key(a: DataFrame) -> DataFrame:
    return a.withColumn("signal_read_id", F.when(F.col("is_split"), F.col("parent_read")).otherwise(F.col("read_id")))


def join_signals(a: DataFrame, raw_reads: DataFrame) -> DataFrame:
    """Alignments with the signal of their read, or of its parent, in their file: one shuffle by (file_name, read); order of the input
    doesn't matter. Reads without a signal are left out."""
    raw = raw_reads.select("file_name", F.col("read_id").alias("signal_read_id"), "signal", "offset", "scale")
    return signal_key(a).hint("merge").join(raw, ["file_name", "signal_read_id"])


#: Bytes of a row of a broadcast table beside its letters: lengths, pointers and its place in the hash table.
_ROW = 96


def join_reference(a: DataFrame, reference: DataFrame, broadcast_bytes: int = 256 << 20, keep: bool = False) -> DataFrame:
    """Adds ref_seq, the reference under each alignment; alignments without any are left out, or kept if `keep`.

    A reference whose measured size, rows' own bytes included, is up to broadcast_bytes goes to all executors. A larger one is cut into chunks that overlap by the
    longest alignment, so that a read lies in the chunk of its start and is shuffled once, by (chr, chunk). Sequences are cut as bytes, in
    time that doesn't depend on the place."""
    size = reference.agg(F.sum(F.length("seq") + F.length("chr") + _ROW)).first()[0] or 0
    cut = lambda seq, at: F.substring(seq, (at + 1).cast("int"), F.col("ref_len")).cast("string")
    how, some = ("left", lambda d: d) if keep else ("inner", lambda d: d.filter(F.length("ref_seq") > 0))
    if size <= broadcast_bytes:
        names = F.broadcast(reference.select("chr", F.col("seq").cast("binary").alias("_ref")))
        return some(a.join(names, "chr", how).withColumn("ref_seq", cut(F.col("_ref"), F.col("ref_start"))).drop("_ref"))
    longest = a.agg(F.max("ref_len")).first()[0] or 1
    chunk = max(1_000_000, longest)
    pieces = fasta.chunked(reference, chunk, longest).select("chr", "chunk", F.col("at").alias("_at"), F.col("seq").cast("binary").alias("_ref"))
    met = a.withColumn("chunk", F.expr(f"cast(ref_start div {chunk} as int)")).join(pieces, ["chr", "chunk"], how)
    return some(met.withColumn("ref_seq", cut(F.col("_ref"), F.col("ref_start") - F.col("_at"))).drop("chunk", "_at", "_ref"))


def truth_labels(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """pos and neg (chr, pos) -> chr, pos, label: 1 for sites of pos, 0 for those of neg alone."""
    both = pos.select("chr", "pos", F.lit(1).alias("label")).unionByName(neg.select("chr", "pos", F.lit(0).alias("label")))
    return both.groupBy("chr", "pos").agg(F.max("label").alias("label"))


def label_sites(sites: DataFrame, labels: DataFrame) -> DataFrame:
    """Sites of the truth sets, with their label. Both sides are shuffled: labels that come of another table are many more than their
    estimated size says, and would all go through the driver."""
    return sites.hint("merge").join(labels, ["chr", "pos"])


def counted(df: DataFrame, name: str, seen: Observation, **more: Column) -> DataFrame:
    """The same rows; the action that runs them counts them into the observation, as `name`, with further aggregates."""
    return df.observe(seen, F.count(F.lit(1)).alias(name), *(c.alias(n) for n, c in more.items()))


def accessors(raw_reads: DataFrame) -> DataFrame:
    return raw_reads.select("file_name", "read_id", F.size("signal").alias("n_samples"), "offset", "scale")


def read_names(a: DataFrame) -> DataFrame:
    return a.select("read_id").distinct()


def semi_join_names(calls: DataFrame, names: DataFrame) -> DataFrame:
    """Calls of the named reads; names are compared whole."""
    return calls.join(names.select("read_id"), "read_id", "left_semi")


def sampled(key: Column, fraction: float) -> Column:
    """Whether a key's hash is in the first `fraction` of its range."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") < int(round(fraction * 2**32))


def downsample(df: DataFrame, fraction: float, key: str = "read_id") -> DataFrame:
    """Rows of the sampled reads: a read stays or goes whole, in any run, and a smaller fraction's reads are among a larger's."""
    return df.filter(sampled(F.col(key), fraction))


def coverage_series(df: DataFrame, total: float, levels: tuple[int, ...] = (5, 10, 15, 20, 25, 30)) -> dict[int, DataFrame]:
    """Downsampled tables by coverage level, of data of `total` coverage."""
    return {c: downsample(df, min(1.0, c / total)) for c in levels}
