"""Sites: aggregation of calls, confident calls, strand merge, interval overlap."""

import contextlib
import subprocess
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as sq


def binarise(p: Column, threshold: float, inclusive: bool = False) -> Column:
    """1 above the threshold (at it too, if inclusive), else 0."""
    return (p >= F.lit(threshold) if inclusive else p > F.lit(threshold)).cast("int")


def confident(calls: DataFrame, t: float, p: str = "prob") -> DataFrame:
    """Calls with p < 1 - t or p >= t."""
    return calls.filter((F.col(p) < F.lit(1 - t)) | (F.col(p) >= F.lit(t)))


def aggregate_sites(calls: DataFrame, threshold: float = 0.5, p: str = "prob", with_count: bool = False) -> DataFrame:
    """calls(chr, pos, p) -> chr, start, end, frequency in percent, methy, unmethy (and count). One partial and final aggregation."""
    one = binarise(F.col(p), threshold)
    out = calls.groupBy("chr", F.col("pos").alias("start")).agg(F.count(F.lit(1)).alias("count"), F.sum(one).alias("methy"))
    out = out.select("chr", "start", (F.col("start") + 1).alias("end"), (F.lit(100.0) * F.col("methy") / F.col("count")).alias("frequency"), "methy", (F.col("count") - F.col("methy")).alias("unmethy"), "count")
    return out if with_count else out.drop("count")


def _nested(d: DataFrame, base: int, levels: int) -> DataFrame:
    """Adds _level and _bin, the smallest bin that holds the whole interval: bins of a level are 8 times as wide as those below."""
    end = F.greatest("end", F.col("start") + 1) - 1
    at = lambda c, n: F.shiftright(c.cast("long"), base + 3 * n)
    level = F.coalesce(*(F.when(at(F.col("start"), n) == at(end, n), F.lit(n)) for n in range(levels - 1)), F.lit(levels - 1))
    shift = F.lit(base) + 3 * F.col("_level")
    return d.withColumn("_level", level).withColumn("_bin", F.call_function("shiftright", F.col("start").cast("long"), shift))


def overlaps(a: DataFrame, b: DataFrame, bin_size: int = 1024, levels: int = 12) -> DataFrame:
    """Pairs of intervals (chr, start, end) that overlap: chr, a_start, a_end, b_start, b_end, overlap, and b's other columns.

    Bins are nested: `levels` levels from bin_size (a power of 2) on, each 8 times as wide. An interval is in one bin, the smallest that
    holds it, whatever its length; two intervals that overlap are in bins of which one holds the other. So each interval meets those of
    its own bin and of the bins around it, at the levels that the other side has intervals in: two joins by equality, of a's bins with those around
    b's and the other way about. A bin that holds most of the rows is split by Spark's handling of skewed joins."""
    base = bin_size.bit_length() - 1
    if bin_size != 1 << base or base + 3 * (levels - 1) > 62:
        raise ValueError("bin_size must be a power of 2, and the highest level's bins at most 2 ** 62 wide")
    rest = [c for c in b.columns if c not in ("chr", "start", "end")]
    left = _nested(a.select("chr", "start", "end"), base, levels).withColumnsRenamed({"start": "a_start", "end": "a_end"})
    right = _nested(b.select("chr", "start", "end", *rest), base, levels).withColumnsRenamed({"start": "b_start", "end": "b_end"})
    here, there = (sorted(r[0] for r in d.select("_level").distinct().collect()) for d in (left, right))

    def around(d: DataFrame, wanted: list[int], own: bool) -> DataFrame:
        """An interval for each bin around its own (and its own), of the wanted levels."""
        up = [F.when((F.lit(n) >= F.col("_level")) if own else (F.lit(n) > F.col("_level")), F.struct(F.lit(n).alias("_level"), F.call_function("shiftright", F.col("_bin"), 3 * (F.lit(n) - F.col("_level"))).alias("_bin"))) for n in wanted]
        return d.select(*(c for c in d.columns if c not in ("_level", "_bin")), F.explode(F.array_compact(F.array(*up)) if up else F.array().cast("array<struct<_level: int, _bin: bigint>>")).alias("_x")).select("*", "_x.*").drop("_x")

    keys = ["chr", "_level", "_bin"]
    met = left.join(around(right, here, True), keys).unionByName(around(left, there, False).join(right, keys))
    met = met.filter("a_start < b_end and b_start < a_end")
    return met.withColumn("overlap", F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).select("chr", "a_start", "a_end", "b_start", "b_end", *rest, "overlap")


def _program(command: list[str], columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed: list[BaseException] = []
        with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8") as p:

            def feed() -> None:
                try:
                    for batch in batches:
                        rows = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
                        p.stdin.writelines("\t".join("" if v is None else str(v) for v in r) + "\n" for r in rows)
                except BrokenPipeError:
                    pass  # it has read enough
                except BaseException as e:
                    failed.append(e)
                finally:
                    with contextlib.suppress(BrokenPipeError):
                        p.stdin.close()

            feeder = threading.Thread(target=feed)
            feeder.start()
            held: list[str] = []
            for line in p.stdout:
                held.append(line.rstrip("\n"))
                if len(held) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(held)], ["line"])
                    held = []
            feeder.join()
        if failed:
            raise failed[0]
        if p.returncode:
            raise RuntimeError(f"{command[0]} ended with {p.returncode}")
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held)], ["line"])

    return run


def merge_by_program(motifs: DataFrame, sites: DataFrame, command: list[str]) -> DataFrame:
    """Lines (line) that a program of the user's makes of motifs (chr, start, end, id) and the sites (chr, start, end, frequency, methy, unmethy) on
    them, a merge of the user's own in place of merged().

    It reads tab-separated lines: the motif's four columns, the site's six, the bases that both have. Each task runs it once, over the whole
    motifs that were dealt to it, sorted by motif and site; so a motif's lines are never parted, and what is to be summed over motifs must be summed
    afterwards. A program that fails, fails the task. The executors must have it."""
    met = overlaps(motifs, sites.select("chr", "start", "end", "frequency", "methy", "unmethy"))
    columns = ["chr", "a_start", "a_end", "id", "b_chr", "b_start", "b_end", "frequency", "methy", "unmethy", "overlap"]
    met = met.withColumn("b_chr", F.col("chr")).withColumn("id", F.concat_ws(":", "chr", F.col("a_start").cast("string")))
    motif = ["chr", "a_start", "a_end"]
    dealt = met.select(columns).repartition(*motif).sortWithinPartitions(*motif, "b_start", "b_end")
    return dealt.mapInArrow(_program(command, columns), "line string")


def merge_strands(motifs: DataFrame, sites: DataFrame, width: int = 2, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Counts of the sites (chr, start, methy, unmethy) of each motif (chr, start, end) together.

    Motifs of fixed width make the overlap an equality: the sites of a motif are at start .. start + width - 1. `then` is applied to
    the joined rows (motif_start, motif_end, start, methy, unmethy) in place of the sums."""
    spots = motifs.select("chr", F.col("start").alias("motif_start"), F.col("end").alias("motif_end"), F.explode(F.sequence(F.col("start"), F.col("start") + width - 1)).alias("start"))
    rows = spots.join(sites.select("chr", "start", "methy", "unmethy"), ["chr", "start"])
    return then(rows) if then else merged(rows)


def merge_strands_by_overlap(motifs: DataFrame, sites: DataFrame) -> DataFrame:
    """The same for motifs of any width."""
    rows = overlaps(motifs, sites.select("chr", "start", "end", "methy", "unmethy"))
    return merged(rows.select("chr", F.col("a_start").alias("motif_start"), F.col("a_end").alias("motif_end"), "methy", "unmethy"))


def merged(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("chr", F.col("motif_start").alias("start"), F.col("motif_end").alias("end")).agg(F.sum("methy").alias("methy"), F.sum("unmethy").alias("unmethy"))
    return out.select("chr", "start", "end", (F.lit(100.0) * F.try_divide(F.col("methy"), F.col("methy") + F.col("unmethy"))).alias("frequency"), "methy", "unmethy")


def motif_bed(reference: DataFrame, kind: str = "CG") -> DataFrame:
    """chr, start, end, id (`chr:start`) of each motif of a reference."""
    n = len(sq.motif_set(kind)[0])
    rows = reference.select("chr", F.explode(sq.motif_offsets(F.upper("seq"), kind)).alias("start"))
    return rows.select("chr", "start", (F.col("start") + n).alias("end"), F.concat_ws(":", "chr", F.col("start").cast("string")).alias("id"))
