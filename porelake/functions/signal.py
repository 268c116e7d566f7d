"""Signal functions: native forms for columns, numpy forms for kernels that see a read at a time."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = 15
MAD_SCALE = 0.674489


def calibrate(signal: Column, offset: Column, scale: Column) -> Column:
    """Picoampere: scale * (raw + offset)."""
    return F.transform(signal.cast("array<double>"), lambda x: scale * (x + offset))


def lower_median(values: Column) -> Column:
    """The lower of the two middle values; null for the empty array."""
    return F.get(F.array_sort(values), F.floor((F.size(values) - 1) / F.lit(2)).cast("int"))


def mad_normalise(values: Column) -> Column:
    """(x - median) / (MAD / 0.674489), lower medians; values as they are where the MAD is 0."""
    centred = lambda v, m: F.transform(v, lambda x: x - m)
    mad = lambda v, m: lower_median(F.transform(v, lambda x: F.abs(x - m)))
    return F.transform(
        F.transform(F.array(values), lambda v: F.struct(v.alias("v"), lower_median(v).alias("m"))),
        lambda s: F.when(mad(s["v"], s["m"]) == 0, s["v"]).otherwise(
            F.transform(F.array(mad(s["v"], s["m"]) / F.lit(MAD_SCALE)), lambda d: F.transform(centred(s["v"], s["m"]), lambda x: x / d))[0]
        ),
    )[0]


def read_slice(signal: Column, is_split: Column, split: Column, num_samples: Column, trim_start: Column) -> Column:
    """A split read's part of its parent's signal, or the whole; then without the trimmed start."""
    part = F.when(is_split, F.slice(signal, split + 1, num_samples)).otherwise(signal)
    return F.slice(part, trim_start + 1, F.greatest(F.size(part) - trim_start, F.lit(0)))


def move_lengths(moves: Column, stride: Column) -> Column:
    """Samples of each base: differences of neighbouring moves, times the stride."""
    return F.transform(F.slice(moves, 2, F.greatest(F.size(moves) - 1, F.lit(0))), lambda m, i: (m - F.get(moves, i)) * stride)


def regroup(signal: Column, moves: Column, stride: Column, points: int = POINTS) -> Column:
    """Exactly `points` samples for each base: a longer stretch is cropped to its centre, a shorter is widened into its neighbours and
    kept inside the signal."""
    size = F.size(signal)

    def start(a: Column, b: Column) -> Column:
        n = b - a
        wide = a - F.floor((points - n) / F.lit(2)).cast("int")
        wide = F.when(wide < 0, 0).otherwise(wide)
        wide = F.when(wide + points > size, size - points).otherwise(wide)
        return F.when(n < points, wide).when(n > points, a + F.floor((n - points) / F.lit(2)).cast("int")).otherwise(a)

    ends = F.slice(moves, 2, F.greatest(F.size(moves) - 1, F.lit(0)))
    return F.transform(ends, lambda m, i: F.slice(signal, start(F.get(moves, i) * stride, m * stride) + 1, points))


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def phred(qual: Column, is_forward: Column) -> Column:
    """(ASCII - 33) / 60 for each base, in the order of sequencing."""
    q = F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: (F.ascii(c) - 33) / F.lit(60.0))
    return F.when(is_forward, q).otherwise(F.reverse(q))


def move_table(tag: Column) -> Column:
    """Numbers of an mv tag (stride, then 0 or 1) -> struct(stride, moves: places of the ones, then the number of places)."""
    bits = F.slice(tag, 2, F.greatest(F.size(tag) - 1, F.lit(0)))
    ones = F.filter(F.transform(bits, lambda x, i: F.when(x == 1, i)), lambda x: x.isNotNull())
    return F.struct(F.get(tag, F.lit(0)).alias("stride"), F.concat(ones, F.array(F.size(bits))).alias("moves"))


def rect(values: Column, n: int) -> Column:
    """n values: zeros around a shorter array, the centre of a longer."""
    pad = (n - F.size(values)) / F.lit(2)
    short = F.concat(F.array_repeat(F.lit(0.0), F.floor(pad).cast("int")), values, F.array_repeat(F.lit(0.0), F.ceil(pad).cast("int")))
    return F.when(F.size(values) < n, short).otherwise(F.slice(values, F.greatest(F.floor((F.size(values) - n) / F.lit(2)).cast("int"), F.lit(0)) + 1, n))


def np_normalise(raw: np.ndarray, offset: float, scale: float) -> np.ndarray:
    pa = np.float32(scale) * (raw.astype(np.float32) + np.float32(offset))
    if not len(pa):
        return pa
    mid = (len(pa) - 1) // 2
    med = np.partition(pa, mid)[mid]
    mad = np.partition(np.abs(pa - med), mid)[mid] / np.float32(MAD_SCALE)
    return pa if mad == 0 else (pa - med) / mad


def np_regroup(signal: np.ndarray, moves: np.ndarray, stride: int, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """(float32[bases, points], lengths); a signal shorter than `points` has no groups."""
    edges = np.asarray(moves, np.int64) * stride
    length = np.diff(edges)
    spare = np.abs(points - length) // 2
    start = edges[:-1] + np.where(length < points, -spare, np.where(length > points, spare, 0))
    short = length < points
    start = np.where(short, np.minimum(np.maximum(start, 0), len(signal) - points), start)
    return signal[start[:, None] + np.arange(points)], length


def np_ref_to_query(ops: np.ndarray, lens: np.ndarray, forward: bool) -> np.ndarray:
    if not forward:
        ops, lens = ops[::-1], lens[::-1]
    on_ref, on_query = np.isin(ops, (0, 2, 3, 7, 8)), np.isin(ops, (0, 1, 7, 8))
    q = np.cumsum(np.where(on_query, lens, 0))
    starts = (q - np.where(on_query, lens, 0))[on_ref]
    n, aligned = lens[on_ref], on_query[on_ref]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.append(np.repeat(starts, n) + within * np.repeat(aligned, n), q[-1] if len(q) else 0)
