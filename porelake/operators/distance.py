"""Correlation of calls within reads, by distance; and smoothing of the curve."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Places of a stretch; what a task holds at once lies over two of them.
STRETCH = 1 << 16


def _add_lags(out: np.ndarray, a1, a0, b1, b0, p: np.ndarray, q: np.ndarray, same: bool) -> None:
    """Ones and zeros at the places p (a) and q (b) of stretches: adds to out, int64[3, 2 * width - 1], the pairs of p and q by number of ones,
    at the differences q - p from -(width - 1). same: p and q are one stretch, of which each two places are a pair once."""
    width = (out.shape[1] + 1) // 2
    if len(p) * len(q) <= 1 << 20 or max((a1 + a0) @ (a1 + a0), (b1 + b0) @ (b1 + b0)) >= 1 << 44:  # few, or too large for the transform
        for lo in range(0, len(p), step := max(1, (1 << 20) // max(len(q), 1))):
            apart = q[None] - p[lo : lo + step, None]
            x1, x0 = (np.broadcast_to(x[lo : lo + step, None], apart.shape) for x in (a1, a0))
            y1, y0 = (np.broadcast_to(y, apart.shape) for y in (b1, b0))
            if same:
                keep = apart > 0
                apart, x1, x0, y1, y0 = (v[keep] for v in (apart, x1, x0, y1, y0))
            at = (apart + width - 1).ravel()
            for k, n in enumerate((x0 * y0, x0 * y1 + x1 * y0, x1 * y1)):
                np.add.at(out[k], at, n.ravel())
    else:
        n = 2 * width
        f1, f0, g1, g0 = (np.fft.rfft(np.bincount(x, y, n)) for x, y in ((p, a1), (p, a0), (q, b1), (q, b0)))
        for k, x in enumerate((f0.conj() * g0, f0.conj() * g1 + f1.conj() * g0, f1.conj() * g1)):
            c = np.rint(np.fft.irfft(x, n)).astype(np.int64)
            out[k, width:] += c[1:width]
            if not same:
                out[k, :width] += np.concatenate([c[width + 1 :], c[:1]])
    if same:
        out[:, width - 1] += (a0 * (a0 - 1) // 2).sum(), (a0 * a1).sum(), (a1 * (a1 - 1) // 2).sum()


def _correlate(keys: list[str], width: int, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # by how many stretches apart
        held: list[list[np.ndarray]] = []

        def close() -> None:
            i, j, pos, one, zero = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            apart = int(j[0] - i[0])
            left = pos // width == i[0]
            right = left if not apart else ~left
            p, q = pos[left] - i[0] * width, pos[right] - j[0] * width
            if apart not in sums:
                sums[apart] = np.zeros((3, 2 * width - 1), np.int64)
            _add_lags(sums[apart], one[left], zero[left], one[right], zero[right], p, q, not apart)

        def flush() -> pa.RecordBatch:
            parts = []
            for apart, c in sums.items():
                at = np.flatnonzero(c.any(0))
                parts.append((at + apart * width - (width - 1), *c[:, at]))
            sums.clear()
            d, *c = (np.concatenate(x) for x in zip(*parts, strict=True))
            keep = slice(None) if most is None else d <= most
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (d, *c)], ["distance", "c0", "c1", "c2"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            of = [batch.column(k) for k in (*keys, "_i", "_j")]
            new = np.zeros(batch.num_rows, bool)
            for c in of:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            first = [c[0].as_py() for c in of]
            new[0] = last is not None and first != last
            last = [c[-1].as_py() for c in of]
            x = [batch.column(c).to_numpy() for c in ("_i", "_j", "pos", "one", "zero")]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if new[a] and held:
                    close()
                if a < b:
                    held.append([c[a:b] for c in x])
            if len(sums) >= 8:
                yield flush()
        if held:
            close()
        if sums:
            yield flush()

    return run


def pair_counts(calls: DataFrame, max_distance: int | None = None, by_chrom: bool = False, width: int = STRETCH) -> DataFrame:
    """calls(read_name, pos, prob 0 or 1) -> distance, n, c0, c1, c2: pairs of calls of a read by distance and number of ones.

    Calls of a read at one place are counted first. A read's ones and zeros are then vectors over its places, and the counts at all
    distances their correlations, by Fourier transform (pair by pair where there are few); no pair is a row. A vector is cut into
    stretches of `width` places, and each two of a read's stretches (that lie near enough, with max_distance) are a group of their own, so a
    read of any length is spread over tasks that hold two stretches at a time. Calls with a null read, chromosome, place or call are left out."""
    keys = ["read_name", "chrom"] if by_chrom else ["read_name"]
    there = calls.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("prob").cast("long").alias("prob")).filter(" and ".join(f"{c} is not null" for c in (*keys, "pos", "prob")))
    spots = there.groupBy(*keys, "pos").agg(F.sum("prob").alias("one"), F.sum(1 - F.col("prob")).alias("zero")).withColumn("_s", F.floor(F.col("pos") / width).cast("long"))
    ends = there.groupBy(*keys).agg(*(F.floor(f("pos") / width).cast("long").alias(n) for f, n in ((F.min, "_lo"), (F.max, "_hi"))))
    span = ends.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 0
    apart = span if max_distance is None else min(span, max_distance // width + 1)
    pair = lambda i, j: F.struct(i.alias("_i"), j.alias("_j"))
    if not apart:
        dealt = spots.select("*", F.col("_s").alias("_i"), F.col("_s").alias("_j"))
    else:  # reads over several stretches; their number is at most calls / 2
        spots = spots.join(ends.filter("_lo < _hi"), keys, "left").withColumns({"_lo": F.coalesce("_lo", "_s"), "_hi": F.coalesce("_hi", "_s")})
        near = lambda a, b: F.sequence(F.greatest(a, F.col("_s") - apart), F.least(b, F.col("_s") + apart))
        met = F.explode(F.transform(near(F.col("_lo"), F.col("_hi")), lambda o: pair(F.least(o, F.col("_s")), F.greatest(o, F.col("_s")))))
        dealt = spots.select(*keys, "pos", "one", "zero", met.alias("_p")).select(*keys, "pos", "one", "zero", "_p.*")
    group = [*keys, "_i", "_j"]
    counted = dealt.select(*group, "pos", "one", "zero").repartition(*group).sortWithinPartitions(*group).mapInArrow(_correlate(keys, width, max_distance), "distance long, c0 long, c1 long, c2 long")
    out = counted.groupBy("distance").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("c0", "c1", "c2")))
    return out.withColumn("n", F.col("c0") + F.col("c1") + F.col("c2")).filter("n > 0").select("distance", "n", "c0", "c1", "c2")


def correlation(counts: DataFrame) -> DataFrame:
    """Adds FM = (c1 + 2 c2) / 2n, FMM = c2 / n and correlation (FMM - FM ^ 2) / (FM (1 - FM)), null where that divides by 0."""
    fm = (F.col("c1") + 2 * F.col("c2")) / (2 * F.col("n")).cast("double")
    out = counts.withColumn("FM", fm).withColumn("FMM", F.col("c2") / F.col("n").cast("double"))
    return out.withColumn("correlation", F.try_divide(F.col("FMM") - F.col("FM") * F.col("FM"), F.col("FM") * (1 - F.col("FM"))))


def top_distances(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("distance").limit(n)


def smoothing_weights(window: int = 51, order: int = 3) -> np.ndarray:
    """H[i, j]: weight of the j-th of `window` points in the least-squares polynomial's value at the i-th."""
    x = np.arange(window) - window // 2
    v = np.vander(x / max(window // 2, 1), order + 1)
    return v @ np.linalg.pinv(v)


def smooth(curve: DataFrame, value: str = "correlation", window: int = 51, order: int = 3) -> DataFrame:
    """curve(distance, value) -> distance, value, smoothed: Savitzky-Golay, the first and last half windows by the polynomial fitted to the
    outermost window; null for curves shorter than the window. A null value weighs nothing.

    The curve has a row for each distance, at most a read's length, so its order is one window; it is made once."""
    if window % 2 == 0 or order >= window:
        raise ValueError("the window must be odd and larger than the order")
    h, half = smoothing_weights(window, order), window // 2
    by, whole = Window.orderBy("distance"), Window.orderBy("distance").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = Window.orderBy("distance").rowsBetween(-half, half)
    y = F.coalesce(value, F.lit(0.0))
    seen = curve.select("distance", value, y.alias("_y")).select(
        "distance", value, (F.row_number().over(by) - 1).alias("_at"), F.count(F.lit(1)).over(whole).alias("_n"), F.collect_list("_y").over(around).alias("_near")
    )
    at = lambda place: F.max(F.when(F.col("_at") == place, F.col("_near"))).over(whole)
    seen = seen.withColumn("_first", at(F.lit(half))).withColumn("_last", at(F.col("_n") - 1 - half))
    dot = lambda weights, values: F.aggregate(F.zip_with(weights, values, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    table = F.lit(h.tolist())
    smoothed = (
        F.when(F.col("_n") < window, None)
        .when(F.col("_at") < half, dot(F.get(table, F.col("_at")), F.col("_first")))
        .when(F.col("_at") >= F.col("_n") - half, dot(F.get(table, (F.col("_at") - F.col("_n") + window).cast("int")), F.col("_last")))
        .otherwise(dot(F.lit(h[half].tolist()), F.col("_near")))
    )
    return seen.select("distance", value, smoothed.alias("smoothed"))


def islands(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal value in a group's order: adds island, from 0."""
    w = Window.partitionBy(*group).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("_c", changed).withColumn("island", (F.sum("_c").over(w) - 1).cast("bigint")).drop("_c")
