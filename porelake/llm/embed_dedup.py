"""Near-duplicates among embeddings, by tiles of int8 products.

Vectors are dealt into groups; each pair of groups is a cell, whose task multiplies their int8 codes in tiles. A vector's error of
quantisation bounds how far a product of codes is from the cosine, so most pairs are settled by their codes; only those that are
within the bounds of the threshold are computed in double precision. A cell returns counts of links and a spanning forest of its
links, not the links."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lookup, spread, stash, unstash
from .vectors import as_bytes, finite, grouped, in_cells

_TILE = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x[n, d] -> unit vectors u, int8 codes q, scales s with u ~ s * q, and bounds e >= |u - s * q|.

    Codes are held as float32: products of up to 1,040 dimensions are whole numbers below 2 ** 24, so float32 sums them exactly."""
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    s = np.maximum(np.abs(u).max(1), 1e-300) / 127
    q = np.rint(u / s[:, None])
    e = np.sqrt(((u - s[:, None] * q) ** 2).sum(1)) + 1e-12
    return u, q.astype(np.float32), s, e


def tile_links(a, b, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows i of a and j of b (i < j if they are the same tile) whose cosine is >= threshold; and how many were recomputed.

    |u.v - s_u s_v q_u.q_v| <= e_u |s_v q_v| + e_v, as u.v = s_u q_u . s_v q_v + (u - s_u q_u) . s_v q_v + u . (v - s_v q_v)."""
    (ua, qa, sa, ea), (ub, qb, sb, eb) = a, b
    if qa.shape[1] > 1040:
        rough = np.sum([qa[:, k : k + 1024].astype(np.float64) @ qb[:, k : k + 1024].T for k in range(0, qa.shape[1], 1024)], axis=0)
    else:
        rough = qa @ qb.T
    # rows whose bound can't be met by any column are skipped at once: the least product that could matter, for each row
    reach = ea * (1 + eb.max()) + eb.max()
    least = (threshold - reach - 1e-9) / (sa * sb.max())
    i, j = np.nonzero(rough >= np.where(least > 0, least, -np.inf)[:, None].astype(np.float32) * np.float32(1 - 1e-6))
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    near = rough[i, j] * (sa[i] * sb[j])
    bound = ea[i] * (1 + eb[j]) + eb[j] + 1e-9
    sure, maybe = near - bound >= threshold, np.abs(near - threshold) < bound
    at = np.flatnonzero(maybe)
    for k in range(0, len(at), 65_536):
        p = at[k : k + 65_536]
        sure[p] = np.einsum("ij,ij->i", ua[i[p]], ub[j[p]]) >= threshold
    return i[sure], j[sure], len(at)


def _cells(threshold: float, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, g, h), rows in grouped(batches, ["d", "g", "h"]):
            own = rows.column("own").to_numpy()
            ids = rows.column("rid").to_numpy()
            all_ = quantise(np.frombuffer(b"".join(rows.column("x").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64))
            left = np.flatnonzero(own == g)
            right = left if g == h else np.flatnonzero(own == h)
            count, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for p in range(0, len(left), _TILE):
                lo = left[p : p + _TILE]
                for r in range(p if g == h else 0, len(right), _TILE):
                    hi = right[r : r + _TILE]
                    i, j, _ = tile_links([v[lo] for v in all_], [v[hi] for v in all_], threshold, g == h and p == r)
                    i, j = lo[i], hi[j]
                    count += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                    while True:  # hook the larger root to the smaller until nothing changes
                        a, b = parent[i], parent[j]
                        open_ = a != b
                        if not open_.any():
                            break
                        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
                        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
                        while not np.array_equal(up := parent[parent], parent):
                            parent = up
            linked = np.flatnonzero(count)
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[parent[linked]]), pa.array(count[linked])], ["u", "v", "links"])

    return run


def near_duplicates(vectors: DataFrame, key: str, column: str, threshold: float = 0.9, cell: int = 8192) -> DataFrame:
    """vectors(key, column array<float or double>) -> key, n_links (other rows whose cosine with it is >= threshold), component_id
    (least key reachable by links, a null one last), kept (key = component_id; of a component whose keys are all null, one row).

    Every pair of rows is compared, whatever their other columns. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing; of several lengths, those of one length are compared with each other. Rows that are repeated
    are vectors of their own. An empty table gives no rows; other columns are not read.

    A cell's task holds about 2 * cell vectors, and each vector is sent to (rows / cell) cells, in the bytes of its own type (floats: 4
    a component), from which the task makes codes; codes alone would not do, as the pairs that they leave in doubt may be all
    pairs of a cluster. All pairs cost what they cost, but no task and no row grows with the data."""
    single = vectors.schema[column].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("x"), F.monotonically_increasing_id().alias("rid"))
    norm = F.aggregate(F.col("x").cast("array<double>"), F.lit(0.0), lambda a, v: a + v * v)
    rows = rows.withColumn("ok", finite(F.col("x"))).withColumn("ok", F.col("ok") & F.coalesce(F.when(F.col("ok"), norm) > 0, F.lit(False)))
    rows = rows.select("key", "rid", "ok", F.when(F.col("ok"), F.size("x")).alias("d"), F.when(F.col("ok"), F.col("x")).alias("x"))
    kinds = f"key {vectors.schema[key].dataType.simpleString()}, rid long, ok boolean, d int, x binary"
    rows = stash(rows.mapInArrow(as_bytes("x", "<f4" if single else "<f8"), kinds), "vectors")
    n = rows.filter("ok").count()
    groups = spread(n, cell)
    own = rows.filter("ok").select("rid", "x", "d", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int").alias("own"))
    # a cell is a pair of groups of vectors of one length
    others = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda o: F.struct(F.least("own", o).alias("g"), F.greatest("own", o).alias("h")))
    dealt = own.select("rid", "x", "own", "d", F.explode(others).alias("c")).select("rid", "x", "own", "d", "c.g", "c.h")
    cells = in_cells(dealt, ["d", "g", "h"], max(1, min(groups * (groups + 1), 100_000)))
    found = stash(cells.mapInArrow(_cells(threshold, np.dtype("<f4" if single else "<f8")), "u long, v long, links long"), "vector-links")
    roots = connected_components(found.select("u", "v"), "vector-cc")
    links = found.groupBy("u").agg(F.sum("links").alias("n_links")).withColumnRenamed("u", "rid")
    out = rows.select("rid", "key").join(links, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    out = stash(out.withColumn("root", F.coalesce("root", "rid")), "vector-roots")
    unstash(found)
    # of each component the row of the least key, a null one last
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "rid")).alias("x")
    least = out.groupBy("root").agg(first).select("root", F.col("x.key").alias("component_id"), F.col("x.rid").alias("_first"))
    out = lookup(out, least, "root", n)
    kept = F.coalesce(F.col("key") == F.col("component_id"), F.col("rid") == F.col("_first"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", kept.alias("kept"))
