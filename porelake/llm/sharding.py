"""Sharding by a k-d tree over metadata: nodes are split at distributed weighted medians along their widest dimension."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, running_before, stash, text_size, unstash

#: A key: the place in the range of all rows in so many bits, a hash that tells rows of equal value apart, a hash that tells equal rows apart.
_VALUE, _TIE, _ROW = 20, 24, 18
_BITS = _VALUE + _TIE + _ROW


def _keyed(df: DataFrame, dims: list[str], tie: str, row: str) -> DataFrame:
    """df with k<i> in place of the numeric columns dims. A null or not-a-number value has the lowest place."""
    number = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in dims]
    ends = df.agg(*(f(c) for c in number for f in (F.min, F.max))).first()
    low = F.pmod(F.col(tie), F.lit(1 << _TIE)) * F.lit(1 << _ROW) + F.pmod(F.col(row), F.lit(1 << _ROW))
    for i, c in enumerate(number):
        lo, hi = (float(x or 0) for x in ends[2 * i : 2 * i + 2])
        place = F.floor((c - F.lit(lo)) * F.lit(((1 << _VALUE) - 1) / (hi - lo))).cast("long") if hi > lo else F.lit(0).cast("long")
        df = df.withColumn(f"k{i}", F.coalesce(place, F.lit(0).cast("long")) * F.lit(1 << (_TIE + _ROW)) + low)
    return df.drop(*dims, tie, row)


class Tree:
    """Nodes as arrays: dim (-1: a leaf), left and right, at (keys below it go left), at_heavy (the same for heavy rows), n (shards)."""

    def __init__(self, n: int):
        self.dim, self.left, self.right, self.at, self.at_heavy, self.n = [-1], [0], [0], [0], [0], [n]

    def split(self, node: int, dim: int, at: int, at_heavy: int) -> None:
        first = len(self.n)
        self.dim[node], self.left[node], self.right[node], self.at[node], self.at_heavy[node] = dim, first, first + 1, at, at_heavy
        for n in (self.n[node] // 2, self.n[node] - self.n[node] // 2):
            for held, v in zip((self.dim, self.left, self.right, self.at, self.at_heavy, self.n), (-1, 0, 0, 0, 0, n), strict=True):
                held.append(v)

    def place(self, keys: np.ndarray, heavy: np.ndarray) -> np.ndarray:
        """keys[n, dims] -> each row's node without children."""
        dim, left, right, at, at_heavy = (np.array(v, np.int64) for v in (self.dim, self.left, self.right, self.at, self.at_heavy))
        node, rows = np.zeros(len(keys), np.int64), np.arange(len(keys))
        while len(rows := rows[dim[node[rows]] >= 0]):
            x = node[rows]
            node[rows] = np.where(keys[rows, dim[x]] < np.where(heavy[rows], at_heavy[x], at[x]), left[x], right[x])
        return node

    def shards(self) -> np.ndarray:
        """node -> number of its leaf, from the left."""
        out, todo, k = np.full(len(self.n), -1, np.int32), [0], 0
        while todo:
            x = todo.pop()
            if self.dim[x] < 0:
                out[x], k = k, k + 1
            else:
                todo += [self.right[x], self.left[x]]
        return out


def _columns(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.stack([batch.column(f"k{i}").to_numpy() for i in range(dims)], 1)
    return keys, batch.column("w").to_numpy(), batch.column("heavy").to_numpy(zero_copy_only=False)


def _counted(tree: Tree, dims: int, windows: dict[int, list[tuple[int, int, int]]]):
    """windows: node -> (dim, lowest key, step) of its histograms. A task's sums of w by (node, dim, bin), heavy rows left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, w, heavy = _columns(batch, dims)
            node = tree.place(keys, heavy)
            for x, wanted in windows.items():
                mine = (node == x) & ~heavy
                if mine.any():
                    for dim, lo, step in wanted:
                        bins = (keys[mine, dim] - lo) // step
                        inside = (bins >= 0) & (bins < _BINS)
                        b, at = np.unique(bins[inside], return_inverse=True)
                        sums = np.zeros(len(b), np.int64)
                        np.add.at(sums, at, w[mine][inside])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), x, np.int32)), pa.array(np.full(len(b), dim, np.int32)), pa.array(b.astype(np.int32)), pa.array(sums)], ["node", "dim", "bin", "w"])

    return run


_BINS = 4096


def _width(bins: dict[int, int]) -> int:
    """How far apart the tenths of weight at both ends of a histogram are."""
    total, sum_, ends = sum(bins.values()), 0, []
    for b in sorted(bins):
        sum_ += bins[b]
        while len(ends) < 2 and sum_ * 10 > total * (1, 9)[len(ends)]:
            ends.append(b)
    return ends[1] - ends[0] if len(ends) == 2 else 0


def kd_tree(points: DataFrame, dims: int, shards: int, tolerance: float = 2e-4, nodes_at_once: int = 64) -> Tree:
    """points(k0 .. k<dims - 1>, w, heavy) -> the tree for kd_shards(). Each level of the tree takes a pass that makes a histogram of
    each dimension for each node, and one or two more that narrow the bin of the median; of a level of many nodes, so many at
    once. So a pass gives the driver at most nodes_at_once * dims * 4,096 sums, whatever the rows are."""
    total = points.agg(F.sum("w")).first()[0] or 0
    tree, level = Tree(shards), [0]
    big = points.filter("heavy").groupBy(*(f"k{i}" for i in range(dims))).agg(F.sum("w").alias("w")).toPandas()  # under 64 * shards rows
    big_keys, big_w = big[[f"k{i}" for i in range(dims)]].to_numpy(np.int64).reshape(-1, dims), big["w"].to_numpy(np.int64)

    def histograms(windows: dict) -> dict:
        out: dict = {x: {dim: {} for dim, _, _ in wanted} for x, wanted in windows.items()}
        for r in points.mapInArrow(_counted(tree, dims, windows), "node int, dim int, bin int, w long").groupBy("node", "dim", "bin").agg(F.sum("w").alias("w")).collect():
            out[r.node][r.dim][r.bin] = r.w
        return out

    while level := [x for x in level if tree.n[x] > 1]:
        below = []
        big_at = tree.place(big_keys, np.ones(len(big_w), bool))
        for lo in range(0, len(level), nodes_at_once):
            nodes = level[lo : lo + nodes_at_once]
            step = 1 << (_BITS - 12)
            seen = histograms({x: [(i, 0, step) for i in range(dims)] for x in nodes})
            open_: dict[int, dict] = {}
            for x in nodes:
                mine = big_at == x
                share, width = (tree.n[x] // 2) / tree.n[x], [_width(seen[x][i]) for i in range(dims)]
                dim = width.index(max(width))
                # heavy rows are cut as near to their share as they can be; the others' cut makes up for it
                order = np.argsort(big_keys[mine, dim], kind="stable")
                k, w = big_keys[mine, dim][order], big_w[mine][order]
                sums = np.concatenate([[0], np.cumsum(w)])
                ends = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]]).astype(int) if len(k) else np.zeros(1, int)
                cut = ends[np.abs(sums[ends] - sums[-1] * share).argmin()]
                light = sum(seen[x][dim].values())
                open_[x] = {
                    "dim": dim, "at_heavy": int(k[cut]) if cut < len(k) else 1 << _BITS, "target": (light + int(sums[-1])) * share - int(sums[cut]), "lo": 0, "step": step, "below": 0,
                    "bins": seen[x][dim],
                }
            while open_:
                for x, o in list(open_.items()):
                    sum_, found = o["below"], False
                    for b, w in sorted(o["bins"].items()):
                        if sum_ + w > o["target"]:
                            key = o["lo"] + b * o["step"]
                            if w <= tolerance * total / shards or o["step"] == 1:
                                o["at"] = key if o["target"] - sum_ <= sum_ + w - o["target"] else key + o["step"]
                            else:
                                o |= {"lo": key, "below": sum_, "step": max(1, o["step"] >> 12)}
                            found = True
                            break
                        sum_ += w
                    if not found:
                        o["at"] = 1 << _BITS
                    if "at" in o:
                        tree.split(x, o["dim"], o["at"], o["at_heavy"])
                        below += [tree.left[x], tree.right[x]]
                        del open_[x]
                if open_:
                    # the rows of a node that is split already stand at its children; those of open ones are still at it
                    seen = histograms({x: [(o["dim"], o["lo"], o["step"])] for x, o in open_.items()})
                    for x, o in open_.items():
                        o["bins"] = seen[x][o["dim"]]
        level = below
    return tree


def _sharded(tree: Tree, dims: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = tree.shards()
        for batch in batches:
            keys, _, heavy = _columns(batch, dims)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(shard[tree.place(keys, heavy)])], [*keep, "shard"])

    return run


def kd_shards(points: DataFrame, dims: list[str], tie: str, row: str, shards: int | None = None, target_bytes: int | None = None, tolerance: float = 2e-4) -> tuple[DataFrame, Tree]:
    """points(dims, w (long), tie, row (longs), others) -> (the others with w and shard, the tree). Give the number of shards, or
    the weight that each should have.

    A node that stands for n shards is split along the dimension in which its rows spread widest (from the first to the last tenth of
    its weight, as a share of the range of all rows), where n // 2 / n of its weight lies below, until each leaf stands for one
    shard. Rows of equal value are split by tie, and those of equal tie by row, if a shard's edge falls among them, so that a value
    that holds any share of the rows is no obstacle. Rows over 1/64 of a shard have a median of their own, and that of
    the others makes up for where it falls, so that shards don't differ by such rows. A column `unit` has the weight of all the rows that
    a row can't be parted from, as they agree in dims, tie and row; they then count together. The driver gets histograms and those rows' keys
    (fewer than 64 * shards). An empty table gives no rows."""
    whole = F.col("unit") if "unit" in points.columns else F.col("w")
    keyed = stash(_keyed(points.withColumn("_whole", whole).drop("unit"), dims, tie, row), "kd-points")
    total = keyed.agg(F.sum("w")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    keyed, n = keyed.withColumn("heavy", F.col("_whole") * (64 * shards) > total).drop("_whole"), len(dims)
    tree = kd_tree(keyed, n, shards, tolerance)
    keep = [c for c in keyed.columns if c != "heavy" and c not in {f"k{i}" for i in range(n)}]
    kinds = ", ".join(f"`{c}` {keyed.schema[c].dataType.simpleString()}" for c in keep)
    return keyed.mapInArrow(_sharded(tree, n, keep), f"{kinds}, shard int"), tree


def shard_documents(docs: DataFrame, shards: int = 24, together: int = 16) -> DataFrame:
    """docs(doc_id, text, lang, source) -> doc_id, size (UTF-8 bytes of the text and 8), text_crc32, shard, slot (gapless from 0).

    Dimensions: source and lang (by their first letters), the place of doc_id, and the text's size. Null texts have no bytes and
    the checksum of the empty text; null sources and languages count as empty, null doc_ids as the lowest. Documents of equal text stand
    together, at the place of the least of them, unless they hold over 1 / together of a shard's bytes: such a group is split, for the shards'
    sizes come first. How many rows they are doesn't matter. Rows that are repeated get slots of their own; other columns are not read."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long")
    letters = lambda c: F.conv(F.hex(F.rpad(F.substring(F.coalesce(F.col(c), F.lit("")).cast("binary"), 1, 6), 6, b"\0")), 16, 10).cast("double")
    narrow = docs.select(
        "doc_id", (text_size(F.col("text")) + 8).alias("w"), crc.alias("crc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), letters("source").alias("s"),
        letters("lang").alias("l"), F.monotonically_increasing_id().alias("row"),
    )
    narrow = stash(narrow, "kd-narrow")
    rows, total = narrow.agg(F.count(F.lit(1)), F.sum("w")).first()
    same = ["h", "crc", "w"]
    least = [F.min(c).alias(f"_{c}") for c in ("doc_id", "s", "l")]
    groups = narrow.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), *least).filter("n > 1")
    large = F.col("n") * F.col("w") * (together * shards) > (total or 0)
    groups = stash(groups.withColumn("large", large), "kd-groups")
    split = groups.filter("large").select(*same, "large")  # fewer than together * shards rows of 25 bytes
    split = F.broadcast(split) if together * shards <= 1 << 18 else split
    flagged = narrow.join(split, same, "left").withColumn("large", F.coalesce("large", F.lit(False)))
    # rows of a split group have a key of their own; of the others, short texts may still be most of the rows
    keyed = flagged.withColumn("h0", F.col("h")).withColumn("h", F.when(F.col("large"), F.xxhash64("h", "row")).otherwise(F.col("h")))
    key = F.struct(*same).alias("_same")
    kept = groups.filter("not large").select(key, (F.col("n") * F.col("w")).alias("_unit"), *(f"_{c}" for c in ("doc_id", "s", "l")))
    joined = lookup(keyed.select("*", key), kept, "_same", rows, "left")
    whole = ~F.col("large")
    log = F.log1p(F.col("w").cast("double"))
    points = joined.select(
        "doc_id", "w", F.coalesce("_unit", "w").alias("unit"), "crc", F.coalesce("_s", "s").alias("p_source"), F.coalesce("_l", "l").alias("p_lang"), F.coalesce("_doc_id", "doc_id").alias("p_id"), log.alias("p_size"),
        F.when(whole, F.col("h0")).otherwise(F.xxhash64("h0", "doc_id")).alias("tie"), F.when(whole, F.lit(0).cast("long")).otherwise(F.xxhash64("row")).alias("row"),
    )
    placed, _ = kd_shards(points, ["p_source", "p_lang", "p_id", "p_size"], "tie", "row", shards)
    placed = stash(placed.select("doc_id", F.col("w").alias("size"), F.col("crc").alias("text_crc32"), "shard", F.monotonically_increasing_id().alias("row")), "kd-shards")
    unstash(narrow, groups)
    return running_before(placed, "shard", ["doc_id", "text_crc32"], F.lit(1), "slot", rows, tie="row").drop("row")
