"""Hard negatives for anchors: rows of another label that score just below the anchor's own positives.

Anchors are taken in chunks of bounded size, which go to the executors as blocks of a broadcast; candidates are blocks of an Arrow
table. A block of anchors times a block of candidates is one product of float64 matrices, exact for whole numbers whose products stay below
2 ** 53. A first pass over the candidates keeps each anchor's best rows of its label, a second one the best rows of other labels
in the window that each of these positives opens. Both keep at most k rows an anchor (and positive) and task, and what tasks have kept is merged
by rank."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, stash, unstash
from .vectors import matrix

_LEAST = -(2.0**62)


class Best:
    """The k best (score, then smaller id) rows seen so far for each of n lists; equal ids and scores may be there twice."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def take(self, lists: slice, score: np.ndarray, ids: np.ndarray) -> None:
        """score[m, c]: of candidates ids[c] for the lists; -inf: none."""
        least = self.score[lists, -1]
        row = np.flatnonzero((score >= np.maximum(least, _LEAST)[:, None]).any(1))
        if not len(row):
            return
        s, k = score[row], self.k
        if s.shape[1] > k:  # no more than k of a block are needed, but for ties
            least = np.maximum(least[row], np.partition(s, s.shape[1] - k, 1)[:, -k])
        else:
            least = least[row]
        i, j = np.nonzero(s >= np.maximum(least, _LEAST)[:, None])
        at = row + lists.start
        old = self.score[at] > -np.inf
        rows = np.concatenate([i, np.nonzero(old)[0]])
        scores, of = np.concatenate([s[i, j], self.score[at][old]]), np.concatenate([ids[j], self.id[at][old]])
        order = np.lexsort((of, -scores, rows))
        rows, scores, of = rows[order], scores[order], of[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = nth < k
        self.score[at], self.id[at] = -np.inf, np.iinfo(np.int64).max
        self.score[at[rows[keep]], nth[keep]], self.id[at[rows[keep]], nth[keep]] = scores[keep], of[keep]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, float64 vectors) of at most `size` rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            b = batch.slice(lo, size)
            yield b.column("vec").to_numpy(), b.column("label").to_numpy(), matrix(b.column("x"))


def _positives(anchors, k: int, size: int):
    """anchors: broadcast (id[a], label[a], x[a, d]) -> at most k rows of each anchor's label for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, label, x = anchors.value
        best = Best(len(own), k)
        for ids, labels, c in _blocks(batches, 4 * size):
            for a in range(0, len(own), size):
                s = x[a : a + size] @ c.T
                s[(label[a : a + size, None] != labels) | (own[a : a + size, None] == ids)] = -np.inf
                best.take(slice(a, min(a + size, len(own))), s, ids)
        i, j = np.nonzero(best.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(best.id[i, j]), pa.array(best.score[i, j].astype(np.int64))], ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(anchors, k: int, size: int, low: int, high: int):
    """anchors: broadcast (id[a], label[a], x[a, d], score[a, p] of positives, of which -inf are none) -> at most k rows of other labels
    for each anchor and positive, with low * positive <= 100 * negative <= high * positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, label, x, of = anchors.value
        least, most = low * of, np.where(of > -np.inf, high * of, -np.inf)
        best = [Best(len(own), k) for _ in range(of.shape[1])]
        for ids, labels, c in _blocks(batches, 4 * size):
            for a in range(0, len(own), size):
                rows = slice(a, min(a + size, len(own)))
                s = x[rows] @ c.T
                s[label[rows, None] == labels] = -np.inf
                hundred = 100 * s
                for p, b in enumerate(best):
                    b.take(rows, np.where((hundred >= least[rows, p, None]) & (hundred <= most[rows, p, None]), s, -np.inf), ids)
        for p, b in enumerate(best):
            i, j = np.nonzero(b.score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(np.full(len(i), p, np.int32)), pa.array(b.id[i, j]), pa.array(b.score[i, j].astype(np.int64))], ["anchor_id", "p", "negative_id", "negative_score"])

    return run


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, chunk: int = 16_384, block: int = 512, part: int = 8192) -> DataFrame:
    """vectors(vec, label, x array<double> of whole numbers), anchors of the same form -> anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.

    A score is an inner product. An anchor's positives are its `positives` best rows of its label with another vec; for each of them, the
    first `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score are returned (all,
    if there are fewer). Higher scores come first, ties go to the smaller vec. All rows are candidates: thresholds only drop what can't be
    among the best.

    Rows with a null vec, label or x take no part; shorter vectors count as filled up with zeros. Repeated rows of vectors are candidates
    of their own, so that a positive may come twice, each time with its negatives; of anchors of one vec, that of the least label and x is
    taken. An empty table gives no rows; other columns are not read. 100 times a score must stay below 2 ** 53.

    The driver holds `chunk` anchors and their positives at a time, 8 * chunk * (dimension + positives) bytes; each chunk takes two passes
    over vectors, in tasks of about `part` rows and matrices of block times 4 * block."""
    vectors, anchors = (t.filter("vec is not null and label is not null and x is not null").select("vec", F.col("label").cast("long").alias("label"), "x") for t in (vectors, anchors))
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = vectors.sparkSession
    d, n = vectors.agg(F.max(F.size("x")), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], kinds)
    even = lambda t: t.withColumn("x", F.slice(F.concat("x", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(d) - F.size("x")))), 1, d))  # noqa: E731  what goes beyond d meets zeros alone
    vectors = stash(even(vectors).repartition(spread(n, part)), "hard-vectors")
    anchors = even(anchors).groupBy("vec").agg(F.min(F.struct("label", "x")).alias("a")).select("vec", "a.*")
    m = anchors.count()
    chunks = spread(m, chunk)
    if chunks > 1:
        anchors = stash(anchors.withColumn("c", F.pmod(F.xxhash64("vec"), F.lit(chunks))), "hard-anchors")
    first = lambda df, keys, k, order: df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= k)
    out, tables = [], [vectors, anchors]
    for c in range(chunks):
        held = (anchors.filter(F.col("c") == c).drop("c") if chunks > 1 else anchors).toArrow()
        if not held.num_rows:
            continue
        own, label, x = held.column("vec").to_numpy(), held.column("label").to_numpy(), matrix(held.column("x").combine_chunks())
        sent = spark.sparkContext.broadcast((own, label, x))
        found = vectors.mapInArrow(_positives(sent, positives, block), "anchor_id long, positive_id long, positive_score long")
        found = first(found, ["anchor_id"], positives, [F.desc("positive_score"), "positive_id"]).withColumn("p", F.col("n") - 1).drop("n")
        found = stash(found, "hard-positives")
        got = found.select("anchor_id", "p", "positive_score").toArrow()
        of = np.full((len(own), positives), -np.inf)
        order = np.argsort(own)
        of[order[np.searchsorted(own, got.column("anchor_id").to_numpy(), sorter=order)], got.column("p").to_numpy()] = got.column("positive_score").to_numpy()
        again = spark.sparkContext.broadcast((own, label, x, of))
        near = vectors.mapInArrow(_negatives(again, negatives, block, low, high), "anchor_id long, p int, negative_id long, negative_score long")
        near = first(near, ["anchor_id", "p"], negatives, [F.desc("negative_score"), "negative_id"])
        near = stash(near.join(found, ["anchor_id", "p"]).select("anchor_id", "positive_id", F.col("n").alias("rank"), "negative_id", "positive_score", "negative_score"), "hard-negatives")
        sent.unpersist()
        again.unpersist()
        unstash(found)
        out.append(near)
    unstash(*tables)
    return spark.read.schema(out[0].schema).parquet(*(t._stash_path for t in out)) if out else spark.createDataFrame([], kinds)
