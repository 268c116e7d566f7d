"""Exact top-k by inner product, over vectors in order of their length.

Vectors are rotated by the right singular vectors of the whole table, so that the first coordinates of a product carry most of
it. Blocks of vectors hold like lengths. A first pass over the longest vectors gives each query a score that its k-th best reaches
at least; in the second, a vector is dropped as soon as its length, or its partial product and the length of what is left, shows
by Cauchy-Schwarz that it stays below. The rest are scored in whole numbers."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, unstash
from .vectors import grouped, in_cells, matrix


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        if b.num_rows:
            x = matrix(b.column("x"))
            total = x.T @ x + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Orthogonal float64[d, d] whose columns are the right singular vectors of all rows, the largest first. Each task sends d * d sums."""
    total = np.zeros((d, d))
    for (g,) in vectors.select("x").mapInArrow(_gram, "gram binary").toLocalIterator():
        total += np.frombuffer(g, np.float64).reshape(d, d)
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def block_top(q, qid, x, xid, k: int, least: np.ndarray, turn: np.ndarray, head: int, others: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Queries q[m, d] against x[n, d], by falling length -> (query row, x row, score) of at most k for each query, of score >= least;
    and the number of products computed in full. others: a query isn't its own result."""
    rq, rx = q @ turn, x @ turn
    tail_q, tail_x = np.sqrt((rq[:, head:] ** 2).sum(1)), np.sqrt((rx[:, head:] ** 2).sum(1))
    len_q, len_x = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    slack = 1e-9 * (1 + len_q * (len_x.max() if len(x) else 0))  # more than double precision loses
    rows, cols, scores, full = [], [], [], 0
    for i in range(len(q)):
        n = int(np.searchsorted(-len_x, -(least[i] - slack[i]) / max(len_q[i], 1e-300), side="right")) if least[i] > 0 else len(x)
        at = np.flatnonzero(rx[:n, :head] @ rq[i, :head] + tail_q[i] * tail_x[:n] >= least[i] - slack[i])
        if others:
            at = at[xid[at] != qid[i]]
        full += len(at)
        s = np.rint(x[at] @ q[i]).astype(np.int64)
        keep = s >= least[i]
        at, s = at[keep], s[keep]
        order = np.lexsort((xid[at], -s))[:k]
        rows.append(np.full(len(order), i))
        cols.append(at[order])
        scores.append(s[order])
    cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return cat(rows), cat(cols), cat(scores), full


def _search(k: int, turn: np.ndarray, head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches, ["qb", "cb"]):
            is_q = t.column("is_query").to_numpy(zero_copy_only=False)
            ids, x = t.column("vec").to_numpy(), matrix(t.column("x").combine_chunks())
            q, c = np.flatnonzero(is_q), np.flatnonzero(~is_q)
            if not len(q) or not len(c):
                continue
            c = c[np.argsort(-(x[c] ** 2).sum(1), kind="stable")]
            least = t.column("least").to_numpy(zero_copy_only=False)[q].astype(np.float64)
            i, j, s, _ = block_top(x[q], ids[q], x[c], ids[c], k, least, turn, head)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q][i]), pa.array(ids[c][j]), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def _numbered(column: str, name: str, number):
    """For mapInArrow: adds the int column `name`, number(values of column as float64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number(b.column(column).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int32))], [*b.schema.names, name])

    return run


def _blocks(counts: dict[int, int], n: int, per: int) -> tuple[np.ndarray, np.ndarray]:
    """counts by class 0 .. n - 1 -> how many blocks of about `per` rows each class has, and the number of its first."""
    parts = np.array([-(-counts.get(i, 0) // per) for i in range(n)], np.int64)
    return parts, np.concatenate([[0], np.cumsum(parts)])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, q_block: int = 2048, c_block: int = 8192, head: int = 16, classes: int = 1024) -> DataFrame:
    """vectors(vec, x array<double> of whole numbers), queries of the same form -> query_id, rank (from 1), vec_id, score: each query's
    k highest inner products with the vectors other than itself (all, if fewer), ties to the smaller vec_id.

    Vectors are in at most `classes` classes of length, the longest first, and a class is in blocks of about c_block. Each block of
    queries meets each block of vectors in a task of its own; a task returns k rows a query. After the first block has given each
    query a score that its k-th best reaches, a query is sent only to the classes whose greatest length can reach it, and a block of
    vectors only to the blocks of such queries. No vector is left out: pruning is by bounds. What the driver sees and the plan's size
    depend on `classes` and the dimension, not on the rows. Repeated rows of vectors are results of their own; repeated queries give
    the same rows once; rows whose vec is null take no part. A shorter vector counts as filled up with zeros. Products must stay
    below 2 ** 53. An empty table gives no rows; other columns are not read."""
    vectors, queries = (t.filter("vec is not null").select("vec", "x") for t in (vectors, queries))
    d = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    even = lambda t: t.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("x")))).withColumn("len", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))
    queries = stash(even(queries.filter(F.size("x") <= d).dropDuplicates(["vec"])), "topk-queries")
    vectors = stash(even(vectors), "topk-vectors")
    nq, nc = queries.count(), vectors.count()
    if not nq or not nc:
        return vectors.select(F.col("vec").alias("query_id"), F.lit(0).alias("rank"), F.col("vec").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    turn, head = rotation(vectors, d), min(head, d)
    n = min(classes, -(-nc // c_block))
    cuts = np.unique(vectors.stat.approxQuantile("len", [i / n for i in range(1, n)], 0.1 / n)) if n > 1 else np.zeros(0)
    n, plain = len(cuts) + 1, "vec long, x array<double>, len double"
    classed = stash(vectors.mapInArrow(_numbered("len", "c", lambda v: len(cuts) - np.searchsorted(cuts, v, "right")), f"{plain}, c int"), "topk-classes")
    unstash(vectors)
    seen = {r.c: r for r in classed.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("len")).collect()}
    parts, base = _blocks({c: r.n for c, r in seen.items()}, n, c_block)
    longest = np.array([seen[c].len if c in seen else 0.0 for c in range(n)])

    def search(q: DataFrame, c: DataFrame, cells: int) -> DataFrame:
        """q(qb, vec, x, least, cb) against c(cb, vec, x, qb)."""
        both = q.select("qb", "cb", "vec", "x", "least", F.lit(True).alias("is_query")).unionByName(c.select("qb", "cb", "vec", "x", F.lit(None).cast("long").alias("least"), F.lit(False).alias("is_query")))
        return in_cells(both, ["qb", "cb"], max(1, min(2 * cells, 100_000))).mapInArrow(_search(k, turn, head), "query_id long, vec_id long, score long")

    # a vector's block: its class's first, and a hash for one of the class's
    own = classed.withColumn("h", F.pmod(F.xxhash64("vec", "x"), F.lit(1 << 30)).cast("int"))
    own = own.mapInArrow(_numbered("c", "cb0", lambda c: base[c.astype(int)]), f"{plain}, c int, h int, cb0 int").mapInArrow(_numbered("c", "np", lambda c: parts[c.astype(int)]), f"{plain}, c int, h int, cb0 int, np int")
    blocked = stash(own.select("vec", "x", "c", (F.col("cb0") + F.col("h") % F.col("np")).alias("cb")), "topk-blocks")
    unstash(classed)
    q_blocks = -(-nq // q_block)
    all_q = F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb")
    some = queries.select("vec", "x", F.pmod(F.xxhash64("vec"), F.lit(q_blocks)).cast("int").alias("qb"), F.lit(-(2**62)).cast("long").alias("least"), F.lit(0).alias("cb"))
    found = stash(search(some, blocked.filter("cb = 0").select("vec", "x", "cb", all_q), q_blocks), "topk-first")
    if base[-1] > 1:
        reach = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec"), "least")
        second = queries.join(reach, "vec", "left").withColumn("least", F.coalesce("least", F.lit(-(2**62)).cast("long")))
        # the product of lengths that a score needs; then how many classes reach it
        second = second.withColumn("need", F.when(F.col("least") > 0, F.col("least") / F.greatest("len", F.lit(1e-300)) * (1 - 1e-9)).otherwise(0.0))
        second = second.select("vec", "x", "len", "least", "need").mapInArrow(_numbered("need", "e", lambda v: np.searchsorted(-longest, -v, "right")), f"{plain}, least long, need double, e int")
        second = stash(second.select("vec", "x", "least", "e"), "topk-reach")
        counts = {n - r.e: r["count"] for r in second.groupBy("e").count().collect()}  # the queries of the farthest reach first
        q_parts, q_base = _blocks(counts, n + 1, q_block)
        q = second.withColumn("h", F.pmod(F.xxhash64("vec"), F.lit(1 << 30)).cast("int")).filter("e > 0")
        kinds = "vec long, x array<double>, least long, e int, h int"
        for name, number in (("qb0", lambda e: q_base[n - e.astype(int)]), ("np", lambda e: q_parts[n - e.astype(int)]), ("end", lambda e: base[e.astype(int)])):
            q = q.mapInArrow(_numbered("e", name, number), kinds := f"{kinds}, {name} int")
        q = q.filter("end > 1").select("vec", "x", "least", (F.col("qb0") + F.col("h") % F.col("np")).alias("qb"), F.explode(F.sequence(F.lit(1), F.col("end") - 1)).alias("cb"))
        c = blocked.filter("cb > 0").mapInArrow(_numbered("c", "to", lambda c: q_base[n - c.astype(int)]), "vec long, x array<double>, c int, cb int, to int")
        c = c.filter("to > 0").select("vec", "x", "cb", F.explode(F.sequence(F.lit(0), F.col("to") - 1)).alias("qb"))
        cells = sum(int(q_parts[n - e]) * int(base[e]) for e in range(1, n + 1))
        found = found.unionByName(search(q, c, max(1, cells)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
