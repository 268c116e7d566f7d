"""Hard-negative mining against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelake.llm import negatives, queries

from .test_llm import SF, tables

KIND = "vec long, label int, x array<double>"


def plain(vectors, anchors, positives=5, k=3, low=50, high=95):
    """Rows (vec, label, x) -> rows of hard_negatives, by all pairs in Python's whole numbers."""
    ok = [r for r in vectors if None not in r]
    firsts = {}
    for a in sorted(r for r in anchors if None not in r):
        firsts.setdefault(a[0], a)
    out = []
    for v, label, x in firsts.values():
        dot = lambda y, x=x: sum(int(p) * int(q) for p, q in zip(x, y, strict=False))  # noqa: E731  the shorter ends it
        same = sorted((-dot(y), u) for u, m, y in ok if m == label and u != v)[:positives]
        other = sorted((-dot(y), u) for u, m, y in ok if m != label)
        for s, u in same:
            near = [(t, w) for t, w in other if low * -s <= 100 * -t <= high * -s][:k]
            out += [(v, u, i + 1, w, -s, -t) for i, (t, w) in enumerate(near)]
    return sorted(out)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("chunk,block,part", [(16_384, 512, 8192), (7, 3, 20), (5, 64, 100_000)])
def test_against_all_pairs(spark, chunk, block, part):
    rng = random.Random(chunk)
    rows = [(i, rng.randrange(3), [float(rng.randrange(-4, 9)) for _ in range(4)]) for i in range(150)]
    rows += [(200 + i, i % 2, [3.0, 1.0, 2.0, 5.0]) for i in range(60)]  # a third alike: ties everywhere
    rows += [(30, 1, [1.0, 2.0, 3.0, 4.0])] * 3 + [(400, 2, [0.0] * 4), (401, 1, [2.0, 1.0]), (402, 0, []), (None, 1, [1.0] * 4), (403, None, [1.0] * 4), (404, 1, None)]
    t = spark.createDataFrame(rows, KIND).withColumn("anchor_id", F.lit("clash")).withColumn("p", F.lit(0))
    got = rows_of(negatives.hard_negatives(t, t.filter("vec % 10 = 0 or vec is null"), chunk=chunk, block=block, part=part))
    want = plain(rows, [r for r in rows if r[0] is None or r[0] % 10 == 0])
    assert want and got == want


def test_few_or_none(spark):
    t = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 1.0]), (3, 1, [0.0, 1.0])], KIND)
    assert rows_of(negatives.hard_negatives(t, t)) == plain([tuple(r) for r in t.collect()], [tuple(r) for r in t.collect()])
    none = t.limit(0)
    assert rows_of(negatives.hard_negatives(none, none)) == [] == rows_of(negatives.hard_negatives(t, none))
    longer = spark.createDataFrame([(1, 0, [1.0, 0.0, 7.0])], KIND)  # what goes beyond the vectors meets nothing
    assert rows_of(negatives.hard_negatives(t, longer)) == plain([tuple(r) for r in t.collect()], [(1, 0, [1.0, 0.0])])


def test_best_rows_over_blocks():
    rng = np.random.default_rng(3)
    best, s, ids = negatives.Best(6, 4), rng.integers(-5, 6, (6, 90)).astype(float), rng.permutation(90).astype(np.int64)
    s[2] = -np.inf
    s[3, 5:] = -np.inf
    for a in range(0, 90, 7):
        best.take(slice(0, 4), s[:4, a : a + 7], ids[a : a + 7])
        best.take(slice(4, 6), s[4:, a : a + 7], ids[a : a + 7])
    for i in range(6):
        want = sorted((-v, k) for v, k in zip(s[i], ids, strict=True) if v > -np.inf)[:4]
        assert [(-v, k) for v, k in zip(best.score[i], best.id[i], strict=True) if v > -np.inf] == want


@tables
def test_registered_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(r.embedding, np.float64)).tolist()) for r in rows if r.label is not None and r.embedding]
    got = rows_of(queries.QUERIES["op13_blocked_gemm"](spark, SF))
    assert got == plain(vectors, [v for v in vectors if v[0] % 50 == 0])
