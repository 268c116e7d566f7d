"""Nested bins, merge programs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelake.operators import sites

KIND = "chr string, start int, end int"


@pytest.mark.parametrize("size", [1, 16, 1024])
def test_overlaps_of_any_length(spark, size):
    rng = np.random.default_rng(size)
    make = lambda n: [(f"c{i % 2}", int(s), int(s + rng.choice([0, 1, 2, 50, 3000, 10**6, 2 * 10**9 - s]))) for i, s in enumerate(rng.integers(0, 5000, n).tolist())]
    a, b = make(70), make(60) + [("c0", 0, 2**31 - 1), ("c1", 1023, 1025), (None, 1, 5)]
    want = sorted((x[0], x[1], x[2], y[1], y[2], min(x[2], y[2]) - max(x[1], y[1]), i) for x in a for i, y in enumerate(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    right = spark.createDataFrame([(*y, i) for i, y in enumerate(b)], KIND + ", i int")
    got = sites.overlaps(spark.createDataFrame(a, KIND), right, size)
    assert sorted(tuple(r) for r in got.select("chr", "a_start", "a_end", "b_start", "b_end", "overlap", "i").collect()) == want


def test_an_interval_is_in_one_bin(spark):
    whole = spark.createDataFrame([("c", 0, 2**31 - 1), ("c", 5, 6), ("c", 1023, 1025), ("c", 8191, 8193)], KIND)
    assert [tuple(r) for r in sites._nested(whole, 10, 12).select("_level", "_bin").collect()] == [(7, 0), (0, 0), (1, 0), (2, 0)]
    plan = sites.overlaps(whole, whole)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sites.overlaps(whole, whole.limit(0)).count() == 0
    with pytest.raises(ValueError, match="power of 2"):
        sites.overlaps(whole, whole, 1000)


def test_merge_program(spark, tmp_path):
    rng = np.random.default_rng(2)
    motifs = spark.createDataFrame([("c", s, s + 2) for s in range(0, 400, 4)], KIND)
    at = spark.createDataFrame([("c", int(p), int(p) + 1, 50.0, int(m), int(u)) for p, m, u in zip(range(400), rng.integers(0, 9, 400), rng.integers(0, 9, 400), strict=True)], KIND + ", frequency double, methy long, unmethy long")
    program = tmp_path / "sum.py"
    program.write_text(
        "import sys\nlast = None\n"
        "def out():\n    if last: print(*last[:3], m, u, sep='\\t')\n"
        "for line in sys.stdin:\n"
        "    f = line.rstrip('\\n').split('\\t')\n"
        "    assert len(f) == 11 and f[3] == f[0] + ':' + f[1] and f[10] == '1'\n"
        "    if f[:3] != last:\n        out()\n        last, m, u = f[:3], 0, 0\n"
        "    m, u = m + int(f[8]), u + int(f[9])\n"
        "out()\n"
    )
    import sys

    got = sorted(tuple(r.line.split("\t")) for r in sites.merge_by_program(motifs, at, [sys.executable, str(program)]).collect())
    want = sites.merge_strands_by_overlap(motifs, at).select("chr", *(F.col(c).cast("string") for c in ("start", "end", "methy", "unmethy"))).collect()
    assert got == sorted(tuple(r) for r in want) and len(got) == 100
    with pytest.raises(Exception, match="ended with 3"):
        sites.merge_by_program(motifs, at, [sys.executable, "-c", "import sys; sys.stdin.read(); sys.exit(3)"]).collect()
