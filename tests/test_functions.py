"""Hand-worked values of the scalar functions."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from porelake.functions import cigar as cg
from porelake.functions import sequence as sq
from porelake.functions import signal as sg
from porelake.functions import text as tx


def one(spark, **columns):
    """Values of expressions over literal columns."""
    row = spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()
    return row if len(columns) > 1 else row[0]


def test_motifs_and_complements(spark):
    s = F.lit("AACGTTCGA")
    assert one(spark, x=sq.motif_offsets(s, "CG")) == [2, 6]
    assert one(spark, x=sq.motif_offsets(sq.reverse_complement(s), "CG")) == [1, 5]
    assert one(spark, x=sq.motif_offsets(F.lit("CCGCTGACAG"), "CHG")) == [0, 3, 7]
    assert one(spark, x=sq.motif_offsets(F.lit("CCCC"), "CHH")) == [0, 1]
    assert one(spark, x=sq.motif_offsets(F.lit("CGCG"), "CG", 1)) == [1, 3]
    for empty in ("", "C"):
        assert one(spark, x=sq.motif_offsets(F.lit(empty), "CG")) == []
    assert one(spark, x=sq.base_codes(F.lit("ACGCN"))) == [0, 1, 2, 1, 4]
    assert one(spark, x=sq.base_codes(F.lit("AxU"))) == [0, None, None]
    assert one(spark, x=sq.base_codes(F.lit("AU"), rna=True)) == [0, 3]
    assert one(spark, x=sq.reverse_complement(F.lit("ACGU"), rna=True)) == "ACGU"
    assert one(spark, a=sq.complement_base(F.lit("R")), b=sq.complement_base(F.lit("?")), c=sq.complement_base(F.lit("N"))) == ("Y", "N", "N")
    assert sq.MOTIFS["CHH"] == ("CAA", "CAC", "CAT", "CCA", "CCC", "CCT", "CTA", "CTC", "CTT")
    with pytest.raises(ValueError):
        sq.motif_set("XY")
    with pytest.raises(ValueError):
        sq.check_odd(4)


def test_windows(spark):
    s = F.lit("AACGTTCGA")
    fits = [one(spark, x=sq.window_fits(s, F.lit(o), k)) for o, k in ((2, 5), (6, 5), (2, 7), (6, 7))]
    assert fits == [True, True, False, False]
    assert one(spark, x=sq.kmer_at(s, F.lit(2), 5)) == "AACGT"
    assert one(spark, x=sq.centre_crop(F.sequence(F.lit(0), F.lit(20)), 21, 13)) == list(range(4, 17))


def test_cigar(spark):
    c = cg.parse_cigar(F.lit("5S10M2I3D4M1S"))
    assert [tuple(x) for x in one(spark, x=c)] == [(4, 5), (0, 10), (1, 2), (2, 3), (0, 4), (4, 1)]
    got = one(spark, r=cg.reference_length(c), a=cg.query_start(c), b=cg.query_end(c, F.lit(22)), i=cg.identity(c, F.lit(6)), v=cg.coverage(c, F.lit(16)), m=cg.identity(c, F.lit(-1)), z=cg.coverage(c, F.lit(0)))
    assert (got.r, got.a, got.b, round(got.i, 6), got.v, got.m, got.z) == (17, 5, 21, 0.421053, 0.875, 0.0, -1.0)
    eq = cg.parse_cigar(F.lit("10="))
    assert one(spark, i=cg.identity(eq, F.lit(0)), c=cg.coverage(eq, F.lit(10)), m=cg.identity(eq, F.lit(0), (0, 7))) == (None, 0.0, 1.0)
    assert one(spark, x=cg.parse_cigar(F.lit("*"))) == []


def test_ref_to_query(spark):
    c = cg.parse_cigar(F.lit("2S3M1I2D2M"))
    assert one(spark, f=cg.ref_to_query(c, F.lit(True)), r=cg.ref_to_query(c, F.lit(False))) == ([0, 1, 2, 4, 4, 4, 5, 6], [0, 1, 2, 2, 3, 4, 5, 6])


@given(st.lists(st.tuples(st.sampled_from([0, 1, 2, 3, 4, 7, 8]), st.integers(1, 9)), min_size=1, max_size=12), st.booleans())
def test_ref_to_query_kernel(ops, forward):
    codes, lens = np.array([o for o, _ in ops]), np.array([n for _, n in ops])
    want, q = [], 0
    for o, n in ops if forward else ops[::-1]:
        if o in (0, 7, 8):
            want += range(q, q + n)
            q += n
        elif o in (2, 3):
            want += [q] * n
        elif o == 1:
            q += n
    got = sg.np_ref_to_query(codes, lens, forward).tolist()
    assert got == [*want, q]
    assert len(got) == sum(n for o, n in ops if o in (0, 2, 3, 7, 8)) + 1 and got == sorted(got)


RAW = [10, 12, 11, 40, 42, 41, 13, 9]


def test_signal(spark):
    raw = F.array(*map(F.lit, RAW))
    pa = sg.calibrate(raw, F.lit(-5.0), F.lit(0.5))
    assert one(spark, x=pa) == [2.5, 3.5, 3, 17.5, 18.5, 18, 4, 2]
    want = [-0.674489, 0, -0.337244, 9.442846, 10.117335, 9.78009, 0.337244, -1.011734]
    assert np.allclose(one(spark, x=sg.mad_normalise(pa)), want, atol=1e-5)
    assert np.allclose(sg.np_normalise(np.array(RAW), -5, 0.5), want, atol=1e-5)
    flat = F.array(*map(F.lit, [1.0, 1.0, 1.0, 5.0]))
    assert one(spark, x=sg.mad_normalise(flat)) == [1, 1, 1, 5]
    assert sg.np_normalise(np.array([1, 1, 1, 5]), 0, 1).tolist() == [1, 1, 1, 5]


@pytest.mark.parametrize(("n", "stride", "moves", "lengths", "starts"), [(60, 5, [0, 1, 4, 8, 11, 12], [5, 15, 20, 15, 5], [0, 5, 22, 40, 45]), (72, 6, [0, 4, 5, 12], [24, 6, 42], [4, 20, 43])])
def test_regroup(spark, n, stride, moves, lengths, starts):
    x, m = F.sequence(F.lit(0), F.lit(n - 1)), F.array(*map(F.lit, moves))
    got = one(spark, g=sg.regroup(x, m, F.lit(stride)), n=sg.move_lengths(m, F.lit(stride)))
    assert got.n == lengths and [g[0] for g in got.g] == starts and all(len(g) == 15 for g in got.g)
    groups, found = sg.np_regroup(np.arange(n), np.array(moves), stride)
    assert groups[:, 0].tolist() == starts and found.tolist() == lengths and sum(lengths) == (moves[-1] - moves[0]) * stride


def test_small_forms(spark):
    assert np.allclose(one(spark, x=sg.phred(F.lit("!I+"), F.lit(True))), [0, 0.666667, 0.166667], atol=1e-6)
    assert np.allclose(one(spark, x=sg.phred(F.lit("!I+"), F.lit(False))), [0.166667, 0.666667, 0], atol=1e-6)
    assert tuple(one(spark, x=sg.move_table(F.array(*map(F.lit, [5, 1, 0, 1, 1]))))) == (5, [0, 2, 3, 4])
    assert one(spark, a=sg.rect(F.array(F.lit(1.0), F.lit(2.0)), 5), b=sg.rect(F.array(*(F.lit(float(i)) for i in range(6))), 3)) == ([0, 1, 2, 0, 0], [1, 2, 3])
    assert one(spark, x=tx.split_all(F.lit("a..b."), ".")) == ["a", "", "b", ""]
    assert one(spark, x=tx.tab_keys(F.array(F.lit(1), F.lit(2)))) == "1\t2"
    assert one(spark, x=tx.six_decimals(F.lit(0.1234565))) == "%f" % 0.1234565
    assert one(spark, x=tx.fixed_site_info(F.lit("r"), F.lit(1), F.lit(2), F.lit("c1"), F.lit(3), F.lit("+"), 4)) == "r\t0000000001\t0000000002\t__c1\t0000000003\t+"


@given(st.text(alphabet=sq.ALPHABET, max_size=40))
def test_complement_twice(s):
    table = str.maketrans(*sq.PAIRS)
    assert s.translate(table).translate(table) == s
    assert s.count("CG") == s.translate(table)[::-1].count("CG")
