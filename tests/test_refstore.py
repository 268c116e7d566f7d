"""The reference on shared storage."""

import os
import random

import pytest

from porelake.operators import features
from porelake.sources import arrays, bam, fasta, refstore

from .test_engine import GENOME, genome, rows  # noqa: F401


def test_packed_bases():
    rng = random.Random(4)
    for letters in ("ACGTN", "ACGTRYKMN", "ACGT-x"):
        for n in (0, 1, 2, 7, 100):
            seq = "".join(rng.choice(letters) for _ in range(n)).encode()
            held = refstore.pack(seq)
            for _ in range(30):
                a, b = sorted(rng.randrange(0, n + 3) for _ in range(2))
                assert refstore.cut(held, a, b) == seq[a:b]
    assert len(refstore.pack(b"ACGT" * 100)) < 220


@pytest.mark.parametrize("size", [10, 1000])
def test_store_like_the_table(spark, genome, tmp_path, size):  # noqa: F811
    d, folder = genome[0], str(tmp_path / "ref")
    chunks = fasta.read_chunks(spark, str(d / "ref.fa"), size)
    assert refstore.write(chunks, folder, size) == (chunks.count(), len(GENOME) + 4)
    store = refstore.Store(folder, most=3)
    rng = random.Random(size)
    for _ in range(200):
        a, b = sorted(rng.randrange(0, len(GENOME) + 20) for _ in range(2))
        assert store.cut("c1", a, b) == GENOME[a:b]
    assert len(store.maps) <= 3 and store.cut("c9", 0, 5) == "" == store.cut(None, 0, 5) == store.cut("c1", None, None)
    a, signals, ref = bam.read_bam(spark, str(d / "bam")), arrays.read_signals(spark, str(d / "signals.parquet")), fasta.read_fasta(spark, str(d / "ref.fa"))
    want = rows(features.site_features(a, signals, ref, k=5).select("read_id", "pos", "strand", "kmer", "signal"))
    got = features.site_features(a, signals, folder, k=5)
    assert rows(got.select("read_id", "pos", "strand", "kmer", "signal")) == want and want
    ledger = features.site_features(a, signals, folder, k=5, ledger=str(tmp_path / "lost"))
    assert rows(ledger.select("read_id", "pos", "strand", "kmer", "signal")) == want
    if size == 10:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join ") == 1  # with the signals alone


def test_a_store_is_whole_or_none(spark, tmp_path):
    none = spark.createDataFrame([], "chr string, chunk int, seq string")
    assert refstore.write(none, str(tmp_path / "none")) == (0, 0) and refstore.Store(str(tmp_path / "none")).cut("c", 0, 9) == ""
    os.makedirs(tmp_path / "half")
    with pytest.raises(FileNotFoundError):
        refstore.Store(str(tmp_path / "half"))
    with pytest.raises(FileExistsError):
        refstore.write(none, str(tmp_path / "half"))
