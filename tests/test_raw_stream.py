"""From BAM files to calls as a stream."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from porelake.operators import features, scoring
from porelake.sources import arrays, bam, fasta
from porelake.streaming import raw

from .test_engine import GENOME, genome, rows  # noqa: F401


def test_files_to_calls_with_restarts(spark, genome, tmp_path):  # noqa: F811
    d, made, _ = genome
    (tmp_path / "in").mkdir()
    signals, ref = arrays.read_signals(spark, str(d / "signals.parquet")), fasta.read_fasta(spark, str(d / "ref.fa"))
    scorer = scoring.ConstantScorer(0.25)
    for i, r in enumerate(made):  # one read a file
        bam.write_bam(str(tmp_path / f"{i}.bam"), [("c1", len(GENOME))], [r])
    go = lambda **kw: raw.call_files(spark, str(tmp_path / "in"), signals, ref, scorer, str(tmp_path / "out"), str(tmp_path / "log"), max_bytes=1, k=5, **kw).awaitTermination()
    for i in (0, 1):
        shutil.move(tmp_path / f"{i}.bam", tmp_path / "in")
    go()
    first = raw.read_calls(spark, str(tmp_path / "out"))
    assert {r.batch for r in first.collect()} == {0, 1}  # a file a batch, as max_bytes has it
    go()  # nothing new
    shutil.move(tmp_path / "2.bam", tmp_path / "in")
    # the third batch is planned, but its commit is lost: it runs again and replaces its folder
    go()
    os.remove(tmp_path / "log" / "commits" / "2")
    crc = tmp_path / "log" / "commits" / ".2.crc"
    if crc.exists():
        os.remove(crc)
    go()
    whole = scoring.call_mods(features.site_features(bam.read_bam(spark, str(d / "bam")), signals, ref, k=5), scorer)
    got = raw.read_calls(spark, str(tmp_path / "out"))
    assert rows(got.drop("batch")) == rows(whole) and got.select("batch").distinct().count() == 3


def test_alignments_of_files_like_the_source(spark, genome):  # noqa: F811
    files = spark.createDataFrame([(f"file://{genome[0]}/bam/one.bam",)], "path string")
    for split in (50, 64 << 20):
        assert rows(bam.alignments_of(files, split)) == rows(bam.read_bam(spark, str(genome[0] / "bam")))
    assert bam.alignments_of(files.limit(0)).count() == 0
    with pytest.raises(Exception, match="not a B"):
        bam.alignments_of(spark.createDataFrame([(f"{genome[0]}/ref.fa",)], "path string")).select(F.count("*")).collect()
