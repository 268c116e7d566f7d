"""Reads without features are written aside, each with its reason."""

import collections

from pyspark.sql import functions as F

from porelake import schemas
from porelake.operators import features, reads

from .test_engine import GENOME, bam, fasta, genome, rows  # noqa: F401

_ = genome


def test_kept_and_dropped_are_all(spark, genome, tmp_path):  # noqa: F811
    d = genome[0]
    good = bam.read_bam(spark, str(d / "bam"))
    raw = spark.read.schema(schemas.RAW_READS).parquet(str(d / "signals.parquet"))
    ref = fasta.read_fasta(spark, str(d / "ref.fa"))
    first = good.orderBy("read_id").limit(1)
    bad = {
        "unmapped": {"is_mapped": F.lit(False)}, "no sequence": {"seq": F.lit(None).cast("string")}, "low quality": {"mapq": F.lit(3)}, "no moves": {"moves": F.lit(None).cast("array<int>")},
        "no reference": {"chr": F.lit("c99")}, "no file": {"file_name": F.lit("other.pod5")}, "no read": {"parent_read": F.lit(None).cast("string"), "is_split": F.lit(False)},
        "empty signal": {}, "kernel": {"stride": F.lit(1_000_000)}, "excluded flag": {"flag": F.lit(256)}, "no site": {"chr": F.lit("at")},
    }
    every = good
    for why, change in bad.items():
        one = first.withColumn("read_id", F.lit(f"bad {why}"))
        signal = raw.filter(F.col("read_id") == first.first().read_id).withColumn("read_id", F.lit(f"bad {why}"))
        if why != "no read":
            raw = raw.unionByName(signal.withColumn("signal", F.array().cast("array<smallint>")) if why == "empty signal" else signal)
        every = every.unionByName(one.withColumns(change) if change else one)
    ref = ref.unionByName(spark.createDataFrame([("at", "A" * len(GENOME))], schemas.REFERENCE))
    plain = features.site_features(every, raw, ref, k=5, exclude_flags=256)
    kept = features.site_features(every, raw, ref, k=5, exclude_flags=256, ledger=str(tmp_path / "ledger"))
    columns = ["read_id", "pos", "strand", "kmer", "signal"]
    assert rows(kept.select(columns)) == rows(plain.select(columns))
    names = {r.read_id for r in kept.select("read_id").distinct().collect()}
    lost = features.read_ledger(spark, str(tmp_path / "ledger"))
    got = collections.Counter((r.read_id, r.reason) for r in lost.collect())
    assert {(r, why) for r, why in got if r.startswith("bad")} == {(f"bad {why}", why) for why in bad} and set(bad) == set(reads.REASONS)
    assert max(got.values()) == 1 and len(names) + len(got) == every.count() and not names & {r for r, _ in got}
