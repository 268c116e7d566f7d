"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from porelake.llm import common, langid, packing, quality

from .test_llm import SF, WORD, awkward, brute, check_packed, empty, shingle_sets

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages(spark):
    docs = common.read(spark, SF, "documents")
    inputs, out = {}, docs
    for name, stage in p.STAGES:
        inputs[name] = out
        out = common.stash(stage(spark, out, SF), "test")
        assert name == p.STAGES[-1][0] or out.columns == p.COLUMNS
    after = dict(zip(inputs, [*list(inputs.values())[1:], out], strict=True))
    ids = lambda d: sorted(r.doc_id for r in d.collect())

    given, kept = inputs["language ID"], after["language ID"]
    model = langid.fit(given.filter("lang is not null and text is not null"))
    said = langid.predict(given, model, ["doc_id"]).collect()
    assert ids(kept) == sorted(r.key.doc_id for r in said if r.lang_pred != "und" and not r.ambiguous) and len(ids(kept)) > 0.97 * docs.count()

    given, kept = inputs["quality classifier"], after["quality classifier"]
    said = quality.grade(given, quality.fit(given, quality.graded(common.read(spark, SF, "labels"))), ["doc_id"]).collect()
    assert ids(kept) == sorted(r.key.doc_id for r in said if r.selected)

    given, kept = inputs["MinHash near-dedup"].collect(), after["MinHash near-dedup"]
    low = brute([d.doc_id for d in given], shingle_sets([d.text for d in given], 5))
    assert ids(kept) == sorted({low[i] for i in low})

    given, mixed = inputs["mixing sources to target weights"], after["mixing sources to target weights"]
    total = sum(len(WORD.findall(d.text)) for d in given.collect())
    assert abs(sum(len(WORD.findall(d.text)) for d in mixed.collect()) - 1.5 * total) <= 25
    assert set(ids(mixed)) <= set(ids(given))

    pieces = packing.pieces(packing.sequences(mixed, ["doc_id"], ranks=None))
    check_packed(pieces.collect(), mixed.collect(), 1024)
    assert pieces.count() == out.count()


def test_near_dedup_by_row(spark):
    """Rows that share a doc_id, or have none, are documents of their own; rows that are repeated are one."""
    text = lambda tag: " ".join(f"{tag}{i}" for i in range(40))
    rows = [
        (1, text("a")), (2, text("a") + " more"), (2, text("b")), (2, text("b")), (3, text("c")), (3, text("d")),
        (None, text("a")), (None, text("e")), (None, text("e") + " more"), (None, text("e")), (None, text("f")), (4, ""), (4, ""), (4, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in p.minhash_near_dedup(spark, docs.repartition(3), SF).collect()]
    (e,) = [x for x in got if x[0] is None and x[1].startswith("e")]
    assert e in rows
    assert sorted(map(str, got)) == sorted(map(str, [rows[0], rows[2], rows[4], rows[5], e, (None, text("f")), (4, ""), (4, None)]))


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_documents(spark, make, tmp_path):
    docs = make(spark).withColumn("key", F.lit(1)).withColumn("rid", F.lit("x")).withColumn("size", F.lit(2))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    common.read(spark, SF, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    got = p.run(spark, str(tmp_path)).collect()
    if make is empty:
        assert got == []
        return
    assert got and {r.doc_id for r in got} <= {1, 2, 6, 7, 8, 9, 10, 12, None}  # not those without a letter
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at and r.length > 0 and r.start + r.length <= r.doc_tokens
            at += r.length
        assert at == 1024 or s == max(r.sequence_id for r in got)


def test_two_runs_agree(spark):
    a, b = (p.run(spark, SF).groupBy().agg(F.bit_xor(F.xxhash64("doc_id", "start", "length", "ids_crc32", "sequence_id")), F.count("*")).first() for _ in range(2))
    assert a == b
