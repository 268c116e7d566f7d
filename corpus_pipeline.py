"""The corpus pipeline: language ID, quality classifier, MinHash near-dedup, mixing sources to target weights, packing.

Each stage takes (spark, docs, sf_dir), docs having the columns of documents, and works on all that its predecessor kept; all but the
last return those columns. An empty or null text is rejected by the first stage; rows that are repeated are copies of each other."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porelake.llm import langid, minhash, mixing, quality
from porelake.llm.common import read, small_batches, stash, unstash
from porelake.llm.queries import digested, pack_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (`und`) and those whose decoding is ambiguous; a null lang becomes the predicted one."""
    small_batches(spark)
    docs = docs.select(COLUMNS)
    model = langid.fit(docs.filter("lang is not null and text is not null"))
    said = langid.predict(docs, model, COLUMNS).filter((F.col("lang_pred") != langid.UND) & ~F.col("ambiguous")).select("key.*", "lang_pred")
    return said.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose probability of the highest grade, neither of low quality nor toxic, is under one half."""
    small_batches(spark)
    docs = docs.select(COLUMNS)
    model = quality.fit(docs, quality.graded(read(spark, sf_dir, "labels")))
    return quality.grade(docs, model, COLUMNS).filter("selected").select("key.*")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (five words, 80 %): that of the least doc_id, a null one last, and the least hash.

    Rows are told apart by all their columns, so that rows of one doc_id, or of none, with different texts are different documents."""
    small_batches(spark)
    docs = docs.select(COLUMNS)
    nulls = F.concat(*(F.col(c).isNull().cast("int").cast("string") for c in COLUMNS))  # hashes leave nulls out
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(*COLUMNS).alias("h1"), F.xxhash64(nulls, *COLUMNS).alias("h2"))
    docs = docs.withColumn("_row", row)
    kept = minhash.near_duplicates(docs, "_row").filter("kept").select("_row").distinct()
    return docs.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and round of its source that takes some of it, with the text that it takes."""
    small_batches(spark)
    out = mixing.mixed_texts(*mixing.mix(docs.select(COLUMNS), with_texts=True))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts of the mix into sequences of 1,024 ids: a row for each piece, with its digest. Null and empty texts give the end id
    alone, repeated rows are packed each, an empty table gives no rows."""
    small_batches(spark)
    return digested(pack_documents(docs, ["doc_id"]))


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: The classifiers can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, out = out, stage(spark, out, sf_dir)
        if i < len(STAGES) - 1:
            out = stash(out, "stage")
            unstash(before)
    return out
