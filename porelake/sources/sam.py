"""SAM text to alignments, in native expressions."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import signal as sg


def _tag(name: str, kind: str) -> Column:
    """Value of a tag `name:kind:value` of the row's tags, the first of a repeated one; null if there is none."""
    return F.substr(F.get(F.filter("tags", lambda t: t.startswith(f"{name}:{kind}")), F.lit(0)), F.lit(6))


def derive(a: DataFrame) -> DataFrame:
    """Adds flags, extents and split-read fields to rows with flag, pos0, cigar, seq, parent_read. Extents of unmapped reads are null."""
    mapped = F.col("flag").bitwiseAND(4) == 0
    a = a.withColumn("is_forward", F.col("flag").bitwiseAND(16) == 0).withColumn("is_mapped", mapped).withColumn("is_split", F.col("parent_read").isNotNull())
    on = lambda c: F.when(mapped & (F.size("cigar") > 0), c)
    seq_len = F.length(F.coalesce("seq", F.lit("")))
    a = a.withColumn("ref_start", on(F.col("pos0"))).withColumn("ref_len", on(cg.reference_length(F.col("cigar")))).withColumn("q_start", on(cg.query_start(F.col("cigar")))).withColumn("q_end", on(cg.query_end(F.col("cigar"), seq_len)))
    return a.withColumn("ref_end", F.col("ref_start") + F.col("ref_len")).withColumn("q_len", F.col("q_end") - F.col("q_start")).drop("pos0")


COLUMNS = [
    "read_id", "flag", "chr", "mapq", "ref_start", "ref_end", "ref_len", "q_start", "q_end", "q_len", "cigar", "seq", "qual", "is_forward", "is_mapped", "is_split",
    "parent_read", "split", "num_samples", "trim_start", "stride", "moves", "nm", "md", "file_name", "rnext", "pnext", "tlen",
]


def parse_sam(lines: DataFrame) -> DataFrame:
    """lines(value) -> alignments. Header lines and lines of fewer than 11 fields are left out; a missing tag is null, a missing NM -1;
    `*` is null."""
    # a line is made and split once: filters on either would be moved below and make it again
    whole = lambda f: (F.size(f) >= 11) & ~F.get(f, F.lit(0)).startswith("@")
    f = lines.select(F.explode_outer(F.filter(F.array(F.split("value", "\t", -1)), whole)).alias("f")).filter(F.col("f").isNotNull())
    col = lambda i: F.get("f", F.lit(i))
    known = lambda c: F.nullif(c, F.lit("*"))
    rows = f.select(
        col(0).alias("read_id"), col(1).cast("int").alias("flag"), known(col(2)).alias("chr"), (col(3).cast("int") - 1).alias("pos0"), col(4).cast("int").alias("mapq"),
        cg.parse_cigar(col(5)).alias("cigar"), known(col(6)).alias("rnext"), col(7).cast("int").alias("pnext"), col(8).cast("bigint").alias("tlen"),
        known(col(9)).alias("seq"), known(col(10)).alias("qual"), F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))).alias("tags"),
    )
    mv = F.transform(F.split(F.regexp_replace(_tag("mv", "B"), r"^[a-zA-Z],?", ""), ","), lambda x: x.try_cast("int"))
    rows = rows.select(
        "*", _tag("fn", "Z").alias("file_name"), _tag("ts", "i").cast("int").alias("trim_start"), _tag("ns", "i").cast("int").alias("num_samples"),
        F.coalesce(_tag("NM", "i").cast("int"), F.lit(-1)).alias("nm"), _tag("MD", "Z").alias("md"), _tag("pi", "Z").alias("parent_read"),
        _tag("sp", "i").cast("int").alias("split"), mv.alias("mv"),
    ).withColumn("mv", sg.move_table(F.col("mv")))
    return derive(rows).withColumn("stride", F.col("mv.stride")).withColumn("moves", F.col("mv.moves")).select(COLUMNS)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))
