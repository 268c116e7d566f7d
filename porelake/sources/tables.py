"""Delimited tables of the engine, read with declared schemas; and their writers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text


def _tsv(spark: SparkSession, path: str, schema: str, header: bool) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=header, schema=schema, enforceSchema=True)


def read_calls(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return _tsv(spark, path, schemas.CALLS, header)


def read_wgbs(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.WGBS, False)


def read_binary_calls(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.BINARY_CALLS, True)


def read_threshold_metrics(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.THRESHOLD_METRICS, True)


def read_site_freq(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.SITE_FREQ, True)


def parse_hc_sites(lines: DataFrame, label: int) -> DataFrame:
    """lines(value) -> distinct chr, pos, label; a row whose first field is `chromosome` is a header."""
    f = F.split("value", "\t", -1)
    rows = lines.select(F.get(f, F.lit(0)).alias("chr"), F.expr("try_cast(get(split(value, '\t', -1), 1) as int)").alias("pos"))
    return rows.filter("chr <> 'chromosome' and pos is not null").dropDuplicates(["chr", "pos"]).withColumn("label", F.lit(label))


def read_hc_sites(spark: SparkSession, path: str, label: int) -> DataFrame:
    return parse_hc_sites(spark.read.text(path), label)


def parse_chr_ids(lines: DataFrame) -> DataFrame:
    """lines(value) of `name id`, split at white space -> chr, id; of a repeated name the largest id."""
    f = F.split(F.trim("value"), r"\s+")
    return lines.filter(F.length(F.trim("value")) > 0).select(F.get(f, F.lit(0)).alias("chr"), F.get(f, F.lit(1)).cast("int").alias("id")).groupBy("chr").agg(F.max("id").alias("id"))


def write_calls(calls: DataFrame, path: str) -> None:
    """Detail rows with a header, the rate with six decimals."""
    calls.withColumn("methylation_rate", text.six_decimals(F.col("methylation_rate").cast("double"))).write.option("sep", "\t").option("header", True).option("quote", "\u0000").csv(path)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.option("sep", "\t").option("header", header).csv(path)
