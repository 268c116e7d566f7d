"""Site frequencies against bisulfite truth."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import reads, sites


def sure_truth(wgbs: DataFrame, min_cov: int = 5) -> DataFrame:
    return wgbs.na.drop("any").filter(F.col("cov") > min_cov)


def frequency_pairs(calls: DataFrame, wgbs: DataFrame, threshold: float = 0.5, min_count: int = 5, min_cov: int = 5) -> DataFrame:
    """chr, start, ratio, frequency of the sites of more than min_count calls and a coverage over min_cov."""
    freq = sites.aggregate_sites(calls, threshold, with_count=True).filter(F.col("count") > min_count)
    return freq.join(sure_truth(wgbs, min_cov).select("chr", "start", "ratio"), ["chr", "start"]).select("chr", "start", "ratio", "frequency")


def _pearson(a: str, b: str) -> Column:
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson(pairs: DataFrame, a: str = "ratio", b: str = "frequency") -> DataFrame:
    """n and pearson of two columns; null where one of them doesn't vary."""
    return pairs.agg(F.count(F.lit(1)).alias("n"), _pearson(a, b).alias("pearson"))


def correlation_matrix(pairs: DataFrame, columns: tuple[str, ...] = ("ratio", "frequency")) -> DataFrame:
    """row, column, value for each pair of columns, in one aggregation."""
    cells = [F.struct(F.lit(a).alias("row"), F.lit(b).alias("column"), _pearson(a, b).alias("value")) for a in columns for b in columns]
    return pairs.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def downsample_curve(calls: DataFrame, wgbs: DataFrame, total: float, levels: tuple[int, ...] = (5, 10, 15, 20, 25, 30), threshold: float = 0.5, min_count: int = 5, min_cov: int = 5) -> DataFrame:
    """coverage, n, pearson for each level of downsampled reads. A site's calls are counted for all levels at once, by the levels that
    their read is among."""
    one = sites.binarise(F.col("prob"), threshold)
    sampled = {c: reads.sampled(F.col("read_id"), min(1.0, c / total)) for c in levels}
    counts = calls.groupBy("chr", F.col("pos").alias("start")).agg(*(F.sum(F.when(on, x).otherwise(0)).alias(f"{n}_{c}") for c, on in sampled.items() for n, x in (("count", F.lit(1)), ("methy", one))))
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("coverage"), F.col(f"count_{c}").alias("count"), F.col(f"methy_{c}").alias("methy")) for c in levels)))
    freq = counts.select("chr", "start", each).filter(F.col("count") > min_count).withColumn("frequency", F.lit(100.0) * F.col("methy") / F.col("count"))
    pairs = freq.join(sure_truth(wgbs, min_cov).select("chr", "start", "ratio"), ["chr", "start"])
    found = pairs.groupBy("coverage").agg(F.count(F.lit(1)).alias("n"), _pearson("ratio", "frequency").alias("pearson"))
    grid = calls.sparkSession.createDataFrame([(int(c),) for c in levels], "coverage int")
    return grid.join(found, "coverage", "left").select("coverage", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "pearson")
