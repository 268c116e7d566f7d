"""Incremental mode: files of features or calls as streams, through the same transforms, into append sinks."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import scoring


def stream_features(spark: SparkSession, path: str, schema: str | None = None, max_files: int = 64) -> DataFrame:
    """New Parquet files of a folder, at most max_files in a batch: what bounds the rows in flight."""
    return spark.readStream.schema(schema or schemas.FEATURES).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_calls(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(schemas.CALLS).option("maxFilesPerTrigger", max_files).option("sep", "\t").option("header", True).csv(path)


def call_stream(features: DataFrame, scorer: scoring.Scorer, batch: int = 1024) -> DataFrame:
    """Stateless: each micro-batch is scored as it comes."""
    return scoring.call_mods(features, scorer, batch)


def append(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to Parquet, each input row once even if the query is started again; once: what is there now, then ends."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def for_each_batch(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    w = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def running_sites(calls: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts of each site so far; state is a row for each site. For the update or complete mode."""
    one = (F.col("methylation_rate") > threshold).cast("int")
    out = calls.groupBy(F.col("chromosome").alias("chr"), F.col("pos_in_strand").alias("start")).agg(F.count(F.lit(1)).alias("count"), F.sum(one).alias("methy"))
    return out.withColumn("frequency", F.lit(100.0) * F.col("methy") / F.col("count"))
