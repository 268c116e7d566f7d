"""From raw files to calls as a stream: new BAM files are joined to signals and reference, go through the kernel and the scorer, and end in
one folder for each micro-batch."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import features, scoring
from ..sources import bam


def stream_files(spark: SparkSession, path: str, max_bytes: int = 4 << 30, pattern: str = "*.bam") -> DataFrame:
    """path, length of a folder's new files, those of about max_bytes together in a batch, one at least. Their contents aren't read here."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return files.option("pathGlobFilter", pattern).option("maxBytesPerTrigger", max_bytes).load(path).select("path", "length")


def stream_bam(spark: SparkSession, path: str, max_bytes: int = 4 << 30, split: int = 64 << 20) -> DataFrame:
    """Alignments of a folder's new BAM files. A file must appear whole (be moved there); inside a batch it is spread over tasks by its splits."""
    return bam.alignments_of(stream_files(spark, path, max_bytes), split)


def call_files(
    spark: SparkSession, path: str, raw_reads: DataFrame, reference: DataFrame | str, scorer: scoring.Scorer, output: str, checkpoint: str, max_bytes: int = 4 << 30, split: int = 64 << 20,
    once: bool = True, **kernel,
) -> StreamingQuery:
    """Starts the stream: output/batch=<n> gets the calls of the n-th micro-batch's files. A batch that runs again, after a restart too, has the
    same files by the checkpoint's log and replaces its own folder, so calls are neither lost nor repeated; max_bytes bounds what is under
    way. raw_reads and reference are tables, the latter rather a folder of refstore.write(); of the signals, only those of the batch's own signal files are read past a join by file name.
    once: what is there now, then it ends. Other arguments are site_features()'s."""

    def batch(alignments: DataFrame, n: int) -> None:
        names = alignments.select("file_name").distinct()
        made = features.site_features(alignments, raw_reads.join(names, "file_name", "left_semi"), reference, **kernel)
        scoring.call_mods(made, scorer).write.mode("overwrite").parquet(f"{output}/batch={n}")

    w = stream_bam(spark, path, max_bytes, split).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def read_calls(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(output).withColumn("batch", F.col("batch").cast("long"))
