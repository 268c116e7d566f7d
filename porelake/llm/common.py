"""What the operators share: written tables, distributed prefix sums, connected components."""

import atexit
import math
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

#: White space that separates words, and words.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Has Spark hand at most so many rows at once to Python: whole texts are long, and a task holds a batch on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a local master may have none (tests): it gets one of its own.
    Elsewhere the lack of it is an error, as executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="porelake-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts the lineage, and what was computed survives a lost executor.
    Tables that unstash() doesn't delete go when the application ends."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/porelake-{spark.sparkContext.applicationId}"
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _path(spark, top)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(*tables: DataFrame) -> None:
    """Deletes tables of stash() that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_stash_path", None):
            where, fs = _path(df.sparkSession, path)
            fs.delete(where, True)


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text; null: none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def n_words(text: Column) -> Column:
    """Number of words of a text; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread(rows: int, per: int) -> int:
    return max(1, math.ceil(rows / per))


def running_before(df: DataFrame, group: str, order: list[str], value: Column, out: str, rows: int, per: int = 1_000, tie: str | None = None) -> DataFrame:
    """Adds out: the sum of value (long) over the rows that precede a row in its group.

    Two passes: sums inside (group, bucket) pieces of about `per` rows (more, once a group has 65,536 pieces), then prefix sums
    over the pieces' totals. A group of any size is thus spread over many tasks. The order inside a group is (bucket of order, order);
    it depends on the rows alone, whatever their partitions. group must not be null; rows that agree in all of `order` are
    interchangeable. A column `tie` that tells these apart lets a piece that they swell over 4 * per rows be cut further: there rows
    stand by the hash of their order, and equal ones are dealt by tie."""
    n = min(spread(rows, per), 1 << 16)
    most = 4 * max(per, spread(rows, n))
    zero = F.lit(0).cast("long")
    cut = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n))).withColumn("_v", value.cast("long")).withColumn("_c", zero).withColumn("_s", zero)
    if tie:
        swollen = cut.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > most)
        if not swollen.isEmpty():
            # less than rows / most of them: under 65,536 / 4
            cut = cut.join(F.broadcast(swollen), [group, "_b"], "left").withColumn("_c", F.when(F.col("_k").isNotNull(), F.xxhash64(*order, F.lit(1))).otherwise(zero))
            cut = cut.withColumn("_s", F.when(F.col("_k").isNotNull(), F.pmod(F.xxhash64(tie), F.ceil(F.col("_k") / per))).otherwise(zero)).drop("_k")
    piece = [group, "_b", "_c", "_s"]
    inner = Window.partitionBy(*piece).orderBy(*order, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*piece).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(group).orderBy("_b", "_c", "_s").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*piece, F.coalesce(F.sum("_t").over(before), F.lit(0)).cast("long").alias("_base"))
    return (
        cut.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)).cast("long"))
        .join(base, piece)
        .withColumn(out, F.col("_base") + F.col("_in"))
        .drop("_b", "_c", "_s", "_v", "_in", "_base")
    )


def lookup(df: DataFrame, table: DataFrame, key: str, rows: int, how: str = "inner", hot: int = 1_000) -> DataFrame:
    """df joined with table, which has at most one row for a key; keys of df may be as unequal as they like.

    Keys that hold over 1 / hot of df's rows, fewer than `hot` of them, are joined by broadcast; the others by a shuffle."""
    often = df.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > max(rows // hot, 1_000)).select(key)
    if often.isEmpty():
        return df.join(table, key, how)
    often = F.broadcast(often)
    few = F.broadcast(table.join(often, key, "left_semi"))
    return df.join(often, key, "left_anti").join(table, key, how).unionByName(df.join(often, key, "left_semi").join(few, key, how))


def schema(ddl: str, **kinds: DataType) -> StructType:
    """A schema of DDL text in which a name in `kinds` stands for a type that DDL can't write, as of columns of any name."""
    swap = lambda t: (
        StructType([StructField(f.name, kinds[f.name] if f.name in kinds else swap(f.dataType)) for f in t]) if isinstance(t, StructType) else ArrayType(swap(t.elementType)) if isinstance(t, ArrayType) else t
    )
    return swap(StructType.fromDDL(ddl))


def key_struct(keys: list[str]) -> Column:
    """The key columns in one struct, so that their names can't clash with an operator's own."""
    return F.struct(*(F.col(f"`{k}`") for k in keys)).alias("key")


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """edges(u, v) of longs -> (node, root), for the nodes that have an edge: root is the smallest node reachable.

    Alternates large-star and small-star contraction on the edge list; each round is two aggregations and two
    joins, whose state is written to the shared folder, so rounds neither gather a node's neighbours in one row nor lengthen
    the lineage. Ends when a round changes nothing. Self-edges and repeated edges are allowed."""
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stash(e, name)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct()
        new = stash(small, name)
        unstash(e)
        e = new
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def keyed(docs: DataFrame, keys: list[str]) -> DataFrame:
    """key, a struct of the keys, and text, unless it is one of the keys; for mapInArrow, which reads it with text_of()."""
    return docs.select(key_struct(keys), *([] if "text" in keys else ["text"]))


def text_of(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("text") if "text" in batch.schema.names else batch.column("key").field("text")
