"""FASTA references: read line by line in splits, or from whole records."""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bases of a piece that a task hands on, and of a chunk.
PIECE, CHUNK = 1 << 16, 1_000_000


def parse_records(records: DataFrame) -> DataFrame:
    """records(value), each a record without its `>` -> chr (up to the first space of the header), seq (lines joined, in upper case).
    Records without bases are dropped. Rows have no order: of a repeated name the last by (length, text) stays."""
    header = F.substring_index("value", "\n", 1)
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    rows = records.filter(F.length("value") > 0).select(
        F.regexp_replace(F.substring_index(header, " ", 1), r"\r", "").alias("chr"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq")
    )
    return rows.filter("chr <> '' and seq <> ''").groupBy("chr").agg(F.max_by("seq", F.struct(F.length("seq"), "seq")).alias("seq"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits, in order -> pieces of bases: which record of the split they belong to (0: the one that the split begins in), its
    name, and where in the split's part of it they stand. A header makes a piece without bases."""
    file = block = name = None
    nth, at, held, size, out = 0, 0, [], 0, []

    def close() -> None:
        nonlocal at, size
        seq = "".join("".join(held).split()).upper()
        held.clear()
        size = 0
        if seq:
            out.append((file, block, nth, name, at, seq))
            at += len(seq)

    for batch in batches:
        files, blocks, lines = (batch.column(c) for c in ("file", "block", "value"))
        cuts = {0, batch.num_rows} | {i + 1 for c in (files, blocks) for i in pc.indices_nonzero(pc.not_equal(c[1:], c[:-1])).to_pylist()} if batch.num_rows else set()
        cuts = sorted(cuts | set(pc.indices_nonzero(pc.starts_with(lines, ">")).to_pylist()))
        for a, b in zip(cuts, cuts[1:], strict=False):
            where = files[a].as_py(), blocks[a].as_py()
            if where != (file, block):
                close()
                (file, block), nth, name, at = where, 0, None, 0
            head = lines[a].as_py()
            if head.startswith(">"):
                close()
                nth, name, at = nth + 1, head[1:].split(" ", 1)[0], 0
                out.append((file, block, nth, name, 0, ""))
                a += 1
            for lo in range(a, b, 1024):
                more = lines[lo : min(lo + 1024, b)].to_pylist()
                held += more
                size += sum(map(len, more))
                if size >= PIECE:
                    close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i != 3 else pa.array(c, pa.string()) for i, c in enumerate(zip(*out, strict=True))], ["file", "block", "nth", "name", "at", "seq"])
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) if i != 3 else pa.array(c, pa.string()) for i, c in enumerate(zip(*out, strict=True))], ["file", "block", "nth", "name", "at", "seq"])


def read_chunks(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """FASTA files -> chr (the header up to its first space), chunk, at (its first base), seq: fixed pieces of `size` bases, in upper case.

    Files are read in Spark's splits of lines. What stands before a split's first header belongs to a record of an earlier split: a scan
    over the splits, of which there is one row each, hands on the record and how many of its bases came before, and each piece of bases is then
    cut at its own offset. So a chromosome is spread over as many tasks as it has splits and chunks. Only a `>` at a line's start begins
    a record; of a repeated name the last one that has bases stays, in the order of paths and lines; records without a name or without bases are
    dropped. The files are read twice."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = lines.mapInArrow(_pieces, "file string, block long, nth long, name string, at long, seq string")
    parts = pieces.groupBy("file", "block", "nth").agg(F.max("name").alias("name"), F.sum(F.length("seq")).alias("n"))
    # a split: its last record, how many bases it has of that, and of the one before its first header
    last = F.max_by(F.struct("nth", "name", "n"), "nth")
    splits = parts.groupBy("file", "block").agg(last.alias("last"), F.sum(F.when(F.col("nth") == 0, F.col("n")).otherwise(0)).alias("lead"))
    by = Window.partitionBy("file").orderBy("block")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    run = splits.withColumn("led", F.sum("lead").over(by)).withColumn("own", F.when(F.col("last.nth") > 0, F.struct("block", "last.nth", "last.name", "last.n", "led")))
    open_ = F.last("own", ignorenulls=True).over(earlier)
    carried = run.select("file", "block", open_.alias("from"), (F.col("led") - F.col("lead")).alias("until")).filter("from is not null")
    carried = carried.select("file", "block", F.col("from.block").alias("_rb"), F.col("from.nth").alias("_rn"), F.col("from.name").alias("_name"), (F.col("from.n") + F.col("until") - F.col("from.led")).alias("_before"))
    whose = lambda df: (  # noqa: E731  a row's record, by the split and place of its header, and what came before it
        df.join(carried.withColumn("nth", F.lit(0).cast("long")), ["file", "block", "nth"], "left").filter("nth > 0 or _rb is not null")
        .withColumns({"name": F.coalesce("name", "_name"), "_before": F.coalesce("_before", F.lit(0)), "_rb": F.coalesce("_rb", "block"), "_rn": F.coalesce("_rn", "nth")})
    )
    records = whose(parts).filter("name <> ''").groupBy("file", "_rb", "_rn").agg(F.max("name").alias("name"), F.sum("n").alias("n")).filter("n > 0")
    kept = records.groupBy("name").agg(F.max(F.struct("file", "_rb", "_rn")).alias("r")).select("name", "r.*")
    placed = whose(pieces.filter("seq <> ''")).join(kept, ["file", "_rb", "_rn", "name"], "left_semi").withColumn("at", F.col("at") + F.col("_before"))
    first, end = F.floor(F.col("at") / size), F.floor((F.col("at") + F.length("seq") - 1) / size)
    cut = placed.select(F.col("name").alias("chr"), "at", "seq", F.explode(F.sequence(first, end)).alias("chunk"))
    lo = F.greatest(F.lit(0), F.col("chunk") * size - F.col("at"))
    part = F.substring("seq", (lo + 1).cast("int"), F.least(F.lit(size), (F.col("chunk") + 1) * size - F.col("at") - lo).cast("int"))
    cut = cut.select("chr", F.col("chunk").cast("int").alias("chunk"), F.struct((F.col("at") + lo).alias("at"), part.alias("seq")).alias("x"))
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["seq"]))
    return cut.groupBy("chr", "chunk").agg(joined.alias("seq")).select("chr", "chunk", (F.col("chunk").cast("long") * size).alias("at"), "seq")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """read_chunks() put together: chr, seq, a row for each chromosome."""
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]))
    return read_chunks(spark, path).groupBy("chr").agg(whole.alias("seq"))


def chunked(reference: DataFrame, size: int = CHUNK, overlap: int = 100_000) -> DataFrame:
    """chr, chunk, at (its first base), seq: pieces of `size` bases and `overlap` more, for genomes too large to broadcast. Sequences are cut as
    bytes, of which a part is found without reading what stands before it."""
    chunk = F.explode(F.sequence(F.lit(0), F.expr(f"cast((greatest(length(seq), 1) - 1) div {size} as int)")))
    pieces = reference.select("chr", F.col("seq").cast("binary").alias("seq"), chunk.alias("chunk"))
    return pieces.select("chr", "chunk", (F.col("chunk") * size).alias("at"), F.expr(f"cast(substring(seq, chunk * {size} + 1, {size + overlap}) as string)").alias("seq"))


def max_name_length(reference: DataFrame) -> DataFrame:
    return reference.agg(F.max(F.length("chr")).alias("width"))
