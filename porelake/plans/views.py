"""The engine's tables derived from the driver's, in Spark and as SQL for DuckDB."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as cg


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def even(df: DataFrame) -> DataFrame:
    """df over all cores, where its scan has fewer partitions than there are: a small file of one row group is else one task. A scan of
    many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, read_id, chr, pos (quarter hour of the day), prob (hundredths)."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("read_id"), F.col("event_type").alias("chr"),
        F.expr("cast(hour(ts) * 4 + minute(ts) div 15 as bigint)").alias("pos"), F.expr("pmod(cast(round(value * 100) as bigint), 101) / 100").alias("prob"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of the odd events: chr, start, end, ratio, cov."""
    odd = calls(spark, sf_dir).filter("event_id % 2 = 1")
    return odd.groupBy("chr", F.col("pos").alias("start")).agg((F.sum(F.expr("cast(round(prob * 100) as bigint)")) / F.count(F.lit(1)) / F.lit(100.0)).alias("ratio"), F.count(F.lit(1)).alias("cov")).withColumn("end", F.col("start") + 1)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls, with a label made of event_id and prob."""
    return calls(spark, sf_dir).withColumn("label", F.expr("cast((event_id div 2) % 7 + prob * 4 > 4 as int)"))


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select(F.col("read_id").alias("read_name"), F.col("chr").alias("chrom"), "pos", (F.col("prob") > 0.5).cast("int").alias("prob"))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return even(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments made of the order lines."""
    q, n, p, s = "cast(l_quantity as int)", "l_linenumber", "cast(l_partkey % 3 as int)", "cast(l_suppkey % 4 as int)"
    text = f"concat({n}, 'S', {q}, 'M', {p} + 1, 'I', {s} + 1, 'D', {q} + 5, 'M', case when {p} = 0 then '2S' else '' end)"
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_returnflag")
    rows = even(lines).select(
        "l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("read_id"), F.expr(text).alias("cigar_text"),
        F.expr("case l_returnflag when 'R' then 16 when 'A' then 4 else 0 end").alias("flag"), F.expr(q).alias("mapq"), F.col("l_partkey").cast("int").alias("ref_start"),
        F.expr("cast(l_suppkey % 5 as int) - 1").alias("nm"), F.concat(F.lit("chr"), F.expr("l_suppkey % 23").cast("string")).alias("chr"),
        F.expr(f"{n} + {q} + {p} + 1 + {q} + 5 + case when {p} = 0 then 2 else 0 end").alias("seq_len"),
    )
    return rows.withColumn("cigar", cg.parse_cigar(F.col("cigar_text")))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return even(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x * 1000, 0) + F.lit(0.0)).alias("raw"))


def kernel_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(alignments, raw reads, reference, labels): a read of five bases for each vector, at eight places of the documents' bases."""
    v = even(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), "embedding"))
    name, file = F.concat(F.lit("v"), F.col("v").cast("string")), F.concat(F.lit("f"), (F.col("v") % 3).cast("string"))
    raw = v.select(file.alias("file_name"), name.alias("read_id"), F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("smallint")).alias("signal"), F.lit(-5.0).cast("float").alias("offset"), F.lit(0.5).cast("float").alias("scale"))
    pick = lambda *x: F.element_at(F.array(*(F.lit(i) for i in x)), (F.col("v") % 4 + 1).cast("int"))
    a = v.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(
        "v", name.alias("read_id"), file.alias("file_name"), (F.col("v") % 2 * 16).cast("int").alias("flag"), (F.col("v") % 60).cast("int").alias("mapq"),
        F.concat(F.lit("d"), (F.col("v") % 200).cast("string")).alias("chr"), ((F.col("v") + F.col("u") * 5) % 40).cast("int").alias("ref_start"), pick(5, 4, 6, 4).alias("ref_len"), pick(0, 1, 0, 0).alias("q_start"),
        F.lit(5).alias("q_end"), pick(5, 4, 5, 5).alias("q_len"), cg.parse_cigar(pick("5M", "1S4M", "2M1D3M", "2M1I2M")).alias("cigar"), F.lit("ACGTA").alias("seq"),
        F.substring(F.lit("!I+5?!I+5?"), (F.col("v") % 5 + 1).cast("int"), F.lit(5)).alias("qual"), F.expr("cast(v div 4 % 3 as int)").alias("nm"), F.lit(2).alias("stride"),
        F.expr("array(0, cast(1 + v % 3 as int), cast(6 + v % 5 as int), cast(14 + v % 7 as int), 24, 32)").alias("moves"), F.lit(0).alias("trim_start"),
        F.lit(64).alias("num_samples"), F.lit(False).alias("is_split"), F.lit(None).cast("string").alias("parent_read"), F.lit(None).cast("int").alias("split"), F.lit(True).alias("is_mapped"),
    ).withColumn("ref_end", F.col("ref_start") + F.col("ref_len")).withColumn("is_forward", F.col("flag") == 0)
    reference = dna(spark, sf_dir).filter("seq <> ''").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chr"), "seq")
    labels = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chr"), F.explode(F.sequence(F.lit(0), F.lit(60))).alias("pos"))
    return a.drop("v"), raw, reference, labels.filter("pos % 5 <> 0").withColumn("label", F.col("pos") % 2)


# The same for DuckDB, as common table expressions.
SQL = {
    "calls": """calls AS (SELECT event_id, 'r' || user_id::VARCHAR AS read_id, event_type AS chr, (hour(ts) * 4 + minute(ts) // 15)::BIGINT AS pos,
        ((round(value * 100)::BIGINT % 101 + 101) % 101) / 100::DOUBLE AS prob FROM events)""",
    "truth": """truth AS (SELECT chr, pos AS start, pos + 1 AS "end", sum(round(prob * 100)::BIGINT)::DOUBLE / count(*) / 100::DOUBLE AS ratio, count(*)::BIGINT AS cov
        FROM calls WHERE event_id % 2 = 1 GROUP BY chr, pos)""",
    "labelled": """labelled AS (SELECT *, ((event_id // 2) % 7 + prob * 4 > 4)::INTEGER AS label FROM calls)""",
    "binary_calls": """binary_calls AS (SELECT read_id AS read_name, chr AS chrom, pos, (prob > 0.5::DOUBLE)::INTEGER AS prob FROM calls)""",
    "dna": """dna AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)""",
    "aln": """aln AS (SELECT l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber AS read_id,
        l_linenumber::VARCHAR || 'S' || l_quantity::INTEGER || 'M' || (l_partkey % 3 + 1) || 'I' || (l_suppkey % 4 + 1) || 'D' || (l_quantity::INTEGER + 5) || 'M' ||
        CASE WHEN l_partkey % 3 = 0 THEN '2S' ELSE '' END AS cigar_text,
        CASE l_returnflag WHEN 'R' THEN 16 WHEN 'A' THEN 4 ELSE 0 END AS flag, l_quantity::INTEGER AS mapq, l_partkey::INTEGER AS ref_start,
        (l_suppkey % 5)::INTEGER - 1 AS nm, 'chr' || (l_suppkey % 23) AS chr,
        (l_linenumber + l_quantity::INTEGER + l_partkey % 3 + 1 + l_quantity::INTEGER + 5 + CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 0 END)::INTEGER AS seq_len FROM lineitem)""",
    "ops": """ops AS (SELECT *, list_transform(regexp_extract_all(cigar_text, '\\d+[MIDNSHP=X]'), lambda t: {'op': right(t, 1), 'len': left(t, len(t) - 1)::INTEGER}) AS c FROM aln)""",
    "extents": """extents AS (SELECT *, list_sum(list_transform(c, lambda x: CASE WHEN x.op IN ('M','D','N','=','X') THEN x.len ELSE 0 END))::INTEGER AS ref_len,
        CASE WHEN c[1].op = 'S' THEN c[1].len ELSE 0 END AS q_start, seq_len - CASE WHEN c[-1].op = 'S' THEN c[-1].len ELSE 0 END AS q_end,
        list_sum(list_transform(c, lambda x: CASE WHEN x.op = 'M' THEN x.len ELSE 0 END))::DOUBLE AS m,
        list_sum(list_transform(c, lambda x: CASE WHEN x.op IN ('M','I','D') THEN x.len ELSE 0 END))::DOUBLE AS align FROM ops)""",
    "kernel": """reads AS (SELECT vec_id AS v, v % 2 = 0 AS fwd, 'd' || (v % 200) AS chr, ((v + u * 5) % 40)::INTEGER AS s, [5, 4, 6, 4][v % 4 + 1] AS n, embedding FROM embeddings CROSS JOIN (SELECT unnest(range(0, 8)) AS u)
        WHERE v % 60 >= 20 AND ([5, 4, 5, 4][v % 4 + 1] - (v // 4) % 3) / [5, 4, 6, 5][v % 4 + 1]::DOUBLE >= 0.8::DOUBLE),
    pa AS (SELECT *, list_transform(embedding, lambda x: (0.5::FLOAT * (round(x::DOUBLE * 1000)::FLOAT - 5::FLOAT))::FLOAT) AS pa FROM reads),
    med AS (SELECT *, list_sort(pa)[32] AS med FROM pa), mad AS (SELECT *, list_sort(list_transform(pa, lambda x: abs(x - med)))[32] AS mad FROM med),
    norm AS (SELECT *, CASE WHEN mad = 0 THEN pa ELSE list_transform(pa, lambda x: ((x - med)::FLOAT / (mad / 0.674489::FLOAT)::FLOAT)::FLOAT) END AS x,
        [0, 1 + v % 3, 6 + v % 5, 14 + v % 7, 24, 32] AS mv, substr('!I+5?!I+5?', (v % 5 + 1)::INTEGER, 5) AS q0 FROM mad),
    bases AS (SELECT *, list_transform(range(1, 6), lambda i: (mv[i + 1] - mv[i]) * 2) AS len, list_transform(range(1, 6), lambda i: mv[i] * 2) AS edge,
        CASE WHEN fwd THEN q0 ELSE reverse(q0) END AS qual FROM norm),
    groups AS (SELECT *, list_transform(range(1, 6), lambda i: CASE WHEN len[i] < 15 THEN least(greatest(edge[i] - (15 - len[i]) // 2, 0), 49) WHEN len[i] > 15 THEN edge[i] + (len[i] - 15) // 2 ELSE edge[i] END) AS g FROM bases),
    refs AS (SELECT g.*, CASE WHEN fwd THEN substr(d.seq, s + 1, n) ELSE reverse(translate(substr(d.seq, s + 1, n), 'ACGT', 'TGCA')) END AS ref,
        CASE WHEN fwd THEN [[0, 1, 2, 3, 4], [1, 2, 3, 4], [0, 1, 2, 2, 3, 4], [0, 1, 3, 4]][v % 4 + 1] ELSE [[0, 1, 2, 3, 4], [0, 1, 2, 3], [0, 1, 2, 3, 3, 4], [0, 1, 3, 4]][v % 4 + 1] END AS map
        FROM groups g JOIN dna d ON g.chr = 'd' || d.doc_id WHERE len(substr(d.seq, s + 1, n)) = n),
    sites AS (SELECT * FROM (SELECT *, unnest(range(1, n - 1))::INTEGER AS i FROM refs) WHERE substr(ref, i + 1, 1) = 'C'),
    placed AS (SELECT *, CASE WHEN fwd THEN s + i ELSE s + n - 1 - i END AS pos FROM sites),
    rows3 AS (SELECT *, unnest([-1, 0, 1]) AS j FROM placed WHERE pos <= 60 AND pos % 5 <> 0),
    one AS (SELECT *, map[i + j + 1] + 1 AS b, instr('ACGT', substr(ref, i + j + 1, 1)) - 1 AS code FROM rows3)""",
    "signal": """signal AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 1000) + 0::DOUBLE) AS raw FROM embeddings)""",
}


def sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
