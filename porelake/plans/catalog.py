"""The registered queries of the engine's operators over the driver's tables, and the SQL that DuckDB answers them with."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import sequence as sq
from ..functions import signal as sg
from ..functions import text as tx
from ..operators import bilstm, distance, features, metrics, reads, scoring, sites, training, validate
from ..sources import bam, fasta, pod5, sam, scratch, tables
from . import views

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None, *with_views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (views.sql(*with_views) + "\n" if with_views else "") + sql
        return f

    return add


def r6(name: str, to: str | None = None):
    return F.round(F.col(name).cast("double"), 6).alias(to or name)


# --- sites -------------------------------------------------------------------------------------------------------------------

_AGG = """SELECT chr, start, start + 1 AS "end", round(100::DOUBLE * methy / count, 6) AS frequency, methy, count - methy AS unmethy{more} FROM
    (SELECT chr, pos AS start, count(*)::BIGINT AS count, sum((prob > 0.5::DOUBLE)::INTEGER)::BIGINT AS methy FROM calls{where} GROUP BY chr, pos){having}"""


@query(_AGG.format(more="", where="", having=""), "calls")
def site_aggregation(spark: SparkSession, d: str) -> DataFrame:
    return sites.aggregate_sites(views.calls(spark, d)).withColumn("frequency", F.round("frequency", 6))


@query(_AGG.format(more=", count", where="", having=" WHERE count > 5"), "calls")
def site_frequency_cov5(spark, d):
    return sites.aggregate_sites(views.calls(spark, d), with_count=True).filter("count > 5").withColumn("frequency", F.round("frequency", 6))


@query(_AGG.format(more="", where=" WHERE prob < 1 - 0.8::DOUBLE OR prob >= 0.8::DOUBLE", having=""), "calls")
def site_confident_calls(spark, d):
    return sites.aggregate_sites(sites.confident(views.calls(spark, d), 0.8)).withColumn("frequency", F.round("frequency", 6))


def _motifs(spark, d):
    return views.calls(spark, d).select("chr", (F.col("pos") - F.col("pos") % 2).alias("start")).distinct().withColumn("end", F.col("start") + 2)


_MOTIFS = """, motifs AS (SELECT DISTINCT chr, pos - pos % 2 AS start, pos - pos % 2 + 2 AS "end" FROM calls),
    freq AS (SELECT chr, pos AS start, pos + 1 AS "end", sum((prob > 0.5::DOUBLE)::INTEGER)::BIGINT AS methy, sum((prob <= 0.5::DOUBLE)::INTEGER)::BIGINT AS unmethy FROM calls GROUP BY chr, pos)"""
_MERGED = _MOTIFS + """
    SELECT m.chr, m.start, m."end", round(100::DOUBLE * sum(methy) / nullif(sum(methy) + sum(unmethy), 0), 6) AS frequency, sum(methy)::BIGINT AS methy, sum(unmethy)::BIGINT AS unmethy
    FROM motifs m JOIN freq f ON m.chr = f.chr AND m.start < f."end" AND f.start < m."end" GROUP BY m.chr, m.start, m."end" """


@query(_MERGED, "calls")
def strand_merge_equi(spark, d):
    return sites.merge_strands(_motifs(spark, d), sites.aggregate_sites(views.calls(spark, d))).withColumn("frequency", F.round("frequency", 6))


@query(_MERGED, "calls")
def strand_merge_overlap(spark, d):
    return sites.merge_strands_by_overlap(_motifs(spark, d), sites.aggregate_sites(views.calls(spark, d))).withColumn("frequency", F.round("frequency", 6))


@query(_MOTIFS + """ SELECT m.chr, m.start AS a_start, m."end" AS a_end, f.start AS b_start, f."end" AS b_end, least(m."end", f."end") - greatest(m.start, f.start) AS overlap
    FROM motifs m JOIN (SELECT chr, start, start + 3 AS "end" FROM freq) f ON m.chr = f.chr AND m.start < f."end" AND f.start < m."end" """, "calls")
def interval_overlap(spark, d):
    wide = sites.aggregate_sites(views.calls(spark, d)).select("chr", "start", (F.col("start") + 3).alias("end"))
    return sites.overlaps(_motifs(spark, d), wide, 16)


# --- truth, ROC, sweeps ------------------------------------------------------------------------------------------------------


def _joined(spark, d):
    even = views.calls(spark, d).filter("event_id % 2 = 0").select("event_id", "read_id", "chr", "pos", "prob")
    return metrics.labelled(metrics.join_truth(views.truth(spark, d), even), 0.52, 0.45)


_JOINED = """, joined AS (SELECT t.chr, t.start, t."end", round(t.ratio, 9) AS ratio, t.cov, c.event_id, c.read_id, c.prob, (t.ratio > 0.5::DOUBLE)::INTEGER AS label FROM truth t
    JOIN calls c ON t.chr = c.chr AND t.start = c.pos AND c.event_id % 2 = 0 WHERE t.ratio >= 0.52::DOUBLE OR t.ratio <= 0.45::DOUBLE)"""


@query(_JOINED + ' SELECT chr, start, "end", ratio, cov, event_id, read_id, prob, label FROM joined', "calls", "truth")
def truth_join_labels(spark, d):
    return _joined(spark, d).select("chr", "start", "end", F.round("ratio", 9).alias("ratio"), "cov", "event_id", "read_id", "prob", "label")


_PAIRS = """, freq AS (SELECT chr, pos AS start, count(*) AS n, 100::DOUBLE * sum((prob > 0.5::DOUBLE)::INTEGER) / count(*) AS frequency FROM calls WHERE event_id % 2 = 0 GROUP BY chr, pos HAVING count(*) > 5),
    pairs AS (SELECT f.chr, f.start, t.ratio, f.frequency FROM freq f JOIN truth t ON f.chr = t.chr AND f.start = t.start WHERE t.cov > 5)"""


def _pairs(spark, d):
    return validate.frequency_pairs(views.calls(spark, d).filter("event_id % 2 = 0"), views.truth(spark, d))


@query(_PAIRS + " SELECT chr, start, round(ratio, 6) AS ratio, round(frequency, 6) AS frequency FROM pairs", "calls", "truth")
def truth_frequency_pairs(spark, d):
    return _pairs(spark, d).select("chr", "start", r6("ratio"), r6("frequency"))


@query(_PAIRS + " SELECT count(*)::BIGINT AS n, round(corr(ratio, frequency), 6) AS pearson FROM pairs", "calls", "truth")
def truth_pearson(spark, d):
    return validate.pearson(_pairs(spark, d)).select("n", r6("pearson"))


@query(_PAIRS + """ SELECT 'ratio' AS "row", 'ratio' AS "column", round(corr(ratio, ratio), 6) AS value FROM pairs UNION ALL SELECT 'ratio', 'frequency', round(corr(ratio, frequency), 6) FROM pairs
    UNION ALL SELECT 'frequency', 'ratio', round(corr(frequency, ratio), 6) FROM pairs UNION ALL SELECT 'frequency', 'frequency', round(corr(frequency, frequency), 6) FROM pairs""", "calls", "truth")
def correlation_matrix(spark, d):
    return validate.correlation_matrix(_pairs(spark, d)).select("row", "column", r6("value"))


_AUC = """, s AS (SELECT prob AS score, sum(label) AS p, sum(1 - label) AS n FROM labelled GROUP BY prob),
    r AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM s)"""


@query(_AUC + " SELECT round(sum(n * (tp - p + p / 2::DOUBLE)) / (sum(p) * sum(n)), 6) AS auc FROM r", "calls", "labelled")
def roc_auc(spark, d):
    return metrics.roc_auc(views.labelled(spark, d), 1).select(r6("auc"))


@query(_AUC + " SELECT round(sum(p * tp / (tp + fp)::DOUBLE) / sum(p), 6) AS ap FROM r", "calls", "labelled")
def average_precision(spark, d):
    return metrics.average_precision(views.labelled(spark, d), 1).select(r6("ap"))


@query(""", y AS (SELECT quality AS label, CASE WHEN n_chars IS NULL THEN 0 ELSE n_chars END::DOUBLE AS prob FROM labels JOIN documents USING (doc_id)),
    s AS (SELECT prob AS score, sum(label) AS p, sum(1 - label) AS n FROM y GROUP BY prob), r AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp FROM s)
    SELECT round(sum(n * (tp - p + p / 2::DOUBLE)) / (sum(p) * sum(n)), 6) AS auc FROM r""".replace(", y AS", "WITH y AS", 1))
def roc_auc_documents(spark, d):
    rows = views.table(spark, d, "labels").join(views.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.roc_auc(rows.select(F.col("quality").alias("label"), F.coalesce("n_chars", F.lit(0)).cast("double").alias("prob"))).select(r6("auc"))


_RATES = """round(coalesce(TP / nullif(TP + FN, 0)::DOUBLE, 0), 6) AS TPR, round(coalesce(FP / nullif(FP + TN, 0)::DOUBLE, 0), 6) AS FPR, round(coalesce(2 * TP / nullif(2 * TP + FP + FN, 0)::DOUBLE, 0), 6) AS F1,
    round(coalesce(TP / nullif(TP + FP, 0)::DOUBLE, 0), 6) AS "Precision", round(coalesce((TP + TN) / nullif(TP + TN + FP + FN, 0)::DOUBLE, 0), 6) AS Accuracy,
    round(coalesce(TP / nullif(TP + FN, 0)::DOUBLE, 0), 6) AS Recall, round(coalesce(TN / nullif(TN + FN, 0)::DOUBLE, 0), 6) AS Specificity"""
_SWEEP = """, sweep AS (SELECT i / 100::DOUBLE AS threshold, sum((label = 1 AND prob >= i / 100::DOUBLE)::INTEGER)::BIGINT AS TP, sum((label = 0 AND prob < i / 100::DOUBLE)::INTEGER)::BIGINT AS TN,
    sum((label = 0 AND prob >= i / 100::DOUBLE)::INTEGER)::BIGINT AS FP, sum((label = 1 AND prob < i / 100::DOUBLE)::INTEGER)::BIGINT AS FN FROM labelled CROSS JOIN (SELECT unnest(range(0, 101)) AS i) GROUP BY i)"""
_NAMES = ("TPR", "FPR", "F1", "Precision", "Accuracy", "Recall", "Specificity")


def _rounded(m):
    return m.select("threshold", "TP", "TN", "FP", "FN", *(r6(c) for c in _NAMES))


@query(_SWEEP + f" SELECT threshold, TP, TN, FP, FN, {_RATES} FROM sweep", "calls", "labelled")
def threshold_sweep(spark, d):
    return _rounded(metrics.sweep_by_grid(views.labelled(spark, d)))


@query(_SWEEP + f" SELECT threshold, TP, TN, FP, FN, {_RATES} FROM sweep", "calls", "labelled")
def threshold_sweep_hist(spark, d):
    return _rounded(metrics.sweep(views.labelled(spark, d)))


@query(_SWEEP + " SELECT threshold, round(coalesce(TN / nullif(TN + FP, 0)::DOUBLE, 0), 6) AS true_specificity FROM sweep", "calls", "labelled")
def true_specificity(spark, d):
    return metrics.true_specificity(metrics.sweep(views.labelled(spark, d))).select("threshold", r6("true_specificity"))


_BALANCE = _SWEEP + """, mult AS (SELECT *, CASE WHEN (SELECT min(TN + FP) FROM sweep) = 0 THEN 0 ELSE (TP + FN) / nullif(TN + FP, 0)::DOUBLE END AS multiplier FROM sweep),
    adj AS (SELECT *, round_even(TN * multiplier, 0)::BIGINT AS adjusted_TN, round_even(FP * multiplier, 0)::BIGINT AS adjusted_FP, round_even(TP * multiplier, 0)::BIGINT AS adjusted_TP, round_even(FN * multiplier, 0)::BIGINT AS adjusted_FN FROM mult),
    bal AS (SELECT *, TP / nullif(TP + adjusted_FP, 0)::DOUBLE AS b_Precision, adjusted_TN / nullif(adjusted_TN + FN, 0)::DOUBLE AS b_Specificity FROM adj)"""
_BAL = "threshold, TP, TN, FP, FN, round(multiplier, 6) AS multiplier, adjusted_TN, adjusted_FP, adjusted_TP, adjusted_FN, round(b_Precision, 6) AS b_Precision, round(b_Specificity, 6) AS b_Specificity"


def _balanced(m):
    return m.select("threshold", "TP", "TN", "FP", "FN", r6("multiplier"), "adjusted_TN", "adjusted_FP", "adjusted_TP", "adjusted_FN", r6("b_Precision"), r6("b_Specificity"))


def _bal(spark, d):
    return metrics.balance(metrics.sweep(views.labelled(spark, d)))


@query(_BALANCE + f" SELECT {_BAL} FROM bal", "calls", "labelled")
def balanced_adjust(spark, d):
    return _balanced(_bal(spark, d))


@query(_BALANCE + f" SELECT {_BAL} FROM bal WHERE threshold > 0 AND threshold < 0.5::DOUBLE", "calls", "labelled")
def calibration_low(spark, d):
    return _balanced(metrics.between(_bal(spark, d), 0, 0.5))


@query(_BALANCE + f" SELECT {_BAL} FROM bal WHERE threshold > 0.5::DOUBLE AND threshold < 1", "calls", "labelled")
def calibration_high(spark, d):
    return _balanced(metrics.between(_bal(spark, d), 0.5, 1))


_LEVELS = (0.5, 0.6, 0.7, 0.8, 0.95)
_CONF = _BALANCE + """, conf AS (SELECT level, arg_min(TP + FP + TN + FN, threshold)::BIGINT AS total, coalesce(arg_min(TP, threshold) FILTER (b_Precision >= level), 0)::BIGINT AS TP_first,
    coalesce(arg_min(TN, threshold) FILTER (b_Precision >= level), 0)::BIGINT AS TN_first, coalesce(arg_max(TP, threshold) FILTER (b_Specificity >= level), 0)::BIGINT AS TP_last,
    coalesce(arg_max(TN, threshold) FILTER (b_Specificity >= level), 0)::BIGINT AS TN_last FROM bal CROSS JOIN (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.95]::DOUBLE[]) AS level) GROUP BY level),
    ratio AS (SELECT *, round(coalesce((TP_first + TN_last) / nullif(total, 0)::DOUBLE, 0), 6) AS ratio FROM conf)"""


@query(_CONF + " SELECT level, total, TP_first, TN_first, TP_last, TN_last, ratio FROM ratio", "calls", "labelled")
def high_confidence_ratio(spark, d):
    return metrics.high_confidence(_bal(spark, d), _LEVELS).withColumn("ratio", F.round("ratio", 6))


@query(_CONF + " SELECT level, total AS total_1, ratio AS ratio_1, total AS total_2, ratio AS ratio_2 FROM ratio", "calls", "labelled")
def compare_confidence(spark, d):
    out = metrics.compare_confidence(_bal(spark, d), _bal(spark, d), _LEVELS)
    return out.select("level", "total_1", r6("ratio_1"), "total_2", r6("ratio_2"))


@query("""SELECT TP, TN, FP, FN, round((TP + TN) / (TP + TN + FP + FN)::DOUBLE, 6) AS accuracy, round(coalesce(TP / nullif(TP + FP, 0)::DOUBLE, 0), 6) AS "precision",
    round(coalesce(TP / nullif(TP + FN, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * TP / nullif(2 * TP + FP + FN, 0)::DOUBLE, 0), 6) AS f1 FROM
    (SELECT count(*) FILTER (quality = 1 AND n_chars > 1500)::BIGINT AS TP, count(*) FILTER (quality = 0 AND n_chars <= 1500)::BIGINT AS TN, count(*) FILTER (quality = 0 AND n_chars > 1500)::BIGINT AS FP,
    count(*) FILTER (quality = 1 AND n_chars <= 1500)::BIGINT AS FN FROM labels JOIN documents USING (doc_id))""")
def batch_metrics(spark, d):
    rows = views.table(spark, d, "labels").join(views.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    got = metrics.global_metrics(rows.select(F.col("quality").alias("label"), (F.col("n_chars") > 1500).cast("int").alias("predicted")))
    return got.select("TP", "TN", "FP", "FN", *(r6(c) for c in ("accuracy", "precision", "recall", "f1")))


# --- distances ---------------------------------------------------------------------------------------------------------------

_COUNTS = """, ord AS (SELECT *, row_number() OVER (PARTITION BY read_name ORDER BY pos, prob) AS i FROM binary_calls),
    counts AS (SELECT b.pos - a.pos AS distance, count(*)::BIGINT AS n, count(*) FILTER (a.prob + b.prob = 0)::BIGINT AS c0, count(*) FILTER (a.prob + b.prob = 1)::BIGINT AS c1,
    count(*) FILTER (a.prob + b.prob = 2)::BIGINT AS c2 FROM ord a JOIN ord b ON a.read_name = b.read_name AND a.i < b.i GROUP BY 1),
    corr AS (SELECT *, (c1 + 2 * c2) / (2 * n)::DOUBLE AS FM, c2 / n::DOUBLE AS FMM FROM counts),
    curve AS (SELECT *, (FMM - FM * FM) / nullif(FM * (1 - FM), 0) AS correlation FROM corr)"""


def _counts(spark, d, **kw):
    return distance.pair_counts(views.binary(spark, d), **kw)


@query(_COUNTS + " SELECT distance, n, c0, c1, c2 FROM counts", "calls", "binary_calls")
def pair_distance_counts(spark, d):
    return _counts(spark, d)


@query(_COUNTS + " SELECT distance, n, c0, c1, c2 FROM counts WHERE distance <= 12", "calls", "binary_calls")
def pair_distance_near(spark, d):
    return _counts(spark, d, max_distance=12)


@query(_COUNTS + " SELECT distance, n, c0, c1, c2, round(FM, 6) AS FM, round(FMM, 6) AS FMM, round(correlation, 6) AS correlation FROM curve", "calls", "binary_calls")
def distance_correlation(spark, d):
    return distance.correlation(_counts(spark, d)).select("distance", "n", "c0", "c1", "c2", r6("FM"), r6("FMM"), r6("correlation"))


@query(_COUNTS + " SELECT distance, n, round(correlation, 6) AS correlation FROM curve ORDER BY distance LIMIT 20", "calls", "binary_calls")
def distance_topn(spark, d):
    return distance.top_distances(distance.correlation(_counts(spark, d)), 20).select("distance", "n", r6("correlation"))


def _smooth_sql() -> str:
    h = distance.smoothing_weights(51, 3)
    values = ", ".join(f"({i}, {j}, {float(h[i, j])!r}::DOUBLE)" for i in range(51) for j in range(51))
    return _COUNTS + f""", w(i, j, w) AS (VALUES {values}), k AS (SELECT distance, correlation AS y, row_number() OVER (ORDER BY distance) - 1 AS rk, count(*) OVER () AS size FROM curve),
        f AS (SELECT *, least(greatest(rk - 25, 0), size - 51) AS first FROM k)
        SELECT f.distance, round(any_value(f.y), 6) AS correlation, round(sum(w.w * g.y), 6) AS smoothed FROM f JOIN w ON w.i = f.rk - f.first JOIN k g ON g.rk = f.first + w.j GROUP BY f.distance"""


@query(_smooth_sql(), "calls", "binary_calls")
def distance_smoothed(spark, d):
    return distance.smooth(distance.correlation(_counts(spark, d))).select("distance", r6("correlation"), r6("smoothed"))


@query(""", c AS (SELECT event_id, read_id, chr, CASE WHEN lag(chr) OVER w IS NOT DISTINCT FROM chr THEN 0 ELSE 1 END AS c FROM calls WINDOW w AS (PARTITION BY read_id ORDER BY event_id))
    SELECT event_id, read_id, chr, (sum(c) OVER (PARTITION BY read_id ORDER BY event_id) - 1)::BIGINT AS island FROM c""", "calls")
def read_islands(spark, d):
    return distance.islands(views.calls(spark, d).select("event_id", "read_id", "chr"), ["read_id"], ["event_id"], "chr")


# --- reads and names ---------------------------------------------------------------------------------------------------------

_HASHED = "('0x' || substr(md5(read_id), 1, 8))::BIGINT < {n}"


@query(f"SELECT event_id, read_id, chr, pos, prob FROM calls WHERE {_HASHED.format(n=int(round(0.25 * 2**32)))}", "calls")
def downsample_reads(spark, d):
    return reads.downsample(views.calls(spark, d), 0.25)


@query(f"SELECT event_id, read_id, chr, pos, prob FROM calls WHERE read_id IN (SELECT DISTINCT read_id FROM calls WHERE {_HASHED.format(n=int(round(0.1 * 2**32)))})", "calls")
def semi_join_names(spark, d):
    c = views.calls(spark, d)
    return reads.semi_join_names(c, reads.read_names(reads.downsample(c, 0.1))).select("event_id", "read_id", "chr", "pos", "prob")


@query("SELECT DISTINCT read_id FROM calls ORDER BY read_id", "calls")
def distinct_reads(spark, d):
    return reads.read_names(views.calls(spark, d)).orderBy("read_id")


def _curve_sql() -> str:
    parts = []
    for level in (5, 10, 15, 20, 25, 30):
        n = int(round(min(1.0, level / 40) * 2**32))
        parts.append(f"""SELECT {level} AS coverage, count(*)::BIGINT AS n, round(corr(t.ratio, f.frequency), 6) AS pearson FROM (SELECT chr, pos AS start, 100::DOUBLE * sum((prob > 0.5::DOUBLE)::INTEGER) / count(*) AS frequency
            FROM calls WHERE event_id % 2 = 0 AND {_HASHED.format(n=n)} GROUP BY chr, pos HAVING count(*) > 2) f JOIN truth t ON f.chr = t.chr AND f.start = t.start WHERE t.cov > 5""")
    return " UNION ALL ".join(parts)


@query(_curve_sql(), "calls", "truth")
def downsample_curve(spark, d):
    got = validate.downsample_curve(views.calls(spark, d).filter("event_id % 2 = 0"), views.truth(spark, d), 40, min_count=2)
    return got.select("coverage", "n", r6("pearson"))


@query(""", s AS (SELECT chr, pos, 1 AS label FROM calls WHERE event_id % 4 = 1 AND prob >= 0.7::DOUBLE UNION ALL SELECT chr, pos, 0 FROM calls WHERE event_id % 4 = 3 AND prob < 0.5::DOUBLE),
    l AS (SELECT chr, pos, max(label) AS label FROM s GROUP BY chr, pos) SELECT c.chr, c.pos, c.event_id, l.label FROM calls c JOIN l USING (chr, pos) WHERE c.event_id % 2 = 0""", "calls")
def hc_site_labeling(spark, d):
    c = views.calls(spark, d)
    labels = reads.truth_labels(c.filter("event_id % 4 = 1 and prob >= 0.7"), c.filter("event_id % 4 = 3 and prob < 0.5"))
    return reads.label_sites(c.filter("event_id % 2 = 0").select("chr", "pos", "event_id"), labels)


# --- sequences ---------------------------------------------------------------------------------------------------------------


def _scan_sql(kind: str) -> str:
    motifs = ", ".join(f"'{m}'" for m in sq.MOTIFS[kind])
    n = len(sq.MOTIFS[kind][0])
    return f"SELECT doc_id, i AS pos FROM (SELECT doc_id, seq, unnest(range(0, len(seq)))::INTEGER AS i FROM dna) WHERE substr(seq, i + 1, {n}) IN ({motifs})"


def _scan(kind):
    def run(spark, d):
        return views.dna(spark, d).select("doc_id", F.explode(sq.motif_offsets(F.col("seq"), kind)).alias("pos"))

    run.__name__ = f"motif_scan_{kind.lower()}"
    return run


for _kind in ("CG", "CHG", "CHH"):
    query(_scan_sql(_kind), "dna")(_scan(_kind))


@query("SELECT 'd' || doc_id AS chr, pos AS start, pos + 2 AS \"end\", 'd' || doc_id || ':' || pos AS id FROM (" + _scan_sql("CG") + ")", "dna")
def motif_bed(spark, d):
    return sites.motif_bed(views.dna(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chr"), "seq"))


@query("SELECT doc_id, len(seq)::BIGINT AS n, md5(reverse(translate(seq, 'ACGTMKRYBVDH', 'TGCAKMYRVBHD'))) AS rc FROM dna", "dna")
def reverse_complement(spark, d):
    return views.dna(spark, d).select("doc_id", F.length("seq").cast("bigint").alias("n"), F.md5(sq.reverse_complement(F.col("seq")).cast("binary")).alias("rc"))


@query("SELECT doc_id, coalesce(list_sum(list_transform(range(0, len(seq)), lambda i: (instr('ACGTNWSMKRYBVDHZ', seq[i + 1]) - 1) * (i % 97 + 1))), 0)::BIGINT AS code_sum FROM dna", "dna")
def base_codes(spark, d):
    codes = F.transform(sq.base_codes(F.col("seq")), lambda c, i: (c * (i % 97 + 1)).cast("bigint"))
    return views.dna(spark, d).select("doc_id", F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("code_sum"))


_KMERS = "kmers AS (SELECT doc_id, pos, substr(seq, pos - 5, 13) AS kmer FROM (SELECT doc_id, seq, unnest(range(0, len(seq)))::INTEGER AS pos FROM dna) WHERE substr(seq, pos + 1, 2) = 'CG' AND pos >= 6 AND pos + 6 < len(seq))"


def _kmers(spark, d):
    rows = views.dna(spark, d).select("doc_id", "seq", F.explode(sq.motif_offsets(F.col("seq"), "CG")).alias("pos"))
    return rows.filter(sq.window_fits(F.col("seq"), F.col("pos"), 13)).select("doc_id", "pos", sq.kmer_at(F.col("seq"), F.col("pos"), 13).alias("kmer"))


@query(", " + _KMERS + " SELECT doc_id, pos, kmer FROM kmers", "dna")
def kmer_windows(spark, d):
    return _kmers(spark, d)


@query(", " + _KMERS + " SELECT doc_id, pos, list_transform(string_split(substr(kmer, 5, 5), ''), lambda c: instr('ACGTNWSMKRYBVDHZ', c) - 1)::VARCHAR AS codes FROM kmers", "dna")
def kmer_crop(spark, d):
    codes = sq.centre_crop(sq.base_codes(F.col("kmer")), 13, 5)
    return _kmers(spark, d).select("doc_id", "pos", F.concat(F.lit("["), F.array_join(codes.cast("array<string>"), ", "), F.lit("]")).alias("codes"))


@query(", " + _KMERS + " SELECT substr(kmer, 5, 5) AS kmer, count(*)::BIGINT AS n FROM kmers GROUP BY 1", "dna")
def kmer_counts(spark, d):
    return _kmers(spark, d).groupBy(F.substring("kmer", 5, 5).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


# --- alignments --------------------------------------------------------------------------------------------------------------


def _extents(spark, d):
    a = views.aln(spark, d)
    a = a.withColumn("ref_len", cg.reference_length(F.col("cigar"))).withColumn("q_start", cg.query_start(F.col("cigar"))).withColumn("q_end", cg.query_end(F.col("cigar"), F.col("seq_len")))
    return a.withColumn("ref_end", F.col("ref_start") + F.col("ref_len")).withColumn("q_len", F.col("q_end") - F.col("q_start")).withColumn("is_forward", F.col("flag").bitwiseAND(16) == 0)


@query("SELECT read_id, cigar_text, len(c)::INTEGER AS n_ops, list_sum(list_transform(c, lambda x: x.len * instr('MIDNSHP=X', x.op)))::BIGINT AS digest FROM ops", "aln", "ops")
def cigar_parse(spark, d):
    digest = F.aggregate("cigar", F.lit(0).cast("bigint"), lambda a, c: a + c["len"] * (c["op"] + 1))
    return views.aln(spark, d).select("read_id", "cigar_text", F.size("cigar").alias("n_ops"), digest.alias("digest"))


@query("SELECT read_id, ref_len FROM extents", "aln", "ops", "extents")
def cigar_ref_length(spark, d):
    return views.aln(spark, d).select("read_id", cg.reference_length(F.col("cigar")).alias("ref_len"))


_IDENT = "CASE WHEN nm = -1 THEN 0 ELSE (m - nm) / align END"


@query(f"SELECT read_id, round({_IDENT}, 6) AS identity FROM extents", "aln", "ops", "extents")
def cigar_identity(spark, d):
    return views.aln(spark, d).select("read_id", F.round(cg.identity(F.col("cigar"), F.col("nm")), 6).alias("identity"))


@query("SELECT read_id, round(CASE WHEN q_end - q_start = 0 THEN -1 ELSE m / (q_end - q_start) END, 6) AS coverage FROM extents", "aln", "ops", "extents")
def cigar_coverage(spark, d):
    return _extents(spark, d).select("read_id", F.round(cg.coverage(F.col("cigar"), F.col("q_len")), 6).alias("coverage"))


@query("SELECT read_id, q_start, q_end::INTEGER AS q_end, (q_end - q_start)::INTEGER AS q_len, ref_start, (ref_start + ref_len)::INTEGER AS ref_end FROM extents", "aln", "ops", "extents")
def query_extents(spark, d):
    return _extents(spark, d).select("read_id", "q_start", "q_end", "q_len", "ref_start", "ref_end")


@query(f"SELECT read_id, mapq FROM extents WHERE mapq >= 20 AND m / nullif(q_end - q_start, 0) >= 0.8::DOUBLE AND {_IDENT} >= 0.8::DOUBLE AND flag & 4 = 0", "aln", "ops", "extents")
def read_quality_filter(spark, d):
    a = _extents(spark, d).withColumn("is_mapped", F.col("flag").bitwiseAND(4) == 0).filter("is_mapped")
    return reads.quality_gate(a).select("read_id", "mapq")


@query(""", o AS (SELECT read_id, i, CASE WHEN flag & 16 = 0 THEN c ELSE list_reverse(c) END AS c FROM (SELECT *, row_number() OVER () AS i FROM ops)),
    u AS (SELECT read_id, i, unnest(c) AS x, unnest(range(0, len(c))) AS j FROM o),
    w AS (SELECT read_id, i, x.op AS op, x.len AS n, coalesce(sum(CASE WHEN x.op IN ('M','D','N','=','X') THEN x.len ELSE 0 END) OVER (PARTITION BY i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r0,
        coalesce(sum(CASE WHEN x.op IN ('M','I','=','X') THEN x.len ELSE 0 END) OVER (PARTITION BY i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q0 FROM u),
    e AS (SELECT read_id, i, r0 + t AS r, CASE WHEN op IN ('M','=','X') THEN q0 + t ELSE q0 END AS q FROM (SELECT *, unnest(range(0, n)) AS t FROM w WHERE op IN ('M','D','N','=','X'))),
    last AS (SELECT i, sum(CASE WHEN op IN ('M','I','=','X') THEN n ELSE 0 END) AS terminal FROM w GROUP BY i)
    SELECT e.read_id, count(*)::INTEGER AS n, max(terminal)::INTEGER AS terminal, sum((r + 1) * q)::BIGINT AS digest FROM e JOIN last USING (i) GROUP BY e.i, e.read_id""", "aln", "ops")
def ref_to_query_map(spark, d):
    a = _extents(spark, d).withColumn("map", cg.ref_to_query(F.col("cigar"), F.col("is_forward")))
    body = F.slice("map", F.lit(1), F.size("map") - 1)
    digest = F.aggregate(F.transform(body, lambda q, i: ((i + 1) * q).cast("bigint")), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return a.select("read_id", (F.size("map") - 1).alias("n"), F.element_at("map", -1).alias("terminal"), digest.alias("digest"))


@query("SELECT read_id, flag & 16 = 0 AS is_forward, flag & 4 = 0 AS is_mapped, CASE WHEN flag & 16 = 0 THEN '+' ELSE '-' END AS strand FROM aln", "aln")
def flag_decode(spark, d):
    a = views.aln(spark, d)
    fwd = F.col("flag").bitwiseAND(16) == 0
    return a.select("read_id", fwd.alias("is_forward"), (F.col("flag").bitwiseAND(4) == 0).alias("is_mapped"), reads.strand(fwd).alias("strand"))


@query("""SELECT read_id, CASE WHEN flag & 16 = 0 THEN ref_start + 3 ELSE ref_start + ref_len - 1 - 3 END::INTEGER AS pos,
    CASE WHEN flag & 16 = 0 THEN q_start ELSE seq_len - q_end END::INTEGER AS read_start FROM extents""", "aln", "ops", "extents")
def abs_position(spark, d):
    a = _extents(spark, d)
    return a.select("read_id", reads.absolute_position(F.col("is_forward"), F.col("ref_start"), F.col("ref_end"), F.lit(3)).alias("pos"), reads.read_start(F.col("is_forward"), F.col("q_start"), F.col("q_end"), F.col("seq_len")).alias("read_start"))


@query("SELECT read_id, chr || '#' || ref_start AS train_key, chr || chr(9) || ref_start || chr(9) || '+' AS call_key FROM aln", "aln")
def site_key_format(spark, d):
    a = views.aln(spark, d)
    return a.select("read_id", tx.site_key(F.col("chr"), F.col("ref_start")).alias("train_key"), F.concat_ws("\t", "chr", F.col("ref_start").cast("string"), F.lit("+")).alias("call_key"))


@query("""SELECT read_id || chr(9) || lpad(ref_start::VARCHAR, 10, '0') || chr(9) || lpad((ref_start + ref_len)::VARCHAR, 10, '0') || chr(9) || lpad(chr, 5, '_') || chr(9) || lpad((ref_start + 3)::VARCHAR, 10, '0') || chr(9) || '+' AS info
    FROM extents""", "aln", "ops", "extents")
def fixed_width_site_info(spark, d):
    a = _extents(spark, d)
    return a.select(tx.fixed_site_info(F.col("read_id"), F.col("ref_start"), F.col("ref_end"), F.col("chr"), F.col("ref_start") + 3, F.lit("+"), 5).alias("info"))


def _sam_lines(spark, d):
    a = views.aln(spark, d)
    unmapped = F.col("flag").bitwiseAND(4) != 0
    return a.select(F.concat_ws(
        "\t", "read_id", F.col("flag").cast("string"), F.when(unmapped, "*").otherwise(F.col("chr")), (F.col("ref_start") + 1).cast("string"), F.col("mapq").cast("string"), "cigar_text",
        F.lit("*"), F.lit("0"), F.lit("0"), F.repeat(F.lit("A"), F.col("seq_len")), F.lit("*"), F.lit("fn:Z:one.pod5"), F.lit("ts:i:7"),
        F.concat(F.lit("NM:i:"), F.col("nm").cast("string")), F.lit("mv:B:c,5,1,0,1,1"), F.when(F.col("nm") == 2, F.lit("pi:Z:parent")),
    ).alias("value"))


@query("""SELECT read_id, flag, CASE WHEN flag & 4 = 0 THEN chr ELSE '*' END AS chr, mapq, CASE WHEN flag & 4 = 0 THEN ref_start ELSE -1 END AS ref_start, CASE WHEN flag & 4 = 0 THEN ref_start + ref_len ELSE -1 END::INTEGER AS ref_end,
    CASE WHEN flag & 4 = 0 THEN q_end - q_start ELSE -1 END::INTEGER AS q_len, nm, 'one.pod5' AS file_name, 7 AS trim_start, 5 AS stride, '0,2,3,4' AS moves, nm = 2 AS is_split FROM extents""", "aln", "ops", "extents")
def sam_text_decode(spark, d):
    got = sam.parse_sam(_sam_lines(spark, d))
    got = got.na.fill({"chr": "*", "ref_start": -1, "ref_end": -1, "q_len": -1})
    return got.select("read_id", "flag", "chr", "mapq", "ref_start", "ref_end", "q_len", "nm", "file_name", "trim_start", "stride", F.array_join(F.col("moves").cast("array<string>"), ",").alias("moves"), "is_split")


# --- signals -----------------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(list_sum(list_transform(raw, lambda x: 0.5::DOUBLE * (x - 5))), 6) AS total, round(0.5::DOUBLE * (raw[1] - 5), 6) AS first FROM signal", "signal")
def signal_calibrate(spark, d):
    s = views.signal(spark, d).withColumn("pa", sg.calibrate(F.col("raw"), F.lit(-5.0), F.lit(0.5)))
    return s.select("vec_id", F.round(F.aggregate("pa", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("pa", F.lit(0)), 6).alias("first"))


_MAD = """, m AS (SELECT vec_id, raw, list_sort(raw)[(len(raw) + 1) // 2] AS med FROM signal), dev AS (SELECT *, list_transform(raw, lambda x: abs(x - med)) AS a FROM m),
    mad AS (SELECT *, list_sort(a)[(len(a) + 1) // 2] AS mad FROM dev), norm AS (SELECT vec_id, med, mad, CASE WHEN mad = 0 THEN raw ELSE list_transform(raw, lambda x: (x - med) / (mad / 0.674489::DOUBLE)) END AS x FROM mad)"""


@query(_MAD + " SELECT vec_id, med, mad, round(list_min(x), 6) AS lo, round(list_max(x), 6) AS hi, round(list_sum(list_transform(x, lambda v: abs(v))), 4) AS total FROM norm", "signal")
def signal_mad_normalize(spark, d):
    s = views.signal(spark, d).withColumn("x", sg.mad_normalise(F.col("raw"))).withColumn("med", sg.lower_median(F.col("raw")))
    mad = F.transform(F.array(F.struct("raw", "med")), lambda s: sg.lower_median(F.transform(s["raw"], lambda v: F.abs(v - s["med"]))))[0]
    return s.select("vec_id", "med", mad.alias("mad"), F.round(F.array_min("x"), 6).alias("lo"), F.round(F.array_max("x"), 6).alias("hi"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v)), 4).alias("total"))


_MOVES = "array(0, cast(1 + vec_id % 3 as int), cast(6 + vec_id % 5 as int), cast(14 + vec_id % 7 as int), 24, 32)"
_REGROUP = """, mv AS (SELECT vec_id, raw, [0, 1 + vec_id % 3, 6 + vec_id % 5, 14 + vec_id % 7, 24, 32] AS moves FROM signal),
    b AS (SELECT vec_id, raw, i, moves[i] * 2 AS s, (moves[i + 1] - moves[i]) * 2 AS n FROM (SELECT *, unnest(range(1, 6)) AS i FROM mv)),
    p AS (SELECT *, CASE WHEN n < 15 THEN least(greatest(s - (15 - n) // 2, 0), 64 - 15) WHEN n > 15 THEN s + (n - 15) // 2 ELSE s END AS p0 FROM b)"""


def _regrouped(spark, d):
    s = views.signal(spark, d).withColumn("moves", F.expr(_MOVES))
    return s.withColumn("groups", sg.regroup(F.col("raw"), F.col("moves"), F.lit(2))).withColumn("lengths", sg.move_lengths(F.col("moves"), F.lit(2)))


@query(_REGROUP + " SELECT vec_id, (i - 1)::INTEGER AS base, n::INTEGER AS length, raw[p0 + 1]::DOUBLE AS first, raw[p0 + 15]::DOUBLE AS last FROM p", "signal")
def signal_move_regroup(spark, d):
    g = _regrouped(spark, d).select("vec_id", "lengths", F.posexplode("groups").alias("base", "g"))
    return g.select("vec_id", "base", F.get("lengths", F.col("base")).alias("length"), F.get("g", F.lit(0)).alias("first"), F.get("g", F.lit(14)).alias("last"))


@query(_REGROUP + " SELECT vec_id, (i - 1)::INTEGER AS base, round(list_sum(raw[p0 + 1 : p0 + 15]) / 15, 6) AS mean FROM p", "signal")
def signal_base_means(spark, d):
    g = _regrouped(spark, d).select("vec_id", F.posexplode("groups").alias("base", "g"))
    return g.select("vec_id", "base", F.round(sg.array_mean(F.col("g")), 6).alias("mean"))


@query("SELECT n_name, round(list_sum(list_transform(range(1, len(n_name) + 1), lambda i: i * (ascii(n_name[i]) - 33) / 60::DOUBLE)), 6) AS forward, round((ascii(n_name[-1]) - 33) / 60::DOUBLE, 6) AS last FROM nation")
def phred_decode(spark, d):
    n = views.table(spark, d, "nation").withColumn("q", sg.phred(F.col("n_name"), F.lit(True))).withColumn("r", sg.phred(F.col("n_name"), F.lit(False)))
    return n.select("n_name", F.round(F.aggregate(F.transform("q", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("forward"), F.round(F.get("r", F.lit(0)), 6).alias("last"))


# --- features, training, scoring -----------------------------------------------------------------------------------------------

_MATRIX = """, mx AS (SELECT vec_id, list_concat(list_concat(list_transform(range(0, 3), lambda j: ((vec_id + j) % 4)::DOUBLE), raw[1:57]), [(vec_id % 2)::DOUBLE]) AS f FROM signal)"""


def _matrix(spark, d):
    """Rows of k = 3: 3 codes, 57 signal values, a label."""
    s = views.signal(spark, d)
    codes = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: ((F.col("vec_id") + j) % 4).cast("double"))
    return s.select("vec_id", F.concat(codes, F.slice("raw", 1, 57), F.array((F.col("vec_id") % 2).cast("double"))).alias("features"))


@query(""" SELECT 'f' || (v % 3) AS file_name, 'v' || v || chr(9) || lpad(s::VARCHAR, 10, '0') || chr(9) || lpad((s + n)::VARCHAR, 10, '0') || chr(9) || lpad(chr, 6, '_') || chr(9) || lpad(pos::VARCHAR, 10, '0') || chr(9) || CASE WHEN fwd THEN '+' ELSE '-' END AS info,
    61 AS width, sum(code * (j + 2))::INTEGER AS codes, sum(len[b])::INTEGER AS lengths, round(sum((ascii(qual[b]) - 33) / 60::DOUBLE), 4) AS quality,
    round(sum(list_sum(list_transform(x[(g[b] + 1) : (g[b] + 15)], lambda y: y::DOUBLE)) / 15), 2) AS means, round(sum(list_sum(list_transform(x[(g[b] + 1) : (g[b] + 15)], lambda y: y::DOUBLE))), 2) AS samples,
    any_value(pos % 2)::INTEGER AS label FROM one GROUP BY v, s, n, chr, pos, fwd""", "dna", "kernel")
def feature_rows(spark, d):
    """Reads through gates, labels, reference and signals to the kernel and the training matrix."""
    made = features.site_features(*views.kernel_tables(spark, d)[:3], "C", 0, 3, views.kernel_tables(spark, d)[3], round_digits=6)
    f = F.col("features").cast("array<double>")
    total = lambda at: F.aggregate(F.transform(F.array(*(F.lit(i) for i in at)), lambda i: F.get(f, i)), F.lit(0.0), lambda a, x: a + x)
    base = [3 + 19 * b for b in range(3)]
    return features.training_matrix(made, 6).select(
        "file_name", "info", F.size("features").alias("width"), (F.get(f, F.lit(0)) + F.get(f, F.lit(1)) * 2 + F.get(f, F.lit(2)) * 3).cast("int").alias("codes"),
        total([b + 2 for b in base]).cast("int").alias("lengths"), F.round(total([b + 3 for b in base]), 4).alias("quality"), F.round(total(base), 2).alias("means"),
        F.round(total([b + 4 + i for b in base for i in range(15)]), 2).alias("samples"), F.element_at(f, -1).cast("int").alias("label"),
    )


@query(_MATRIX + " SELECT vec_id, f[1]::INTEGER AS k0, f[4] AS s0, f[60] AS s56, f[61]::INTEGER AS label FROM mx", "signal")
def feature_split(spark, d):
    s = features.split_features(_matrix(spark, d), 3)
    return s.select("vec_id", F.get("kmer", F.lit(0)).alias("k0"), F.get("signal", F.lit(0)).alias("s0"), F.get("signal", F.lit(56)).alias("s56"), "label")


@query(_MATRIX + " SELECT vec_id, 21 AS width, f[2] AS code, f[23] AS s0, f[41] AS s18, f[61] AS label FROM mx", "signal")
def feature_crop(spark, d):
    s = features.crop_features(_matrix(spark, d), 3, 1)
    g = lambda i: F.get("features", F.lit(i))
    return s.select("vec_id", F.size("features").alias("width"), g(0).alias("code"), g(1).alias("s0"), g(19).alias("s18"), g(20).alias("label"))


_FRACTION = "('0x' || substr(md5(vec_id::VARCHAR || '{salt}'), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE"


@query(f"SELECT vec_id, floor({_FRACTION.format(salt='chunk')} * 10)::INTEGER AS chunk, src FROM (SELECT vec_id, 'a' AS src FROM signal UNION ALL SELECT vec_id, 'b' FROM signal)", "signal")
def chunk_union_shuffle(spark, d):
    v = views.signal(spark, d).select("vec_id")
    both = training.union_sources(v.withColumn("src", F.lit("a")), v.withColumn("src", F.lit("b")))
    return training.shuffle_rows(training.chunk_of(both, "vec_id", 10), ["vec_id", "src"]).select("vec_id", "chunk", "src")


@query(f"SELECT vec_id, {_FRACTION.format(salt='epoch3')} < 0.7::DOUBLE AS is_train FROM signal", "signal")
def train_valid_split(spark, d):
    return training.split(views.signal(spark, d).select("vec_id"), "vec_id", 3)


@query("""SELECT n_name AS name, ((row_number() OVER (ORDER BY md5(n_name), n_name) - 1) // ((count(*) OVER () + 10) // 10))::INTEGER AS chunk FROM nation""")
def file_chunks(spark, d):
    return training.file_chunks(views.table(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("""SELECT a.at::INTEGER AS at, a.n AS one, b.n AS two FROM (SELECT n_name AS n, row_number() OVER (ORDER BY n_name) AS at FROM nation) a
    JOIN (SELECT r_name AS n, row_number() OVER (ORDER BY r_name) AS at FROM region) b ON a.at = b.at""")
def zip_files(spark, d):
    return training.zip_files(views.table(spark, d, "nation").select(F.col("n_name").alias("name")), views.table(spark, d, "region").select(F.col("r_name").alias("name")))


_LOGIT = "1 / (1 + exp(-list_sum(list_transform(range(1, 58), lambda i: raw[i] * ((i - 1) % 7 - 3) / 1009::DOUBLE))))"


def _scored(spark, d):
    rows = features.split_features(_matrix(spark, d), 3).select("vec_id", "kmer", "signal")
    return scoring.score(rows, scoring.LogisticScorer([(i % 7) - 3 for i in range(57)], scale=1009))


@query(f"SELECT vec_id, round({_LOGIT}, 4) AS p FROM signal", "signal")
def logistic_calls(spark, d):
    return _scored(spark, d).select("vec_id", F.round(F.col("methylation_rate").cast("double"), 4).alias("p"))


@query(f"SELECT vec_id, ({_LOGIT} > 0.5::DOUBLE)::INTEGER AS predicted FROM signal", "signal")
def argmax_class(spark, d):
    return _scored(spark, d).select("vec_id", "predicted")


# --- text and files ----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, len(string_split(p_name, ' '))::INTEGER AS n, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[-1] AS last FROM part")
def text_split(spark, d):
    s = views.table(spark, d, "part").withColumn("s", tx.split_all(F.col("p_name"), " "))
    return s.select("p_partkey", F.size("s").alias("n"), F.get("s", F.lit(0)).alias("first"), F.element_at("s", -1).alias("last"))


@query("SELECT n_nationkey, lpad(n_name, (SELECT max(len(n_name)) FROM nation)::INTEGER, '_') AS padded FROM nation")
def pad_names(spark, d):
    n = views.table(spark, d, "nation")
    width = fasta.max_name_length(n.select(F.col("n_name").alias("chr")))
    return n.join(F.broadcast(width)).select("n_nationkey", tx.padded_name(F.col("n_name"), F.col("width")).alias("padded"))


@query("""SELECT 'd' || doc_id AS chr, len(seq)::INTEGER AS n, md5(seq) AS digest FROM dna WHERE seq <> ''""", "dna")
def fasta_parse(spark, d):
    rows = views.dna(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(" some text\n"), F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")).alias("value"))
    return fasta.parse_records(rows).select("chr", F.length("seq").alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


@query("""SELECT 'd' || doc_id AS chr, len(seq)::INTEGER AS n, md5(CASE WHEN doc_id % 5 = 0 THEN reverse(seq) ELSE seq END) AS digest FROM dna WHERE seq <> ''""", "dna")
def fasta_files(spark, d):
    """Bases as FASTA files, written and read in splits: `>` inside headers, and names that come again in a later file."""
    where, dna = scratch.folder(spark, "fasta"), views.dna(spark, d)
    lines = lambda df, seq: df.select(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" a->b >text\n"), F.regexp_replace(F.lower(seq), "(.{60})", "$1\n")).alias("value"))
    lines(dna, F.col("seq")).write.text(f"{where}/1")
    lines(dna.filter("doc_id % 5 = 0"), F.reverse("seq")).write.text(f"{where}/2")
    return fasta.read_fasta(spark, f"{where}/*").select("chr", F.length("seq").alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


@query("""SELECT vec_id, 'f' || vec_id % 3 || '.pod5' AS file_name, len(embedding)::INTEGER AS n, md5(array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::SMALLINT), ',')) AS digest,
    -5.0::DOUBLE AS offset, 0.5::DOUBLE AS scale FROM embeddings""")
def pod5_signals(spark, d):
    """Signals written as POD5 files, and read from them in splits."""
    v = views.table(spark, d, "embeddings").select("vec_id", "embedding")
    name = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.lower(F.hex("vec_id")), 12, "0"))
    raw = v.select(
        F.concat(F.lit("f"), (F.col("vec_id") % 3).cast("string"), F.lit(".pod5")).alias("file_name"), name.alias("read_id"),
        F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("smallint")).alias("signal"), F.lit(-5.0).alias("offset"), F.lit(0.5).alias("scale"),
    )
    where = scratch.folder(spark, "pod5")
    pod5.write_pod5(raw, where).collect()  # a row a file
    got = pod5.read_pod5(spark, where, split=20_000)
    return got.select(
        F.conv(F.substring("read_id", 25, 12), 16, 10).cast("long").alias("vec_id"), "file_name", F.size("signal").alias("n"), F.md5(F.array_join(F.col("signal").cast("array<string>"), ",").cast("binary")).alias("digest"),
        F.col("offset").cast("double").alias("offset"), F.col("scale").cast("double").alias("scale"),
    )


def _bam(spark, d):
    a = views.aln(spark, d)
    rows = a.select(
        "read_id", "flag", "chr", "ref_start", "mapq", "cigar", F.repeat(F.lit("A"), F.col("seq_len")).alias("seq"), F.lit("one.pod5").alias("file_name"), F.lit(7).alias("trim_start"), "nm",
        F.lit(5).alias("stride"), F.expr("array(0, 2, 3, 4)").alias("moves"), F.when(F.col("nm") == 2, F.lit("parent")).alias("parent_read"), (F.col("flag").bitwiseAND(4) == 0).alias("is_mapped"),
    )
    path, names = f"{scratch.folder(spark, 'bam')}/all.bam", [(f"chr{i}", 1 << 29) for i in range(23)]
    bam.write_alignments(rows, names, path, b"@CO\tmade of order lines\n")
    return path


@query("""SELECT read_id, flag, CASE WHEN flag & 4 = 0 THEN chr END AS chr, mapq, CASE WHEN flag & 4 = 0 THEN ref_start END AS ref_start, CASE WHEN flag & 4 = 0 THEN ref_start + ref_len END::INTEGER AS ref_end,
    CASE WHEN flag & 4 = 0 THEN q_end - q_start END::INTEGER AS q_len, seq_len AS n, nm, 'one.pod5' AS file_name, 7 AS trim_start, 5 AS stride, '0,2,3,4' AS moves, nm = 2 AS is_split FROM extents""", "aln", "ops", "extents")
def bam_file_decode(spark, d):
    """Alignments written as one sorted BAM file with its index, and read from it in splits."""
    return bam.read_bam(spark, _bam(spark, d), split=1 << 18).select(
        "read_id", "flag", "chr", "mapq", "ref_start", "ref_end", "q_len", F.length("seq").alias("n"), "nm", "file_name", "trim_start", "stride", F.concat_ws(",", "moves").alias("moves"), "is_split"
    )


@query("""SELECT read_id, ref_start, (ref_start + ref_len)::INTEGER AS ref_end FROM extents WHERE flag & 4 = 0 AND chr = 'chr7' AND ref_start < 400 AND ref_start + ref_len > 100""", "aln", "ops", "extents")
def bam_region(spark, d):
    """Reads over a region, by the index."""
    return bam.read_bam(spark, _bam(spark, d), region="chr7:100-400").select("read_id", "ref_start", "ref_end")


def _kernel_features(spark, d):
    a, raw, reference, labels = views.kernel_tables(spark, d)
    return features.site_features(a, raw, reference, "C", 0, 3, labels, round_digits=6)


@query()
def bilstm_calls(spark, d):
    """Calls of the two-branch BiLSTM, with small fixed weights."""
    scorer = scoring.BiLstmScorer(scoring.random_weights(embedding=4, hidden=8, branch_layers=1, joint_layers=1, seed=7), 1, 1)
    called = scoring.call_mods(_kernel_features(spark, d), scorer)
    return called.withColumn("methylation_rate", F.round(F.col("methylation_rate").cast("double"), 4))


@query()
def bilstm_training(spark, d):
    """Two epochs of training on the kernel's features: what each came to."""
    where = scratch.folder(spark, "bilstm")
    made = _kernel_features(spark, d).withColumn("info", F.concat_ws("#", "read_id", "ref_start", "pos", "strand"))
    made.write.parquet(f"{where}/features")  # once for the count and all epochs
    rows = spark.read.schema(made.schema).parquet(f"{where}/features")
    start = scoring.random_weights(embedding=4, hidden=8, branch_layers=1, joint_layers=1, seed=7)
    n = rows.count()
    _, seen = bilstm.train(rows, start, where, epochs=2, batch=max(1, n // 3), rate=0.01)
    return spark.createDataFrame([(h["epoch"], n, h["train_loss"], h["loss"], h["accuracy"], h["f1"]) for h in seen], "epoch int, rows long, train_loss double, loss double, accuracy double, f1 double")


@query("SELECT DISTINCT chr, pos::INTEGER AS pos, 1 AS label FROM calls", "calls")
def hc_sites_parse(spark, d):
    lines = views.calls(spark, d).select(F.concat_ws("\t", "chr", F.col("pos").cast("string"), F.lit("x")).alias("value"))
    return tables.parse_hc_sites(lines.unionByName(spark.createDataFrame([("chromosome\tpos\tx",)], "value string")), 1)


@query("SELECT n_name AS chr, n_nationkey::INTEGER AS id FROM nation")
def chr_ids_parse(spark, d):
    lines = views.table(spark, d, "nation").select(F.concat_ws("  \t", "n_name", F.col("n_nationkey").cast("string")).alias("value"))
    return tables.parse_chr_ids(lines)
