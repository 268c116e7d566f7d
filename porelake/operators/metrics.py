"""Truth joins, ROC and precision-recall, threshold sweeps, balanced counts and confidence."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 100


def join_truth(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """truth(chr, start, ratio, ...) and calls(chr, pos, ...) of one site, each with each."""
    return truth.join(calls.withColumnRenamed("pos", "start"), ["chr", "start"])


def labelled(joined: DataFrame, pos: float = 1.0, neg: float = 0.0, cut: float = 0.5) -> DataFrame:
    """Rows of sure truth (ratio >= pos or <= neg), with label: ratio > cut."""
    return joined.filter((F.col("ratio") >= pos) | (F.col("ratio") <= neg)).withColumn("label", (F.col("ratio") > cut).cast("int"))


def _by_score(rows: DataFrame) -> DataFrame:
    """score, p and n: positives and negatives of each score."""
    return rows.groupBy(F.col("prob").alias("score")).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))


def _ahead(scores: DataFrame, parts: int) -> DataFrame:
    """Adds tp and fp: positives and negatives of this and all higher scores. Scores are dealt by range into parts; sums inside a part and
    of the parts before it make the running sums, so no task sees all scores."""
    if parts == 1:
        ahead = Window.orderBy(F.desc("score"))
        return scores.withColumn("tp", F.sum("p").over(ahead)).withColumn("fp", F.sum("n").over(ahead))
    dealt = scores.repartitionByRange(parts, F.desc("score")).withColumn("_part", F.spark_partition_id())
    totals = dealt.groupBy("_part").agg(F.sum("p").alias("tp_"), F.sum("n").alias("fp_"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_part", F.coalesce(F.sum("tp_").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("fp_").over(before), F.lit(0)).alias("bn"))
    inner = Window.partitionBy("_part").orderBy(F.desc("score"))
    run = dealt.withColumn("_tp", F.sum("p").over(inner)).withColumn("_fp", F.sum("n").over(inner))
    return run.join(base, "_part").withColumn("tp", F.col("_tp") + F.col("bp")).withColumn("fp", F.col("_fp") + F.col("bn")).drop("_part", "_tp", "_fp", "bp", "bn")


def _parts(rows: DataFrame, parts: int | None) -> int:
    return parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def roc_auc(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows(label, prob) -> auc; ties count half. Null if a class is missing. Distinct scores are spread over `parts` tasks (as many as a
    shuffle has); where they are few, one part saves a pass over the rows."""
    r = _ahead(_by_score(rows), _parts(rows, parts))
    s = r.agg(F.sum(F.col("n").cast("double") * (F.col("tp") - F.col("p") + F.col("p") / F.lit(2.0))).alias("u"), F.sum("p").cast("double").alias("P"), F.sum("n").cast("double").alias("N"))
    return s.select(F.try_divide("u", F.col("P") * F.col("N")).alias("auc"))


def average_precision(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows(label, prob) -> ap: precision at each score, weighted by the recall it adds. parts as for roc_auc()."""
    r = _ahead(_by_score(rows), _parts(rows, parts))
    return r.agg(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")).alias("s"), F.sum("p").cast("double").alias("P")).select(F.try_divide("s", "P").alias("ap"))


def confusion(label: Column, predicted: Column) -> list[Column]:
    hit = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")
    return [
        hit((label == 1) & (predicted == 1)).alias("TP"), hit((label == 0) & (predicted == 0)).alias("TN"), hit((label == 0) & (predicted == 1)).alias("FP"),
        hit((label == 1) & (predicted == 0)).alias("FN"),
    ]


def rates(df: DataFrame) -> DataFrame:
    """Adds the rates of TP, TN, FP, FN; 0 where there is nothing to divide by. Specificity is TN / (TN + FN), as the published tables
    have it; true_specificity is TN / (TN + FP)."""
    c = lambda n: F.col(n).cast("double")
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return df.withColumns({
        "TPR": over(c("TP"), c("TP") + c("FN")), "FPR": over(c("FP"), c("FP") + c("TN")), "F1": over(2 * c("TP"), 2 * c("TP") + c("FP") + c("FN")),
        "Precision": over(c("TP"), c("TP") + c("FP")), "Accuracy": over(c("TP") + c("TN"), c("TP") + c("TN") + c("FP") + c("FN")),
        "Recall": over(c("TP"), c("TP") + c("FN")), "Specificity": over(c("TN"), c("TN") + c("FN")),
    })


def true_specificity(df: DataFrame) -> DataFrame:
    return df.withColumn("true_specificity", F.coalesce(F.try_divide(F.col("TN").cast("double"), (F.col("TN") + F.col("FP")).cast("double")), F.lit(0.0)))


def threshold_grid(df: DataFrame, steps: int = STEPS) -> DataFrame:
    return df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i"), (F.col("id") / F.lit(float(steps))).alias("threshold"))


def sweep(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """rows(label, prob) -> threshold, TP, TN, FP, FN and rates at i / steps, i = 0 .. steps; a call at the threshold is positive.

    One pass: a row counts in the highest threshold it reaches, and running sums over the steps + 1 counts give all thresholds."""
    i = F.least(F.floor(F.col("prob") * steps), F.lit(steps)).cast("int")
    i = i + F.when((i < steps) & (F.col("prob") >= (i + 1) / F.lit(float(steps))), 1).otherwise(0) - F.when(F.col("prob") < i / F.lit(float(steps)), 1).otherwise(0)
    hist = rows.groupBy(F.greatest(i, F.lit(-1)).alias("i")).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    # a row for each threshold, and one for what is below them all
    none = threshold_grid(rows, steps).select("i", F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("n"))
    full = hist.unionByName(none).groupBy("i").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).filter("i is not null")
    up = Window.orderBy(F.desc("i"))
    down = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    s = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("bigint")
    out = full.select("i", (F.col("i") / F.lit(float(steps))).alias("threshold"), s("p", up).alias("TP"), s("n", down).alias("TN"), s("n", up).alias("FP"), s("p", down).alias("FN"))
    return rates(out.filter("i >= 0").drop("i"))


def sweep_by_grid(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """The same by holding each distinct (prob, label) against each threshold; for checks."""
    few = rows.groupBy("prob", "label").agg(F.count(F.lit(1)).alias("k"))
    grid = few.join(F.broadcast(threshold_grid(rows, steps)))
    hit = F.col("prob") >= F.col("threshold")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("k")).otherwise(0)), F.lit(0)).cast("bigint")
    out = grid.groupBy("threshold").agg(n((F.col("label") == 1) & hit).alias("TP"), n((F.col("label") == 0) & ~hit).alias("TN"), n((F.col("label") == 0) & hit).alias("FP"), n((F.col("label") == 1) & ~hit).alias("FN"))
    return rates(out)


def balance(metrics: DataFrame) -> DataFrame:
    """Adds multiplier (TP + FN) / (TN + FP), the counts times it, rounded half to even, and the balanced precision and specificity.
    If any row has no negatives, the multiplier is 0 in all."""
    c = lambda n: F.col(n).cast("double")
    least = F.min(F.col("TN") + F.col("FP")).over(Window.partitionBy(F.lit(0)))  # a table of thresholds is small
    out = metrics.withColumn("_least", least).withColumn("multiplier", F.when(F.col("_least") == 0, 0.0).otherwise(F.try_divide(c("TP") + c("FN"), c("TN") + c("FP")))).drop("_least")
    out = out.withColumns({f"adjusted_{n}": F.rint(c(n) * F.col("multiplier")).cast("bigint") for n in ("TN", "FP", "TP", "FN")})
    return out.withColumns({"b_Precision": F.try_divide(c("TP"), c("TP") + c("adjusted_FP")), "b_Specificity": F.try_divide(c("adjusted_TN"), c("adjusted_TN") + c("FN"))})


def between(metrics: DataFrame, lower: float, upper: float) -> DataFrame:
    return metrics.filter((F.col("threshold") > lower) & (F.col("threshold") < upper))


def high_confidence(balanced: DataFrame, levels: tuple[float, ...] = (0.95, 0.96, 0.97, 0.98, 0.99)) -> DataFrame:
    """For each level: TP and TN of the first threshold of balanced precision >= level and of the last of balanced specificity >= level,
    and (TP of the first + TN of the last) / all calls; 0 where there is none. A few rows for each table, so one task."""
    m = balanced.withColumn("level", F.explode(F.array(*(F.lit(float(v)) for v in levels))))
    sure, clear = F.col("b_Precision") >= F.col("level"), F.col("b_Specificity") >= F.col("level")
    pick = lambda f, n, on: F.coalesce(f(F.when(on, F.col(n)), F.when(on, F.col("threshold"))), F.lit(0)).cast("bigint")
    out = m.groupBy("level").agg(
        F.min_by(F.col("TP") + F.col("FP") + F.col("TN") + F.col("FN"), "threshold").cast("bigint").alias("total"),
        pick(F.min_by, "TP", sure).alias("TP_first"), pick(F.min_by, "TN", sure).alias("TN_first"), pick(F.max_by, "TP", clear).alias("TP_last"), pick(F.max_by, "TN", clear).alias("TN_last"),
    )
    return out.withColumn("ratio", F.coalesce(F.try_divide((F.col("TP_first") + F.col("TN_last")).cast("double"), F.col("total").cast("double")), F.lit(0.0)))


def compare_confidence(one: DataFrame, two: DataFrame, levels: tuple[float, ...] = (0.95, 0.96, 0.97, 0.98, 0.99)) -> DataFrame:
    """high_confidence() of two models' balanced tables side by side."""
    a, b = (high_confidence(m, levels).select("level", *(F.col(c).alias(f"{c}_{i}") for c in ("total", "ratio"))) for i, m in ((1, one), (2, two)))
    return a.join(b, "level")


def global_metrics(rows: DataFrame) -> DataFrame:
    """rows(label, predicted) -> accuracy, precision, recall, f1 over all rows."""
    r = rates(rows.agg(*confusion(F.col("label"), F.col("predicted"))))
    return r.select("TP", "TN", "FP", "FN", F.col("Accuracy").alias("accuracy"), F.col("Precision").alias("precision"), F.col("Recall").alias("recall"), F.col("F1").alias("f1"))
