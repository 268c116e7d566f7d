"""Training sets: shuffles, chunks, unions, splits; and a baseline learner."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics


def hash_order(keys: list[str], seed: int = 0) -> Column:
    return F.xxhash64(*keys, F.lit(seed))


def stable_fraction(key: Column, salt: str = "") -> Column:
    """A number in [0, 1) that depends on the key's text and the salt alone."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt)).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def shuffle_rows(df: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """Rows in a pseudorandom order that is the same in each run; rows of equal keys stand together."""
    return df.orderBy(hash_order(keys, seed), *keys)


def chunk_of(df: DataFrame, key: str, chunks: int, salt: str = "chunk") -> DataFrame:
    """Adds chunk 0 .. chunks - 1, by the key's hash."""
    return df.withColumn("chunk", F.floor(stable_fraction(F.col(key), salt) * chunks).cast("int"))


def file_chunks(files: DataFrame, name: str = "name", per: int | None = None) -> DataFrame:
    """Files in order of their hash, in chunks of (n + 10) div 10; the last may be short, none is lost. A row for each file."""
    ranked = files.withColumn("_r", F.row_number().over(Window.orderBy(F.md5(F.col(name).cast("binary")), name)) - 1)
    size = F.lit(per) if per else F.expr("(n_ + 10) div 10")
    return ranked.join(F.broadcast(files.agg(F.count(F.lit(1)).alias("n_")))).withColumn("chunk", F.floor(F.col("_r") / size).cast("int")).drop("_r", "n_")


def union_sources(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.unionByName(two)


def zip_files(one: DataFrame, two: DataFrame, name: str = "name") -> DataFrame:
    """Pairs of the i-th names of two lists, in order of the names."""
    rank = lambda d, to: d.select(F.col(name).alias(to), F.row_number().over(Window.orderBy(name)).alias("at"))
    return rank(one, "one").join(rank(two, "two"), "at").orderBy("at").select("at", "one", "two")


def split(df: DataFrame, key: str, epoch: int = 0, train: float = 0.7) -> DataFrame:
    """Adds is_train: 70 % of the keys, drawn anew for each epoch."""
    return df.withColumn("is_train", stable_fraction(F.col(key), f"epoch{epoch}") < train)


def logistic_baseline(train: DataFrame, features: str = "features", label: str = "label", max_iter: int = 25):
    """MLlib logistic regression over a flattened array column."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = train.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=max_iter, regParam=1e-3).fit(rows)


def evaluate(model, rows: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    got = model.transform(rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("int").alias("label")))
    return metrics.global_metrics(got.select("label", F.col("prediction").cast("int").alias("predicted")))


def save_if_better(model, accuracy: float, best: float, path: str, slack: float = 0.0002) -> float:
    """Saves the model if its accuracy is over best - slack; the best accuracy so far."""
    if accuracy > best - slack:
        model.write().overwrite().save(path)
    return max(accuracy, best)
