"""Deterministic splits by row index, and random search."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.functions.columns import seeded


def fold_of(row_idx: Column, n: int, k: int, chunk: int) -> Column:
    """Contiguous folds of whole chunks; the last takes what is left.  With n < chunk * k all rows are in the last."""
    size = n // (chunk * k) * chunk
    return F.lit(k - 1).cast("int") if size == 0 else F.least(F.floor(row_idx / size), F.lit(k - 1)).cast("int")


def kfold(df: DataFrame, k: int, chunk: int) -> DataFrame:
    return df.withColumn("fold", fold_of(F.col("row_idx"), df.count(), k, chunk))


def fold_sizes(n: int, k: int, chunk: int) -> list[int]:
    size = n // (chunk * k) * chunk
    return [size] * (k - 1) + [n - size * (k - 1)]


def chunk_split(df: DataFrame, chunk: int, train: float = 0.8, seed: str | int = 0) -> DataFrame:
    """``df`` with split: floor(train * n / chunk) whole chunks, drawn from all but the last, are 'train'."""
    if not 0.1 <= train <= 0.9:
        raise ValueError("the share of train has to be 0.1 to 0.9")
    n = df.count()
    want, last = math.floor(train * n / chunk), (n - 1) // chunk
    spark = df.sparkSession
    # One row for each chunk; the limit is a TakeOrdered.
    chosen = spark.range(last).select(F.col("id").alias("_c")).orderBy(seeded(seed, F.col("_c")), "_c").limit(want)
    return df.withColumn("_c", F.floor(F.col("row_idx") / chunk)).join(chosen.withColumn("_t", F.lit(True)), "_c", "left").withColumn("split", F.when(F.col("_t"), "train").otherwise("test")).drop("_c", "_t")


def random_search(n: int, seed: int = 0, subsample: tuple[float, float] = (0.7, 0.7)) -> list[dict]:
    """n parameter sets: eta log-uniform 1e-4 to 0.1, colsample 0.5 to 1, depth 2 to 8, subsample uniform."""
    r = random.Random(seed)
    return [{"param_id": i, "eta": 10 ** r.uniform(-4, -1), "colsample_bytree": r.uniform(0.5, 1.0), "max_depth": r.randint(2, 8), "subsample": r.uniform(*subsample)} for i in range(n)]


def param_frame(spark: SparkSession, params: list[dict]) -> DataFrame:
    return spark.createDataFrame([(p["param_id"], p["eta"], p["colsample_bytree"], p["max_depth"], p["subsample"]) for p in params], "param_id int, eta double, colsample_bytree double, max_depth int, subsample double")


PARAMS = ["eta", "subsample", "colsample_bytree", "max_depth", "metric"]


def mean_scores(scores: DataFrame) -> DataFrame:
    """One row for each parameter set: means over the folds.  Rows with a null or NaN parameter are left out."""
    for c in ("eta", "subsample", "colsample_bytree"):
        scores = scores.where(F.col(c).isNotNull() & ~F.isnan(c))
    return scores.where("max_depth is not null and metric is not null").groupBy(*PARAMS).agg(*[F.avg(c).alias(c) for c in ("n_boost_round", "score", "train_score", "fold")])


def best_row(scores: DataFrame) -> DataFrame:
    """The row of the best mean score: the highest if the metric is AUC, else the lowest; ties to smaller parameters."""
    sign = F.when(F.col("metric") == "AUC", -F.col("score")).otherwise(F.col("score"))
    return scores.orderBy(sign, "eta", "max_depth", "subsample", "colsample_bytree").limit(1)


def exact_sample(df: DataFrame, n: int, key: str, seed: str | int = 0) -> DataFrame:
    """n rows; fewer rows than that are an error."""
    if n and len(df.select(key).limit(n).take(n)) < n:
        raise ValueError(f"fewer than {n} rows")
    return df.orderBy(seeded(seed, F.col(key)), key).limit(n)


def partition_map(parts: int, workers: list[str]) -> dict[int, str]:
    """Partitions dealt to workers in contiguous runs as even as can be."""
    if parts < len(workers):
        raise ValueError("fewer partitions than workers")
    q, r = divmod(parts, len(workers))
    sizes = [q + (i < r) for i in range(len(workers))]
    owners = [w for w, s in zip(workers, sizes, strict=True) for _ in range(s)]
    return dict(enumerate(owners))
