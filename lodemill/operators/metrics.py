"""Metrics of predictions, each one aggregation; those by rank first group equal scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodemill.operators.linear import fit_ols
from lodemill.operators.relational import labelled


def _by_score(df: DataFrame, value: Column, group: list[str], summed: Callable[[DataFrame], DataFrame], bins: int | None) -> DataFrame:
    """``summed`` of the distinct scores of each group with their counts of both labels (pos, neg) and those below (pos_below, neg_below).

    The running sums go over ranges of (group, score), as many as the session has shuffle partitions: each range has its
    own sums, and those of the ranges before it come from one row for each range and group.  The result, small by now,
    is computed at once, so that the ranges can be released.
    """
    spark = df.sparkSession
    g = df.groupBy(*group, value.alias("s")).agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") != 1).cast("long")).alias("neg"))
    n = bins or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = g.repartitionByRange(n, *group, "s").withColumn("_p", F.spark_partition_id()).persist()
    totals = r.groupBy("_p", *group).agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    before = W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    start = totals.select("_p", *group, *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(a) for t, a in (("tp", "p0"), ("tn", "n0"))])
    own = W.partitionBy("_p", *group).orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    rows = r.withColumns({b: F.coalesce(F.sum(c).over(own), F.lit(0)) for c, b in (("pos", "pb"), ("neg", "nb"))}).join(F.broadcast(start) if not group else start, ["_p", *group])
    out = summed(rows.select(*group, "s", "pos", "neg", (F.col("p0") + F.col("pb")).alias("pos_below"), (F.col("n0") + F.col("nb")).alias("neg_below")))
    out = spark.createDataFrame(out.collect(), out.schema)
    r.unpersist()
    return out


def auc(df: DataFrame, y: str = "y_true", score: str = "y_pred", bins: int | None = None) -> DataFrame:
    """One row (auc): area under the ROC curve, ties half; null unless both labels occur.  Rows without label or score don't count."""
    rows = labelled(df.select(F.col(y).alias("y"), F.col(score).cast("double").alias("s")), "y").where("s is not null and not isnan(s)")
    return _by_score(rows, F.col("s"), [], lambda r: r.agg(_won().alias("auc")), bins)


def _won() -> Column:
    return F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)) / F.expr("nullif(sum(pos) * sum(neg), 0)")


def auc_by_group(df: DataFrame, group: str, y: str = "y_true", score: str = "y_pred", bins: int | None = None) -> DataFrame:
    """(group, auc), one row for each group; a group may span many ranges of scores."""
    rows = labelled(df.select(group, F.col(y).alias("y"), F.col(score).cast("double").alias("s")), "y").where("s is not null and not isnan(s)")
    return _by_score(rows, F.col("s"), [group], lambda r: r.groupBy(group).agg(_won().alias("auc")), bins)


def rmse(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return labelled(df, y).agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))).alias("rmse"))


def r2(df: DataFrame, y: str = "y_true", fitted: str = "fitted") -> DataFrame:
    """1 - SSE / SST against y."""
    ok = labelled(df, y).where(F.col(fitted).isNotNull())
    return ok.agg((1 - F.sum(F.pow(F.col(y) - F.col(fitted), 2)) / (F.var_pop(y) * F.count("*"))).alias("r2"))


def logloss(df: DataFrame, y: str = "y_true", p: str = "y_pred", eps: float = 1e-7) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return labelled(df, y).agg(F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("logloss"))


def aucpr(df: DataFrame, y: str = "y_true", score: str = "y_pred", bins: int | None = None) -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the recall it adds."""
    rows = labelled(df.select(F.col(y).alias("y"), (-F.col(score).cast("double")).alias("s")), "y").where("s is not null")
    tp, fp = F.col("pos_below") + F.col("pos"), F.col("neg_below") + F.col("neg")
    return _by_score(rows, F.col("s"), [], lambda r: r.agg((F.sum(F.col("pos") * tp / (tp + fp)) / F.expr("nullif(sum(pos), 0)")).alias("aucpr")), bins)


def score(df: DataFrame, metric: str, y: str = "y_true", p: str = "y_pred") -> float | None:
    """AUC, RMSE, logloss or aucpr as a number."""
    found = {"AUC": auc, "RMSE": rmse, "logloss": logloss, "aucpr": aucpr}.get(metric)
    if found is None:
        raise ValueError(f"unknown metric {metric!r}")
    return found(df, y, p).first()[0]


def adjusted_auc(df: DataFrame, covars: list[str], y: str = "y_true", p: str = "y_pred", model: str | None = "ols", draws: int = 50, trees: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(auc, r2) of predictions whose covariate part is taken off, and the rows with fitted value and residual.

    model None: the plain AUC, r2 null.  r2 is that of the fitted values against y.  model 'rf': a forest of ``trees``
    trees with the best parameters of ``draws`` random ones.
    """
    if model is None:
        return auc(df, y, p).withColumn("r2", F.lit(None).cast("double")), df
    ok = labelled(df.dropna(subset=[p, *covars]), y)
    if model == "ols":
        rows = fit_ols(ok, covars, p)
    elif model == "rf":
        rows = _forest(ok, covars, p, draws, trees)
    else:
        raise ValueError(f"unknown model {model!r}")
    return auc(rows, y, "residual").crossJoin(r2(rows, y)), rows  # one row each


def _forest(df: DataFrame, covars: list[str], p: str, draws: int, trees: int, seed: int = 0) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    best = tune_forest(df, covars, p, draws, trees, seed=seed)
    rows = VectorAssembler(inputCols=covars, outputCol="_v").transform(df)
    m = RandomForestRegressor(featuresCol="_v", labelCol=p, seed=seed, predictionCol="fitted", **best).fit(rows)
    return m.transform(rows).drop("_v").withColumn("residual", F.col(p) - F.col("fitted"))


def forest_draws(n: int, trees: int, covars: int, seed: int = 0) -> list[dict]:
    """Parameters of ``n`` forests: depth 2 + NB(2, 0.45), rows that a split needs 2 + NB(1.5, 0.5), features 3 to 8.

    MLlib bounds the rows of each side of a split, not those of the node: half as many.  Its depth goes to 30.
    """
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        depth, rows, features = 2 + r.negative_binomial(2, 0.45), 2 + r.negative_binomial(1.5, 0.5), r.integers(3, 9)
        out.append({"numTrees": trees, "maxDepth": int(min(30, depth)), "minInstancesPerNode": int(rows // 2), "featureSubsetStrategy": str(features) if features < covars else "all"})
    return out


def forest_sample(df: DataFrame, rows: int, seed: int, folds: int = 5) -> DataFrame:
    """At most ``rows`` rows, drawn by the hash of all their columns, with their fold ``_fold``."""
    drawn = df.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])).orderBy("_h").limit(rows)
    return drawn.withColumn("_fold", ((F.row_number().over(W.orderBy("_h")) - 1) % folds).cast("int")).drop("_h")  # bounded by rows


def tune_forest(df: DataFrame, covars: list[str], p: str, n_iter: int = 50, trees: int = 1000, rows: int = 5000, seed: int = 0) -> dict:
    """The best of ``n_iter`` random draws by 5-fold cross-validation on a random sample of at most ``rows`` rows."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator

    data = VectorAssembler(inputCols=covars, outputCol="_v").transform(forest_sample(df, rows, seed)).select("_v", p, "_fold").persist()
    model = RandomForestRegressor(featuresCol="_v", labelCol=p, seed=seed)
    drawn = forest_draws(n_iter, trees, len(covars), seed)
    grid = [{model.getParam(k): v for k, v in d.items()} for d in drawn]
    fit = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=p), numFolds=5, foldCol="_fold", parallelism=4).fit(data)
    data.unpersist()
    return drawn[min(zip(fit.avgMetrics, range(n_iter), strict=True))[1]]


def newton_sums(df: DataFrame, a: float, b: float, y: str, p: str) -> DataFrame:
    """The five sums of a Newton step of the logistic curve at (a, b)."""
    q = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) + F.lit(b) * F.col(p))))
    w = q * (1 - q)
    e: Column = F.col(y) - q
    return df.agg(F.sum(w).alias("sw"), F.sum(w * F.col(p)).alias("swp"), F.sum(w * F.col(p) * F.col(p)).alias("swpp"), F.sum(e).alias("se"), F.sum(e * F.col(p)).alias("sep"))
