"""Whole runs: cross-validation, two-stage refit, prediction, calibration, adjustment, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.functions.arrays import matrix, take
from lodemill.functions.columns import pick, platt
from lodemill.operators import boosting, explain, folds, linear, metrics
from lodemill.operators.boosting import Booster, FitConfig
from lodemill.operators.relational import head_rows, join_covariates, subset_contributions


@dataclass
class CVResult:
    """scores: one row for each parameter set, best first; params and score of the best; oof: its out-of-fold predictions."""

    scores: DataFrame
    params: dict
    score: float | None
    oof: DataFrame


def objective_of(y: str) -> tuple[str, str]:
    """(objective, metric): adjusted labels are regressed, plain ones classified."""
    return ("reg:squarederror", "RMSE") if y == "y_adjusted" else ("binary:logistic", "AUC")


def one_round_cv(df: DataFrame, params: dict, k: int, chunk: int, rounds: int, y: str = "y", x: str = "x") -> tuple[list[dict], DataFrame]:
    """Scores of each fold, and the stacked out-of-fold predictions (row_idx, iid, y_true, y_pred, fold)."""
    objective, metric = objective_of(y)
    rows = folds.kfold(df, k, chunk)
    scores, parts = [], []
    for f in range(k):
        test, train = rows.where(F.col("fold") == f), rows.where(F.col("fold") != f)
        model = boosting.fit(train, FitConfig.of(params, objective=objective), rounds, x=x, y=y)
        out = boosting.predict(test, model, x).select("row_idx", "iid", F.col(y).alias("y_true"), "y_pred", "fold")
        parts.append(out)
        seen = boosting.predict(train, model, x).select(F.col(y).alias("y_true"), "y_pred")
        scores.append({**params, "n_boost_round": rounds, "metric": metric, "fold": f, "score": metrics.score(out, metric), "train_score": metrics.score(seen, metric)})
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return scores, oof


def cross_validate(df: DataFrame, n_iter: int, k: int, chunk: int, rounds: int, seed: int = 0, subsample: tuple[float, float] = (0.7, 0.7), cv_rows: int = 0, y: str = "y", x: str = "x") -> CVResult:
    """Random search; every set sees the same folds.  Labels missing from a test fold don't count."""
    df = head_rows(df, cv_rows)
    grid = folds.random_search(n_iter, seed, subsample)
    rows, kept = [], {}
    for params in grid:
        s, oof = one_round_cv(df, params, k, chunk, rounds, y, x)
        rows += s
        kept[params["param_id"]] = oof
    spark = df.sparkSession
    cols = ["param_id", "eta", "subsample", "colsample_bytree", "max_depth", "metric", "n_boost_round", "score", "train_score", "fold"]
    each = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], "param_id int, eta double, subsample double, colsample_bytree double, max_depth int, metric string, n_boost_round int, score double, train_score double, fold int")
    mean = folds.mean_scores(each)
    best = folds.best_row(mean).first()
    chosen = next(p for p in grid if p["eta"] == best.eta and p["max_depth"] == best.max_depth and p["colsample_bytree"] == best.colsample_bytree)
    sign = -1 if best.metric == "AUC" else 1
    order = [F.col("score") * sign, "eta", "max_depth", "subsample", "colsample_bytree"]
    return CVResult(mean.orderBy(*order), {**chosen, "n_boost_round": rounds}, best.score, kept[chosen["param_id"]])


@dataclass
class Refit:
    booster: Booster
    used: list[int]
    importances: DataFrame
    score: float | None
    platt: tuple[float, float] | None
    history: list[dict]
    shap: DataFrame | None
    interactions: DataFrame | None


@dataclass
class Incremental:
    """``per_round`` trees on a fresh draw of row chunks each round; ``path``: folder of a round's model; ``start``, ``start_round``: where to go on."""

    per_round: int
    path: Callable[[int], str] | None = None
    start: Booster | None = None
    start_round: int = 0


def refit(df: DataFrame, variants: DataFrame, params: dict, rounds: int | None = None, y: str = "y", x: str = "x", shap: bool = False, k: int = 5, chunk: int = 100, interactions: bool = False, metric: str | None = None, incremental: Incremental | None = None) -> Refit:
    """Fits all predictors, keeps those that split, and fits again on them alone.

    A curve that turns scores into probabilities is fitted on out-of-fold predictions where y is 'y_adjusted'.
    ``metric``: of the training rows after each round of the second fit.  ``shap``, ``interactions``: contributions (iid,
    phi without bias) and (row_idx, i, j, phi) of the predictors used.  ``incremental`` makes the second fit in rounds.
    """
    n = rounds or int(params.get("n_boost_round", 100))
    objective, by = objective_of(y)
    config, history = FitConfig.of(params, objective=objective), []
    names = [r["name"] for r in variants.orderBy("variant_idx").collect()]
    first = boosting.fit(df, config, n, names, x, y)
    used = first.used()
    if incremental:
        small = df.withColumn(x, pick(F.col(x), used))
        final = boosting.incremental_fit(small.select("row_idx", F.col(x).alias("x"), F.col(y).alias("y")), config, n, incremental.per_round, chunk, incremental.path, incremental.start, incremental.start_round)
        final.features = [names[i] for i in used]
    else:
        small, final = subset_and_refit(df, used, names, config, n, y, x, history, metric)
    pred = boosting.predict(small, final, x).select(F.col(y).alias("y_true"), "y_pred")
    contributions = explain.shap(small, final, x) if shap else None
    splits = final.used()
    main = contributions.select("iid", subset_contributions(F.col("phi"), splits, len(final.features)).alias("phi")) if shap else None
    pairs = explain.shap_interactions(small, final, x=x) if interactions else None
    imp = explain.collect_importances(final.nodes(df.sparkSession), contributions)
    labels = df.sparkSession.createDataFrame(list(enumerate(final.features)), "feature int, predictors string")
    curve = None
    if y == "y_adjusted":
        _, oof = one_round_cv(small, params, k, chunk, n, y, x)
        curve = linear.platt_fit(oof.select("row_idx", "y_pred").join(df.select("row_idx", F.col("y").alias("y_true")), "row_idx"))
    return Refit(final, used, imp.join(labels, "feature"), metrics.score(pred, by), curve, history, main, pairs)


def subset_and_refit(df: DataFrame, used: list[int], names: list[str], config: FitConfig, rounds: int, y: str = "y", x: str = "x", history: list[dict] | None = None, metric: str | None = None) -> tuple[DataFrame, Booster]:
    small = df.withColumn(x, pick(F.col(x), used))
    return small, boosting.fit(small, config, rounds, [names[i] for i in used], x, y, history=history, metric=metric)


def yhat(df: DataFrame, model, x: str = "y_pred", out: str = "yhat") -> DataFrame:
    """``df`` with what any estimator makes of the column ``x``, a number or an array.

    A calibration curve (two numbers) and a Booster are known; of other objects the first of predict_proba (the second
    class), decision_function and predict is called, on a matrix for each Arrow batch.
    """
    if isinstance(model, tuple) and len(model) == 2:
        return df.withColumn(out, platt(F.col(x), *model))
    if isinstance(model, Booster):
        return boosting.predict(df, model, x, out)
    name = next((n for n in ("predict_proba", "decision_function", "predict") if hasattr(model, n)), None)
    if name is None:
        raise ValueError(f"{type(model).__name__} predicts nothing")

    @F.arrow_udf("double")
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            m = matrix(b) if pa.types.is_list(b.type) else b.to_numpy(zero_copy_only=False).astype(float)[:, None]
            found = np.asarray(getattr(model, name)(m)) if len(b) else np.zeros(0)
            yield pa.array(found[:, 1] if found.ndim == 2 else found, pa.float64())

    return df.withColumn(out, call(F.col(x)))


def predict(df: DataFrame, variants: DataFrame, booster: Booster, x: str = "x") -> DataFrame:
    """``df`` with y_pred; predictors are matched by name, whatever the width."""
    asked = df.sparkSession.createDataFrame([(f,) for f in booster.features], "name string").distinct()
    at = {r["name"]: r.variant_idx for r in variants.join(asked, "name").collect()}  # as many as the model has predictors
    missing = [f for f in booster.features if f not in at]
    if missing:
        raise KeyError(f"{len(missing)} predictors of the model aren't in the data, such as {missing[0]!r}")
    return boosting.predict(df.withColumn("_x", take(F.col(x), [at[f] for f in booster.features])), booster, "_x").drop("_x")


def score_test(pred: DataFrame, y: str = "y", plain: str = "y", curve: tuple[float, float] | None = None) -> dict:
    """The metric of ``y_pred`` against the label it was fitted to, and the AUC of calibrated scores against the plain one."""
    _, by = objective_of(y)
    out = {by.lower(): metrics.score(pred, by, y, "y_pred")}
    if curve:
        out["platt_auc"] = metrics.score(yhat(pred, curve, out="_p"), "AUC", plain, "_p")
    return out


def score_predictions(pred: DataFrame, covars: DataFrame, names: list[str], how: str = "both") -> tuple[dict, DataFrame]:
    """AUCs without and with the covariates taken off, and the predictions with the adjusted ones beside them."""
    df = join_covariates(pred, covars)
    out = {"auc": metrics.auc(df).first().auc}
    for m in ("ols", "rf"):
        if how in (m, "both"):
            table, rows = metrics.adjusted_auc(df, names, model=m)
            r = table.first()
            out |= {f"{m}_auc": r.auc, f"{m}_r2": r.r2}
            df = df.join(rows.select("iid", F.col("residual").alias(f"{m.upper()}_adjusted_y_pred")), "iid", "left")
    return out, df
