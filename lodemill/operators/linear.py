"""Regressions for covariate adjustment and calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.functions.arrays import lists, matrix


def zscore_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column; a deviation of 0 counts as 1."""
    r = df.agg(*[f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(cols) for f in (F.avg, F.stddev_pop)]).first()
    return {c: (r[f"avg_{i}"], r[f"stddev_pop_{i}"] or 1.0) for i, c in enumerate(cols)}


def zscore(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns standardised by statistics that may come from other rows."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def slopes_one(long: DataFrame, x: str, c: str, by: str) -> DataFrame:
    """(by, beta): slope of x on one covariate with intercept, for each group."""
    return long.groupBy(by).agg(F.regr_slope(x, c).alias("beta"))


def slopes(df: DataFrame, covars: list[str], x: str = "x") -> np.ndarray:
    """k x p slopes of every element of the array ``x`` on the covariates, with an intercept that is dropped.

    One pass: each partition adds up, in matrix products, the moments of its rows; for each element only rows where
    it isn't null count.  Partial sums meet by element in a hash aggregation, whose tasks solve the k x k systems in
    batches; the driver gets the k x p result.
    """
    k = len(covars)
    m = k + 1
    fields = "at int, moments array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = cross = None
        for b in batches:
            if not b.num_rows:
                continue
            c = np.column_stack([np.ones(b.num_rows), *(b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(k))])
            v = matrix(b.column(k))
            ok = ~np.isnan(v)
            if grams is None:
                grams, cross = np.zeros((m * m, v.shape[1])), np.zeros((m, v.shape[1]))
            outer = (c[:, :, None] * c[:, None, :]).reshape(len(c), -1)
            grams += outer.T @ ok
            cross += c.T @ np.where(ok, v, 0.0)
        if grams is not None:
            p = grams.shape[1]
            rows = np.vstack([grams, cross]).T
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p, dtype=np.int32)), lists(rows)], ["at", "moments"])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = matrix(b.column(1))
                g, v = s[:, : m * m].reshape(-1, m, m), s[:, m * m :, None]
                yield pa.RecordBatch.from_arrays([b.column(0), lists((np.linalg.pinv(g, hermitian=True) @ v)[:, 1:, 0])], ["at", "beta"])

    cols = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(covars)]
    parts = df.select(*cols, F.col(x).cast("array<double>").alias("x")).mapInArrow(partial, fields)
    sums = parts.groupBy("at").agg(F.array(*[F.sum(F.get("moments", F.lit(i))) for i in range(m * m + m)]).alias("m"))
    found = sums.mapInArrow(solved, "at int, beta array<double>").toArrow().combine_chunks().sort_by("at")
    return matrix(found.column(1).combine_chunks()).reshape(len(found), k).T if len(found) else np.zeros((k, 0))


def residual_matrix(df: DataFrame, covars: list[str], beta: np.ndarray, x: str = "x", out: str = "x_adjusted") -> DataFrame:
    """``df`` with x - covariates @ beta; no intercept is taken off, missing elements stay missing."""
    sent = df.sparkSession.sparkContext.broadcast(beta)  # as many numbers as covariates times elements

    @F.arrow_udf("array<double>")
    def residual(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for v, *c in batches:
            if len(v):
                yield lists(matrix(v) - np.column_stack([a.to_numpy(zero_copy_only=False).astype(float) for a in c]) @ sent.value)
            else:
                yield pa.array([], pa.list_(pa.float64()))

    return df.withColumn(out, residual(F.col(x).cast("array<double>"), *[F.col(c).cast("double") for c in covars]))


def residual_expr(x: Column, covars: list[Column], beta: list[float]) -> Column:
    """x - sum of beta * covariate, as one expression."""
    out = x
    for c, b in zip(covars, beta, strict=True):
        out = out - F.lit(float(b)) * c
    return out


def _normal_equations(df: DataFrame, cols: list[Column], y: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Moments of (1, cols) and y, in one aggregation; rows with a null anywhere are left out."""
    w = F.lit(1.0) if weight is None else weight
    k = len(cols) + 1
    rows = df.select(w.alias("w"), y.cast("double").alias("y"), *[c.cast("double").alias(f"c{i + 1}") for i, c in enumerate(cols)]).withColumn("c0", F.lit(1.0)).dropna()
    terms = [F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}")) for i in range(k) for j in range(i, k)] + [F.sum(F.col("w") * F.col(f"c{i}") * F.col("y")) for i in range(k)]
    r = list(rows.agg(*[t.alias(f"t{n}") for n, t in enumerate(terms)]).first())
    g, n = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = r[n] or 0.0
            n += 1
    return g, np.array([v or 0.0 for v in r[n:]])


def ols(df: DataFrame, covars: list[str], y: str) -> np.ndarray:
    """Intercept and slopes."""
    g, v = _normal_equations(df, [F.col(c) for c in covars], F.col(y))
    return np.linalg.lstsq(g, v, rcond=None)[0]


def fit_ols(df: DataFrame, covars: list[str], y: str, fitted: str = "fitted", residual: str = "residual") -> DataFrame:
    """``df`` with fitted value and residual of y on the covariates, with intercept; null where a covariate or y is."""
    b = ols(df, covars, y)
    fit = F.lit(float(b[0]))
    for c, s in zip(covars, b[1:], strict=True):
        fit = fit + F.lit(float(s)) * F.col(c)
    return df.withColumn(fitted, fit).withColumn(residual, F.col(y) - fit)


def logistic(df: DataFrame, covars: list[str], y: str, ridge: float = 0.0, steps: int = 50, tol: float = 1e-10) -> np.ndarray:
    """Intercept and slopes by Newton's method, one aggregation a step; ``ridge`` (1 / C) weighs slopes only."""
    cols = [F.col(c).cast("double") for c in covars]
    beta = np.zeros(len(covars) + 1)
    rows = df.select(*[c.alias(f"v{i}") for i, c in enumerate(cols)], F.col(y).cast("double").alias("y")).dropna().persist()
    names = [F.col(f"v{i}") for i in range(len(cols))]
    penalty = np.diag([0.0, *[ridge] * len(cols)])
    for _ in range(steps):
        z = F.lit(float(beta[0]))
        for c, b in zip(names, beta[1:], strict=True):
            z = z + F.lit(float(b)) * c
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        g, v = _normal_equations(rows, names, F.lit(0.0), p * (1 - p))
        grad = _normal_equations(rows, names, F.col("y") - p)[1] - penalty @ beta
        step = np.linalg.solve(g + penalty + 1e-12 * np.eye(len(beta)), grad)
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    rows.unpersist()
    return beta


def y_slopes(df: DataFrame, covars: list[str], y: str = "y", method: str = "logistic") -> np.ndarray:
    """Slopes of y: 'linear', or 'logistic' with an L2 penalty of weight 1."""
    if method == "linear":
        return ols(df, covars, y)[1:]
    if method == "logistic":
        return logistic(df, covars, y, ridge=1.0)[1:]
    raise ValueError(f"unknown method {method!r}")


def adjust(train: DataFrame, test: DataFrame, covars: list[str], standardise: bool = True) -> tuple[DataFrame, DataFrame]:
    """Train and test with x_adjusted and y_adjusted; means, deviations and slopes come from train alone."""
    if standardise:
        stats = zscore_stats(train, covars)
        train, test = zscore(train, stats), zscore(test, stats)
    bx, by = slopes(train, covars), y_slopes(train, covars, method="linear")
    done = []
    for d in (train, test):
        d = residual_matrix(d, covars, bx)
        done.append(d.withColumn("y_adjusted", residual_expr(F.col("y"), [F.col(c) for c in covars], list(by))))
    return done[0], done[1]


def platt_fit(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> tuple[float, float]:
    """Intercept and slope of the unpenalised logistic curve."""
    a, b = logistic(pred, [p], y)
    return float(a), float(b)


def odds_ratios(long: DataFrame, y: str = "y", x: str = "dosage", by: str = "variant") -> DataFrame:
    """(by, beta, odds_ratio) of the logistic regression of y on x within each group.

    Dosages take few values, so groups are first counted by (x, y); a group's counts, not its rows, meet in one task.
    """
    counts = long.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").cast("double").alias("n"))
    kind = dict(long.dtypes)[by]

    def newton(pdf: pd.DataFrame) -> pd.DataFrame:
        v, t, n = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy()
        c, beta = np.column_stack([np.ones(len(v)), v]), np.zeros(2)
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(c @ beta, -700, 700)))
            step = np.linalg.lstsq((c * (n * q * (1 - q))[:, None]).T @ c + 1e-12 * np.eye(2), c.T @ (n * (t - q)), rcond=None)[0]
            beta = beta + step
            if np.abs(step).max() < 1e-10:
                break
        return pd.DataFrame({by: [pdf[by].iloc[0]], "beta": [beta[1]], "odds_ratio": [float(np.exp(beta[1]))]})

    return counts.groupBy(by).applyInPandas(newton, f"{by} {kind}, beta double, odds_ratio double")
