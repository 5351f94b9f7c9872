"""Importances from the node table and exact path-dependent SHAP values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.functions.arrays import lists, matrix
from lodemill.operators.boosting import Booster


def importances(nodes: DataFrame) -> DataFrame:
    """(feature, weight, gain, cover, total_gain, total_cover) of the features that split."""
    inner = nodes.where("not is_leaf")
    return inner.groupBy("feature").agg(F.count("*").alias("weight"), F.avg("gain").alias("gain"), F.avg("cover").alias("cover"), F.sum("gain").alias("total_gain"), F.sum("cover").alias("total_cover"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    """One row: numbers of trees and of features used."""
    return nodes.agg(F.countDistinct("tree").alias("trees"), F.countDistinct(F.when(~F.col("is_leaf"), F.col("feature"))).alias("features"))


def _paths(tree: list[dict]) -> list[tuple[float, list[tuple[int, float, float, float, bool]]]]:
    """For each leaf its value and, by feature, the interval that leads to it, the share of cover and whether missing goes along."""
    out = []

    def walk(at: int, cond: dict) -> None:
        n = tree[at]
        if n["feature"] < 0:
            out.append((n["leaf"], [(f, *v) for f, v in cond.items()]))
            return
        f = n["feature"]
        lo, hi, share, miss = cond.get(f, (-np.inf, np.inf, 1.0, True))
        for child, left in ((n["left"], True), (n["right"], False)):
            part = tree[child]["cover"] / n["cover"] if n["cover"] else 0.0
            new = (lo, min(hi, n["split"])) if left else (max(lo, n["split"]), hi)
            walk(child, cond | {f: (*new, share * part, miss and n["default_left"] == left)})

    walk(0, {})
    return out


def _weights(d: int) -> np.ndarray:
    """Shapley weight of a coalition of each size 0 to d - 1 out of d players."""
    from math import factorial

    return np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])


def _without(poly: np.ndarray, z: float, o: np.ndarray) -> np.ndarray:
    """Coefficients by coalition size with one player's factor (z + o t) taken out; poly: rows x (d + 1)."""
    d = poly.shape[1] - 1
    out = np.zeros((len(poly), d))
    one = o > 0.5
    rest = poly[one, d].copy()
    for s in range(d - 1, -1, -1):  # o = 1: from the highest power down
        out[one, s] = rest
        rest = poly[one, s] - z * rest
    if z > 0:
        out[~one] = poly[~one, :d] / z
    return out


def shap_values(booster: Booster, x: np.ndarray) -> np.ndarray:
    """n x (p + 1): contribution of every feature to the margin; the last column is the bias.

    For one leaf with features i on its path, a coalition reaches it with weight prod(o_i or z_i): o_i says whether the
    row meets the condition, z_i is the share of cover that does.  The sums over coalitions of one size are the
    coefficients of prod(z_i + o_i t), so each leaf takes polynomial time.
    """
    n, p = len(x), len(booster.features)
    phi = np.zeros((n, p + 1))
    phi[:, p] = booster.base
    for tree in booster.trees:
        for value, path in _paths(tree):
            d = len(path)
            if not d:
                phi[:, p] += value
                continue
            meets = np.array([np.where(np.isnan(x[:, f]), miss, (x[:, f] >= lo) & (x[:, f] < hi)) for f, lo, hi, _, miss in path], float)
            shares = [s for *_, s, _ in path]
            phi[:, p] += value * np.prod(shares)
            poly = np.zeros((n, d + 1))
            poly[:, 0] = 1.0
            for k in range(d):
                poly[:, 1 : k + 2] = poly[:, 1 : k + 2] * shares[k] + poly[:, : k + 1] * meets[k][:, None]
                poly[:, 0] *= shares[k]
            w = _weights(d)
            for k, (f, *_) in enumerate(path):
                phi[:, f] += value * (meets[k] - shares[k]) * (_without(poly, shares[k], meets[k]) @ w)
    return phi


def interaction_values(booster: Booster, x: np.ndarray, features: list[int]) -> np.ndarray:
    """n x k x k interactions of the chosen features: half the Shapley interaction off the diagonal; rows of the full matrix sum to the main values.

    phi_ij is half of phi_i with j known less phi_i with j unknown, summed leaf by leaf.
    """
    n, k = len(x), len(features)
    place = {f: i for i, f in enumerate(features)}
    out = np.zeros((n, k, k))
    main = shap_values(booster, x)
    for tree in booster.trees:
        for value, path in _paths(tree):
            d = len(path)
            meets = np.array([np.where(np.isnan(x[:, f]), miss, (x[:, f] >= lo) & (x[:, f] < hi)) for f, lo, hi, _, miss in path], float) if d else None
            for b in range(d):
                fb, zb, rest = path[b][0], path[b][3], [k2 for k2 in range(d) if k2 != b]
                if fb not in place or not rest:
                    continue
                poly = np.zeros((n, d))
                poly[:, 0] = 1.0
                for m, r in enumerate(rest):
                    poly[:, 1 : m + 2] = poly[:, 1 : m + 2] * path[r][3] + poly[:, : m + 1] * meets[r][:, None]
                    poly[:, 0] *= path[r][3]
                w = _weights(d - 1)
                for r in rest:
                    if path[r][0] in place:
                        gain = value * (meets[r] - path[r][3]) * (_without(poly, path[r][3], meets[r]) @ w)
                        out[:, place[path[r][0]], place[fb]] += 0.5 * gain * (meets[b] - zb)
    for i, f in enumerate(features):
        out[:, i, i] = main[:, f] - out[:, i].sum(1)
    return out


def shap(df: DataFrame, booster: Booster, x: str = "x", out: str = "phi") -> DataFrame:
    """``df`` with the array of contributions, bias last."""
    sent = df.sparkSession.sparkContext.broadcast(booster)

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield lists(shap_values(sent.value, matrix(col))) if len(col) else pa.array([], pa.list_(pa.float64()))

    return df.withColumn(out, run(F.col(x).cast("array<double>")))


def shap_interactions(df: DataFrame, booster: Booster, key: str = "row_idx", x: str = "x") -> DataFrame:
    """(key, i, j, phi) for pairs of used features with an interaction."""
    sent, used = df.sparkSession.sparkContext.broadcast(booster), booster.used()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                m = interaction_values(sent.value, matrix(part.column(1)), used)
                r, i, j = np.nonzero(m)
                u = np.array(used, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(u[i]), pa.array(u[j]), pa.array(m[r, i, j])], ["k", "i", "j", "phi"])

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(x).cast("array<double>")).mapInArrow(run, f"k {kind}, i int, j int, phi double").withColumnRenamed("k", key)


def mean_abs(df: DataFrame, col: str = "phi", drop_last: bool = True) -> DataFrame:
    """(feature, shap_mean_abs) over all rows: partial sums of whole arrays in each partition, then one row a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                m = np.abs(matrix(b.column(0)))
                total, n = m.sum(0) if total is None else total + m.sum(0), n + len(m)
        if n:
            total = total[:-1] if drop_last else total
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total), pa.array([n] * len(total), pa.int64())], ["feature", "s", "n"])

    return df.select(F.col(col).cast("array<double>")).mapInArrow(run, "feature int, s double, n long").groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("shap_mean_abs"))


def top_features(imp: DataFrame, by: str = "gain", n: int = 5) -> DataFrame:
    return imp.orderBy(F.desc(by), "feature").limit(n)


def collect_importances(nodes: DataFrame, contributions: DataFrame | None = None) -> DataFrame:
    """Importances, joined by feature with the mean absolute contributions."""
    imp = importances(nodes)
    return imp if contributions is None else imp.join(mean_abs(contributions), "feature", "left")
