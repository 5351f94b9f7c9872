"""Boruta feature selection with shadow features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodemill.functions.columns import average_rank, binomial_tails, pick, seeded, with_row_index
from lodemill.operators import boosting, explain, qc


def threshold(shadow: DataFrame, perc: float = 100.0, col: str = "imp") -> DataFrame:
    """One row (threshold): the percentile of the shadow importances, linearly interpolated."""
    return shadow.where(~F.isnan(col)).agg(F.percentile(F.col(col), F.lit(perc / 100)).alias("threshold"))


def hits(imp: DataFrame, thr: float) -> DataFrame:
    """``imp(feature, imp)`` with hit: 1 if above the threshold; a missing importance is 0."""
    return imp.withColumn("hit", F.when(F.nanvl(F.coalesce("imp", F.lit(0.0)), F.lit(0.0)) > thr, 1).otherwise(0))


def benjamini_hochberg(p: DataFrame, alpha: float = 0.05, col: str = "p", key: str = "feature") -> DataFrame:
    """``p`` with rank, adjusted (running minimum of p m / i from the highest down, at most 1) and rejected.

    Ranks come from range partitions; each range has its own running minimum, and one row of it bounds the ranges below.
    """
    r = with_row_index(p.where(F.col(col).isNotNull()), col, key, name="_i").withColumn("rank", (F.col("_i") + 1).cast("int"))
    size = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = r.count()
    block = max(1, -(-m // size))
    r = r.withColumn("_v", F.col(col) * m / F.col("rank")).withColumn("_b", F.floor(F.col("_i") / block).cast("int"))
    facts = r.groupBy("_b").agg(F.min("_v").alias("least"), F.max(F.when(F.col(col) <= F.col("rank") / m * alpha, F.col("rank"))).alias("last")).collect()
    above, after = float("inf"), {}
    for f in sorted(facts, key=lambda f: -f["_b"]):
        after[f["_b"]] = above
        above = min(above, f["least"])
    last = max((f["last"] or 0 for f in facts), default=0)
    rest = p.sparkSession.createDataFrame(sorted(after.items()), "_b int, _after double")  # one row for each range
    down = W.partitionBy("_b").orderBy(F.col("rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    r = r.join(F.broadcast(rest), "_b").withColumn("adjusted", F.least(F.lit(1.0), F.col("_after"), F.min("_v").over(down)))
    return r.withColumn("rejected", F.col("rank") <= last).drop("_i", "_v", "_b", "_after")


def tests(state: DataFrame, iteration: int, alpha: float = 0.05, two_step: bool = True) -> DataFrame:
    """(feature, decision, hits, accept_p, reject_p, decided) of features whose decision isn't -1.

    The numbers of hits are Bin(iteration, 1/2) by chance.  two_step: Benjamini-Hochberg at alpha and p <= alpha /
    iteration; else p <= alpha / all features.  Only undecided ones (0) change.
    """
    spark = state.sparkSession
    total = state.count()
    tails = spark.createDataFrame([(h, ge, le) for n, h, ge, le in binomial_tails(iteration) if n == iteration], "hits int, accept_p double, reject_p double")
    t = state.where("decision >= 0").withColumn("hits", F.col("hits").cast("int")).join(F.broadcast(tails), "hits")  # iteration + 1 rows
    if two_step:
        for name in ("accept", "reject"):
            bh = benjamini_hochberg(t, alpha, f"{name}_p").select("feature", (F.col("rejected") & (F.col(f"{name}_p") <= alpha / iteration)).alias(name))
            t = t.join(bh, "feature")
    else:
        t = t.withColumn("accept", F.col("accept_p") <= alpha / total).withColumn("reject", F.col("reject_p") <= alpha / total)
    decided = F.when((F.col("decision") == 0) & F.col("accept"), 1).when((F.col("decision") == 0) & F.col("reject"), -1).otherwise(F.col("decision"))
    return t.select("feature", "decision", "hits", "accept_p", "reject_p", decided.cast("int").alias("decided"))


def rank_importances(imp: DataFrame, by: str = "iteration") -> DataFrame:
    """Average ranks within each iteration; missing stays missing."""
    clean = imp.withColumn("imp", F.when(~F.isnan("imp"), F.col("imp")))
    return clean.withColumn("rank", average_rank("imp", [by]))


def median_ranks(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("feature").agg(F.median("rank").alias("median_rank"))


def tentative(imp: DataFrame, undecided: DataFrame, shadow_threshold_median: float) -> DataFrame:
    """Undecided features whose median importance is above that of the thresholds."""
    return imp.join(undecided.select("feature"), "feature", "left_semi").groupBy("feature").agg(F.median("imp").alias("median_imp")).where(F.col("median_imp") > shadow_threshold_median)


def permuted_columns(df: DataFrame, features: list[int], seed: int, x: str = "x") -> DataFrame:
    """(row_idx, shadow): every chosen element permuted over all rows on its own.

    Row i gets element j of the row that stands at place i in j's own md5 order.  Places come from range partitions, a
    feature at a time within one sort: the long form holds the chosen features only.
    """
    long = df.select("row_idx", F.posexplode(pick(F.col(x), features)).alias("j", "v"))
    order = long.withColumn("k", seeded(seed, F.col("j"), F.col("row_idx")))
    placed = with_row_index(order, "j", "k", "row_idx", name="place")
    n = df.count()
    moved = placed.select((F.col("place") - F.col("j") * n).alias("row_idx"), "j", "v")
    return moved.groupBy("row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("shadow"))


def shadow_copies(n: int) -> int:
    """How often n features have to be copied: shadows are doubled until there are five or more."""
    k = 1
    while n * k < 5:
        k *= 2
    return k


def final_ranks(history: np.ndarray, confirmed: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """1 for confirmed features, 2 for weak ones; the others follow by the median, over the iterations, of their ranks.

    history: iterations x features, NaN where a feature was out.  The highest importance ranks first; ties share the mean
    rank.  Ranks of the others begin at 2, or at 3 if there are weak ones; a feature that was never in comes last.
    """
    out = np.ones(history.shape[1], int)
    out[weak] = 2
    rest = np.flatnonzero(~(confirmed | weak))
    if not len(rest):
        return out
    each = np.array([_average_ranks(-row) for row in history[:, rest]])
    seen = ~np.isnan(each).all(0)
    median = np.full(len(rest), np.inf)
    median[seen] = np.nanmedian(each[:, seen], axis=0)
    ranks = _average_ranks(median)
    out[rest] = (ranks - ranks.min() + (3 if weak.any() else 2)).astype(int)
    return out


def _average_ranks(v: np.ndarray) -> np.ndarray:
    """Ascending ranks, ties at their mean; NaN stays."""
    out, ok = np.full(len(v), np.nan), ~np.isnan(v)
    _, inverse, count = np.unique(v[ok], return_inverse=True, return_counts=True)
    out[ok] = (np.cumsum(count) - (count - 1) / 2)[inverse]
    return out


@dataclass
class Result:
    support: list[bool]
    support_weak: list[bool]
    hits: list[int]
    decisions: list[int]
    ranking: list[int]


def select(df: DataFrame, config: boosting.FitConfig, rounds: int, max_iter: int = 10, perc: float = 100.0, alpha: float = 0.05, two_step: bool = True, train_split: float = 0.7, on: str = "test", x: str = "x", y: str = "y", importance: str = "shap", stat: str = "mean") -> Result:
    """Runs at most max_iter - 1 iterations, while any feature is undecided.

    Rejected features leave the matrix; shadows are doubled until there are five.  Each iteration fits floor(train_split
    * n) rows drawn anew.  Importances are mean absolute contributions on the 'train' or 'test' part.  If nothing is left
    unselected the support is all true.
    """
    if importance != "shap" or stat != "mean":
        raise NotImplementedError("importance 'shap' and statistic 'mean' only")
    if on not in ("train", "test") or (on == "test" and train_split >= 1):
        raise ValueError("there is no such part to measure importances on")
    p, n = len(df.select(x).first()[0]), df.count()
    decision, hit = np.zeros(p, int), np.zeros(p, int)
    history, thresholds = [], []
    for it in range(1, max_iter):
        if not (decision == 0).any():
            break
        live = np.flatnonzero(decision >= 0).tolist()
        real = df.select("row_idx", y, pick(F.col(x), live).alias("real"))
        copies = live * shadow_copies(len(live))
        shadow = permuted_columns(df, live, config.seed + it, x) if len(copies) == len(live) else _doubled(df, live, copies, config.seed + it, x)
        both = real.join(shadow, "row_idx").select("row_idx", y, F.concat("real", "shadow").alias("x"))
        part = train_rows(both, train_split, n, f"{config.seed}|{it}").persist()
        model = boosting.fit(part.where("_u") if train_split < 1 else part, config, rounds, y=y)
        measured = part.where("_u" if on == "train" else "not _u") if train_split < 1 else part
        phi = {r.feature: r.shap_mean_abs for r in explain.mean_abs(explain.shap(measured, model)).collect()}  # one row a feature
        part.unpersist()
        thr = float(np.percentile([phi[j] for j in range(len(live), len(live) + len(copies))], perc))
        imp = np.full(p, np.nan)
        imp[live] = [phi[j] for j in range(len(live))]
        history.append(imp)
        thresholds.append(thr)
        hit += np.nan_to_num(imp) > thr
        state = df.sparkSession.createDataFrame([(int(i), int(d), int(h)) for i, (d, h) in enumerate(zip(decision, hit, strict=True))], "feature int, decision int, hits int")
        for r in tests(state, it, alpha, two_step).collect():
            decision[r.feature] = r.decided
    weak = np.zeros(p, bool)
    for i in np.flatnonzero(decision == 0):
        weak[i] = bool(np.median([h[i] for h in history]) > np.median(thresholds)) if history else False
    support = decision == 1
    if not ((~support) & (~weak)).any():
        support = np.ones(p, bool)
    ranking = final_ranks(np.array(history).reshape(-1, p), decision == 1, weak)
    return Result(support.tolist(), weak.tolist(), hit.tolist(), decision.tolist(), ranking.tolist())


def train_rows(df: DataFrame, share: float, n: int, seed: str | int) -> DataFrame:
    """``df`` with _u: true for exactly floor(share * n) of its n rows, drawn by the seed."""
    want = int(share * n + 1e-9)
    out = qc.split_ids(df, want / n if n else 0.0, "row_idx", seed)
    return out.withColumn("_u", F.col("split") == "train").drop("split")

def _doubled(df: DataFrame, live: list[int], copies: list[int], seed: int, x: str) -> DataFrame:
    """Shadows of few features, more than once each."""
    out = None
    for k in range(len(copies) // len(live)):
        one = permuted_columns(df, live, seed * 31 + k, x).withColumnRenamed("shadow", f"s{k}")
        out = one if out is None else out.join(one, "row_idx")
    return out.select("row_idx", F.concat(*[f"s{k}" for k in range(len(copies) // len(live))]).alias("shadow"))
