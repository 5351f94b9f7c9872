"""Command line: python -m lodemill.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodemill.functions.columns import none_if_none, parse_bool
from lodemill.operators import boosting, boruta, explain, linear, metrics
from lodemill.operators.relational import align_covariates, subset_tables
from lodemill.plans import preprocess as preprocessing
from lodemill.plans import training
from lodemill.sources import genotype, sinks


def session(kind: str = "local", threads: int = 4, url: str | None = None, executors: int | None = None) -> SparkSession:
    """A session on this machine, or on the cluster at ``url``, there with so many executors, or as many as the work asks for."""
    if kind not in ("local", "distributed"):
        raise ValueError(f"unknown kind of cluster {kind!r}")
    b = SparkSession.builder.appName("lodemill").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if kind == "local":
        b = b.master(f"local[{threads}]")
    else:
        b = scaled(b.master(url) if url else b, executors)
    return b.getOrCreate()


def scaled(builder, executors: int | None):
    """A fixed number of executors, or dynamic allocation with shuffle tracking."""
    if executors:
        return builder.config("spark.dynamicAllocation.enabled", "false").config("spark.executor.instances", str(executors))
    return builder.config("spark.dynamicAllocation.enabled", "true").config("spark.dynamicAllocation.shuffleTracking.enabled", "true")


def ingest(spark, a):
    samples, variants = genotype.read_raw(spark, a.in_raw, a.nrows)
    print("rows, variants:", sinks.write_container(samples, variants, a.out))


def adjust(spark, a):
    cov = genotype.read_covariates(spark, a.covar)
    names = cov.columns[2:]
    key = cov.withColumnRenamed(cov.columns[1], "iid").drop(cov.columns[0])
    parts = [genotype.read_container(spark, p) for p in (a.train, a.test)]
    done = linear.adjust(align_covariates(parts[0][0], key), align_covariates(parts[1][0], key), names, parse_bool(a.standardise_covars))
    for df, (_, variants), path in zip(done, parts, (a.out_train, a.out_test), strict=True):
        sinks.write_container(df.drop(*names), variants, path)


def subset(spark, a):
    samples, variants = genotype.read_container(spark, a.in_path, a.xkey, a.ykey)
    ids, snps = (genotype.read_ids(spark, p) if none_if_none(p) else None for p in (a.ids, a.snps))
    print("rows, variants:", sinks.write_container(*subset_tables(samples, variants, ids, snps), a.out_path))


def cv(spark, a):
    samples, _ = genotype.read_container(spark, a.data, a.xkey, "y")
    if a.ykey != "y":
        samples = samples.drop("y").join(genotype.read_container(spark, a.data, a.xkey, a.ykey)[0].select("row_idx", F.col("y").alias(a.ykey)), "row_idx")
    r = training.cross_validate(samples, a.n_iter, a.n_fold, a.row_chunks, a.n_boost_round, a.seed, (a.subsample_min, a.subsample_max), a.cv_subsample, a.ykey)
    sinks.write_csv(r.scores, f"{a.out_dir}/cv/hp_search/{a.out_prefix}_cv_scores.csv")
    sinks.write_csv(r.oof, f"{a.out_dir}/cv/y_pred/{a.out_prefix}_best_cv_ypred.csv")
    print(json.dumps(r.params), r.score)


def refit(spark, a):
    samples, variants = genotype.read_container(spark, a.data, a.xkey, "y")
    if a.ykey != "y":
        samples = samples.join(spark.read.parquet(f"{a.data}/samples").select("row_idx", a.ykey), "row_idx")
    params = genotype.read_search_results(spark, a.hp)
    start = genotype.read_booster(spark, a.start_model) if none_if_none(a.start_model) else None
    rounds = training.Incremental(a.n_boost_per_round, lambda r: f"{a.out_dir}/rounds/{r:04d}", start, a.start_round) if parse_bool(a.incremental) else None
    r = training.refit(samples, variants, params, a.n_boost_round, a.ykey, shap=parse_bool(a.shap), chunk=a.row_chunks, interactions=parse_bool(a.shap_interactions), metric=none_if_none(a.eval_metric), incremental=rounds)
    if r.shap is not None:
        r.shap.write.mode("overwrite").parquet(f"{a.out_dir}/shap_main")
        sinks.write_csv(spark.createDataFrame([(r.booster.features[i],) for i in r.booster.used()], "predictors string"), f"{a.out_dir}/shap_colnames.csv", header=False)
    if r.interactions is not None:
        r.interactions.write.mode("overwrite").parquet(f"{a.out_dir}/shap_interactions")
    if r.history:
        sinks.write_csv(spark.createDataFrame([(h["round"], h["metric"], h["value"]) for h in r.history], "round int, metric string, value double"), f"{a.out_dir}/eval_history.csv")
    sinks.write_booster(spark, r.booster, f"{a.out_dir}/model")
    sinks.write_csv(r.importances, f"{a.out_dir}/importances.csv")
    sinks.write_csv(spark.createDataFrame([(f,) for f in r.booster.features], "predictors string"), f"{a.out_dir}/used_cols.csv")
    if r.platt:
        spark.createDataFrame([r.platt], "a double, b double").write.mode("overwrite").json(f"{a.out_dir}/platt")
    print("score", r.score)


def predict(spark, a):
    samples, variants = genotype.read_container(spark, a.data, a.xkey)
    if a.ykey != "y":
        samples = samples.join(spark.read.parquet(f"{a.data}/samples").select("row_idx", a.ykey), "row_idx")
    booster = genotype.read_booster(spark, a.model)
    out = training.predict(samples, variants, booster)
    curve = None
    if none_if_none(a.platt):
        r = spark.read.json(a.platt).first()
        curve = (r.a, r.b)
    sinks.write_csv(sinks.predictions(out, platt=curve), a.out)
    print(json.dumps(training.score_test(out, a.ykey, "y", curve)))
    if none_if_none(a.importances):
        labels = spark.createDataFrame(list(enumerate(booster.features)), "feature int, predictors string")
        sinks.write_csv(explain.collect_importances(booster.nodes(spark)).join(labels, "feature"), a.importances)


def select(spark, a):
    samples, variants = genotype.read_container(spark, a.data, a.xkey, a.ykey)
    r = boruta.select(samples, boosting.FitConfig.of(json.loads(a.params)), a.n_boost_round, a.max_iter, a.perc, train_split=a.train_split, on=a.on)
    sinks.write_selected(variants, r.support, a.out, "important")
    sinks.write_selected(variants, r.support_weak, a.out, "tentative")
    sinks.write_csv(variants.join(spark.createDataFrame(list(enumerate(r.ranking)), "variant_idx int, ranking int"), "variant_idx").select("name", "ranking"), f"{a.out}/ranking.csv")
    print("important", sum(r.support), "tentative", sum(r.support_weak))


def score(spark, a):
    pred = genotype.read_predictions(spark, a.predictions, a.sep, a.id)
    cov = genotype.read_covariates(spark, a.covars)
    key = cov.withColumnRenamed(cov.columns[1], "iid").drop(cov.columns[0])
    found, rows = training.score_predictions(pred, key, cov.columns[2:], a.model)
    sinks.write_csv(rows, a.out)
    print(json.dumps(found))


def preprocess(spark, a):
    samples, variants = genotype.read_raw(spark, a.in_raw, a.nrows)
    train, test, kept = prepared(spark, samples, variants, a.covar, a.maf, a.share, a.seed)
    for df, name in ((train, "train"), (test, "test")):
        print(name, "rows, variants:", sinks.write_container(df, kept, f"{a.out}/{name}"))


def prepared(spark, samples, variants, covar, maf, share, seed):
    cov = None
    if none_if_none(covar):
        table = genotype.read_covariates(spark, covar)
        cov = table.withColumnRenamed(table.columns[1], "iid").drop(table.columns[0])
    return preprocessing.preprocess(samples, variants, cov, maf, share, seed)


def run(spark, a):
    """Everything from the text of dosages to scored predictions of the test set."""
    samples, variants = genotype.read_raw(spark, a.in_raw, a.nrows)
    train, test, kept = prepared(spark, samples, variants, a.covar, a.maf, a.share, a.seed)
    sinks.write_container(train, kept, f"{a.out}/train")
    sinks.write_container(test, kept, f"{a.out}/test")
    train, test = (spark.read.parquet(f"{a.out}/{n}/samples") for n in ("train", "test"))
    x, y = ("x_adjusted", "y_adjusted") if "x_adjusted" in train.columns else ("x", "y")
    best = training.cross_validate(train, a.n_iter, a.n_fold, a.row_chunks, a.n_boost_round, a.seed, y=y, x=x)
    sinks.write_csv(best.scores, f"{a.out}/cv_scores.csv")
    model = training.refit(train, kept, best.params, y=y, x=x, k=a.n_fold, chunk=a.row_chunks)
    sinks.write_booster(spark, model.booster, f"{a.out}/model")
    sinks.write_csv(model.importances, f"{a.out}/importances.csv")
    pred = training.predict(test, kept, model.booster, x)
    sinks.write_csv(sinks.predictions(pred, platt=model.platt), f"{a.out}/predictions.csv")
    print(json.dumps({"cv": best.score, "train": model.score, "test_auc": metrics.score(pred.withColumnRenamed("y", "y_true"), "AUC")}))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodemill")
    p.add_argument("--cluster", default="local")
    p.add_argument("--threads", type=int, default=4)
    p.add_argument("--url")
    p.add_argument("--executors", type=int)
    s = p.add_subparsers(dest="command", required=True)

    def command(f, *flags):
        c = s.add_parser(f.__name__)
        c.set_defaults(run=f)
        for name, kw in flags:
            c.add_argument(f"--{name}", **kw)

    need, text = {"required": True}, lambda d: {"default": d}
    num = lambda d, kind=int: {"type": kind, "default": d}
    data, keys = ("data", need), [("xkey", text("x")), ("ykey", text("y"))]
    command(ingest, ("in_raw", need), ("out", need), ("nrows", num(None)))
    command(adjust, *[(n, need) for n in ("train", "test", "covar", "out_train", "out_test")], ("standardise_covars", text("true")))
    command(subset, ("in_path", need), ("out_path", need), ("snps", text("none")), ("ids", text("none")), *keys)
    command(cv, data, *keys, ("out_dir", need), ("out_prefix", need), ("n_iter", num(10)), ("n_fold", num(5)), ("row_chunks", num(100)), ("n_boost_round", num(50)), ("seed", num(0)), ("cv_subsample", num(0)), ("subsample_min", num(0.7, float)), ("subsample_max", num(0.7, float)))
    command(refit, data, *keys, ("hp", need), ("out_dir", need), ("n_boost_round", num(None)), ("shap", text("false")), ("shap_interactions", text("false")), ("eval_metric", text("none")), ("incremental", text("false")), ("n_boost_per_round", num(1)), ("row_chunks", num(100)), ("start_round", num(0)), ("start_model", text("none")))
    command(predict, data, *keys, ("model", need), ("platt", text("none")), ("out", need), ("importances", text("none")))
    command(select, data, *keys, ("params", text("{}")), ("out", need), ("n_boost_round", num(20)), ("max_iter", num(30)), ("perc", num(100.0, float)), ("train_split", num(1.0, float)), ("on", text("train")))
    command(score, ("predictions", need), ("covars", need), ("out", need), ("sep", text(",")), ("id", text("IID")), ("model", {"choices": ["ols", "rf", "both"], "default": "both"}))
    first = [("in_raw", need), ("out", need), ("nrows", num(None)), ("covar", text("none")), ("maf", num(0.05, float)), ("share", num(0.7, float)), ("seed", num(0))]
    command(preprocess, *first)
    command(run, *first, ("n_iter", num(5)), ("n_fold", num(5)), ("row_chunks", num(100)), ("n_boost_round", num(50)))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(session(a.cluster, a.threads, a.url, a.executors), a)


if __name__ == "__main__":
    main(sys.argv[1:])
