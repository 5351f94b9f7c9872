"""Deterministic instances of readers, writers, whole runs and command lines on the driver's tables, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodemill.operators import boosting, boruta, explain, folds, qc
from lodemill.operators import relational as R
from lodemill.plans import preprocess, training
from lodemill.plans import tables as T
from lodemill.plans.queries import _ADJUSTED, _IMP, _SPLIT, _STUMP, WIDTH, _adjusted, _imp, _stump_data, fixed_booster, query, rounded, write_raw
from lodemill.sources import genotype, sinks
from lodemill.sources.scratch import scratch_path

NAMES = f"v AS (SELECT range::INT AS variant_idx, 'f' || range::VARCHAR AS name FROM range({WIDTH}))"
DOSES = f"WITH {T.LONG}"


def names(spark):
    return spark.range(WIDTH).select(F.col("id").cast("int").alias("variant_idx"), F.concat(F.lit("f"), "id").alias("name"))


def stored(spark, samples, name="container"):
    """Path of a container of the samples."""
    path = scratch_path(spark, name)
    fam = [c for c in ("fid", "pat", "mat", "sex", "phenotype") if c not in samples.columns]
    sinks.write_container(samples.withColumns({c: F.lit(None).cast("string") for c in fam}), names(spark), path)
    return path


def exploded(df, *cols, col="x", digits=6):
    return rounded(df.select(*cols, F.posexplode(col).alias("variant", "v")), "v", digits=digits)


# Readers and writers


@query(f"WITH {T.LONG} SELECT row_idx, iid, y, variant, round(v, 6) AS v FROM long")
def raw_text_read(spark, sf):
    """A text in several files, each split by size; places follow the files."""
    s, _ = genotype.read_raw(spark, write_raw(spark, T.samples(spark, sf)))
    return exploded(s, "row_idx", "iid", "y")


@query(f"WITH {T.LONG}, n AS (SELECT count(*) AS n FROM samples) SELECT row_idx - n // 4 AS row_idx, iid, variant, round(v, 6) AS v FROM long, n WHERE row_idx >= n // 4 AND row_idx < n // 4 + n // 2")
def raw_text_part(spark, sf):
    s = T.samples(spark, sf)
    n = s.count()
    return exploded(genotype.read_raw(spark, write_raw(spark, s), max_rows=n // 2, skip_rows=n // 4)[0], "row_idx", "iid")


@query(f"SELECT unnest(range({WIDTH + 6}))::INT AS place, unnest(list_concat(['FID', 'IID', 'PAT', 'MAT', 'SEX', 'PHENOTYPE'], list_transform(range({WIDTH}), lambda i: 'f' || i::VARCHAR))) AS name")
def raw_header(spark, sf):
    return spark.createDataFrame(list(enumerate(genotype.header(spark, write_raw(spark, T.samples(spark, sf))))), "place int, name string")


@query(f"WITH {NAMES} SELECT * FROM v")
def container_variants(spark, sf):
    return genotype.read_container(spark, stored(spark, T.samples(spark, sf)))[1]


@query(f"WITH {T.SAMPLES} SELECT row_idx, iid, y FROM samples")
def container_rows(spark, sf):
    return genotype.read_container(spark, stored(spark, T.samples(spark, sf)))[0].select("row_idx", "iid", "y")


@query(f"WITH {T.SAMPLES} SELECT iid, round(1 / (1 + exp(-(CASE WHEN x[1] < 0 THEN CASE WHEN x[4] < 0.05 THEN -0.3 ELSE 0.1 END ELSE 0.4 END + CASE WHEN x[4] < -0.02 THEN -0.2 ELSE 0.25 END))), 6) AS y_pred FROM samples")
def booster_written_and_read(spark, sf):
    path = scratch_path(spark, "booster")
    sinks.write_booster(spark, fixed_booster(), path)
    return rounded(boosting.predict(T.samples(spark, sf), genotype.read_booster(spark, path)).select("iid", "y_pred"), "y_pred")


_BEST = f"WITH {T.SCORES}, m AS (SELECT eta, subsample, colsample_bytree, max_depth, metric, avg(n_boost_round) AS n, avg(score) AS score FROM scores GROUP BY 1, 2, 3, 4, 5)"


@query(f"{_BEST} SELECT round(eta, 6) AS eta, max_depth, n::INT AS n_boost_round, round(score, 6) AS score FROM m ORDER BY m.score DESC, m.eta, max_depth, m.subsample, m.colsample_bytree LIMIT 1")
def search_results_read(spark, sf):
    """The best row of a folder of CSV files."""
    path = scratch_path(spark, "scores")
    sinks.write_csv(folds.mean_scores(T.scores(spark, sf)).withColumn("n_boost_round", F.rint("n_boost_round")), path)
    r = genotype.read_search_results(spark, path)
    return rounded(spark.createDataFrame([(r["eta"], r["max_depth"], r["n_boost_round"], r["score"])], "eta double, max_depth int, n_boost_round int, score double"), "eta", "score")


@query(f"WITH {T.SAMPLES} SELECT iid AS id FROM samples")
def id_list_read(spark, sf):
    path = scratch_path(spark, "ids")
    sinks.write_ids(T.samples(spark, sf), path)
    return genotype.read_ids(spark, path)


@query(f"WITH {T.SAMPLES} SELECT iid || chr(9) || iid AS line FROM samples")
def family_id_list(spark, sf):
    path = scratch_path(spark, "family")
    sinks.write_ids(T.samples(spark, sf).withColumn("fid", F.col("iid")), path, family="fid")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"WITH {T.CUSTOMERS} SELECT iid, y_true, round(y_pred, 6) AS y_pred FROM customers")
def predictions_read(spark, sf):
    path = scratch_path(spark, "predictions")
    sinks.write_csv(T.customers(spark, sf).select(F.col("iid").alias("IID"), "y_true", "y_pred"), path)
    return rounded(genotype.read_predictions(spark, path), "y_pred")


@query(f"WITH {T.VARIANTS} SELECT split_part(name, '_', 1) AS rsid FROM variants WHERE variant_idx % 3 = 0")
def selected_rsids(spark, sf):
    path, v = scratch_path(spark, "selected"), T.variants(spark, sf)
    sinks.write_selected(v, [i % 3 == 0 for i in range(v.count())], path, "important")
    return spark.read.text(f"{path}/important_rsids").select(F.col("value").alias("rsid"))


@query(_ADJUSTED + " SELECT iid, variant, round(v - b_x * z, 5) AS v, round(y - b_y * z, 5) AS y FROM z JOIN b USING (variant) WHERE row_idx < cut")
def adjusted_container(spark, sf):
    """The adjusted columns of a container as its plain ones."""
    path = stored(spark, _adjusted(spark, sf)[0].drop("c", "label"))
    return rounded(exploded(genotype.read_container(spark, path, "x_adjusted", "y_adjusted")[0], "iid", "y", digits=5), "y", digits=5)


# Subsets


@query(f"WITH {T.LONG} SELECT iid, (variant // 4)::INT AS variant, round(v, 6) AS v FROM long WHERE variant % 4 = 1 AND iid IN (SELECT doc_id::VARCHAR FROM labels)")
def subset_rows_and_columns(spark, sf):
    ids = T.table(spark, sf, "labels").select("doc_id")
    wanted = names(spark).where("variant_idx % 4 = 1").select("name")
    s, _ = R.subset_tables(T.samples(spark, sf), names(spark), ids, wanted)
    return exploded(s, "iid")


@query("SELECT c_acctbal, c_nationkey FROM customer")
def dropped_ids(spark, sf):
    return R.drop_ids(T.table(spark, sf, "customer").select(F.col("c_custkey").alias("FID"), F.col("c_custkey").alias("IID"), "c_acctbal", "c_nationkey"))


@query(f"WITH {T.LONG} SELECT iid, i.i AS i, j.i AS j, round(x[2 * i.i + 1] * x[2 * j.i + 1], 6) AS phi FROM samples, (SELECT unnest(range(3))::INT AS i) i, (SELECT unnest(range(3))::INT AS i) j")
def interaction_axes(spark, sf):
    """Places 0, 2 and 4 of both axes of an array of arrays."""
    outer = F.transform(F.slice("x", 1, 6), lambda a: F.transform(F.slice("x", 1, 6), lambda b: a * b))
    d = T.samples(spark, sf).select("iid", R.subset_interactions(outer, [4, 0, 2], 5).alias("phi"))
    d = d.select("iid", F.posexplode("phi").alias("i", "row")).select("iid", "i", F.posexplode("row").alias("j", "phi"))
    return rounded(d, "phi")


@query(f"{DOSES} SELECT iid, variant, dosage FROM long WHERE variant % 5 = 0 AND iid IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 1)")
def keep_and_extract(spark, sf):
    ids = T.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("iid"))
    wanted = spark.range(0, WIDTH, 5).select(F.col("id").cast("int").alias("variant"))
    return qc.extract_variants(qc.keep_samples(T.long(spark, sf), ids), wanted).select("iid", "variant", "dosage")


@query(_SPLIT + " SELECT CASE WHEN k <= round(0.7 * n) THEN 'train' ELSE 'test' END AS split, iid FROM r")
def split_containers(spark, sf):
    """One container for each part, read back."""
    s = T.samples(spark, sf)
    split = qc.split_ids(s.select("iid"), 0.7, "iid", 3)
    parts = [genotype.read_container(spark, stored(spark, R.subset_rows(s, split.where(F.col("split") == name).select("iid")), name))[0].select(F.lit(name).alias("split"), "iid") for name in ("train", "test")]
    return R.concatenate(*parts)


# Adjustment, folds and search


@query(f"""WITH {T.CUSTOMERS}, s AS (SELECT regr_sxx(acctbal, acctbal) AS s11, regr_sxx(nation, nation) AS s22, regr_sxy(acctbal, nation) AS s12, regr_sxy(y_true, acctbal) AS s1, regr_sxy(y_true, nation) AS s2 FROM customers),
    b AS (SELECT (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2 FROM s) SELECT iid, round(y_true - b1 * acctbal - b2 * nation, 6) AS y_adjusted FROM customers, b""")
def covariate_residuals(spark, sf):
    c = T.customers(spark, sf)
    covars = c.select(F.col("iid").alias("FID"), F.col("iid").alias("IID"), "acctbal", "nation")
    return rounded(genotype.add_adjustment(c.select("iid", F.col("y_true").alias("y")), covars).select("iid", "y_adjusted"), "y_adjusted")


_FOLDED = f"{T.LONG}, n AS (SELECT count(*) // (30 * 3) * 30 AS s FROM samples), f AS (SELECT iid, CASE WHEN s = 0 THEN 2 ELSE least(row_idx // s, 2) END AS fold FROM samples, n)"
_FOLD_STUMPS = f"""WITH {_FOLDED}, d AS (SELECT k.k AS fold, variant, dosage AS v, sum(0.5 - y) AS g, count(*) * 0.25::DOUBLE AS h FROM long JOIN f USING (iid), (SELECT unnest(range(3)) AS k) k WHERE f.fold <> k.k GROUP BY 1, 2, 3),
    c AS (SELECT fold, variant, v, sum(g) OVER w - g AS gl, sum(h) OVER w - h AS hl, sum(g) OVER (PARTITION BY fold, variant) AS g, sum(h) OVER (PARTITION BY fold, variant) AS h FROM d WINDOW w AS (PARTITION BY fold, variant ORDER BY v)),
    q AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(0.5 * (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)), 9) DESC, variant, v) AS place FROM c WHERE hl >= 1 AND h - hl >= 1),
    b AS (SELECT fold, variant, v, -0.3 * gl / (hl + 1) AS l, -0.3 * (g - gl) / (h - hl + 1) AS r FROM q WHERE place = 1),
    p AS (SELECT iid, row_idx, y, f.fold, CASE WHEN dosage < b.v THEN l ELSE r END AS m FROM long JOIN f USING (iid) JOIN b ON b.fold = f.fold AND b.variant = long.variant)"""


def _folds(spark, sf):
    return training.one_round_cv(_stump_data(spark, sf), {"eta": 0.3, "max_depth": 1, "subsample": 1.0, "colsample_bytree": 1.0}, 3, 30, 1)


@query(f"""{_FOLD_STUMPS}, k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY m) + (count(*) OVER (PARTITION BY fold, m) - 1) / 2.0 AS rk FROM p)
    SELECT fold::INT AS fold, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS score FROM k GROUP BY 1""")
def cv_scores_by_fold(spark, sf):
    scores, _ = _folds(spark, sf)
    return rounded(spark.createDataFrame([(r["fold"], r["score"]) for r in scores], "fold int, score double"), "score")


@query(f"{_FOLD_STUMPS} SELECT row_idx, fold::INT AS fold, y AS y_true, round(1 / (1 + exp(-m)), 6) AS y_pred FROM p")
def cv_out_of_fold(spark, sf):
    return rounded(_folds(spark, sf)[1].select("row_idx", F.col("fold").cast("int").alias("fold"), "y_true", "y_pred"), "y_pred")


@query(f"WITH {T.SAMPLES}, r AS (SELECT row_idx, row_number() OVER (ORDER BY md5('3|1|' || row_idx::VARCHAR), row_idx) AS k, count(*) OVER () AS n FROM samples) SELECT row_idx, k <= floor(0.7 * n) AS used FROM r")
def boruta_train_rows(spark, sf):
    s = T.samples(spark, sf).select("row_idx")
    return boruta.train_rows(s, 0.7, s.count(), "3|1").select("row_idx", F.col("_u").alias("used"))


@query("SELECT p_partkey AS part, (ntile(7) OVER (ORDER BY p_partkey) - 1)::INT AS worker FROM part")
def partition_owners(spark, sf):
    keys = sorted(r.p_partkey for r in T.table(spark, sf, "part").select("p_partkey").collect())
    owner = folds.partition_map(len(keys), [str(w) for w in range(7)])
    return spark.createDataFrame([(k, int(owner[i])) for i, k in enumerate(keys)], "part long, worker int")


# Boosting


_TWO = f"""{_STUMP}, m1 AS (SELECT iid, y, CASE WHEN dosage < b.v THEN -0.3 * gl / (hl + 1) ELSE -0.3 * (g - gl) / (h - hl + 1) END AS m FROM long JOIN b ON variant = f),
    s2 AS (SELECT variant AS f, dosage AS v, sum(1 / (1 + exp(-m)) - y) AS g, sum(1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m)))) AS h FROM (SELECT l.variant, l.dosage, m1.m, m1.y FROM long l JOIN m1 USING (iid)) GROUP BY 1, 2),
    c2 AS (SELECT f, v, sum(g) OVER (PARTITION BY f ORDER BY v) - g AS gl, sum(h) OVER (PARTITION BY f ORDER BY v) - h AS hl, sum(g) OVER (PARTITION BY f) AS g, sum(h) OVER (PARTITION BY f) AS h FROM s2),
    k2 AS (SELECT *, 0.5 * (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) AS gain FROM c2 WHERE hl >= 1 AND h - hl >= 1),
    b2 AS (SELECT * FROM k2 ORDER BY round(gain, 9) DESC, f, v LIMIT 1),
    m2 AS (SELECT iid, m1.y, m1.m, CASE WHEN dosage < b2.v THEN -0.3 * gl / (hl + 1) ELSE -0.3 * (g - gl) / (h - hl + 1) END AS more FROM long JOIN b2 ON variant = f JOIN m1 USING (iid))"""
_ONE = boosting.FitConfig(max_depth=1, eta=0.3)


@query(f"{_TWO} SELECT iid, y, round(1 / (1 + exp(-(m + more))), 6) AS y_pred FROM m2")
def boosted_fit(spark, sf):
    s = _stump_data(spark, sf)
    return rounded(boosting.predict(s, boosting.fit(s, _ONE, 2)).select("iid", "y", "y_pred"), "y_pred")


@query(f"{_TWO} SELECT iid, y, round(1 / (1 + exp(-(m + more))), 6) AS y_pred FROM m2")
def warm_start(spark, sf):
    """The second tree continues a model that has been written and read."""
    s, path = _stump_data(spark, sf), scratch_path(spark, "first")
    sinks.write_booster(spark, boosting.fit(s, _ONE, 1), path)
    return rounded(boosting.predict(s, boosting.fit(s, _ONE, 1, start=genotype.read_booster(spark, path))).select("iid", "y", "y_pred"), "y_pred")


@query(f"{_TWO}, i AS (SELECT f, gain, h FROM b UNION ALL SELECT f, gain, h FROM b2) SELECT f AS feature, count(*) AS weight, round(avg(gain), 5) AS gain, round(avg(h), 5) AS cover, round(sum(gain), 5) AS total_gain, round(sum(h), 5) AS total_cover FROM i GROUP BY 1")
def tree_importances(spark, sf):
    d = explain.importances(boosting.fit(_stump_data(spark, sf), _ONE, 2).nodes(spark))
    return rounded(d, "gain", "cover", "total_gain", "total_cover", digits=5)


@query(f"{_TWO} SELECT 2::BIGINT AS trees, count(DISTINCT f) AS features FROM (SELECT f FROM b UNION ALL SELECT f FROM b2)")
def tree_counts(spark, sf):
    return explain.tree_stats(boosting.fit(_stump_data(spark, sf), _ONE, 2).nodes(spark))


_DRAWN = _STUMP.replace("FROM long GROUP BY 1, 2", "FROM long WHERE ('0x' || substr(md5('5|0|' || (row_idx // 10)::VARCHAR), 1, 8))::BIGINT < floor(0.6 * 4294967296) GROUP BY 1, 2")


@query(f"{_DRAWN} SELECT iid, round(1 / (1 + exp(-CASE WHEN dosage < b.v THEN -0.3 * gl / (hl + 1) ELSE -0.3 * (g - gl) / (h - hl + 1) END)), 6) AS y_pred FROM long JOIN b ON variant = f")
def incremental_round(spark, sf):
    """One round on its draw of row chunks."""
    s = _stump_data(spark, sf)
    m = boosting.incremental_fit(s, boosting.FitConfig(max_depth=1, eta=0.3, subsample=0.6, seed=5), 1, 1, 10)
    return rounded(boosting.predict(s, m).select("iid", "y_pred"), "y_pred")


@query(f"""{_TWO}, e AS (SELECT 0 AS round, y, m FROM m1 UNION ALL SELECT 1, y, m + more FROM m2), q AS (SELECT round, y, m, 1 / (1 + exp(-m)) AS q FROM e),
    t AS (SELECT round, round(m, 12) AS m, sum(y) AS p, count(*) AS n FROM q GROUP BY 1, 2), u AS (SELECT round, p, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM t WINDOW w AS (PARTITION BY round ORDER BY m DESC))
    SELECT round, 'logloss' AS metric, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS value FROM q GROUP BY 1 UNION ALL SELECT round, 'rmse', round(sqrt(avg((y - q) * (y - q))), 6) FROM q GROUP BY 1
    UNION ALL SELECT round, 'aucpr', round(sum(p * tp / k) / sum(p), 6) FROM u GROUP BY 1""")
def evaluation_history(spark, sf):
    s, rows = _stump_data(spark, sf), []
    for metric in ("logloss", "rmse", "aucpr"):
        boosting.fit(s, _ONE, 2, history=rows, metric=metric)
    return rounded(spark.createDataFrame([(r["round"], r["metric"], r["value"]) for r in rows], "round int, metric string, value double"), "value")


@query(f"{_STUMP} SELECT iid, round(1 / (1 + exp(-CASE WHEN dosage < b.v THEN -0.3 * gl / (hl + 1) ELSE -0.3 * (g - gl) / (h - hl + 1) END)), 6) AS y_pred, 'f' || f::VARCHAR AS predictors FROM long JOIN b ON variant = f")
def refit_and_predict(spark, sf):
    """Two-stage refit with the rounds overridden; prediction by names, on columns in another order."""
    s = _stump_data(spark, sf)
    r = training.refit(s, names(spark), {"eta": 0.3, "max_depth": 1, "n_boost_round": 9}, 1)
    back = names(spark).withColumn("variant_idx", WIDTH - 1 - F.col("variant_idx"))
    out = training.predict(s.withColumn("x", F.reverse("x")), back, r.booster)
    return rounded(out.select("iid", "y_pred", F.lit(",".join(r.booster.features)).alias("predictors")), "y_pred")


@query(f"{_STUMP}, s1 AS (SELECT iid, CASE WHEN dosage < b.v THEN -0.3 * gl / (hl + 1) ELSE -0.3 * (g - gl) / (h - hl + 1) END AS m, hl / h * (-0.3 * gl / (hl + 1)) + (1 - hl / h) * (-0.3 * (g - gl) / (h - hl + 1)) AS base FROM long JOIN b ON variant = f) SELECT iid, round(m - base, 6) AS phi FROM s1")
def refit_contributions(spark, sf):
    """The table of contributions that refit gives, of the predictors used, without bias."""
    r = training.refit(_stump_data(spark, sf), names(spark), {"eta": 0.3, "max_depth": 1}, 1, shap=True)
    return rounded(r.shap.select("iid", F.explode("phi").alias("phi")), "phi")


_SHAP2 = f"""WITH {T.SAMPLES}, v AS (SELECT row_idx, x[1] < 0 AS a, CASE WHEN x[4] < 0.05 THEN -0.3 ELSE 0.1 END AS w, CASE WHEN x[4] < -0.02 THEN -0.2 ELSE 0.25 END - (0.3 * -0.2 + 0.7 * 0.25) AS two FROM samples),
    e AS (SELECT row_idx, two, CASE WHEN a THEN w ELSE 0.4 END AS v03, CASE WHEN a THEN -0.3 / 3 + 0.2 / 3 ELSE 0.4 END AS v0, 0.6 * w + 0.4 * 0.4 AS v3, 0.6 * (-0.3 / 3 + 0.2 / 3) + 0.4 * 0.4 AS v FROM v),
    p AS (SELECT row_idx, 0.5 * (v03 - v0 - v3 + v) AS i, 0.5 * (v0 - v + v03 - v3) AS m0, 0.5 * (v3 - v + v03 - v0) + two AS m3 FROM e)"""


@query(f"{_SHAP2} SELECT row_idx, i, j, round(phi, 6)::DOUBLE AS phi FROM (SELECT row_idx, 0 AS i, 0 AS j, m0 - i AS phi FROM p UNION ALL SELECT row_idx, 0, 3, i FROM p UNION ALL SELECT row_idx, 3, 0, i FROM p UNION ALL SELECT row_idx, 3, 3, m3 - i FROM p) WHERE abs(phi) > 1e-9")
def shap_interactions(spark, sf):
    d = explain.shap_interactions(T.samples(spark, sf).select("row_idx", "x"), fixed_booster())
    return rounded(d.where("abs(phi) > 1e-9"), "phi")


# Scores and calibration


@query(f"""WITH {T.CUSTOMERS}, b AS (SELECT regr_intercept(y_pred, acctbal) AS a, regr_slope(y_pred, acctbal) AS b FROM customers), f AS (SELECT y_true, y_pred, a + b * acctbal AS fitted, y_pred - a - b * acctbal AS res FROM customers, b),
    r AS (SELECT *, rank() OVER (ORDER BY res) + (count(*) OVER (PARTITION BY res) - 1) / 2.0 AS r, rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2.0 AS r0 FROM f), k AS (SELECT sum(y_true) AS p, count(*) - sum(y_true) AS q FROM customers)
    SELECT round((sum(CASE WHEN y_true = 1 THEN r0 END) - any_value(p * (p + 1) / 2)) / any_value(p * q), 6) AS auc, round((sum(CASE WHEN y_true = 1 THEN r END) - any_value(p * (p + 1) / 2)) / any_value(p * q), 6) AS ols_auc FROM r, k""")
def scoring_run(spark, sf):
    c = T.customers(spark, sf)
    found, _ = training.score_predictions(c.select("iid", "y_true", "y_pred"), c.select("iid", "acctbal"), ["acctbal"], "ols")
    return rounded(spark.createDataFrame([(found["auc"], found["ols_auc"])], "auc double, ols_auc double"), "auc", "ols_auc")


@query(f"""WITH {T.ITEMS}, r AS (SELECT *, rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2.0 AS r FROM items), a AS (SELECT (sum(CASE WHEN y_true = 1 THEN r END) - sum(y_true) * (sum(y_true) + 1) / 2) / (sum(y_true) * (count(*) - sum(y_true))) AS a FROM r)
    SELECT round(a, 6) AS auc, round(1 - a, 6) AS platt_auc FROM a""")
def prediction_scores(spark, sf):
    """AUC of test predictions, and of the calibrated ones; a falling curve turns it round."""
    found = training.score_test(T.items(spark, sf).withColumnRenamed("y_true", "y"), curve=(0.5, -3.0))
    return rounded(spark.createDataFrame([(found["auc"], found["platt_auc"])], "auc double, platt_auc double"), "auc", "platt_auc")


class Doubled:
    """An estimator with a decision function."""

    def decision_function(self, m):
        return 2 * m[:, 0] + 1


@query(f"WITH {T.CUSTOMERS} SELECT iid, round(2 * acctbal + 1, 4) AS decided, round(1 / (1 + exp(-(0.5 - 0.001 * acctbal))), 6) AS curved FROM customers")
def estimator_dispatch(spark, sf):
    d = training.yhat(training.yhat(T.customers(spark, sf), Doubled(), "acctbal", "decided"), (0.5, -0.001), "acctbal", "curved")
    return rounded(rounded(d.select("iid", "decided", "curved"), "decided", digits=4), "curved")


# Boruta


_BINOM = "c AS (SELECT range AS k, (SELECT coalesce(product(10 - g + 1), 1) / coalesce(product(g), 1) FROM (SELECT unnest(range(1, r.range + 1)) AS g)) AS ways FROM range(11) r)"


@query(f"""WITH {_BINOM}, s AS (SELECT p_partkey AS feature, (CASE WHEN p_partkey % 50 = 0 THEN 10 WHEN p_partkey % 50 = 1 THEN 0 ELSE p_partkey % 11 END)::INT AS hits, (CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END)::INT AS decision FROM part),
    t AS (SELECT *, (SELECT sum(ways) FROM c WHERE k >= hits) / 1024 AS a, (SELECT sum(ways) FROM c WHERE k <= hits) / 1024 AS r FROM s),
    u AS (SELECT *, row_number() OVER (ORDER BY a, feature) AS ia, row_number() OVER (ORDER BY r, feature) AS ir, count(*) OVER () AS m FROM t),
    w AS (SELECT *, ia <= coalesce(max(CASE WHEN a <= ia / m::DOUBLE * 0.05 THEN ia END) OVER (), 0) AND a <= 0.05 / 10 AS accept, ir <= coalesce(max(CASE WHEN r <= ir / m::DOUBLE * 0.05 THEN ir END) OVER (), 0) AND r <= 0.05 / 10 AS reject FROM u)
    SELECT feature, (CASE WHEN decision = 0 AND accept THEN 1 WHEN decision = 0 AND reject THEN -1 ELSE decision END)::INT AS decided FROM w""")
def two_step_decisions(spark, sf):
    k = F.col("p_partkey")
    hits = F.when(k % 50 == 0, 10).when(k % 50 == 1, 0).otherwise(k % 11).cast("int")
    s = T.table(spark, sf, "part").select(k.alias("feature"), F.when(k % 13 == 0, 1).otherwise(0).alias("decision"), hits.alias("hits"))
    return boruta.tests(s, 10).select("feature", "decided")


@query("SELECT n_nationkey AS features, (n_nationkey * CASE WHEN n_nationkey >= 5 THEN 1 WHEN n_nationkey >= 3 THEN 2 WHEN n_nationkey = 2 THEN 4 ELSE 8 END)::BIGINT AS shadows FROM nation WHERE n_nationkey > 0")
def shadow_doubling(spark, sf):
    n = [r.n_nationkey for r in T.table(spark, sf, "nation").where("n_nationkey > 0").collect()]
    return spark.createDataFrame([(k, k * boruta.shadow_copies(k)) for k in n], "features long, shadows long")


@query(f"""WITH {_IMP}, rest AS (SELECT * FROM imp WHERE feature % 7 NOT IN (1, 2)), k AS (SELECT feature, iteration, CASE WHEN imp IS NOT NULL THEN rank() OVER (PARTITION BY iteration, imp IS NULL ORDER BY imp DESC) + (count(*) OVER (PARTITION BY iteration, imp) - 1) / 2.0 END AS r FROM rest),
    m AS (SELECT feature, coalesce(median(r)::DOUBLE, 'inf'::DOUBLE) AS r FROM k GROUP BY 1), q AS (SELECT feature, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS r FROM m)
    SELECT feature, floor(r - min(r) OVER () + 3)::INT AS ranking FROM q UNION ALL SELECT DISTINCT feature, CASE feature % 7 WHEN 1 THEN 1 ELSE 2 END FROM imp WHERE feature % 7 IN (1, 2)""")
def boruta_final_ranks(spark, sf):
    rows = _imp(spark, sf).collect()
    history = np.full((5, WIDTH), np.nan)
    for r in rows:
        history[r.iteration, r.feature] = np.nan if r.imp is None else r.imp
    j = np.arange(WIDTH)
    return spark.createDataFrame([(int(i), int(k)) for i, k in enumerate(boruta.final_ranks(history, j % 7 == 1, j % 7 == 2))], "feature int, ranking int")


# Whole runs, streams and command lines


@query(f"""{DOSES}, keep AS (SELECT variant FROM long GROUP BY 1 HAVING least(avg(dosage) / 2, 1 - avg(dosage) / 2) >= 0.495), s AS (SELECT iid, row_number() OVER (ORDER BY md5('3|' || iid), iid) AS k, count(*) OVER () AS n FROM samples),
    p AS (SELECT iid, CASE WHEN k <= round(0.7 * n) THEN 'train' ELSE 'test' END AS split, k FROM s) SELECT split, iid, row_number() OVER (PARTITION BY split ORDER BY k) - 1 AS row_idx, (SELECT count(*) FROM keep) AS width FROM p""")
def preprocessed(spark, sf):
    train, test, _ = preprocess.preprocess(_stump_data(spark, sf), names(spark), maf=0.495, share=0.7, seed=3)
    return R.concatenate(*[d.select(F.lit(n).alias("split"), "iid", "row_idx", F.size("x").cast("long").alias("width")) for n, d in (("train", train), ("test", test))])


@query(f"WITH {T.SAMPLES} SELECT iid, round(1 / (1 + exp(-(CASE WHEN x[1] < 0 THEN CASE WHEN x[4] < 0.05 THEN -0.3 ELSE 0.1 END ELSE 0.4 END + CASE WHEN x[4] < -0.02 THEN -0.2 ELSE 0.25 END))), 6) AS y_pred FROM samples")
def stream_scored(spark, sf):
    from lodemill.streaming.scoring import score_stream

    root = scratch_path(spark, "stream")
    T.samples(spark, sf).select("row_idx", "iid", "x").write.parquet(f"{root}/in")
    score_stream(spark, f"{root}/in", fixed_booster(), f"{root}/out", f"{root}/state").awaitTermination()
    return rounded(spark.read.parquet(f"{root}/out").select("iid", "y_pred"), "y_pred")


def _cli(spark, *words):
    from lodemill import cli

    a = cli.parser().parse_args(list(words))
    a.run(spark, a)


@query(f"WITH {T.LONG} SELECT row_idx, iid, y, variant, round(v, 6) AS v FROM long")
def cli_ingest(spark, sf):
    out = scratch_path(spark, "ingested")
    _cli(spark, "ingest", "--in_raw", write_raw(spark, T.samples(spark, sf)), "--out", out)
    return exploded(genotype.read_container(spark, out)[0], "row_idx", "iid", "y")


@query(f"WITH {T.LONG} SELECT iid, (variant // 4)::INT AS variant, round(v, 6) AS v FROM long WHERE variant % 4 = 1 AND iid IN (SELECT doc_id::VARCHAR FROM labels)")
def cli_subset(spark, sf):
    root = scratch_path(spark, "lists")
    sinks.write_ids(T.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("iid")), f"{root}/ids")
    sinks.write_ids(names(spark).where("variant_idx % 4 = 1"), f"{root}/names", key="name")
    _cli(spark, "subset", "--in_path", stored(spark, T.samples(spark, sf)), "--out_path", f"{root}/out", "--ids", f"{root}/ids", "--snps", f"{root}/names")
    return exploded(genotype.read_container(spark, f"{root}/out")[0], "iid")


def _covariate_text(spark, rows, path):
    """FID, IID and covariates of rows (iid, covariates) as a text with a header."""
    lines = rows.select(F.concat_ws("\t", "iid", *[F.col(c).cast("string") for c in rows.columns]).alias("value"))
    head = "\t".join(["FID", "IID", *rows.columns[1:]])
    first = F.col("value") != head
    spark.createDataFrame([(head,)], "value string").unionAll(lines).repartitionByRange(1, first).sortWithinPartitions(first).write.text(path)
    return path


@query(_ADJUSTED + " SELECT iid, variant, round(v - b_x * z, 5) AS v, round(y - b_y * z, 5) AS y FROM z JOIN b USING (variant) WHERE row_idx >= cut")
def cli_adjust(spark, sf):
    """The adjusted test set."""
    s, root = T.samples(spark, sf), scratch_path(spark, "cli")
    cut = s.count() * 3 // 5
    covar = _covariate_text(spark, s.select("iid", F.col("row_idx").alias("C1")), f"{root}/covar")
    _cli(spark, "adjust", "--train", stored(spark, s.where(f"row_idx < {cut}"), "train"), "--test", stored(spark, s.where(f"row_idx >= {cut}"), "test"), "--covar", covar, "--out_train", f"{root}/train", "--out_test", f"{root}/test")
    return rounded(exploded(genotype.read_container(spark, f"{root}/test", "x_adjusted", "y_adjusted")[0], "iid", "y", digits=5), "y", digits=5)


@query(f"WITH {T.SAMPLES} SELECT iid, y AS y_true, round(1 / (1 + exp(-(CASE WHEN x[1] < 0 THEN CASE WHEN x[4] < 0.05 THEN -0.3 ELSE 0.1 END ELSE 0.4 END + CASE WHEN x[4] < -0.02 THEN -0.2 ELSE 0.25 END))), 6) AS y_pred FROM samples")
def cli_predict(spark, sf):
    root = scratch_path(spark, "cli")
    sinks.write_booster(spark, fixed_booster(), f"{root}/model")
    _cli(spark, "predict", "--data", stored(spark, T.samples(spark, sf)), "--model", f"{root}/model", "--out", f"{root}/out")
    d = spark.read.csv(f"{root}/out", header=True).select("iid", F.col("y_true").cast("double").alias("y_true"), F.col("y_pred").cast("double").alias("y_pred"))
    return rounded(d, "y_pred")


@query(f"WITH {T.CUSTOMERS}, b AS (SELECT regr_intercept(y_pred, acctbal) AS a, regr_slope(y_pred, acctbal) AS b FROM customers) SELECT iid, round(y_pred - a - b * acctbal, 1) AS adjusted FROM customers, b")
def cli_score(spark, sf):
    c, root = T.customers(spark, sf), scratch_path(spark, "cli")
    sinks.write_csv(c.select(F.col("iid").alias("IID"), "y_true", "y_pred"), f"{root}/predictions")
    _cli(spark, "score", "--predictions", f"{root}/predictions", "--covars", _covariate_text(spark, c.select("iid", F.col("acctbal").alias("C1")), f"{root}/covar"), "--out", f"{root}/out", "--model", "ols")
    return rounded(spark.read.csv(f"{root}/out", header=True).select("iid", F.col("OLS_adjusted_y_pred").cast("double").alias("adjusted")), "adjusted", digits=1)


@query(f"{_STUMP} SELECT 'f' || f::VARCHAR AS predictors, round(gain, 5) AS gain, 1::BIGINT AS weight FROM b")
def cli_refit(spark, sf):
    """The importances that refit writes."""
    root = scratch_path(spark, "cli")
    best = spark.createDataFrame([(0.3, 1.0, 1.0, 1, "AUC", 1, 0.5)], "eta double, subsample double, colsample_bytree double, max_depth int, metric string, n_boost_round int, score double")
    sinks.write_csv(best, f"{root}/hp")
    _cli(spark, "refit", "--data", stored(spark, _stump_data(spark, sf)), "--hp", f"{root}/hp", "--out_dir", root, "--n_boost_round", "1")
    return rounded(spark.read.csv(f"{root}/importances.csv", header=True).select("predictors", F.col("gain").cast("double").alias("gain"), F.col("weight").cast("long").alias("weight")), "gain", digits=5)


@query(f"WITH {T.SAMPLES} SELECT count(*) AS rows, count(DISTINCT iid) AS iids, 1::BIGINT AS sets, 3::BIGINT AS folds FROM samples")
def cli_cv(spark, sf):
    """Every row has one out-of-fold prediction; the seed fixes the parameters."""
    root = scratch_path(spark, "cli")
    _cli(spark, "cv", "--data", stored(spark, _stump_data(spark, sf)), "--out_dir", root, "--out_prefix", "a", "--n_iter", "1", "--n_fold", "3", "--row_chunks", "30", "--n_boost_round", "1", "--seed", "1")
    d = spark.read.csv(f"{root}/cv/y_pred/a_best_cv_ypred.csv", header=True)
    sets = spark.read.csv(f"{root}/cv/hp_search/a_cv_scores.csv", header=True).count()
    return d.agg(F.count("*").alias("rows"), F.countDistinct("iid").alias("iids"), F.lit(sets).cast("long").alias("sets"), F.countDistinct("fold").alias("folds"))

