"""Deterministic instances of the operators on the driver's tables, each with its SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodemill.functions import columns as C
from lodemill.operators import boosting, boruta, explain, folds, linear, metrics, qc
from lodemill.operators import relational as R
from lodemill.plans import tables as T
from lodemill.sources import genotype, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Elements of x.
WIDTH = 64


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# Scans and sinks


@query(f"WITH {T.SAMPLES} SELECT iid AS fid, iid, '0' AS pat, '0' AS mat, 1.0::DOUBLE AS sex, y + 1 AS phenotype, unnest(range(len(x) + 1))::INT AS variant, round(unnest(list_append(x, NULL)), 6) AS v FROM samples")
def src_parse_raw(spark, sf):
    s = T.samples(spark, sf)
    d = s.select(raw_line(F.lit("NA")).alias("value")).select(*genotype.parse_raw(F.col("value")))
    return rounded(d.select("fid", "iid", "pat", "mat", "sex", "phenotype", F.posexplode("x").alias("variant", "v")), "v")


def raw_line(*more):
    """A line of dosages of a sample, with further fields."""
    return F.concat_ws(" ", "iid", "iid", F.lit("0"), F.lit("0"), F.lit("1"), (F.col("y") + 1).cast("string"), F.array_join(F.col("x").cast("array<string>"), " "), *more)


@query(f"WITH {T.SAMPLES}, l AS (SELECT iid, y + 1 AS phenotype FROM samples) SELECT iid, CASE WHEN (SELECT max(phenotype) FROM l) = 2 THEN phenotype - 1 ELSE phenotype END AS y FROM l")
def label_recode(spark, sf):
    return genotype.recode_labels(T.samples(spark, sf).select("iid", (F.col("y") + 1).alias("phenotype"))).select("iid", "y")


@query(f"WITH {T.SAMPLES} SELECT count(*) AS n_rows, min(len(x))::BIGINT AS width, max(len(x))::BIGINT AS most FROM samples")
def shape_check(spark, sf):
    s = T.samples(spark, sf)
    width = s.agg(F.max(F.size("x"))).first()[0]
    n, p = R.check_samples(s, spark.range(width))
    return spark.createDataFrame([(n, p, p)], "n_rows long, width long, most long")


@query(f"WITH {T.LONG} SELECT iid, y, variant, round(v, 6) AS v FROM long")
def container_read_back(spark, sf):
    from lodemill.sources.scratch import scratch_path

    path = scratch_path(spark, "container")
    s = T.samples(spark, sf)
    width = s.agg(F.max(F.size("x"))).first()[0]
    sinks.write_container(s, spark.range(width).select(F.col("id").cast("int").alias("variant_idx"), F.concat(F.lit("rs"), "id", F.lit("_A")).alias("name")), path)
    return rounded(genotype.read_container(spark, path)[0].select("iid", "y", F.posexplode("x").alias("variant", "v")), "v")


@query("SELECT c_custkey::VARCHAR AS fid, c_custkey::VARCHAR AS iid, round(c_acctbal, 2) AS cov1, c_nationkey::DOUBLE AS cov2 FROM customer")
def covariate_text(spark, sf):
    from lodemill.sources.scratch import scratch_path

    path = scratch_path(spark, "covars")
    c = T.table(spark, sf, "customer")
    rows = c.select(F.concat_ws("\t", "c_custkey", "c_custkey", F.round("c_acctbal", 2).cast("decimal(18,2)"), "c_nationkey").alias("value"))
    spark.createDataFrame([("FID\tIID\tCOV1\tCOV2",)], "value string").unionAll(rows).repartitionByRange(1, F.col("value") != "FID\tIID\tCOV1\tCOV2").sortWithinPartitions(F.col("value") != "FID\tIID\tCOV1\tCOV2").write.text(path)
    d = genotype.read_covariates(spark, path)
    return d.select(F.col("FID").alias("fid"), F.col("IID").alias("iid"), F.round("COV1", 2).alias("cov1"), F.col("COV2").alias("cov2"))


@query(f"WITH {T.CUSTOMERS} SELECT iid, y_true, round(y_pred, 6) AS y_pred, round(1 / (1 + exp(-(0.5 - 0.00001 * y_pred))), 9) AS y_pred_platt_scaled FROM customers")
def platt_apply(spark, sf):
    return rounded(rounded(sinks.predictions(T.customers(spark, sf), "y_true", platt=(0.5, -0.00001)), "y_pred"), "y_pred_platt_scaled", digits=9)


@query(f"WITH {T.CUSTOMERS} SELECT iid, y_true, round(y_pred, 6) AS y_pred, NULL::DOUBLE AS y_pred_platt_scaled FROM customers")
def predictions_table(spark, sf):
    return rounded(sinks.predictions(T.customers(spark, sf), "y_true"), "y_pred")


# Rows and columns


@query(f"WITH {T.SAMPLES} SELECT row_idx, iid FROM samples WHERE iid IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 1)")
def subset_rows(spark, sf):
    ids = T.table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return R.subset_rows(T.samples(spark, sf), ids).select("row_idx", "iid")


@query(f"WITH {T.SAMPLES} SELECT row_idx, iid FROM samples WHERE iid NOT IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 1)")
def exclude_rows(spark, sf):
    ids = T.table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return R.exclude_rows(T.samples(spark, sf), ids).select("row_idx", "iid")


@query(f"WITH {T.VARIANTS} SELECT variant_idx, name, split_part(name, '_', 1) AS rsid FROM variants WHERE split_part(name, '_', 1) IN ('rs3', 'rs10', 'rs20', 'rs9999')")
def subset_cols_rsid(spark, sf):
    v = T.variants(spark, sf)
    at = R.variant_places(v, spark.createDataFrame([("rs3",), ("rs10",), ("rs20",), ("rs9999",)], "id string"), True)
    return v.where(F.col("variant_idx").isin(at)).select("variant_idx", "name", C.rsid(F.col("name")).alias("rsid"))


@query(f"WITH {T.SAMPLES} SELECT iid, round(x[2], 6) AS a, round(x[5], 6) AS b, round(x[12], 6) AS c FROM samples")
def subset_predictors(spark, sf):
    names = spark.createDataFrame([(i, f"f{i}") for i in range(64)], "variant_idx int, name string")
    s, _ = R.subset_columns(T.samples(spark, sf), names, spark.createDataFrame([("f11",), ("f1",), ("f4",)], "name string"), by_rsid=False)
    return s.select("iid", *[F.round(F.get("x", F.lit(i)), 6).alias(n) for i, n in enumerate("abc")])


@query(f"WITH {T.LONG} SELECT iid, (CASE WHEN variant = 63 THEN 32 ELSE variant // 2 END)::INT AS place, round(v, 6) AS phi FROM long WHERE variant % 2 = 0 OR variant = 63")
def subset_contributions(spark, sf):
    s = T.samples(spark, sf).withColumn("phi", R.subset_contributions(F.col("x"), list(range(0, 63, 2)), 63, drop_bias=False))
    return rounded(s.select("iid", F.posexplode("phi").alias("place", "phi")), "phi")


@query(f"WITH {T.SAMPLES} SELECT row_idx, iid FROM samples WHERE row_idx < 100")
def head_n(spark, sf):
    return R.head_rows(T.samples(spark, sf), 100).select("row_idx", "iid")


@query("SELECT o_orderkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def align_covars(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("iid"))
    return R.align_covariates(o, T.table(spark, sf, "customer").select(F.col("c_custkey").alias("iid"), "c_acctbal")).select("o_orderkey", "c_acctbal")


@query(f"WITH {T.CUSTOMERS} SELECT iid, y_true, n_name FROM customers JOIN nation ON nation = n_nationkey")
def join_pred_covars(spark, sf):
    n = T.table(spark, sf, "nation").select(F.col("n_nationkey").cast("double").alias("nation"), "n_name")
    return R.join_covariates(T.customers(spark, sf), n, "nation").select("iid", "y_true", "n_name")


@query(f"WITH {T.SCORES} SELECT max_depth, fold, round(score, 6) AS score FROM scores WHERE abs(eta - 0.003) <= 1e-8 + 1e-5 * 0.003 AND abs(subsample - 0.6) <= 1e-8 + 1e-5 * 0.6 AND abs(colsample_bytree - 0.75) <= 1e-8 + 1e-5 * 0.75 AND max_depth = 4")
def isclose_match(spark, sf):
    best = spark.createDataFrame([(0.003000000001, 0.6, 0.75, 4)], "eta double, subsample double, colsample_bytree double, max_depth int")
    return rounded(R.params_match(T.scores(spark, sf), best).select("max_depth", "fold", "score"), "score")


@query(f"WITH {T.SCORES} SELECT fold, round(score, 6) AS score FROM scores WHERE fold = 0 UNION ALL SELECT fold, round(score, 6) FROM scores WHERE fold > 2")
def union_cv(spark, sf):
    s = rounded(T.scores(spark, sf).select("fold", "score"), "score")
    return R.concatenate(s.where("fold = 0"), s.where("fold > 2"))


@query("SELECT range AS feature FROM range(64) WHERE range NOT IN (SELECT label FROM embeddings)")
def setdiff_features(spark, sf):
    return R.features_left(64, T.table(spark, sf, "embeddings").select(F.col("label").alias("feature")))


@query("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL")
def missing_label_filter(spark, sf):
    return R.labelled(T.table(spark, sf, "labels"), "quality").select("doc_id", "quality")


@query("SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS iids, count(DISTINCT c_custkey) AS fids FROM customer")
def covariate_check(spark, sf):
    n = R.check_covariates(T.table(spark, sf, "customer").select(F.col("c_custkey").alias("fid"), F.col("c_custkey").alias("iid"), "c_acctbal"))
    return spark.createDataFrame([(n["rows"], n["iids"], n["fids"])], "n_rows long, iids long, fids long")


# Quality control


@query(f"WITH {T.LONG} SELECT variant, round(avg(dosage) / 2, 9) AS af, round(least(avg(dosage) / 2, 1 - avg(dosage) / 2), 9) AS maf, 0.0::DOUBLE AS missing FROM long GROUP BY 1 HAVING least(avg(dosage) / 2, 1 - avg(dosage) / 2) >= 0.495")
def maf_filter(spark, sf):
    d = T.long(spark, sf)
    return rounded(qc.allele_frequencies(qc.filter_maf(d, 0.495)), "af", "maf", digits=9)


@query(f"WITH {T.LONG} SELECT variant AS variant_idx, round(avg(dosage) / 2, 9) AS af, round(least(avg(dosage) / 2, 1 - avg(dosage) / 2), 9) AS maf, 0.0::DOUBLE AS missing FROM long GROUP BY 1")
def array_frequencies(spark, sf):
    s = T.samples(spark, sf).withColumn("x", F.transform("x", lambda v: qc.dosage_of(v, 0.085)))
    return rounded(qc.array_frequencies(s), "af", "maf", digits=9)


@query("SELECT l_suppkey AS variant, round(avg((l_quantity > 40)::INT), 9) AS missing FROM lineitem GROUP BY 1")
def variant_missingness(spark, sf):
    d = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("variant"), F.when(F.col("l_quantity") <= 40, 1.0).alias("dosage"))
    return rounded(qc.allele_frequencies(d).select("variant", "missing"), "missing", digits=9)


@query(f"WITH {T.LONG} SELECT iid, variant, dosage FROM long WHERE iid NOT IN (SELECT doc_id::VARCHAR FROM labels)")
def sample_removal(spark, sf):
    ids = T.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("iid"))
    return qc.filter_maf(T.long(spark, sf), 0.0, ids).select("iid", "variant", "dosage")



@query(f"WITH {T.LONG} SELECT iid, variant, CASE WHEN variant % 2 = 0 THEN dosage ELSE 2 - dosage END AS dosage FROM long")
def allele_recode(spark, sf):
    d = T.long(spark, sf)
    return d.select("iid", "variant", qc.recode_dosage(F.col("dosage"), F.when(F.col("variant") % 2 == 0, "A").otherwise("G"), F.lit("A")).alias("dosage"))



_LD = f"""WITH {T.LONG}, {T.VARIANTS},
    near AS (SELECT u.chr, u.pos AS a, v.pos AS b, u.variant AS va, v.variant AS vb FROM variants u JOIN variants v ON u.chr = v.chr AND u.pos < v.pos AND v.pos - u.pos <= 1000),
    r AS (SELECT chr, a, b, pow(corr(s.dosage, t.dosage), 2) AS r2 FROM near JOIN long s ON s.variant = va JOIN long t ON t.variant = vb AND t.iid = s.iid GROUP BY 1, 2, 3)"""


def _ld(spark, sf):
    v = T.variants(spark, sf)
    near = v.select(F.col("pos").alias("variant"), "chr", "pos", F.col("variant").alias("column"))
    return qc.ld_pairs(near, T.long(spark, sf).select("variant", "iid", "dosage"), 1.0)


@query(_LD + " SELECT chr, a, b, round(r2, 6) AS r2 FROM r WHERE r2 IS NOT NULL")
def ld_r2_window(spark, sf):
    return rounded(_ld(spark, sf).where("r2 is not null"), "r2")


_CLUMPS = _LD.replace("WITH ", "WITH RECURSIVE ", 1) + """, strong AS (SELECT chr, a, b FROM r WHERE r2 >= 0.75), ties AS (SELECT chr, a AS v, list(b) AS near FROM (SELECT * FROM strong UNION ALL SELECT chr, b, a FROM strong) GROUP BY 1, 2),
    o AS (SELECT chr, pos AS v, row_number() OVER (PARTITION BY chr ORDER BY p, pos) AS k FROM variants),
    g(chr, k, taken, own, v) AS (SELECT DISTINCT chr, 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT FROM variants
        UNION ALL SELECT o.chr, o.k, list_concat(g.taken, n.own), n.own, o.v FROM g JOIN o ON o.chr = g.chr AND o.k = g.k + 1 LEFT JOIN ties t ON t.chr = o.chr AND t.v = o.v,
            LATERAL (SELECT CASE WHEN list_contains(g.taken, o.v) THEN []::BIGINT[] ELSE list_prepend(o.v, list_filter(coalesce(t.near, []), lambda u: NOT list_contains(g.taken, u))) END AS own) n),
    c AS (SELECT chr, v AS index_variant, unnest(own) AS variant FROM g)"""


def _clumps(spark, sf):
    v = T.variants(spark, sf).select(F.col("pos").alias("variant"), "chr", "p")
    return qc.clump(v, _ld(spark, sf), r2=0.75)


@query(_CLUMPS + " SELECT chr, index_variant, variant FROM c")
def clump_greedy(spark, sf):
    return _clumps(spark, sf)


@query(_CLUMPS + " SELECT DISTINCT index_variant FROM c")
def clump_index_list(spark, sf):
    return qc.index_variants(_clumps(spark, sf))


@query(f"WITH {T.SAMPLES} SELECT iid, row_number() OVER (ORDER BY md5('7|' || iid)) - 1 AS place FROM samples")
def shuffle_row_idx(spark, sf):
    s = T.samples(spark, sf).select("iid")
    return C.with_row_index(s.withColumn("k", qc.shuffled_order(s, "iid", 7)), "k", name="place").select("iid", "place")


_SPLIT = f"WITH {T.SAMPLES}, r AS (SELECT iid, row_number() OVER (ORDER BY md5('3|' || iid), iid) AS k, count(*) OVER () AS n FROM samples)"


@query(_SPLIT + " SELECT iid FROM r WHERE k <= round(0.7 * n)")
def split_ids_train(spark, sf):
    return qc.split_ids(T.samples(spark, sf).select("iid"), 0.7, "iid", 3).where("split = 'train'").select("iid")


@query(_SPLIT + " SELECT iid FROM r WHERE k > round(0.7 * n)")
def split_ids_test(spark, sf):
    return qc.split_ids(T.samples(spark, sf).select("iid"), 0.7, "iid", 3).where("split = 'test'").select("iid")


@query("SELECT count(*) AS n FROM embeddings")
def raw_row_count(spark, sf):
    return spark.createDataFrame([(genotype.count_raw_rows(spark, write_raw(spark, T.samples(spark, sf))),)], "n long")


def write_raw(spark, samples, files=4):
    """Path of a text of dosages of the samples, its header first, in several files."""
    from lodemill.sources.scratch import scratch_path

    path = scratch_path(spark, "raw")
    names = " ".join(["FID", "IID", "PAT", "MAT", "SEX", "PHENOTYPE", *(f"f{i}" for i in range(WIDTH))])
    rows = spark.createDataFrame([(-1, names)], "k long, value string").unionAll(samples.select(F.col("row_idx").alias("k"), raw_line()))
    rows.repartitionByRange(files, "k").sortWithinPartitions("k").select("value").write.text(path)
    return path


# Regression


@query(f"WITH {T.CUSTOMERS} SELECT iid, round((acctbal - (SELECT avg(acctbal) FROM customers)) / (SELECT stddev_pop(acctbal) FROM customers), 6) AS acctbal FROM customers")
def zscore_pop(spark, sf):
    d = T.customers(spark, sf)
    return rounded(linear.zscore(d, linear.zscore_stats(d, ["acctbal"])).select("iid", "acctbal"), "acctbal")


@query(f"WITH {T.CUSTOMERS}, s AS (SELECT avg(acctbal) AS m, stddev_pop(acctbal) AS d FROM customers WHERE nation < 12) SELECT iid, round((acctbal - m) / d, 6) AS acctbal FROM customers, s WHERE nation >= 12")
def zscore_train_apply_test(spark, sf):
    d = T.customers(spark, sf)
    return rounded(linear.zscore(d.where("nation >= 12"), linear.zscore_stats(d.where("nation < 12"), ["acctbal"])).select("iid", "acctbal"), "acctbal")


@query(f"WITH {T.LONG} SELECT variant, round(regr_slope(v, row_idx), 9) AS beta FROM long GROUP BY 1")
def beta_k1(spark, sf):
    return rounded(linear.slopes_one(T.long(spark, sf), "v", "row_idx", "variant"), "beta", digits=9)


_BETA2 = f"""WITH {T.LONG}, c AS (SELECT *, row_idx::DOUBLE AS c1, y AS c2 FROM long),
    s AS (SELECT variant, regr_sxx(c1, c1) AS s11, regr_sxx(c2, c2) AS s22, regr_sxy(c1, c2) AS s12, regr_sxy(v, c1) AS s1, regr_sxy(v, c2) AS s2 FROM c GROUP BY 1),
    b AS (SELECT variant, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2 FROM s)"""


def _beta2(spark, sf):
    s = T.samples(spark, sf).withColumn("c1", F.col("row_idx").cast("double")).withColumn("c2", F.col("y"))
    return s, linear.slopes(s, ["c1", "c2"])


@query(_BETA2 + " SELECT variant, round(b1, 8) AS b1, round(b2, 6) AS b2 FROM b")
def beta_k2(spark, sf):
    _, b = _beta2(spark, sf)
    return spark.createDataFrame([(i, round(float(b[0, i]), 8), round(float(b[1, i]), 6)) for i in range(b.shape[1])], "variant int, b1 double, b2 double")


@query(_BETA2 + " SELECT iid, variant, round(v - b1 * c1 - b2 * c2, 5) + 0.0 AS r FROM c JOIN b USING (variant)")
def residual_x(spark, sf):
    s, b = _beta2(spark, sf)
    d = linear.residual_matrix(s, ["c1", "c2"], b)
    return rounded(d.select("iid", F.posexplode("x_adjusted").alias("variant", "r")), "r", digits=5).withColumn("r", F.col("r") + 0.0)  # no -0.0



@query(f"WITH {T.CUSTOMERS}, b AS (SELECT regr_slope(y_true, acctbal) AS b FROM customers) SELECT iid, round(y_true - b * acctbal, 6) AS y_adjusted FROM customers, b")
def residual_y(spark, sf):
    d = T.customers(spark, sf)
    b = linear.y_slopes(d, ["acctbal"], "y_true", "linear")
    return rounded(d.select("iid", linear.residual_expr(F.col("y_true"), [F.col("acctbal")], list(b)).alias("y_adjusted")), "y_adjusted")


_ADJUSTED = f"""WITH {T.LONG}, k AS (SELECT count(*) * 3 // 5 AS cut FROM samples), t AS (SELECT avg(row_idx) AS m, stddev_pop(row_idx) AS s FROM samples, k WHERE row_idx < cut),
    z AS (SELECT row_idx, iid, y, variant, v, (row_idx - m) / s AS z, cut FROM long, t, k), b AS (SELECT variant, regr_slope(v, z) AS b_x, regr_slope(y, z) AS b_y FROM z WHERE row_idx < cut GROUP BY 1)"""


def _adjusted(spark, sf):
    """The first 60 % of the rows train."""
    s = T.samples(spark, sf).withColumn("c", F.col("row_idx").cast("double"))
    cut = s.count() * 3 // 5
    return linear.adjust(s.where(f"row_idx < {cut}"), s.where(f"row_idx >= {cut}"), ["c"])


@query(_ADJUSTED + " SELECT iid, variant, round(v - b_x * z, 5) AS x_adjusted, round(y - b_y * z, 5) AS y_adjusted FROM z JOIN b USING (variant)")
def adjust_train_test(spark, sf):
    a, b = _adjusted(spark, sf)
    return rounded(a.unionByName(b).select("iid", F.posexplode("x_adjusted").alias("variant", "x_adjusted"), "y_adjusted"), "x_adjusted", "y_adjusted", digits=5)


@query(f"""WITH {T.LONG}, d AS (SELECT variant, y, (dosage > 1)::INT AS e FROM long),
    n AS (SELECT variant, sum(e * y) AS a, sum(e * (1 - y)) AS b, sum((1 - e) * y) AS c, sum((1 - e) * (1 - y)) AS d FROM d GROUP BY 1) SELECT variant, round(a * d / (b * c), 5) AS odds_ratio FROM n""")
def odds_ratio_2x2(spark, sf):
    d = T.long(spark, sf).withColumn("dosage", (F.col("dosage") > 1).cast("double"))
    return rounded(linear.odds_ratios(d).select("variant", "odds_ratio"), "odds_ratio", digits=5)



# Splits and search


@query(f"WITH {T.SAMPLES}, n AS (SELECT count(*) // (30 * 5) * 30 AS s FROM samples) SELECT row_idx, CASE WHEN s = 0 THEN 4 ELSE least(row_idx // s, 4) END::INT AS fold FROM samples, n")
def kfold_assign(spark, sf):
    return folds.kfold(T.samples(spark, sf), 5, 30).select("row_idx", "fold")


@query("WITH n AS (SELECT count(*) AS n, count(*) // 300 * 100 AS s FROM orders) SELECT f.range::INT AS fold, CASE WHEN f.range < 2 THEN s ELSE n - 2 * s END AS n_rows FROM n, range(3) f")
def kfold_sizes(spark, sf):
    n = T.table(spark, sf, "orders").count()
    return spark.createDataFrame(list(enumerate(folds.fold_sizes(n, 3, 100))), "fold int, n_rows long")


@query(f"""WITH {T.SAMPLES}, n AS (SELECT count(*) AS n FROM samples), c AS (SELECT range AS c, row_number() OVER (ORDER BY md5('5|' || range::VARCHAR), range) AS k FROM n, range(0, (SELECT (count(*) - 1) // 20 FROM samples)))
    SELECT row_idx, CASE WHEN k <= floor(0.8 * n / 20) THEN 'train' ELSE 'test' END AS split FROM samples CROSS JOIN n LEFT JOIN c ON c = row_idx // 20""")
def chunk_split(spark, sf):
    return folds.chunk_split(T.samples(spark, sf), 20, 0.8, 5).select("row_idx", "split")


@query(f"WITH {T.SAMPLES} SELECT iid FROM samples ORDER BY md5('9|' || iid), iid LIMIT 50")
def exact_sample(spark, sf):
    return folds.exact_sample(T.samples(spark, sf).select("iid"), 50, "iid", 9)


@query()
def random_search(spark, sf):
    return folds.param_frame(spark, folds.random_search(20, 1))


_MEAN = f"WITH {T.SCORES}, m AS (SELECT eta, subsample, colsample_bytree, max_depth, metric, avg(n_boost_round) AS n_boost_round, avg(score) AS score, avg(train_score) AS train_score, avg(fold) AS fold FROM scores GROUP BY 1, 2, 3, 4, 5)"
_MEANS = ["eta", "subsample", "colsample_bytree", "n_boost_round", "score", "train_score", "fold"]
_MEAN_COLS = "round(eta, 6) AS eta, round(subsample, 6) AS subsample, round(colsample_bytree, 6) AS colsample_bytree, max_depth, metric, round(n_boost_round, 6) AS n_boost_round, round(score, 6) AS score, round(train_score, 6) AS train_score, round(fold, 6) AS fold"


@query(f"{_MEAN} SELECT {_MEAN_COLS} FROM m")
def cv_groupby_mean(spark, sf):
    return rounded(folds.mean_scores(T.scores(spark, sf)), *_MEANS)


@query(f"{_MEAN} SELECT {_MEAN_COLS} FROM m ORDER BY m.score DESC, m.eta, max_depth, m.subsample, m.colsample_bytree LIMIT 1")
def cv_best(spark, sf):
    return rounded(folds.best_row(folds.mean_scores(T.scores(spark, sf))), *_MEANS)


# Metrics

_AUC = "SELECT {g} round((sum(CASE WHEN y_true = 1 THEN r END) - sum(y_true) * (sum(y_true) + 1) / 2) / (sum(y_true) * (count(*) - sum(y_true))), 9) AS auc FROM (SELECT *, rank() OVER ({p} ORDER BY y_pred) + (count(*) OVER ({q} PARTITION BY {k}) - 1) / 2.0 AS r FROM {t})"


@query(f"WITH {T.ITEMS} " + _AUC.format(g="", p="", q="", k="y_pred", t="items"))
def auc_ties(spark, sf):
    return rounded(metrics.auc(T.items(spark, sf)), "auc", digits=9)


@query(f"WITH {T.ITEMS} " + _AUC.format(g="grp, ", p="PARTITION BY grp", q="", k="grp, y_pred", t="items") + " GROUP BY grp")
def auc_by_group(spark, sf):
    return rounded(metrics.auc_by_group(T.items(spark, sf), "grp"), "auc", digits=9)


@query(f"WITH {T.ITEMS} SELECT round(sqrt(avg(pow(y_true - y_pred, 2))), 9) AS rmse FROM items")
def rmse(spark, sf):
    return rounded(metrics.rmse(T.items(spark, sf)), "rmse", digits=9)


@query(f"WITH {T.CUSTOMERS} SELECT round(1 - sum(pow(y_true - y_pred / 200000, 2)) / (var_pop(y_true) * count(*)), 6) AS r2 FROM customers")
def r2_quirk(spark, sf):
    return rounded(metrics.r2(T.customers(spark, sf).withColumn("fitted", F.col("y_pred") / 200000)), "r2")


@query(f"WITH {T.ITEMS}, q AS (SELECT y_true, least(greatest(y_pred * 5, 1e-7), 1 - 1e-7) AS q FROM items) SELECT round(avg(-(y_true * ln(q) + (1 - y_true) * ln(1 - q))), 6) AS logloss FROM q")
def logloss(spark, sf):
    return rounded(metrics.logloss(T.items(spark, sf).withColumn("y_pred", F.col("y_pred") * 5)), "logloss")


@query(f"""WITH {T.ITEMS}, g AS (SELECT y_pred, sum(y_true) AS p, count(*) AS n FROM items GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY y_pred DESC) AS tp, sum(n) OVER (ORDER BY y_pred DESC) AS k FROM g)
    SELECT round(sum(p * tp / k) / sum(p), 9) AS aucpr FROM c""")
def aucpr(spark, sf):
    return rounded(metrics.aucpr(T.items(spark, sf)), "aucpr", digits=9)


@query(f"WITH {T.CUSTOMERS}, b AS (SELECT regr_intercept(y_pred, acctbal) AS a, regr_slope(y_pred, acctbal) AS b FROM customers) SELECT iid, round(a + b * acctbal, 1) AS fitted, round(y_pred - a - b * acctbal, 1) AS residual FROM customers, b")
def ols_fit(spark, sf):
    return rounded(linear.fit_ols(T.customers(spark, sf), ["acctbal"], "y_pred").select("iid", "fitted", "residual"), "fitted", "residual", digits=1)


@query(f"""WITH {T.CUSTOMERS}, b AS (SELECT regr_intercept(y_pred, acctbal) AS a, regr_slope(y_pred, acctbal) AS b FROM customers), f AS (SELECT y_true, a + b * acctbal AS fitted, y_pred - a - b * acctbal AS res FROM customers, b),
    r AS (SELECT *, rank() OVER (ORDER BY res) + (count(*) OVER (PARTITION BY res) - 1) / 2.0 AS r FROM f)
    SELECT round((sum(CASE WHEN y_true = 1 THEN r END) - sum(y_true) * (sum(y_true) + 1) / 2) / (sum(y_true) * (count(*) - sum(y_true))), 6) AS auc, round((1 - sum(pow(y_true - fitted, 2)) / (var_pop(y_true) * count(*))) / 1e6, 2) AS r2_millions FROM r""")
def covar_adjusted_auc(spark, sf):
    t, _ = metrics.adjusted_auc(T.customers(spark, sf), ["acctbal"])
    return t.select(F.round("auc", 6).alias("auc"), F.round(F.col("r2") / 1e6, 2).alias("r2_millions"))


@query(f"""WITH {T.ITEMS}, q AS (SELECT y_true, y_pred AS p, 1 / (1 + exp(-(0.1 + 0.2 * y_pred))) AS q FROM items)
    SELECT round(sum(q * (1 - q)), 3) AS sw, round(sum(q * (1 - q) * p), 3) AS swp, round(sum(q * (1 - q) * p * p), 3) AS swpp, round(sum(y_true - q), 3) AS se, round(sum((y_true - q) * p), 3) AS sep FROM q""")
def platt_newton_step(spark, sf):
    return rounded(metrics.newton_sums(T.items(spark, sf), 0.1, 0.2, "y_true", "y_pred"), "sw", "swp", "swpp", "se", "sep", digits=3)


def _newton(rows: str, ridge: float) -> str:
    """Newton's steps of the logistic curve of t on v as a recursive table n(i, a, b), over rows (v, t, k): k of them alike."""
    return f"""d AS ({rows}), n(i, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
        SELECT i + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
        FROM (SELECT i, a, b, sum(w) AS h00, sum(w * v) AS h01, sum(w * v * v) + {ridge} AS h11, sum(k * (t - q)) AS g0, sum(k * (t - q) * v) - {ridge} * b AS g1
              FROM (SELECT i, a, b, v, t, k, 1 / (1 + exp(-(a + b * v))) AS q, k * q * (1 - q) AS w FROM n, d WHERE i < 30) GROUP BY i, a, b))"""


@query(f"WITH RECURSIVE {T.ITEMS}, {_newton('SELECT y_pred::DOUBLE AS v, y_true AS t, count(*) AS k FROM items GROUP BY 1, 2', 0.0)} SELECT round(a, 6) AS a, round(b, 6) AS b FROM n WHERE i = 30")
def platt_fit(spark, sf):
    a, b = linear.platt_fit(T.items(spark, sf))
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "a double, b double")


@query(f"WITH RECURSIVE {T.CUSTOMERS}, {_newton('SELECT acctbal / 1000 AS v, y_true AS t, 1 AS k FROM customers', 1.0)} SELECT round(b, 6) AS beta FROM n WHERE i = 30")
def y_slopes_logistic(spark, sf):
    b = linear.y_slopes(T.customers(spark, sf).withColumn("v", F.col("acctbal") / 1000), ["v"], "y_true", "logistic")
    return spark.createDataFrame([(round(float(b[0]), 6),)], "beta double")


# Boosting and explanation


def _stump_data(spark, sf):
    return T.samples(spark, sf).withColumn("x", F.transform("x", lambda v: F.when(v < -0.085, 0.0).when(v > 0.085, 2.0).otherwise(1.0)))


_STUMP = f"""WITH {T.LONG}, s AS (SELECT variant AS f, dosage AS v, sum(0.5 - y) AS g, count(*) * 0.25::DOUBLE AS h FROM long GROUP BY 1, 2),
    c AS (SELECT f, v, sum(g) OVER (PARTITION BY f ORDER BY v) - g AS gl, sum(h) OVER (PARTITION BY f ORDER BY v) - h AS hl, sum(g) OVER (PARTITION BY f) AS g, sum(h) OVER (PARTITION BY f) AS h FROM s),
    k AS (SELECT *, 0.5 * (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) AS gain FROM c WHERE hl >= 1 AND h - hl >= 1),
    b AS (SELECT * FROM k ORDER BY round(gain, 9) DESC, f, v LIMIT 1)"""


def _stump(spark, sf):
    return boosting.fit(_stump_data(spark, sf), boosting.FitConfig(max_depth=1, eta=0.3), 1)


@query(f"{_STUMP} SELECT f AS feature, v::DOUBLE AS split_value, round(gain, 6) AS gain, round(h, 6) AS cover FROM b")
def stump_gain(spark, sf):
    return rounded(_stump(spark, sf).nodes(spark).where("not is_leaf").select("feature", "split_value", "gain", "cover"), "gain", "cover")



@query(f"{_STUMP} SELECT 'left' AS side, round(-0.3 * gl / (hl + 1), 6) AS leaf FROM b UNION ALL SELECT 'right', round(-0.3 * (g - gl) / (h - hl + 1), 6) FROM b")
def stump_leaf(spark, sf):
    return rounded(_stump(spark, sf).nodes(spark).where("is_leaf").select(F.when(F.col("node") == 1, "left").otherwise("right").alias("side"), "leaf"), "leaf")



@query(f"WITH {T.LONG} SELECT variant, dosage AS cut FROM long GROUP BY 1, 2")
def bin_quantile(spark, sf):
    cuts = boosting.cut_points(_stump_data(spark, sf))
    return spark.createDataFrame([(i, float(c)) for i, cs in enumerate(cuts) for c in cs], "variant int, cut double")



def _node(feature=-1, split=0.0, left=-1, right=-1, cover=1.0, leaf=0.0, gain=0.0, depth=0):
    return {"depth": depth, "feature": feature, "split": split, "default_left": True, "left": left, "right": right, "gain": gain, "cover": cover, "leaf": leaf}


def fixed_booster(features: int = 64) -> boosting.Booster:
    """Two trees with known numbers."""
    one = [_node(0, 0.0, 1, 2, 100.0, gain=5.0), _node(3, 0.05, 3, 4, 60.0, gain=2.0, depth=1), _node(cover=40.0, leaf=0.4, depth=1), _node(cover=20.0, leaf=-0.3, depth=2), _node(cover=40.0, leaf=0.1, depth=2)]
    two = [_node(3, -0.02, 1, 2, 100.0, gain=1.0), _node(cover=30.0, leaf=-0.2, depth=1), _node(cover=70.0, leaf=0.25, depth=1)]
    return boosting.Booster(boosting.FitConfig(), [f"f{i}" for i in range(features)], [one, two], [])


@query(f"WITH {T.SAMPLES} SELECT iid, round(1 / (1 + exp(-(CASE WHEN x[1] < 0 THEN CASE WHEN x[4] < 0.05 THEN -0.3 ELSE 0.1 END ELSE 0.4 END + CASE WHEN x[4] < -0.02 THEN -0.2 ELSE 0.25 END))), 6) AS y_pred FROM samples")
def predict_fixed_tree(spark, sf):
    return rounded(boosting.predict(T.samples(spark, sf), fixed_booster()).select("iid", "y_pred"), "y_pred")


@query(f"WITH {T.SAMPLES} SELECT iid, round(CASE WHEN x[4] < -0.02 THEN -0.2 ELSE 0.25 END - (0.3 * -0.2 + 0.7 * 0.25), 6)::DOUBLE AS phi, round(0.3 * -0.2 + 0.7 * 0.25, 6)::DOUBLE AS bias FROM samples")
def shap_stump(spark, sf):
    b = fixed_booster()
    b.trees = b.trees[1:]
    d = explain.shap(T.samples(spark, sf), b)
    return rounded(d.select("iid", F.get("phi", F.lit(3)).alias("phi"), F.get("phi", F.lit(64)).alias("bias")), "phi", "bias")


@query(f"WITH {T.SAMPLES} SELECT iid, round(CASE WHEN x[1] < 0 THEN CASE WHEN x[4] < 0.05 THEN -0.3 ELSE 0.1 END ELSE 0.4 END + CASE WHEN x[4] < -0.02 THEN -0.2 ELSE 0.25 END, 6)::DOUBLE AS margin FROM samples")
def shap_adds_up(spark, sf):
    d = explain.shap(T.samples(spark, sf), fixed_booster())
    return rounded(d.select("iid", F.aggregate("phi", F.lit(0.0), lambda s, v: s + v).alias("margin")), "margin")


@query(f"WITH {T.LONG} SELECT variant AS feature, round(avg(abs(v)), 6) AS shap_mean_abs FROM long GROUP BY 1")
def shap_mean_abs(spark, sf):
    return rounded(explain.mean_abs(T.samples(spark, sf), "x", drop_last=False), "shap_mean_abs")


@query(f"WITH {T.LONG} SELECT variant AS feature, round(avg(abs(v)), 6) AS shap_mean_abs FROM long GROUP BY 1 ORDER BY avg(abs(v)) DESC, 1 LIMIT 5")
def top_features(spark, sf):
    return rounded(explain.top_features(explain.mean_abs(T.samples(spark, sf), "x", drop_last=False), "shap_mean_abs"), "shap_mean_abs")


# Boruta

_IMP = f"{T.LONG}, imp AS (SELECT variant AS feature, (row_idx % 5)::INT AS iteration, CASE WHEN variant % 9 = 0 THEN NULL ELSE round(avg(abs(v)), 6) END AS imp FROM long GROUP BY variant, row_idx % 5, variant % 9)"


def _imp(spark, sf):
    d = T.long(spark, sf).groupBy(F.col("variant").alias("feature"), (F.col("row_idx") % 5).cast("int").alias("iteration")).agg(F.round(F.avg(F.abs("v")), 6).alias("imp"))
    return d.withColumn("imp", F.when(F.col("feature") % 9 != 0, F.col("imp")))


@query(f"WITH {_IMP} SELECT round(quantile_cont(imp, 0.9), 6) AS threshold FROM imp WHERE iteration = 0")
def shadow_threshold(spark, sf):
    return rounded(boruta.threshold(_imp(spark, sf).where("iteration = 0"), 90.0), "threshold")


@query(f"WITH {_IMP} SELECT feature, (coalesce(imp, 0) > 0.1)::INT AS hit FROM imp WHERE iteration = 1")
def assign_hits(spark, sf):
    return boruta.hits(_imp(spark, sf).where("iteration = 1"), 0.1).select("feature", "hit")


_P = "p AS (SELECT p_partkey AS feature, ((p_partkey * 37) % 1009 + 1) / 20000.0::DOUBLE AS p FROM part)"


@query(f"""WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS i, count(*) OVER () AS m FROM p)
    SELECT feature, i::INT AS rank, round(least(1.0, min(p * m / i) OVER (ORDER BY i DESC)), 9) AS adjusted, i <= coalesce((SELECT max(i) FROM r WHERE p <= i / m::DOUBLE * 0.05), 0) AS rejected FROM r""")
def bh_fdr(spark, sf):
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), (((F.col("p_partkey") * 37) % 1009 + 1) / 20000.0).alias("p"))
    return rounded(boruta.benjamini_hochberg(p).select("feature", "rank", "adjusted", "rejected"), "adjusted", digits=9)


_BINOM = "c AS (SELECT range AS k, (SELECT coalesce(product(10 - g + 1), 1) / coalesce(product(g), 1) FROM (SELECT unnest(range(1, r.range + 1)) AS g)) AS ways FROM range(11) r)"


@query(f"""WITH {_BINOM}, s AS (SELECT p_partkey AS feature, (p_partkey % 11)::INT AS hits FROM part)
    SELECT feature, hits, round((SELECT sum(ways) FROM c WHERE k >= hits) / 1024, 9) AS accept_p, round((SELECT sum(ways) FROM c WHERE k <= hits) / 1024, 9) AS reject_p FROM s""")
def binom_tests(spark, sf):
    s = T.table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), F.lit(0).alias("decision"), (F.col("p_partkey") % 11).cast("int").alias("hits"))
    return rounded(boruta.tests(s, 10).select("feature", "hits", "accept_p", "reject_p"), "accept_p", "reject_p", digits=9)


@query(f"WITH {_BINOM}, s AS (SELECT p_partkey AS feature, (p_partkey % 11)::INT AS hits, (SELECT count(*) FROM part) AS m FROM part), t AS (SELECT *, (SELECT sum(ways) FROM c WHERE k >= hits) / 1024 AS a, (SELECT sum(ways) FROM c WHERE k <= hits) / 1024 AS r FROM s) SELECT feature, CASE WHEN a <= 0.5 / m THEN 1 WHEN r <= 0.5 / m THEN -1 ELSE 0 END::INT AS decided FROM t")
def bonferroni_decisions(spark, sf):
    s = T.table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), F.lit(0).alias("decision"), (F.col("p_partkey") % 11).cast("int").alias("hits"))
    return boruta.tests(s, 10, alpha=0.5, two_step=False).select("feature", "decided")


_RANK = f"WITH {_IMP}, r AS (SELECT feature, iteration, CASE WHEN imp IS NOT NULL THEN rank() OVER (PARTITION BY iteration, imp IS NULL ORDER BY imp) + (count(*) OVER (PARTITION BY iteration, imp) - 1) / 2.0 END AS rank FROM imp)"


@query(_RANK + " SELECT feature, iteration, rank::DOUBLE AS rank FROM r")
def nan_rank(spark, sf):
    return boruta.rank_importances(_imp(spark, sf)).select("feature", "iteration", F.col("rank").cast("double").alias("rank"))


@query(_RANK + " SELECT feature, median(rank)::DOUBLE AS median_rank FROM r GROUP BY 1")
def rank_medians(spark, sf):
    return boruta.median_ranks(boruta.rank_importances(_imp(spark, sf))).select("feature", F.col("median_rank").cast("double").alias("median_rank"))


@query(f"WITH {_IMP} SELECT feature, round(median(imp), 6) AS median_imp FROM imp WHERE feature % 2 = 0 GROUP BY 1 HAVING median(imp) > 0.098")
def tentative_weak(spark, sf):
    even = spark.range(0, 64, 2).select(F.col("id").cast("int").alias("feature"))
    return rounded(boruta.tentative(_imp(spark, sf), even, 0.098), "median_imp")


@query(f"WITH {T.LONG} SELECT variant AS j, round(sum(v), 6) AS s, round(min(v), 6) AS lo, round(max(v), 6) AS hi, count(*) AS n FROM long GROUP BY 1")
def shadow_permutation(spark, sf):
    d = boruta.permuted_columns(T.samples(spark, sf), list(range(WIDTH)), 4).select(F.posexplode("shadow").alias("j", "v"))
    return rounded(d.groupBy("j").agg(F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")), "s", "lo", "hi")



# Aggregations


@query("SELECT l_returnflag, l_linestatus, round(percentile, 6) AS p90, round(med, 6) AS med, n, n_late FROM (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.9) AS percentile, median(l_quantity) AS med, count(DISTINCT l_suppkey) AS n, count_if(l_discount > 0.05)::BIGINT AS n_late FROM lineitem GROUP BY 1, 2)")
def grouped_percentiles(spark, sf):
    d = T.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.percentile("l_extendedprice", 0.9).alias("p90"), F.median("l_quantity").alias("med"), F.countDistinct("l_suppkey").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_late"))
    return rounded(d, "p90", "med")


@query("SELECT o_custkey, o_orderkey, round(min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS UNBOUNDED PRECEDING), 2) AS lowest FROM orders")
def running_minimum(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")).rowsBetween(W.unboundedPreceding, 0)
    return T.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.min("o_totalprice").over(w), 2).alias("lowest"))
