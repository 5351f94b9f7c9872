import numpy as np
import pytest

from lodemill.operators import boosting, boruta, explain, linear, metrics
from lodemill.plans import queries, training
from lodemill.sources import genotype, sinks


def frame(spark, x, y):
    return spark.createDataFrame([(i, str(i), [None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "row_idx long, iid string, x array<double>, y double")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (240, 6)).astype(float)
    y = ((x[:, 1] + 0.5 * x[:, 4] + rng.normal(0, 0.4, 240)) > 1.5).astype(float)
    x[::17, 1] = np.nan
    return x, y, frame(spark, x, y).persist()


def exact_tree(x, g, h, depth, lam=1.0):
    """Greedy second-order tree by brute force over all thresholds; returns each row's leaf."""
    out = np.zeros(len(x))

    def grow(rows, d):
        best = (1e-12, None)
        G, H = g[rows].sum(), h[rows].sum()
        if d < depth:
            for j in range(x.shape[1]):
                v, miss = x[rows, j], np.isnan(x[rows, j])
                for c in np.unique(v[~miss])[1:]:
                    for default in (True, False):
                        left = np.where(miss, default, v < c)
                        gl, hl = g[rows][left].sum(), h[rows][left].sum()
                        if hl < 1 or H - hl < 1:
                            continue
                        gain = 0.5 * (gl**2 / (hl + lam) + (G - gl) ** 2 / (H - hl + lam) - G**2 / (H + lam))
                        if gain > best[0] + 1e-9:
                            best = (gain, left)
        if best[1] is None:
            out[rows] = -0.3 * G / (H + lam)
        else:
            grow(rows[best[1]], d + 1)
            grow(rows[~best[1]], d + 1)

    grow(np.arange(len(x)), 0)
    return out


def test_trees_match_brute_force(spark, data):
    x, y, df = data
    m = boosting.fit(df, boosting.FitConfig(max_depth=3, eta=0.3), 2)
    margin = np.zeros(len(x))
    for tree in m.trees:
        p = 1 / (1 + np.exp(-margin))
        want = exact_tree(x, p - y, p * (1 - p), 3)
        assert np.allclose(boosting.evaluate(tree, x), want)
        margin += want
    got = {r.row_idx: r.y_pred for r in boosting.predict(df, m).collect()}
    assert np.allclose([got[i] for i in range(len(x))], 1 / (1 + np.exp(-margin)))


def test_warm_start_equals_one_run(spark, data):
    _, _, df = data
    c = boosting.FitConfig(max_depth=2, eta=0.3, subsample=0.7, colsample_bytree=0.5)
    history = []
    whole = boosting.fit(df, c, 3, history=history, metric="logloss")
    part = boosting.fit(df, c, 1)
    assert boosting.fit(df, c, 2, start=part).to_json() == whole.to_json()
    assert [h["round"] for h in history] == [0, 1, 2] and history[2]["value"] < history[0]["value"]
    assert boosting.Booster.from_json(whole.to_json()).to_json() == whole.to_json()


def test_margins_are_rebased_without_a_trace(spark, data, monkeypatch):
    _, _, df = data
    c = boosting.FitConfig(max_depth=1, eta=0.3)
    whole = boosting.fit(df, c, 3)
    monkeypatch.setattr(boosting, "REBASE", 2)
    assert boosting.fit(df, c, 3).to_json() == whole.to_json()


def test_regression_objective_and_errors(spark, data):
    x, y, df = data
    m = boosting.fit(df, boosting.FitConfig(max_depth=1, objective="reg:squarederror"), 1)
    assert np.allclose(boosting.evaluate(m.trees[0], x), exact_tree(x, 0.5 - y, np.ones(len(y)), 1))
    with pytest.raises(ValueError):
        boosting.fit(df, boosting.FitConfig(objective="rank"), 1)
    with pytest.raises(ValueError):
        boosting.fit(df, boosting.FitConfig(), 1, features=["one"])


def brute_shap(booster, x):
    from itertools import combinations
    from math import factorial

    p = len(booster.features)
    cond = lambda t, at, row, s: t[at]["leaf"] if t[at]["feature"] < 0 else (
        cond(t, t[at]["left"] if (np.isnan(row[t[at]["feature"]]) and t[at]["default_left"]) or row[t[at]["feature"]] < t[at]["split"] else t[at]["right"], row, s)
        if t[at]["feature"] in s
        else sum(t[t[at][k]]["cover"] / t[at]["cover"] * cond(t, t[at][k], row, s) for k in ("left", "right"))
    )
    out = np.zeros((len(x), p))
    for n, row in enumerate(x):
        for i in range(p):
            for k in range(p):
                for s in combinations([j for j in range(p) if j != i], k):
                    w = factorial(k) * factorial(p - 1 - k) / factorial(p)
                    out[n, i] += w * sum(cond(t, 0, row, {*s, i}) - cond(t, 0, row, {*s}) for t in booster.trees)
    return out


def test_shap_is_exact_and_adds_up(spark, data):
    x, _, df = data
    m = boosting.fit(df, boosting.FitConfig(max_depth=3), 2)
    phi = explain.shap_values(m, x)
    assert np.allclose(phi.sum(1), m.margin(x))
    assert np.allclose(phi[:12, :-1], brute_shap(m, x[:12]))
    used = m.used()
    inter = explain.interaction_values(m, x, used)
    assert np.allclose(inter, inter.transpose(0, 2, 1)) and np.allclose(inter.sum(2), phi[:, used])


def test_cut_points_thin_out(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, rng.normal(size=(3000, 2)), np.zeros(3000))
    for cuts in boosting.cut_points(df, max_bin=32):
        assert len(cuts) <= 32 and list(cuts) == sorted(cuts)
        share = np.diff(np.searchsorted(np.sort(rng.normal(size=3000)), cuts)) / 3000
        assert share.max() < 0.15


def test_slopes_and_residuals(spark):
    rng = np.random.default_rng(0)
    n = 60
    c = rng.normal(size=(n, 2))
    x = np.column_stack([1 + 2 * c[:, 0] - c[:, 1], rng.normal(size=n)])
    x[5, 1] = np.nan
    df = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in x[i]], float(c[i, 0]), float(c[i, 1]), float(i % 2)) for i in range(n)], "row_idx long, x array<double>, c1 double, c2 double, y double")
    b = linear.slopes(df, ["c1", "c2"])
    assert np.allclose(b[:, 0], [2, -1])
    ok = ~np.isnan(x[:, 1])
    assert np.allclose(b[:, 1], np.linalg.lstsq(np.column_stack([np.ones(ok.sum()), c[ok]]), x[ok, 1], rcond=None)[0][1:])
    r = {q.row_idx: q.x_adjusted for q in linear.residual_matrix(df, ["c1", "c2"], b).collect()}
    assert r[5][1] is None and np.allclose([r[i][0] for i in range(n)], 1.0)
    assert len(linear.y_slopes(df, ["c1", "c2"])) == 2
    with pytest.raises(ValueError):
        linear.y_slopes(df, ["c1"], method="other")


def test_auc_ties_and_one_class(spark):
    d = spark.createDataFrame([(1.0, 0.9), (0.0, 0.1), (1.0, 0.8), (0.0, 0.2), (None, 0.5)], "y_true double, y_pred double")
    assert metrics.auc(d).first().auc == 1.0
    tied = spark.createDataFrame([(1.0, 0.5), (0.0, 0.5)], "y_true double, y_pred double")
    assert metrics.auc(tied).first().auc == 0.5
    assert metrics.auc(tied.where("y_true = 1")).first().auc is None
    with pytest.raises(ValueError):
        metrics.score(d, "F1")
    with pytest.raises(ValueError):
        metrics.adjusted_auc(d, [], model="svm")


def test_benjamini_hochberg_golden(spark):
    p = spark.createDataFrame(list(enumerate([0.01, 0.04, 0.03, 0.002, 0.005])), "feature int, p double")
    r = sorted(boruta.benjamini_hochberg(p).collect(), key=lambda r: r.feature)
    assert np.allclose([q.adjusted for q in r], [1 / 60, 0.04, 0.0375, 0.01, 0.0125]) and all(q.rejected for q in r)


def test_boruta_tests_golden(spark):
    s = spark.createDataFrame([(i, 0, h) for i, h in enumerate([1, 2, 1, 3, 1])], "feature int, decision int, hits int")
    r = sorted(boruta.tests(s, 5).collect(), key=lambda r: r.feature)
    assert [q.accept_p for q in r] == [0.96875, 0.8125, 0.96875, 0.5, 0.96875] and {q.decided for q in r} == {0}
    eight = spark.createDataFrame([(0, 0, 8), (1, 0, 0), (2, 0, 4)], "feature int, decision int, hits int")
    assert sorted((q.feature, q.decided) for q in boruta.tests(eight, 8).collect()) == [(0, 1), (1, -1), (2, 0)]


def test_hits_golden(spark):
    imp = spark.createDataFrame(list(enumerate([0.1, 0.4, 0.2, 0.3, float("nan")])), "feature int, imp double")
    assert [r.hit for r in sorted(boruta.hits(imp, 0.25).collect())] == [0, 1, 0, 1, 0]


def test_boruta_loop_finds_the_signal(spark, data):
    _, _, df = data
    r = boruta.select(df, boosting.FitConfig(max_depth=2, eta=0.5), 2, max_iter=3, train_split=1.0, on="train")
    assert len(r.support) == 6 and r.hits[1] == 2
    with pytest.raises(ValueError):
        boruta.select(df, boosting.FitConfig(), 1, train_split=1.0, on="test")
    with pytest.raises(NotImplementedError):
        boruta.select(df, boosting.FitConfig(), 1, importance="gain")


def test_cv_refit_predict(spark, data):
    _, _, df = data
    r = training.cross_validate(df, 1, 2, 20, 2)
    assert r.oof.count() == 240 and r.scores.count() == 1 and r.score > 0.5
    v = spark.createDataFrame([(i, f"rs{i}_A") for i in range(6)], "variant_idx int, name string")
    m = training.refit(df, v, {**r.params, "eta": 0.3}, 2, shap=True)
    assert m.score > 0.7 and m.booster.features == [f"rs{i}_A" for i in m.used]
    assert "shap_mean_abs" in m.importances.columns
    assert training.predict(df, v, m.booster).where("y_pred is null").count() == 0
    with pytest.raises(KeyError):
        training.predict(df, v.where("variant_idx < 1"), m.booster)


def test_incremental_resumes(spark, data, tmp_path):
    _, _, df = data
    c = boosting.FitConfig(max_depth=2, subsample=0.5)
    at = lambda r: str(tmp_path / f"{r}.json")
    whole = boosting.incremental_fit(df, c, 2, 1, 20, at)
    first = genotype.read_booster(spark, at(0))
    assert boosting.incremental_fit(df, c, 2, 1, 20, start=first, start_round=1).to_json() == whole.to_json()


def test_raw_text_to_container(spark, tmp_path):
    p = tmp_path / "a.raw"
    p.write_text("FID IID PAT MAT SEX PHENOTYPE rs1_A rs2_C\n" + "".join(f"{i} {i} 0 0 1 {i % 2 + 1} {i % 3} {'NA' if i == 2 else 1}\n" for i in range(12)))
    s, v = genotype.read_raw(spark, str(p), max_rows=10, skip_rows=1)
    rows = s.orderBy("row_idx").collect()
    assert [r.iid for r in rows] == [str(i) for i in range(1, 11)] and rows[1].x == [2.0, None] and {r.y for r in rows} == {0.0, 1.0}
    assert sinks.write_container(s, v, str(tmp_path / "c")) == (10, 2)
    back, _ = genotype.read_container(spark, str(tmp_path / "c"))
    assert back.count() == 10


def test_search_results(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        genotype.read_search_results(spark, str(tmp_path / "none"))
    (tmp_path / "h.csv").write_text("eta,subsample,colsample_bytree,max_depth,metric,score,n_boost_round\n0.1,0.7,0.5,3.0,AUC,0.6,10.0\n0.2,0.7,0.5,2.0,AUC,0.8,10.0\n")
    best = genotype.read_search_results(spark, str(tmp_path))
    assert best["eta"] == 0.2 and best["max_depth"] == 2 and isinstance(best["n_boost_round"], int)


def test_simulated_odds(spark):
    s, v = genotype.simulate(spark, 6000, 4, 3)
    from pyspark.sql import functions as F

    o = {r.variant: r.odds_ratio for r in linear.odds_ratios(s.select("y", F.posexplode("x").alias("variant", "dosage"))).collect()}
    assert abs(o[2] - 3) < 0.6 and abs(o[3] - 5) < 1.0 and abs(o[0] - 1) < 0.2
    assert genotype.simulate_covariates(s).count() == 6000


def test_stream_scores_new_files_once(spark, data, tmp_path):
    from lodemill.streaming.scoring import score_stream

    _, _, df = data
    m = boosting.fit(df, boosting.FitConfig(max_depth=1), 1)
    df.select("row_idx", "iid", "x").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = score_stream(spark, str(tmp_path / "in"), m, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 240


def test_tree_sql_agrees(spark, data):
    _, _, df = data
    m = boosting.fit(df, boosting.FitConfig(max_depth=2), 1)
    d = boosting.predict(df, m, margin=True).selectExpr("y_pred", boosting.tree_sql(m.trees[0]) + " s")
    assert d.where("abs(y_pred - s) > 1e-9").count() == 0


def test_registry_has_sql_for_most():
    assert len(queries.QUERIES) >= 70 and len(queries.ORACLES) >= 60


def test_preprocess(spark):
    from lodemill.plans.preprocess import preprocess

    s, v = genotype.simulate(spark, 200, 6, 1)
    v = v.selectExpr("variant_idx", "name", "1 chr", "100L * variant_idx pos", "0.01D * (variant_idx + 1) p")
    cov = genotype.simulate_covariates(s).selectExpr("IID iid", "COV1 c1", "COV3 c3")
    train, test, kept = preprocess(s, v, cov, maf=0.05, share=0.7, clump={"kb": 1.0, "r2": 0.75})
    assert train.count() == 140 and test.count() == 60 and kept.count() <= 6
    assert not {r.iid for r in train.collect()} & {r.iid for r in test.collect()}
    row = train.orderBy("row_idx").first()
    assert row.row_idx == 0 and len(row.x_adjusted) == kept.count() and row.y_adjusted is not None


def test_command_line(spark, tmp_path):
    from lodemill import cli

    s, v = genotype.simulate(spark, 120, 4, 2)
    names = [r["name"] for r in v.orderBy("variant_idx").collect()]
    rows = s.orderBy("row_idx").collect()
    raw, cov = tmp_path / "a.raw", tmp_path / "c.txt"
    raw.write_text(" ".join(["FID IID PAT MAT SEX PHENOTYPE", *names]) + "\n" + "".join(f"{r.fid} {r.iid} 0 0 1 {int(r.phenotype)} {' '.join(str(int(x)) for x in r.x)}\n" for r in rows))
    cov.write_text("FID IID COV1\n" + "".join(f"{r.fid} {r.iid} {i % 7}.5\n" for i, r in enumerate(rows)))
    out = str(tmp_path / "out")
    a = cli.parser().parse_args(["run", "--in_raw", str(raw), "--out", out, "--covar", str(cov), "--n_iter", "1", "--n_fold", "2", "--row_chunks", "10", "--n_boost_round", "2"])
    a.run(spark, a)
    pred = spark.read.csv(f"{out}/predictions.csv", header=True, inferSchema=True)
    assert pred.count() == 36 and pred.where("y_pred_platt_scaled is null").count() == 0
    b = cli.parser().parse_args(["score", "--predictions", f"{out}/predictions.csv", "--covars", str(cov), "--out", f"{out}/scored", "--id", "iid", "--model", "ols"])
    b.run(spark, b)
    assert "OLS_adjusted_y_pred" in spark.read.csv(f"{out}/scored", header=True).columns
    with pytest.raises(ValueError):
        cli.session("slurm")


def test_column_blocks():
    cols = np.arange(1000)
    parts = boosting._blocks(cols, 64 * 255)
    assert len(parts) == 2 and np.array_equal(np.concatenate(parts), cols) and len(boosting._blocks(cols, 4)) == 1


def test_whole_queries_by_brute_force(spark, tmp_path):
    """Queries have the rows of every variant, right in each."""
    rng = np.random.default_rng(8)
    n, p = 200, queries.WIDTH
    x = rng.normal(0, 0.125, (n, p)).astype(np.float32).astype(float)
    label = rng.integers(0, 10, n)
    y, t = (label < 5).astype(float), np.arange(n, dtype=float)
    sf = str(tmp_path)
    spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(n)], "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(0, n, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    run = lambda name: queries.QUERIES[name](spark, sf).collect()
    dose = np.where(x < -0.085, 0.0, np.where(x > 0.085, 2.0, 1.0))

    assert sorted(map(tuple, run("sample_removal"))) == sorted((str(i), j, dose[i, j]) for i in range(n) if i % 7 for j in range(p))
    assert sorted(map(tuple, run("allele_recode"))) == sorted((str(i), j, dose[i, j] if j % 2 == 0 else 2 - dose[i, j]) for i in range(n) for j in range(p))
    b = np.linalg.lstsq(np.column_stack([np.ones(n), t, y]), x, rcond=None)[0]
    got = {(int(r.iid), r.variant): r.r for r in run("residual_x")}
    assert len(got) == n * p and all(abs(v - (x - np.outer(t, b[1]) - np.outer(y, b[2]))[k]) < 2e-5 for k, v in got.items())

    cut = n * 3 // 5
    z = (t - t[:cut].mean()) / t[:cut].std()
    slope = lambda v: (z[:cut] @ (v[:cut] - v[:cut].mean(0))) / (z[:cut] @ z[:cut])
    xa, ya = x - np.outer(z, slope(x)), y - z * slope(y)
    got = {(int(r.iid), r.variant): (r.x_adjusted, r.y_adjusted) for r in run("adjust_train_test")}
    assert len(got) == n * p and all(abs(v - xa[k]) < 2e-5 and abs(w - ya[k[0]]) < 2e-5 for k, (v, w) in got.items())

    e = (dose > 1).astype(float)
    odds = (y @ e) * ((1 - y) @ (1 - e)) / (((1 - y) @ e) * (y @ (1 - e)))
    got = {r.variant: r.odds_ratio for r in run("odds_ratio_2x2")}
    assert len(got) == p and all(abs(v - odds[j]) < 1e-4 for j, v in got.items())

    best = (-1.0,)
    g, h = 0.5 - y, n * 0.25
    for j in range(p):
        for v in (1.0, 2.0):
            left = dose[:, j] < v
            gl, hl = g[left].sum(), left.sum() * 0.25
            gain = 0.5 * (gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h - hl + 1) - g.sum() ** 2 / (h + 1))
            if gain > best[0]:
                best = (gain, j, v, -0.3 * gl / (hl + 1), -0.3 * (g.sum() - gl) / (h - hl + 1))
    (r,) = run("stump_gain")
    assert best[1] >= 8 and (r.feature, r.split_value) == best[1:3] and (r.gain, r.cover) == pytest.approx((best[0], h), abs=1e-5)
    assert {r.side: r.leaf for r in run("stump_leaf")} == pytest.approx({"left": best[3], "right": best[4]}, abs=1e-5)
    assert sorted(map(tuple, run("bin_quantile"))) == [(j, v) for j in range(p) for v in np.unique(dose[:, j])]
    got = {r.j: (r.s, r.lo, r.hi, r.n) for r in run("shadow_permutation")}
    assert len(got) == p and all(v == pytest.approx((x[:, j].sum(), x[:, j].min(), x[:, j].max(), n), abs=2e-6) for j, v in got.items())


def test_forest_is_searched(spark, monkeypatch):
    d = spark.range(300).selectExpr("id", "double(id % 2) y_true", "double(id % 7) a", "double(id % 5) b").selectExpr("*", "a * b + sin(id) y_pred")
    found, search = [], metrics.tune_forest
    monkeypatch.setattr(metrics, "tune_forest", lambda *a, **k: found.append(search(*a, **k)) or found[-1])
    table, rows = metrics.adjusted_auc(d, ["a", "b"], model="rf", draws=2, trees=3)
    assert found[0] in metrics.forest_draws(2, 3, 2) and table.first().auc is not None
    assert rows.count() == 300 and rows.where("abs(residual - (y_pred - fitted)) > 1e-12").count() == 0
    draws = metrics.forest_draws(2000, 1000, 20)
    assert {x["numTrees"] for x in draws} == {1000} and {x["featureSubsetStrategy"] for x in draws} == set("345678")
    assert abs(np.mean([x["maxDepth"] for x in draws]) - (2 + 2 * 0.55 / 0.45)) < 0.2
    some = [r.id for r in metrics.forest_sample(d, 100, 0).collect()]
    assert len(some) == 100 and 120 < np.mean(some) < 180 and sorted(some) == sorted(r.id for r in metrics.forest_sample(d.repartition(7), 100, 0).collect())


def test_take_is_the_same_in_the_plan_and_out_of_it(spark):
    from pyspark.sql import functions as F

    from lodemill.functions import arrays

    d = spark.createDataFrame([(1, [float(i) for i in range(100)]), (2, [1.0, None]), (3, [])], "k int, x array<double>")
    few, many = [5, 1, 99], [5, 1, 99] * 30
    assert len(many) > arrays.INLINE >= len(few)
    a = {r.k: r.v for r in d.select("k", arrays.take(F.col("x"), few).alias("v")).collect()}
    b = {r.k: r.v for r in d.select("k", arrays.take(F.col("x"), many).alias("v")).collect()}
    assert a == {1: [5.0, 1.0, 99.0], 2: [None, None, None], 3: [None, None, None]} and b == {k: v * 30 for k, v in a.items()}
    assert d.select(arrays.take(F.col("x"), []).alias("v")).first().v == []


def test_plans_do_not_grow_with_the_width(spark):
    from lodemill.operators import relational as R

    s, v = genotype.simulate(spark, 20, 3000, 1)
    some, kept = R.subset_columns(s, v, v.where("variant_idx % 2 = 1").select("name"), by_rsid=False)
    assert len(some._jdf.queryExecution().analyzed().toString()) < 20_000
    assert kept.count() == 1500 and all(len(r.x) == 1500 for r in some.select("x").collect())
    m = boosting.fit(s, boosting.FitConfig(max_depth=1), 1)
    assert boosting.predict(s, m).where("y_pred is null").count() == 0
    a, _ = linear.adjust(s.withColumn("c", s.row_idx % 7), s.withColumn("c", s.row_idx % 7), ["c"])
    assert all(len(r.x_adjusted) == 3000 for r in a.select("x_adjusted").collect())


def test_estimators_by_what_they_offer(spark):
    d = spark.createDataFrame([(1.0, [1.0, 2.0]), (2.0, [0.0, 5.0])], "p double, x array<double>")

    class Proba:
        def predict_proba(self, m):
            return np.column_stack([1 - m[:, 0], m[:, 0]])

        def predict(self, m):
            raise AssertionError

    class Sum:
        def predict(self, m):
            return m.sum(1)

    assert [r.yhat for r in training.yhat(d, Proba(), "p").collect()] == [1.0, 2.0]
    assert [r.yhat for r in training.yhat(d, Sum(), "x").collect()] == [3.0, 5.0]
    assert training.yhat(d, (0.0, 0.0), "p").first().yhat == 0.5
    with pytest.raises(ValueError):
        training.yhat(d, object(), "p")


def test_final_ranks_golden():
    history = np.array([[0.9, 0.1, 0.5, 0.2, 0.3], [0.8, 0.2, 0.6, np.nan, 0.2]])
    no = np.zeros(5, bool)
    confirmed, weak = no.copy(), no.copy()
    confirmed[0], weak[2] = True, True
    assert boruta.final_ranks(history, confirmed, weak).tolist() == [1, 5, 2, 4, 3]
    assert boruta.final_ranks(history, confirmed, no).tolist() == [1, 5, 2, 4, 3]
    assert boruta.final_ranks(history, ~no, no).tolist() == [1] * 5
    assert [n * boruta.shadow_copies(n) for n in (1, 2, 3, 4, 5, 9)] == [8, 8, 6, 8, 5, 9]


def test_cut_points_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CUT_BYTES", 100)
    with pytest.raises(ValueError, match="max_bin"):
        boosting.cut_points(frame(spark, np.random.default_rng(0).normal(size=(50, 2)), np.zeros(50)))


def test_linkage_with_missing_dosages(spark):
    from lodemill.operators import qc

    rng = np.random.default_rng(3)
    d = rng.integers(0, 3, (40, 6)).astype(float)
    d[rng.random((40, 6)) < 0.2] = np.nan
    d[:, 5] = 1.0
    pos = [0, 900, 1500, 1600, 2600, 2600]
    v = spark.createDataFrame([(j, 1, pos[j]) for j in range(6)], "variant int, chr int, pos long")
    long = spark.createDataFrame([(str(i), j, None if np.isnan(d[i, j]) else float(d[i, j])) for i in range(40) for j in range(6)], "iid string, variant int, dosage double")
    got = {(r.a, r.b): r.r2 for r in qc.ld_pairs(v, long, 1.0).collect()}
    want = {}
    for a in range(6):
        for b in range(a + 1, 6):
            if pos[b] - pos[a] <= 1000:
                ok = ~np.isnan(d[:, a]) & ~np.isnan(d[:, b])
                want[a, b] = None if b == 5 else np.corrcoef(d[ok, a], d[ok, b])[0, 1] ** 2
    assert got.keys() == want.keys()
    assert all(got[k] is None if w is None else abs(got[k] - w) < 1e-9 for k, w in want.items())


def test_linkage_of_shared_columns_in_blocks_and_chunks(spark, monkeypatch):
    """Variants that share dosages are correlated once; blocks of 3 columns and chunks of some 16 samples add up."""
    from lodemill.operators import qc

    monkeypatch.setattr(qc, "BLOCK", 3)
    monkeypatch.setattr(qc, "CHUNK", 16)
    rng = np.random.default_rng(4)
    d = rng.integers(0, 3, (70, 7)).astype(float)
    d[rng.random((70, 7)) < 0.3] = np.nan
    d[:, 6] = np.nan
    at = [(j, 1 + j % 2, 130 * j, j % 8) for j in range(40)]  # column 7 isn't there, 6 is never called
    v = spark.createDataFrame(at, "variant int, chr int, pos long, column int")
    long = spark.createDataFrame([(f"s{i}", j, None if np.isnan(d[i, j]) else float(d[i, j])) for i in range(70) for j in range(7)], "iid string, variant int, dosage double")
    got = {(r.a, r.b): r.r2 for r in qc.ld_pairs(v, long, 1.0).collect()}
    want = {}
    for a, chr_a, pos_a, col_a in at:
        for b, chr_b, pos_b, col_b in at:
            if a < b and chr_a == chr_b and pos_b - pos_a <= 1000 and max(col_a, col_b) < 6:
                ok = ~np.isnan(d[:, col_a]) & ~np.isnan(d[:, col_b])
                want[a, b] = np.corrcoef(d[ok, col_a], d[ok, col_b])[0, 1] ** 2
    assert got.keys() == want.keys()
    assert all(abs(got[k] - w) < 1e-9 for k, w in want.items())


def test_search_results_round_the_mean_number_of_rounds(spark, tmp_path):
    """Means of 11.6 rounds are 12, as in the query's SQL."""
    from lodemill.plans.registry import QUERIES

    rows = [(k, 900.0) for k in (2, 212, 422, 842, 1262)]  # one set of parameters; 12, 10, 12, 12 and 12 rounds
    spark.createDataFrame(rows, "p_partkey long, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    assert [tuple(r) for r in QUERIES["search_results_read"](spark, str(tmp_path)).collect()] == [(0.003, 4, 12, 0.3)]
