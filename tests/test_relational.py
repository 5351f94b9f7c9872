import pytest
from pyspark.sql import functions as F

from lodemill.functions import columns as C
from lodemill.operators import folds, qc
from lodemill.operators import relational as R


@pytest.fixture
def samples(spark):
    return spark.createDataFrame([(i, str(100 + i), [float(i), float(i % 3), None], float(i % 2)) for i in range(10)], "row_idx long, iid string, x array<double>, y double")


def test_subset_rows_ignores_repeats_and_types(spark, samples):
    ids = spark.createDataFrame([(103,), (103,), (999,)], "id long")
    assert [r.iid for r in R.subset_rows(samples, ids).collect()] == ["103"]
    assert R.exclude_rows(samples, ids).count() == 9


def test_subset_columns_takes_all_alleles_in_matrix_order(spark, samples):
    v = spark.createDataFrame([(0, "rs5_A"), (1, "rs1_C"), (2, "rs5_G")], "variant_idx int, name string")
    s, kept = R.subset_columns(samples, v, spark.createDataFrame([("rs5",)], "id string"))
    assert s.where("row_idx = 4").first().x == [4.0, None]
    assert sorted(map(tuple, kept.collect())) == [(0, "rs5_A"), (1, "rs5_G")]
    none, _ = R.subset_columns(samples, v, spark.createDataFrame([("rs9",)], "id string"))
    assert none.first().x == []


def test_subset_tables_needs_a_list(spark, samples):
    with pytest.raises(ValueError):
        R.subset_tables(samples, samples)


def test_alignment_names_the_missing_id(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "iid string")
    with pytest.raises(KeyError):
        R.align_covariates(ids, spark.createDataFrame([("a", 1.0)], "iid string, c double"))


def test_covariate_checks(spark):
    good = spark.createDataFrame([("1", "1", 0.5), ("2", "2", 0.1)], "FID string, IID string, c double")
    assert R.check_covariates(good)["rows"] == 2
    with pytest.raises(ValueError):
        R.check_covariates(good.union(good))
    with pytest.raises(ValueError):
        R.check_covariates(good.drop("c"))


def test_fold_sizes():
    assert folds.fold_sizes(100, 5, 10) == [20] * 5
    assert folds.fold_sizes(1000, 3, 100) == [300, 300, 400]
    assert folds.fold_sizes(1050, 5, 100) == [200] * 4 + [250]
    assert folds.fold_sizes(300, 5, 100) == [0, 0, 0, 0, 300]


@pytest.mark.parametrize("n,k,chunk", [(100, 5, 10), (105, 3, 10), (30, 5, 100)])
def test_kfold_covers_every_row_once(spark, n, k, chunk):
    d = folds.kfold(spark.range(n).withColumnRenamed("id", "row_idx"), k, chunk)
    sizes = dict(map(tuple, d.groupBy("fold").count().collect()))
    assert [sizes.get(f, 0) for f in range(k)] == folds.fold_sizes(n, k, chunk)


def test_chunk_split_leaves_the_last_chunk_to_test(spark):
    d = folds.chunk_split(spark.range(100).withColumnRenamed("id", "row_idx"), 10, 0.8)
    assert d.where("split = 'train'").count() == 80
    assert d.where("row_idx >= 90 and split = 'train'").count() == 0
    with pytest.raises(ValueError):
        folds.chunk_split(d, 10, 0.95)


def test_split_ids_is_exact_and_repeatable(spark):
    d = spark.range(101).select(F.col("id").cast("string").alias("iid"))
    a = qc.split_ids(d, 0.7, seed=1).where("split = 'train'")
    assert a.count() == round(0.7 * 101)
    assert {r.iid for r in a.collect()} == {r.iid for r in qc.split_ids(d.repartition(7), 0.7, seed=1).where("split = 'train'").collect()}
    assert qc.split_ids(d, 1.0).where("split = 'test'").count() == 0


def test_row_index_follows_the_order(spark):
    d = C.with_row_index(spark.range(50).select((49 - F.col("id")).alias("k")), "k")
    assert all(r.k == r.row_idx for r in d.collect())
    assert C.with_row_index(spark.range(0), "id").count() == 0


def test_partition_map():
    assert folds.partition_map(5, ["a", "b"]) == {0: "a", 1: "a", 2: "a", 3: "b", 4: "b"}
    with pytest.raises(ValueError):
        folds.partition_map(1, ["a", "b"])


def test_small_helpers():
    assert C.parse_bool("True") and not C.parse_bool("no")
    with pytest.raises(ValueError):
        C.parse_bool("maybe")
    assert C.none_if_none("None") is None and C.none_if_none("x") == "x"
    assert C.spark_type("float16") == "float"
    with pytest.raises(ValueError):
        C.spark_type("int3")
    with pytest.raises(ValueError, match="expected"):
        C.check_shape((1, 2), (2, 1))


def test_clump_is_greedy(spark):
    v = spark.createDataFrame([("a", 1, 0.01), ("b", 1, 0.02), ("c", 1, 0.03), ("d", 2, 0.5)], "variant string, chr int, p double")
    pairs = spark.createDataFrame([(1, "a", "b", 0.9), (1, "b", "c", 0.9)], "chr int, a string, b string, r2 double")
    got = sorted((r.index_variant, r.variant) for r in qc.clump(v, pairs).collect())
    assert got == [("a", "a"), ("a", "b"), ("c", "c"), ("d", "d")]


def test_bed_codes():
    assert qc.bed_decode(bytes([0b11_10_01_00]), 4).tolist() == [2, -1, 1, 0]
