"""The driver's tables in the roles of the engine's: as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.functions.columns import with_row_index


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """row_idx, iid, x, y, label."""
    e = with_row_index(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"), "vec_id")
    return e.select("row_idx", F.col("vec_id").cast("string").alias("iid"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), (F.col("label") < 5).cast("double").alias("y"), "label")


SAMPLES = "samples AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_idx, vec_id::VARCHAR AS iid, list_transform(embedding, lambda e: e::DOUBLE) AS x, (label < 5)::INT::DOUBLE AS y, label FROM embeddings)"


def long(spark: SparkSession, sf: str, features: int = 64) -> DataFrame:
    """iid, row_idx, y, variant (0-based), v, dosage."""
    s = samples(spark, sf).select("iid", "row_idx", "y", F.posexplode(F.slice("x", 1, features)).alias("variant", "v"))
    return s.withColumn("dosage", F.when(F.col("v") < -0.085, 0.0).when(F.col("v") > 0.085, 2.0).otherwise(1.0))


LONG = SAMPLES + ", long0 AS (SELECT iid, row_idx, y, unnest(range(len(x)))::INT AS variant, unnest(x) AS v FROM samples), long AS (SELECT *, CASE WHEN v < -0.085 THEN 0.0::DOUBLE WHEN v > 0.085 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS dosage FROM long0)"


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """iid, y_true, y_pred and covariates acctbal and nation, one row a customer with orders."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 6).alias("y_pred"))
    c = table(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey).select(F.col("c_custkey").cast("string").alias("iid"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("y_true"), F.col("y_pred"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").cast("double").alias("nation"))


CUSTOMERS = "customers AS (SELECT c_custkey::VARCHAR AS iid, (c_mktsegment = 'BUILDING')::INT::DOUBLE AS y_true, p AS y_pred, c_acctbal AS acctbal, c_nationkey::DOUBLE AS nation FROM customer JOIN (SELECT o_custkey, round(avg(o_totalprice), 6) AS p FROM orders GROUP BY 1) ON c_custkey = o_custkey)"


def items(spark: SparkSession, sf: str) -> DataFrame:
    """y_true and a prediction with few distinct values."""
    return table(spark, sf, "lineitem").select("l_shipdate", F.col("l_linestatus").alias("grp"), (F.col("l_returnflag") == "R").cast("double").alias("y_true"), F.col("l_discount").alias("y_pred"))


ITEMS = "items AS (SELECT l_linestatus AS grp, (l_returnflag = 'R')::INT::DOUBLE AS y_true, l_discount AS y_pred FROM lineitem)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """A table of cross-validation scores."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select((0.001 * (k % 7 + 1)).alias("eta"), (0.5 + 0.1 * (k % 3)).alias("subsample"), (0.5 + 0.25 * (k % 2)).alias("colsample_bytree"), (k % 5 + 2).cast("int").alias("max_depth"), F.lit("AUC").alias("metric"), (k % 4 + 10).cast("int").alias("n_boost_round"), (F.col("p_retailprice") / 3000).alias("score"), (F.col("p_retailprice") / 2500).alias("train_score"), (k % 5).cast("int").alias("fold"))


SCORES = "scores AS (SELECT 0.001::DOUBLE * (p_partkey % 7 + 1) AS eta, 0.5::DOUBLE + 0.1::DOUBLE * (p_partkey % 3) AS subsample, 0.5::DOUBLE + 0.25::DOUBLE * (p_partkey % 2) AS colsample_bytree, (p_partkey % 5 + 2)::INT AS max_depth, 'AUC' AS metric, (p_partkey % 4 + 10)::INT AS n_boost_round, p_retailprice / 3000 AS score, p_retailprice / 2500 AS train_score, (p_partkey % 5)::INT AS fold FROM part)"


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """variant_idx, name, variant, chr, pos, p."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select((k - 1).cast("int").alias("variant_idx"), F.concat(F.lit("rs"), (k / 2).cast("long").cast("string"), F.lit("_"), F.substring("p_brand", -1, 1)).alias("name"), (k % 64).cast("int").alias("variant"), F.col("p_size").alias("chr"), F.col("p_partkey").alias("pos"), (F.col("p_retailprice") / 1e5).alias("p"))


VARIANTS = "variants AS (SELECT (p_partkey - 1)::INT AS variant_idx, 'rs' || (p_partkey // 2)::VARCHAR || '_' || right(p_brand, 1) AS name, (p_partkey % 64)::INT AS variant, p_size AS chr, p_partkey AS pos, p_retailprice / 1e5 AS p FROM part)"
