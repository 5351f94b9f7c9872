"""Readers of text formats and of the Parquet container, and simulated data.

A container is a folder with ``samples`` (row_idx, fid, iid, pat, mat, sex, phenotype, x, y, and maybe x_adjusted,
y_adjusted, split) and ``variants`` (variant_idx, name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.functions.columns import with_row_index
from lodemill.operators.boosting import Booster
from lodemill.operators.folds import best_row
from lodemill.operators import linear
from lodemill.operators.relational import align_covariates, check_covariates, check_samples

FAM = ["fid", "iid", "pat", "mat", "sex", "phenotype"]


def parse_raw(line: Column) -> list[Column]:
    """Six family columns and x of a line of dosages; what isn't a number is null."""
    v = F.split(F.trim(line), r"\s+")
    fam = [F.get(v, F.lit(i)).alias(n) for i, n in enumerate(FAM[:4])]
    fam += [F.get(v, F.lit(i)).try_cast("double").alias(n) for i, n in ((4, "sex"), (5, "phenotype"))]
    x = F.transform(F.slice(v, 7, F.greatest(F.size(v) - 6, F.lit(0))), lambda e: e.try_cast("double"))
    return [*fam, x.alias("x")]


def first_line(spark: SparkSession, path: str) -> str:
    """Of the first file, in order of name, that has one; '' for none.  Spark itself reads the largest file first."""
    for f in sorted(spark.read.text(path).inputFiles()):
        row = spark.read.text(f).first()
        if row:
            return row[0]
    return ""


def header(spark: SparkSession, path: str) -> list[str]:
    return first_line(spark, path).strip().split()


def recode_labels(df: DataFrame, col: str = "phenotype", out: str = "y") -> DataFrame:
    """Labels 1 and 2 become 0 and 1 if the highest is 2."""
    two = df.agg((F.max(col) == 2).alias("two")).first().two
    return df.withColumn(out, F.col(col) - 1.0 if two else F.col(col))


def _is_header(value: Column) -> Column:
    return F.trim(value).rlike(r"^FID\s+IID\s")


def count_raw_rows(spark: SparkSession, path: str) -> int:
    """Samples of a text of dosages: its lines without headers and blank ones."""
    return spark.read.text(path).where(~_is_header(F.col("value")) & (F.trim("value") != "")).count()


def read_raw(spark: SparkSession, path: str, max_rows: int | None = None, skip_rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """(samples, variants) of a text of dosages with a header; split like any text file, so no chunks are needed.

    Places follow the file: files in order of name, lines in order of offset.
    """
    names = header(spark, path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    body = lines.where(~_is_header(F.col("value")) & (F.trim("value") != ""))
    rows = with_row_index(body, "_f", "_b", "_m")
    rows = rows.where(F.col("row_idx") >= skip_rows).withColumn("row_idx", F.col("row_idx") - skip_rows)
    if max_rows is not None:
        rows = rows.where(F.col("row_idx") < max_rows)
    samples = recode_labels(rows.select("row_idx", *parse_raw(F.col("value"))))
    variants = spark.createDataFrame([(i, n) for i, n in enumerate(names[6:])], "variant_idx int, name string")
    return samples, variants


def read_covariates(spark: SparkSession, path: str, sep: str | None = None, check: bool = True) -> DataFrame:
    """FID, IID and numeric covariates; fields are split at ``sep``, or at any white space."""
    names = header(spark, path) if sep is None else first_line(spark, path).split(sep)
    lines = spark.read.text(path).where(F.trim("value") != "")
    v = F.split(F.trim("value"), r"\s+" if sep is None else sep)
    rows = lines.select(v.alias("v")).where(F.get("v", F.lit(0)) != names[0])
    out = rows.select(*[(F.get("v", F.lit(i)) if i < 2 else F.get("v", F.lit(i)).try_cast("double")).alias(n.strip()) for i, n in enumerate(names)])
    if check:
        check_covariates(out)
    return out


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def read_predictions(spark: SparkSession, path: str, sep: str = ",", key: str = "IID") -> DataFrame:
    """Predictions with header; the key column is called iid."""
    df = spark.read.csv(path, header=True, sep=sep)
    return df.select(*[(F.col(c).cast("string").alias("iid") if c == key else F.col(c).try_cast("double").alias(c)) for c in df.columns])


def read_search_results(spark: SparkSession, path: str) -> dict:
    """The best row of a CSV, or of all CSVs of a folder, as parameters."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.option("pathGlobFilter", "*.csv").csv(path, header=True, inferSchema=True)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    row = best_row(df).first()
    if row is None:
        raise FileNotFoundError(path)
    out = row.asDict()
    for c in ("max_depth", "n_boost_round"):
        if out.get(c) is not None:
            out[c] = int(out[c])
    return out


def read_container(spark: SparkSession, path: str, x: str = "x", y: str = "y", check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(samples, variants); ``x`` and ``y`` choose the plain or the adjusted columns."""
    samples, variants = spark.read.parquet(f"{path}/samples"), spark.read.parquet(f"{path}/variants")
    fam = [c for c in ("row_idx", *FAM, "split") if c in samples.columns]
    samples = samples.select(*fam, F.col(x).alias("x"), F.col(y).alias("y"))
    if check:
        check_samples(samples, variants)
    return samples, variants


def read_booster(spark: SparkSession, path: str) -> Booster:
    """The model of a file or folder; says how many trees and features it has."""
    booster = Booster.from_json("\n".join(r.value for r in spark.read.text(path).collect()))
    print("trees, features:", *booster.summary().values())
    return booster


def simulate(spark: SparkSession, n: int, p: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Half cases, half controls; case allele frequencies uniform 0.05 to 0.5; the last two variants have odds ratios 3 and 5.

    Frequencies and draws are hashes of the variant's and the row's number, so the plan is as short for any width.
    """
    uniform = lambda *of: F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / float(1 << 30)
    rows = spark.range(n).select(F.col("id").alias("row_idx"), F.col("id").cast("string").alias("fid"), F.col("id").cast("string").alias("iid"), (F.col("id") % 2).cast("double").alias("y"))

    def draw(j: Column) -> Column:
        maf = 0.05 + 0.45 * uniform(F.lit(seed), j, F.lit("maf"))
        odds = F.when((j == p - 2) & F.lit(p >= 2), 3.0).when((j == p - 1) & F.lit(p >= 2), 5.0).otherwise(1.0)
        f = F.when(F.col("y") == 1, maf).otherwise(maf / (odds * (1 - maf) + maf))
        return (uniform("row_idx", F.lit(seed), j, F.lit(0)) < f).cast("double") + (uniform("row_idx", F.lit(seed), j, F.lit(1)) < f).cast("double")

    samples = rows.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(p - 1)), draw)).withColumn("phenotype", F.col("y") + 1)
    names = [f"rs{1000 + 7 * j}_{'ACGT'[j % 4]}" for j in range(p - 2)] + ["rs7412_T", "rs429358_C"] if p >= 2 else [f"rs{j}_A" for j in range(p)]
    return samples, spark.createDataFrame(list(enumerate(names)), "variant_idx int, name string")


def simulate_covariates(samples: DataFrame, seed: int = 0) -> DataFrame:
    """FID, IID, two normal covariates of deviation 0.1 and a binary one."""
    normal = lambda k: 0.1 * F.sqrt(-2 * F.log(_u(k))) * F.cos(2 * 3.141592653589793 * _u(k + 1))
    _u = lambda k: (F.pmod(F.xxhash64("row_idx", F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    return samples.select(F.col("fid").alias("FID"), F.col("iid").alias("IID"), normal(1).alias("COV1"), normal(3).alias("COV2"), (_u(5) < 0.5).cast("double").alias("COV3"))


def add_adjustment(samples: DataFrame, covars: DataFrame, y: str = "y", out: str = "y_adjusted") -> DataFrame:
    """``samples`` with the label less its regression on the covariates (FID, IID, numbers); the intercept stays."""
    names = covars.columns[2:]
    rows = align_covariates(samples, covars.withColumnRenamed(covars.columns[1], "iid").drop(covars.columns[0]))
    beta = linear.y_slopes(rows, names, y, "linear")
    return rows.withColumn(out, linear.residual_expr(F.col(y), [F.col(c) for c in names], list(beta))).drop(*names)


def print_summary(samples: DataFrame) -> None:
    samples.select("row_idx", "y", F.slice("x", 1, 10).alias("x")).limit(10).show(truncate=False)
    print(samples.count(), "rows")
