"""Row and column subsets, alignment and joins of sample tables.

A sample table has row_idx, iid, x (array of doubles) and y; a variant table variant_idx and name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.functions.columns import isclose, pick, rsid


def subset_rows(samples: DataFrame, ids: DataFrame, key: str = "iid") -> DataFrame:
    """Rows whose key is in ``ids``; repeated ids don't repeat rows."""
    return samples.join(ids.select(F.col(ids.columns[0]).cast("string").alias("_id")), samples[key].cast("string") == F.col("_id"), "left_semi")


def exclude_rows(samples: DataFrame, ids: DataFrame, key: str = "iid") -> DataFrame:
    """Rows whose key isn't in ``ids``."""
    return samples.join(ids.select(F.col(ids.columns[0]).cast("string").alias("_id")), samples[key].cast("string") == F.col("_id"), "left_anti")


def variant_places(variants: DataFrame, wanted: DataFrame, by_rsid: bool) -> list[int]:
    """0-based places of wanted variants, ascending: by rsid all alleles of one, else by full name."""
    name = rsid(F.col("name")) if by_rsid else F.col("name")
    keep = variants.withColumn("_n", name).join(wanted.select(F.col(wanted.columns[0]).alias("_n")), "_n", "left_semi")
    # One row for each variant kept.
    return sorted(r.variant_idx for r in keep.select("variant_idx").collect())


def subset_columns(samples: DataFrame, variants: DataFrame, wanted: DataFrame, by_rsid: bool = True, col: str = "x") -> tuple[DataFrame, DataFrame]:
    """Samples and variants cut to the wanted variants, in the order of the matrix, with new places."""
    at = variant_places(variants, wanted, by_rsid)
    places = samples.sparkSession.createDataFrame([(i, k) for k, i in enumerate(at)], "variant_idx int, _new int")
    kept = variants.join(places, "variant_idx").withColumn("variant_idx", F.col("_new")).select(*variants.columns)
    return samples.withColumn(col, pick(F.col(col), at)), kept


def subset_tables(samples: DataFrame, variants: DataFrame, ids: DataFrame | None = None, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows, then columns; at least one list has to be given."""
    if ids is None and wanted is None:
        raise ValueError("give row ids, column ids or both")
    if ids is not None:
        samples = subset_rows(samples, ids)
    return subset_columns(samples, variants, wanted) if wanted is not None else (samples, variants)


def subset_contributions(phi: Column, used: list[int], p: int, drop_bias: bool = True) -> Column:
    """Contributions of used features, of an array whose last element is the bias."""
    return pick(phi, [*used] if drop_bias else [*used, p])


def subset_interactions(phi: Column, used: list[int], p: int, drop_bias: bool = True) -> Column:
    """The same of both axes of an array of p + 1 arrays of interactions."""
    at = F.array(*map(F.lit, sorted([*used] if drop_bias else [*used, p])))
    return F.transform(at, lambda i: F.transform(at, lambda j: F.get(F.get(phi, i), j)))


def align_covariates(ids: DataFrame, covars: DataFrame, key: str = "iid") -> DataFrame:
    """Covariates in the order of ``ids``.  A missing id is an error; repeated covariate rows repeat."""
    missing = ids.join(covars, key, "left_anti").select(key).take(1)
    if missing:
        raise KeyError(f"no covariates for {key} {missing[0][0]!r}")
    return ids.join(covars, key, "left")


def drop_ids(df: DataFrame, names: tuple[str, ...] = ("FID", "IID", "fid", "iid")) -> DataFrame:
    return df.drop(*names)


def join_covariates(pred: DataFrame, covars: DataFrame, key: str = "iid") -> DataFrame:
    return pred.join(covars, key, "inner")


def params_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose parameters are close to those of ``right`` (depth equal)."""
    close = [isclose(left[c], right[c]) for c in ("eta", "subsample", "colsample_bytree")]
    return left.join(right, close[0] & close[1] & close[2] & (left["max_depth"] == right["max_depth"]), "left_semi")


def labelled(df: DataFrame, label: str = "y_true") -> DataFrame:
    """Rows with a label: neither null nor NaN."""
    return df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))


def head_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by row_idx; all if n isn't positive."""
    return df.where(F.col("row_idx") < n) if n > 0 else df


def concatenate(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def features_left(p: int, chosen: DataFrame) -> DataFrame:
    """Features 0 to p - 1 that aren't in ``chosen(feature)``."""
    return chosen.sparkSession.range(p).withColumnRenamed("id", "feature").join(chosen.select("feature"), "feature", "left_anti")


def check_covariates(covars: DataFrame) -> dict:
    """Counts of a covariate table (fid, iid, covariates); raises what is wrong with it."""
    if [c.lower() for c in covars.columns[:2]] != ["fid", "iid"]:
        raise ValueError("the first columns have to be FID and IID")
    if len(covars.columns) < 3:
        raise ValueError("no covariates")
    fid, iid = covars.columns[:2]
    n = covars.agg(F.count("*").alias("rows"), F.countDistinct(iid).alias("iids"), F.countDistinct(fid).alias("fids")).first().asDict()
    if n["rows"] < 2:
        raise ValueError("fewer than two rows")
    if n["iids"] < n["rows"] or n["fids"] < n["rows"]:
        raise ValueError("repeated FID or IID")
    return n


def check_samples(samples: DataFrame, variants: DataFrame, col: str = "x") -> tuple[int, int]:
    """(rows, width); raises if a row has another width than there are variants."""
    n = samples.agg(F.count("*").alias("n"), F.min(F.size(col)).alias("lo"), F.max(F.size(col)).alias("hi")).first()
    p = variants.count()
    if n.n and (n.lo != p or n.hi != p):
        raise ValueError(f"rows are {n.lo} to {n.hi} wide, there are {p} variants")
    return n.n, p
