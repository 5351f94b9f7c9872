"""From genotype dosages to an adjusted train and test set: filter, clump, shuffle, split, adjust."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.functions.columns import with_row_index
from lodemill.operators import linear, qc
from lodemill.operators import relational as R


def frequent(samples: DataFrame, variants: DataFrame, maf: float) -> tuple[DataFrame, DataFrame]:
    """Samples and variants cut to those whose minor allele is frequent enough."""
    keep = qc.array_frequencies(samples).where(F.col("maf") >= maf).join(variants, "variant_idx").select("name")
    return R.subset_columns(samples, variants, keep, by_rsid=False)


def clumped(samples: DataFrame, variants: DataFrame, kb: float, r2: float, p1: float = 1.0, p2: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Samples and variants (with chr, pos and p) cut to the index variants of their clumps."""
    named = variants.select(F.col("name").alias("variant"), "chr", "pos", "p", "variant_idx")
    long = qc.wide_to_long(samples).withColumnRenamed("variant", "variant_idx").join(named.select("variant_idx", "variant"), "variant_idx")
    pairs = qc.ld_pairs(named.select("variant", "chr", "pos"), long.select("variant", "iid", "dosage"), kb)
    index = qc.clump(named.select("variant", "chr", "p"), pairs, r2, p1, p2).select(F.col("index_variant").alias("name")).distinct()
    return R.subset_columns(samples, variants, index, by_rsid=False)


def preprocess(samples: DataFrame, variants: DataFrame, covars: DataFrame | None = None, maf: float = 0.05, share: float = 0.7, seed: int = 0, remove: DataFrame | None = None, clump: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, variants).  Rows are shuffled by a seeded hash; covariates (iid and numbers) are taken off if given.

    ``clump``: kb, r2 and maybe p1, p2; then variants need chr, pos and p.
    """
    if remove is not None:
        samples = R.exclude_rows(samples, remove)
    samples, variants = frequent(samples, variants, maf)
    if clump:
        samples, variants = clumped(samples, variants, **clump)
    split = qc.split_ids(samples.drop("row_idx"), share, "iid", seed)
    parts = [with_row_index(split.where(F.col("split") == s).withColumn("_k", qc.shuffled_order(split, "iid", seed)), "_k", "iid").drop("_k") for s in ("train", "test")]
    if covars is not None:
        names = [c for c in covars.columns if c not in ("iid", "IID", "fid", "FID")]
        parts = linear.adjust(*[R.align_covariates(p, covars.select("iid", *names)) for p in parts], names)
    return parts[0], parts[1], variants
