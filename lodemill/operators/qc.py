"""Quality control of genotype dosages, in long form (iid, variant, dosage)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodemill.functions.columns import seeded, with_row_index


def allele_frequencies(long: DataFrame) -> DataFrame:
    """(variant, af, maf, missing): frequency of the counted allele among called dosages."""
    af = F.avg("dosage") / 2
    return long.groupBy("variant").agg(af.alias("af"), F.least(af, 1 - af).alias("maf"), F.avg(F.col("dosage").isNull().cast("double")).alias("missing"))


def array_frequencies(samples: DataFrame, x: str = "x") -> DataFrame:
    """(variant_idx, af, maf, missing) of every element of the array ``x``; nothing is exploded: each partition sends one row for each element."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = called = None
        rows = 0
        for b in batches:
            if b.num_rows:
                m = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                ok = ~np.isnan(m)
                s, n = np.where(ok, m, 0.0).sum(0), ok.sum(0)
                total, called, rows = (s, n, len(m)) if total is None else (total + s, called + n, rows + len(m))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total), pa.array(called, pa.int64()), pa.array([rows] * len(total), pa.int64())], ["variant_idx", "s", "n", "rows"])

    sums = samples.select(F.col(x).cast("array<double>")).mapInArrow(partial, "variant_idx int, s double, n long, rows long").groupBy("variant_idx").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    af = F.col("s") / F.expr("nullif(n, 0)") / 2
    return sums.select("variant_idx", af.alias("af"), F.least(af, 1 - af).alias("maf"), (1 - F.col("n") / F.col("rows")).alias("missing"))


def filter_maf(long: DataFrame, least: float = 0.05, remove: DataFrame | None = None) -> DataFrame:
    """Rows of variants whose minor allele is at least so frequent, without the samples to remove."""
    if remove is not None:
        long = long.join(remove.select("iid"), "iid", "left_anti")
    kept = allele_frequencies(long).where(F.col("maf") >= least)
    return long.join(kept.select("variant"), "variant", "left_semi")


def keep_samples(long: DataFrame, ids: DataFrame) -> DataFrame:
    return long.join(ids.select("iid"), "iid", "left_semi")


def extract_variants(long: DataFrame, names: DataFrame) -> DataFrame:
    return long.join(names.select("variant"), "variant", "left_semi")


def recode_dosage(dosage: Column, allele: Column, counted: Column) -> Column:
    """Dosage of the counted allele."""
    return F.when(allele == counted, dosage).when(allele.isNotNull(), 2 - dosage)


#: Columns of a block and samples of a chunk: a task of ``ld_pairs`` multiplies matrices of two blocks of one chunk.
BLOCK, CHUNK = 256, 4096


def ld_pairs(variants: DataFrame, long: DataFrame, kb: float) -> DataFrame:
    """(chr, a, b, r2) of variants (variant, chr, pos) on one chromosome within ``kb`` thousand bases.

    r2 is the squared correlation over samples with both dosages, null without two of them or where either doesn't vary.
    Variants without any dosage stand in no pair.  Where variants share dosages, a further field ``column`` names those in
    ``long``; else a variant is its own.

    Each pair of columns that some pair of variants needs is correlated once, however many variants share it.  Columns,
    in order of their places, fall into blocks, and samples into chunks; a task gets two blocks of a chunk and gives sums of
    products, which add up over the chunks.  So a dosage moves once for each block that its own is paired with, and a
    task is bounded by ``BLOCK`` and ``CHUNK``, whatever the number of samples.
    """
    width = max(1, int(kb * 1000))
    own = variants if "column" in variants.columns else variants.withColumn("column", F.col("variant"))
    cells = long.where("dosage is not null and iid is not null").select(F.col("variant").alias("column"), F.col("iid").cast("string").alias("iid"), F.col("dosage").cast("double").alias("d"))
    chunks = max(1, -(-cells.agg(F.approx_count_distinct("iid")).first()[0] // CHUNK))
    first = own.groupBy("column").agg(F.min(F.struct("chr", "pos")).alias("at")).join(cells.select("column").distinct(), "column", "left_semi")
    places = with_row_index(first.select("column", "at.chr", "at.pos"), "chr", "pos", "column", name="k").select("column", "k")
    places = F.broadcast(places) if places.count() <= 1_000_000 else places

    own = own.join(places, "column").select("chr", "variant", "pos", "k", F.floor(F.col("pos") / width).alias("w"))
    # A window's variants meet those of their own and of the next window.
    later = own.select("chr", F.col("variant").alias("b"), F.col("pos").alias("pos_b"), F.col("k").alias("k_b"), F.explode(F.array("w", F.col("w") - 1)).alias("w"))
    pairs = own.withColumnRenamed("variant", "a").join(later, ["chr", "w"])
    pairs = pairs.where((F.col("pos_b") - F.col("pos") <= width) & ((F.col("pos_b") > F.col("pos")) | ((F.col("pos_b") == F.col("pos")) & (F.col("b") > F.col("a")))))
    pairs = pairs.select("chr", "a", "b", F.least("k", "k_b").alias("lo"), F.greatest("k", "k_b").alias("hi"))

    block = lambda k: F.floor(F.col(k) / BLOCK)
    code = (F.col("lo") % BLOCK * BLOCK + F.col("hi") % BLOCK).cast("int")
    needed = pairs.select("lo", "hi").distinct().select(block("lo").alias("left"), block("hi").alias("right"), code.alias("i"))
    tasks = needed.select("left", "right").distinct()
    sides = tasks.select(F.col("left").alias("block"), "left", "right", F.lit(0).alias("side")).unionAll(tasks.where("left < right").select("right", "left", "right", F.lit(1)))
    cells = cells.join(places, "column").select(F.pmod(F.xxhash64("iid"), F.lit(chunks)).alias("chunk"), block("k").alias("block"), (F.col("k") % BLOCK).cast("int").alias("i"), "iid", "d")
    cells = cells.join(F.broadcast(sides), "block").select("chunk", "left", "right", "side", "i", "iid", "d")
    asked = needed.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "left", "right", F.lit(2).alias("side"), "i", F.lit(None).cast("string"), F.lit(None).cast("double"))

    def moments(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side, place = (t.column(c).to_numpy() for c in ("side", "i"))
        left, right, asked = t.column("left")[0].as_py(), t.column("right")[0].as_py(), place[side == 2]
        # Of several dosages of one sample the highest counts.
        t = t.filter(pa.array(side < 2)).sort_by("d").combine_chunks()
        side, place, d = (t.column(c).to_numpy() for c in ("side", "i", "d"))
        row = t.column("iid").combine_chunks().dictionary_encode().indices.to_numpy() if len(t) else np.zeros(0, np.int32)
        sets = []
        for k in range(1 + (left < right)):
            x, seen = np.zeros((2, row.max(initial=-1) + 1, BLOCK))
            at = side == k
            x[row[at], place[at]], seen[row[at], place[at]] = d[at], 1.0
            sets.append((x, seen))
        (x, sx), (y, sy), (i, j) = sets[0], sets[-1], divmod(asked, BLOCK)
        found = [sx.T @ sy, x.T @ sy, sx.T @ y, (x**2).T @ sy, sx.T @ y**2, x.T @ y]
        return pa.table([pa.array(left * BLOCK + i, pa.int64()), pa.array(right * BLOCK + j, pa.int64()), *(pa.array(m[i, j]) for m in found)], ["lo", "hi", *SUMS])

    parts = cells.unionAll(asked).groupBy("chunk", "left", "right").applyInArrow(moments, "lo long, hi long, " + ", ".join(f"{s} double" for s in SUMS))
    n, sx, sy, sxx, syy, sxy = (F.sum(s) for s in SUMS)
    vx, vy, vxy = n * sxx - sx * sx, n * syy - sy * sy, n * sxy - sx * sy
    r2 = parts.groupBy("lo", "hi").agg(F.when((vx > 1e-9) & (vy > 1e-9), vxy * vxy / (vx * vy)).alias("r2"))
    return pairs.join(r2, ["lo", "hi"], "left").select("chr", "a", "b", "r2")


#: Over the samples that have both dosages: their number, and sums of the first, the second, their squares and their products.
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def clump(variants: DataFrame, pairs: DataFrame, r2: float = 0.75, p1: float = 1.0, p2: float = 1.0) -> DataFrame:
    """(chr, index_variant, variant): greedy clumps of variants (variant, chr, p) by ascending p.

    A variant that isn't clumped yet and has p <= p1 is an index; it takes the variants with p <= p2 that a pair with
    at least ``r2`` ties to it.  One group a chromosome, which holds its variants and strong pairs only.
    """
    strong = pairs.where(F.col("r2") >= r2).selectExpr("chr", "a", "b")
    ties = strong.unionAll(strong.selectExpr("chr", "b a", "a b")).groupBy("chr", "a").agg(F.sort_array(F.collect_list("b")).alias("near"))
    rows = variants.join(ties.withColumnRenamed("a", "variant"), ["chr", "variant"], "left").select("chr", "variant", "p", "near")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "variant"])
        p = dict(zip(pdf["variant"], pdf["p"], strict=True))
        taken, out = set(), []
        for v, pv, near in zip(pdf["variant"], pdf["p"], pdf["near"], strict=True):
            if v in taken or pv > p1:
                continue
            own = [v, *(u for u in (near if near is not None else []) if u not in taken and u != v and p.get(u, 2.0) <= p2)]
            taken.update(own)
            out += [(v, u) for u in own]
        return pd.DataFrame({"chr": pdf["chr"].iloc[0], "index_variant": [x[0] for x in out], "variant": [x[1] for x in out]})

    kinds = dict(rows.dtypes)
    return rows.groupBy("chr").applyInPandas(greedy, f"chr {kinds['chr']}, index_variant {kinds['variant']}, variant {kinds['variant']}")


def index_variants(clumps: DataFrame) -> DataFrame:
    """The list of variants that clumping keeps."""
    return clumps.select("index_variant").distinct()


def shuffled_order(df: DataFrame, key: str = "iid", seed: str | int = 0) -> Column:
    """Sort key of a seeded permutation."""
    return seeded(seed, df[key])


def split_ids(df: DataFrame, share: float, key: str = "iid", seed: str | int = 0) -> DataFrame:
    """``df`` with split 'train' for exactly round(share * n) rows, else 'test'.

    The rank comes from a histogram of the first 16 bits of the permutation's key, so only one bin is ranked by a window.
    """
    rows = df.withColumn("_k", seeded(seed, F.col(key))).withColumn("_b", F.substring("_k", 1, 4))
    bins = sorted((r["_b"], r["count"]) for r in rows.groupBy("_b").count().collect())  # 65536 at most
    want, at, edge = round(share * sum(c for _, c in bins)), 0, None
    for b, c in bins:
        if at + c > want:
            edge = b
            break
        at += c
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_k", key))
    inside = rows.withColumn("_r", F.when(F.col("_b") == F.lit(edge), rank)) if edge is not None else rows.withColumn("_r", F.lit(None).cast("int"))
    train = (F.col("_b") < F.lit(edge)) | ((F.col("_b") == F.lit(edge)) & (F.col("_r") <= want - at)) if edge is not None else F.lit(True)
    return inside.withColumn("split", F.when(train, "train").otherwise("test")).drop("_k", "_b", "_r")


def wide_to_long(samples: DataFrame, col: str = "x") -> DataFrame:
    """(iid, variant, dosage): for up to some thousand variants; wider matrices stay arrays."""
    return samples.select("iid", F.posexplode(col).alias("variant", "dosage"))


def dosage_of(x: Column, t: float) -> Column:
    return F.when(x < -t, 0.0).when(x > t, 2.0).otherwise(1.0)


def bed_decode(raw: bytes, n: int) -> np.ndarray:
    """Dosages of the first allele of n samples from 2-bit codes, lowest bits first; -1 is missing."""
    codes = np.frombuffer(raw, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    return np.array([2, -1, 1, 0], np.int8)[codes.ravel()[:n]]
