"""Column expressions shared by the operators."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodemill.functions.arrays import take


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol * |b|."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def rsid(name: Column) -> Column:
    """Variant name before its first underscore."""
    return F.substring_index(name, "_", 1)


def seeded(seed: str | int, *cols: Column) -> Column:
    """md5 of seed|a|b...: the order of every deterministic draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def pick(x: Column, index: list[int]) -> Column:
    """Elements of an array at ascending 0-based places."""
    return take(x, sorted(index))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def platt(p: Column, a: float, b: float) -> Column:
    """Calibrated probability of a score."""
    return sigmoid(F.lit(float(a)) + F.lit(float(b)) * p)


def binomial_tails(most: int, p: float = 0.5) -> list[tuple[int, int, float, float]]:
    """(n, h, P(B >= h), P(B <= h)) for B ~ Bin(n, p), all 0 <= h <= n <= most: exact sums of at most n + 1 terms."""
    out = []
    for n in range(most + 1):
        mass = [comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        out += [(n, h, min(1.0, sum(mass[h:])), min(1.0, sum(mass[: h + 1]))) for h in range(n + 1)]
    return out


def parse_bool(text: str | bool) -> bool:
    """True and False, and their usual words in any case; all else is an error."""
    if isinstance(text, bool):
        return text
    word = str(text).strip().lower()
    if word in ("true", "t", "yes", "y", "1"):
        return True
    if word in ("false", "f", "no", "n", "0"):
        return False
    raise ValueError(f"not a boolean: {text!r}")


def none_if_none(text):
    """None for the words none, null and the empty string."""
    return None if text is None or str(text).strip().lower() in ("none", "null", "") else text


SPARK_TYPES = {"float16": "float", "float32": "float", "float64": "double"}


def spark_type(dtype: str) -> str:
    """Spark type that holds a numeric type name; there is no half float."""
    if dtype not in SPARK_TYPES:
        raise ValueError(f"unknown dtype {dtype!r}, expected one of {sorted(SPARK_TYPES)}")
    return SPARK_TYPES[dtype]


def check_shape(found: tuple, expected: tuple) -> None:
    if tuple(found) != tuple(expected):
        raise ValueError(f"expected shape {tuple(expected)}, found {tuple(found)}")


def with_row_index(df: DataFrame, *order: str, name: str = "row_idx", partitions: int | None = None) -> DataFrame:
    """``df`` with 0-based places in ``order``: range partitions are sorted on their own and offset by prefix sums.

    One count for each partition comes to the driver; no window runs over all rows.  The sorted rows are persisted, so
    that counts and places see the same partitions.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")).persist()
    at, starts = 0, []
    for p, k in sorted((r["_p"], r["count"]) for r in rows.groupBy("_p").count().collect()):
        starts += [F.lit(p), F.lit(at)]
        at += k
    start = F.try_element_at(F.create_map(*starts), F.col("_p")) if starts else F.lit(0)
    return rows.select(*df.columns, (start.cast("long") + F.col("_i")).alias(name))


def average_rank(value: str, by: list[str] | None = None, cond: Column | None = None) -> Column:
    """Ascending rank with ties at their mean; null for null values."""
    part = list(by or [])
    w = W.partitionBy(*part, F.col(value).isNull()).orderBy(value)
    ties = W.partitionBy(*part, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0)
