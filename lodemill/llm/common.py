"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word in the sense of the contracts: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a new temporary folder serves a local session; on a cluster, where executors have other disks,
    that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodemill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def tasks_for(df: DataFrame, bytes_each: int = 128 << 20, most: int = 100_000) -> int:
    """Tasks for a shuffle of the rows: the session's number, or more where the optimizer's estimate of their size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, -(-size // bytes_each)))


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    What is left goes when the session ends, or earlier by ``sweep``.
    """

    _roots: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/lodemill-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        fs, path = _hadoop(spark, self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        Scratch._roots.append((spark, self.root))

    @staticmethod
    def mark() -> int:
        return len(Scratch._roots)

    @staticmethod
    def sweep(mark: int) -> None:
        """Removes the folders made since ``mark``: only after all that reads them has been written elsewhere."""
        for spark, root in Scratch._roots[mark:]:
            _remove(spark, root)
        del Scratch._roots[mark:]

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _remove(self.spark, df._scratch_path)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # what can't be removed now goes with the session
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], scratch: Scratch) -> DataFrame:
    """``df`` with a column for each of ``sums`` (name: column): the sum over all rows before, in ``order``.

    Ranges of rows are sorted and summed on their own; one row for each range comes to the driver.
    """
    n = tasks_for(df)
    rows = df.repartitionByRange(n, *order).select("*", F.spark_partition_id().alias("_range"))
    rows = scratch.save(rows, "ranges")
    at, starts = dict.fromkeys(sums, 0), []
    for r in sorted(rows.groupBy("_range").agg(*[F.sum(c).alias(k) for k, c in sums.items()]).collect(), key=lambda r: r["_range"]):
        starts.append((r["_range"], *(float(v) for v in at.values())))
        at = {k: v + (r[k] or 0) for k, v in at.items()}
    start = df.sparkSession.createDataFrame(starts, "_range int, " + ", ".join(f"_{k} double" for k in sums))
    own = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumns({k: F.coalesce(F.sum(c).over(own).cast("double"), F.lit(0.0)) for k, c in sums.items()}).join(F.broadcast(start), "_range")
    return out.select(*df.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in sums])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col):
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(col, UPPER, LOWER)


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library, which keeps less
        return lambda _: None


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on between tasks, and beside each other."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def cuts(data, rows: int = 512, size: int = 4 << 20) -> Iterator:
    """An Arrow batch or array, cut where ``rows`` rows or, by the lengths of its longest column, ``size`` bytes are reached.

    A row of more bytes stands alone.
    """
    n, columns = len(data), data.columns if isinstance(data, pa.RecordBatch) else [data]
    texts = [c for c in columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    ends = np.cumsum(sum(pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)) if texts else np.full(n, data.nbytes) * np.arange(1, n + 1) // max(1, n)
    lo = given = 0
    while lo < n:
        before = ends[lo - 1] if lo else 0
        hi = min(n, lo + rows, max(lo + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield data.slice(lo, hi - lo)
        lo = hi
        if ends[lo - 1] - given > 4 << 20 or lo == n:
            given = ends[lo - 1]
            give_back()


def slices(batches: Iterator, rows: int = 512, size: int = 4 << 20) -> Iterator:
    """All batches, cut as in ``cuts``."""
    for batch in batches:
        yield from cuts(batch, rows, size)
