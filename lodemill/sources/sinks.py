"""Writers: the Parquet container, models, tables of scores and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.operators.boosting import Booster
from lodemill.operators.relational import check_samples


def write_container(samples: DataFrame, variants: DataFrame, path: str, partitions: int | None = None, check: bool = True) -> tuple[int, int]:
    """Sorted by row_idx, so that folds prune row groups; read back and measured."""
    n = partitions or int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    samples.repartitionByRange(n, "row_idx").sortWithinPartitions("row_idx").write.mode("overwrite").parquet(f"{path}/samples")
    variants.coalesce(1).write.mode("overwrite").parquet(f"{path}/variants")
    spark = samples.sparkSession
    return check_samples(spark.read.parquet(f"{path}/samples"), spark.read.parquet(f"{path}/variants")) if check else (-1, -1)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header, sep=sep)


def write_ids(df: DataFrame, path: str, key: str = "iid", family: str | None = None) -> None:
    """One id a line, or family and id with a tab."""
    cols = [family, key] if family else [key]
    df.select(*cols).write.mode("overwrite").csv(path, sep="\t", header=False)


def write_booster(spark, booster: Booster, path: str) -> None:
    spark.createDataFrame([(booster.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def predictions(df: DataFrame, y: str = "y", pred: str = "y_pred", platt: tuple[float, float] | None = None) -> DataFrame:
    """(iid, y_true, y_pred, y_pred_platt_scaled); the last is null without a curve, y_true is the plain label."""
    from lodemill.functions.columns import platt as curve

    scaled = curve(F.col(pred), *platt) if platt else F.lit(None).cast("double")
    return df.select("iid", F.col(y).alias("y_true"), F.col(pred).alias("y_pred"), scaled.alias("y_pred_platt_scaled"))


def write_selected(variants: DataFrame, support: list[bool], path: str, kind: str) -> bool:
    """rsids of the selected variants, without allele; nothing is written if there are none."""
    at = [i for i, s in enumerate(support) if s]
    if not at:
        return False
    chosen = variants.sparkSession.createDataFrame([(i,) for i in at], "variant_idx int")
    variants.join(chosen, "variant_idx").select(F.substring_index("name", "_", 1)).write.mode("overwrite").text(f"{path}/{kind}_rsids")
    return True
