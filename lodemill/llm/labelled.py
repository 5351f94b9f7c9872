"""Bounded samples of labelled documents, for training on the driver, and scores of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.llm.common import Scratch, cuts

#: The texts of a sample come to the driver in parts of about so many bytes, so that its JVM never holds them all.
PART_BYTES = 8 << 20


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the doc_id in decimal, modulo m; null for null."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % m


def sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, per_class: int, longest: int) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) of label 0 and of label 1, in a fixed order that doesn't depend on the partitions.

    Rows without a label, text or doc_id, with contradicting labels, or with a text of over ``longest`` characters
    teach nothing; twice as many labels are drawn, so that others take their place.  Of a repeated doc_id the least text
    teaches.  The labels drawn, and so the texts that come to the driver, are bounded by ``per_class``;
    they come part by part, and only those that teach.
    """
    clean = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & may_learn).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y1")).where("y = y1")
    order = F.md5(F.concat(F.lit(f"{label}|"), F.col("doc_id").cast("string")))
    clean = clean.select("doc_id", "y", order.alias("place"))
    drawn = [clean.where(F.col("y") == y).orderBy("place", "doc_id").limit(2 * per_class) for y in (0, 1)]
    rows = docs.select("doc_id", "text").where(F.length("text") <= longest).join(F.broadcast(drawn[0].unionAll(drawn[1])), "doc_id").groupBy("doc_id", "y", "place").agg(F.min("text").alias("text"))
    scratch = Scratch(docs.sparkSession, "sample")
    rows = scratch.save(rows, label)
    found = sorted((r.place, r.doc_id, r.y, r.size) for r in rows.select("place", "doc_id", "y", F.octet_length("text").alias("size")).collect())
    kept = [[r for r in found if r[2] == y][:per_class] for y in (0, 1)]
    last = [(y, *of[-1][:2]) for y, of in enumerate(kept) if of]
    kept = sorted(kept[0] + kept[1])
    texts = {}
    if kept:
        part = rows
        for y, place, doc_id in last:  # none after the last that is kept
            part = part.where((F.col("y") != y) | (F.col("place") < place) | ((F.col("place") == place) & (F.col("doc_id") <= doc_id)))
        part = part.select("doc_id", "text").repartition(1 + sum(r[3] for r in kept) // PART_BYTES, "doc_id")
        texts = {r.doc_id: r.text for r in part.toLocalIterator()}
    scratch.drop(rows)
    return [(texts[doc_id], y) for _, doc_id, y, _ in kept]


def text_score(model, rows: int = 256, size: int = 1 << 20):
    """Function of a text column: ``model.scores`` of its texts, null counting as empty.

    Only the texts go to Python, and only numbers come back; all other columns stay in the JVM.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [np.clip(model.scores([t or "" for t in part.to_pylist()]), 0, 1) for part in cuts(batch, rows, size)]
            yield pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())

    return score
