"""Operator 8: fingerprints by locally consistent parsing.

A text's symbols are named phrase by phrase, level over level.  Deterministic coin tossing turns each symbol into a
small label that depends on a few symbols before it alone (the lowest bit in which it differs from its neighbour, and
that bit, again and again); phrases begin where a label is a local minimum.  So equal substrings are cut alike but for
a few symbols at their ends, wherever they stand, and their inner phrases get equal names.  The fingerprint holds, for
each of some levels, one-permutation minima of the names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm.common import slices

#: Levels in the fingerprint with their weights in likeness (phrases of about 4, 12, 40 and 120 characters), minima for each.
LEVELS, MINIMA = {1: 0.1, 2: 0.3, 3: 0.3, 4: 0.3}, 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _A)]))


def coin_toss(sym: np.ndarray, first: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Labels below 8 of symbols whose neighbours differ; ``first`` marks those that begin a text."""
    one = np.uint64(1)
    for _ in range(rounds):
        diff = sym.copy()
        diff[1:] ^= sym[:-1]
        diff[first] = one
        low = np.bitwise_count((diff & (~diff + one)) - one).astype(np.uint64)
        sym = (low << one) | ((sym >> low) & one)
    return sym.astype(np.int8)


def next_level(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of one level, and the text that each belongs to (ascending)."""
    if not len(sym):
        return sym, doc
    # A run of one symbol becomes one symbol, so that neighbours differ.
    new = np.ones(len(sym), bool)
    new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    if len(start) < len(sym):
        count = np.diff(start, append=len(sym))
        sym, doc = sym[start], doc[start]
        run = count > 1
        sym[run] = _mix(sym[run] + _mix(count[run].astype(np.uint64)))
    first = np.ones(len(sym), bool)
    first[1:] = doc[1:] != doc[:-1]
    label = coin_toss(sym, first)
    cut = first.copy()
    cut[1:-1] |= (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:]) & ~first[2:]
    start = np.flatnonzero(cut)
    size = np.diff(start, append=len(sym))
    power = _powers(int(size.max()))
    place = np.arange(len(sym)) - np.repeat(start, size)
    return _mix(np.add.reduceat(_mix(sym) * power[place], start)), doc[start]


def _minima(names: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """MINIMA 16-bit values of each of n texts; empty bins borrow from the next full one, marked with the distance.  Texts without names have zeros."""
    h = _mix(names ^ _A)
    key = doc.astype(np.int64) * MINIMA + (h & np.uint64(MINIMA - 1)).astype(np.int64)
    full = np.full(n * MINIMA, 1 << 62, np.uint64)
    np.minimum.at(full, key, h >> np.uint64(8))
    full = full.reshape(n, MINIMA)
    empty = full == np.uint64(1 << 62)
    out = full.copy()
    for d in range(1, MINIMA):
        if not empty.any():
            break
        take = np.roll(full, -d, 1)
        ok = empty & (take != np.uint64(1 << 62))
        out[ok] = _mix(take[ok] + np.uint64(d))
        empty &= ~ok
    out[empty] = 0
    low = (out & np.uint64(0xFFFF)).astype(np.uint16)
    return np.where(empty, np.uint16(0), np.maximum(low, 1))


def prints(texts: list[str]) -> np.ndarray:
    """One row of 16-bit values for each text; zeros for empty ones."""
    size = np.array([len(t) for t in texts], np.int64)
    sym = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    names, out = _mix(sym.astype(np.uint64) + np.uint64(1)), []
    for level in range(1, max(LEVELS) + 1):
        names, doc = next_level(names, doc)
        if level in LEVELS:
            out.append(_minima(names, doc, len(texts)))
    return np.hstack(out) if texts else np.zeros((0, MINIMA * len(LEVELS)), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of prints: twice the shared part over the sum, estimated from the minima; 1 for two empty texts, 0 for one."""
    same = (a == b) & (a > 0)
    j = sum(w * same[:, i * MINIMA : (i + 1) * MINIMA].mean(1) for i, w in enumerate(LEVELS.values()))
    both_empty = ~a.any(1) & ~b.any(1)
    return np.where(both_empty, 1.0, np.minimum(1.0, 2 * j / (1 + j)))


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by the first as many code points of the following text, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _placed(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, head, doc_id, key, text): each partition a range of doc_ids, and once more, as head, the first row of the range after it.

    Only doc_ids are looked at for that; at most one for each partition comes to the driver.
    """
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    keys = rows.select("key")
    bounds = np.unique(np.array(keys.approxQuantile("key", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else [], float).astype(np.int64))

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="left"), dtype="int32")

    heads = sorted((r.part, r.key) for r in keys.withColumn("part", part_of("key")).groupBy("part").agg(F.min("key").alias("key")).collect())
    rows = rows.withColumn("part", part_of("key")).withColumn("head", F.lit(False))
    if not heads:
        return rows
    after = [(heads[(i + 1) % len(heads)][1], part) for i, (part, _) in enumerate(heads)]
    spark = docs.sparkSession
    again = rows.drop("part", "head").join(F.broadcast(spark.createDataFrame(after, "key long, part int")), "key").withColumn("head", F.lit(True))
    return rows.unionByName(again)


def fingerprint_documents(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs(doc_id, text)``.

    Null text counts as empty; null doc_id comes first, rows of equal doc_id stand in order of their texts, each the
    next of the one before.  A lone row is its own next.  Fingerprints are hexadecimal; empty texts have zeros.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def digest(ids: list, texts: list[str]) -> pa.RecordBatch:
        """The last text is only the next of the one before it."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        p, q = prints(texts), prints(changed)
        show = lambda rows: [r.astype(">u2").tobytes().hex() for r in rows]
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
        cols = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(sha), pa.array(show(p[:-1])), pa.array(show(q)), pa.array(likeness(p[:-1], q)), pa.array(likeness(p[:-1], p[1:]))]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, head = [], [], None
        for b in slices(batches, 512, 1 << 20):
            for i, t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not h:
                    ids.append(i)
                    texts.append(t)
                elif head is None:
                    head = t
            if len(texts) > 1:
                yield digest(ids[:-1], texts)
                ids, texts = ids[-1:], texts[-1:]
        if texts:
            yield digest(ids, [*texts, texts[0] if head is None else head])

    rows = _placed(docs, n).repartitionById(n, "part").sortWithinPartitions("head", "key", "text").select("doc_id", "text", "head")
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
