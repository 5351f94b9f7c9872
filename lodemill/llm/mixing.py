"""Operator 5: mixing sources to target weights by weighted sampling without replacement.

Each document draws an exponential key divided by its quality weight (Efraimidis and Spirakis, 2006); within a source
the documents stand in order of their keys.  A source first takes whole epochs, then the documents of the smallest
keys up to what is left of its budget.  The prefix sums that find the last document are taken over a tree of key
ranges, 256 at a time, so no task sorts a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodemill.llm.common import Scratch, prefix_sums

LEVELS, FAN = 3, 256


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def quality_weight(text: Column, words: Column) -> Column:
    """0.05 to 1: the share of letters among the characters, times the share of distinct words."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))
    distinct = F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    return F.lit(0.05) + F.lit(0.95) * F.coalesce(letters, F.lit(0.0)) * distinct


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, with u in (0, 1) from 52 bits of md5(seed|doc_id|md5(text)); null counts as ''.

    The text is part of it, so that rows without a doc_id, or with a repeated one, don't all stand in one place.
    """
    own = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.md5(own), 1, 13), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / weight


def drawn(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``docs`` with src (the source; '~' stands for null), size and key, and its own columns under ``doc``."""
    words = word_list(F.col("doc.text"))
    src = F.when(F.col("doc.source").isNull(), "~").otherwise(F.concat(F.lit("="), "doc.source"))
    return (
        docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
        .select("doc", src.alias("src"), words.alias("w"))
        .select("doc", "src", F.size("w").cast("long").alias("size"), sampling_key(F.col("doc.doc_id"), F.col("doc.text"), quality_weight(F.col("doc.text"), F.col("w")), seed).alias("key"))
    )


def source_targets(base: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(src, source_size, target) of each source; sources in code point order, null last, weigh ``weights`` in turn.

    Water-filling: targets are ``level * weight``, but at most ``most`` times the size; sources in order of the level
    at which they are full, the level is right after the last full one.  Places and sums go by ranges of sources, so
    there may be as many sources as there are hosts.
    """
    t = scratch.save(base.groupBy("src").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1)), "sizes")
    t = prefix_sums(t, ["src"], {"place": "one"}, scratch)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place").cast("long") % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    t = scratch.save(prefix_sums(t, ["fill", "src"], {"full": "cap", "past": "weight"}, scratch), "filled")
    total = t.agg(F.sum("source_size").cast("double").alias("size"), F.sum("weight").cast("double").alias("weight")).first()
    size, weight = total["size"] or 0.0, total["weight"] or 0.0
    t = t.withColumn("level", (F.lit(share) * F.lit(size) - F.col("full")) / (F.lit(weight) - F.col("past")))
    # The level of the first source that isn't full at the level that holds if all before it are.
    level = t.where(F.col("level") <= F.col("fill")).agg(F.min_by("level", F.struct("fill", "src"))).first()[0]
    return t.select("src", "source_size", F.least("cap", F.lit(float("inf") if level is None else level) * F.col("weight")).alias("target"))


def _range_no(key: Column, level: int) -> Column:
    """Number of the key's range at ``level``; 1 - 1 / (1 + key) grows with the key and stays below 1 for every key there is.

    It leaves room for the large keys of low weights: a unit of key at 700 still has 34 ranges of the last level.
    """
    return F.floor((F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + key)) * float(FAN**level)).cast("long")


def cut_points(base: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, source_size, target, epochs, last_key, last_doc, last_size): which documents a source takes once more.

    A document is one of those if its key, doc_id and size aren't above the last one's; all null: none is.
    """
    left = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    left = scratch.save(left.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("at", F.lit(0).cast("long")), "targets")
    found, todo = left, left.select("src", "rest", "at")
    for level in range(1, LEVELS + 1):
        inner = base.join(todo.select("src", "at"), (base.src == todo.src) & (_range_no(base.key, level - 1) == todo["at"])).select(base.src, base.size, _range_no(base.key, level).alias("no"))
        sums = inner.groupBy("src", "no").agg(F.sum("size").alias("size"))
        before = F.sum("size").over(W.partitionBy("src").orderBy("no").rowsBetween(W.unboundedPreceding, -1))
        sums = sums.withColumn("before", F.coalesce(before, F.lit(0)))
        # The last range that begins within the budget holds the last document.
        at = sums.join(todo.select("src", "rest"), "src").where(F.col("before") <= F.col("rest")).groupBy("src").agg(F.max(F.struct("no", "before")).alias("m"))
        todo = scratch.save(todo.select("src", "rest").join(at, "src").select("src", (F.col("rest") - F.col("m.before")).alias("rest"), F.col("m.no").alias("at")), "range")
    last = base.join(todo, (base.src == todo.src) & (_range_no(base.key, LEVELS) == todo["at"])).select(base.src, "key", "doc_id", "size", "rest")
    order = W.partitionBy("src").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    last = last.withColumn("before", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    last = last.where(F.col("before") + F.col("size") / 2 <= F.col("rest")).groupBy("src").agg(F.max(F.struct("key", "doc_id", "size")).alias("last"))
    return scratch.save(found.drop("at", "rest").join(todo.select("src", "at"), "src", "left").join(last, "src", "left"), "cuts")


def taken_times(cuts_at: Column) -> Column:
    """How often a document is taken, from its key, doc_id, size and its source's cut."""
    range_, last = _range_no(F.col("key"), LEVELS), F.col("last")
    own = F.struct("key", "doc_id", "size")
    once = (range_ < cuts_at) | ((range_ == cuts_at) & last.isNotNull() & (own <= last))
    return F.col("epochs") + F.coalesce(once, F.lit(False)).cast("long")


def _cut(spark, base: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "mix")
    small = scratch.save(drawn(base, seed).select("doc.doc_id", "src", "size", "key"), "drawn")
    return small, cut_points(small, scratch.save(source_targets(small, scratch), "sources"), scratch)


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs(doc_id, text, source)``.

    Size is the number of words, 0 for null text; null is a source of its own, the last.  The key comes from doc_id and
    text, so only whole copies, of both, are taken alike.  Sources without words, and empty tables, take nothing; a very
    long text is one document, taken or not.  Other columns are not read.
    """
    small, cuts = _cut(docs.sparkSession, docs.select("doc_id", "text", "source"), seed)
    return small.join(cuts, "src").select("doc_id", "size", "source_size", "target", (F.col("size") * taken_times(F.col("at"))).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows of ``docs``, all columns as they are, each as often as the mix takes it, copies side by side.

    Documents without words, null text among them, are taken as often as there are epochs.
    """
    cuts = _cut(docs.sparkSession, docs.select("doc_id", "text", "source"), seed)[1]
    rows = drawn(docs, seed).join(cuts, "src").select("doc", F.col("doc.doc_id").alias("doc_id"), "key", "size", "at", "epochs", "last")
    rows = rows.select("doc", F.explode(F.array_repeat(F.lit(1), taken_times(F.col("at")).cast("int"))))
    return rows.select("doc.*")


def oracle(table: str = "documents", seed: str = "mix") -> str:
    """DuckDB SQL of ``mix``: one sort of each source."""
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS src,
                      list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}),
    b AS (SELECT doc_id, src, len(w)::BIGINT AS size,
                 -ln((('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(text)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
                 / (0.05 + 0.95 * (length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / greatest(length(text), 1)) * (len(list_distinct(w)) / greatest(len(w), 1))) AS key FROM d),
    s AS (SELECT src, sum(size)::BIGINT AS source_size FROM b GROUP BY src),
    r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
    f AS (SELECT *, cap / weight AS fill FROM r),
    g AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER (ORDER BY fill, src) - cap))
                    / (sum(weight) OVER () - sum(weight) OVER (ORDER BY fill, src) + weight) AS level FROM f),
    t AS (SELECT src, source_size, least(cap, coalesce((SELECT level FROM g WHERE level <= fill ORDER BY fill, src LIMIT 1), 'inf'::DOUBLE) * weight) AS target FROM g),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
    p AS (SELECT b.*, source_size, target, epochs, target - epochs * source_size AS rest,
                 sum(size) OVER (PARTITION BY b.src ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before FROM b JOIN e ON b.src = e.src)
    SELECT doc_id, size, source_size, target::DOUBLE AS target, (size * (epochs + CASE WHEN before + size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM p"""
