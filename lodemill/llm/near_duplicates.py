"""Operator 4: near-duplicates by MinHash with banding, signature verification and exact confirmation.

1. Every document's set of shingle hashes gives its exact class and BANDS band keys of ROWS minima each.  Only class
   representatives (the smallest doc_id) go on.
2. In every band bucket all members are paired with one leader: stars, never all pairs.  Those pairs that pass the size
   and the signature test are confirmed on full sets.  Connected components of the links.
3. A link between members of one bucket may have missed its star.  Buckets that hang together, by all their pairs and
   not only those of like size, form groups; where a group still holds more than one component, its members outside the
   largest one are compared with all the group's members, packed in blocks of bounded size: by signature, then on full
   sets.  Nothing is capped.
4. Components of the components that those links join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm.common import Scratch, slices, tasks_for
from lodemill.llm.star_components import components

BANDS, ROWS, SHINGLE = 36, 8, 5
#: A pair is a link if 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Signatures that agree in fewer places are those of a link with probability below 1e-7 (5.5 standard deviations).
MARGIN = 5.5
BLOCK_BYTES = 2 << 20
#: Up to so many ids are broadcast to pick texts; more are joined.
BROADCAST_IDS = 2_000_000

_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _A
    x = (x ^ (x >> _U(29))) * _B
    return x ^ (x >> _U(32))


def _families(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n universal hash functions x -> a x + b modulo 2^64."""
    seed = _mix(np.arange(1, 2 * n + 1, dtype=_U) * _B)
    return seed[:n] | _U(1), seed[n:]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the number of each text's (in order).

    Words are runs without ASCII white space, A-Z lower-cased.
    """
    n = len(texts)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, _U), np.zeros(n, np.int64)
    size = stop - start
    byte = raw[inside].astype(_U) + _U(1)
    first = np.cumsum(size) - size
    place = np.arange(len(byte)) - np.repeat(first, size)
    power = np.cumprod(np.concatenate([[_U(1)], np.full(int(size.max()) - 1, _A)]))
    word = _mix(np.add.reduceat(_mix(byte) * power[place], first) + size.astype(_U))
    doc = np.searchsorted(ends, start, side="right")
    per = np.bincount(doc, minlength=n)
    at = np.cumsum(per) - per
    # A shingle begins at every word that has SHINGLE - 1 more in its text, or at the first word of a shorter text.
    rank = np.arange(len(word)) - at[doc]
    count = np.minimum(per[doc], SHINGLE)
    begins = np.flatnonzero(rank + count <= per[doc]) if len(word) else np.empty(0, int)
    begins = begins[(per[doc[begins]] >= SHINGLE) | (rank[begins] == 0)]
    value = count[begins].astype(_U) * _B
    for k in range(SHINGLE):
        ok = k < count[begins]
        value[ok] = (value[ok] + word[begins[ok] + k]) * _A
        value[ok] ^= value[ok] >> _U(29)
    value, doc = _mix(value), doc[begins]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=n)


def minima(values: np.ndarray, count: np.ndarray, hashes: int) -> np.ndarray:
    """One row of minima for each text with shingles; ``count`` has no zeros."""
    a, b = _families(hashes)
    out = np.empty((hashes, len(count)), _U)
    first = np.cumsum(count) - count
    for k in range(hashes):
        out[k] = np.minimum.reduceat(values * a[k] + b[k], first)
    return out.T


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.empty((len(sig), BANDS), _U)
    for k in range(BANDS):
        h = np.full(len(sig), _U(k + 1)) * _B
        for r in range(ROWS):
            h = _mix(h + sig[:, k * ROWS + r])
        out[:, k] = h
    return out.view(np.int64)


def _lists(values: np.ndarray, count: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(values, kind))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "k1", "k2", "sig", "bands"]
    for b in slices(batches, 256, 256 << 10):
        values, count = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()])
        full = count > 0
        keys, sig, bands = np.zeros((2, len(count)), _U), [None] * len(count), np.zeros((0, BANDS), np.int64)
        if full.any():
            first = (np.cumsum(count) - count)[full]
            keys[0, full] = _mix(np.add.reduceat(_mix(values), first))
            keys[1, full] = _mix(np.add.reduceat(_mix(values ^ _B), first))
            found = minima(values, count[full], BANDS * ROWS)
            bands = band_keys(found)
            low = (_mix(found) & _U(0xFF)).astype(np.uint8)
            for i, row in zip(np.flatnonzero(full), low, strict=True):
                sig[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(sig, pa.binary()), _lists(bands.ravel(), full * BANDS, pa.int64())], names)


def least_agreement(places: int) -> float:
    """Share of equal bytes that signatures of a link reach but with probability below 1e-7."""
    p = PERCENT / 100
    return p - MARGIN * (p * (1 - p) / places) ** 0.5


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, sig_a, sig_b): pairs whose signatures agree well enough."""
    least = least_agreement(BANDS * ROWS)
    for batch in slices(batches, 8192, 8 << 20):
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
        keep = pa.array((x == y).mean(1) >= least)
        yield batch.select([0, 1]).filter(keep)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, set_a, set_b): pairs that are links."""
    for batch in slices(batches, 1024, 16 << 20):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 256, 1 << 20):
        values, count = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()])
        ends = np.cumsum(count)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([values[e - c : e].tobytes() for c, e in zip(count, ends, strict=True)], pa.binary())], ["id", "set"])


def _pack(root: str):
    """Writes blocks of (g, probe, no, members) to one file a task; gives (g, probe, no, file, at, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = f"{uuid.uuid4().hex}.bin", None, 0
        fs, base = pafs.FileSystem.from_uri(root)
        rows = []
        for batch in batches:
            for lo in range(batch.num_rows):
                g, probe, no, members = (c[lo] for c in batch.columns)
                members = members.values.flatten() if len(members) else None
                c, sets = members[0].to_numpy().astype("<i8"), members[1].to_pylist()
                raw = b"".join([np.array([len(sets)], "<i8").tobytes(), c.tobytes(), np.array([len(x) // 8 for x in sets], "<i8").tobytes(), *sets])
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}")
                out.write(raw)
                rows.append((g.as_py(), probe.as_py(), no.as_py(), name, at, len(raw)))
                at += len(raw)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["g", "probe", "no", "file", "at", "length"])

    return run


def _block_links(root: str):
    """Of (same, file and place of left, of right): pairs of components that a link joins."""
    places = 128
    least = least_agreement(places)

    def load(fs, base: str, name: str, at: int, length: int):
        with fs.open_input_file(f"{base}/{name}") as f:
            f.seek(at)
            raw = np.frombuffer(f.read(length), np.int64)
        n = int(raw[0])
        c, count, flat = raw[1 : n + 1], raw[n + 1 : 2 * n + 1], raw[2 * n + 1 :].view(_U)
        sig = (_mix(minima(flat, count, places)) & _U(0xFF)).astype(np.uint8)
        return c, np.split(flat, np.cumsum(count)[:-1]), count, sig

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        last, left = None, None
        for batch in batches:
            for same, *where in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != where[:3]:
                    last, left = where[:3], load(fs, base, *where[:3])
                lc, lsets, lcount, lsig = left
                rc, rsets, rcount, rsig = left if same else load(fs, base, *where[3:])
                out = set()
                for i in range(len(lsets)):
                    small, large = np.minimum(rcount, lcount[i]), np.maximum(rcount, lcount[i])
                    ok = (rc != lc[i]) & (100 * small >= PERCENT * large)
                    if same:
                        ok[: i + 1] = False
                    at = np.flatnonzero(ok)
                    at = at[(rsig[at] == lsig[i]).mean(1) >= least]
                    if not len(at):
                        continue
                    flat = np.concatenate([rsets[j] for j in at])
                    found = np.minimum(np.searchsorted(lsets[i], flat), lcount[i] - 1)
                    first = np.cumsum(rcount[at]) - rcount[at]
                    both = np.add.reduceat((lsets[i][found] == flat).astype(np.int64), first)
                    hit = at[100 * both >= PERCENT * (lcount[i] + rcount[at] - both)]
                    out.update((int(lc[i]), int(rc[j])) for j in hit)
                pairs = sorted(out)
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return run


def _rest_links(pairs: DataFrame, links: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Components of the links of the stars, and the links between those components that the stars missed.

    Blocks of sets are written once; only their names and places are paired and shuffled.
    """
    c = scratch.save(components(links, scratch).withColumnRenamed("component", "c"), "linked")
    g = scratch.save(components(pairs, scratch).withColumnRenamed("component", "g"), "groups")
    members = scratch.save(g.join(c, "id", "left").select("id", "g", F.coalesce("c", "id").alias("c")), "members")
    sizes = members.groupBy("g", "c").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max(F.struct("n", "c")).alias("m")).where("k > 1 and n > 2").select("g", F.col("m.c").alias("most"))
    open_ = scratch.save(open_, "open")
    rows = members.join(open_, "g").select("id", "g", "c", (F.col("c") != F.col("most")).alias("probe"))
    rows = scratch.save(rows.join(sets, "id").select("g", "probe", "c", "id", "set"), "rest")
    total = scratch.save(rows.groupBy("g", "probe").agg((F.floor(F.sum(F.length("set") + 200) / BLOCK_BYTES) + 1).alias("blocks")), "totals")
    blocks = rows.join(total, ["g", "probe"]).withColumn("no", F.pmod(F.xxhash64("id", "c"), F.col("blocks")))
    blocks = blocks.groupBy("g", "probe", "no").agg(F.collect_list(F.struct("c", "set")).alias("members"))
    root = scratch.path("files")
    fs, base = pafs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)
    at = scratch.save(blocks.mapInArrow(_pack(root), "g long, probe boolean, no long, file string, at long, length long"), "blocks")
    right = at.selectExpr("g", "probe as other", "no as j", "struct(file, at, length) as right")
    grid = at.where("probe").selectExpr("g", "no as i", "struct(file, at, length) as left").join(right, "g").where("not other or j >= i")
    grid = grid.selectExpr("other and j = i as same", "left.*", "right.file as file2", "right.at as at2", "right.length as length2")
    found = grid.repartition(tasks_for(sets)).mapInArrow(_block_links(root), "a long, b long")
    return c, scratch.save(found.distinct(), "found")


def _ties(real: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between the classes of every doc_id that has several, so that its rows are one node; mostly none."""
    several = real.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi")).where("lo <> hi").select("doc_id")
    of = scratch.save(real.join(several, "doc_id").join(classes, ["k1", "k2"]).select("doc_id", "id").distinct(), "several")
    return of.join(of.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("a <> id").selectExpr("a", "id as b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs(doc_id, text)``.

    Rows of one doc_id are one node with all their texts' links.  Documents without words, null and empty text among
    them, and rows with null doc_id (component null, kept) are linked with nothing.  Very long texts are sets like any
    other, held one at a time.  Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats = scratch.save(text.mapInArrow(_features, "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"), "features")
    real = feats.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "classes")
    # A class' own row has three keys, so copies of a text don't meet in one task.
    own = (real["k1"] == classes["k1"]) & (real["k2"] == classes["k2"]) & (real["doc_id"] == classes["id"])
    nodes = real.join(classes, own).select("id", "n_shingles", "sig", "bands").dropDuplicates(["id", "n_shingles", "sig"])
    nodes = scratch.save(nodes, "nodes")
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    leaders = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("k"), F.min("id").alias("a")).where("k > 1").select("key", "a"), "leaders")
    # Whatever their sizes: two members that link may share buckets only with leaders that neither resembles in size.
    pairs = keyed.join(leaders, "key").where("id <> a").selectExpr("a", "id b").distinct()
    pairs = scratch.save(pairs, "pairs")
    scratch.drop(leaders)
    ids = scratch.save(pairs.selectExpr("a id").unionAll(pairs.selectExpr("b id")).distinct(), "ids")
    sig = nodes.select("id", F.col("n_shingles").alias("n"), "sig")
    alike = pairs.join(sig.selectExpr("id a", "n na", "sig sa"), "a").join(sig.selectExpr("id b", "n nb", "sig sb"), "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    alike = alike.select("a", "b", "sa", "sb").mapInArrow(_alike, "a long, b long").distinct()
    alike = scratch.save(alike, "alike")
    picked = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = text.withColumnRenamed("doc_id", "id").join(picked, "id", "left_semi").mapInArrow(_sets, "id long, set binary")
    sets = scratch.save(sets.where("length(set) > 0").dropDuplicates(["id", "set"]), "sets")
    links = alike.join(sets.selectExpr("id b", "set sb"), "b").join(sets.selectExpr("id a", "set sa"), "a").select("a", "b", "sa", "sb").mapInArrow(_links, "a long, b long")
    links = scratch.save(links.unionAll(_ties(real, classes, scratch)), "links")
    linked, found = _rest_links(pairs, links, sets, scratch)
    scratch.drop(sets)
    joined = scratch.save(components(found, scratch).selectExpr("id c", "component final"), "joined")
    of_class = classes.join(linked, "id", "left").withColumn("c", F.coalesce("c", "id")).join(joined, "c", "left").select("k1", "k2", "n", F.coalesce("final", "c").alias("component_id"))
    return _spread(feats.select("doc_id", "n_shingles", "k1", "k2"), scratch.save(of_class, "component"))


def _spread(rows: DataFrame, of_class: DataFrame, share: int = 200) -> DataFrame:
    """The component of every row.  Classes with more than 1 / ``share`` of all rows, ``share`` at most, are broadcast; rows without a class need none."""
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    least = (of_class.agg(F.sum("n")).first()[0] or 0) / share
    names = ["doc_id", "n_shingles", "component_id"]
    large, small = of_class.where(F.col("n") > least).drop("n"), of_class.where(F.col("n") <= least).drop("n")
    in_large = rows.where(linkable).join(F.broadcast(large), ["k1", "k2"]).select(names)
    in_small = rows.where(linkable).join(F.broadcast(large), ["k1", "k2"], "left_anti").join(small, ["k1", "k2"]).select(names)
    alone = rows.where(~F.coalesce(linkable, F.lit(False))).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return in_large.unionAll(in_small).unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns as they are, of the documents that stay: one of each component.

    Of repeated rows of one doc_id, a document like any other, all stay or all go; null doc_ids and texts stay.
    """
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = Scratch(docs.sparkSession, "gone").save(gone, "ids")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(few, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
