"""Operator 2: token ids as flat binary files with 64-bit document offsets.

Layout under ``root``, one set of files for each range partition ``p`` of ascending ``doc_id``:

* ``ids-p.bin``   unsigned little-endian ids, 16 bits each if the vocabulary fits, else 32;
* ``off-p.bin``   (documents + 1) unsigned 64-bit offsets, in ids, from the start of the file;
* ``doc-p.bin``   signed 64-bit doc_id of each document, 0 for null;
* ``set-p.bin``   one byte for each document: 1 if its doc_id isn't null.

Partition ``p`` starts, in the corpus, at the prefix sum of the ids of all partitions before it.  A task streams its
files to temporary names, batch by batch, and renames them at its end; they hold the same bytes whichever attempt
writes them.
"""

from __future__ import annotations

import contextlib
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm.common import Scratch, slices, tasks_for
from lodemill.llm.pieces import Ids, PieceCoder

def id_type(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


class PieceEncoder:
    """Encodes with the tokenizers library, thousands of distinct pre-tokens or pieces in one call.

    ``tok`` is the tokenizer as it is, ``inner`` the same without its split pattern, for single pre-tokens.
    """

    def __init__(self, vocabulary: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.inner = Tokenizer.from_file(vocabulary), Tokenizer.from_file(vocabulary)
        for t in (self.tok, self.inner):
            t.no_truncation()
            t.no_padding()
        self.inner.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.dtype = id_type(self.tok.get_vocab_size())
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.code = PieceCoder(partial(self._each, self.inner), partial(self._each, self.tok), self._whole, special, self.dtype, limit)

    def _each(self, tok, texts: list[str], most: int = 8192) -> Ids:
        """Each text is one word of an input that is cut into words beforehand, so its tokens carry its number."""
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, self.dtype)]
        for i in range(0, len(texts), most):
            some = texts[i : i + most]
            found = tok.encode(some, is_pretokenized=True, add_special_tokens=False)
            counts.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))
            ids.append(np.array(found.ids, self.dtype))
        return np.concatenate(counts), np.concatenate(ids)

    def _whole(self, texts: list[str]) -> Ids:
        ids = [np.array(self.tok.encode(t, add_special_tokens=False).ids, self.dtype) for t in texts]
        return np.array([len(i) for i in ids], np.int64), np.concatenate([*ids, np.zeros(0, self.dtype)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        return self.code(texts)


@lru_cache(maxsize=2)
def piece_encoder(vocabulary: str) -> PieceEncoder:
    """One for each Python worker: what it has learnt serves all its tasks."""
    return PieceEncoder(vocabulary)


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


class _Files:
    """Files of one partition, streamed to temporary names until ``close`` renames them."""

    def __init__(self, root: str, part: int, kinds: tuple[str, ...]):
        self.fs, self.base = _store(root)
        self.names = {k: (f"{self.base}/.{k}-{part:06d}.{uuid.uuid4().hex}", f"{self.base}/{k}-{part:06d}.bin") for k in kinds}
        self.out = {k: self.fs.open_output_stream(a) for k, (a, _) in self.names.items()}

    def close(self) -> None:
        for out in self.out.values():
            out.close()
        for a, b in self.names.values():
            # Another attempt's file has the same bytes; not every store renames onto a file.
            if self.fs.get_file_info(b).type == pafs.FileType.File:
                self.fs.delete_file(b)
            self.fs.move(a, b)

    def abandon(self) -> None:
        for k, (a, _) in self.names.items():
            with contextlib.suppress(Exception):
                self.out[k].close()
            with contextlib.suppress(Exception):
                self.fs.delete_file(a)


def _get(root: str, name: str, dtype) -> np.ndarray:
    """Memory-mapped where the store is a local or mounted folder, read whole otherwise."""
    fs, base = _store(root)
    path = f"{base}/{name}"
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(docs: DataFrame, root: str, vocabulary: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Writes ids of ``docs(doc_id, text)`` under ``root``; returns (part, n_docs, n_tokens), one row for each set of files.

    Null text counts as empty; such a document holds ``end_id`` alone.  Rows with equal doc_id are each a document,
    in the order of their texts; null doc_id comes first.  A very long text is one document like any other: a task holds
    a batch of some MB, or one text if that is longer, and never its partition.  Other columns are not read.  An empty
    table gives no files.
    """
    spark = docs.sparkSession
    n = partitions or tasks_for(docs)
    fs, base = _store(root)
    fs.create_dir(base, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = piece_encoder(vocabulary), TaskContext.get().partitionId()
        files, docs_, at = None, 0, 0
        try:
            for b in slices(batches, 4096, 8 << 20):
                ids, start = enc(b.column(1))
                if files is None:
                    files = _Files(root, part, ("ids", "off", "doc", "set"))
                    files.out["off"].write(np.zeros(1, "<u8").tobytes())
                ids = np.insert(ids, start[1:], end_id)
                off = (at + start[1:] + np.arange(1, len(start))).astype("<u8")
                keys = b.column(0)
                files.out["ids"].write(ids.tobytes())
                files.out["off"].write(off.tobytes())
                files.out["doc"].write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                files.out["set"].write(keys.is_valid().to_numpy(zero_copy_only=False).astype("u1").tobytes())
                docs_, at = docs_ + len(off), int(off[-1])
            if files is not None:
                files.close()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs_], pa.int64()), pa.array([at], pa.int64())], ["part", "n_docs", "n_tokens"])
                files = None
        finally:
            if files is not None:
                files.abandon()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # The beginnings of the texts split the rows of one doc_id, should it repeat.
    return rows.repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text").mapInArrow(encode, "part int, n_docs long, n_tokens long")


def read_token_files(spark: SparkSession, root: str, parts: DataFrame, wide: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of ``parts`` alone."""
    # One row for each set of files, never more than the shuffle has partitions.
    sets = sorted(parts.select("part", "n_tokens").collect())
    base, starts = 0, []
    for part, n in sets:
        starts.append((part, base))
        base += n
    width = np.dtype("<u4" if wide else "<u2")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, off = _get(root, f"ids-{part:06d}.bin", width), _get(root, f"off-{part:06d}.bin", "<u8")
                doc, n = _get(root, f"doc-{part:06d}.bin", "<i8"), len(off) - 1
                valid = _get(root, f"set-{part:06d}.bin", "u1").astype(bool)
                for i in range(0, n, 4096):
                    j = min(n, i + 4096)
                    crc = [zlib.crc32(ids[off[k] : off[k + 1]].astype("<u4").tobytes()) for k in range(i, j)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(doc[i:j], np.int64), pa.int64(), mask=~valid[i:j]), pa.array(off[i:j].astype("i8") + start), pa.array((off[i + 1 : j + 1] - off[i:j]).astype("i8")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    sets_df = spark.createDataFrame(starts, "part int, start long").repartition(max(1, len(starts)))
    return sets_df.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    root = scratch.path("files")
    parts = scratch.save(write_token_files(docs, root, vocabulary, end_id), "parts")
    from tokenizers import Tokenizer

    wide = id_type(Tokenizer.from_file(vocabulary).get_vocab_size()).itemsize > 2
    return read_token_files(spark, root, parts, wide)
