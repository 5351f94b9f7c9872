"""Operator 10: byte-level BPE encoding by a prefix-sharing trie, and decoding.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are (Berglund and van der
Merwe, 2023).  So the encoding of a prefix is fixed by its *last token*: the one token ``t`` that ends the prefix and
may follow the last token of what stands before ``t``.  Distinct words, sorted, are the leaves of a trie in
depth-first order; a stack holds the last token of every node on the path, and a word only computes the nodes that
it doesn't share with the word before.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm.common import slices
from lodemill.llm.pieces import Ids, PieceCoder


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _ids(found: Iterable[list[int]]) -> Ids:
    counts, ids = [], array("i")
    for i in found:
        counts.append(len(i))
        ids.extend(i)
    return np.array(counts, np.int64), np.array(ids, np.int32)


class TrieBPE:
    """Encoder and decoder of one vocabulary file (JSON with ``model.vocab``, ``model.merges`` and ``added_tokens``)."""

    def __init__(self, vocabulary: str, limit: int = 200_000):
        import regex

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_symbols()
        vocab, added = spec["model"]["vocab"], spec["added_tokens"]
        self.special = {a["content"]: a["id"] for a in added}
        raw = {i: bytes(symbol[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.token = raw | {i: s.encode() for s, i in self.special.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # Tokens are numbered by age: single bytes first, then in the order of the merges that make them.
        self.id_of: list[int] = [vocab[c] for c in symbol]
        age = {c: k for k, c in enumerate(symbol)}
        self.halves: list[tuple[int, int]] = [(-1, -1)] * len(age)
        self.merged: dict[int, int] = {}
        for a, b in pairs:
            if a + b not in age:
                age[a + b] = len(self.halves)
                self.halves.append((age[a], age[b]))
                self.id_of.append(vocab[a + b])
            self.merged.setdefault(age[a] << 20 | age[b], age[a + b])
        # A trie of the vocabulary: step[node << 8 | byte] is the child, spelled[node] the token that ends there or -1.
        self.step: dict[int, int] = {}
        self.spelled = [-1]
        for k in range(len(self.halves)):
            node = 0
            for c in raw[self.id_of[k]]:
                node = self.step.setdefault(node << 8 | c, len(self.spelled))
                if node == len(self.spelled):
                    self.spelled.append(-1)
            self.spelled[node] = k
        self.may_follow: dict[int, bool] = {}
        self.limit = limit
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.spelling = pa.array([self.token.get(i, b"") for i in range(max(self.token) + 1)], pa.large_binary())
        self.code = PieceCoder(self._words, self._pieces, lambda texts: _ids(map(self.encode, texts)), self.special, np.int32, limit)

    def _stable(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` side by side.

        Undoes the newest merge of the two again and again.  Wherever the tokens that then meet at the border would
        merge before the merge just undone, BPE had joined them.  Of equal merges the left one goes first.
        """
        merged, halves, bound = self.merged, self.halves, 1 << 30
        while True:
            if merged.get(left << 20 | right, bound) < bound:
                return False
            newest = left if left > right else right
            if halves[newest][0] < 0:
                return True
            if left > right:
                bound, left = left, halves[left][1]
            else:
                bound, right = right + 1, halves[right][0]

    def _whole(self, t: int) -> bool:
        """Whether BPE makes token ``t`` of its own bytes."""
        a, b = self.halves[t]
        return a < 0 or (self._whole(a) and self._whole(b) and self._stable_below(a, b, t))

    def _stable_below(self, left: int, right: int, top: int) -> bool:
        key = left << 20 | right
        own = self.merged.pop(key)
        ok = self._stable(left, right) and own == top
        self.merged[key] = own
        return ok

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words, in one depth-first walk of their trie."""
        out: dict[bytes, list[int]] = {}
        step, spelled, follows, id_of = self.step.get, self.spelled, self.may_follow, self.id_of
        # For each node on the path: its last token, the depth before that token, and the vocabulary tokens that have
        # begun on the path and may still end below, the earliest begun first.
        last: list[int] = []
        back: list[int] = []
        begun: list[list[tuple[int, int]]] = [[]]
        before = b""
        for w in sorted(words):
            n = min(len(w), len(before))
            shared = n if w[:n] == before[:n] else next(i for i in range(n) if w[i] != before[i])
            del last[shared:], back[shared:], begun[shared + 1 :]
            for end in range(shared, len(w)):
                c, open_, done = w[end], [], False
                for start, node in begun[end]:
                    child = step(node << 8 | c)
                    if child is None:
                        continue
                    open_.append((start, child))
                    if done or (t := spelled[child]) < 0:
                        continue
                    key = last[start - 1] << 20 | t if start else t
                    ok = follows.get(key if start else ~t)
                    if ok is None:
                        ok = self._whole(t) and (not start or self._stable(last[start - 1], t))
                        follows[key if start else ~t] = ok
                    if ok:
                        last.append(t)
                        back.append(start)
                        done = True
                child = step(c)
                open_.append((end, child))
                if not done:
                    last.append(spelled[child])
                    back.append(end)
                begun.append(open_)
            ids, end = [], len(w)
            while end:
                ids.append(id_of[last[end - 1]])
                end = back[end - 1]
            ids.reverse()
            out[w] = ids
            before = w
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Text of ``ids``, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(self.spelling.take(pa.array(ids, pa.int32())).to_pylist()).decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, start: np.ndarray) -> pa.Array:
        """Texts of ids in a row, each from one place of ``start`` to the next."""
        spelled = self.spelling.take(pa.array(ids, pa.int32()))
        ends = np.frombuffer(spelled.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start) - 1, [None, pa.py_buffer(ends[start]), spelled.buffers()[2] or pa.py_buffer(b"")])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that aren't UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())

    def _words(self, words: list[str]) -> Ids:
        raw = [w.encode() for w in words]
        found = self.encode_words(raw)
        return _ids(map(found.__getitem__, raw))

    def _cut(self, texts: list[str]) -> list[list[int]]:
        cut = [[w.encode() for w in self.split(t)] for t in texts]
        found = self.encode_words(list({w for c in cut for w in c}))
        return [[i for w in c for i in found[w]] for c in cut]

    def _pieces(self, texts: list[str]) -> Ids:
        return _ids(self._cut(texts))

    def encode(self, text: str) -> list[int]:
        """Ids of one text, special tokens in it included."""
        parts = self.parts(text)
        plain = [p for p in parts if p not in self.special]
        known = dict(zip(plain, self._cut(plain), strict=True))
        return [i for p in parts for i in ([self.special[p]] if p in self.special else known[p])]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        if len(self.may_follow) > self.limit:
            self.may_follow.clear()
        return self.code(texts)


@lru_cache(maxsize=2)
def trie_bpe(vocabulary: str) -> TrieBPE:
    """One for each Python worker: what it has learnt serves all its tasks."""
    return TrieBPE(vocabulary)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, decoded) of ``docs(doc_id, text)``: token ids, and the text that they decode to.

    Null and empty text have no tokens.  Every row gives a row, repeated and null doc_id included.  A very long text is
    encoded whole, in memory of about twenty times its size.  Other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = trie_bpe(vocabulary)
        for b in slices(batches, 2048, 4 << 20):
            distinct = b.column(1).fill_null("").dictionary_encode()  # copies, which a mix has side by side, are encoded once
            ids, start = bpe.batch(distinct.dictionary)
            texts = distinct.indices.to_numpy()
            # Ids take more room than the texts, so they go on in smaller batches.
            for lo, hi in runs(np.diff(start)[texts], 1 << 18):
                part = texts[lo:hi]
                at = np.concatenate([[0], np.cumsum(np.diff(start)[part])])
                own = np.concatenate([ids[start[k] : start[k + 1]] for k in part])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(own))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists, bpe.decode_all(own, at)], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive places whose sizes add up to ``most`` or less, or of one place."""
    lo = total = 0
    for k, s in enumerate(sizes.tolist()):
        if k > lo and total + s > most:
            yield lo, k
            lo, total = k, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_documents``' rows, and the columns ``keep``."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *keep)


def bpe_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    return digests(encode_documents(docs, vocabulary))
