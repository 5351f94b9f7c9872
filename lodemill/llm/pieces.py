"""Cutting text into pieces that a byte-level BPE never merges across, and remembering what they encode to.

The split pattern of the vocabulary lets one space open the next pre-token, so a space that stands before a
non-space always begins a new pre-token, and white space before it ends with the piece.  Pieces can therefore be
encoded on their own and remembered: a corpus has far fewer distinct pieces than words.  Texts are cut, pieces looked
up and ids put together in Arrow; Python only sees pre-tokens that aren't remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_OPENING = re.compile(r" (?=\S)")
#: Before a piece that no space opens: the first of a text.
BARE = "\0"
#: Keys of more bytes are encoded but not remembered, so a memory's bytes are bounded by its entries.
LONGEST = 64
#: A word of Latin letters and the punctuation after it, its pre-tokens.
PLAIN = r"^(?P<w> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<q>[!-&(-/:-@\[-`{-~]*)$"
#: Pieces that plain splitting at spaces may have cut wrongly: they are empty or begin with white space.
ODD = r"^$|^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Ids of some texts: how many each has, and all in a row.
Ids = tuple[np.ndarray, np.ndarray]


def joined(counts: np.ndarray, ids: np.ndarray) -> pa.LargeBinaryArray:
    """One value for each count: the bytes of so many ids."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * ids.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))])


def _large(*columns):
    return [pa.scalar(c, pa.large_string()) if isinstance(c, str) else c.cast(pa.large_string()) for c in columns]


class Memory:
    """The ``limit`` keys asked for last, with their values."""

    def __init__(self, limit: int):
        self.keys, self.values, self.limit = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), limit

    def __call__(self, keys: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """Values of ``keys``; those that aren't known are learnt."""
        at = pc.index_in(keys, value_set=self.keys)
        unknown = at.is_null().to_numpy(zero_copy_only=False)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[unknown] = len(self.keys) + np.arange(unknown.sum())
        out = pa.concat_arrays([self.values, learn(keys.filter(pa.array(unknown)))]).take(pa.array(place))
        short = np.flatnonzero(pc.binary_length(keys).to_numpy() <= LONGEST)[: self.limit]
        rest = np.ones(len(self.keys), bool)
        rest[place[~unknown]] = False
        rest = np.flatnonzero(rest)[: self.limit - len(short)]
        self.keys, self.values = (pa.concat_arrays([new.take(pa.array(short)), old.take(pa.array(rest))]) for new, old in ((keys, self.keys), (out, self.values)))
        return out


class PieceCoder:
    """Token ids of whole texts, each distinct piece encoded once for as long as it is remembered.

    ``words`` encodes pre-tokens, ``pieces`` any pieces, ``whole`` texts that may hold special tokens.  A key is a piece
    without the space that opens it, or ``BARE`` and the piece.
    """

    def __init__(self, words: Callable[[list[str]], Ids], pieces: Callable[[list[str]], Ids], whole: Callable[[list[str]], Ids], special: Iterable[str], dtype, limit: int = 200_000):
        self.words, self.pieces, self.whole, self.special, self.dtype = words, pieces, whole, list(special), np.dtype(dtype)
        self.known, self.tokens = Memory(limit), Memory(limit)

    def _learn(self, keys: pa.Array) -> pa.Array:
        bare = pc.starts_with(keys, BARE)
        texts = pc.if_else(bare, pc.utf8_slice_codeunits(keys, 1), pc.binary_join_element_wise(*_large(" ", keys, "")))
        cut = pc.extract_regex(texts, PLAIN)
        plain = cut.is_valid()
        w, q = (x.dictionary_encode() for x in cut.filter(plain).flatten())
        words = pa.concat_arrays([w.dictionary, q.dictionary.filter(pc.not_equal(q.dictionary, ""))]).unique()
        values = self.tokens(words, lambda x: joined(*self.words(x.to_pylist())))
        of = lambda d: pc.fill_null(values.take(pc.index_in(d.dictionary, value_set=words)), b"").take(d.indices)
        easy = pc.binary_join_element_wise(of(w), of(q), pa.scalar(b"", pa.large_binary()))
        rest = joined(*self.pieces(texts.filter(pc.invert(plain)).to_pylist()))
        order = np.empty(len(keys), np.int64)
        order[np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(keys))
        return pa.concat_arrays([easy, rest]).take(pa.array(order))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (and the last one's end); null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        rare = pc.match_substring(texts, BARE)
        for s in self.special:
            rare = pc.or_(rare, pc.match_substring(texts, s))
        lists = pc.split_pattern(pc.binary_join_element_wise(*_large(BARE, pc.if_else(rare, "", texts), "")), " ")
        start, coded = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().dictionary_encode()
        keys, index = coded.dictionary, coded.indices.to_numpy()
        del lists, coded
        # Plain splitting at spaces is right unless white space stands on both sides of a space.
        odd = pc.match_substring_regex(keys, ODD).to_numpy(zero_copy_only=False)
        again = np.unique(np.searchsorted(start, np.flatnonzero(odd[index]), side="right") - 1) if odd.any() else np.empty(0, np.int64)
        cut = [_OPENING.split(BARE + texts[k].as_py()) for k in again.tolist()]
        values = [self.known(pa.concat_arrays([keys.filter(pa.array(~odd)), pa.array([x for c in cut for x in c], pa.large_string())]), self._learn)]
        index, keys = (np.cumsum(~odd) - 1)[index], None
        alone = np.flatnonzero(rare.to_numpy(zero_copy_only=False))
        if len(again) + len(alone):  # these texts' pieces, or the texts as one, take the place of what plain splitting found
            values.append(joined(*self.whole([texts[k].as_py() for k in alone.tolist()])))
            of, own = np.repeat(np.arange(n), np.diff(start)), np.repeat(again, [len(c) for c in cut])
            kept, first = ~np.isin(of, np.concatenate([again, alone])), int((~odd).sum())
            of = np.concatenate([of[kept], own, alone])
            order = np.argsort(of, kind="stable")
            index = np.concatenate([index[kept], first + np.arange(len(own) + len(alone))])[order]
            start = np.searchsorted(of[order], np.arange(n + 1))
        flat = pa.concat_arrays(values).take(pa.array(index))
        ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset :][: len(flat) + 1] // self.dtype.itemsize if len(flat) else np.zeros(1, np.int64)
        ids = np.frombuffer(flat.buffers()[2], self.dtype)[: ends[-1]] if ends[-1] else np.empty(0, self.dtype)
        return ids, ends[start]
