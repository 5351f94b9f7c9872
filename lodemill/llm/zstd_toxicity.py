"""Operator 9: toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text and one on windows of toxic text.  Every window
of a document is compressed as ordinary text, with the ordinary dictionary, and as text of a toxic document, which is
mostly ordinary: with the toxic dictionary put before the ordinary one.  What the second saves is text that toxic
documents have and ordinary ones don't.  A logistic curve on the savings of a document's windows gives its score.

Labels are of documents, not windows, so the toxic windows are found in rounds (multiple instances): at first all
windows of toxic documents train the toxic dictionary, then those only that it saves more on than on nearly all
ordinary windows.  Windows are judged by dictionaries of other documents only (folds), a window that several documents
share trains once, and the curve, the threshold and the dictionary's size come from such out-of-fold judgements too.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm.common import WORD
from lodemill.llm.labelled import remainder, sample, text_score

_WORDS = re.compile(WORD).findall
#: Words of the windows that are scored and of those that train, and steps between their beginnings.
WINDOW, STEP, SHORT, SHORT_STEP = 24, 22, 5, 3
LEVEL, ORDINARY_BYTES, TOXIC_BYTES = 6, 110_000, (2048, 4096, 8192)
#: Bytes of the pieces that a dictionary is put together from, and of the strings that are counted for that.
ORDINARY_PIECE, TOXIC_PIECE = (64, 8), (16, 6)
FOLDS, ROUNDS, RARE = 3, 4, 0.995
#: Ordinary windows of a fold, evenly spread, that say what is rare among them.
JUDGES = 20_000
#: A false alarm costs as much as so many misses when the curve is set against the threshold.
ALARM, THRESHOLD = 5.0, 0.3
FEATURES = 8


def windows(text: str, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    """Lower-cased windows of ``size`` words, every ``step`` words, to the end; words of any length are whole."""
    w = _WORDS(text.lower())
    return [(" " + " ".join(w[i : i + size]) + " ").encode() for i in range(0, max(1, len(w) - size + step), step)] if w else []


def _dictionary(size: int, samples: list[bytes], piece: tuple[int, int]) -> bytes:
    """A trained dictionary; where there are too few samples to train on, the last bytes of the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=piece[0], d=piece[1]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _length(content: bytes):
    """Compressed length of a window after ``content``."""
    import zstandard

    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=200, write_content_size=False, write_checksum=False, write_dict_id=False)
    d.precompute_compress(compression_params=p)
    compress = zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress
    return lambda w: len(compress(w))


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, curve: np.ndarray):
        self.ordinary, self.toxic, self.curve, self.pair = ordinary, toxic, curve, None

    def __getstate__(self):
        return self.__dict__ | {"pair": None}

    def savings(self, ws: list[bytes]) -> list[int]:
        """Bytes by which each window is shorter as toxic than as ordinary text."""
        if self.pair is None:
            self.pair = _length(self.ordinary), _length(self.toxic + self.ordinary)
        plain, both = self.pair
        return [plain(w) - both(w) for w in ws]

    def features(self, text: str) -> list[float]:
        saved = sorted(self.savings(windows(text)), reverse=True) if self.toxic else []
        top = [max(0, s) for s in saved[:3]] + [0] * (3 - len(saved[:3]))
        over, n = sum(s - 2 for s in saved if s > 2), max(1, len(saved))
        return [1.0, top[0] / 4, top[1] / 4, top[2] / 4, math.log1p(over), over / n, math.log1p(len(saved)) / 4, sum(saved) / n]

    def matrix(self, texts: list[str]) -> np.ndarray:
        return np.array([self.features(t) for t in texts]).reshape(-1, FEATURES)

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.matrix(texts)
        some = np.array([bool(t.strip()) for t in texts], bool) if self.toxic else np.ones(len(x), bool)
        return np.where(some, 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30))), 0.0)


def _distinct(texts: list[str]) -> list[list[bytes]]:
    """Short windows of each text, without those that it or one before it has had."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        new = [w for w in dict.fromkeys(windows(t, SHORT, SHORT_STEP)) if w not in seen]
        seen.update(new)
        out.append(new)
    return out


def _others(folds: list[list[bytes]], f: int) -> list[bytes]:
    return [w for g, ws in enumerate(folds) if g != f for w in ws]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic curve, shifted so that the threshold stands where misses and alarms cost least; and that cost.

    Between equal costs it stands in the middle of the widest gap.
    """
    curve = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps with a small ridge
        s = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        h = (x * (s * (1 - s))[:, None]).T @ x + 0.02 * np.eye(x.shape[1])
        curve = curve + np.linalg.solve(h, x.T @ (y - s) - 0.02 * curve)
    z, order = x @ curve, np.argsort(x @ curve)
    cost = np.concatenate([[ALARM], ALARM * (1 - np.cumsum(y[order] == 0) / max(1, (y == 0).sum()))])
    cost = cost + np.concatenate([[0.0], np.cumsum(y[order] == 1) / (y == 1).sum()])
    edges = np.concatenate([[z.min() - 1], z[order], [z.max() + 1]])
    best = max(np.flatnonzero(cost <= cost.min() + 1e-12), key=lambda k: edges[k + 1] - edges[k])
    curve[0] += math.log(THRESHOLD / (1 - THRESHOLD)) - (edges[best] + edges[best + 1]) / 2
    return curve, float(cost.min())


def train(rows: list[tuple[str, int]]) -> Model:
    """Dictionaries and curve from (text, label) in a fixed order.

    With fewer than two documents of a label nothing is toxic: every score is 0.05.
    """
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    n = min(FOLDS, len(toxic), len(ordinary))
    if n < 2:
        return Model(b"", b"", np.array([math.log(0.05 / 0.95)] + [0.0] * (FEATURES - 1)))
    folds = [(toxic[f::n], ordinary[f::n]) for f in range(n)]
    of_toxic, of_ordinary = _distinct([t for a, _ in folds for t in a]), _distinct([t for _, b in folds for t in b])
    at_t, at_o = np.cumsum([0] + [len(a) for a, _ in folds]), np.cumsum([0] + [len(b) for _, b in folds])
    toxic_ws = [[w for ws in of_toxic[at_t[f] : at_t[f + 1]] for w in ws] for f in range(n)]
    ordinary_ws = [[w for ws in of_ordinary[at_o[f] : at_o[f + 1]] for w in ws] for f in range(n)]
    plain = [_dictionary(ORDINARY_BYTES, _others(ordinary_ws, f), ORDINARY_PIECE) for f in range(n)]
    y = np.concatenate([[1.0] * len(a) + [0.0] * len(b) for a, b in folds])
    judges = [ws[:: max(1, len(ws) // JUDGES)] for ws in ordinary_ws]
    # The lengths as ordinary text are the same for every toxic dictionary.
    lengths = [[np.array(list(map(_length(plain[f]), ws)), np.int64) for ws in (judges[f], toxic_ws[f])] for f in range(n)]
    best = None
    for size in TOXIC_BYTES:
        chosen = toxic_ws
        for _ in range(ROUNDS):
            after = []
            for f in range(n):
                both = _length(_dictionary(size, _others(chosen, f), TOXIC_PIECE) + plain[f])
                usual, saved = (of - np.array(list(map(both, ws)), np.int64) for of, ws in zip(lengths[f], (judges[f], toxic_ws[f]), strict=True))
                least = np.quantile(usual, RARE) if len(usual) else 0
                after.append([w for w, s in zip(toxic_ws[f], saved.tolist(), strict=True) if s > least])
            chosen = after
        models = [Model(plain[f], _dictionary(size, _others(chosen, f), TOXIC_PIECE), np.zeros(FEATURES)) for f in range(n)]
        curve, cost = _curve(np.vstack([m.matrix([*a, *b]) for m, (a, b) in zip(models, folds, strict=True)]), y)
        if best is None or cost < best[0]:
            best = cost, size, [w for ws in chosen for w in ws], curve
    _, size, chosen, curve = best
    return Model(_dictionary(ORDINARY_BYTES, [w for ws in ordinary_ws for w in ws], ORDINARY_PIECE), _dictionary(size, chosen, TOXIC_PIECE), curve)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2400, longest: int = 20_000) -> Model:
    """Learns from rows whose crc32(doc_id) mod 4 isn't 2, at most ``per_class`` of each label."""
    return train(sample(docs, labels, "toxic", remainder(F.col("doc_id"), 4) != 2, per_class, longest))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; only the text is scored.

    Null, empty and blank text has no windows and scores 0.  held_out is null for null doc_id.  Every row gives a row,
    repeated ones too; an empty table gives none; other columns are not read.  A very long text is scored by all its
    windows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_score(model)(F.col("text")).alias("score"))
    return rows.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: Model, most: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns as they are, that score below ``most``; null and empty texts stay."""
    return docs.where(text_score(model)(docs["text"]) < most)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
