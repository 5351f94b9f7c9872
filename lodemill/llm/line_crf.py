"""Operator 3: document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  A line's own features and those of the lines beside it weigh for either; a 2 x 2 table
weighs every pair of neighbours.  Forward-backward gives each line's marginal, and the marginals, weighted by line
length, the document's quality, which a logistic curve fitted on the training documents turns into a score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm.labelled import remainder, sample, text_score

_ODD = re.compile(r"[^\w\s.,;:'\"()?!¿¡-]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_REPEAT = re.compile(r"(\S)\1\1")
_ENDS = re.compile(r"[.!?…][\"')\]]*$")
OWN = 14


def line_features(lines: list[str], repeats: np.ndarray) -> np.ndarray:
    """Own features of lines; repeats: how often each occurs in its document."""
    out = np.zeros((len(lines), OWN))
    known: dict[str, tuple] = {}
    for i, line in enumerate(lines):
        f = known.get(line)
        if f is None:
            words = line.split()
            n, w = max(1, len(line)), max(1, len(words))
            same = sum(map(str.__eq__, words, words[1:]))
            f = known[line] = (
                1.0, min(1.0, len(line) / 200), min(1.0, w / 40), min(2.0, 8 * len(_ODD.findall(line)) / w), len(_UPPER.findall(line)) / n,
                min(2.0, 4 * (line.count("!") + line.count("?")) / w), len(set(words)) / w, same / w, min(1.0, n / w / 20), 1.0 if _ENDS.search(line) else 0.0,
                min(1.0, 4 * line.count("|") / w), min(1.0, 4 * sum(map(str.isdigit, line)) / n), 1.0 if _REPEAT.search(line) else 0.0,
            )
        out[i, :13] = f
    out[:, 13] = np.minimum(4, repeats - 1) / 4
    return out


def with_neighbours(own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and after in the same document (0 where there is none)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        same = (doc[1:] == doc[:-1])[:, None]
        before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    return np.hstack([own, before[:, 1:], after[:, 1:]])


def forward_backward(unary: np.ndarray, edge: np.ndarray, start: np.ndarray, count: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the sum of all neighbours' joint marginals, each times its document's ``weight``.

    ``unary``: log-odds of good; ``edge``: log factors [before][after]; documents begin at ``start`` with ``count``
    lines.  All documents of equal rank step together, longest first, so a batch takes as many steps as its longest
    document has lines.
    """
    order = np.argsort(-count, kind="stable")
    start, count = start[order], count[order]
    weight = np.ones(len(count)) if weight is None else weight[order]
    steps = int(count[0]) if len(count) else 0
    live = np.searchsorted(-count, -np.arange(1, steps + 1), side="right")  # documents with more lines than the step
    phi = np.stack([1 / (1 + np.exp(np.clip(unary, -30, 30))), 1 / (1 + np.exp(-np.clip(unary, -30, 30)))], 1)
    psi = np.exp(edge)
    alpha, beta = np.empty_like(phi), np.ones_like(phi)
    for s in range(steps):
        at = start[: live[s]] + s
        a = phi[at] if s == 0 else phi[at] * (alpha[at - 1] @ psi)
        alpha[at] = a / a.sum(1, keepdims=True)
    joint = np.zeros((2, 2))
    for s in range(steps - 2, -1, -1):
        at = start[: live[s + 1]] + s
        m = phi[at + 1] * beta[at + 1]
        b = m @ psi.T
        j = alpha[at][:, :, None] * psi * m[:, None, :]
        joint += (weight[: live[s + 1], None, None] * j / j.sum((1, 2), keepdims=True)).sum(0)
        beta[at] = b / b.sum(1, keepdims=True)
    g = alpha * beta
    return g[:, 1] / np.maximum(g.sum(1), 1e-300), joint


class Lines:
    """The lines of a batch of documents; blank ones are left out."""

    def __init__(self, texts: list[str]):
        cut = [[x for x in t.split("\n") if x.strip()] for t in texts]
        self.count = np.array([len(c) for c in cut], np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.count)
        self.flat = [x for c in cut for x in c]
        self.length = np.array([len(x) for x in self.flat], float)
        seen = [Counter(c) for c in cut]
        self.repeats = np.array([n[x] for n, c in zip(seen, cut, strict=True) for x in c], np.int32)

    def features(self, lo: int, hi: int) -> np.ndarray:
        """Features of the lines from ``lo`` to before ``hi``, those of neighbours among them."""
        a, b = max(0, lo - 1), min(len(self.flat), hi + 1)
        return with_neighbours(line_features(self.flat[a:b], self.repeats[a:b]), self.doc[a:b])[lo - a : hi - a]

    def unary(self, weight: np.ndarray, step: int = 1 << 14) -> np.ndarray:
        """Log-odds of each line, some lines at a time, so that their features never stand in memory together."""
        return np.concatenate([np.zeros(0), *(self.features(lo, min(len(self.flat), lo + step)) @ weight for lo in range(0, len(self.flat), step))])

    def mean(self, p: np.ndarray) -> np.ndarray:
        """Length-weighted mean of each document; 1/2 for documents without lines."""
        n = len(self.count)
        total = np.bincount(self.doc, self.length, n)
        return np.where(total > 0, np.bincount(self.doc, self.length * p, n) / np.maximum(total, 1), 0.5)


class Model:
    def __init__(self, weight: np.ndarray, edge: np.ndarray, curve: tuple[float, float]):
        self.weight, self.edge, self.curve = weight, edge, curve

    def raw(self, texts: list[str]) -> np.ndarray:
        lines = Lines(texts)
        run = lines.count > 0
        p, _ = forward_backward(lines.unary(self.weight), self.edge, lines.start[run], lines.count[run])
        return lines.mean(p)

    def scores(self, texts: list[str]) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * self.raw(texts), -30, 30)))


def train(rows: list[tuple[str, int]], rounds: int = 80, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """AdaGrad on the likelihood of line labels, each line's being its document's; then the curve, with the classes weighing alike.

    Without rows of both classes every score is 1/2 or more for good ones only, less for bad ones only.
    """
    y = np.array([r[1] for r in rows], float)
    lines = Lines([r[0] for r in rows])
    weight, edge, x = np.zeros(3 * OWN - 2), np.zeros((2, 2)), lines.features(0, len(lines.flat))
    if len(rows) == 0 or y.min() == y.max():
        return Model(weight, edge, (float(2 * y.mean() - 1) if len(rows) else 0.0, 0.0))
    yl = y[lines.doc].astype(int)
    # Both classes weigh alike, and so do documents within a class.
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    total = np.bincount(lines.doc, lines.length, len(y))
    each = (share[lines.doc] * lines.length / total[lines.doc])[:, None]
    same = lines.doc[1:] == lines.doc[:-1]
    run = lines.count > 0
    pairs = share / np.maximum(1, lines.count - 1)  # of each pair of neighbours
    seen = np.zeros((2, 2))
    np.add.at(seen, (yl[:-1][same], yl[1:][same]), pairs[lines.doc[1:]][same])
    gw, ge = np.full_like(weight, 1e-8), np.full_like(edge, 1e-8)
    for _ in range(rounds):
        p, joint = forward_backward(x @ weight, edge, lines.start[run], lines.count[run], pairs[run])
        g = (each * x).T @ (yl - p) - decay * weight
        gw += g * g
        weight = weight + rate * g / np.sqrt(gw)
        g = seen - joint - 1e-2 * edge
        ge += g * g
        edge = edge + 0.1 * rate * g / np.sqrt(ge)
    q = lines.mean(p)
    a = b = 0.0
    for _ in range(25):  # Newton steps with a small ridge
        s = 1 / (1 + np.exp(-(a + b * q)))
        w, r = share * s * (1 - s), share * (y - s)
        h = np.array([[w.sum() + 1e-4, (w * q).sum()], [(w * q).sum(), (w * q * q).sum() + 1e-4]])
        da, db = np.linalg.solve(h, [r.sum() - 1e-4 * a, (r * q).sum() - 1e-4 * b])
        a, b = a + da, b + db
    return Model(weight, edge, (float(a), float(b)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200, longest: int = 20_000) -> Model:
    """Learns from rows whose crc32(doc_id) mod 3 isn't 1, at most ``per_class`` of each label."""
    return train(sample(docs, labels, "quality", remainder(F.col("doc_id"), 3) != 1, per_class, longest))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; only the text is scored.

    Null, empty and blank text scores as a document that is as much good as bad.  held_out is null for null doc_id.
    Every row gives a row, repeated ones too; an empty table gives none; other columns are not read.  A very long text
    is scored whole, its features some lines at a time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_score(model)(F.col("text")).alias("score"))
    return rows.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns as they are, that score ``least`` or more; null and empty texts score as in ``score``."""
    return docs.where(text_score(model)(docs["text"]) >= least)


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
