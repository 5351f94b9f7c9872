"""Histogram gradient boosting with second-order gradients, on binned rows.

Rows are binned once: codes 0 to 254 of each feature as bytes, 255 for missing.  For every level of a tree each
partition adds up its gradient histograms in NumPy and emits one row for each (node, feature); a hash aggregation adds
those and the best split of each node comes to the driver: 2**depth rows.  A task evaluates the latest trees on its own
rows; every REBASE trees the margins are stored anew beside the codes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.functions.arrays import byte_matrix, byte_rows, lists, matrix
from lodemill.functions.columns import seeded

MISSING = 255
#: After so many trees margins are brought up to date, so a level evaluates this many trees at most.
REBASE = 16


@dataclass
class FitConfig:
    """eta, depth, shares of rows and columns for each tree, L2 weight of leaves, least gain and least hessian of a child.

    objective: 'binary:logistic' or 'reg:squarederror'.  Both start from base score 0.5.
    """

    max_depth: int = 6
    eta: float = 0.3
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    max_bin: int = 254
    objective: str = "binary:logistic"
    seed: int = 0

    @classmethod
    def of(cls, params: dict, **more) -> FitConfig:
        known = {k: v for k, v in {**params, **more}.items() if k in cls.__dataclass_fields__}
        return cls(**known)


@dataclass
class Booster:
    """Trees as lists of nodes: feature (-1: leaf), split (left if x < split), default_left, left, right, gain, cover, leaf."""

    config: FitConfig
    features: list[str]
    trees: list[list[dict]] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)

    @property
    def base(self) -> float:
        return 0.0 if self.config.objective == "binary:logistic" else 0.5

    def margin(self, x: np.ndarray, start: int = 0) -> np.ndarray:
        """Sum of leaves from tree ``start`` on, with the base if that is 0."""
        out = np.full(len(x), self.base if start == 0 else 0.0)
        for tree in self.trees[start:]:
            out += evaluate(tree, x)
        return out

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return 1 / (1 + np.exp(-m)) if self.config.objective == "binary:logistic" else m

    def used(self) -> list[int]:
        return sorted({n["feature"] for t in self.trees for n in t if n["feature"] >= 0})

    def nodes(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, n["depth"], n["feature"] < 0, n["feature"], n["split"], n["default_left"], n["left"], n["right"], n["gain"], n["cover"], n["leaf"]) for t, tree in enumerate(self.trees) for i, n in enumerate(tree)]
        return spark.createDataFrame(rows, "tree int, node int, depth int, is_leaf boolean, feature int, split_value double, default_left boolean, left int, right int, gain double, cover double, leaf double")

    def to_json(self) -> str:
        return json.dumps({"config": asdict(self.config), "features": self.features, "trees": self.trees, "cuts": [[float(v) for v in c] for c in self.cuts]})

    @classmethod
    def from_json(cls, text: str) -> Booster:
        d = json.loads(text)
        return cls(FitConfig(**d["config"]), d["features"], d["trees"], [np.array(c, float) for c in d["cuts"]])

    def summary(self) -> dict:
        return {"trees": len(self.trees), "features": len(self.used())}


def evaluate(tree: list[dict], x: np.ndarray) -> np.ndarray:
    """Leaf value of each row; NaN goes the default way."""
    f, s, d, l, r, v = (np.array([n[k] for n in tree]) for k in ("feature", "split", "default_left", "left", "right", "leaf"))
    at = np.zeros(len(x), int)
    for _ in range(len(tree)):
        inner = f[at] >= 0
        if not inner.any():
            break
        k = at[inner]
        value = x[inner, f[k]]
        left = np.where(np.isnan(value), d[k], value < s[k])
        at[inner] = np.where(left, l[k], r[k])
    return v[at]


#: What the cut points of all features may take on the driver and in each executor.
CUT_BYTES = 2 << 30


def cut_points(df: DataFrame, x: str = "x", max_bin: int = 254) -> list[np.ndarray]:
    """Ascending cut points of every element of ``x``: distinct values where they are few, else approximate quantiles.

    Elements are summarised in one pass: each partition sends, for every feature, a weighted sample of at most
    4 * max_bin values, and their merge gives the quantiles; the driver gets at most p * max_bin numbers, which have to
    fit into ``CUT_BYTES``: very wide matrices of continuous values need a smaller ``max_bin``.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] | None = None
        for b in batches:
            m = matrix(b.column(0))
            if not m.size:
                continue
            held = held or [(np.zeros(0), np.zeros(0, np.int64))] * m.shape[1]
            m = np.sort(m, axis=0)  # NaN goes last
            for j, (v, n) in enumerate(held):
                col = m[: len(m) - np.isnan(m[:, j]).sum(), j]
                v, n = _merged(np.concatenate([v, col]), np.concatenate([n, np.ones(len(col), np.int64)]))
                held[j] = (v, n) if len(v) <= 8 * max_bin else _thinned(v, n, 4 * max_bin)
        if held:
            thin = [_thinned(v, n, 4 * max_bin) for v, n in held]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(v) for v, _ in thin])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(thin), dtype=np.int32)), *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([t[k] for t in thin]))) for k in (0, 1))], ["at", "v", "n"])

    parts = df.select(F.col(x).cast("array<double>")).mapInArrow(sketch, "at int, v array<double>, n array<long>")
    # One sample from each partition meets in a row of its feature.
    met = parts.groupBy("at").agg(F.flatten(F.collect_list("v")).alias("v"), F.flatten(F.collect_list("n")).alias("n"))

    @F.arrow_udf("array<double>")
    def cut(v: pa.Array, n: pa.Array) -> pa.Array:
        out = [_thinned(*_merged(a.values.to_numpy(), b.values.to_numpy()), max_bin)[0] for a, b in zip(v, n, strict=True)]
        return pa.array(out, pa.list_(pa.float64()))

    sizes = met.select("at", cut("v", "n").alias("cuts")).persist()
    total = 8 * (sizes.agg(F.sum(F.size("cuts"))).first()[0] or 0)
    if total > CUT_BYTES:
        sizes.unpersist()
        raise ValueError(f"cut points of {total} bytes are above the bound of {CUT_BYTES}: use a smaller max_bin than {max_bin}")
    found = sizes.toArrow().combine_chunks().sort_by("at").column(1).combine_chunks()
    sizes.unpersist()
    flat, ends = found.flatten().to_numpy(), np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())]) if len(found) else np.zeros(1, int)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _merged(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, with the sums of their weights."""
    order = np.argsort(v, kind="stable")
    v, n = v[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, int)
    return v[first], np.add.reduceat(n, first) if len(v) else n


def _thinned(v: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most so many values, evenly spread by weight; the lowest and highest stay."""
    if len(v) <= most:
        return v, n
    mid = np.cumsum(n) - n / 2
    at = np.unique(np.concatenate([[0], np.searchsorted(mid, np.linspace(0, n.sum(), most)[1:-1]).clip(0, len(v) - 1), [len(v) - 1]]))
    return v[at], np.add.reduceat(n, at)


def bin_rows(df: DataFrame, cuts: list[np.ndarray], x: str = "x") -> DataFrame:
    """``df`` with code, the bytes of the bins: the number of cut points <= the value, less one; values below all are in bin 0."""
    sent = df.sparkSession.sparkContext.broadcast(cuts)  # bounded by CUT_BYTES

    @F.arrow_udf("binary")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            m = matrix(b)
            out = np.full(m.shape, MISSING, np.uint8)
            for j, c in enumerate(sent.value if len(b) else ()):
                ok = ~np.isnan(m[:, j])
                out[ok, j] = np.clip(np.searchsorted(c, m[ok, j], side="right") - 1, 0, 254)
            yield byte_rows(out)

    return df.withColumn("code", code(F.col(x).cast("array<double>")))


def _uniform(seed: int, rows: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each row, the same wherever it is computed."""
    z = (rows.astype(np.uint64) + np.uint64(seed % (1 << 32) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(32))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _code_tree(tree: list[dict], cuts: list[np.ndarray]) -> list[dict]:
    """The tree on bin codes; a split value is always a cut point."""
    return [n if n["feature"] < 0 else n | {"split": float(np.searchsorted(cuts[n["feature"]], n["split"]))} for n in tree]


def _gradients(config: FitConfig, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if config.objective == "binary:logistic":
        p = 1 / (1 + np.exp(-margin))
        return p - y, np.maximum(p * (1 - p), 1e-16)
    return margin - y, np.ones(len(y))


def fit(df: DataFrame, config: FitConfig, rounds: int, features: list[str] | None = None, x: str = "x", y: str = "y", start: Booster | None = None, history: list[dict] | None = None, metric=None) -> Booster:
    """``rounds`` more trees on ``df(row_idx, x, y)``, after those of ``start``; rows with a null label don't count.

    history: gets {round, metric, value} of the training rows after each round if ``metric`` is 'logloss', 'rmse' or
    'aucpr'.
    """
    if config.objective not in ("binary:logistic", "reg:squarederror"):
        raise ValueError(f"unknown objective {config.objective!r}")
    rows = df.where(F.col(y).isNotNull()).select("row_idx", x, F.col(y).cast("double").alias("y"))
    cuts = start.cuts if start else cut_points(rows, x, config.max_bin)
    p = len(cuts)
    names = features or (start.features if start else [f"f{i}" for i in range(p)])
    if len(names) != p:
        raise ValueError(f"{len(names)} names for {p} features")
    booster = Booster(config, names, list(start.trees) if start else [], cuts)
    # Old margins once for each row; the new trees are evaluated on codes.
    binned = bin_rows(rows, cuts, x)
    binned = predict(binned, start, x, out="m0", margin=True).select("row_idx", "y", "code", "m0") if start and start.trees else binned.select("row_idx", "y", "code", F.lit(booster.base).alias("m0"))
    binned = binned.persist()
    coded: list[list[dict]] = []
    for r in range(rounds):
        k = len(booster.trees)
        rng = np.random.default_rng([config.seed, k])
        cols = np.sort(rng.permutation(p)[: max(1, round(config.colsample_bytree * p))])
        tree = _grow(binned, booster, coded, cols, k)
        booster.trees.append(tree)
        coded.append(_code_tree(tree, cuts))
        if len(coded) == REBASE:
            binned, coded = _advanced(binned, coded), []
        if history is not None and metric:
            history.append({"round": r, "metric": metric, "value": _loss(binned, config, coded, metric)})
    binned.unpersist()
    return booster


def _advanced(binned: DataFrame, coded: list) -> DataFrame:
    """The persisted rows with the trees' leaves added to m0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.set_column(3, "m0", pa.array(_margin_of(b, coded)))

    out = binned.mapInArrow(run, "row_idx long, y double, code binary, m0 double").persist()
    out.count()
    binned.unpersist()
    return out


def _loss(binned: DataFrame, config: FitConfig, coded: list, metric: str) -> float:
    if metric == "aucpr":
        from lodemill.operators.metrics import score

        def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(1), pa.array(_margin_of(b, coded))], ["y_true", "y_pred"])

        return score(binned.mapInArrow(margins, "y_true double, y_pred double"), "aucpr")
    if metric not in ("logloss", "rmse"):
        raise ValueError(f"unknown metric {metric!r}")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y, m = b.column(1).to_numpy(), _margin_of(b, coded)
                if metric == "rmse":
                    v = (y - (1 / (1 + np.exp(-m)) if config.objective == "binary:logistic" else m)) ** 2
                else:
                    q = np.clip(1 / (1 + np.exp(-m)), 1e-7, 1 - 1e-7)
                    v = -(y * np.log(q) + (1 - y) * np.log(1 - q))
                yield pa.RecordBatch.from_arrays([pa.array([float(v.sum())]), pa.array([float(len(v))])], ["s", "n"])

    r = binned.mapInArrow(part, "s double, n double").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    return float((r.s / r.n) ** 0.5 if metric == "rmse" else r.s / r.n)


def _codes(b: pa.RecordBatch) -> np.ndarray:
    return byte_matrix(b.column(2))


def _as_values(codes: np.ndarray) -> np.ndarray:
    out = codes.astype(float)
    out[codes == MISSING] = np.nan
    return out


def _margin_of(b: pa.RecordBatch, coded: list) -> np.ndarray:
    m = b.column(3).to_numpy().copy()
    if coded:
        v = _as_values(_codes(b))
        for t in coded:
            m += evaluate(t, v)
    return m


def _grow(binned: DataFrame, booster: Booster, coded: list, cols: np.ndarray, k: int) -> list[dict]:
    config, cuts = booster.config, booster.cuts
    width = max(map(len, cuts), default=0) + 1  # bins, and the missing ones
    leaf = lambda depth: {"depth": depth, "feature": -1, "split": 0.0, "default_left": True, "left": -1, "right": -1, "gain": 0.0, "cover": 0.0, "leaf": 0.0}
    tree = [leaf(0)]
    open_ = [0]
    for depth in range(config.max_depth + 1):
        if not open_:
            break
        last = depth == config.max_depth
        partial = _code_tree(tree, cuts)
        best: dict[int, tuple] = {}
        for block in _blocks(cols[:1] if last else cols, len(open_) * width):
            hist = binned.mapInArrow(_histograms(config, coded, partial, open_, block, k, width), "node int, feature int, g array<double>, h array<double>")
            sums = hist.groupBy("node", "feature").agg(_array_sum("g", width).alias("g"), _array_sum("h", width).alias("h"))
            splits = sums.mapInArrow(_splits(config, last), "node int, feature int, bin int, default_left boolean, gain double, g double, h double, gl double, hl double")
            pick = splits.groupBy("node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("nf"), (-F.col("bin")).alias("nb"), "default_left", "g", "h")).alias("m"))
            for r in pick.collect():  # one row for each open node
                best[r.node] = max(best.get(r.node, tuple(r.m)), tuple(r.m))
        grown = []
        for at, (gain, nf, nb, default, g, h) in sorted(best.items()):
            node = tree[at]
            node["cover"], node["leaf"] = h, -config.eta * g / (h + config.reg_lambda)
            if last or not gain > 1e-12:
                continue
            node |= {"feature": int(-nf), "split": float(cuts[-nf][-nb]), "default_left": bool(default), "left": len(tree), "right": len(tree) + 1, "gain": float(gain), "leaf": 0.0}
            tree += [leaf(depth + 1), leaf(depth + 1)]
            grown += [node["left"], node["right"]]
        open_ = grown
    return tree


def _blocks(cols: np.ndarray, cells: int, most: int = 16_000_000) -> list[np.ndarray]:
    """Columns in blocks whose histograms, of so many cells a column, fit into 256 MB."""
    return np.array_split(cols, max(1, -(-len(cols) * cells // most)))


def _array_sum(col: str, width: int):
    """Element sums of arrays: one row for each partition and (node, feature) comes in, so collecting them is bounded by the partitions."""
    return F.aggregate(F.collect_list(col), F.array_repeat(F.lit(0.0), width), lambda s, a: F.zip_with(s, a, lambda p, q: p + q))


def _histograms(config: FitConfig, coded: list, partial: list[dict], open_: list[int], cols: np.ndarray, k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {n: i for i, n in enumerate(open_)}
        g_sum = np.zeros((len(open_), len(cols), width))
        h_sum, seen = np.zeros_like(g_sum), False
        for b in batches:
            if not b.num_rows:
                continue
            rows, y, codes = b.column(0).to_numpy(), b.column(1).to_numpy(), _codes(b)
            keep = _uniform(config.seed * 1_000_003 + k, rows) < config.subsample if config.subsample < 1 else slice(None)
            g, h = _gradients(config, _margin_of(b, coded), y)
            at = _node_of(partial, _as_values(codes))[keep]
            g, h, codes = g[keep], h[keep], codes[keep]
            slot = np.array([place.get(n, -1) for n in range(len(partial))])[at]
            ok = slot >= 0
            seen = seen or ok.any()
            for j, c in enumerate(cols):
                flat = slot[ok] * width + np.minimum(codes[ok, c], width - 1)  # the code of missing ones is above all bins
                g_sum[:, j] += np.bincount(flat, g[ok], len(open_) * width).reshape(len(open_), -1)
                h_sum[:, j] += np.bincount(flat, h[ok], len(open_) * width).reshape(len(open_), -1)
        if seen:
            n = len(open_) * len(cols)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(open_, len(cols)), pa.int32()), pa.array(np.tile(cols, len(open_)), pa.int32()), lists(g_sum.reshape(n, -1)), lists(h_sum.reshape(n, -1))], ["node", "feature", "g", "h"])

    return run


def _node_of(tree: list[dict], x: np.ndarray) -> np.ndarray:
    """Index of the leaf that each row falls into."""
    marked = [n | {"leaf": float(i)} for i, n in enumerate(tree)]
    return evaluate(marked, x).astype(int)


def split_gain(gl, hl, g, h, reg_lambda: float, gamma: float):
    """Half of the loss that a split takes off, less gamma."""
    return 0.5 * (gl**2 / (hl + reg_lambda) + (g - gl) ** 2 / (h - hl + reg_lambda) - g**2 / (h + reg_lambda)) - gamma


def _splits(config: FitConfig, last: bool):
    """The best split of each (node, feature); bin b: left are the codes below b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "feature", "bin", "default_left", "gain", "g", "h", "gl", "hl"]
        for b in batches:
            out = []
            for node, feature, gs, hs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), matrix(b.column(2)), matrix(b.column(3)), strict=True):
                g, h = gs.sum(), hs.sum()
                best = (0.0, 0, True, 0.0, 0.0)
                if not last:
                    gm, hm = gs[-1], hs[-1]
                    for default in (True, False):
                        gl, hl = np.cumsum(gs[:-1])[:-1] + gm * default, np.cumsum(hs[:-1])[:-1] + hm * default
                        ok = (hl >= config.min_child_weight) & (h - hl >= config.min_child_weight)
                        gain = np.where(ok, split_gain(gl, hl, g, h, config.reg_lambda, config.gamma), -np.inf)
                        i = int(np.argmax(gain)) if len(gain) else -1
                        if i >= 0 and gain[i] > best[0] + 1e-12:
                            best = (float(gain[i]), i + 1, default, float(gl[i]), float(hl[i]))
                out.append((node, feature, best[1], best[2], best[0], g, h, best[3], best[4]))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), *[pa.float64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(9)], names)

    return run


def predict(df: DataFrame, booster: Booster, x: str = "x", out: str = "y_pred", margin: bool = False) -> DataFrame:
    """``df`` with the prediction; a booster is a few megabytes, bounded by its rounds and depth, and is broadcast."""
    sent = df.sparkSession.sparkContext.broadcast(booster)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            m, b = matrix(col), sent.value
            yield pa.array((b.margin(m) if margin else b.predict_array(m)) if len(col) else np.zeros(0), pa.float64())

    return df.withColumn(out, run(F.col(x).cast("array<double>")))


def drawn_chunks(chunk: Column, share: float, seed: int, r: int) -> Column:
    """Whether round ``r`` draws a chunk: by the first 32 bits of md5(seed|round|chunk)."""
    return F.conv(F.substring(seeded(f"{seed}|{r}", chunk), 1, 8), 16, 10).cast("long") < int(share * (1 << 32))


def incremental_fit(df: DataFrame, config: FitConfig, rounds: int, per_round: int, chunk: int, path=None, start: Booster | None = None, start_round: int = 0) -> Booster:
    """Boosting that sees a fresh draw of row chunks each round: a share ``subsample`` of them, and all their rows.

    ``path``: function of the round that says in which folder of the cluster's store its model goes, so that a stopped
    run can go on from ``start_round``.
    """
    booster = start
    share, config = config.subsample, FitConfig(**{**asdict(config), "subsample": 1.0})
    for r in range(start_round, rounds):
        part = df.where(drawn_chunks(F.floor(F.col("row_idx") / chunk), share, config.seed, r))
        booster = fit(part, config, per_round, start=booster)
        if path:
            spark = df.sparkSession
            spark.createDataFrame([(booster.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path(r))
    return booster


def tree_sql(tree: list[dict], x: str = "x", at: int = 0) -> str:
    """One tree as nested CASE, for small models."""
    n = tree[at]
    if n["feature"] < 0:
        return repr(float(n["leaf"]))
    v = f"get({x}, {n['feature']})"
    cond = f"({v} IS NULL OR isnan({v}) OR {v} < {n['split']!r})" if n["default_left"] else f"{v} < {n['split']!r}"
    return f"CASE WHEN {cond} THEN {tree_sql(tree, x, n['left'])} ELSE {tree_sql(tree, x, n['right'])} END"
