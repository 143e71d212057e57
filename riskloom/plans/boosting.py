"""Histogram boosting of binary labels, grown for several models at once: one pass of the rows and one shuffle a level.

Features are binned once by their exact quantiles; a row is then a byte string of bins, its label, its weight and its folds. A model is grown on the rows
outside its held-out fold (of a column of folds; there may be several, say one for each seed), and all models (one for each fold, and maybe one of all rows) share each pass. A level is one job: tasks
add up gradients, hessians and rows of each (model, node, feature, bin) in arrays, the arrays of a feature meet, and the best split of
each node (of each partition) comes to the driver, which holds nothing but the trees.

Gradients and hessians are fixed-point integers (2**-SHIFT), so sums, and the trees with them, are the same however the rows are dealt. A
feature may be held to be rising or falling: a split against that is never taken, and both sides pass the middle of their values down as a bound.
Missing values have a bin of their own, which goes to whichever side gains more.

With held-out folds each round is also judged on them (AUC, average precision or log loss), in the pass that begins the next
tree; a model that hasn't bettered for `patience` rounds is finished and scores with its best round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import exact_quantiles
from ..operators.profile import to_long
from ..scratch import dropped, written

#: Gradients are multiples of 2**-SHIFT: sums of 2**34 rows of weight 1 fit a long.
SHIFT = 28
#: Scores are judged on a grid of log-odds: so many steps for 1, up to +-RANGE.
STEPS, RANGE = 128, 16
#: Trees between two writings of the rows' scores; cells (models x nodes x features x bins) a task adds up at once; rows of a block.
REFRESH, MOST_CELLS, BLOCK = 10, 1 << 22, 4096
MISSING = 0


@dataclass(frozen=True)
class Parameters:
    """rounds: trees at most. rate: of learning. child_weight: least hessian of a side. ridge, lasso: penalties on leaf values. gain: what a split must bring. rows, columns: shares drawn for each tree. positive: weight of positive rows.
    rising: +1 or -1 for features whose effect must rise or fall. every_round: score with all rounds, whatever held-out rows say."""

    rounds: int = 30
    rate: float = 0.1
    depth: int = 3
    child_weight: float = 1.0
    ridge: float = 1.0
    lasso: float = 0.0
    gain: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    positive: float = 1.0
    bins: int = 32
    patience: int | None = None
    metric: str = "auc"
    rising: dict[str, int] = field(default_factory=dict)
    seed: int = 42
    every_round: bool = False

    def __post_init__(self):
        if not 2 <= self.bins <= 255 or self.depth < 1 or self.metric not in ("auc", "ap", "logloss"):
            raise ValueError("bins from 2 to 255, depth from 1, metric auc, ap or logloss")
        if any(v not in (-1, 0, 1) for v in self.rising.values()):
            raise ValueError("rising: 1, -1 or 0")


@dataclass
class Tree:
    """Nodes as in a heap (children of i: 2i + 1, 2i + 2). A row goes left if its bin is at most `at`; a missing one if `left`. value: of a node that isn't split."""

    feature: np.ndarray
    at: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: dict[int, tuple[int, float]] = field(default_factory=dict)

    @classmethod
    def blank(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n))

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node each row of bins ends in."""
        at = np.zeros(len(x), np.int64)
        for _ in range(len(self.feature).bit_length()):
            inner = self.feature[at] >= 0
            if not inner.any():
                break
            i = np.flatnonzero(inner)
            node = at[i]
            b = x[i, self.feature[node]]
            left = np.where(b == MISSING, self.left[node], b <= self.at[node])
            at[i] = 2 * node + 2 - left
        return at


@dataclass
class Model:
    """held: the column and the fold that the model hasn't seen (None: it has seen all). best: the rounds it scores with; curve: the metric after each round."""

    held: tuple[str, int] | None
    base: float
    p: Parameters
    trees: list[Tree] = field(default_factory=list)
    curve: list[float] = field(default_factory=list)
    best: int = 0
    grown: int = 0
    done: bool = False


@dataclass
class Ensemble:
    features: list[str]
    edges: list[np.ndarray]
    models: list[Model]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of a matrix of doubles: 0 for missing values, else 1 and one more for each edge below the value."""
    out = np.zeros(x.shape, np.uint8)
    for j, e in enumerate(edges):
        c = x[:, j]
        out[:, j] = np.where(np.isnan(c), MISSING, 1 + np.searchsorted(e, c, side="left"))
    return out


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.stack([batch.column(f).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for f in features], axis=1) if features else np.zeros((batch.num_rows, 0))


def feature_edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """The distinct inner quantiles of each feature (missing and NaN values left out), so that bins - 1 bins hold values."""
    long = to_long(df, features, ("row_id",)).where("x is not null and not isnan(x)")
    cuts = exact_quantiles(long, ["feature"], "x", [i / (bins - 1) for i in range(1, bins - 1)]) if bins > 2 else None
    found = {r["feature"]: sorted({v for k, v in r.asDict().items() if k != "feature"}) for r in cuts.collect()} if cuts is not None else {}
    return [np.array(found.get(f, []), np.float64) for f in features]


def rows_of(df: DataFrame, features: list[str], edges: list[np.ndarray], columns: list[str], base: list[float]) -> DataFrame:
    """row_id, y, folds (of the columns), w, x (a byte a feature) and raw (a score for each model), written."""
    names, models = ["row_id", "y", "folds", "w"], len(base)
    schema = pa.schema([("row_id", pa.int64()), ("y", pa.int32()), ("folds", pa.list_(pa.int32())), ("w", pa.float64()), ("x", pa.binary()), ("raw", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = binned(_matrix(batch, features), edges)
            n, f = x.shape
            data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * f).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
            raw = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * models, pa.int32()), pa.array(np.tile(base, n)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), data, raw], schema=schema)

    folds = F.array(*(F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in columns)) if columns else F.array().cast("array<int>")
    rows = df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("y").cast("int").alias("y"), folds.alias("folds"), F.coalesce(F.col("w"), F.lit(0.0)).alias("w"), *features).where("y is not null and row_id is not null")
    return written(rows.mapInArrow(run, ROWS), "boosting-rows")


ROWS = "row_id bigint, y int, folds array<int>, w double, x binary, raw array<double>"


def _bins(x: pa.Array, features: int) -> np.ndarray:
    if not features or not len(x):
        return np.zeros((len(x), features), np.uint8)
    start = np.frombuffer(x.buffers()[1], np.int32)[x.offset]
    return np.frombuffer(x.buffers()[2], np.uint8)[start : start + len(x) * features].reshape(len(x), features)


def _block(batch: pa.RecordBatch, features: int, models: int) -> tuple[np.ndarray, ...]:
    """row_id, y, folds, w, bins, raw."""
    lists = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1)) for c in ("folds", "raw"))
    folds, raw = lists
    return batch.column("row_id").to_numpy(), batch.column("y").to_numpy(), folds, batch.column("w").to_numpy(), _bins(batch.column("x"), features), raw.reshape(-1, models)


def _add_trees(raw: np.ndarray, x: np.ndarray, pending: list[list[Tree]], rates: list[float]) -> np.ndarray:
    """raw with the trees of each model added, one after the other."""
    raw = raw.copy()
    for k, trees in enumerate(pending):
        for t in trees:
            raw[:, k] += rates[k] * t.value[t.nodes(x)]
    return raw


def drawn(row_id: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree sees: decided by the row's id, so the same for every dealing of the rows."""
    if share >= 1:
        return np.ones(len(row_id), bool)
    h = row_id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(zlib.crc32(f"{seed}:{tree}".encode()))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)) < np.uint64(int(share * (1 << 53)))


def gradients(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log loss, as multiples of 2**-SHIFT."""
    p = 1 / (1 + np.exp(-raw))
    scale = float(1 << SHIFT)
    return np.rint(w * (p - y) * scale).astype(np.int64), np.rint(w * p * (1 - p) * scale).astype(np.int64)


def _value(g: np.ndarray, h: np.ndarray, p: Parameters, low: float, high: float) -> np.ndarray:
    shrunk = np.sign(g) * np.maximum(np.abs(g) - p.lasso, 0)
    return np.clip(-shrunk / np.maximum(h + p.ridge, 1e-12), low, high)


def _worth(g: np.ndarray, h: np.ndarray, v: np.ndarray, p: Parameters) -> np.ndarray:
    """How much the loss falls if rows with these sums take the value v."""
    return -(g * v + 0.5 * (h + p.ridge) * v * v + p.lasso * np.abs(v))


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: Parameters, low: float, high: float, rising: int) -> tuple | None:
    """(gain, bin, whether missing values go left, then value, g, h of the left and of the right side) of a feature's sums by bin (MISSING first); the first of equally good ones."""
    scale = float(1 << SHIFT)
    best = None
    g_all, h_all = g.sum() / scale, h.sum() / scale
    own = _worth(g_all, h_all, _value(g_all, h_all, p, low, high), p)
    for missing_left in (False, True) if n[MISSING] else (False,):
        lead = slice(0, None) if missing_left else slice(1, None)
        skip = 0 if not missing_left else 1
        gl, hl, nl = (np.cumsum(a[lead])[skip:-1] for a in (g, h, n))
        gr, hr, nr = (g.sum() - gl) / scale, (h.sum() - hl) / scale, n.sum() - nl
        gl, hl = gl / scale, hl / scale
        vl, vr = _value(gl, hl, p, low, high), _value(gr, hr, p, low, high)
        gain = _worth(gl, hl, vl, p) + _worth(gr, hr, vr, p) - own
        ok = (nl > 0) & (nr > 0) & (hl >= p.child_weight) & (hr >= p.child_weight) & (gain > max(p.gain, 1e-9))
        if rising:
            ok &= rising * (vr - vl) >= 0
        if not ok.any():
            continue
        i = int(np.argmax(np.where(ok, gain, -np.inf)))
        if best is None or gain[i] > best[0]:
            best = (float(gain[i]), i + 1, missing_left, float(vl[i]), float(gl[i]), float(hl[i]), float(vr[i]), float(gr[i]), float(hr[i]))
    return best


def better(a, b):
    """The row of FOUND with the higher gain, of equal ones that of the earlier feature."""
    return b if a is None or (b["gain"] or 0, -(b["feature"] or 0)) > (a["gain"] or 0, -(a["feature"] or 0)) else a


FOUND = "node bigint, feature int, gain double, at int, missing_left boolean, vl double, gl double, hl double, vr double, gr double, hr double"


class _Grower:
    """Grows the models' trees over the written rows."""

    def __init__(self, df: DataFrame, features: list[str], p: Parameters | list[Parameters], held: list, edges: list[np.ndarray] | None = None):
        ps = p if isinstance(p, list) else [p] * len(held)
        self.features, self.bins = features, ps[0].bins
        if any(x.bins != self.bins for x in ps):
            raise ValueError("models that grow together have the same bins")
        self.edges = edges if edges is not None else feature_edges(df, features, self.bins)
        held = [("fold", h) if isinstance(h, int) else h for h in held]
        self.columns = sorted({h[0] for h in held if h} | ({"fold"} if "fold" in df.columns else set()))
        weight = F.coalesce(F.col("w").cast("double"), F.lit(0.0)) if "w" in df.columns else F.lit(1.0)
        seen = lambda h: F.lit(True) if h is None else ~F.col(h[0]).eqNullSafe(F.lit(h[1]))
        asked = list(dict.fromkeys(held))
        sums = df.where("y is not null").select("*", weight.alias("_w")).agg(*(F.coalesce(F.sum(F.when(seen(h) & ((F.col("y") == 1) == F.lit(one)), F.col("_w"))), F.lit(0.0)).alias(f"{i}_{int(one)}") for i, h in enumerate(asked) for one in (False, True))).first()
        self.models = []
        for h, x in zip(held, ps):
            zeros, ones = sums[f"{asked.index(h)}_0"], x.positive * sums[f"{asked.index(h)}_1"]
            share = min(max(ones / (ones + zeros), 1e-6), 1 - 1e-6) if ones + zeros else 0.5
            self.models.append(Model(h, float(np.log(share / (1 - share))), x))
        self.rows = rows_of(df.withColumn("w", weight), features, self.edges, self.columns, [m.base for m in self.models])
        self.pending: list[list[Tree]] = [[] for _ in held]

    def level(self, depth: int, tree: int, open_: dict[int, dict[int, tuple[float, float]]], judge: bool, by_feature: bool = False) -> tuple[dict, dict]:
        """Best splits {(model, node): row of FOUND} of the open nodes {model: {node: bounds}}, and counts on the grid {model: array} of held-out rows if judge. by_feature: the best of each feature, under (model, node, feature)."""
        features, held = len(self.features), [(self.columns.index(m.held[0]), m.held[1]) if m.held else None for m in self.models]
        ps, rates = [m.p for m in self.models], [m.p.rate for m in self.models]
        bins, grid = self.bins + 1, 2 * STEPS * RANGE + 1
        pending = [list(t) for t in self.pending]
        growing = {k: m.trees[-1] for k, m in enumerate(self.models) if k in open_}
        chosen = {k: self.chosen(k, tree) for k in open_}
        rising = {k: [ps[k].rising.get(f, 0) for f in self.features] for k in open_}
        nodes = [(k, n) for k in open_ for n in sorted(open_[k])]
        at_once = max(1, MOST_CELLS // max(1, features * bins))
        judged = [k for k, m in enumerate(self.models) if judge and m.held is not None and not m.done and len(m.curve) < m.grown]
        splits, grids = {}, {}
        sums_schema = pa.schema([("cell", pa.int64()), ("data", pa.binary())])
        for lo in range(0, max(1, len(nodes)), at_once):
            part = nodes[lo : lo + at_once]
            number = {kn: i for i, kn in enumerate(part)}
            asked = judged if not lo else []
            if not part and not asked:
                break

            def add(batches: Iterator[pa.RecordBatch], part=part, number=number, asked=asked) -> Iterator[pa.RecordBatch]:
                total = np.zeros((3, len(part) * features * bins), np.int64)
                seen = np.zeros((len(held), 2, grid), np.int64)
                loss = np.zeros((len(held), 2), np.int64)
                of_node = {k: np.full(2 ** (depth + 1) - 1, -1) for k, _ in part}
                for (k, n), i in number.items():
                    of_node[k][n] = i
                for batch in batches:
                    for at in range(0, batch.num_rows, BLOCK):
                        row_id, y, folds, w, x, raw = _block(batch.slice(at, BLOCK), features, len(held))
                        raw = _add_trees(raw, x, pending, rates)
                        for k in asked:
                            out = folds[:, held[k][0]] == held[k][1]
                            cell = np.clip(np.rint(raw[out, k] * STEPS), -STEPS * RANGE, STEPS * RANGE).astype(np.int64) + STEPS * RANGE
                            for c in (0, 1):
                                seen[k, c] += np.bincount(cell[y[out] == c], minlength=grid)
                            z = np.where(y[out] == 1, -raw[out, k], raw[out, k])
                            loss[k] += np.array([np.rint(np.logaddexp(0, z) * (1 << 20)).astype(np.int64).sum(), out.sum()])
                        for k, slots in of_node.items():
                            use = drawn(row_id, tree, ps[k].rows, ps[k].seed)
                            use = use if held[k] is None else use & (folds[:, held[k][0]] != held[k][1])
                            at_node = growing[k].nodes(x)
                            slot = np.where(at_node < len(slots), slots[np.minimum(at_node, len(slots) - 1)], -1)
                            i = np.flatnonzero(use & (slot >= 0) & (w > 0))
                            if not len(i):
                                continue
                            g, h = gradients(raw[i, k], y[i], np.where(y[i] == 1, ps[k].positive, 1.0) * w[i])
                            cells = ((slot[i][:, None] * features + np.arange(features)) * bins + x[i]).reshape(-1)
                            for t, v in zip(total, (g, h, None)):
                                # Sums of a block stay far below 2**53, where doubles are exact integers.
                                t += np.bincount(cells, None if v is None else np.repeat(v, features).astype(np.float64), len(t)).astype(np.int64)
                total = total.reshape(3, -1, bins)
                some = np.flatnonzero(total[2].any(axis=1) & (np.concatenate([chosen[k] for k, _ in part]) if part else True))
                for at in range(0, len(some), 512):
                    cells = some[at : at + 512]
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array([total[:, c].tobytes() for c in cells], pa.binary())], schema=sums_schema)
                for k in asked:
                    if loss[k, 1]:
                        yield pa.RecordBatch.from_arrays([pa.array([-1 - k]), pa.array([np.append(seen[k].reshape(-1), loss[k]).tobytes()], pa.binary())], schema=sums_schema)

            def meet(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
                names = [c.split()[0] for c in FOUND.split(", ")] + ["data"]

                def one(cell: int, data: np.ndarray) -> dict | None:
                    if cell < 0:
                        return {"node": cell, "data": data.tobytes()}
                    k, node = part[cell // features]
                    f = cell % features
                    got = best_split(*data.reshape(3, bins), ps[k], *open_[k][node], rising[k][f])
                    return dict(zip(names, (cell // features, f, *got))) if got else None

                best, open_cell, data = {}, None, None

                def close() -> None:
                    r = one(open_cell, data) if open_cell is not None else None
                    if r:
                        key = (r["node"], r["feature"]) if by_feature else r["node"]
                        best[key] = better(best.get(key), r)

                for batch in batches:
                    for cell, b in zip(batch.column("cell").to_pylist(), batch.column("data")):
                        row = np.frombuffer(b.as_buffer(), np.int64)
                        if cell == open_cell:
                            data = data + row
                            continue
                        close()
                        open_cell, data = cell, row
                close()
                yield pa.RecordBatch.from_pylist(list(best.values()), found_schema)

            found_schema = pa.schema([("node", pa.int64()), ("feature", pa.int32()), ("gain", pa.float64()), ("at", pa.int32()), ("missing_left", pa.bool_()), *((c, pa.float64()) for c in ("vl", "gl", "hl", "vr", "gr", "hr")), ("data", pa.binary())])
            sums = self.rows.mapInArrow(add, "cell bigint, data binary").repartition("cell").sortWithinPartitions("cell")
            for r in sums.mapInArrow(meet, FOUND + ", data binary").collect():  # a row for each open node and each judged model at most, of each partition
                if r["node"] < 0:
                    grids[-1 - r["node"]] = np.frombuffer(r["data"], np.int64)
                else:
                    key = (*part[r["node"]], r["feature"]) if by_feature else part[r["node"]]
                    splits[key] = better(splits.get(key), r)
        return splits, grids

    def chosen(self, k: int, tree: int) -> np.ndarray:
        """The features that a tree of the model may use, one at least."""
        p, n = self.models[k].p, len(self.features)
        out = np.array([p.columns >= 1 or zlib.crc32(f"{p.seed}:{tree}:{f}".encode()) / 2**32 < p.columns for f in self.features], bool)
        if n and not out.any():
            out[tree % n] = True
        return out

    def judge(self, grids: dict) -> None:
        """Adds a round to the curves; models that haven't bettered in time, or have all their rounds, are done."""
        for k, m in enumerate(self.models):
            if k in grids:
                m.curve.append(judged_on_grid(grids[k], m.p.metric))
                better = len(m.curve) == 1 or m.curve[-1] > max(m.curve[:-1])
                m.best = len(m.curve) if better else m.best
                m.done = bool(m.p.patience and len(m.curve) - m.best >= m.p.patience)
            m.done = m.done or m.grown >= m.p.rounds

    def refresh(self) -> None:
        """Writes the rows' scores anew, with the trees so far."""
        features, models, pending, rates = len(self.features), len(self.models), [list(t) for t in self.pending], [m.p.rate for m in self.models]
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    *_, x, raw = _block(part, features, models)
                    raw = _add_trees(raw, x, pending, rates).reshape(-1)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row_id", "y", "folds", "w", "x")), pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * models, pa.int32()), pa.array(raw))], names=["row_id", "y", "folds", "w", "x", "raw"])

        before, self.rows = self.rows, written(self.rows.mapInArrow(run, ROWS), "boosting-rows")
        dropped(before)
        self.pending = [[] for _ in self.models]

    def grow(self) -> None:
        tree = 0
        while any(not m.done for m in self.models):
            if max(map(len, self.pending)) >= REFRESH:
                self.refresh()
            live = [k for k, m in enumerate(self.models) if not m.done and m.grown < m.p.rounds]
            for k in live:
                self.models[k].trees.append(Tree.blank(self.models[k].p.depth))
            open_ = {k: {0: (-np.inf, np.inf)} for k in live}
            for depth in range(max((self.models[k].p.depth for k in live), default=1)):
                splits, grids = self.level(depth, tree, open_, depth == 0)  # judged are the trees before this one
                if not depth:
                    self.judge(grids)
                following: dict[int, dict] = {}
                for (k, n), s in splits.items():
                    m = self.models[k]
                    if m.done:
                        continue
                    t, (low, high) = m.trees[-1], open_[k][n]
                    f = s["feature"]
                    t.feature[n], t.at[n], t.left[n] = f, s["at"], s["missing_left"]
                    t.value[2 * n + 1], t.value[2 * n + 2] = s["vl"], s["vr"]
                    t.gain[n] = (f, s["gain"])
                    middle = (s["vl"] + s["vr"]) / 2
                    turn = m.p.rising.get(self.features[f], 0)
                    left = (low, middle) if turn > 0 else (middle, high) if turn < 0 else (low, high)
                    right = (middle, high) if turn > 0 else (low, middle) if turn < 0 else (low, high)
                    if depth + 1 < m.p.depth:
                        following.setdefault(k, {}).update({2 * n + 1: left, 2 * n + 2: right})
                open_ = following
                if not open_:
                    break
            for k in live:
                m = self.models[k]
                if m.done:  # the tree that was open when the model was judged
                    m.trees.pop()
                else:
                    self.pending[k].append(m.trees[-1])
                    m.grown += 1
                    m.done = m.held is None and m.grown >= m.p.rounds
            tree += 1
        for m in self.models:
            if not m.curve or m.p.every_round:
                m.best = len(m.trees)


def split_gains(df: DataFrame, features: list[str], p: Parameters | None = None, edges: list[np.ndarray] | None = None) -> DataFrame:
    """feature, at, missing_left, edge, gain: the best first split of each feature, by how much a single split of all rows lowers the log loss. Features without a split that gains have no row."""
    p = p or Parameters()
    grower = _Grower(df, features, p, [None], edges)
    rows = []
    grower.models[0].trees.append(Tree.blank(1))
    found = grower.level(0, 0, {0: {0: (-np.inf, np.inf)}}, False, by_feature=True)[0]
    for (k, node, f), s in found.items():
        edge = grower.edges[f]
        rows.append((features[f], s["at"], s["missing_left"], float(edge[s["at"] - 1]) if s["at"] <= len(edge) else None, s["gain"]))
    dropped(grower.rows)
    return df.sparkSession.createDataFrame(rows, "feature string, at int, missing_left boolean, edge double, gain double")


def judged_on_grid(data: np.ndarray, metric: str) -> float:
    """A metric (the higher the better) of counts by class on the grid, and of the sum of losses."""
    neg, pos = data[:-2].reshape(2, -1).astype(np.float64)
    if metric == "logloss":
        return -float(data[-2]) / float(1 << 20) / float(data[-1])
    n1, n0 = pos.sum(), neg.sum()
    if metric == "auc":
        below = np.cumsum(neg) - neg / 2
        return float((pos * below).sum() / (n1 * n0)) if n1 and n0 else 0.5
    cum_pos, cum = np.cumsum(pos[::-1]), np.cumsum((pos + neg)[::-1])
    return float((pos[::-1] * cum_pos / np.maximum(cum, 1)).sum() / n1) if n1 else 0.0


def fit(df: DataFrame, features: list[str], p: Parameters | list[Parameters] | None = None, held: list | None = None, edges: list[np.ndarray] | None = None) -> tuple[Ensemble, DataFrame]:
    """The models of df (row_id, y, features; the columns of held-out folds; w, a weight), and their scores: row_id, fold, y and p of each row.

    held: for each model (column, fold), or a fold of the column fold, or None for one that sees all rows (the default). p: for all models, or a list, one for
    each. The score p is by the model whose fold of the column fold
    the row is in, else by the model of all rows (null if there is none); with other columns of folds, or several models of a fold, the scores are model (its number), row_id, y, p, of its
    held-out rows (or all). Rows without y or row_id are left out; no rows and one class are no errors: such models have a base score and no trees.
    """
    grower = _Grower(df, features, p or Parameters(), held if held is not None else [None], edges)
    grower.grow()
    out = Ensemble(features, grower.edges, grower.models)
    if set(grower.columns) <= {"fold"} and len({m.held for m in out.models}) == len(out.models):
        rows = grower.rows.select("row_id", F.coalesce(F.get("folds", F.lit(0)), F.lit(-1)).alias("fold"), "y", "x")
        scores = rows.mapInArrow(_scorer(out, binned_rows=True), "row_id bigint, fold int, y int, p double")
    else:
        scores = grower.rows.select("row_id", "folds", "y", "x").mapInArrow(_held_scorer(out, grower.columns), "model int, row_id bigint, y int, p double")
    scores = written(scores, "boosting-scores")
    dropped(grower.rows)
    return out, scores


def _held_scorer(e: Ensemble, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, folds = _bins(part.column("x"), len(e.features)), part.column("folds").flatten().to_numpy().reshape(part.num_rows, -1)
                for k, m in enumerate(e.models):
                    mine = np.arange(len(x)) if m.held is None else np.flatnonzero(folds[:, columns.index(m.held[0])] == m.held[1])
                    raw = _add_trees(np.full((len(mine), 1), m.base), x[mine], [m.trees[: m.best]], [m.p.rate])[:, 0]
                    take = pa.array(mine)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), k, np.int32)), part.column("row_id").take(take), part.column("y").take(take), pa.array(1 / (1 + np.exp(-raw)))], names=["model", "row_id", "y", "p"])

    return run


def _scorer(e: Ensemble, binned_rows: bool = False):
    places = {m.held and m.held[1]: k for k, m in enumerate(e.models)}
    trees, rates = [[*m.trees[: m.best]] for m in e.models], [m.p.rate for m in e.models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.num_rows
                x = _bins(part.column("x"), len(e.features)) if binned_rows else binned(_matrix(part, e.features), e.edges)
                raw = _add_trees(np.tile([m.base for m in e.models], (n, 1)), x, trees, rates)
                fold = part.column("fold").to_numpy()
                model = np.array([places.get(f, places.get(None, -1)) for f in fold.tolist()], np.int64)
                p = 1 / (1 + np.exp(-raw[np.arange(n), model])) if n else np.zeros(0)
                yield pa.RecordBatch.from_arrays([part.column("row_id"), part.column("fold"), part.column("y"), pa.array(p, mask=model < 0)], names=["row_id", "fold", "y", "p"])

    return run


def scorer_of(e: Ensemble, k: int = 0):
    """The model's probabilities for a matrix of doubles, a column for each feature."""
    m = e.models[k]
    return lambda x: 1 / (1 + np.exp(-_add_trees(np.full((len(x), 1), m.base), binned(x, e.edges), [m.trees[: m.best]], [m.p.rate])[:, 0]))


def predict(e: Ensemble, df: DataFrame) -> DataFrame:
    """row_id, fold, y, p of df (row_id, features; maybe y and fold): a row of a held-out fold by the model that hasn't seen it."""
    fold = F.col("fold").cast("int") if "fold" in df.columns else F.lit(-1)
    y = F.col("y").cast("int") if "y" in df.columns else F.lit(None).cast("int")
    rows = df.select(F.col("row_id").cast("bigint").alias("row_id"), F.coalesce(fold, F.lit(-1)).alias("fold"), y.alias("y"), *e.features)
    return rows.mapInArrow(_scorer(e), "row_id bigint, fold int, y int, p double")


def importance(e: Ensemble, how: str = "average") -> list[tuple[str, float]]:
    """(feature, importance), the highest first: gains of the splits, averaged over the models. average: a feature's mean gain, as a share of all features' means; total: the sum of its gains."""
    out = np.zeros(len(e.features))
    for m in e.models:
        total, n = np.zeros(len(e.features)), np.zeros(len(e.features))
        for t in m.trees[: m.best]:
            for f, gain in t.gain.values():
                total[f] += gain
                n[f] += 1
        if how == "average":
            mean = total / np.maximum(n, 1)
            total = mean / mean.sum() if mean.sum() else mean
        out += total / len(e.models)
    return sorted(zip(e.features, out.tolist()), key=lambda x: (-x[1], x[0]))


def cross_validated(df: DataFrame, features: list[str], p: Parameters | None = None, folds: int = 5, whole: bool = False) -> tuple[Ensemble, DataFrame]:
    """fit() with a model for each fold of df (fold: 0 to folds - 1), and one of all rows if whole."""
    return fit(df, features, p, [*range(folds), *([None] if whole else [])])


def curves(e: Ensemble, spark) -> DataFrame:
    """fold, round, metric, and whether the model scores with that round."""
    rows = [(m.held and m.held[1], i + 1, v, i + 1 == m.best) for m in e.models for i, v in enumerate(m.curve)]
    return spark.createDataFrame(rows, "fold int, round int, metric double, is_best boolean")
