"""Networks of tabular features, trained by mini-batches that Spark deals: a perceptron and attention over features.

Rows are put in order of md5(row_id|seed) once and packed into blocks; an epoch goes through the blocks in a drawn order, some at a time. A step adds up the gradients
of its blocks and is one of AdamW with a warm-up and a cosine. Each step needs the parameters that the one before has left, so an epoch is walked in legs of LEG blocks:
Spark deals the blocks to the legs, a leg is one job with a task for each model, which takes the leg's steps in their order, and the driver hands parameters (and nothing of the rows)
from leg to leg. A step of more blocks than a leg is a job over its blocks. Gradients are added as fixed-point integers, so a run is the same however blocks are dealt. As in
boosting, a model for each held-out fold, and maybe one of all rows, share each pass; after an epoch held-out rows are scored, and a model that doesn't better for
`patience` epochs stops and keeps its best parameters.

Batch norms use the statistics of their block, and running means of those for scores. GELU is in its tanh form.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import prefix_sums
from ..scratch import dropped, written
from .boosting import RANGE, STEPS, judged_on_grid

#: Gradients are added as multiples of 2**-SHIFT.
SHIFT = 36
EPS = 1e-5
#: Blocks that one task takes at most, one after the other.
LEG = 64


class Var:
    """A value with the ways its gradient goes back: (Var, function of this one's gradient)."""

    def __init__(self, v: np.ndarray, back: tuple = ()):
        self.v, self.back, self.grad = v, back, None

    def __add__(self, o: Var) -> Var:
        return Var(self.v + o.v, ((self, lambda g: _fit(g, self.v.shape)), (o, lambda g: _fit(g, o.v.shape))))

    def __mul__(self, o: Var) -> Var:
        return Var(self.v * o.v, ((self, lambda g: _fit(g * o.v, self.v.shape)), (o, lambda g: _fit(g * self.v, o.v.shape))))

    def __matmul__(self, o: Var) -> Var:
        turn = lambda a: np.swapaxes(a, -1, -2)
        return Var(self.v @ o.v, ((self, lambda g: _fit(g @ turn(o.v), self.v.shape)), (o, lambda g: _fit(turn(self.v) @ g, o.v.shape))))

    def moved(self, f: Callable, back: Callable) -> Var:
        """The same numbers in other places."""
        return Var(f(self.v), ((self, back),))

    def backward(self) -> None:
        order, seen = [], set()

        def visit(x: Var) -> None:
            if id(x) not in seen:
                seen.add(id(x))
                for y, _ in x.back:
                    visit(y)
                order.append(x)

        visit(self)
        self.grad = np.ones_like(self.v)
        for x in reversed(order):
            for y, f in x.back:
                g = f(x.grad)
                y.grad = g if y.grad is None else y.grad + g


def _fit(g: np.ndarray, shape: tuple) -> np.ndarray:
    """g summed over the axes along which a value of the shape was repeated."""
    g = g.sum(axis=tuple(range(g.ndim - len(shape)))) if g.ndim > len(shape) else g
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(axis=i, keepdims=True)
    return g


def gelu(x: Var) -> Var:
    c = np.sqrt(2 / np.pi)
    t = np.tanh(c * (x.v + 0.044715 * x.v**3))
    slope = 0.5 * (1 + t) + 0.5 * x.v * (1 - t * t) * c * (1 + 3 * 0.044715 * x.v**2)
    return Var(0.5 * x.v * (1 + t), ((x, lambda g: g * slope),))


def softmax(x: Var) -> Var:
    e = np.exp(x.v - x.v.max(axis=-1, keepdims=True))
    p = e / e.sum(axis=-1, keepdims=True)
    return Var(p, ((x, lambda g: p * (g - (g * p).sum(axis=-1, keepdims=True))),))


def normed(x: Var, axis: int) -> tuple[Var, np.ndarray, np.ndarray]:
    """x with mean 0 and variance 1 along the axis; the mean and the variance."""
    mean, var = x.v.mean(axis=axis, keepdims=True), x.v.var(axis=axis, keepdims=True)
    s = 1 / np.sqrt(var + EPS)
    z = (x.v - mean) * s
    return Var(z, ((x, lambda g: s * (g - g.mean(axis=axis, keepdims=True) - z * (g * z).mean(axis=axis, keepdims=True))),)), mean, var


def dropout(x: Var, share: float, rng: np.random.Generator | None) -> Var:
    if rng is None or share <= 0:
        return x
    keep = Var((rng.random(x.v.shape) >= share) / (1 - share))
    return x * keep


def uniform(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return rng.uniform(-1, 1, shape) / np.sqrt(shape[0])


@dataclass(frozen=True)
class Perceptron:
    """Layers of a linear map, a batch norm, GELU and dropout, and a linear map to the log-odds."""

    features: int
    hidden: tuple[int, ...] = (512, 256, 128)
    drop: float = 0.2

    def start(self, rng: np.random.Generator) -> dict[str, np.ndarray]:
        out, n = {}, self.features
        for i, m in enumerate(self.hidden):
            out |= {f"w{i}": uniform(rng, n, m), f"b{i}": np.zeros(m), f"scale{i}": np.ones(m), f"shift{i}": np.zeros(m)}
            n = m
        return out | {"w": uniform(rng, n, 1), "b": np.zeros(1)}

    def moments(self) -> dict[str, np.ndarray]:
        """Running statistics, which are no parameters."""
        return {k: v for i, m in enumerate(self.hidden) for k, v in ((f"mean{i}", np.zeros(m)), (f"var{i}", np.ones(m)))}

    def logits(self, p: dict[str, Var], x: np.ndarray, rng: np.random.Generator | None, moments: dict[str, np.ndarray], seen: dict | None = None) -> Var:
        """seen: gets the block's statistics; without it the running ones are used."""
        z = Var(x)
        for i in range(len(self.hidden)):
            z = z @ p[f"w{i}"] + p[f"b{i}"]
            if seen is not None:
                z, seen[f"mean{i}"], seen[f"var{i}"] = normed(z, 0)
            else:
                z = (z + Var(-moments[f"mean{i}"])) * Var(1 / np.sqrt(moments[f"var{i}"] + EPS))
            z = dropout(gelu(z * p[f"scale{i}"] + p[f"shift{i}"]), self.drop, rng)
        return (z @ p["w"] + p["b"]).moved(lambda v: v[:, 0], lambda g: g[:, None])


@dataclass(frozen=True)
class Attention:
    """A token for each feature and one more, blocks of attention and a two-layer map with norms before each, and a linear map of the extra token."""

    features: int
    width: int = 96
    layers: int = 4
    heads: int = 8
    stretch: float = 2.0
    drop: float = 0.1
    feature_drop: float = 0.05

    def __post_init__(self):
        if self.width % self.heads:
            raise ValueError("heads must divide the width")

    def start(self, rng: np.random.Generator) -> dict[str, np.ndarray]:
        d, wide = self.width, int(self.width * self.stretch)
        out = {"tokens": rng.uniform(-1, 1, (self.features, d)) * np.sqrt(6 / (self.features + d)), "places": np.zeros((self.features, d)), "extra": 0.02 * rng.standard_normal((1, 1, d)), "scale": np.ones(d), "shift": np.zeros(d), "w": uniform(rng, d, 1), "b": np.zeros(1)}
        for i in range(self.layers):
            out |= {f"{n}{i}": uniform(rng, d, d) for n in ("query", "key", "value", "out")} | {f"{n}_b{i}": np.zeros(d) for n in ("query", "key", "value", "out")}
            out |= {f"scale{i}{n}": np.ones(d) for n in "ab"} | {f"shift{i}{n}": np.zeros(d) for n in "ab"}
            out |= {f"up{i}": uniform(rng, d, wide), f"up_b{i}": np.zeros(wide), f"down{i}": uniform(rng, wide, d), f"down_b{i}": np.zeros(d)}
        return out

    def moments(self) -> dict[str, np.ndarray]:
        return {}

    def logits(self, p: dict[str, Var], x: np.ndarray, rng: np.random.Generator | None, moments: dict[str, np.ndarray], seen: dict | None = None) -> Var:
        n, heads = len(x), self.heads
        tokens = Var(x[:, :, None]) * p["tokens"] + p["places"]
        if rng is not None and self.feature_drop > 0:
            tokens = tokens * Var((rng.random(tokens.v.shape[:2]) >= self.feature_drop).astype(np.float64)[:, :, None])
        extra = p["extra"] + Var(np.zeros((n, 1, self.width)))
        z = Var(np.concatenate([extra.v, tokens.v], axis=1), ((extra, lambda g: g[:, :1]), (tokens, lambda g: g[:, 1:])))
        split = lambda v: v.reshape(n, v.shape[1], heads, -1).swapaxes(1, 2)
        merge = lambda v: v.swapaxes(1, 2).reshape(n, v.shape[2], -1)
        for i in range(self.layers):
            a = normed(z, 2)[0] * p[f"scale{i}a"] + p[f"shift{i}a"]
            q, k, v = ((a @ p[f"{m}{i}"] + p[f"{m}_b{i}"]).moved(split, merge) for m in ("query", "key", "value"))
            k = k.moved(lambda x: x.swapaxes(2, 3) / np.sqrt(self.width / heads), lambda g: g.swapaxes(2, 3) / np.sqrt(self.width / heads))
            mixed = (dropout(softmax(q @ k), self.drop, rng) @ v).moved(merge, split)
            z = z + mixed @ p[f"out{i}"] + p[f"out_b{i}"]
            a = normed(z, 2)[0] * p[f"scale{i}b"] + p[f"shift{i}b"]
            a = dropout(gelu(a @ p[f"up{i}"] + p[f"up_b{i}"]), self.drop, rng)
            z = z + dropout(a @ p[f"down{i}"] + p[f"down_b{i}"], self.drop, rng)
        first = z.moved(lambda v: v[:, 0], lambda g: np.concatenate([g[:, None], np.zeros((n, self.features, self.width))], axis=1))
        out = normed(first, 1)[0] * p["scale"] + p["shift"]
        return (out @ p["w"] + p["b"]).moved(lambda v: v[:, 0], lambda g: g[:, None])


def loss_and_gradients(net, params: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, positive: float, rng: np.random.Generator | None) -> tuple[float, dict[str, np.ndarray], dict]:
    """The summed log loss (positive rows weigh `positive`) of a block, its gradients and its statistics."""
    p, seen = {k: Var(v) for k, v in params.items()}, {}
    z = net.logits(p, x, rng, {}, seen)
    w = np.where(y == 1, positive, 1.0)
    out = Var(w * np.logaddexp(0, np.where(y == 1, -z.v, z.v)), ((z, lambda g: g * w * (1 / (1 + np.exp(-z.v)) - y)),))
    out.backward()
    return float(out.v.sum()), {k: (v.grad if v.grad is not None else np.zeros_like(v.v)) for k, v in p.items()}, seen


@dataclass(frozen=True)
class Training:
    """block: rows of a block; blocks: of a step. warm: share of the steps that warm up. clip: the most a step's gradient may measure (0: any)."""

    epochs: int = 50
    block: int = 1024
    blocks: int = 1
    rate: float = 1e-3
    least_rate: float = 1e-6
    warm: float = 0.06
    decay: float = 1e-4
    clip: float = 1.0
    patience: int = 10
    balanced: bool = True
    seed: int = 42


def rate_of(step: int, total: int, t: Training) -> float:
    """The learning rate of a step (from 1): a linear warm-up, then half a cosine."""
    first = int(total * t.warm)
    if step < first:
        return t.rate * step / max(1, first)
    return t.least_rate + 0.5 * (t.rate - t.least_rate) * (1 + np.cos(np.pi * (step - first) / max(1, total - first)))


class AdamW:
    def __init__(self, size: int, decay: float, clip: float):
        self.m, self.v, self.n, self.decay, self.clip = np.zeros(size), np.zeros(size), 0, decay, clip

    def step(self, p: np.ndarray, g: np.ndarray, rate: float) -> np.ndarray:
        norm = float(np.sqrt((g * g).sum()))
        g = g * min(1.0, self.clip / (norm + 1e-6)) if self.clip else g
        self.n += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        return p * (1 - rate * self.decay) - rate * (self.m / (1 - 0.9**self.n)) / (np.sqrt(self.v / (1 - 0.999**self.n)) + 1e-8)


@dataclass
class Fitted:
    """A model: the fold it hasn't seen, its parameters and running statistics, the scaling of its features, and its held-out AUC by epoch."""

    held: int | None
    params: dict[str, np.ndarray]
    moments: dict[str, np.ndarray]
    mean: np.ndarray
    sd: np.ndarray
    positive: float
    curve: list[float]
    best: int = 0
    done: bool = False

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.nan_to_num((x - self.mean) / self.sd, nan=0.0, posinf=0.0, neginf=0.0)

    def scores(self, net, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        return net.logits({k: Var(v) for k, v in self.params.items()}, self.scaled(x), None, self.moments).v if len(x) else np.zeros(0)


def blocks_of(df: DataFrame, features: list[str], t: Training) -> DataFrame:
    """block, row_id, y, fold and x (all rows' features) of each block, written in order of block. Null features are NaN."""
    key = F.md5(F.concat_ws("|", F.col("row_id").cast("string"), F.lit(str(t.seed))))
    fold = F.coalesce(F.col("fold").cast("int"), F.lit(-1)) if "fold" in df.columns else F.lit(-1)
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features))
    rows = df.where("y is not null and row_id is not null").select(F.col("row_id").cast("bigint").alias("row_id"), F.col("y").cast("int").alias("y"), fold.alias("fold"), x.alias("x"))
    rows = rows.withColumns({"_key": key, "_head": F.conv(F.substring(key, 1, 12), 16, 10).cast("double"), "_one": F.lit(1)})
    rows = prefix_sums(rows, [], ["_head", "_key", "row_id"], {"_place": "_one"})
    rows = rows.groupBy(F.floor((F.col("_place") - 1) / t.block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_place", "row_id", "y", "fold", "x"))).alias("r"))  # t.block rows
    rows = rows.select("block", F.col("r.row_id").alias("row_id"), F.col("r.y").alias("y"), F.col("r.fold").alias("fold"), F.flatten("r.x").alias("x"))
    return written(rows.repartitionByRange("block").sortWithinPartitions("block"), "blocks")


def _each(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            row_id, y, fold, x = (batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("row_id", "y", "fold", "x"))
            yield batch.column("block")[i].as_py(), row_id, y, fold, x.reshape(len(y), features)


def _flat(d: dict[str, np.ndarray], like: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """The numbers of d, in the order of like's names."""
    names = list(d if like is None else like)
    return np.concatenate([np.ravel(d[n]) for n in names]) if names else np.zeros(0)


def _unflat(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n, a in like.items():
        out[n] = v[at : at + a.size].reshape(a.shape)
        at += a.size
    return out


def _sums_of(net, m: Fitted, k: int, t: Training, epoch: int, block: int, y: np.ndarray, fold: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    """What a block adds to a step of model k: gradients, statistics, loss and rows, as fixed-point integers; None if the model has too few rows there."""
    use = fold != m.held if m.held is not None else np.ones(len(y), bool)
    if use.sum() < 2:  # a batch norm needs two rows
        return None
    rng = np.random.default_rng([t.seed, epoch, block, k])
    loss, g, seen = loss_and_gradients(net, m.params, m.scaled(x[use]), y[use], m.positive, rng)
    n = float(use.sum())
    v = np.concatenate([_flat(g, m.params), n * _flat(seen, m.moments), [loss, n]])
    return np.rint(np.clip(v, -(2.0**26), 2.0**26) * 2.0**SHIFT).astype(np.int64)


def _stepped(m: Fitted, optimiser: AdamW, sums: np.ndarray, rate: float) -> None:
    """Moves m by one step, given the sums over the step's blocks."""
    v = sums / 2.0**SHIFT
    n, size = v[-1], optimiser.m.size
    m.params = _unflat(optimiser.step(_flat(m.params), v[:size] / n, rate), m.params)
    if m.moments:
        m.moments = _unflat(0.9 * _flat(m.moments) + 0.1 * v[size:-2] / n, m.moments)


def _summed(chosen: DataFrame, net, models: list[Fitted], t: Training, epoch: int, features: int) -> dict[int, np.ndarray]:
    """The sums of one step over many blocks, for each model that goes on: one job."""
    live, schema = [k for k, m in enumerate(models) if not m.done], pa.schema([("model", pa.int32()), ("sums", pa.binary())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for block, _, y, fold, x in _each(batches, features):
            for k in live:
                v = _sums_of(net, models[k], k, t, epoch, block, y, fold, x)
                if v is not None:
                    sums[k] = sums.get(k, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], schema=schema)

    total: dict[int, np.ndarray] = {}
    for r in chosen.mapInArrow(add, "model int, sums binary").collect():  # a row for each model and task
        total[r["model"]] = total.get(r["model"], 0) + np.frombuffer(r["sums"], np.int64)
    return total


def _dealt(blocks: DataFrame, features: int) -> RDD:
    """(block, its y, fold and x in one string of bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, y, fold, x in _each(batches, features):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pickle.dumps((y, fold, x))], pa.binary())], names=["block", "packed"])

    return blocks.mapInArrow(run, "block bigint, packed binary").rdd.map(lambda r: (r["block"], bytes(r["packed"])))


def _walked(dealt: RDD, net, models: list[Fitted], optimisers: list[AdamW], t: Training, epoch: int, order: np.ndarray) -> None:
    """Takes an epoch's steps, leg by leg. order: the blocks as the epoch goes through them."""
    leg, steps, place = LEG // t.blocks * t.blocks, -(-len(order) // t.blocks), np.argsort(order)
    rows = dealt.map(lambda r: (int(place[r[0]]), r)).repartitionAndSortWithinPartitions(-(-len(order) // leg), lambda at: at // leg)
    parts, live = rows.getNumPartitions(), [k for k, m in enumerate(models) if not m.done]
    each = dealt.context.union([rows.map(lambda r: r)] * len(models))  # a leg's rows for each model; the map keeps the union from merging partitions of one partitioner
    for lo in range(0, len(order), leg):
        state = {k: (models[k], optimisers[k]) for k in live}

        def walk(i: int, found: Iterator, state=state) -> Iterator[tuple]:
            k = i // parts
            m, optimiser = state[k]
            for step, own in groupby(found, lambda r: r[0] // t.blocks):
                total = None
                for _, (block, packed) in own:
                    v = _sums_of(net, m, k, t, epoch, block, *pickle.loads(packed))
                    total = v if total is None else total if v is None else total + v
                if total is not None:
                    _stepped(m, optimiser, total, rate_of(epoch * steps + step + 1, steps * t.epochs, t))
            yield k, m.params, m.moments, optimiser

        for k, params, moments, optimiser in dealt.context.runJob(each.mapPartitionsWithIndex(walk), iter, [k * parts + lo // leg for k in live]):
            models[k].params, models[k].moments, optimisers[k] = params, moments, optimiser
    rows.cleanShuffleDependencies()


def fit(df: DataFrame, features: list[str], net, t: Training | None = None, held: list[int | None] | None = None) -> tuple[list[Fitted], DataFrame]:
    """The models of df (row_id, y, features; fold if folds are held out) and their scores: row_id, fold, y, p, each row by the model that hasn't seen its fold, else by the model of all rows.

    Features are scaled by the mean and deviation of the rows a model sees; missing values are 0 then. A model of all rows takes all epochs. Rows
    without y or row_id are left out; without rows the parameters stay as they began.
    """
    t, held = t or Training(), held if held is not None else [None]
    spark = df.sparkSession
    blocks = blocks_of(df, features, t)
    stats = {r["fold"]: r for r in _statistics(blocks, len(features)).collect()}
    models = []
    for k in held:
        own = [r for f, r in stats.items() if f != k or k is None]
        n, s, q = (sum((np.array(r[c]) for r in own), np.zeros(len(features))) for c in ("n", "s", "q"))
        mean = s / np.maximum(n, 1)
        sd = np.sqrt(np.maximum(q / np.maximum(n, 1) - mean**2, 0))
        pos, neg = sum(r["pos"] for r in own), sum(r["neg"] for r in own)
        params = net.start(np.random.default_rng([t.seed, 0 if k is None else k + 1]))
        models.append(Fitted(k, params, net.moments(), mean, np.where(sd > 1e-12, sd, 1.0), neg / max(pos, 1) if t.balanced else 1.0, []))
    n_blocks = blocks.count()
    steps = -(-n_blocks // t.blocks)
    optimisers = [AdamW(_flat(m.params).size, t.decay, t.clip) for m in models]
    best = [(m.params, m.moments) for m in models]
    dealt = _dealt(blocks, len(features)) if t.blocks <= LEG else None
    for epoch in range(t.epochs if n_blocks else 0):
        order = np.random.default_rng([t.seed, epoch]).permutation(n_blocks)
        if dealt is not None:
            _walked(dealt, net, models, optimisers, t, epoch, order)
        for step in range(steps if dealt is None else 0):
            chosen = [int(b) for b in order[step * t.blocks : (step + 1) * t.blocks]]
            for k, v in _summed(blocks.where(F.col("block").isin(chosen)), net, models, t, epoch, len(features)).items():
                _stepped(models[k], optimisers[k], v, rate_of(epoch * steps + step + 1, steps * t.epochs, t))
        for k, auc in _held_out(blocks, net, models, len(features)).items():
            m = models[k]
            m.curve.append(auc)
            if len(m.curve) == 1 or auc > m.curve[m.best - 1] + 1e-5:
                m.best, best[k] = len(m.curve), (m.params, m.moments)
            m.done = len(m.curve) - m.best >= t.patience
        if all(m.done for m in models):
            break
    for m, kept in zip(models, best):
        if m.curve:
            m.params, m.moments = kept
        else:
            m.best = t.epochs
    out = written(_scored(blocks, net, models, len(features)), "network-scores")
    dropped(blocks)
    return models, out


def _statistics(blocks: DataFrame, features: int) -> DataFrame:
    """fold, and of its rows pos and neg, and of each feature n, s and q: values, their sum and their sum of squares."""
    each = blocks.select(F.explode(F.arrays_zip("y", "fold", F.sequence(F.lit(0), F.size("y") - 1).alias("i"))).alias("r"), "x").select("r.y", "r.fold", F.slice("x", F.col("r.i") * features + 1, features).alias("x"))
    cells = each.select("fold", F.posexplode("x").alias("at", "x")).where("not isnan(x) and abs(x) < double('infinity')")
    cells = cells.groupBy("fold", "at").agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    places = F.sequence(F.lit(0), F.lit(features - 1)) if features else F.array().cast("array<int>")
    by_fold = each.groupBy("fold").agg(F.sum((F.col("y") == 1).cast("int")).alias("pos"), F.sum((F.col("y") != 1).cast("int")).alias("neg"))
    cells = cells.groupBy("fold").agg(*(F.map_from_entries(F.collect_list(F.struct("at", c))).alias(f"{c}_") for c in "nsq"))
    dense = lambda c: F.transform(places, lambda i: F.coalesce(F.element_at(F.col(f"{c}_"), i), F.lit(0.0))).alias(c)
    return by_fold.join(cells, "fold", "left").select("fold", "pos", "neg", *map(dense, "nsq"))


def _held_out(blocks: DataFrame, net, models: list[Fitted], features: int) -> dict[int, float]:
    """The AUC of each model that goes on, on its held-out rows, by counts on boosting's grid."""
    asked = [k for k, m in enumerate(models) if m.held is not None and not m.done]
    if not asked:
        return {}
    grid = 2 * STEPS * RANGE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {k: np.zeros((2, grid), np.int64) for k in asked}
        for _, _, y, fold, x in _each(batches, features):
            for k in asked:
                out = fold == models[k].held
                cell = np.clip(np.rint(models[k].scores(net, x[out]) * STEPS), -STEPS * RANGE, STEPS * RANGE).astype(np.int64) + STEPS * RANGE
                for c in (0, 1):
                    seen[k][c] += np.bincount(cell[(y[out] == 1) == c], minlength=grid)
        yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array([seen[k].tobytes() for k in asked], pa.binary())], names=["model", "sums"])

    total: dict[int, np.ndarray] = {}
    for r in blocks.mapInArrow(run, "model int, sums binary").collect():  # grids, a row for each model and task
        total[r["model"]] = total.get(r["model"], 0) + np.frombuffer(r["sums"], np.int64)
    return {k: judged_on_grid(np.append(v, [0, 1]), "auc") for k, v in total.items()}


def _scored(blocks: DataFrame, net, models: list[Fitted], features: int) -> DataFrame:
    by_fold = {m.held: k for k, m in enumerate(models)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row_id, y, fold, x in _each(batches, features):
            p = np.full(len(y), np.nan)
            for k, m in enumerate(models):
                mine = np.array([by_fold.get(f, by_fold.get(None)) == k for f in fold.tolist()], bool)
                p[mine] = 1 / (1 + np.exp(-m.scores(net, x[mine])))
            yield pa.RecordBatch.from_arrays([pa.array(row_id), pa.array(fold, pa.int32()), pa.array(y, pa.int32()), pa.array(p, mask=np.isnan(p))], names=["row_id", "fold", "y", "p"])

    return blocks.mapInArrow(run, "row_id bigint, fold int, y int, p double")


def cross_validated(df: DataFrame, features: list[str], net, t: Training | None = None, folds: int = 5, whole: bool = False) -> tuple[list[Fitted], DataFrame]:
    """fit() with a model for each fold of df (fold: 0 to folds - 1), and one of all rows if whole."""
    return fit(df, features, net, t, [*range(folds), *([None] if whole else [])])


def predict(models: list[Fitted], net, df: DataFrame, features: list[str], k: int = -1) -> DataFrame:
    """row_id, p of df (row_id, features) by one of the models."""
    m, schema = models[k], pa.schema([("row_id", pa.int64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(features))
                yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(1 / (1 + np.exp(-m.scores(net, x))))], schema=schema)

    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features))
    return df.select(F.col("row_id").cast("bigint").alias("row_id"), x.alias("x")).mapInArrow(run, "row_id bigint, p double")
