"""Logistic regression with an elastic net, fitted for many sets of rows in the same passes.

A pass adds up, for each model, the loss, the gradient and the weighted products of features over the rows that the model sees; the driver, which holds
nothing but columns by columns, then goes to the least of the quadratic model with its penalties by coordinate descent. So a fit takes some ten
passes, whatever the number of models: seeds and folds are columns that say which rows to leave out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import exact_quantiles
from ..operators.profile import to_long
from ..scratch import dropped, written

#: Doubles that a task adds up at once (models x features squared); models beyond it take a pass of their own. Rows of a block.
MOST_CELLS, BLOCK = 1 << 23, 4096


@dataclass(frozen=True)
class Penalty:
    """strength: of the penalties against the summed loss (1 / C). lasso: their share of absolute values, the rest is of squares. passes: at most; tolerance: of the coefficients."""

    strength: float = 1.0
    lasso: float = 0.5
    passes: int = 40
    tolerance: float = 1e-8
    balanced: bool = False


@dataclass
class Linear:
    """A model: the rows it hasn't seen (a column and its value; None: all are seen), the intercept and the coefficients of scaled features."""

    held: tuple[str, int] | None
    w: np.ndarray
    done: bool = False

    @property
    def intercept(self) -> float:
        return float(self.w[0])

    @property
    def coefficients(self) -> np.ndarray:
        return self.w[1:]


def robust_scales(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The median and the quartile range (1 where it is 0) of each feature, over all rows that have it."""
    long = to_long(df, features, ("row_id",)).where("x is not null and not isnan(x)")
    found = {r["feature"]: (r["q1"], (r["q2"] - r["q0"]) or 1.0) for r in exact_quantiles(long, ["feature"], "x", [0.25, 0.5, 0.75]).collect()}
    middle, spread = zip(*(found.get(f, (0.0, 1.0)) for f in features)) if features else ((), ())
    return np.array(middle), np.array(spread)


def lasso_step(w: np.ndarray, gradient: np.ndarray, gram: np.ndarray, p: Penalty, rounds: int = 500) -> np.ndarray:
    """The least of the quadratic model at w with its penalties, by coordinate descent; the intercept has none."""
    l1, l2 = p.strength * p.lasso, p.strength * (1 - p.lasso)
    out, g = w.copy(), gradient.copy()  # g: of the loss at out
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            a = gram[j, j] + (l2 if j else 0.0)
            if a <= 1e-12:
                continue
            b = gram[j, j] * out[j] - g[j]
            new = b / a if not j else np.sign(b) * max(abs(b) - l1, 0.0) / a
            if new != out[j]:
                g += gram[:, j] * (new - out[j])
                most = max(most, abs(new - out[j]))
                out[j] = new
        if most < p.tolerance / 10:
            break
    return out


def _penalty(w: np.ndarray, p: Penalty) -> float:
    return p.strength * (p.lasso * np.abs(w[1:]).sum() + 0.5 * (1 - p.lasso) * (w[1:] ** 2).sum())


def rows_of(df: DataFrame, features: list[str], middle: np.ndarray, spread: np.ndarray, columns: list[str]) -> DataFrame:
    """row_id, y, the columns of held-out rows, and x: scaled features, missing ones at 0 (the median), written."""
    scaled = F.array(*(F.coalesce(F.nanvl((F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)), F.lit(0.0)) for f, m, s in zip(features, middle, spread))) if features else F.array().cast("array<double>")
    rows = df.where("y is not null and row_id is not null").select(F.col("row_id").cast("bigint").alias("row_id"), F.col("y").cast("int").alias("y"), *(F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in columns), scaled.alias("x"))
    return written(rows, "linear-rows")


def _sums(rows: DataFrame, models: list[Linear], features: int, columns: list[str], positive: list[float]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of each model the summed loss, its gradient and the products of features weighted by its second derivative."""
    m, schema = features + 1, pa.schema([("model", pa.int32()), ("sums", pa.binary())])
    live = [k for k, x in enumerate(models) if not x.done]
    out: dict[int, np.ndarray] = {}
    step = max(1, MOST_CELLS // (m * m))
    for lo in range(0, len(live), step):
        part = live[lo : lo + step]

        def add(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            sums = {k: np.zeros(1 + m + m * m) for k in part}
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    b = batch.slice(at, BLOCK)
                    x = np.ones((b.num_rows, m))
                    x[:, 1:] = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, features)
                    y, held = b.column("y").to_numpy(), {c: b.column(c).to_numpy() for c in columns}
                    z = x @ np.stack([models[k].w for k in part], axis=1)
                    for i, k in enumerate(part):
                        c = models[k].held
                        w = np.where(y == 1, positive[k], 1.0) * (np.ones(len(y)) if c is None else held[c[0]] != c[1])
                        q = 1 / (1 + np.exp(-z[:, i]))
                        weighted = x * (w * q * (1 - q))[:, None]
                        loss = (w * np.logaddexp(0, np.where(y == 1, -z[:, i], z[:, i]))).sum()
                        sums[k] += np.concatenate([[loss], x.T @ (w * (q - y)), (x.T @ weighted).reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([sums[k].tobytes() for k in part], pa.binary())], schema=schema)

        for r in rows.mapInArrow(add, "model int, sums binary").toLocalIterator():  # columns by columns, a row for each model and task
            out[r["model"]] = out.get(r["model"], 0) + np.frombuffer(r["sums"])
    return {k: (float(v[0]), v[1 : m + 1], v[m + 1 :].reshape(m, m)) for k, v in out.items()}


def fit(df: DataFrame, features: list[str], p: Penalty | None = None, held: list[tuple[str, int] | None] | None = None, scales: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[Linear], DataFrame]:
    """The models of df (row_id, y, features, and the columns of held), and their scores on held-out rows: model (its number), row_id, y, p; of a model that sees all rows, on all.

    Features are scaled by median and quartile range of all rows; missing values are the median. Rows without y or row_id are left out. Without
    rows all coefficients are 0.
    """
    p, held = p or Penalty(), held if held is not None else [None]
    columns = sorted({h[0] for h in held if h})
    rows = rows_of(df, features, *(scales or robust_scales(df, features)), columns)
    models = [Linear(h, np.zeros(len(features) + 1)) for h in held]
    positive = [1.0] * len(models)
    if p.balanced:
        seen = lambda h: F.lit(True) if h is None else F.col(h[0]) != h[1]
        n = rows.agg(*(F.count(F.when(seen(h) & ((F.col("y") == 1) == F.lit(one)), 1)).alias(f"{k}_{int(one)}") for k, h in enumerate(held) for one in (False, True))).first()
        positive = [n[f"{k}_0"] / max(n[f"{k}_1"], 1) for k in range(len(held))]
    before: dict[int, tuple[float, np.ndarray]] = {}
    for _ in range(p.passes):
        for k, (loss, gradient, gram) in _sums(rows, models, len(features), columns, positive).items():
            m, worth = models[k], loss + _penalty(models[k].w, p)
            if k in before and worth > before[k][0] + 1e-9 * abs(before[k][0]):  # too far: half the way
                m.w = (m.w + before[k][1]) / 2
                m.done = bool(np.abs(m.w - before[k][1]).max() < p.tolerance)
                continue
            new = lasso_step(m.w, gradient, gram, p)
            before[k] = (worth, m.w)
            m.done = bool(np.abs(new - m.w).max() < p.tolerance)
            m.w = new
        if all(m.done for m in models) or not before:
            break
    out = written(_scored(rows, models, len(features), columns), "linear-scores")
    dropped(rows)
    return models, out


def _scored(rows: DataFrame, models: list[Linear], features: int, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, features)
                for k, m in enumerate(models):
                    mine = np.arange(len(x)) if m.held is None else np.flatnonzero(b.column(m.held[0]).to_numpy() == m.held[1])
                    score = 1 / (1 + np.exp(-(x[mine] @ m.coefficients + m.intercept)))
                    take = pa.array(mine)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), k, np.int32)), b.column("row_id").take(take), b.column("y").take(take), pa.array(score)], names=["model", "row_id", "y", "p"])

    return rows.mapInArrow(run, "model int, row_id bigint, y int, p double")
