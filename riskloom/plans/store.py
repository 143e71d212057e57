"""Saving and loading models: a line of JSON, written and read by Spark, so any path that Spark knows will do."""

from __future__ import annotations

import json
from dataclasses import is_dataclass

import numpy as np
from pyspark.sql import SparkSession

from .boosting import Ensemble, Model, Parameters, Tree
from .linear import Linear
from .networks import Attention, Fitted, Perceptron

_KINDS = {k.__name__: k for k in (Ensemble, Model, Parameters, Tree, Linear, Attention, Fitted, Perceptron)}


def _plain(x):
    if is_dataclass(x):
        return {"_": type(x).__name__, **{k: _plain(v) for k, v in vars(x).items()}}
    if isinstance(x, np.ndarray):
        return {"_": "array", "kind": str(x.dtype), "shape": list(x.shape), "values": x.reshape(-1).tolist()}
    if isinstance(x, dict):
        return {"_": "dict", "items": [[_plain(k), _plain(v)] for k, v in x.items()]}
    if isinstance(x, tuple):
        return {"_": "tuple", "items": [_plain(v) for v in x]}
    return [_plain(v) for v in x] if isinstance(x, list) else x.item() if isinstance(x, np.generic) else x


def _rebuilt(x):
    if isinstance(x, list):
        return [_rebuilt(v) for v in x]
    if not isinstance(x, dict):
        return x
    kind = x["_"]
    if kind == "array":
        return np.array(x["values"], x["kind"]).reshape(x["shape"])
    if kind == "dict":
        return {_rebuilt(k): _rebuilt(v) for k, v in x["items"]}
    if kind == "tuple":
        return tuple(_rebuilt(v) for v in x["items"])
    return _KINDS[kind](**{k: _rebuilt(v) for k, v in x.items() if k != "_"})


def save(spark: SparkSession, model, path: str) -> None:
    """model: an Ensemble, lists of Linear or Fitted, a network, parameters, or lists, tuples and dicts of them."""
    spark.createDataFrame([(json.dumps(_plain(model)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str):
    return _rebuilt(json.loads(spark.read.text(path, wholetext=True).first()["value"]))


def scaler(model: Fitted, features: list[str]) -> dict[str, dict[str, float]]:
    """The mean and deviation that a network's features are scaled by."""
    return {f: {"mean": float(m), "sd": float(s)} for f, m, s in zip(features, model.mean, model.sd)}

