"""Additive attribution of a boosted tree model's margin to features (TreeSHAP, path-dependent)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tree_arrays(model: GBTClassificationModel | RandomForestClassificationModel, path: str) -> list[dict[str, np.ndarray]]:
    """A saved model's nodes as arrays, one dict for each tree: as many numbers as the model has nodes."""
    model.write().overwrite().save(path)
    rows = SparkSession.active().read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas()
    out = []
    for k, tree in rows.groupby("treeID"):
        tree = tree.sort_values("id")
        split = list(tree["split"])
        out.append({
            "left": tree["leftChild"].to_numpy(), "right": tree["rightChild"].to_numpy(), "value": tree["prediction"].to_numpy() * model.treeWeights[k], "cover": tree["rawCount"].to_numpy(np.float64),
            "share": np.array([x[1] / sum(x) if len(x) > 1 and sum(x) else 0.0 for x in tree["impurityStats"]]), "feature": np.array([s["featureIndex"] for s in split]), "cut": np.array([s["leftCategoriesOrThreshold"][0] if s["featureIndex"] >= 0 else 0.0 for s in split]),
        })
    return out


def leaves(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf that each row ends at."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while (inner := tree["left"][at] >= 0).any():
        goes_left = x[rows, tree["feature"][at]] <= tree["cut"][at]
        at = np.where(inner, np.where(goes_left, tree["left"][at], tree["right"][at]), at)
    return at


def kinds(ways: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of yes and no: the first one of each kind, and which kind each is of."""
    packed = np.zeros((len(ways), 8 * max(1, -(-ways.shape[1] // 64))), np.uint8)
    packed[:, : -(-ways.shape[1] // 8)] = np.packbits(ways, axis=1)
    codes = packed.view(np.uint64)
    _, first, kind = np.unique(codes[:, 0] if codes.shape[1] == 1 else codes, axis=0, return_index=True, return_inverse=True)
    return first, kind.reshape(-1)


class _Path:
    """The features on the way to a node, for many rows at once: of each, the share of rows that go this way when it is
    unknown (zero), whether a row goes this way when it is known (one), and the weights of subsets of the path by size."""

    def __init__(self, rows: int):
        self.features, self.zero, self.one, self.weights = [], [], [], np.zeros((0, rows))

    def extended(self, feature: int, zero: float, one: np.ndarray) -> _Path:
        n, out = len(self.features), _Path(0)
        out.features, out.zero, out.one = [*self.features, feature], [*self.zero, zero], [*self.one, one]
        w = np.concatenate([self.weights, np.full((1, len(one)), 1.0 if n == 0 else 0.0)])
        for i in range(n - 1, -1, -1):
            w[i + 1] += one * w[i] * (i + 1) / (n + 1)
            w[i] *= zero * (n - i) / (n + 1)
        out.weights = w
        return out

    def without(self, k: int) -> np.ndarray:
        """The weights as they would be had the k-th feature not been added."""
        n, zero, one = len(self.features) - 1, self.zero[k], self.one[k]
        known = one != 0
        w, rest = self.weights[:-1].copy(), self.weights[-1].copy()
        for j in range(n - 1, -1, -1):
            was = self.weights[j]
            w[j] = np.where(known, rest * (n + 1) / ((j + 1) * np.where(known, one, 1)), was * (n + 1) / (zero * (n - j)))
            rest = was - w[j] * zero * (n - j) / (n + 1)
        return w

    def reduced(self, k: int) -> _Path:
        out = _Path(0)
        out.weights = self.without(k)
        out.features, out.zero, out.one = (x[:k] + x[k + 1 :] for x in (self.features, self.zero, self.one))
        return out


def shap_rows(trees: list[dict], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shapley values of each row and the base value, by path-dependent TreeSHAP (Lundberg et al., 2018): each leaf is
    visited once, with all rows; work grows with leaves times the square of depth. Rows that go the same way at all nodes of a tree
    have the same values in it, so one of each kind is taken."""
    total_out, base = np.zeros(x.shape), 0.0

    def visit(x: np.ndarray, out: np.ndarray, tree: dict, node: int, path: _Path, feature: int, zero: float, one: np.ndarray, share: float) -> float:
        path = path.extended(feature, zero, one)
        left, right = tree["left"][node], tree["right"][node]
        if left < 0:
            for k in range(1, len(path.features)):
                out[:, path.features[k]] += path.without(k).sum(axis=0) * (path.one[k] - path.zero[k]) * tree["value"][node]
            return share * tree["value"][node]
        f, before_zero, before_one = int(tree["feature"][node]), 1.0, np.ones(len(x))
        if f in path.features[1:]:  # met above already: both splits count as one
            k = path.features.index(f, 1)
            before_zero, before_one = path.zero[k], path.one[k]
            path = path.reduced(k)
        goes_left, total, mean = x[:, f] <= tree["cut"][node], tree["cover"][left] + tree["cover"][right], 0.0
        for child, goes in ((left, goes_left), (right, ~goes_left)):
            part = tree["cover"][child] / total
            if part > 0:
                mean += visit(x, out, tree, child, path, f, before_zero * part, before_one * goes, share * part)
        return mean

    for tree in trees:
        inner = np.flatnonzero(tree["left"] >= 0)
        first, kind = kinds(x[:, tree["feature"][inner]] <= tree["cut"][inner])
        out = np.zeros((len(first), x.shape[1]))
        base += visit(x[first], out, tree, 0, _Path(len(first)), -1, 1.0, np.ones(len(first)), 1.0)
        total_out += out[kind]
    return total_out, base


def shap_tree(scored: DataFrame, key: str, features: str, trees: list[dict], names: list[str], most: int | None = None) -> DataFrame:
    """(key, feature, contribution, base) of every row: the contributions and the base add up to the margin. With `most`, a row's
    largest ones alone, so many (of equal ones those of the first names)."""
    by_name = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
    shared = scored.sparkSession.sparkContext.broadcast(trees)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist(), float).reshape(len(batch), len(names))
            values, base = shap_rows(shared.value, x)
            at = np.broadcast_to(np.arange(len(names)), values.shape)
            if most is not None and most < len(names):
                at = by_name[np.argsort(-np.abs(values[:, by_name]), axis=1, kind="stable")[:, :most]]
            yield pd.DataFrame({key: np.repeat(batch["k"].to_numpy(), at.shape[1]), "feature": np.array(names, object)[at.reshape(-1)], "contribution": np.take_along_axis(values, at, axis=1).reshape(-1), "base": base})

    rows = scored.select(F.col(key).alias("k"), vector_to_array(features).alias("x"))
    return rows.mapInPandas(explain, f"{key} long, feature string, contribution double, base double")
