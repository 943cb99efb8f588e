"""Gradient-boosted trees for small labelled tables, as column expressions."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Leaf(NamedTuple):
    value: float


class Split(NamedTuple):
    feature: int
    limit: float
    low: Leaf | Split
    high: Leaf | Split


def grow(rows: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int, least: int, penalty: float) -> Leaf | Split:
    """A tree that splits by the gain in squared slope over curvature."""
    best, at = 1e-6, None
    whole = slope.sum() ** 2 / (curve.sum() + penalty)
    if depth:
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for limit in (values[1:] + values[:-1]) / 2:
                low = rows[:, f] < limit
                if least <= low.sum() <= len(low) - least:
                    gain = (slope[low].sum() ** 2 / (curve[low].sum() + penalty)
                            + slope[~low].sum() ** 2 / (curve[~low].sum() + penalty) - whole)
                    if gain > best:
                        best, at = gain, (f, float(limit))
    if at is None:
        return Leaf(float(slope.sum() / (curve.sum() + penalty)))
    low = rows[:, at[0]] < at[1]
    return Split(*at, *(grow(rows[m], slope[m], curve[m], depth - 1, least, penalty) for m in (low, ~low)))


def walk(tree: Leaf | Split, rows: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(rows), tree.value)
    return np.where(rows[:, tree.feature] < tree.limit, walk(tree.low, rows), walk(tree.high, rows))


def boost(rows: np.ndarray, labels: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, least: int = 4,
          penalty: float = 1.0) -> list[Leaf | Split]:
    """Trees whose values add up to log odds, by Newton steps on the logistic loss."""
    trees: list[Leaf | Split] = []
    margin = np.zeros(len(rows))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(rows, labels - p, p * (1 - p), depth, least, penalty)
        trees.append(tree)
        margin += rate * walk(tree, rows)
    return trees


def margins(trees: list[Leaf | Split], rows: np.ndarray, rate: float = 0.3) -> np.ndarray:
    return rate * sum(walk(tree, rows) for tree in trees)


def platt(margin: np.ndarray, labels: np.ndarray, rounds: int = 500) -> tuple[float, float]:
    """a, b of the calibrated probability 1 / (1 + exp(-(a * margin + b))), by damped Newton steps."""
    w, x = np.array([1.0, 0.0]), np.stack([margin, np.ones_like(margin)], 1)
    goal = np.where(labels > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w + 0.5 * np.linalg.solve(bend, x.T @ (goal - p))
    return float(w[0]), float(w[1])


def column(trees: list[Leaf | Split], features: list[Column], rate: float = 0.3) -> Column:
    """The sum of the trees as an expression."""

    def of(tree: Leaf | Split) -> Column:
        if isinstance(tree, Leaf):
            return F.lit(tree.value)
        return F.when(features[tree.feature] < tree.limit, of(tree.low)).otherwise(of(tree.high))

    total = F.lit(0.0)
    for tree in trees:
        total = total + of(tree)
    return total * rate
