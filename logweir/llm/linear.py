"""Hashed features and linear hinge-loss models for the classifiers of this folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def uniform(key: Column) -> Column:
    """A number in [0, 1) that only depends on the key; 0 for a null key."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def hold_out(key: str, modulus: int, remainder: int) -> Column:
    """crc32 of the key as text has this remainder; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def hinge_model(
    rows: list[tuple[np.ndarray, np.ndarray]],
    target: np.ndarray,
    size: int,
    cost: np.ndarray,
    epochs: int = 12,
    seed: int = 7,
) -> np.ndarray:
    """Weights of a linear hinge-loss model by dual coordinate descent.

    ``rows`` are (indexes, values), ``target`` is +1 or -1, ``cost`` bounds the dual variable of a row. The last weight is the
    one of a constant feature.
    """
    weights = np.zeros(size + 1)
    dual = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in order.permutation(len(rows)).tolist():
            index, value = rows[k]
            gradient = target[k] * (weights[index] @ value + weights[size]) - 1
            new = min(max(dual[k] - gradient / norm[k], 0.0), cost[k])
            step = (new - dual[k]) * target[k]
            if step:
                weights[index] += step * value
                weights[size] += step
                dual[k] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def calibration(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (weighted logistic fit, soft targets)."""
    goal = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ beta)
        curve = weight * p * (1 - p) + 1e-9
        hessian = x.T @ (x * curve[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weight * (goal - p)) - 1e-6 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])
