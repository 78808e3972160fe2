"""Dimension reduction by independent components (parallel fixed-point iteration)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from logweir.functions.matrices import map_vectors, matrix_sum
from logweir.functions.vectors import vector_size
from logweir.session import materialise


def _orthonormal(w: np.ndarray) -> np.ndarray:
    s, u = np.linalg.eigh(w @ w.T)
    return u @ np.diag(1.0 / np.sqrt(np.maximum(s, 1e-12))) @ u.T @ w


@dataclass
class IcaModel:
    mean: np.ndarray
    whitening: np.ndarray
    unmixing: np.ndarray

    @property
    def components(self) -> np.ndarray:
        return self.unmixing @ self.whitening

    @staticmethod
    def fit(
        df: DataFrame, k: int = 50, max_iter: int = 200, tol: float = 1e-4, seed: int = 6,
        vec: str = "vec",
    ) -> "IcaModel":
        """One distributed sum of width x width for the covariance, then one of k x k per step."""
        width, n = vector_size(df, vec), df.count()
        total = matrix_sum(df, vec, width, lambda x: x.sum(axis=0)[None], (1, width))[0]
        mean = total / n
        gram = matrix_sum(df, vec, width, lambda x: (x - mean).T @ (x - mean), (width, width))
        values, vectors = np.linalg.eigh(gram / n)
        order = [i for i in np.argsort(values)[::-1] if values[i] > 1e-10 * values.max()][:k]
        k = len(order)
        whitening = vectors[:, order].T / np.sqrt(values[order])[:, None]

        white = materialise(
            map_vectors(
                df.select(vec), vec, width, lambda x: [(x - mean) @ whitening.T], f"{vec} array<double>"
            ),
            "whitened",
        )
        w = _orthonormal(np.random.default_rng(seed).standard_normal((k, k)))
        for _ in range(max_iter):

            def step(z, w=w):
                g = np.tanh(z @ w.T)
                return np.hstack([g.T @ z, (1.0 - g**2).sum(axis=0)[:, None]])

            sums = matrix_sum(white, vec, k, step, (k, k + 1)) / n
            new = _orthonormal(sums[:, :k] - sums[:, k:] * w)
            change = np.max(np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1.0))
            w = new
            if change < tol:
                break
        return IcaModel(mean, whitening, w)

    def transform(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        mean, c = self.mean, self.components
        return map_vectors(
            df, vec, len(mean), lambda x: [(x - mean) @ c.T], f"{vec} array<double>"
        )
