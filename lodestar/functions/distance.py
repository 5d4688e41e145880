"""Distances between vectors, as built-in column expressions and on numpy blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "ip")
#: Distances that agree to so many decimals are ties.
DECIMALS = 12


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    return metric


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Cosine distance, squared Euclidean distance ("l2") or 1 - inner product ("ip"); lower is nearer in each.

    The cosine distance to a vector of norm 0 is 1.
    """
    check_metric(metric)
    if metric == "l2":
        value = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    elif metric == "ip":
        value = 1 - _dot(a, b)
    else:
        norms = F.sqrt(_dot(a, a) * _dot(b, b))
        value = 1 - F.when(norms > 0, _dot(a, b) / norms).otherwise(F.lit(0.0))
    return F.round(value, DECIMALS)


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def matrix_distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances between the rows of a and those of b, 64-bit floats."""
    dot = a @ b.T
    if metric == "l2":
        out = np.square(a).sum(1)[:, None] + np.square(b).sum(1)[None, :] - 2 * dot
    elif metric == "ip":
        out = 1 - dot
    else:
        norms = np.sqrt(np.square(a).sum(1)[:, None] * np.square(b).sum(1)[None, :])
        out = 1 - np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0)
    return np.round(out, DECIMALS) + 0.0


class Block:
    """Vectors, 64-bit floats, ready to be compared with those of other blocks."""

    def __init__(self, vectors: np.ndarray, metric: str):
        self.vectors, self.metric = vectors, metric
        self.squares = np.square(vectors).sum(1)
        norms = np.sqrt(self.squares)
        self.scaled = np.divide(vectors, norms[:, None], out=np.zeros_like(vectors), where=norms[:, None] > 0) if metric == "cosine" else vectors
        finite = norms[np.isfinite(norms)]
        self.reach = 1.0 if metric == "cosine" else float(finite.max()) if len(finite) else 0.0

    def approximate(self, other: Block) -> tuple[np.ndarray, float]:
        """(distances to the rows of other, by how much they may be off at most)."""
        out = self.scaled @ other.scaled.T
        if self.metric == "l2":
            out *= -2
            out += self.squares[:, None]
            out += other.squares[None, :]
        else:
            np.subtract(1, out, out=out)
        return out, 1e-9 * (1 + (self.reach + other.reach) ** 2)

    def exact(self, other: Block, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """What matrix_distance() has at these places."""
        dot = np.einsum("ij,ij->i", self.vectors[row], other.vectors[column])
        if self.metric == "l2":
            out = self.squares[row] + other.squares[column] - 2 * dot
        elif self.metric == "ip":
            out = 1 - dot
        else:
            norms = np.sqrt(self.squares[row] * other.squares[column])
            out = 1 - np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0)
        return np.round(out, DECIMALS) + 0.0
