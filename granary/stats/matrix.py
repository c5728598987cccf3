"""Small matrices on the driver."""

from __future__ import annotations

import numpy as np


def identity(n: int) -> np.ndarray:
    return np.eye(n)


def matmul(a, b) -> np.ndarray:
    return np.asarray(a, float) @ np.asarray(b, float)


def matvec(a, x) -> np.ndarray:
    return np.asarray(a, float) @ np.asarray(x, float)


def dot(x, y) -> float:
    return float(np.dot(np.asarray(x, float), np.asarray(y, float)))


def transpose(a) -> np.ndarray:
    return np.asarray(a, float).T


def inv(a, least_pivot: float = 1e-12) -> np.ndarray:
    """The inverse; raises when elimination meets a pivot under ``least_pivot`` (a singular matrix)."""
    a = np.asarray(a, float)
    left = a.copy()
    for i in range(len(left)):
        j = i + int(np.argmax(np.abs(left[i:, i])))
        if abs(left[j, i]) < least_pivot:
            raise ValueError("The matrix is singular: some terms are linear combinations of others")
        left[[i, j]] = left[[j, i]]
        left[i + 1 :] -= np.outer(left[i + 1 :, i] / left[i, i], left[i])
    return np.linalg.inv(a)
