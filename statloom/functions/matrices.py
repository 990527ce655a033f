"""Small matrices on the driver: those of regressors by regressors, whose size is that of a model, never of the rows."""

from __future__ import annotations

import numpy as np


def solve(a, b) -> np.ndarray:
    return np.linalg.solve(np.asarray(a, float), np.asarray(b, float))


def inverse(a) -> np.ndarray:
    """The inverse; a singular matrix is a ValueError."""
    a = np.asarray(a, float)
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ValueError("only square matrices have inverses")
    if np.linalg.matrix_rank(a) < len(a):
        raise ValueError("the matrix is singular")
    return np.linalg.inv(a)


def pseudo_inverse(a, tolerance: float = 1e-10) -> np.ndarray:
    """Moore-Penrose inverse; singular values below `tolerance` times the largest count as zero."""
    return np.linalg.pinv(np.asarray(a, float), rcond=tolerance)


def condition_number(a) -> float:
    """Largest over smallest singular value; infinite for a singular matrix."""
    s = np.linalg.svd(np.asarray(a, float), compute_uv=False)
    return float(s[0] / s[-1]) if s[-1] > 0 else float("inf")


def safe_inverse(a, most: float = 1e12) -> tuple[np.ndarray, bool]:
    """The inverse, or the pseudo-inverse and true if the condition number is above `most`."""
    poor = condition_number(a) > most
    return (pseudo_inverse(a) if poor else inverse(a)), poor


def cholesky(a) -> np.ndarray:
    """The lower factor; a matrix that isn't positive definite is a ValueError."""
    try:
        return np.linalg.cholesky(np.asarray(a, float))
    except np.linalg.LinAlgError as e:
        raise ValueError("the matrix is not positive definite") from e


def cholesky_inverse(a) -> np.ndarray:
    """The inverse of a positive definite matrix by its Cholesky factor."""
    half = np.linalg.inv(cholesky(a))
    return half.T @ half


def eigen_symmetric(a) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and their vectors as columns whose largest entry is positive."""
    values, vectors = np.linalg.eigh(np.asarray(a, float))
    values, vectors = values[::-1], vectors[:, ::-1]
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    return values, vectors * np.where(top < 0, -1.0, 1.0)


def toeplitz(first_column, first_row=None) -> np.ndarray:
    """Constant along each diagonal; without a first row symmetric. The corner is the first column's."""
    c = np.asarray(first_column, float)
    r = c if first_row is None else np.asarray(first_row, float)
    every = np.concatenate([r[:0:-1], c])
    return every[np.arange(len(c))[:, None] - np.arange(len(r))[None, :] + len(r) - 1]


def toeplitz_autocorrelation(acf) -> np.ndarray:
    """The correlation matrix of neighbouring values, from autocorrelations of lags 1, 2, ...; the diagonal is 1."""
    return toeplitz(np.concatenate([[1.0], np.asarray(acf, float)]))


def toeplitz_vector(a) -> np.ndarray:
    """The first column of a Toeplitz matrix followed by the rest of its first row; other matrices are a ValueError."""
    a = np.asarray(a, float)
    if not np.allclose(a[1:, 1:], a[:-1, :-1]):
        raise ValueError("the matrix is not constant along its diagonals")
    return np.concatenate([a[:, 0], a[0, 1:]])
