"""Eigenvectors of a symmetric matrix: single precision, refined by matrix products."""

from __future__ import annotations

import numpy as np

#: Eigenvalues closer than this share of the norm, times the size, count as equal.
TINY = float(np.finfo(np.float64).eps) / 8
#: A correction of this size leaves errors of its square, below double precision.
LAST = 1e-9


def refinement(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step: (improved x, eigenvalues, separable gap, size of the correction).

    The correction solves the first-order equations of orthogonality and
    diagonality. Where two eigenvalues lie closer than what the residuals can
    tell apart, only orthogonality is corrected.
    """
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s, r = (s + s.T) / 2, (r + r.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    gap = 2 * (np.sqrt((off * off).sum()) + np.abs(a).sum(axis=0).max() * np.sqrt((r * r).sum()))
    apart = values[None, :] - values[:, None]
    wide = np.abs(apart) > gap
    e = np.where(wide, (s + values[None, :] * r) / np.where(wide, apart, 1), r / 2)
    return x + x @ e, values, float(gap), float(np.abs(e).max())


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Index groups of two or more eigenvalues chained by distances of at most ``gap``."""
    order = np.argsort(values, kind="stable")
    ends = np.flatnonzero(np.diff(values[order].astype(np.float64)) > gap) + 1
    return [g for g in np.split(order, ends) if len(g) > 1]


def eigen(matrix: np.ndarray, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), largest first, to double precision.

    float32 eigenvectors are the start; the corrections are matrix products in
    extended precision and converge quadratically. A cluster of eigenvalues that
    the residuals cannot separate is turned by a sub-solve: the matrix is
    projected on the cluster, shifted and scaled, so that its small differences
    become large, and its eigenvectors rotate the cluster's basis.
    """
    d = len(matrix)
    scale = float(np.abs(matrix).max(initial=0.0))
    if scale == 0:
        return np.zeros(d), np.eye(d)
    a = np.asarray(matrix, np.longdouble) / scale
    _, start = np.linalg.eigh(a.astype(np.float32))
    x, size = start.astype(np.longdouble), np.inf
    for _ in range(steps):
        x, values, gap, size = refinement(a, x)
        turned = 0.0
        for group in clusters(values, gap):
            basis = x[:, group]
            inner = basis.T @ (a @ basis)
            middle = np.trace(inner) / len(group)
            inner = (inner + inner.T) / 2 - middle * np.eye(len(group))
            spread = float(np.abs(inner).max())
            if spread <= TINY * d:  # equal eigenvalues: any basis will do
                continue
            _, turn = np.linalg.eigh((inner / spread).astype(np.float64))
            x[:, group] = basis @ turn
            turned = max(turned, float(np.abs(np.abs(turn) - np.eye(len(group))[:, np.abs(turn).argmax(axis=0)]).max()))
        if max(size, turned) <= LAST:
            break
    for _ in range(2):  # a cluster's turn is orthogonal in double precision only
        x = x + x @ (np.eye(d) - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    x = x / np.sqrt((x * x).sum(axis=0))
    lead = x[np.abs(x).argmax(axis=0), np.arange(d)]
    return np.asarray(values * scale, np.float64), np.asarray(x * np.where(lead < 0, -1, 1), np.float64)
