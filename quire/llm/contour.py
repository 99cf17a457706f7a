"""Leading eigenpairs of a symmetric positive matrix by contour integration (Polizzi, 2009), checked by inertia.

The integral of (zI - V)^-1 Y around an interval keeps of Y what lies in the eigenvectors of that interval. A few
Gauss-Legendre nodes on a circle stand for it, each a complex shifted solve; the Rayleigh-Ritz step on what
is left gives the eigenpairs, and the step is repeated until they settle. How many eigenvalues lie above a place
is counted apart from that, by the signs of a Sturm sequence (inertia), which chooses the intervals and proves
that none was missed. The matrix has one row for each dimension, whatever the number of vectors.
"""

from __future__ import annotations

import numpy as np

NODES = 8
#: An interval wider than this ratio is split, so that its lower end stands out at its own scale.
WIDEST = 4.0
ROUNDS = 40


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the same eigenvalues (Householder)."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or size == abs(x[0]) and not x[1:].any():
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ x
        p -= (x @ p) * x
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(x, p) + np.outer(p, x))
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy()


class Inertia:
    """Numbers of eigenvalues above places."""

    def __init__(self, v: np.ndarray):
        self.main, off = tridiagonal(v)
        self.square = off * off
        self.tiny = np.finfo(float).tiny / np.finfo(float).eps
        self.seen: dict[float, int] = {}

    def above(self, place: float) -> int:
        if place not in self.seen:
            below, q = 0, 1.0
            for i, a in enumerate(self.main):
                q = a - place - (self.square[i - 1] / q if i else 0.0)
                if abs(q) < self.tiny:
                    q = -self.tiny
                below += q < 0
            self.seen[place] = len(self.main) - below
        return self.seen[place]

    def kth(self, k: int, low: float, high: float) -> tuple[float, float]:
        """A short bracket of the k-th largest eigenvalue."""
        while high - low > 1e-9 * high:
            mid = (low + high) / 2
            low, high = (mid, high) if self.above(mid) >= k else (low, mid)
        return low, high


def _intervals(count: Inertia, wanted: int, low: float, top: float) -> list[tuple[float, float, int]]:
    """(low, high, number inside) of intervals that together hold the `wanted` largest eigenvalues; ends lie in gaps."""
    least, _ = count.kth(wanted, low, top)
    more = count.above(least * (1 - 1e-6))  # ties with the last wanted one come along
    under = count.kth(more + 1, low, least)[1] if count.above(low) > more else low
    last = max((least + under) / 2, (least * 0.5 if under < least * 0.5 else 0.0))
    edges = [top, last]
    k = 0
    while k + 1 < len(edges):
        hi, lo = edges[k], edges[k + 1]
        inside = count.above(lo) - count.above(hi)
        split = None
        if inside > 1 and hi / lo > WIDEST:
            ends = [hi] + [count.kth(count.above(hi) + m + 1, lo, hi)[0] for m in range(inside)]
            gaps = [(ends[m] / ends[m + 1], (ends[m] * ends[m + 1]) ** 0.5) for m in range(1, inside)]
            ratio, place = max(gaps)
            split = place if ratio > 1.05 else None
        if split is None:
            k += 1
        else:
            edges.insert(k + 1, split)
    out = []
    for hi, lo in zip(edges, edges[1:]):
        over, inside = count.above(hi), count.above(lo) - count.above(hi)
        if inside:  # a wide gap stays outside, so that the circle is no wider than it must be
            first, least = count.kth(over + 1, lo, hi)[1], count.kth(over + inside, lo, hi)[0]
            out.append((max(lo, least / 1.5), min(hi, first * 1.5), inside))
    return out


def _inside(v: np.ndarray, lo: float, hi: float, inside: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs between lo and hi, largest first; `inside` is their number."""
    d = len(v)
    size = min(d, inside + max(4, inside // 2))
    points, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (1 + points)
    middle, radius = (lo + hi) / 2, (hi - lo) / 2
    turn = np.exp(1j * angles)
    random = np.random.default_rng(0)
    y = random.standard_normal((d, size))
    identity = np.eye(d)
    found, before = None, np.inf
    for turns in range(ROUNDS):
        q = np.zeros_like(y)
        for z, w in zip(turn, weights):
            q += np.real(w / 2 * radius * z * np.linalg.solve((middle + radius * z) * identity - v, y.astype(complex)))
        q, _ = np.linalg.qr(q)
        values, small = np.linalg.eigh(q.T @ v @ q)
        y = q @ small
        own = (values > lo) & (values < hi)
        if own.sum() != inside:  # not settled yet, or too few columns for what lies close outside
            found, before = None, np.inf
            if turns > 2 and y.shape[1] < d:
                y = np.concatenate([y, random.standard_normal((d, min(inside, d - y.shape[1])))], axis=1)
            continue
        wrong = np.abs(v @ y[:, own] - y[:, own] * values[own]).max() / scale
        if found is not None and wrong >= before / 2:
            if wrong < before:
                found = values[own][::-1], y[:, own][:, ::-1]
            if min(wrong, before) < 1e-11:
                return found
        else:
            found = values[own][::-1], y[:, own][:, ::-1]
        before = min(wrong, before)
        if wrong < 1e-15:
            return found
    if found is None or before > 1e-9:
        raise ArithmeticError(f"{inside} eigenvalues between {lo} and {hi} were not all found")
    return found


def leading(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, columns): the `wanted` largest eigenvalues that are not zero, and unit eigenvectors.

    Eigenvalues below 1e-12 of the trace count as zero, so fewer may come back. Each vector's largest entry is positive.
    """
    trace = float(np.trace(v))
    if not trace > 0:
        return np.empty(0), np.empty((len(v), 0))
    v = (v + v.T) / 2
    count = Inertia(v)
    low = 1e-12 * trace
    top = count.kth(1, low, trace * 1.001)[1] * 1.001
    wanted = min(wanted, count.above(low))
    parts = [_inside(v, lo, hi, n, trace) for lo, hi, n in _intervals(count, wanted, low, top)]
    vectors, _ = np.linalg.qr(np.concatenate([p[1] for p in parts], axis=1))
    values, small = np.linalg.eigh(vectors.T @ v @ vectors)  # once more over all intervals together
    values, vectors = values[::-1][:wanted], (vectors @ small)[:, ::-1][:, :wanted]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)])
