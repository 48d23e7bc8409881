"""Best candidates of a block of queries, found behind a cheap lower bound of the distance.

A block of candidates is first screened: ``bounds`` gives each pair a number that is small where its distance is, worked
out by a product of matrices in single precision or in sums of small integers, and ``cuts`` the number up to which a
distance can still be among a query's best.  Rounding is on the safe side, so no pair is lost; what is left is worked
out in double precision.  Memory is two blocks and a tile, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

#: Queries screened at once: by products of matrices, and by sums of integers, which have to stay in the cache.
ROWS, FEW_ROWS = 256, 32
#: Candidates of the first block from which each query's first best are taken.
FIRST = 1024
#: Numbers worked out at once in double precision.
EXACT = 1 << 15
#: Logarithms of sizes are told apart over such a range (canberra).
SPAN = 2.5
MOST = np.iinfo(np.int16).max
SMALL = np.float32(1e-30)


def ready(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows as ``pairs`` takes them: at length 1 for correlation and cosine, NaN where these aren't defined."""
    if metric not in ("correlation", "cosine"):
        return x
    with np.errstate(all="ignore"):
        if metric == "correlation":
            x = x - x.mean(axis=1, keepdims=True)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(n > 1e-12, x / n, np.nan)


def pairs(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of a to the same row of b, both made ``ready``."""
    with np.errstate(all="ignore"):
        if metric in ("correlation", "cosine"):
            return 1 - np.einsum("ij,ij->i", a, b)
        d = np.abs(b - a)
        if metric in ("euclidean", "sqeuclidean", "minkowski"):
            d = (d * d).sum(axis=1)
            return d if metric == "sqeuclidean" else np.sqrt(d)
        if metric == "chebyshev":
            return d.max(axis=1)
        if metric == "canberra":
            return np.nan_to_num(d / (np.abs(b) + np.abs(a))).sum(axis=1)
        return d.sum(axis=1) / (np.abs(b + a).sum(axis=1) if metric == "braycurtis" else 1)


def _cut(found: np.ndarray) -> np.ndarray:
    return np.minimum(found, np.finfo(np.float32).max).astype(np.float32)


class _Products:
    """Correlation and cosine: 1 and a product."""

    rows = ROWS
    again = None

    def __init__(self, q: np.ndarray, c: np.ndarray, metric: str):
        self.q, self.c = q.astype(np.float32), np.ascontiguousarray(-c.T, np.float32)
        self.slack = 1e-9 + (q.shape[1] + 8) * 2.4e-7

    def bounds(self, at: slice, cut: np.ndarray | None) -> np.ndarray:
        return self.q[at] @ self.c

    def cuts(self, tau: np.ndarray, at: slice) -> np.ndarray:
        return _cut(tau - 1 + self.slack)


class _Squares:
    """Euclidean distances: squares by a product, seen from the middle of the queries."""

    rows = ROWS
    again = None

    def __init__(self, q: np.ndarray, c: np.ndarray, metric: str):
        middle = q.mean(axis=0)
        q, c = q - middle, c - middle
        self.scale = max(np.abs(q).max(), np.abs(c).max()) or 1.0
        q, c = q / self.scale, c / self.scale
        n_q, n_c = (q * q).sum(axis=1, keepdims=True), (c * c).sum(axis=1, keepdims=True)
        self.q = np.hstack((-2 * q, n_q, np.ones_like(n_q))).astype(np.float32)
        self.c = np.ascontiguousarray(np.hstack((c, np.ones_like(n_c), n_c)).T, np.float32)
        self.slack = (q.shape[1] + 8) * 4.8e-7 * (n_q[:, 0] + n_c.max())
        self.squared = metric == "sqeuclidean"

    def bounds(self, at: slice, cut: np.ndarray | None) -> np.ndarray:
        return self.q[at] @ self.c

    def cuts(self, tau: np.ndarray, at: slice) -> np.ndarray:
        most = tau * (1 + 1e-12) + 1e-9
        return _cut((most / self.scale**2 if self.squared else (most / self.scale) ** 2) * (1 + 1e-6) + self.slack[at])


class _Sums:
    """Cityblock and chebyshev: sums, or the largest, of differences in whole steps."""

    rows = FEW_ROWS
    again = None

    def __init__(self, q: np.ndarray, c: np.ndarray, metric: str):
        self.width, self.largest = q.shape[1], metric == "chebyshev"
        low, high = min(q.min(), c.min()), max(q.max(), c.max())
        self.step = (high - low) / (MOST if self.largest else max(1, MOST // self.width)) or 1.0
        self.q, self.c = (np.ascontiguousarray(np.rint((x - low) / self.step).T, np.int16) for x in (q, c))

    def bounds(self, at: slice, cut: np.ndarray | None) -> np.ndarray:
        q = self.q[:, at, None]
        total = np.zeros((q.shape[1], self.c.shape[1]), np.int16)
        d = np.empty_like(total)
        for j in range(self.width):
            np.abs(np.subtract(q[j], self.c[j], out=d), out=d)
            (np.maximum if self.largest else np.add)(total, d, out=total)
            # The largest of some differences is a bound as well, and mostly leaves few pairs.
            if self.largest and cut is not None and j % 8 == 7 and np.count_nonzero(total <= cut[:, None]) < total.size >> 9:
                break
        return total

    def cuts(self, tau: np.ndarray, at: slice) -> np.ndarray:
        spare = 1 if self.largest else self.width  # a difference is off by a step at most
        return np.minimum((tau * (1 + 1e-9) + 1e-9) / self.step + spare + 1, MOST).astype(np.int16)


def _looks(q: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray, share: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the sums of |a - b| and |a + b| (share), or 0 and the sum of |a - b| / (|a| + |b|), in single precision."""
    step = max(1, EXACT // q.shape[1])
    over, under = np.zeros(len(row), np.float32), np.zeros(len(row), np.float32)
    a, b, d = (np.empty((step, q.shape[1]), np.float32) for _ in range(3))
    for i in range(0, len(row), step):
        n = len(row[i : i + step])
        x, y, z = a[:n], b[:n], d[:n]
        np.take(q, row[i : i + step], axis=0, out=x, mode="clip")
        np.take(c, col[i : i + step], axis=0, out=y, mode="clip")
        np.abs(np.subtract(x, y, out=z), out=z)
        if share:
            over[i : i + n] = np.einsum("ij->i", z)
            np.abs(np.add(x, y, out=x), out=x)
            under[i : i + n] = np.einsum("ij->i", x)
        else:
            np.add(np.abs(x, out=x), np.abs(y, out=y), out=x)
            np.divide(z, np.maximum(x, SMALL, out=x), out=z)
            over[i : i + n] = np.einsum("ij->i", z)
    return over, under


class _Shares:
    """Braycurtis: sums in whole steps over the most that the sum of |a + b| can be, which is sqrt(width) times its length."""

    rows = FEW_ROWS

    def __init__(self, q: np.ndarray, c: np.ndarray, metric: str):
        scale = max(np.abs(q).max(), np.abs(c).max()) or 1.0
        q, c = q / scale, c / scale
        self.above = _Sums(q, c, "cityblock")
        n_q, n_c = (q * q).sum(axis=1, keepdims=True), (c * c).sum(axis=1, keepdims=True)
        slack = (q.shape[1] + 8) * 4.8e-7 * (n_q + n_c.max()) + 1e-30
        self.x, self.y = q.astype(np.float32), c.astype(np.float32)
        self.off = (q.shape[1] + 8) * 2.4e-7 * (np.abs(q).sum(axis=1) + np.abs(c).sum(axis=1).max())
        self.q = (q.shape[1] * np.hstack((2 * q, n_q + slack, np.ones_like(n_q)))).astype(np.float32)
        self.c = np.ascontiguousarray(np.hstack((c, np.ones_like(n_c), n_c)).T, np.float32)

    def bounds(self, at: slice, cut: np.ndarray | None) -> np.ndarray:
        found = (self.above.bounds(at, None) - np.float32(self.above.width + 1)) * np.float32(self.above.step)
        return np.maximum(found, 0) / np.sqrt(np.maximum(self.q[at] @ self.c, SMALL))

    def cuts(self, tau: np.ndarray, at: slice) -> np.ndarray:
        return _cut(tau * (1 + 1e-5) + 1e-8)

    def again(self, row: np.ndarray, col: np.ndarray, tau: np.ndarray) -> np.ndarray:
        over, under = _looks(self.x, self.y, row, col, True)
        return over - self.off[row] <= (tau * (1 + 1e-5) + 1e-8) * (under + self.off[row])


class _Ratios:
    """Canberra: 1 where signs differ (a product), else tanh of half the logarithms' difference, which is at least the
    difference of the logarithms within a window of SPAN, times tanh(SPAN / 2) / SPAN (sums in whole steps)."""

    rows = FEW_ROWS

    def __init__(self, q: np.ndarray, c: np.ndarray, metric: str):
        self.odd_q, self.odd_c = (~np.isfinite(x).all(axis=1) for x in (q, c))
        q, c = (np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0) for x in (q, c))
        scale = max(np.abs(q).max(), np.abs(c).max()) or 1.0
        self.x, self.y = (q / scale).astype(np.float32), (c / scale).astype(np.float32)
        width = q.shape[1]
        top = 1.6 * np.sqrt(np.mean(q * q)) or 1.0
        rate = np.tanh(SPAN / 2) / SPAN
        step = 2 * SPAN / max(1, MOST // width)
        sides = []
        for x in (q, c):
            size = np.clip(np.log(np.abs(x) / top) + SPAN, 0, SPAN)
            sides.append((np.where(x < 0, -1.0, 1.0), size, rate * size.sum(axis=1, keepdims=True)))
        (s_q, l_q, sum_q), (s_c, l_c, sum_c) = sides
        self.codes = tuple(np.ascontiguousarray(np.rint(s * x / step).T, np.int16) for s, x, _ in sides)
        one = np.ones_like
        self.q = np.hstack((s_q, s_q * l_q, (width - sum_q) / 2, one(sum_q))).astype(np.float32)
        self.c = np.ascontiguousarray(np.hstack(((rate * s_c * l_c - s_c) / 2, rate / 2 * s_c, one(sum_c), -sum_c / 2)).T, np.float32)
        self.width, self.unit = width, np.float32(rate * step)
        self.slack = rate * step * (width + 1) + 1e-5 * width + 1e-8

    def bounds(self, at: slice, cut: np.ndarray | None) -> np.ndarray:
        q, c = self.codes[0][:, at, None], self.codes[1]
        total = np.zeros((q.shape[1], c.shape[1]), np.int16)
        d = np.empty_like(total)
        for j in range(self.width):
            np.add(total, np.abs(np.subtract(q[j], c[j], out=d), out=d), out=total)
        found = total * self.unit
        found += self.q[at] @ self.c
        found[self.odd_q[at]] = -np.inf
        found[:, self.odd_c] = -np.inf
        return found

    def cuts(self, tau: np.ndarray, at: slice) -> np.ndarray:
        return _cut(tau * (1 + 1e-5) + self.slack)

    def again(self, row: np.ndarray, col: np.ndarray, tau: np.ndarray) -> np.ndarray:
        over, _ = _looks(self.x, self.y, row, col, False)
        return (over <= tau * (1 + 1e-5) + 1e-5 * self.width) | self.odd_q[row] | self.odd_c[col]


SCREENS = dict.fromkeys(("correlation", "cosine"), _Products) | dict.fromkeys(("euclidean", "sqeuclidean", "minkowski"), _Squares) | {"cityblock": _Sums, "chebyshev": _Sums, "braycurtis": _Shares, "canberra": _Ratios}


def _marked(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true in a matrix where little is."""
    flat = m.ravel()
    even = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:even].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate((at[flat[at]], even + np.flatnonzero(flat[even:])))
    return at // m.shape[1], at % m.shape[1]


class Best:
    """The k best candidates so far of each query of a block: nearest first, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, metric: str, limit: float):
        x = ready(x, metric)
        if metric != "canberra":  # elsewhere such rows have no distance to any
            held = np.isfinite(x).all(axis=1)
            ids, x = ids[held], x[held]
        self.ids, self.x, self.k, self.metric, self.limit = ids, x, k, metric, limit
        self.dist, self.to = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.fresh = True

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes in a block of candidates."""
        x = ready(x, self.metric)
        if self.metric != "canberra":
            held = np.isfinite(x).all(axis=1)
            ids, x = ids[held], x[held]
        if not len(ids) or not len(self.ids):
            return
        with np.errstate(all="ignore"):
            screen = SCREENS[self.metric](self.x, x, self.metric)
            for begin in range(0, len(self.ids), screen.rows):
                at = slice(begin, min(begin + screen.rows, len(self.ids)))
                cut = None if self.fresh else screen.cuts(np.minimum(self.dist[at, -1], self.limit), at)
                bound = screen.bounds(at, cut)
                if self.fresh:
                    some = bound[:, :FIRST]
                    most = min(self.k + 1, some.shape[1])
                    near = np.argpartition(some, most - 1, axis=1)[:, :most]
                    self._add(begin + np.repeat(np.arange(len(near)), most), near.ravel(), ids, x)
                    cut = screen.cuts(np.minimum(self.dist[at, -1], self.limit), at)
                hit = np.flatnonzero(bound.min(axis=1) <= cut)
                if len(hit):
                    row, col = _marked(bound[hit] <= cut[hit, None])
                    row = begin + hit[row]
                    if screen.again is not None:
                        kept = screen.again(row, col, np.minimum(self.dist[row, -1], self.limit))
                        row, col = row[kept], col[kept]
                    self._add(row, col, ids, x)
            self.fresh = False

    def _add(self, row: np.ndarray, col: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(1, EXACT // x.shape[1])
        for i in range(0, len(row), step):
            r, c = row[i : i + step], col[i : i + step]
            d = np.round(pairs(self.x[r], x[c], self.metric), 9)
            good = (self.ids[r] != ids[c]) & np.isfinite(d) & (d <= np.minimum(self.dist[r, -1], self.limit))
            if good.any():
                self._merge(r[good], d[good], ids[c[good]])

    def _merge(self, row: np.ndarray, dist: np.ndarray, to: np.ndarray) -> None:
        some = np.unique(row)
        row = np.concatenate((np.repeat(some, self.k), row))
        dist, to = np.concatenate((self.dist[some].ravel(), dist)), np.concatenate((self.to[some].ravel(), to))
        order = np.lexsort((to, dist, row))
        row, dist, to = row[order], dist[order], to[order]
        again = np.zeros(len(row), bool)  # a block's first best come again with its others
        again[1:] = (row[1:] == row[:-1]) & (to[1:] == to[:-1]) & (dist[1:] == dist[:-1])
        row, dist, to = row[~again], dist[~again], to[~again]
        first = np.searchsorted(row, some)
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        kept = place < self.k
        self.dist[some], self.to[some] = np.inf, np.iinfo(np.int64).max
        self.dist[row[kept], place[kept]], self.to[row[kept], place[kept]] = dist[kept], to[kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(src, dst, dist) of what there is."""
        row, col = np.nonzero(np.isfinite(self.dist))
        return self.ids[row], self.to[row, col], self.dist[row, col]
