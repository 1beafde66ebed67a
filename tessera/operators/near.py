"""The radius graph of one system's points within a task, without an edge: which points are near which, cell by cell.

Points are sorted by cells of the radius' width, and a slice of a cell meets the cells around it. A pair that meets takes one bit, up
to a bound on all of them; what is beyond is computed anew at each product. So a task holds its points and no more
than a fixed number of bits, however many edges there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

from tessera.operators.contacts import squared

#: Points whose rows of pairs are unfolded at once, and pairs at most; points of more partners go fewer at once.
ROWS, PAIRS = 64, 1 << 22
#: Bytes of bits that a task holds.
HELD_BYTES = 128 << 20
#: Vectors that the solver moves at once.
WIDTH = 6


def _places(x: np.ndarray, width: float) -> np.ndarray:
    """Numbers of cells from 1, neighbouring ones in sequence and others at least two apart."""
    with np.errstate(invalid="ignore"):
        cells = np.clip(np.nan_to_num(np.floor(x / width)), -(2.0**40), 2.0**40).astype(np.int64)
    names, at = np.unique(cells, return_inverse=True)
    return np.r_[0, np.cumsum(np.minimum(np.diff(names), 2))][at] + 1


class Near:
    """Degrees and products with the Laplacian of points of three axes; a point is no neighbour of itself."""

    def __init__(self, xyz: Sequence[np.ndarray], r: float):
        self.n, self.r2 = len(xyz[0]), float(r) * float(r)
        c = [_places(x, float(r) * (1 + 1e-9)) for x in xyz]
        _, high, deep = (int(x.max(initial=0)) + 2 for x in c)
        names = (c[0] * high + c[1]) * deep + c[2]
        self.order = np.argsort(names, kind="stable")
        names, self.xyz = names[self.order], [x[self.order] for x in xyz]
        around = np.array([(a * high + b) * deep for a in (-1, 0, 1) for b in (-1, 0, 1)])
        starts = np.flatnonzero(np.r_[True, np.diff(names) != 0]) if self.n else np.empty(0, np.int64)
        self.slices, self.at, degree, held = [], np.empty(self.n, np.int64), np.empty(self.n, np.int64), 0
        for a, b in zip(starts, np.r_[starts[1:], self.n]):
            # a cell, the one before it and the one after it on the last axis follow each other
            low, end = (np.searchsorted(names, names[a] + around + d, side) for d, side in ((-1, "left"), (1, "right")))
            spans = [(int(x), int(y)) for x, y in zip(low, end) if x < y]
            step = max(1, min(ROWS, PAIRS // sum(y - x for x, y in spans)))
            for lo in range(a, b, step):
                hi = min(b, lo + step)
                near = self._pairs(lo, hi, spans)
                degree[lo:hi], self.at[lo:hi] = np.count_nonzero(near, axis=1), len(self.slices)
                bits = np.packbits(near, axis=1) if held + len(near) * ((near.shape[1] + 7) // 8) <= HELD_BYTES else None
                held += 0 if bits is None else bits.nbytes
                self.slices.append((lo, hi, spans, near.shape[1], bits))
        self.degree = np.empty(self.n, np.int64)
        self.degree[self.order] = degree

    def _of(self, x: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
        return np.concatenate([x[a:b] for a, b in spans])

    def _pairs(self, lo: int, hi: int, spans: list[tuple[int, int]]) -> np.ndarray:
        near = squared([x[lo:hi, None] for x in self.xyz], [self._of(x, spans) for x in self.xyz]) <= self.r2
        before = 0
        for a, b in spans:
            if a <= lo < b:
                near[np.arange(hi - lo), before + np.arange(lo, hi) - a] = False
            before += b - a
        return near

    def _rows(self) -> Iterator[tuple[int, int, list, np.ndarray]]:
        for lo, hi, spans, width, bits in self.slices:
            yield lo, hi, spans, self._pairs(lo, hi, spans) if bits is None else np.unpackbits(bits, axis=1, count=width)

    def laplacian(self, nodes: np.ndarray) -> np.ndarray:
        """The dense Laplacian of ``nodes``, sorted, which have no neighbour among the others."""
        back = np.full(self.n, -1)
        back[nodes] = np.arange(len(nodes))
        back = back[self.order]
        out = np.zeros((len(nodes), len(nodes)))
        for s in np.unique(self.at[back >= 0]):
            lo, hi, spans, width, bits = self.slices[s]
            near = self._pairs(lo, hi, spans) if bits is None else np.unpackbits(bits, axis=1, count=width)
            own, there = back[lo:hi], self._of(back, spans)
            i, j = np.flatnonzero(own >= 0), np.flatnonzero(there >= 0)
            out[np.ix_(own[i], there[j])] = -near[np.ix_(i, j)].astype(float)
        np.fill_diagonal(out, self.degree[nodes])
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        """D - A times the columns of ``x``."""
        own = np.ascontiguousarray(x[self.order])
        out = np.empty_like(own)
        for lo, hi, spans, near in self._rows():
            out[lo:hi] = near.astype(float) @ self._of(own, spans)
        back = np.empty_like(out)
        back[self.order] = out
        return self.degree[:, None] * x - back

    def labels(self) -> np.ndarray:
        """The first node of each node's component."""
        label, names = np.full(self.n, -1), np.empty(self.n, np.int64)
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        for s in place:
            front = np.array([s]) if label[s] < 0 else ()
            while len(front):
                label[front], found = s, []
                for k in np.unique(self.at[front]):
                    lo, hi, spans, width, bits = self.slices[k]
                    own = front[self.at[front] == k] - lo
                    near = self._pairs(lo, hi, spans)[own].any(axis=0) if bits is None else np.unpackbits(np.bitwise_or.reduce(bits[own], axis=0), count=width).view(bool)
                    there = np.concatenate([np.arange(a, b) for a, b in spans])[near]
                    there = there[label[there] < 0]
                    label[there] = s
                    found.append(there)
                front = np.concatenate(found)
        names[self.order] = self.order[label]
        return names


def second_pair(times: Callable, degree: np.ndarray, rounds: int = 1000, close: float = 1e-8) -> tuple[float, np.ndarray]:
    """Second smallest pair of a connected graph's D - A: some vectors improved together across the constant one.

    Each round minimises over the vectors, their residuals divided by the degrees and their last moves, with one product for
    all of them. ValueError if the residual stays above ``close`` times the larger of the value and 1e-4.
    """
    m, k = len(degree), min(WIDTH, len(degree) // 4)
    one = np.ones((m, 1))
    x = np.linalg.qr(np.hstack([one, np.random.default_rng(0).normal(size=(m, k))]))[0][:, 1:]
    ax, p = times(x), np.zeros((m, 0))
    values, c = np.linalg.eigh(x.T @ ax)
    x, ax = x @ c, ax @ c
    best, since = None, 0
    for _ in range(rounds):
        rest = ax - x * values
        off = np.linalg.norm(rest, axis=0)
        # the next ones have to be near theirs too, or one of them may still fall below the first
        known = (off[: k // 2 + 1] <= 1e-3 * np.maximum(values[: k // 2 + 1], 1e-4)).all()
        if known and (best is None or off[0] < best[0]):
            best, since = (off[0], values[0], x[:, 0].copy()), 0
        since += known
        if known and (best[0] <= 1e-10 * max(best[1], 1e-4) or since > 30):
            break
        # what is next to nothing of moves and residuals becomes some other direction, which does no harm
        q, r = np.linalg.qr(np.hstack([one, x, p, rest / degree[:, None]]))
        q = q[:, 1:]
        images = np.hstack([ax * np.sign(np.diag(r)[1 : k + 1]), times(q[:, k:])])
        h = q.T @ images
        values, c = np.linalg.eigh((h + h.T) / 2)
        values, c = values[:k], c[:, :k]
        x, ax, p = q @ c, images @ c, q[:, k:] @ c[k:]
    if best is not None:
        v = best[2] - best[2].mean()
        v /= np.linalg.norm(v)
        lv = times(v[:, None])[:, 0]
        if np.linalg.norm(lv - (v @ lv) * v) <= close * max(v @ lv, 1e-4):
            return float(v @ lv), v
    raise ValueError(f"{m} nodes; the iteration did not converge")
