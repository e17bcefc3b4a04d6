"""Per-task state of a nearest-neighbour search, on numpy arrays."""

from __future__ import annotations

import numpy as np

# Elements of a distance block or of a gathered vector block held at a time.
BLOCK_ELEMENTS = 1 << 22
FLOAT32_UNIT = 2.0**-24
FLOAT32_SAFE = 1e36

# Candidates per query and result beyond which a block looks for a closer bound.
CROWDED = 4


def exact_distance(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise distance in double precision."""
    if metric == "l2":
        return ((q - v) ** 2).sum(axis=1)
    dots = (q * v).sum(axis=1)
    if metric == "ip":
        return 1.0 - dots
    norms = np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1))
    return 1.0 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def drop_surplus_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of more than k equal vectors only the k smallest ids can be among the k nearest.

    Equal vectors are found by equal projections on one direction, then compared.
    """
    if len(ids) <= k:
        return ids, vectors
    direction = np.cos(np.arange(1, vectors.shape[1] + 1, dtype=np.float64))
    _, group, size = np.unique(vectors @ direction, return_inverse=True, return_counts=True)
    keep = np.ones(len(ids), dtype=bool)
    for crowded in np.flatnonzero(size > k):
        rows = np.flatnonzero(group == crowded)
        if (vectors[rows] == vectors[rows[0]]).all():
            keep[rows[np.argsort(ids[rows], kind="stable")[k:]]] = False
    return ids[keep], vectors[keep]


class NearestRecords:
    """The k nearest records seen so far for each of a block of query vectors.

    One single-precision matrix product gives a lower bound of every distance
    (up to a constant). Only pairs whose bound reaches the k-th best are
    computed exactly, so the result equals a full double-precision search. Ties
    at `digits` decimals go to the smaller id.
    """

    def __init__(
        self, queries: np.ndarray, k: int, metric: str, digits: int = 9, bounds: np.ndarray | None = None
    ):
        """`bounds` are tie keys that the k-th best of each query is known not to exceed."""
        self.queries = queries.astype(np.float64)
        self.k = k
        self.metric = metric
        self.scale = 10.0**digits
        self.count, self.dim = queries.shape
        self.error = 4.0 * (self.dim + 8) * FLOAT32_UNIT
        self.query = np.zeros(0, dtype=np.int64)
        self.tie_key = np.zeros(0)
        self.distance = np.zeros(0)
        self.ids: np.ndarray | None = None
        self.worst = np.full(self.count, np.inf) if bounds is None else (bounds + 0.5) / self.scale
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        scaled, self._squares = self._scaled(self.queries)
        if metric == "l2":
            self._offset, self._weight, dots = 0.0, 1.0 - self.error, -2.0 * scaled
        else:
            self._offset, self._weight, dots = 1.0, -self.error, -scaled
        ones = np.ones((self.count, 1))
        with np.errstate(over="ignore"):
            self._left = np.hstack([dots, ones, self._weight * self._squares[:, None]]).astype(np.float32)

    def _scaled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows as the bound sees them (unit length for cosine) and their squared lengths."""
        squares = (rows**2).sum(axis=1)
        if self.metric != "cosine":
            return rows, squares
        norms = np.sqrt(squares)[:, None]
        rows = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
        return rows, (rows**2).sum(axis=1)

    def update(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take in a batch of records with finite vectors of the right width."""
        ids, vectors = drop_surplus_copies(ids, vectors, self.k)
        if len(ids) == 0 or self.count == 0:
            return
        exact = vectors.astype(np.float64)
        scaled, squares = self._scaled(exact)
        with np.errstate(over="ignore"):
            right = np.hstack([scaled, self._weight * squares[:, None], np.ones((len(ids), 1))]).astype(np.float32).T
        step = max(1, BLOCK_ELEMENTS // len(ids))
        for start in range(0, self.count, step):
            self._update_block(slice(start, min(start + step, self.count)), ids, exact, right, squares.max())

    def _update_block(self, block: slice, ids, exact, right, largest: float) -> None:
        own = self._squares[block]
        if max(own.max(), largest) > FLOAT32_SAFE:
            lower = np.full((len(own), len(ids)), -np.inf, dtype=np.float32)
        else:
            lower = self._left[block] @ right
        near = lower <= self._reach(self.worst[block])
        if len(ids) > self.k and np.count_nonzero(near) > CROWDED * self.k * len(own):
            kth = np.partition(lower, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
            bound = kth + self._offset + 2.0 * self.error * (own + largest)
            near = lower <= self._reach(np.minimum(self.worst[block], bound))
        rows, columns = np.nonzero(near)
        if len(rows) == 0:
            return
        rows += block.start
        distances = np.empty(len(rows))
        step = max(1, BLOCK_ELEMENTS // self.dim)
        for start in range(0, len(rows), step):
            part = slice(start, start + step)
            distances[part] = exact_distance(self.queries[rows[part]], exact[columns[part]], self.metric)
        self.waiting.append((rows, ids[columns], distances))
        # sorting again costs the whole state, so what is new waits until it is worth it
        if 2 * sum(len(w[0]) for w in self.waiting) >= len(self.query):
            self.settle()

    def _reach(self, bound: np.ndarray) -> np.ndarray:
        """Largest lower bound that may still tie with `bound`, rounded outwards."""
        reach = bound - self._offset + 1.0 / self.scale
        return (reach + np.abs(reach) * 1e-6).astype(np.float32)[:, None]

    def settle(self) -> None:
        """Merge what waits into the k best of each query."""
        if not self.waiting:
            return
        query, ids, distance = (np.concatenate(parts) for parts in zip(*self.waiting))
        self.waiting = []
        query = np.concatenate([self.query, query])
        tie_key = np.concatenate([self.tie_key, np.rint(distance * self.scale)])
        distance = np.concatenate([self.distance, distance])
        ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        order = _by_query_key_id(query, tie_key, ids)
        query = query[order]
        first = np.searchsorted(query, query, side="left")
        kept = (np.arange(len(query)) - first < self.k) & (tie_key[order] <= self._limit()[query])
        order = order[kept]
        self.query, self.tie_key = query[kept], tie_key[order]
        self.distance, self.ids = distance[order], ids[order]
        found = np.bincount(self.query, minlength=self.count)
        full = found >= self.k
        last = np.cumsum(found) - 1
        self.worst[full] = (self.tie_key[last[full]] + 0.5) / self.scale

    def _limit(self) -> np.ndarray:
        """Largest tie key that may still be among the k best."""
        return self.worst * self.scale


def _by_query_key_id(query: np.ndarray, tie_key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by query, key and id; ids, which may be Python strings, are compared in ties alone."""
    order = np.lexsort((tie_key, query))
    equal = (np.diff(query[order]) == 0) & (np.diff(tie_key[order]) == 0)
    tied = np.flatnonzero(np.append(equal, False) | np.append(False, equal))
    if len(tied):
        rows = order[tied]
        order[tied] = rows[np.lexsort((ids[rows], tie_key[rows], query[rows]))]
    return order
