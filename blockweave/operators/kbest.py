"""The n best exact solutions of V x = counts, x whole and not negative, by sum of cost: k-best over a layered dynamic program.

One area's counts are one small problem.  The prices of its linear relaxation turn costs into reduced costs, which are not
negative and say how far a partial solution is over the bound.  Layers hold what may be left of the counts after each
household type, without what is too far over; the best ways through the layers come out in order of cost.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np

TOLERANCE = 1e-5
FIRST_WIDTH = 4.0  # nats over the bound that are looked at first
WIDER = 1.25  # and by how much more, until enough solutions lie within
BIG = 1e6  # cost of a count that no type fills, in the relaxation
BOX = 10_000_000  # entries of the tables of what some of the counts cost at least
TIES = 1000  # solutions that tie with the last of the n best and are compared with it


class Layer(NamedTuple):
    """Ways from what is left before a type to what is left after it, sorted by source."""

    element: int
    first: np.ndarray  # of each source its first way; one more at the end
    times: np.ndarray
    to: np.ndarray


def dual_prices(v: np.ndarray, cost: np.ndarray, counts: np.ndarray) -> np.ndarray | None:
    """Prices y with v @ y <= cost and a high bound y @ counts; zeros where the simplex method does not end; None if no x solves.

    The counts are moved a little against cycling, which the prices' being valid does not depend on.
    """
    n, d = v.shape
    if not n:
        return None
    inverse, basis = np.eye(d), np.full(d, -1)
    x = counts + 1e-4 * np.random.default_rng(1).random(d)
    for _ in range(50 * d + 200):
        y = np.where(basis < 0, BIG, cost[basis]) @ inverse
        reduced = cost - v @ y
        j = int(reduced.argmin())
        if reduced[j] > -1e-9:
            break
        w = inverse @ v[j]
        ratio = np.where(w > 1e-9, x / np.where(w > 1e-9, w, 1.0), np.inf)
        i = int(ratio.argmin())
        if ratio[i] == np.inf:
            return np.zeros(d)
        x = x - ratio[i] * w
        x[i] = ratio[i]
        row = inverse[i] / w[i]
        inverse = inverse - np.outer(w, row)
        inverse[i] = row
        basis[i] = j
    else:
        return np.zeros(d)
    most = counts.sum() // max(1, v.sum(axis=1).min())  # types in any solution
    if y @ counts > cost.max() * most + 1 + 1e-9 * BIG:
        return None
    return y


def _in_order(v: np.ndarray, reduced: np.ndarray) -> np.ndarray:
    """Order of the types: those that fill the count that fewest types fill, then of the others those that fill the next."""
    dims = np.argsort((v > 0).sum(axis=0), kind="stable")
    return np.lexsort((reduced, (v[:, dims] > 0).argmax(axis=1)))


class Lookahead:
    """What the types from each on cost at least, by what is left of a few counts: those that most types fill, which are settled last."""

    def __init__(self, v: np.ndarray, reduced: np.ndarray, counts: np.ndarray, order: np.ndarray):
        self.dims: list[int] = []
        for d in np.argsort(-(v > 0).sum(axis=0), kind="stable").tolist():
            if np.prod(counts[[*self.dims, d]] + 1.0) * (len(order) + 1) <= BOX:
                self.dims.append(d)
        shape = tuple(int(c) + 1 for c in counts[self.dims])
        table = np.full(shape, np.inf, np.float32)
        table[(0,) * len(shape)] = 0
        tables = [table.ravel()]
        for e in order[::-1]:
            step, table = v[e, self.dims], table.copy()
            if not step.any():  # free to take here
                tables.append(table.ravel())
                continue
            before = table.copy()
            for k in range(1, int((counts[self.dims][step > 0] // step[step > 0]).min()) + 1):
                to = tuple(slice(int(k * x), None) for x in step)
                of = tuple(slice(0, n - int(k * x)) for n, x in zip(shape, step, strict=True))
                table[to] = np.minimum(table[to], before[of] + np.float32(k * reduced[e]))
            tables.append(table.ravel())
        self.tables = tables[::-1]
        self.strides = np.array([int(np.prod(shape[i + 1 :])) for i in range(len(shape))], np.int64)

    def least(self, at: int, left: np.ndarray) -> np.ndarray:
        """For the types from place ``at`` of the order on."""
        return self.tables[at][left[:, self.dims] @ self.strides]


def _forward(v: np.ndarray, reduced: np.ndarray, counts: np.ndarray, order: np.ndarray, ahead: Lookahead, width: float, max_states: int) -> tuple[list[Layer], np.ndarray, bool] | None:
    """Layers, their last states (one, nothing left, or none), and whether nothing was too far over; None beyond ``max_states``."""
    last = len(order) - 1 - (v[order][::-1] > 0).argmax(axis=0)
    names = np.random.default_rng(2).integers(1, 1 << 63, len(counts), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    left, over = counts[None, :].copy(), np.zeros(1)
    name = (left.astype(np.uint64) * names).sum(axis=1)
    layers, whole, n_states = [], True, 1
    for at, e in enumerate(order):
        used = np.flatnonzero(v[e])
        most = int((left[:, used] // v[e, used]).min(axis=1).max(initial=0))
        ends = np.flatnonzero(last == at)  # no later type fills these counts
        if not most and not len(ends):
            continue
        parts = []
        source, n_source = np.arange(len(left)), len(left)
        steps = np.arange(most + 1, dtype=np.uint64) * (v[e].astype(np.uint64) * names).sum()
        for k in range(most + 1):
            if k:
                source = source[(left[source][:, used] >= k * v[e, used]).all(axis=1)]
            rest, far = left[source] - k * v[e], over[source] + k * reduced[e]
            good = (rest[:, ends] == 0).all(axis=1)
            ahead_of = ahead.least(at + 1, rest)
            near = good & (far + ahead_of <= width)
            whole &= not (good & ~near & (ahead_of < np.inf)).any()
            parts.append((source[near], np.full(int(near.sum()), k, np.int32), rest[near], name[source[near]] - steps[k], far[near]))
        s, times, rest, code, far = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, first, to = np.unique(code, return_index=True, return_inverse=True)
        if not (rest == rest[first][to]).all():
            raise RuntimeError("two remainders share a name")
        n_states += len(first)
        if n_states > max_states:
            return None
        left, name = rest[first], code[first]
        over = np.full(len(first), np.inf)
        np.minimum.at(over, to, far)
        by = np.argsort(s, kind="stable")
        layers.append(Layer(int(e), np.searchsorted(s[by], np.arange(n_source + 1)), times[by], to[by].astype(np.int32)))
        if not len(left):
            break
    return layers, left, whole


class Ways:
    """All ways through the layers, with the least cost from each place on; the best are taken lazily."""

    def __init__(self, layers: list[Layer], cost: np.ndarray):
        self.layers, self.cost, self.best = layers, cost, [np.zeros(1)]
        for layer in reversed(layers):
            n = len(layer.first) - 1
            price = np.full(n, np.inf)
            source = np.repeat(np.arange(n), np.diff(layer.first))
            np.minimum.at(price, source, layer.times * cost[layer.element] + self.best[-1][layer.to])
            self.best.append(price)
        self.best.reverse()
        self.known: dict[tuple[int, int], list[tuple[float, int, int]]] = {}

    def out(self, at: int, state: int) -> list[tuple[float, int, int]]:
        """(cost to the end, times, next state) of the ways out of a place, best first."""
        found = self.known.get((at, state))
        if found is None:
            layer = self.layers[at]
            a, b = layer.first[state], layer.first[state + 1]
            total = layer.times[a:b] * self.cost[layer.element] + self.best[at + 1][layer.to[a:b]]
            found = self.known[at, state] = sorted(x for x in zip(total.tolist(), layer.times[a:b].tolist(), layer.to[a:b].tolist(), strict=True) if x[0] < np.inf)
        return found

    def __iter__(self):
        """(cost, ((type, times), ...)) in order of cost.  A way leaves another one at one place, by the next best way out there."""
        if self.best[0][0] == np.inf:
            return
        made = 0
        heap = [(float(self.best[0][0]), made, 0.0, (), 0, 0, 0)]
        while heap:
            total, _, spent, chosen, at, state, nth = heapq.heappop(heap)
            while at < len(self.layers):
                ways = self.out(at, state)
                if nth + 1 < len(ways):
                    made += 1
                    heapq.heappush(heap, (spent + ways[nth + 1][0], made, spent, chosen, at, state, nth + 1))
                _, times, to = ways[nth]
                e = self.layers[at].element
                if times:
                    spent, chosen = spent + times * float(self.cost[e]), (*chosen, (e, times))
                at, state, nth = at + 1, to, 0
            yield total, chosen


def n_best(counts: np.ndarray, v: np.ndarray, cost: np.ndarray, n: int, max_states: int) -> tuple[list[tuple[float, tuple[tuple[int, int], ...]]], bool]:
    """The ``n`` best solutions (cost, ((row of v, times), ...)), best first, and whether they are certain to be.

    Where there are fewer, all; where ``max_states`` states do not do, those that lie within the last width that they did for.
    Equal costs (to 9 digits) go by the rows: the multiset that has more of the first row where two differ comes first; of more than TIES
    that tie with the last, those that the search meets first are compared.
    """
    counts = np.asarray(counts, np.int64)
    if not counts.any():
        return [(0.0, ())], True
    held = counts > 0
    fit = np.flatnonzero((v <= counts).all(axis=1))
    part, price, left = v[fit][:, held].astype(np.int64), cost[fit], counts[held]
    y = dual_prices(part, price, left)
    if y is None:
        return [], True
    bound = float(y @ left)
    reduced = np.maximum(0.0, price - part @ y)
    if not (part > 0).any(axis=0).all():  # a count that nothing fills
        return [], True
    order = _in_order(part, reduced)
    ahead = Lookahead(part, reduced, left, order)
    found: list[tuple[float, tuple[tuple[int, int], ...]]] = []
    width = FIRST_WIDTH
    while True:
        built = _forward(part, reduced, left, order, ahead, width, max_states)
        if built is None:
            return _ranked(found, n), False
        layers, end, whole = built
        found, certain = [], whole
        if len(end):
            for total, chosen in Ways(layers, price):
                if total > bound + width - TOLERANCE and not whole:
                    break
                if len(found) >= n and (total > found[n - 1][0] + 1e-9 or len(found) >= n + TIES):
                    certain = True
                    break
                found.append((total, tuple((int(fit[e]), k) for e, k in chosen)))
            else:
                certain |= len(found) >= n and whole
        if certain:
            return _ranked(found, n), True
        width *= WIDER


def _ranked(found: list, n: int) -> list:
    found = [(c, tuple(sorted(x))) for c, x in found]
    return sorted(found, key=lambda x: (round(x[0], 9), [(e, -k) for e, k in x[1]]))[:n]
