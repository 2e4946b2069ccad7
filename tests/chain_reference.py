"""Transition graphs by plain loops over one area's states, to hold the distributed ones against."""

import itertools
import math

import numpy as np
from blockweave.operators.chains import exact_states, log_prob, partial_states


def reduced_edges(counts: np.ndarray, v: np.ndarray, logp: np.ndarray, k: int) -> tuple[list, list]:
    """Chain over exact solutions: half lazy; k elements are taken out, and refilled by the likelihood of the whole."""
    states = exact_states(counts, v, logp)
    number = {s: i for i, s in enumerate(states)}
    edges: dict[tuple[int, int], float] = {}
    for i, s in enumerate(states):
        n = sum(s)
        kk = min(k, n)
        for r in itertools.product(*[range(min(m, kk) + 1) for m in s]):
            if sum(r) != kk:
                continue
            keep = np.array(s) - r
            fill = exact_states(np.array(r) @ v, v, logp)
            to = [tuple(int(a) for a in keep + np.array(f)) for f in fill]
            lw = np.array([log_prob(np.array(t), logp) for t in to])
            w = np.exp(lw - lw.max())
            for t, p in zip(to, w / w.sum(), strict=True):
                if t in number and number[t] != i:
                    edges[i, number[t]] = edges.get((i, number[t]), 0.0) + p / (2 * math.comb(n, kk))
    return states, _with_loops(edges, len(states))


def _with_loops(edges: dict[tuple[int, int], float], n: int) -> list[tuple[int, int, float]]:
    out = np.zeros(n)
    for (a, _), w in edges.items():
        out[a] += w
    return sorted([(a, b, w) for (a, b), w in edges.items()] + [(i, i, 1 - out[i]) for i in range(n)])


def gibbs_edges(counts: np.ndarray, v: np.ndarray, logp: np.ndarray, gamma: float) -> tuple[list, list]:
    """Lazy heat bath: one element's multiplicity is redrawn by likelihood and exp(-gamma x what is left)."""
    states = partial_states(counts, v)
    number = {s: i for i, s in enumerate(states)}
    weight = np.array([log_prob(np.array(s), logp) - gamma * (counts - np.array(s) @ v).sum() for s in states])
    edges: dict[tuple[int, int], float] = {}
    for i, s in enumerate(states):
        for e in range(len(v)):
            line, n = [], 0
            while (t := (*s[:e], n, *s[e + 1 :])) in number:
                line.append(number[t])
                n += 1
            w = np.exp(weight[line] - weight[line].max())
            for j, p in zip(line, w / w.sum(), strict=True):
                if j != i:
                    edges[i, j] = edges.get((i, j), 0.0) + p / (2 * len(v))
    return states, _with_loops(edges, len(states))


def simple_edges(counts: np.ndarray, v: np.ndarray, logp: np.ndarray, gamma: float) -> tuple[list, list]:
    """Lazy Metropolis: a multiplicity of one element is proposed and taken by the ratio of weights."""
    states = partial_states(counts, v)
    number = {s: i for i, s in enumerate(states)}
    weight = [log_prob(np.array(s), logp) - gamma * (counts - np.array(s) @ v).sum() for s in states]
    most = [int((counts[x > 0] // x[x > 0]).min()) for x in v]
    edges = {}
    for i, s in enumerate(states):
        for e in range(len(v)):
            for n in range(most[e] + 1):
                j = number.get((*s[:e], n, *s[e + 1 :]))
                if j is not None and j != i:
                    edges[i, j] = min(1.0, math.exp(weight[j] - weight[i])) / (2 * len(v) * most[e])
    return states, _with_loops(edges, len(states))


KINDS = {"reduced": reduced_edges, "gibbs": gibbs_edges, "simple": simple_edges}


