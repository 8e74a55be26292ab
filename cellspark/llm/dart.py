"""DartMinHash: fast signatures for the weighted Jaccard similarity (Christiani, 2020).

Darts are thrown at rate one per unit of area into the quarter plane of weight and rank of every
element, dyadic region by dyadic region, from hashes of the element and the region alone. Those below
the element's weight and below a rank limit belong to the set; of each coordinate the one of least rank
is kept. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

#: Exponent of the least rank region's upper end.
LOW = -6
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: a bijection of 64-bit words that scatters them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


@cache
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, ... events."""
    k = np.arange(int(mean + 12 * math.sqrt(mean) + 24))
    return np.cumsum(np.exp(-mean + k * math.log(mean) - np.array([math.lgamma(i + 1) for i in k.tolist()])))


def _ends(step: int, low: int) -> tuple[float, float]:
    """Ends of the dyadic interval number ``step``; number 0 goes from 0 to 2 ** low."""
    return (0.0 if step == 0 else 2.0 ** (low + step - 1)), 2.0 ** (low + step)


def _throw(element: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element's place, rank and id of every dart below the weight and the rank limit of its element."""
    owners, ranks, ids = [], [], []
    nu = 0
    while (wide := np.flatnonzero(weight > _ends(nu, 0)[0])).size:
        w0, w1 = _ends(nu, 0)
        rho = 0
        while (own := wide[limit[wide] > _ends(rho, LOW)[0]]).size:
            r0, r1 = _ends(rho, LOW)
            seed = mix(element[own] + np.uint64(int(GOLDEN) * (1 + nu * 128 + rho) % 2**64))
            n = np.searchsorted(_poisson((w1 - w0) * (r1 - r0)), _unit(seed), side="right")
            at = np.repeat(np.arange(len(own)), n)
            if at.size:
                nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                dart = mix(seed[at] ^ mix(GOLDEN * (nth.astype(np.uint64) + np.uint64(1))))
                rank = r0 + (r1 - r0) * _unit(mix(dart + np.uint64(1)))
                own = own[at]
                hit = (w0 + (w1 - w0) * _unit(mix(dart + np.uint64(2))) < weight[own]) & (rank < limit[own])
                owners.append(own[hit])
                ranks.append(rank[hit])
                ids.append(dart[hit])
            rho += 1
        nu += 1
    return np.concatenate(owners), np.concatenate(ranks), np.concatenate(ids)


def signatures(element: np.ndarray, weight: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Signatures (sets x k) of sets that lie one after the other; ``sizes`` counts their elements.

    ``element`` holds distinct 64-bit hashes within a set, ``weight`` positive numbers. No set is empty.
    The rank limit lets about k (ln k + 2) darts of each set through; the few sets in which a
    coordinate gets none are thrown again with twice the limit.
    """
    out = np.zeros((len(sizes), k), np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(owner, weight, len(sizes))
    limit = k * (math.log(k) + 2) / total
    todo = np.arange(len(sizes))
    while todo.size:
        some = np.isin(owner, todo) if len(todo) < len(sizes) else np.ones(len(owner), bool)
        own = owner[some]
        at, rank, dart = _throw(element[some], weight[some], limit[own])
        cell = own[at] * k + (mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)
        least = np.full(len(sizes) * k, np.inf)
        np.minimum.at(least, cell, rank)
        won = rank == least[cell]
        out.reshape(-1)[cell[won]] = dart[won]
        filled = np.isfinite(least).reshape(-1, k).all(axis=1)[todo]
        todo = todo[~filled]
        limit[todo] *= 2
    return out
