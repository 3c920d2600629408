"""A suffix tree in memory, by arrays of whole corpora: the slow version that the tables are held against."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tandem.llm.suffix_lm import grams


class Keys:
    """Positions of hashes in a sorted array, -1 where absent; a bit table spares most searches."""

    BITS = 22

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.maybe = np.zeros(1 << self.BITS, dtype=bool)
        self.maybe[keys >> np.uint64(64 - self.BITS)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int64)
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - self.BITS)])
        if len(at):
            k = np.searchsorted(self.keys, h[at])
            k[k == len(self.keys)] = 0
            hit = self.keys[k] == h[at]
            out[at[hit]] = k[hit]
        return out


@dataclass
class Level:
    """Frequent runs of one length, sorted by hash: context (all but the last token), suffix (all but the first)."""

    key: np.ndarray
    n: np.ndarray
    context: np.ndarray
    suffix: np.ndarray
    symbol: np.ndarray


@dataclass
class Tree:
    """Kept states and stored edges by depth, with the unigram odds of the frequent words."""

    states: list[tuple[np.ndarray, np.ndarray]]  # (context keys, weight handed to the suffix)
    edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # (run keys, own probability, base probability)


def build(levels: list[Level], total: int, distinct: int, min_gain: float) -> Tree:
    """Keep the states that pass the divergence test, from short to long."""
    z = total + 0.5 * (distinct + 1)
    words = levels[0]
    q = (words.n + 0.5) / z  # probability of each run's last token under its longest kept context
    states, edges = [], []
    for d in range(1, len(levels)):
        below, here = levels[d - 1], levels[d]
        at = np.searchsorted(below.key, here.context)
        q_below = q[np.searchsorted(below.key, here.suffix)]
        base = (words.n[np.searchsorted(words.key, here.symbol)] + 0.5) / z
        n = below.n.astype(np.float64)
        m = len(n)
        stored = np.bincount(at, weights=here.n, minlength=m)
        symbols = np.bincount(at, minlength=m)
        seen = np.bincount(at, weights=q_below, minlength=m)
        gain = np.bincount(at, weights=here.n * np.log(here.n / n[at] / q_below), minlength=m)
        rest = np.maximum(n - stored, 0)
        spare = np.maximum(1 - seen, 1e-12)
        gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-300) / n / spare), 0)
        keep = (gain >= min_gain) & (symbols > 0)
        whole = n + symbols
        own = np.where(keep[at], here.n / whole[at], 0.0)
        hand = np.where(keep, (rest + symbols) / whole, 1.0)
        q = own + hand[at] * q_below
        states.append((below.key[keep], hand[keep]))
        edges.append((here.key[keep[at]], own[keep[at]], base[keep[at]]))
    return Tree(states, edges)


def gains(tree: Tree, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per document, the tree's log10 probability less the base's."""
    depth = len(tree.states)
    own, hand, base = np.zeros(len(flat)), np.ones(len(flat)), np.ones(len(flat))
    g = grams(flat, ends, depth + 1)
    for d in range(depth):
        before = np.zeros_like(flat)
        before[1:] = g[d][:-1]
        before[ends[:-1][ends[:-1] < len(flat)]] = 0
        state = Keys(tree.states[d][0]).find(before) if len(tree.states[d][0]) else np.full(len(flat), -1)
        i = np.flatnonzero((state >= 0) & (before != 0))
        if not len(i):
            continue
        w = tree.states[d][1][state[i]]
        own[i] *= w
        hand[i] *= w
        e = Keys(tree.edges[d][0]).find(g[d + 1][i])
        j, e = i[e >= 0], e[e >= 0]
        own[j] += tree.edges[d][1][e]
        base[j] = tree.edges[d][2][e]
    gain = np.log10(own / base + hand)
    # every document has an end token; summed per document, so equal texts score equally
    return np.add.reduceat(gain, ends[:-1]) if len(gain) else gain
