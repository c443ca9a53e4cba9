"""A linear-chain conditional random field over sparse binary features, in numpy.

Fitting runs on a bounded sample; scoring runs inside Spark tasks, on all sequences of a slice of
text at once. Sequences lie one after another in one array of positions; ``first`` holds where each
begins (and the end).
"""

from __future__ import annotations

import numpy as np

GATHER = 1 << 20  # features whose weights are gathered at once


class ChainCRF:
    """``weights`` (features + 1 for padding, labels), ``moves`` (labels, labels), ``start``."""

    def __init__(self, n_features: int, n_labels: int):
        self.weights = np.zeros((n_features + 1, n_labels), np.float32)
        self.moves = np.zeros((n_labels, n_labels), np.float32)
        self.start = np.zeros(n_labels, np.float32)

    def emissions(self, features: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Scores of every label at every position; features: (positions, slots) of numbers.

        Given ``at``, position i has the features ``at[i]`` to ``at[i + 1]`` of one long array (one at least).
        """
        if at is not None:
            out = np.empty((len(at) - 1, self.weights.shape[1]), np.float32)
            low = 0
            while low < len(out):  # a bounded number of features at once, or one position's
                high = max(low + 1, int(np.searchsorted(at, at[low] + GATHER, "right")) - 1)
                rows = self.weights[features[at[low] : at[high]]]
                out[low:high] = np.add.reduceat(rows, at[low:high] - at[low], axis=0)
                low = high
            return out
        out = np.zeros((len(features), self.weights.shape[1]), np.float32)
        for slot in range(features.shape[1]):
            out += self.weights[features[:, slot]]
        return out

    def fit(
        self,
        features: np.ndarray,
        labels: np.ndarray,
        first: np.ndarray,
        rounds: int = 100,
        rate: float = 0.1,
        decay: float = 1e-3,
        at: np.ndarray | None = None,
    ) -> ChainCRF:
        """Maximum likelihood with a Gaussian prior, by Adam on the full gradient.

        Sequences should be of like, moderate length: they are padded to the longest.
        ``features`` and ``at`` are as in :meth:`emissions`.
        """
        n_labels, length = len(self.start), np.diff(first)
        longest, rows = int(length.max()), len(length)
        place = np.full((rows, longest), -1)
        for r in range(rows):
            place[r, : length[r]] = np.arange(first[r], first[r + 1])
        valid = place >= 0
        truth = np.eye(n_labels, dtype=np.float32)[labels]
        seen_moves = np.zeros((n_labels, n_labels))
        both = valid[:, 1:]
        np.add.at(seen_moves, (labels[place[:, :-1][both]], labels[place[:, 1:][both]]), 1)
        seen_start = truth[first[:-1]].sum(0)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.weights, self.moves, self.start)]
        scale = 1.0 / len(labels)
        used, flat = np.unique(features, return_inverse=True)  # sums over used features only
        flat = flat.ravel()
        for step in range(1, rounds + 1):
            e = self.emissions(features, at)
            posterior, moves, start = _expected(e, self.moves, self.start, place, valid)
            slope = posterior - truth
            g_w = np.zeros_like(self.weights)
            slots = features.shape[1] if at is None else np.diff(at)
            for k in range(n_labels):
                g_w[used, k] = np.bincount(flat, np.repeat(slope[:, k], slots), len(used))
            g_w[-1] = 0
            grads = (
                g_w * scale + decay * scale * self.weights,
                (moves - seen_moves).astype(np.float32) * scale,
                (start - seen_start).astype(np.float32) * scale,
            )
            for p, g, s in zip((self.weights, self.moves, self.start), grads, state):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                p -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
        return self

    def viterbi(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest label sequence of every sequence (ties: the smaller label)."""
        length = np.diff(first)
        out = np.zeros(len(e), np.int64)
        if not len(e):
            return out
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        begin, n = first[:-1][order], length[order]
        back = np.zeros(e.shape, np.int8)
        best = self.start + e[begin]
        active = np.searchsorted(-n, -np.arange(n[0]), "left")  # sequences longer than t
        for t in range(1, n[0]):
            a = active[t]
            ways = best[:a, :, None] + self.moves
            at = begin[:a] + t
            back[at] = ways.argmax(1)
            best[:a] = ways.max(1) + e[at]
        label = best.argmax(1)
        for t in range(n[0] - 1, -1, -1):
            a = active[t]
            at = begin[:a] + t
            out[at] = label[:a]
            label[:a] = back[at, label[:a]]
        return out

    def marginals(self, e: np.ndarray, first: np.ndarray, block: int = 64) -> np.ndarray:
        """Forward-backward: the probability of every label at every position.

        Long sequences are cut into blocks whose transfer matrices are computed side by side; the
        states at the block borders follow from their products, so the result is exact and the
        number of numpy steps grows with the number of blocks of the longest sequence.
        """
        n_labels = len(self.start)
        if not len(e):
            return np.zeros((0, n_labels))
        moves, pi = np.exp(self.moves.astype(float)), np.exp(self.start.astype(float))
        e = np.exp((e - e.max(1, keepdims=True)).astype(float))
        length = np.diff(first)
        n_blocks = -(-length // block)
        own = np.repeat(np.arange(len(length)), n_blocks)
        base = np.concatenate(([0], np.cumsum(n_blocks)))
        nth = np.arange(base[-1]) - base[own]
        begin = first[own] + nth * block
        size = np.minimum(block, first[own + 1] - begin)
        order = np.argsort(-size, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        begin, size, opens = begin[order], size[order], nth[order] == 0
        active = np.searchsorted(-size, -np.arange(block), "left")
        steps = int(size[0])
        # transfer matrix of every block
        p = np.broadcast_to(np.eye(n_labels), (len(begin), n_labels, n_labels)).copy()
        for j in range(steps):
            a = active[j]
            q = p[:a].reshape(-1, n_labels) @ moves
            q = q.reshape(a, n_labels, n_labels)
            if j == 0:
                q[opens[:a]] = pi
            q *= e[begin[:a] + j][:, None, :]
            q /= q.max((1, 2), keepdims=True)
            p[:a] = q
        # states at the block borders
        into = np.ones((len(begin), n_labels))
        after = np.ones((len(begin), n_labels))
        by_count = np.argsort(-n_blocks, kind="stable")
        most = n_blocks[by_count]
        for k in range(1, int(most[0])):
            docs = by_count[: np.searchsorted(-most, -k, "left")]
            here, before = rank[base[docs] + k], rank[base[docs] + k - 1]
            v = np.einsum("dl,dlm->dm", into[before], p[before])
            into[here] = v / v.sum(1, keepdims=True)
        for k in range(int(most[0]) - 1, 0, -1):
            docs = by_count[: np.searchsorted(-most, -k, "left")]
            here, before = rank[base[docs] + k], rank[base[docs] + k - 1]
            v = np.einsum("dlm,dm->dl", p[here], after[here])
            after[before] = v / v.sum(1, keepdims=True)
        # within the blocks
        out = np.empty((len(e), n_labels))
        v = into
        for j in range(steps):
            a = active[j]
            w = v[:a] @ moves
            if j == 0:
                w[opens[:a]] = pi
            at = begin[:a] + j
            w *= e[at]
            w /= w.sum(1, keepdims=True)
            v[:a] = out[at] = w
        v = after
        for j in range(steps - 1, -1, -1):
            a = active[j]
            at = begin[:a] + j
            out[at] *= v[:a]
            w = (e[at] * v[:a]) @ moves.T
            v[:a] = w / w.sum(1, keepdims=True)
        return out / out.sum(1, keepdims=True)


def _expected(e, moves, start, place, valid):
    """Expected label, transition and start counts of padded sequences."""
    rows, longest = place.shape
    n_labels = len(start)
    m = np.exp(moves.astype(float))
    x = np.ones((rows, longest, n_labels))
    x[valid] = np.exp((e - e.max(1, keepdims=True)).astype(float))[place[valid]]
    forward = np.empty_like(x)
    v = np.exp(start.astype(float)) * x[:, 0]
    forward[:, 0] = v = v / v.sum(1, keepdims=True)
    for t in range(1, longest):
        w = (v @ m) * x[:, t]
        w /= w.sum(1, keepdims=True)
        v = np.where(valid[:, t, None], w, v)
        forward[:, t] = v
    both = np.zeros((n_labels, n_labels))
    posterior = np.empty((len(e), n_labels), np.float32)
    b = np.ones((rows, n_labels))
    for t in range(longest - 1, -1, -1):
        on = valid[:, t]
        p = forward[on, t] * b[on]
        posterior[place[on, t]] = p / p.sum(1, keepdims=True)
        if t:
            xb = x[on, t] * b[on]
            f = forward[on, t - 1]
            pair = f[:, :, None] * m * xb[:, None, :]
            both += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            w = xb @ m.T
            b[on] = w / w.sum(1, keepdims=True)
    return posterior, both, posterior[place[:, 0]].sum(0)
