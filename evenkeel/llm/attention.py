"""A small causal self-attention model over subword ranks, in numpy, and its training.

The next subword is drawn from a mixture of bigram tables ("experts", one per kind of text); the
attention decides how much each expert counts. At every position the query of the current subword
meets the keys of those before it and its own (causal mask, plus a bias per distance); the values
that attention brings together are log weights of the experts. All of a batch's windows are worked
on at once, and no softmax over the vocabulary is needed, as the tables are normalised.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

WINDOW, OVERLAP = 32, 8  # subwords of a window, and how many of them only give context
WIDTH = 8  # of queries and keys
RATE, BATCH = 0.05, 64


def sums_by(x: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """[n, w]: the rows of values [.., w] summed by their places x [..]."""
    flat, columns = x.ravel(), values.reshape(x.size, -1).T.astype(float, order="C")
    return np.stack([np.bincount(flat, c, n) for c in columns], axis=1)


def over_experts(function: np.ufunc, x: np.ndarray) -> np.ndarray:
    """``function`` over the last axis, kept with length one. The axis is short, so this goes through
    it in numpy's own order, but over all places at once."""
    out = function(x[..., :1], x[..., 1:2]) if x.shape[-1] > 1 else x[..., :1].copy()
    for k in range(2, x.shape[-1]):
        function(out, x[..., k : k + 1], out=out)
    return out


@dataclass
class Model:
    """Tables by subword rank; ``experts[previous, next, k]`` are probabilities."""

    queries: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    near: np.ndarray  # bias by distance back
    bias: np.ndarray
    experts: np.ndarray

    @property
    def trained(self) -> list[np.ndarray]:
        return [self.queries, self.keys, self.values, self.near, self.bias]

    def with_trained(self, parts: list[np.ndarray]) -> Model:
        return Model(*parts, self.experts)

    @classmethod
    def start(cls, unigrams: np.ndarray, experts: np.ndarray, seed: int = 1) -> Model:
        """From each expert's probabilities of single subwords: [k, rank]."""
        rng = np.random.default_rng(seed)
        ranks, k = experts.shape[1], experts.shape[2]
        log = np.log(unigrams.T)
        values = np.clip(log - log.mean(axis=1, keepdims=True), -3, 3) * (WINDOW / 4)
        small = lambda *shape: rng.normal(0, 0.05, shape).astype(np.float32)
        return cls(small(ranks, WIDTH), small(ranks, WIDTH), values.astype(np.float32), np.zeros(WINDOW, np.float32), np.zeros(k, np.float32), experts)

    def causal(self, n: int) -> np.ndarray:
        """The mask of a window of ``n``, with the bias by distance."""
        back = np.arange(n)[:, None] - np.arange(n)[None, :]
        return np.where(back >= 0, self.near[np.maximum(back, 0)], np.float32(-1e9)).astype(np.float32)

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(attention [b, t, j], weights of the experts [b, t, k]) for windows x [b, t]."""
        mask = self.causal(x.shape[1])
        return self._attended(self.queries[x], self.keys[x], self.values[x], mask)

    def _attended(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.matmul(q, k.transpose(0, 2, 1))
        s += mask
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        z = np.matmul(s, v)
        z += self.bias
        z -= over_experts(np.maximum, z)
        np.exp(z, out=z)
        z /= over_experts(np.add, z)
        return s, z

    def gradients(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Gradients of the trained parts and the summed log likelihood; ``scored`` masks padding."""
        q, k, v = self.queries[x], self.keys[x], self.values[x]
        a, g = self._attended(q, k, v, self.causal(x.shape[1]))
        p = g * self.experts.reshape(-1, self.experts.shape[2])[x * self.experts.shape[1] + y]
        total = over_experts(np.add, p)
        p /= np.maximum(total, 1e-30)
        dz = g
        dz -= p
        dz *= scored[:, :, None]
        ds = np.matmul(dz, v.transpose(0, 2, 1))
        ds -= (a * ds).sum(axis=2, keepdims=True)
        ds *= a
        near = np.zeros_like(self.near)
        by_distance = ds.sum(axis=0)
        for d in range(x.shape[1]):
            near[d] = by_distance.diagonal(-d).sum()
        out = [
            sums_by(x, np.matmul(ds, k), len(self.queries)),
            sums_by(x, np.matmul(ds.transpose(0, 2, 1), q), len(self.keys)),
            sums_by(x, np.matmul(a.transpose(0, 2, 1), dz), len(self.values)),
            near, dz.sum(axis=(0, 1)),
        ]
        return out, float((np.log(np.maximum(total[:, :, 0], 1e-30)) * scored).sum())

    def train(self, sequences: np.ndarray, rate: float = RATE) -> Model:
        """One pass of Adagrad over sequences [n, WINDOW + 1] of ranks; -1 is padding."""
        return self.train_on([sequences], rate)

    def train_on(self, chunks: Iterable[np.ndarray], rate: float = RATE) -> Model:
        """As ``train``, over sequences that come in several arrays, one after the other."""
        model = self.with_trained([t.copy() for t in self.trained])
        seen = [np.full_like(t, 1e-2) for t in model.trained]
        for part in (chunk[at : at + BATCH] for chunk in chunks for at in range(0, len(chunk), BATCH)):
            x, y = np.maximum(part[:, :-1], 0).astype(np.intp), np.maximum(part[:, 1:], 0).astype(np.intp)
            gradients, _ = model.gradients(x, y, (part[:, 1:] >= 0).astype(np.float32))
            for value, total, g in zip(model.trained, seen, gradients):
                g /= BATCH
                total += g * g
                value -= rate * g / np.sqrt(total)
        return model

    def ready(self, begins_word: np.ndarray) -> Model:
        """Tables that ``probabilities`` needs besides; ``begins_word``: by rank."""
        self.stops = np.einsum("pnk,n->pk", self.experts, begins_word.astype(np.float32))
        # A column of ones gives the sum of the attention along with its values.
        self.valued = np.concatenate([self.values, np.ones((len(self.values), 1), np.float32)], axis=1)
        longest = lambda t: float(np.sqrt((t.astype(float) ** 2).sum(axis=1).max()))
        self.small = longest(self.queries) * longest(self.keys) + float(np.abs(self.near).max()) < 60
        back = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        self.mask = np.where(back >= 0, self.near[np.maximum(back, 0)], np.float32(-1e9)).astype(np.float32)
        return self

    def weigh(self, x: np.ndarray) -> np.ndarray:
        """As ``attend``, but the weights of the experts alone, and only in proportion."""
        s = np.matmul(self.queries[x], self.keys[x].transpose(0, 2, 1))
        s += self.mask
        if not self.small:  # else no exponential can overflow
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        z = np.matmul(s, self.valued[x])
        z = z[:, :, :-1] / z[:, :, -1:]
        z += self.bias
        z -= over_experts(np.maximum, z)
        return np.exp(z, out=z)

    def probabilities(self, ranks: np.ndarray, starts: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sequences laid end to end (``starts``: where each begins; its first subword is given,
        not scored): (probability of each subword given those before it, chance that a word ends
        before it, where ``ending`` is true). Values at ``starts`` mean nothing.

        Windows overlap by OVERLAP; each subword is scored once, by the first window that holds it.
        """
        ends = np.r_[starts[1:], len(ranks)]
        step = WINDOW - OVERLAP
        counts = np.maximum(1, -(-np.maximum(ends - starts - 1 - OVERLAP, 0) // step))
        begin = np.repeat(starts - np.cumsum(counts) * step + counts * step, counts) + np.arange(counts.sum()) * step
        end = np.repeat(ends, counts)
        first = np.repeat(starts, counts) == begin
        p, stop = np.ones(len(ranks), np.float32), np.ones(len(ranks), np.float32)
        columns, experts = np.arange(WINDOW), self.experts.reshape(-1, self.experts.shape[2])
        late = columns >= OVERLAP
        for at in range(0, len(begin), 128):
            b, e, f = begin[at : at + 128], end[at : at + 128], first[at : at + 128]
            place = b[:, None] + columns
            x = ranks[np.minimum(place, e[:, None] - 1)]
            z = self.weigh(x)
            scored = (place + 1 < e[:, None]) & (late | f[:, None])
            where, w, previous = place[scored] + 1, z[scored], x[scored]
            total = over_experts(np.add, w)[:, 0]
            p[where] = np.einsum("nk,nk->n", w, experts[previous * self.experts.shape[1] + ranks[where]]) / total
            word = ending[where]
            stop[where[word]] = np.einsum("nk,nk->n", w[word], self.stops[previous[word]]) / total[word]
        return p, stop


def bigram_experts(counts: np.ndarray, discount: float = 0.5, pull: float = 20.0) -> np.ndarray:
    """[previous, next, k] from counts [k, previous, next]: each expert is drawn to all of them
    together where it has seen little, and those to the single subwords by absolute discounting."""
    everything = counts.sum(axis=0)
    single = everything.sum(axis=0) + 1.0
    single /= single.sum()
    rows = everything.sum(axis=1, keepdims=True)
    kinds = (everything > 0).sum(axis=1, keepdims=True)
    whole = np.where(rows > 0, (np.maximum(everything - discount, 0) + discount * kinds * single) / np.maximum(rows, 1), single)
    return np.stack([(c + pull * whole) / (c.sum(axis=1, keepdims=True) + pull) for c in counts], axis=2).astype(np.float32)


def kinds_of_text(histograms: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """[k, rank]: a mixture of unigrams fitted to rows of subword counts; the first centres are
    rows that lie far apart."""
    n, ranks = histograms.shape
    smooth = histograms.sum(axis=0) + 1.0
    smooth /= smooth.sum()
    if not n:
        return np.tile(smooth, (k, 1))
    shares = (histograms + smooth) / (histograms.sum(axis=1, keepdims=True) + 1)
    roots = np.sqrt(shares)
    chosen = [int(np.argmax(histograms.sum(axis=1)))]
    nearest = np.full(n, np.inf)
    while len(chosen) < k:
        nearest = np.minimum(nearest, ((roots - roots[chosen[-1]]) ** 2).sum(axis=1))
        # Far from the others, but not a lonely row: the upper tenth rather than the maximum.
        chosen.append(int(np.argsort(nearest, kind="stable")[int(0.9 * (n - 1))]))
    unigrams = shares[chosen]
    weights = np.full(k, 1 / k)
    for _ in range(rounds):
        log = histograms @ np.log(unigrams).T + np.log(weights)
        log -= log.max(axis=1, keepdims=True)
        share = np.exp(log)
        share /= share.sum(axis=1, keepdims=True)
        weights = (share.sum(axis=0) + 1) / (n + k)
        unigrams = share.T @ histograms + 5 * smooth
        unigrams /= unigrams.sum(axis=1, keepdims=True)
    return unigrams
