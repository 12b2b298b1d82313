"""A linear-chain conditional random field in numpy: fitted by Adagrad, decoded by Viterbi in batches."""

from __future__ import annotations

import numpy as np


class Field:
    """Weights of hashed binary features by label, and of label transitions."""

    def __init__(self, labels: list[str], buckets: int):
        self.labels, self.buckets = labels, buckets
        self.emit = np.zeros((buckets, len(labels)), np.float32)
        self.move = np.zeros((len(labels), len(labels)), np.float32)
        # an inside label can only follow one of its own type; such moves, and such beginnings, are forbidden
        self.allowed = np.array([[b[0] != "I" or a[1:] == b[1:] and a != "O" for b in labels] for a in labels])
        self.start = np.array([label[0] != "I" for label in labels])

    def copy(self) -> Field:
        other = Field(self.labels, self.buckets)
        other.emit[:], other.move[:] = self.emit, self.move
        return other

    def _moves(self) -> np.ndarray:
        return np.where(self.allowed, self.move, -1e4).astype(np.float32)

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels of sequences laid end to end, by Viterbi over all sequences at once, the longest first.

        Sequences in which no other label can pay off against O, whatever the moves, are O throughout.
        """
        out = np.zeros(len(scores), np.int8)
        if not len(lengths):
            return out
        move = self._moves()
        gain = max(0.0, float((move - move[0, 0]).max()))
        margin = scores[:, 1:].max(1) - scores[:, 0]
        starts = np.cumsum(lengths) - lengths
        open_ = np.maximum.reduceat(margin, starts) + 2 * gain >= 0
        lengths, starts = lengths[open_], starts[open_]
        order = np.argsort(-lengths, kind="stable")
        begin, size = starts[order], lengths[order]
        if not len(size):
            return out
        back = []
        k = len(self.labels)
        free = np.flatnonzero(np.array([x[0] != "I" for x in self.labels]))  # reached from any label
        bound = {i: np.flatnonzero(self.allowed[:, i]) for i in range(k) if i not in set(free.tolist())}
        best = scores[begin] + np.where(self.start, 0, -1e4).astype(np.float32)
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, side="left"))
            old = best[:live]
            if live < 256:  # one dense step costs less than one by label
                paths = old[:, :, None] + move
                by = paths.argmax(1).astype(np.int8)
                back.append(by)
                best[:live] = paths.max(1) + scores[begin[:live] + t]
                continue
            new, by = np.empty((live, k), np.float32), np.empty((live, k), np.int8)
            for i in free:
                path = old + move[:, i]
                by[:, i] = path.argmax(1)
                new[:, i] = path[np.arange(live), by[:, i]]
            for i, sources in bound.items():
                path = old[:, sources] + move[sources, i]
                pick = path.argmax(1)
                by[:, i] = sources[pick]
                new[:, i] = path[np.arange(live), pick]
            back.append(by)
            best[:live] = new + scores[begin[:live] + t]
        label = best.argmax(1)
        out[begin + size - 1] = label
        for t in range(int(size[0]) - 1, 0, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            label[:live] = back[t - 1][np.arange(live), label[:live]]
            out[begin[:live] + t - 1] = label[:live]
        return out

    def fit(self, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, epochs: int = 5, rate: float = 0.25, l2: float = 1e-6, batch: int = 64, cells: int = 6000, seed: int = 3) -> Field:
        """Maximises the likelihood of labelled sequences laid end to end, in batches of at most ``batch`` sequences and, filled up to the longest, ``cells`` tokens."""
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        g_emit, g_move = np.full(self.emit.shape, 1e-6, np.float32), np.full(self.move.shape, 1e-6, np.float32)
        random, k = np.random.default_rng(seed), len(self.labels)
        for _ in range(epochs):
            order = np.argsort(lengths + random.random(len(lengths)) * 6)
            groups, i = [], 0
            while i < len(order):
                j = i + 1
                while j < len(order) and j - i < batch and (j - i + 1) * lengths[order[i : j + 1]].max() <= cells:
                    j += 1
                groups.append(order[i:j])
                i = j
            random.shuffle(groups)
            for group in groups:
                n, top = lengths[group], int(lengths[group].max())
                at = begin[group][:, None] + np.minimum(np.arange(top), n[:, None] - 1)
                inside = np.arange(top) < n[:, None]
                f, y = features[at], labels[at]
                score = self.emit[f].sum(2).astype(np.float64)
                score[:, 0] += np.where(self.start, 0, -1e4)
                move = self._moves().astype(np.float64)
                alpha, beta = np.zeros_like(score), np.zeros_like(score)
                alpha[:, 0] = score[:, 0]
                for t in range(1, top):
                    new = _lse(alpha[:, t - 1, :, None] + move, 1) + score[:, t]
                    alpha[:, t] = np.where(inside[:, t, None], new, alpha[:, t - 1])
                for t in range(top - 2, -1, -1):
                    new = _lse(move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                    beta[:, t] = np.where(inside[:, t + 1, None], new, 0)
                total = _lse(alpha[:, -1], 1)
                p = np.exp(alpha + beta - total[:, None, None]) * inside[..., None]
                p[np.arange(len(group))[:, None], np.arange(top), y] -= inside
                pair = np.zeros((k, k))
                for t in range(1, top):
                    both = alpha[:, t - 1, :, None] + move + (score[:, t] + beta[:, t])[:, None, :] - total[:, None, None]
                    pair += (np.exp(np.minimum(both, 0)) * inside[:, t, None, None]).sum(0)
                    np.add.at(pair, (y[inside[:, t], t - 1], y[inside[:, t], t]), -1)
                flat, grad = f[inside], p[inside].astype(np.float32) / len(group)
                used, where = np.unique(flat, return_inverse=True)
                step = np.zeros((len(used), k), np.float32)
                np.add.at(step, where.reshape(flat.shape).ravel(), np.repeat(grad, flat.shape[1], 0))
                step += l2 * self.emit[used]
                g_emit[used] += step * step
                self.emit[used] -= rate * step / np.sqrt(g_emit[used])
                pair = (pair / len(group)).astype(np.float32)
                g_move += pair * pair
                self.move -= rate * pair / np.sqrt(g_move)
        return self


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)
