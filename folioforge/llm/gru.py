"""A bidirectional gated recurrent network over bytes, in numpy.

Text is lower-cased and written in an eight-bit code page of the letters that
occur in the languages at hand; two bytes enter per step, each through its own
table, and every step labels both of its positions.  Training is plain
backpropagation through time with Adam.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# The letters of the code page; everything else is a blank, a digit or a sign.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäæçèéêëìíîïñòóôöœùúûüÿßабвгдежзийклмнопрстуфхцчшщъыьэюяёєіїґ"
BLANK, DIGIT, SIGN = 0, 1, 2
SYMBOLS = 128

_table = np.full(0x10000, SIGN, dtype=np.uint8)
for _p in range(0x10000):
    _c = chr(_p)
    if _c.isspace():
        _table[_p] = BLANK
    elif _c.isdigit():
        _table[_p] = DIGIT
for _i, _c in enumerate(LETTERS):
    _table[ord(_c)] = 3 + _i
    if len(_c.upper()) == 1:
        _table[ord(_c.upper())] = 3 + _i


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def encode(code_points: np.ndarray) -> np.ndarray:
    """Bytes of the code page, one per character."""
    return _table[np.minimum(code_points, 0xFFFF)]


class BiGRU:
    """``hidden`` units each way, ``classes`` labels per position."""

    def __init__(self, hidden: int, classes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        h = self.h = hidden
        self.classes = classes
        self.w = {}
        for way in "fb":
            self.w["a" + way] = rng.normal(0, 0.3, (SYMBOLS, 3 * h)).astype(np.float32)
            self.w["b" + way] = rng.normal(0, 0.3, (SYMBOLS, 3 * h)).astype(np.float32)
            self.w["u" + way] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
            self.w["c" + way] = np.zeros(3 * h, dtype=np.float32)
            self.w["v" + way] = rng.normal(0, 1 / np.sqrt(h), (h, classes)).astype(np.float32)
        self.w["o"] = np.zeros(classes, dtype=np.float32)

    def _forward(self, first: np.ndarray, second: np.ndarray, way: str):
        h, w = self.h, self.w
        t, b = first.shape
        g = w["a" + way][first] + w["b" + way][second] + w["c" + way]
        state = np.zeros((b, h), dtype=np.float32)
        keep = []
        states = np.empty((t, b, h), dtype=np.float32)
        for i in range(t) if way == "f" else range(t - 1, -1, -1):
            u = state @ w["u" + way]
            zr = 0.5 + 0.5 * np.tanh(0.5 * (g[i, :, : 2 * h] + u[:, : 2 * h]))
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(g[i, :, 2 * h :] + r * u[:, 2 * h :])
            keep.append((i, state, z, r, n, u[:, 2 * h :]))
            state = n + z * (state - n)
            states[i] = state
        return states, keep

    def step(self, first: np.ndarray, second: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of windows (time x batch) with one label each."""
        h, w = self.h, self.w
        t, b = first.shape
        sf, kf = self._forward(first, second, "f")
        sb, kb = self._forward(first, second, "b")
        logits = sf @ w["vf"] + sb @ w["vb"] + w["o"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        loss = -np.log(p[:, np.arange(b), labels] + 1e-9).mean()
        p[:, np.arange(b), labels] -= 1
        p /= t * b
        grad = {"o": p.sum((0, 1))}
        flat = p.reshape(t * b, -1)
        hot = [np.zeros((t * b, SYMBOLS), dtype=np.float32) for _ in "ab"]
        for one, ids in zip(hot, (first, second)):
            one[np.arange(t * b), ids.ravel()] = 1
        for way, states, keep in (("f", sf, kf), ("b", sb, kb)):
            grad["v" + way] = states.reshape(t * b, h).T @ flat
            up = p @ w["v" + way].T
            dg = np.empty((t, b, 3 * h), dtype=np.float32)
            du = np.zeros_like(w["u" + way])
            carry = np.zeros((b, h), dtype=np.float32)
            for i, before, z, r, n, un in reversed(keep):
                d = up[i] + carry
                dn = d * (1 - z) * (1 - n * n)
                dz = d * (before - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                dg[i, :, :h], dg[i, :, h : 2 * h], dg[i, :, 2 * h :] = dz, dr, dn
                dpre = np.concatenate((dz, dr, dn * r), axis=1)
                du += before.T @ dpre
                carry = d * z + dpre @ w["u" + way].T
            grad["u" + way] = du
            flat_g = dg.reshape(t * b, 3 * h)
            grad["c" + way] = flat_g.sum(0)
            grad["a" + way], grad["b" + way] = hot[0].T @ flat_g, hot[1].T @ flat_g
        return float(loss), grad

    def fit(self, windows: np.ndarray, labels: np.ndarray, rounds: int = 450, batch: int = 128, rate: float = 0.012, seed: int = 2) -> list[float]:
        """Train on windows of bytes (rows of even length)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for i in range(1, rounds + 1):
            pick = rng.integers(0, len(windows), batch)
            x = windows[pick].T
            if i % 3 == 0:  # ends of texts are padded with blanks
                x = x.copy()
                x[int(rng.integers(len(x) // 2, len(x))) :] = BLANK
            loss, grad = self.step(x[0::2], x[1::2], labels[pick])
            losses.append(loss)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 1.0 / (size + 1e-9))
            lr = rate * min(1.0, 2 * (1 - i / (rounds + 1)))
            for k, g in grad.items():
                g = g * scale
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.w[k] -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return losses

    def prepare(self) -> None:
        """Gate inputs of every pair of bytes; each gate apart, so that all work runs over whole arrays."""
        self.gates = {}
        for way in "fb":
            w, h = self.w, self.h
            table = (w["a" + way][:, None, :] + w["b" + way][None, :, :] + w["c" + way]).reshape(SYMBOLS * SYMBOLS, 3 * h)
            half = np.float32(0.5)  # a logistic gate is half of a tanh of half its input, plus a half
            self.gates[way] = [
                (np.ascontiguousarray(table[:, k * h : (k + 1) * h] * (half if k < 2 else 1)), np.ascontiguousarray(w["u" + way][:, k * h : (k + 1) * h] * (half if k < 2 else 1)))
                for k in range(3)
            ]

    def _states(self, pairs: np.ndarray, way: str, out: np.ndarray) -> None:
        t, b = pairs.shape
        (tz, uz), (tr, ur), (tn, un) = self.gates[way]
        state = np.zeros((b, self.h), dtype=np.float32)
        z, r, n, x = (np.empty((b, self.h), dtype=np.float32) for _ in range(4))
        half = np.float32(0.5)
        for i in range(t) if way == "f" else range(t - 1, -1, -1):
            at = pairs[i]
            np.take(tz, at, axis=0, out=z, mode="clip")
            np.matmul(state, uz, out=x)
            z += x
            np.tanh(z, out=z)
            z *= half
            z += half
            np.take(tr, at, axis=0, out=r, mode="clip")
            np.matmul(state, ur, out=x)
            r += x
            np.tanh(r, out=r)
            r *= half
            r += half
            np.matmul(state, un, out=x)
            x *= r
            np.take(tn, at, axis=0, out=n, mode="clip")
            n += x
            np.tanh(n, out=n)
            state -= n
            state *= z
            state += n
            out[i] = state

    def batches(self, pieces: list[np.ndarray], batch: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of like length, and the posterior of every label at each of their steps: (classes, steps, pieces), 0 beyond a piece's end."""
        if not hasattr(self, "gates"):
            self.prepare()
        sizes = np.array([(len(p) + 1) // 2 for p in pieces])
        order = np.argsort(sizes, kind="stable")
        room = np.empty(0, dtype=np.float32)
        low = 0
        while low < len(order):
            high = min(len(order), low + batch)
            while high > low + 1 and int(sizes[order[high - 1]]) * (high - low) > 400_000:
                high = low + (high - low + 1) // 2
            part = order[low:high]
            low = high
            t, b = int(sizes[part[-1]]), len(part)
            if t == 0:
                continue
            raw = np.zeros((b, 2 * t), dtype=np.uint8)
            for row, k in enumerate(part):
                raw[row, : len(pieces[k])] = pieces[k]
            pairs = np.ascontiguousarray((raw[:, 0::2].astype(np.intp) * SYMBOLS + raw[:, 1::2]).T)
            if room.size < t * b * self.h:
                room = np.empty(t * b * self.h, dtype=np.float32)
            states = room[: t * b * self.h].reshape(t, b, self.h)
            self._states(pairs, "f", states)
            logits = self.w["vf"].T @ states.reshape(t * b, self.h).T
            self._states(pairs, "b", states)
            logits += self.w["vb"].T @ states.reshape(t * b, self.h).T
            logits += self.w["o"][:, None]
            logits -= logits.max(0)
            np.exp(logits, out=logits)
            logits *= (np.arange(t)[:, None] < sizes[part][None, :]).reshape(t * b) / logits.sum(0)
            yield part, logits.reshape(self.classes, t, b)

    def label(self, pieces: list[np.ndarray], batch: int = 512) -> np.ndarray:
        """Mean posterior of each label over the positions of every piece of bytes."""
        result = np.zeros((len(pieces), self.classes), dtype=np.float32)
        for part, posterior in self.batches(pieces, batch):
            sizes = np.array([(len(pieces[k]) + 1) // 2 for k in part])
            result[part] = (posterior.sum(1) / np.maximum(sizes, 1)).T
        return result
