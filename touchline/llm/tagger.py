"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by Adam, decoding in windows."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)              # O, then begin and inside of each kind
WINDOW, STRIDE = 96, 48
HIDDEN = 16
PRINTABLE = "".join(map(chr, range(32, 127)))
SYMBOLS = len(PRINTABLE) + 4           # padding, other letter, other white space, anything else
_FORBIDDEN = np.zeros((TAGS, TAGS), np.float32)
for _k in range(len(KINDS)):
    _FORBIDDEN[:, 2 + 2 * _k] = -1e4   # inside only after begin or inside of its kind
    _FORBIDDEN[1 + 2 * _k, 2 + 2 * _k] = _FORBIDDEN[2 + 2 * _k, 2 + 2 * _k] = 0
_FIRST = np.zeros(TAGS, np.float32)
_FIRST[2::2] = -1e4


def symbol_table() -> np.ndarray:
    out = np.full(0x3000, 3, np.int16)
    for i in range(0x3000):
        c = chr(i)
        out[i] = 1 if c.isalpha() else 2 if c.isspace() else 3
    for i, c in enumerate(PRINTABLE):
        out[ord(c)] = i + 4
    return out


_TABLE = symbol_table()


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(codes, 0x2FFF)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """w: input tables (2, symbols, 4 hidden), u: recurrent (2, hidden, 4 hidden), o: output, b: its bias, t: transitions."""
    weights: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 7, hidden: int = HIDDEN) -> Tagger:
        rng = np.random.default_rng(seed)
        w = rng.normal(0, 0.3, (2, SYMBOLS, 4 * hidden))
        w[:, :, hidden:2 * hidden] += 1  # remember at first
        return Tagger({k: v.astype(np.float32) for k, v in {
            "w": w, "u": rng.normal(0, 0.25, (2, hidden, 4 * hidden)), "o": rng.normal(0, 0.2, (2 * hidden, TAGS)),
            "b": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}.items()})

    def states(self, x: np.ndarray, keep: bool = False):
        """Hidden states (windows, positions, 2 hidden) of both directions; with ``keep``, what the gradient needs."""
        w, u = self.weights["w"], self.weights["u"]
        n, length = x.shape
        hidden = u.shape[1]
        out = np.empty((n, length, 2 * hidden), np.float32)
        kept = []
        for d in (0, 1):
            h = np.zeros((n, hidden), np.float32)
            c = np.zeros((n, hidden), np.float32)
            trace = []
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                a = w[d][x[:, t]] + h @ u[d]
                gates = _sigmoid(a[:, :3 * hidden])
                i, f, o = gates[:, :hidden], gates[:, hidden:2 * hidden], gates[:, 2 * hidden:]
                g = np.tanh(a[:, 3 * hidden:])
                before, c = c, f * c + i * g
                th = np.tanh(c)
                if keep:
                    trace.append((t, h, before, i, f, o, g, th))
                h = o * th
                out[:, t, d * hidden:(d + 1) * hidden] = h
            kept.append(trace)
        return (out, kept) if keep else out

    def emissions(self, states: np.ndarray) -> np.ndarray:
        return states @ self.weights["o"] + self.weights["b"]

    def _chain(self, e: np.ndarray):
        """Forward and backward log sums of the CRF, and its log partition."""
        trans, first = self.weights["t"] + _FORBIDDEN, self.weights["s"] + _FIRST
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + first
        for t in range(1, e.shape[1]):
            alpha[:, t] = _logsum(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
        for t in range(e.shape[1] - 2, -1, -1):
            beta[:, t] = _logsum(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        return alpha, beta, _logsum(alpha[:, -1], 1)

    def marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Emissions and, from the CRF, every position's tag probabilities."""
        e = self.emissions(self.states(x))
        alpha, beta, z = self._chain(e)
        return e, np.exp(alpha + beta - z[:, None, None])

    def best_path(self, e: np.ndarray) -> np.ndarray:
        trans = self.weights["t"] + _FORBIDDEN
        score = e[:, 0] + self.weights["s"] + _FIRST
        back = np.zeros(e.shape, np.int8)
        for t in range(1, e.shape[1]):
            all_ = score[:, :, None] + trans
            back[:, t] = all_.argmax(axis=1)
            score = all_.max(axis=1) + e[:, t]
        path = np.empty(e.shape[:2], np.int8)
        path[:, -1] = score.argmax(axis=1)
        rows = np.arange(len(e))
        for t in range(e.shape[1] - 1, 0, -1):
            path[:, t - 1] = back[rows, t, path[:, t]]
        return path

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags y and its gradient."""
        n, length = x.shape
        states, kept = self.states(x, keep=True)
        e = self.emissions(states)
        alpha, beta, z = self._chain(e)
        trans = self.weights["t"] + _FORBIDDEN
        rows = np.arange(n)[:, None]
        truth = e[rows, np.arange(length), y].sum(axis=1) + (self.weights["s"])[y[:, 0]] + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
        grad = {k: np.zeros_like(v) for k, v in self.weights.items()}
        de = np.exp(alpha + beta - z[:, None, None])
        grad["s"] += de[:, 0].sum(axis=0)
        np.add.at(grad["s"], y[:, 0], -1)
        de[rows, np.arange(length), y] -= 1
        pair = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        np.add.at(pair, (y[:, :-1], y[:, 1:]), -1)
        grad["t"] += pair
        flat = de.reshape(-1, TAGS)
        grad["o"] += states.reshape(len(flat), -1).T @ flat
        grad["b"] += flat.sum(axis=0)
        ds = de @ self.weights["o"].T
        hidden = self.weights["u"].shape[1]
        for d in (0, 1):
            u = self.weights["u"][d]
            dh_next = np.zeros((n, hidden), np.float32)
            dc_next = np.zeros((n, hidden), np.float32)
            for t, h, before, i, f, o, g, th in reversed(kept[d]):
                dh = ds[:, t, d * hidden:(d + 1) * hidden] + dh_next
                dc = dc_next + dh * o * (1 - th * th)
                da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                np.add.at(grad["w"][d], x[:, t], da)
                grad["u"][d] += h.T @ da
                dh_next, dc_next = da @ u.T, dc * f
        return float((z - truth).mean()), {k: v / n for k, v in grad.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 32, rate: float = 0.05, seed: int = 7) -> float:
        """Adam on random batches; returns the mean loss of the last tenth."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            loss, grad = self.loss(x[pick], y[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            pace = rate * (1 - step / (steps + 1)) * min(1.0, 5 / max(norm, 1e-9))
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.weights[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return float(np.mean(losses[-max(1, steps // 10):]))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def windows_of(length: int) -> list[int]:
    """Starts of the overlapping windows that cover a text."""
    return list(range(0, max(1, length - WINDOW + STRIDE), STRIDE)) if length else []


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of a text from (start, end, kind number); a window that begins inside a span sees it begin there."""
    out = np.zeros(length, np.int64)
    for start, end, kind in spans:
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


def window_rows(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Training windows of one text: symbols and tags."""
    codes, tags = symbols(text), tags_of(len(text), spans)
    xs, ys = [], []
    for a in windows_of(len(text)):
        x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
        part = codes[a:a + WINDOW]
        x[:len(part)], y[:len(part)] = part, tags[a:a + WINDOW]
        if y[0] and y[0] % 2 == 0:
            y[0] -= 1
        xs.append(x)
        ys.append(y)
    return np.array(xs).reshape(-1, WINDOW), np.array(ys).reshape(-1, WINDOW)
