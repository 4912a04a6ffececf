"""A character tagger: bidirectional LSTM with CRF transitions, in numpy.

Trained from windows of text with labelled spans. Tags are O and, per kind, B and I; the CRF's
transitions never lead into an I from another kind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
#: Characters of a window, and its step where windows overlap.
WINDOW, STRIDE = 96, 48
EMBED, HIDDEN = 12, 16
STEPS, BATCH, RATE = 400, 32, 0.02
NEVER = -1e4

#: Character classes: 0 pads, then single marks, digits, and sorts of letters.
MARKS = "@.+-_()[] \n:=,\"'/%#"
VOWELS = "aeiou"
CLASSES = 2 + len(MARKS) + 10 + 26 + 3


def class_table() -> np.ndarray:
    """The class of every code point below 128, and of all others last."""
    table = np.full(129, 1, np.int64)
    for i, c in enumerate(MARKS):
        table[ord(c)] = 2 + i
    for i in range(10):
        table[48 + i] = 2 + len(MARKS) + i
    for i in range(26):
        table[97 + i] = 2 + len(MARKS) + 10 + i
        table[65 + i] = CLASSES - 3
    table[128] = CLASSES - 2
    return table


TABLE = class_table()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return TABLE[np.minimum(points, 128)]


def allowed() -> np.ndarray:
    """0 where a tag may follow another, NEVER elsewhere; the last row is for the first character."""
    may = np.zeros((TAGS + 1, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        may[:, inside] = NEVER
        may[[inside - 1, inside], inside] = 0
    return may


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass
class Tagger:
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"embed": rng.normal(0, 0.3, (CLASSES, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS))}
        p |= {"out_b": np.zeros(TAGS), "next": np.zeros((TAGS + 1, TAGS))}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (EMBED, 4 * HIDDEN))
            p[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            p[f"g{d}"] = np.zeros(4 * HIDDEN)
            p[f"g{d}"][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def transitions(self) -> np.ndarray:
        return self.p["next"] + allowed()

    def one_way(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction over x (time, rows, EMBED)."""
        n = x.shape[1]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.empty((len(x), n, HIDDEN), np.float32)
        part = x @ self.p[f"x{d}"] + self.p[f"g{d}"]
        for t in range(len(x)):
            gates = part[t] + h @ self.p[f"h{d}"]
            s = sigmoid(gates[:, : 3 * HIDDEN])
            new = np.tanh(gates[:, 3 * HIDDEN :])
            before, c = c, s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * new
            squashed = np.tanh(c)
            if keep is not None:
                keep.append((h, before, s, new, squashed))
            h = s[:, 2 * HIDDEN :] * squashed
            out[t] = h
        return out

    def emissions(self, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Tag scores (time, rows, TAGS) of windows given as classes (rows, time)."""
        x = self.p["embed"][rows.T]
        kept = {"f": None, "b": None} if keep is None else {"f": [], "b": []}
        both = np.concatenate([self.one_way(x, "f", kept["f"]), self.one_way(x[::-1], "b", kept["b"])[::-1]], axis=2)
        if keep is not None:
            keep |= {"x": x, "both": both, **kept}
        return both @ self.p["out"] + self.p["out_b"]

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """The best tags (rows, time) of each window under the CRF."""
        scores, move = self.emissions(rows), self.transitions()
        best = move[-1] + scores[0]
        back = np.empty(scores.shape, np.int8)
        for t in range(1, len(scores)):
            through = best[:, :, None] + move[:-1]
            back[t] = through.argmax(axis=1)
            best = through.max(axis=1) + scores[t]
        tags = np.empty(rows.shape, np.int8)
        tags[:, -1] = best.argmax(axis=1)
        at = np.arange(len(rows))
        for t in range(len(scores) - 1, 0, -1):
            tags[:, t - 1] = back[t][at, tags[:, t]]
        return tags

    def gradients(self, rows: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradient."""
        keep: dict = {}
        e = self.emissions(rows, keep).astype(np.float64)
        move, steps, n = self.transitions(), len(e), rows.shape[0]
        ahead = np.empty_like(e)
        ahead[0] = move[-1] + e[0]
        for t in range(1, steps):
            ahead[t] = logsum(ahead[t - 1][:, :, None] + move[:-1], 1) + e[t]
        total = logsum(ahead[-1], 1)
        behind = np.zeros_like(e)
        pairs = np.zeros((TAGS, TAGS))
        for t in range(steps - 1, 0, -1):
            after = e[t] + behind[t]
            joint = ahead[t - 1][:, :, None] + move[:-1] + after[:, None, :]
            pairs += np.exp(joint - total[:, None, None]).sum(axis=0)
            behind[t - 1] = logsum(move[:-1] + after[:, None, :], 2)
        delta = np.exp(ahead + behind - total[:, None])
        first = delta[0].sum(axis=0)
        at = np.arange(n)
        gold = move[-1][tags[:, 0]] + e[0][at, tags[:, 0]]
        for t in range(1, steps):
            gold = gold + move[tags[:, t - 1], tags[:, t]] + e[t][at, tags[:, t]]
            np.subtract.at(pairs, (tags[:, t - 1], tags[:, t]), 1)
        for t in range(steps):
            delta[t][at, tags[:, t]] -= 1
        np.subtract.at(first, tags[:, 0], 1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["next"][:-1], g["next"][-1] = pairs / n, first / n
        delta = (delta / n).astype(np.float32)
        both = keep["both"]
        g["out"] = np.einsum("tnh,tnk->hk", both, delta)
        g["out_b"] = delta.sum(axis=(0, 1))
        wide = delta @ self.p["out"].T
        dx = self.through_time(keep["x"], wide[:, :, :HIDDEN], "f", keep["f"], g)
        dx = dx + self.through_time(keep["x"][::-1], wide[::-1, :, HIDDEN:], "b", keep["b"], g)[::-1]
        np.add.at(g["embed"], rows.T, dx)
        return float((total - gold).mean()), g

    def through_time(self, x, dout, d, kept, g) -> np.ndarray:
        dh = np.zeros(dout.shape[1:], np.float32)
        dc = np.zeros_like(dh)
        dgates = np.empty((len(x), x.shape[1], 4 * HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, before, s, new, squashed = kept[t]
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - squashed**2)
            parts = [dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)]
            dgates[t] = np.concatenate(parts, axis=1)
            g[f"h{d}"] += h.T @ dgates[t]
            dh = dgates[t] @ self.p[f"h{d}"].T
            dc = dc * f
        g[f"x{d}"] = np.einsum("tne,tng->eg", x, dgates)
        g[f"g{d}"] = dgates.sum(axis=(0, 1))
        return dgates @ self.p[f"x{d}"].T


def train(windows: list[tuple[str, list[tuple[str, int, int]]]], seed: int = 11, steps: int = STEPS) -> Tagger:
    """Learn from windows of at most WINDOW characters with (kind, start, end) spans, by Adam."""
    rows = np.zeros((len(windows), WINDOW), np.int64)
    tags = np.zeros((len(windows), WINDOW), np.int64)
    for r, (text, spans) in enumerate(windows):
        rows[r, : len(text)] = classes(text)
        for kind, start, end in spans:
            b = 1 + 2 * KINDS.index(kind)
            tags[r, start:end] = b + 1
            tags[r, start] = b
    model, rng = Tagger.fresh(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}
    square = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1 if windows else 0):
        batch = rng.integers(0, len(windows), BATCH)
        _, g = model.gradients(rows[batch], tags[batch])
        rate = RATE * (1 - step / (steps + 1))
        for k, v in model.p.items():
            d = np.clip(g[k], -1, 1)
            mean[k] = 0.9 * mean[k] + 0.1 * d
            square[k] = 0.99 * square[k] + 0.01 * d * d
            v -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
    return model


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the runs in one row of tags."""
    out: list[tuple[int, int, int]] = []
    begun = None
    for t, tag in enumerate([*tags.tolist(), 0]):
        if begun is not None and (tag == 0 or tag % 2 == 1):
            out.append((begun[0], begun[1], t))
            begun = None
        if tag % 2 == 1:
            begun = ((tag - 1) // 2, t)
    return out
