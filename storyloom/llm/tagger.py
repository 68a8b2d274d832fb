"""A character tagger in numpy: bidirectional LSTM, linear emissions, CRF transitions."""

from __future__ import annotations

import numpy as np

# Characters beyond ASCII share one symbol; another stands for what lies outside a text.
ALIEN, OUTSIDE = 128, 129
SYMBOLS = 130
IMPOSSIBLE = -1e4
# Gradients are clipped to this norm.
CLIP = 5.0


def begin_of(kind: int) -> int:
    return 1 + 2 * kind


def legal_moves(kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Which labels may follow which, and which may come first; 0 is outside, then begin and inside per kind."""
    labels = 1 + 2 * kinds
    move, first = np.zeros((labels, labels), bool), np.zeros(labels, bool)
    move[:, 0] = first[0] = True
    for kind in range(kinds):
        b = begin_of(kind)
        move[:, b] = first[b] = True
        move[b, b + 1] = move[b + 1, b + 1] = True
    return move, first


class Tagger:
    """Parameters and what is done with them.

    Arrays hold both directions: row 0 reads a window from the left, row 1 from the right.
    """

    def __init__(self, kinds: int, hidden: int = 16, seed: int = 7, dtype=np.float32):
        rng = np.random.default_rng(seed)
        labels = 1 + 2 * kinds

        def drawn(*shape: int, scale: float) -> np.ndarray:
            return (rng.normal(size=shape) * scale).astype(dtype)

        self.hidden, self.labels = hidden, labels
        self.parts = {
            "symbols": drawn(2, SYMBOLS, 4 * hidden, scale=0.3),
            "recurrent": drawn(2, hidden, 4 * hidden, scale=hidden**-0.5),
            "emit": drawn(2 * hidden, labels, scale=(2 * hidden) ** -0.5),
            "bias": np.zeros(labels, dtype),
            "move": np.zeros((labels, labels), dtype),
            "first": np.zeros(labels, dtype),
        }
        # Cells remember at first.
        self.parts["symbols"][:, :, hidden : 2 * hidden] += 1.0
        move, first = legal_moves(kinds)
        self.barred_move = np.where(move, 0.0, IMPOSSIBLE).astype(dtype)
        self.barred_first = np.where(first, 0.0, IMPOSSIBLE).astype(dtype)

    # --- network ----------------------------------------------------------------

    def states(self, windows: np.ndarray, keep: bool = False):
        """Hidden states (time, direction, window, hidden) of rows of symbols; all gates too if kept."""
        size, hidden = self.hidden, []
        both = np.stack([windows.T, windows.T[::-1]], axis=1)
        symbols, recurrent = self.parts["symbols"], self.parts["recurrent"]
        h = np.zeros((2, len(windows), size), symbols.dtype)
        c = np.zeros_like(h)
        direction = np.arange(2)[:, None]
        gates, cells = [], []
        for step in both:
            z = np.matmul(h, recurrent)
            z += symbols[direction, step]
            # The logistic function by way of tanh, which is one call for all gates.
            z[:, :, : 3 * size] *= 0.5
            np.tanh(z, out=z)
            z[:, :, : 3 * size] *= 0.5
            z[:, :, : 3 * size] += 0.5
            i, f, o, g = (z[:, :, n * size : (n + 1) * size] for n in range(4))
            c = f * c + i * g
            h = o * np.tanh(c)
            hidden.append(h)
            if keep:
                gates.append(z)
                cells.append(c)
        return np.stack(hidden), both, gates, cells

    def emissions(self, hidden: np.ndarray) -> np.ndarray:
        """(time, window, label)."""
        joined = np.concatenate([hidden[:, 0], hidden[::-1, 1]], axis=-1)
        return joined @ self.parts["emit"] + self.parts["bias"]

    def decode(self, windows: np.ndarray) -> np.ndarray:
        """The best legal labels of each window."""
        scores = self.emissions(self.states(windows)[0])
        move = self.parts["move"] + self.barred_move
        best = scores[0] + self.parts["first"] + self.barred_first
        back = np.empty((len(scores), len(windows), self.labels), np.int8)
        for t in range(1, len(scores)):
            ways = best[:, :, None] + move
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[t]
        labels = np.empty((len(scores), len(windows)), np.int8)
        labels[-1] = best.argmax(axis=1)
        row = np.arange(len(windows))
        for t in range(len(scores) - 1, 0, -1):
            labels[t - 1] = back[t, row, labels[t]]
        return labels.T

    # --- learning ---------------------------------------------------------------

    def loss(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of a window's labels, and its gradient."""
        hidden, both, gates, cells = self.states(windows, keep=True)
        scores = self.emissions(hidden)
        time, count = len(scores), len(windows)
        move = self.parts["move"] + self.barred_move
        first = self.parts["first"] + self.barred_first
        forward = np.empty_like(scores)
        forward[0] = scores[0] + first
        for t in range(1, time):
            forward[t] = _log_sum(forward[t - 1][:, :, None] + move, 1) + scores[t]
        total = _log_sum(forward[-1], 1)
        backward = np.zeros_like(scores)
        moves = np.zeros_like(move)
        for t in range(time - 1, 0, -1):
            ahead = scores[t] + backward[t]
            ways = move + ahead[:, None, :]
            backward[t - 1] = _log_sum(ways, 2)
            moves += np.exp(forward[t - 1][:, :, None] + ways - total[:, None, None]).sum(axis=0)
        chance = np.exp(forward + backward - total[None, :, None])

        true = labels.T
        row = np.arange(count)
        steps = np.arange(time)[:, None]
        gold = scores[steps, row, true].sum() + first[true[0]].sum() + move[true[:-1], true[1:]].sum()
        value = float(total.sum() - gold) / count
        chance[steps, row, true] -= 1
        np.add.at(moves, (true[:-1].ravel(), true[1:].ravel()), -1)
        grad = {"move": moves / count, "first": chance[0].sum(axis=0) / count}
        chance /= count
        joined = np.concatenate([hidden[:, 0], hidden[::-1, 1]], axis=-1)
        # Many small products: a large one would start threads for little work.
        grad["emit"] = np.matmul(joined.transpose(0, 2, 1), chance).sum(axis=0)
        grad["bias"] = chance.sum(axis=(0, 1))
        back = chance @ self.parts["emit"].T
        size = self.hidden
        into = np.stack([back[:, :, :size], back[::-1, :, size:]], axis=1)
        grad["symbols"], grad["recurrent"] = self._through_time(into, both, hidden, gates, cells)
        return value, grad

    def _through_time(self, into, both, hidden, gates, cells) -> tuple[np.ndarray, np.ndarray]:
        size = self.hidden
        turned = self.parts["recurrent"].transpose(0, 2, 1)
        of_z = np.empty((len(both), *gates[0].shape), gates[0].dtype)
        of_h, of_c = np.zeros_like(hidden[0]), np.zeros_like(hidden[0])
        for t in range(len(both) - 1, -1, -1):
            i, f, o, g = (gates[t][:, :, n * size : (n + 1) * size] for n in range(4))
            before = cells[t - 1] if t else np.zeros_like(of_c)
            bent = np.tanh(cells[t])
            of_h = of_h + into[t]
            of_c = of_c + of_h * o * (1 - bent * bent)
            of_z[t] = np.concatenate(
                [of_c * g * i * (1 - i), of_c * before * f * (1 - f), of_h * bent * o * (1 - o), of_c * i * (1 - g * g)],
                axis=-1,
            )
            of_h = np.matmul(of_z[t], turned)
            of_c = of_c * f
        symbols = np.zeros_like(self.parts["symbols"])
        for d in range(2):
            order = np.argsort(both[:, d], axis=None, kind="stable")
            present, starts = np.unique(both[:, d].ravel()[order], return_index=True)
            symbols[d, present] = np.add.reduceat(of_z[:, d].reshape(-1, 4 * size)[order], starts, axis=0)
        recurrent = np.matmul(hidden[:-1].transpose(0, 1, 3, 2), of_z[1:]).sum(axis=0)
        return symbols, recurrent

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 7):
        """Adam over shuffled batches, the rate falling to a tenth."""
        rng = np.random.default_rng(seed)
        mean = {n: np.zeros_like(p) for n, p in self.parts.items()}
        square = {n: np.zeros_like(p) for n, p in self.parts.items()}
        step, steps = 0, epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                _, grad = self.loss(windows[chosen], labels[chosen])
                step += 1
                norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
                clip = min(1.0, CLIP / (norm + 1e-9))
                speed = rate * (1 - 0.9 * step / steps) * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
                for name, part in self.parts.items():
                    mean[name] += 0.1 * (clip * grad[name] - mean[name])
                    square[name] += 0.01 * ((clip * grad[name]) ** 2 - square[name])
                    part -= speed * mean[name] / (np.sqrt(square[name]) + 1e-8)


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + np.squeeze(top, axis)


def symbols_of(text: str) -> np.ndarray:
    """One symbol per character."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.minimum(points, ALIEN).astype(np.uint8)
