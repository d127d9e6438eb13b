"""A character tagger in numpy: embeddings, one LSTM in each direction, a linear layer and CRF transitions.

Arrays are batches of windows padded at the right; ``lengths`` tells where they end.  Tags are 0 (outside) and, for kind
k, 2k + 1 (begins) and 2k + 2 (goes on).  A window may start or end inside a span.
"""

from __future__ import annotations

import numpy as np

#: Code points are 33 to 126 as they are; the rest are classes: space, other blanks, other letters (lower, upper), other digits, other.
PAD, SPACE, BLANK, LOWER, UPPER, DIGIT, OTHER, SIZE = 0, 95, 96, 97, 98, 99, 100, 101
FORBIDDEN = -1e4


def symbol(c: str) -> int:
    n = ord(c)
    if 33 <= n <= 126:
        return n - 32
    if c == " ":
        return SPACE
    return BLANK if c.isspace() else DIGIT if c.isdigit() else UPPER if c.isupper() else LOWER if c.isalpha() else OTHER


class Symbols(dict):
    """Symbols of the characters met so far."""

    def __missing__(self, c: str) -> int:
        self[c] = found = symbol(c)
        return found


def batch_of(texts: list[str], symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts])
    ids = np.zeros((len(texts), int(lengths.max(initial=1))), np.int64)
    for row, text in zip(ids, texts):
        row[: len(text)] = [symbols[c] for c in text]
    return ids, lengths


def initial(kinds: int, hidden: int, width: int, seed: int, dtype=np.float32) -> dict[str, np.ndarray]:
    rng, tags = np.random.default_rng(seed), 2 * kinds + 1
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(dtype)
    p = {"embed": draw(SIZE, width) * 3, "out": draw(2 * hidden, tags), "out_b": np.zeros(tags, dtype), "trans": np.zeros((tags, tags), dtype), "start": np.zeros(tags, dtype), "end": np.zeros(tags, dtype)}
    for d in "fb":
        bias = np.zeros(4 * hidden, dtype)
        bias[hidden : 2 * hidden] = 1  # remember at first
        p |= {f"wx{d}": draw(width, 4 * hidden), f"wh{d}": draw(hidden, 4 * hidden), f"b{d}": bias}
    for tag in range(2, tags, 2):  # a span goes on only after its own kind
        p["trans"][[t for t in range(tags) if t not in (tag - 1, tag)], tag] = FORBIDDEN
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(p: dict, d: str, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Hidden states in time order; with ``keep`` also what the gradient needs.  Direction b reads from the end."""
    wh, (n, length) = p[f"wh{d}"], ids.shape
    size = wh.shape[0]
    gates_of = p["embed"] @ p[f"wx{d}"] + p[f"b{d}"]  # a row per symbol
    h, c = np.zeros((n, size), wh.dtype), np.zeros((n, size), wh.dtype)
    out, kept = np.empty((length, n, size), wh.dtype), []
    for t in range(length) if d == "f" else range(length - 1, -1, -1):
        z = gates_of[ids[:, t]] + h @ wh
        s, g, m = sigmoid(z), np.tanh(z[:, 2 * size : 3 * size]), mask[:, t, None]
        i, f, o = s[:, :size], s[:, size : 2 * size], s[:, 3 * size :]
        made = f * c + i * g
        bent = np.tanh(made)
        if keep:
            kept.append((t, i, f, g, o, c, bent, h, m))
        h, c = m * (o * bent) + (1 - m) * h, m * made + (1 - m) * c
        out[t] = h
    return out, kept


def lstm_back(p: dict, d: str, ids: np.ndarray, kept: list, upper: np.ndarray, grads: dict) -> None:
    """Adds the gradients of one direction, given those of its hidden states."""
    wh, wx = p[f"wh{d}"], p[f"wx{d}"]
    dh, dc = np.zeros_like(kept[0][7]), np.zeros_like(kept[0][7])
    steps = np.empty((len(kept), len(dh), wh.shape[1]), wh.dtype)
    for t, i, f, g, o, c, bent, h, m in reversed(kept):
        dh = dh + upper[t]
        own = m * dh
        made = own * o * (1 - bent * bent) + m * dc
        dz = np.concatenate([made * g * i * (1 - i), made * c * f * (1 - f), made * i * (1 - g * g), own * bent * o * (1 - o)], axis=1)
        grads[f"wh{d}"] += h.T @ dz
        steps[t] = dz
        dh, dc = dz @ wh.T + (1 - m) * dh, made * f + (1 - m) * dc
    flat = ids.T.reshape(-1)
    order = np.argsort(flat, kind="stable")
    met, first = np.unique(flat[order], return_index=True)
    of_symbol = np.zeros((SIZE, wh.shape[1]), wh.dtype)
    of_symbol[met] = np.add.reduceat(steps.reshape(len(flat), -1)[order], first)
    grads[f"b{d}"] += of_symbol.sum(0)
    grads[f"wx{d}"] += p["embed"].T @ of_symbol
    grads["embed"] += of_symbol @ wx.T


def emissions(p: dict, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    (f, kept_f), (b, kept_b) = lstm(p, "f", ids, mask, keep), lstm(p, "b", ids, mask, keep)
    states = np.concatenate([f, b], axis=2)  # time, window, state
    return states @ p["out"] + p["out_b"], states, kept_f, kept_b


def marginals(p: dict, e: np.ndarray, mask: np.ndarray):
    """The tags' probabilities, the log of the CRF's partition function, and the factors of pairs of neighbouring tags.

    Sums run over probabilities, scaled at every step, so a step is one product with the matrix of transitions.
    """
    length, moves, end, m = len(e), np.exp(p["trans"]), np.exp(p["end"]), mask.T[:, :, None]
    top = e.max(2, keepdims=True)
    own = np.exp(e - top)
    a, b = np.empty_like(e), np.empty_like(e)
    a[0] = np.exp(p["start"]) * own[0]
    scale = a[0].sum(1, keepdims=True)
    a[0] /= scale
    z = np.log(scale)
    for t in range(1, length):
        made = (a[t - 1] @ moves) * own[t]
        scale = made.sum(1, keepdims=True)
        a[t] = np.where(m[t] > 0, made / scale, a[t - 1])
        z += np.log(scale) * m[t]
    b[-1] = end
    for t in range(length - 2, -1, -1):
        made = (own[t + 1] * b[t + 1]) @ moves.T
        b[t] = np.where(m[t + 1] > 0, made / made.sum(1, keepdims=True), end)
    both = a * b
    z = (z + np.log((a[-1] * end).sum(1, keepdims=True)) + (top * m).sum(0))[:, 0]
    after = own[1:] * b[1:]
    before = a[:-1] * m[1:] / ((a[:-1] @ moves) * after).sum(2, keepdims=True)
    return both / both.sum(2, keepdims=True), z, before, after


def loss_and_gradients(p: dict, ids: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log likelihood of a batch's tags."""
    n, length = ids.shape
    mask = (np.arange(length) < lengths[:, None]).astype(p["out"].dtype)
    e, states, kept_f, kept_b = emissions(p, ids, mask, keep=True)
    own, z, before, after = marginals(p, e, mask)
    rows, last = np.arange(n), lengths - 1
    gold = p["start"][tags[:, 0]] + p["end"][tags[rows, last]] + (e[np.arange(length)[:, None], rows, tags.T] * mask.T).sum(0)
    gold = gold + (p["trans"][tags[:, :-1], tags[:, 1:]] * mask[:, 1:]).sum(1)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    de = own * mask.T[:, :, None]
    de[np.arange(length)[:, None], rows, tags.T] -= mask.T
    de /= n
    grads["start"] += own[0].sum(0) / n
    np.add.at(grads["start"], tags[:, 0], -1 / n)
    grads["end"] += own[last, rows].sum(0) / n
    np.add.at(grads["end"], tags[rows, last], -1 / n)
    tagged = before.shape[2]
    grads["trans"] += np.exp(p["trans"]) * (before.reshape(-1, tagged).T @ after.reshape(-1, tagged)) / n
    np.add.at(grads["trans"], (tags[:, :-1], tags[:, 1:]), -mask[:, 1:] / n)
    grads["out"] += states.reshape(-1, states.shape[2]).T @ de.reshape(-1, de.shape[2])
    grads["out_b"] += de.sum((0, 1))
    upper, size = de @ p["out"].T, p["whf"].shape[0]
    lstm_back(p, "f", ids, kept_f, upper[:, :, :size], grads)
    lstm_back(p, "b", ids, kept_b, upper[:, :, size:], grads)
    return float((z - gold).mean()), grads


def train(p: dict, texts: list[str], tags: list[np.ndarray], epochs: int, batch: int, rate: float, seed: int) -> dict:
    """Adam with a rate that falls to zero; windows of like length share a batch."""
    rng, symbols = np.random.default_rng(seed), Symbols()
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    chunks = [order[i : i + batch] for i in range(0, len(order), batch)]
    step, steps = 0, epochs * len(chunks)
    for _ in range(epochs):
        for k in rng.permutation(len(chunks)):
            chosen = chunks[k]
            ids, lengths = batch_of([texts[i] for i in chosen], symbols)
            gold = np.zeros_like(ids)
            for row, i in zip(gold, chosen):
                row[: len(tags[i])] = tags[i]
            _, grads = loss_and_gradients(p, ids, lengths, gold)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for name, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.999 * square[name] + 0.001 * g * g
                moved = mean[name] / (1 - 0.9**step) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
                p[name] = (p[name] - rate * (1 - step / (steps + 1)) * moved).astype(p[name].dtype)
    return p


def decode(p: dict, ids: np.ndarray, lengths: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """Spans of the best tags (Viterbi) of each window: start, end, kind and the tags' mean probability."""
    n, length = ids.shape
    mask = (np.arange(length) < lengths[:, None]).astype(p["out"].dtype)
    e = emissions(p, ids, mask)[0]
    own = marginals(p, e, mask)[0]
    best, back = p["start"] + e[0], np.zeros((length, n, e.shape[2]), np.int64)
    for t in range(1, length):
        ways = best[:, :, None] + p["trans"]
        back[t] = np.where(mask[:, t, None] > 0, ways.argmax(1), np.arange(e.shape[2]))
        best = np.where(mask[:, t, None] > 0, ways.max(1) + e[t], best)
    tag, tags = (best + p["end"]).argmax(1), np.zeros((length, n), np.int64)
    for t in range(length - 1, -1, -1):
        tags[t] = tag
        tag = back[t][np.arange(n), tag]
    found = []
    for w in range(n):
        spans, row = [], tags[: lengths[w], w]
        for t in np.flatnonzero(row):
            kind, prob = (int(row[t]) - 1) // 2, float(own[t, w, row[t]])
            if row[t] % 2 == 0 and spans and spans[-1][1] == t and spans[-1][2] == kind:
                spans[-1][1], spans[-1][3] = int(t) + 1, spans[-1][3] + prob
            else:
                spans.append([int(t), int(t) + 1, kind, prob])
        found.append([(s, x, k, q / (x - s)) for s, x, k, q in spans])
    return found
