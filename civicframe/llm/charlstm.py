"""A small character BiLSTM with a CRF on top, in numpy: training and decoding.

Tags are O and B-/I- of each kind. All functions work on batches of windows of
one length, so the inner loops are matrix products.
"""

from __future__ import annotations

import numpy as np

# Character classes: letters and digits by kind, listed signs one each.
SIGNS = "@._%+-() :/,;=\n\"'"
PAD, LOWER, UPPER, DIGIT, HIGH, OTHER = range(6)
N_CLASSES = OTHER + 1 + len(SIGNS)
_ASCII = np.full(128, OTHER, np.int8)
_ASCII[97:123], _ASCII[65:91], _ASCII[48:58] = LOWER, UPPER, DIGIT
for _i, _c in enumerate(SIGNS):
    _ASCII[ord(_c)] = OTHER + 1 + _i

EMBED, HIDDEN = 8, 16
BANNED = -1e4


def classes(text: str) -> np.ndarray:
    """Class of every code point."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(cp < 128, _ASCII[np.minimum(cp, 127)], HIGH).astype(np.int8)


def tag_count(kinds: int) -> int:
    return 1 + 2 * kinds


def allowed(kinds: int) -> np.ndarray:
    """0 where tag j may follow tag i, else a large negative number; row -1
    is the start. I-x follows only B-x and I-x."""
    k = tag_count(kinds)
    a = np.zeros((k + 1, k), np.float32)
    for x in range(kinds):
        a[:, 2 + 2 * x] = BANNED
        a[[1 + 2 * x, 2 + 2 * x], 2 + 2 * x] = 0
    return a


def init(kinds: int, seed: int = 42) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    k = tag_count(kinds)

    def mat(*shape):
        return (r.standard_normal(shape) * (shape[0] ** -0.5)).astype(np.float32)
    p = {"E": mat(N_CLASSES, EMBED), "Wo": mat(2 * HIDDEN, k), "bo": np.zeros(k, np.float32),
         "T": np.zeros((k + 1, k), np.float32)}
    for d in "fb":
        p["Wx" + d], p["Wh" + d], p["b" + d] = mat(EMBED, 4 * HIDDEN), mat(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
        p["b" + d][HIDDEN:2 * HIDDEN] = 1.0
    return p


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(x, wx, wh, b, keep):
    """x (L, N, e) -> h (L, N, H); with ``keep`` also what the gradient needs."""
    length, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.empty((length, n, HIDDEN), np.float32), []
    pre = x @ wx + b
    for t in range(length):
        z = pre[t] + h @ wh
        g = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:]
        u = np.tanh(z[:, 3 * HIDDEN:])
        c2 = f * c + i * u
        tc = np.tanh(c2)
        if keep:
            kept.append((i, f, o, u, c, tc, h))
        h, c = o * tc, c2
        out[t] = h
    return out, kept


def _lstm_grad(dh_all, x, wx, wh, kept):
    length, n, _ = x.shape
    dz = np.empty((length, n, 4 * HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(length - 1, -1, -1):
        i, f, o, u, c, tc, h = kept[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc * tc)
        z = dz[t]
        z[:, :HIDDEN] = dc * u * i * (1 - i)
        z[:, HIDDEN:2 * HIDDEN] = dc * c * f * (1 - f)
        z[:, 2 * HIDDEN:3 * HIDDEN] = dh * tc * o * (1 - o)
        z[:, 3 * HIDDEN:] = dc * i * (1 - u * u)
        dwh += h.T @ z
        dh, dc = z @ wh.T, dc * f
    flat = dz.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0), dz @ wx.T


def emissions(p, windows: np.ndarray, keep: bool = False):
    """Tag scores (L, N, K) of class windows (N, L)."""
    ids = windows.T
    x = p["E"][ids]
    hf, kf = _lstm(x, p["Wxf"], p["Whf"], p["bf"], keep)
    hb, kb = _lstm(x[::-1], p["Wxb"], p["Whb"], p["bb"], keep)
    h = np.concatenate([hf, hb[::-1]], axis=2)
    e = h @ p["Wo"] + p["bo"]
    return (e, (ids, x, h, kf, kb)) if keep else e


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_grads(p, windows: np.ndarray, tags: np.ndarray, bans: np.ndarray):
    """Mean negative log likelihood of the tags (N, L) and its gradients."""
    e, (ids, x, h, kf, kb) = emissions(p, windows, keep=True)
    length, n, k = e.shape
    trans = p["T"] + bans
    a = np.empty_like(e)
    a[0] = e[0] + trans[k]
    for t in range(1, length):
        a[t] = _lse(a[t - 1][:, :, None] + trans[None, :k], 1) + e[t]
    b = np.zeros_like(e)
    for t in range(length - 2, -1, -1):
        b[t] = _lse(trans[None, :k] + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = _lse(a[-1], 1)
    y, rows = tags.T, np.arange(n)
    gold = e[0][rows, y[0]] + trans[k][y[0]]
    de = np.exp(a + b - z[None, :, None])
    dt = np.zeros_like(p["T"])
    dt[k] = de[0].sum(0)
    np.add.at(dt[k], y[0], -1)
    for t in range(1, length):
        gold = gold + e[t][rows, y[t]] + trans[y[t - 1], y[t]]
        pair = np.exp(a[t - 1][:, :, None] + trans[None, :k] + (e[t] + b[t])[:, None, :] - z[:, None, None])
        dt[:k] += pair.sum(0)
        np.add.at(dt, (y[t - 1], y[t]), -1)
    de[np.arange(length)[:, None], rows[None], y] -= 1
    de, dt = (de / n).astype(np.float32), (dt / n).astype(np.float32)
    dt[bans < 0] = 0
    g = {"T": dt, "Wo": h.reshape(-1, h.shape[2]).T @ de.reshape(-1, k), "bo": de.sum((0, 1))}
    dh = de @ p["Wo"].T
    g["Wxf"], g["Whf"], g["bf"], dxf = _lstm_grad(dh[:, :, :HIDDEN], x, p["Wxf"], p["Whf"], kf)
    g["Wxb"], g["Whb"], g["bb"], dxb = _lstm_grad(dh[::-1, :, HIDDEN:], x[::-1], p["Wxb"], p["Whb"], kb)
    g["E"] = np.zeros_like(p["E"])
    np.add.at(g["E"], ids, dxf + dxb[::-1])
    return float((z - gold).mean()), g


def train(windows: np.ndarray, tags: np.ndarray, kinds: int, epochs: int = 12, batch: int = 64, rate: float = 0.02,
          seed: int = 42) -> dict[str, np.ndarray]:
    """Adam on shuffled batches; the same input gives the same model."""
    p, bans, r = init(kinds, seed), allowed(kinds), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(windows))
        lr = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            _, g = loss_and_grads(p, windows[some], tags[some], bans)
            step += 1
            for k in p:
                d = np.clip(g[k], -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.999 * s[k] + 0.001 * d * d
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return p


def decode(p, windows: np.ndarray, kinds: int, at_once: int = 2048) -> np.ndarray:
    """Best tags (N, L) by Viterbi."""
    bans = allowed(kinds)
    trans = p["T"] + bans
    k = trans.shape[1]
    out = np.empty(windows.shape, np.int8)
    for s in range(0, len(windows), at_once):
        e = emissions(p, windows[s:s + at_once])
        length, n, _ = e.shape
        back = np.empty((length, n, k), np.int8)
        a = e[0] + trans[k]
        for t in range(1, length):
            x = a[:, :, None] + trans[None, :k]
            back[t] = x.argmax(1)
            a = x.max(1) + e[t]
        best = a.argmax(1)
        rows = np.arange(n)
        for t in range(length - 1, -1, -1):
            out[s:s + n, t] = best
            best = back[t][rows, best] if t else best
    return out


def decode_runs(p, windows: np.ndarray, first: np.ndarray, last: np.ndarray, run: np.ndarray, kinds: int, at_once: int = 2048,
                cells: int = 1 << 19) -> list[np.ndarray]:
    """Best tags of runs of overlapping windows, one Viterbi pass over each run
    whatever its length. Window i gives the scores of its places first[i] to
    last[i] - 1, which lie end to end in a run; ``run`` numbers the runs from 0, rising."""
    place = np.arange(windows.shape[1])
    scores = []
    for s in range(0, len(windows), at_once):
        e = emissions(p, windows[s:s + at_once]).transpose(1, 0, 2)
        own = (place >= first[s:s + at_once, None]) & (place < last[s:s + at_once, None])
        scores.append(e[own])
    flat = np.concatenate(scores)
    size = np.bincount(run, last - first).astype(np.int64)
    start = np.cumsum(size) - size
    trans = p["T"] + allowed(kinds)
    k = trans.shape[1]
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(size)
    order = np.argsort(size, kind="stable")
    while len(order):
        # runs of like length together, as many as fit
        n = len(order)
        while n > 1 and n * size[order[n - 1]] > cells:
            n = max(1, int(n * 0.7))
        some, order = order[:n], order[n:]
        length = int(size[some[-1]])
        live = size[some]
        back = np.empty((length, n, k), np.int8)
        at = start[some]
        a = flat[at] + trans[k]
        for t in range(1, length):
            x = a[:, :, None] + trans[None, :k]
            back[t] = x.argmax(1)
            go = t < live
            nxt = x.max(1) + flat[np.minimum(at + t, len(flat) - 1)]
            # a run that has ended keeps its scores and points straight back
            a = np.where(go[:, None], nxt, a)
            back[t][~go] = np.arange(k)
        best = a.argmax(1)
        rows = np.arange(n)
        tags = np.empty((n, length), np.int8)
        for t in range(length - 1, -1, -1):
            tags[:, t] = best
            best = back[t][rows, best] if t else best
        for j, i in enumerate(some.tolist()):
            out[i] = tags[j, :size[i]]
    return out
