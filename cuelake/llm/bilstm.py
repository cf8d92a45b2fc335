"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by gradients, decoding by Viterbi.

Both directions run side by side as one batch of two.  Sequences have one length; short ones are padded with a character of
their own.  Arrays go by (time, direction, sequence, unit).
"""

from __future__ import annotations

import numpy as np

NEVER, CLIP = -1e4, 20.0
KEYS = ("W", "U", "b", "O", "bo", "A", "s", "e")


def initial(chars: int, hidden: int, tags: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {
        "W": rng.normal(0, 0.3, (2, chars, 4 * hidden)), "U": rng.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)), "b": np.zeros((2, 4 * hidden)),
        "O": rng.normal(0, hidden**-0.5, (2, hidden, tags)), "bo": np.zeros(tags), "A": np.zeros((tags, tags)), "s": np.zeros(tags), "e": np.zeros(tags),
    }
    out["b"][:, hidden : 2 * hidden] = 1.0
    return out


def _sides(ids: np.ndarray) -> np.ndarray:
    """(sequence, time) to (time, direction, sequence)."""
    return np.stack([ids.T, ids.T[::-1]], axis=1)


def _emissions(h: np.ndarray, p: dict) -> np.ndarray:
    """(time, sequence, tag) from the hidden states of both directions."""
    return h[:, 0] @ p["O"][0] + h[::-1, 1] @ p["O"][1] + p["bo"]


def _run(ids: np.ndarray, p: dict) -> tuple[np.ndarray, list]:
    x = _sides(ids)
    hidden = p["U"].shape[1]
    h = c = np.zeros((2, x.shape[2], hidden), p["U"].dtype)
    both, out, kept = np.arange(2)[:, None], [], []
    for t in range(len(x)):
        z = p["W"][both, x[t]] + h @ p["U"] + p["b"][:, None]
        gates = np.tanh(z[..., : 3 * hidden] / 2) / 2 + 0.5
        i, f, o, g = gates[..., :hidden], gates[..., hidden : 2 * hidden], gates[..., 2 * hidden :], np.tanh(z[..., 3 * hidden :])
        before, last = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out.append(h)
        kept.append((i, f, o, g, tc, before, last))
    return np.stack(out), kept


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def loss_and_gradients(ids: np.ndarray, tags: np.ndarray, p: dict, forbidden: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of a batch (sequence, time), and its gradients."""
    n, steps = ids.shape
    h, kept = _run(ids, p)
    em = _emissions(h, p)
    a = p["A"] + forbidden
    alpha, beta = np.empty_like(em), np.empty_like(em)
    alpha[0] = p["s"] + em[0]
    for t in range(1, steps):
        alpha[t] = _log_sum(alpha[t - 1][:, :, None] + a, 1) + em[t]
    beta[-1] = p["e"]
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(a + (em[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _log_sum(alpha[-1] + p["e"], 1)
    y, rows = tags.T, np.arange(n)
    path = p["s"][y[0]] + p["e"][y[-1]] + em[np.arange(steps)[:, None], rows, y].sum(axis=0) + a[y[:-1], y[1:]].sum(axis=0)
    loss = float((z - path).mean())
    share = np.exp(alpha + beta - z[:, None])
    d_em = share.copy()
    d_em[np.arange(steps)[:, None], rows, y] -= 1
    pairs = np.exp(alpha[:-1, :, :, None] + a + (em[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum(axis=(0, 1))
    np.add.at(pairs, (y[:-1], y[1:]), -1)
    grads = {"A": np.where(forbidden < 0, 0, pairs), "s": d_em[0].sum(axis=0), "e": d_em[-1].sum(axis=0), "bo": d_em.sum(axis=(0, 1))}
    grads["O"] = np.stack([np.einsum("tbh,tbk->hk", h[:, 0], d_em), np.einsum("tbh,tbk->hk", h[::-1, 1], d_em)])
    d_h = np.stack([d_em @ p["O"][0].T, (d_em @ p["O"][1].T)[::-1]], axis=1)
    d_z = np.empty((steps, 2, n, p["U"].shape[2]), em.dtype)
    grads["U"] = np.zeros_like(p["U"])
    back, d_c = np.zeros_like(d_h[0]), np.zeros_like(d_h[0])
    for t in range(steps - 1, -1, -1):
        i, f, o, g, tc, before, last = kept[t]
        dh = d_h[t] + back
        d_c = d_c + dh * o * (1 - tc * tc)
        d_z[t] = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), dh * tc * o * (1 - o), d_c * i * (1 - g * g)], axis=-1)
        grads["U"] += last.transpose(0, 2, 1) @ d_z[t]
        back = d_z[t] @ p["U"].transpose(0, 2, 1)
        d_c = d_c * f
    grads["b"] = d_z.sum(axis=(0, 2))
    x = _sides(ids)
    chars = np.eye(p["W"].shape[1], dtype=em.dtype)
    grads["W"] = np.stack([chars[x[:, k].ravel()].T @ d_z[:, k].reshape(steps * n, -1) for k in range(2)])
    return loss, {k: v / n for k, v in grads.items()}


def fit(ids: np.ndarray, tags: np.ndarray, chars: int, hidden: int, forbidden: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> dict[str, np.ndarray]:
    """Adam with a falling rate over random batches; the same rows and seed give the same model."""
    kind = np.float32
    p, forbidden = {k: v.astype(kind) for k, v in initial(chars, hidden, len(forbidden), seed).items()}, forbidden.astype(kind)
    rng, first, second = np.random.default_rng(seed), {k: 0.0 for k in KEYS}, {k: 0.0 for k in KEYS}
    for step in range(1, steps + 1):
        at = rng.integers(0, len(ids), batch)
        _, grads = loss_and_gradients(ids[at], tags[at], p, forbidden)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip, now = min(1.0, CLIP / size), rate * min(1.0, 2 - 2 * step / (steps + 1))
        for k in KEYS:
            g = clip * grads[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = (p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(kind)
    return p


class Tagger:
    """A fitted model for decoding: 32-bit floats, all gates by one hyperbolic tangent."""

    def __init__(self, p: dict[str, np.ndarray], forbidden: np.ndarray):
        hidden = p["U"].shape[1]
        half = np.concatenate([np.full(3 * hidden, 0.5), np.ones(hidden)])
        self.table = ((p["W"] + p["b"][:, None]) * half).astype(np.float32)
        self.own = (p["U"] * half).astype(np.float32)
        self.out, self.bias = p["O"].astype(np.float32), p["bo"].astype(np.float32)
        self.a, self.s, self.e = (x.astype(np.float32) for x in (p["A"] + forbidden, p["s"], p["e"]))
        steps = max(0.0, float((self.a - self.a[0, 0]).max()), float((self.s - self.s[0]).max()), float((self.e - self.e[0]).max()))
        self.margin = 2 * steps + 1e-3

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        x = _sides(ids)
        hidden = self.own.shape[1]
        h = c = np.zeros((2, x.shape[2], hidden), np.float32)
        states = np.empty((len(x), 2, x.shape[2], hidden), np.float32)
        for t in range(len(x)):
            z = h @ self.own
            z[0] += self.table[0][x[t, 0]]
            z[1] += self.table[1][x[t, 1]]
            np.tanh(z, out=z)
            gates = z[..., : 3 * hidden] * np.float32(0.5) + np.float32(0.5)
            c = gates[..., hidden : 2 * hidden] * c + gates[..., :hidden] * z[..., 3 * hidden :]
            h = gates[..., 2 * hidden :] * np.tanh(c)
            states[t] = h
        return states[:, 0] @ self.out[0] + states[::-1, 1] @ self.out[1] + self.bias

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Tags (sequence, time) of the likeliest paths.

        Where tag 0 leads at each character by more than transitions could make up, it is the whole path and no search is needed.
        """
        em = self.emissions(ids)
        lead = em[..., 0] - em[..., 1:].max(axis=-1)
        out = np.zeros(ids.shape, np.uint8)
        todo = np.flatnonzero(lead.min(axis=0) <= self.margin)
        if len(todo):
            out[todo] = self._paths(em[:, todo])
        return out

    def _paths(self, em: np.ndarray) -> np.ndarray:
        steps, n, _ = em.shape
        best, came = self.s + em[0], np.zeros(em.shape, np.uint8)
        for t in range(1, steps):
            ways = best[:, :, None] + self.a
            came[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + em[t]
        out, rows = np.zeros((n, steps), np.uint8), np.arange(n)
        out[:, -1] = (best + self.e).argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = came[t][rows, out[:, t]]
        return out
