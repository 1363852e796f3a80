"""A small character convolutional network in numpy, and the labelled findings that it learns from.

Findings are written by rules from a seeded generator: a candidate string inside a context, with
the label that the rule gives it (a credential, or something that merely looks like one).  A
candidate may be a chain, such as a URL's path, with or without a credential as one of its parts.
Candidates are seen through windows; of each finding one is learnt from, which holds HELD
characters of its credential at least if it has one.
"""

from __future__ import annotations

import string

import numpy as np

#: Characters of a window before its place in a candidate, and from there on.
BEFORE, AFTER = 24, 48
#: Distance of a candidate's windows, characters of context after it that they have (more could be the next secret), and of a credential that a window must hold.
STRIDE, TAIL, HELD = 24, 16, 16
WIDTH, EMBED, FILTERS = 5, 12, 32
FINDINGS, EPOCHS, BATCH, RATE, SEED = 9000, 7, 128, 4e-3, 7
#: Recall that the threshold must keep on held-out findings.
RECALL = 0.98

_CODE = np.full(256, 95, np.int64)
_CODE[32:127] = np.arange(95)
CODES = 97  # printable ASCII, others, outside the text


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the candidate and place in it of every window: together they show whole candidates and TAIL characters more."""
    last = np.maximum(lengths - (AFTER - TAIL), 0)
    count = 1 - (-last // STRIDE)
    owner = np.repeat(np.arange(len(lengths)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, np.minimum(step * STRIDE, last[owner])


def encode(before: bytes, rest: bytes) -> np.ndarray:
    """Symbol numbers of a window; its place in the candidate is at BEFORE."""
    out = np.full(BEFORE + AFTER, 96, np.int64)
    b, r = np.frombuffer(before[-BEFORE:], np.uint8), np.frombuffer(rest[:AFTER], np.uint8)
    out[BEFORE - len(b) : BEFORE] = _CODE[b]
    out[BEFORE : BEFORE + len(r)] = _CODE[r]
    return out


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    some = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    alnum, hexa, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    parts = "an re th on er in the and ing tion en sch ung ver que eau ment los ado cion ou ie st".split()
    word = lambda: "".join(pick(parts) for _ in range(int(rng.integers(1, 5))))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(2, 7))))
    size = lambda a, b: int(rng.integers(a, b))
    host = lambda: pick(["mail", "web", "host", "node", word()]) + some(string.digits, size(1, 4)) + "." + pick(["example", "example", word()]) + "." + pick(["com", "org", "net", "info"])
    secrets = [
        lambda: some(alnum, size(16, 44)),
        lambda: some(alnum, size(16, 24)),
        lambda: some(string.ascii_uppercase + string.digits, size(16, 33)),
        lambda: "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: some(hexa, size(24, 65)),
        lambda: some(b64, size(24, 60)) + "=" * size(0, 3),
        lambda: "gh" + pick("pousr") + "_" + some(alnum, 36),
        lambda: "sk-" + some(alnum, size(20, 49)),
        lambda: "xox" + pick("bpas") + "-" + some(string.digits, 11) + "-" + some(alnum, 24),
        lambda: "eyJ" + some(alnum, size(16, 30)) + "." + some(alnum, size(16, 30)),
        lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
        lambda: "AIza" + some(alnum + "_-", 35),
        lambda: some(alnum + "_-", size(16, 40)),
        lambda: some(string.ascii_lowercase, size(2, 6)) + pick("_-") + some(alnum, size(16, 40)),
    ]
    harmless = [
        lambda: "".join(word() for _ in range(3)) + some(string.digits, size(1, 4)),
        lambda: "www." + word() + ".example." + pick(["com", "org", "net"]) + "/" + word() + "/" + some(string.digits, size(1, 6)),
        lambda: some(string.digits, 2) + "mail7.example.com",
        lambda: host(),
        lambda: word() + "." + word() + some(string.digits, 2) + ".example.org",
        lambda: f"20{some(string.digits, 2)}-{some('01', 2)}-{some(string.digits, 2)}T{some(string.digits, 2)}.{some(string.digits, 2)}Z",
        lambda: "v" + ".".join(some(string.digits, size(1, 3)) for _ in range(5)) + "-beta" + some(string.digits, 1),
        lambda: "/".join(word() for _ in range(4)) + "/file" + some(string.digits, 2) + ".txt",
        lambda: "_".join(word() for _ in range(4)) + "_" + some(string.digits, 1),
        lambda: "-".join(word() for _ in range(4)) + "-" + some(string.digits, size(1, 5)),
        lambda: "".join(word().capitalize() for _ in range(4)) + some(string.digits, 1),
        lambda: pick(["-", "=", ".", "_"]) * size(12, 30) + "a1",
        lambda: some(string.digits, size(12, 20)) + "." + word(),
        lambda: "ISBN" + some(string.digits, 13),
        lambda: pick(hexa) * size(16, 30) + "x0",
    ]
    lead = [lambda: prose() + ' key = "', lambda: prose() + " Authorization: Bearer ", lambda: "export " + word().upper() + "=", lambda: prose() + " ", lambda: prose() + ".\n", lambda: '{"credential": "', lambda: prose() + ": "]
    x, y = [], []
    for _ in range(n):
        label = int(rng.random() < 0.45)
        address = not label and rng.random() < 0.25
        text = host() if address else pick(secrets if label else harmless)()
        a, b = 0, len(text)
        if not address and rng.random() < 0.4:  # a chain
            sign = pick("/./=-_")
            first, rest = (sign.join(pick(harmless)() for _ in range(size(0, 4))) for _ in "ab")
            a = len(first) + 1 if first else 0
            b += a
            text = sign.join(t for t in (first, text, rest) if t)
        before = prose() + " " + word()[:4] + "." + some(string.digits, size(0, 3)) + "@" if address else pick(lead)()
        after = pick(['" ', " ", "\n", ", "]) + prose()
        _, places = windows(np.array([len(text)]))
        if label:
            places = places[np.minimum(places + AFTER, b) - np.maximum(places - BEFORE, a) >= HELD]
        at, end = len(before) + pick(places), len(before) + len(text) + TAIL
        whole = (before + text + after).encode()
        x.append(encode(whole[max(0, at - BEFORE) : at], whole[at : min(at + AFTER, end)]))
        y.append(label)
    return np.array(x), np.array(y)


class Network:
    """Embedding, one convolution, max and mean pooling, one linear unit; then a calibration."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 0.3, (CODES, EMBED)), rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1)]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x):
        e, k, b, w, c = self.p
        emb = e[x]
        steps = x.shape[1] - WIDTH + 1
        cols = np.lib.stride_tricks.sliding_window_view(emb, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(-1, WIDTH * EMBED)
        act = np.maximum(cols @ k + b, 0).reshape(len(x), steps, FILTERS)
        top = act.argmax(1)
        pool = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(1)], 1)
        return cols, act, top, pool, pool @ w + c[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[4] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -40, 40)))

    def _gradients(self, x, y):
        e, k, b, w, c = self.p
        cols, act, top, pool, z = self._forward(x)
        steps = act.shape[1]
        dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        dpool = dz[:, None] * w
        dact = np.repeat(dpool[:, None, FILTERS:] / steps, steps, 1)
        rows = np.arange(len(x))[:, None]
        dact[rows, top, np.arange(FILTERS)] += dpool[:, :FILTERS]
        dact = (dact * (act > 0)).reshape(-1, FILTERS)
        dcols = (dact @ k.T).reshape(len(x), steps, WIDTH, EMBED)
        demb = np.zeros((*x.shape, EMBED))
        for j in range(WIDTH):
            demb[:, j : j + steps] += dcols[:, :, j]
        hot = np.zeros((x.size, CODES))
        hot[np.arange(x.size), x.ravel()] = 1
        return [hot.T @ demb.reshape(-1, EMBED), cols.T @ dact, dact.sum(0), pool.T @ dz, np.array([dz.sum()])]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> "Network":
        """Adam on four sixths; a sixth calibrates the probabilities, another one sets the threshold."""
        rng = np.random.default_rng(seed)
        sixth = np.arange(len(y)) % 6
        held, other = sixth == 0, sixth == 1
        tx, ty = x[sixth > 1], y[sixth > 1]
        m, v, t = [0 * a for a in self.p], [0 * a for a in self.p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(ty))
            for i in range(0, len(order), BATCH):
                part, t = order[i : i + BATCH], t + 1
                for j, g in enumerate(self._gradients(tx[part], ty[part])):
                    m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                    self.p[j] = self.p[j] - RATE * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        z, hy = self.logits(x[held]), y[held]
        for _ in range(200):  # Platt scaling, with a small penalty that keeps it finite
            p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))
            s, d = p * (1 - p), p - hy
            h = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.1]])
            move = np.linalg.solve(h, np.array([(d * z).sum() + 0.1 * (self.scale - 1), d.sum() + 0.1 * self.shift]))
            self.scale, self.shift = self.scale - 0.5 * move[0], self.shift - 0.5 * move[1]
            if np.abs(move).max() < 1e-6:
                break
        positive = np.sort(self.probability(x[other])[y[other] == 1])
        # The highest threshold that keeps the recall.
        self.threshold = float(positive[int((1 - RECALL) * len(positive))])
        return self


def trained() -> Network:
    return Network().fit(*labelled_findings())
