"""A causal self-attention model over subword ids, in numpy.

An id is embedded by what stands before and behind it in the training documents, reduced to WIDTH numbers that are its own. One head attends over a
window of ids. The next id's probability has two levels: that of its class, and its weight in the class. The classes' logits are what the attention
gives, on top of how often each class follows ids that behave like the last one (its state); the weights inside a class are learned by counting which ids
follow each state. States and classes are clusters of ids by what follows and what precedes them. So the model starts as a bigram of
states and ids, and the attention learns what the rest of the window adds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CLASSES, STATES, WIDTH, WINDOW, STRIDE = 16, 256, 8, 24, 16
RATE = 3e-3
#: Windows of a training step, and of a portion that is scored at once; small ones stay in the processor's cache.
BATCH, PORTION = 128, 128
SHAPES = {"a": (WIDTH, WIDTH), "p": (WINDOW, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "o": (WIDTH, WIDTH), "w": (WIDTH, CLASSES), "b": (CLASSES,)}
_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_ONES = {n: np.ones((n, 1), np.float32) for n in (WINDOW, CLASSES)}
#: Bounds of scores and of what the attention adds to a class, so that exponentials need no search for the largest; sums go through products, which are
#: several times as fast as numpy's reductions over short rows.
SCORE_BOUND, LOGIT_BOUND = 50.0, 20.0
#: Prior counts of a state's ids and of the unseen ids.
PRIOR, UNSEEN = 100.0, 0.01


@dataclass
class Lexicon:
    """What is counted over all training documents. Columns stand for ids: the used ones, one for all others, and one for the beginning."""

    column: np.ndarray  # of each id
    embedding: np.ndarray  # columns x WIDTH
    state: np.ndarray  # of each column
    class_: np.ndarray  # of each column but the last
    prior: np.ndarray | None = None  # states x CLASSES, logarithms
    weight: np.ndarray | None = None  # states x columns but the last, logarithms of an id's share of its class

    @property
    def begin(self) -> int:
        return len(self.state) - 1


def clusters(x: np.ndarray, mass: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """k-means from the heaviest points; the same for the same input."""
    k = min(k, len(x))
    centres = x[np.argsort(-mass, kind="stable")[:k]].copy()
    out = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        # points in blocks, so that the distances take little room
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            out[a : a + 4096] = ((centres**2).sum(1) - 2 * part @ centres.T).argmin(1)
        total = np.bincount(out, mass, k)
        sums = np.stack([np.bincount(out, mass * x[:, j], k) for j in range(x.shape[1])], 1)
        centres[total > 0] = sums[total > 0] / total[total > 0][:, None]
    return out


def lexicon(ids: np.ndarray, mass: np.ndarray, before: np.ndarray, behind: np.ndarray, size: int) -> Lexicon:
    """ids that are used, how often, and the sums of the random vectors of what stands before and behind them."""
    column = np.full(size, len(ids), np.int32)
    column[ids] = np.arange(len(ids))
    shape = np.zeros((len(ids) + 2, WIDTH), np.float32)
    state, class_ = np.zeros(len(ids) + 2, np.int64), np.zeros(len(ids) + 1, np.int64)
    state[-1] = STATES
    shape[-1, 0] = 1
    if len(ids):
        sides = []
        for sums in (before, behind):
            mean = sums / mass[:, None]
            centred = mean - (mean * mass[:, None]).sum(0) / mass.sum()
            sides.append(centred * (mass / (mass + 20))[:, None])
        state[: len(ids)] = clusters(sides[1], mass, STATES)
        class_[: len(ids)] = clusters(sides[0], mass, CLASSES)
        both = np.concatenate(sides, 1)
        _, _, axes = np.linalg.svd(both * np.sqrt(mass / mass.sum())[:, None], full_matrices=False)
        # the signs of the axes are set by their largest component, so that a run repeats another
        axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        made = both @ axes[:WIDTH].T
        made /= np.sqrt((made**2 * (mass / mass.sum())[:, None]).sum(0)) + 1e-9
        shape[: len(ids), : made.shape[1]] = np.clip(made, -4, 4)
    return Lexicon(column, shape, state, class_)


def with_counts(lex: Lexicon, counts: np.ndarray) -> Lexicon:
    """counts: states x columns but the last, how often the column's id follows the state."""
    unseen = (lex.column == lex.begin - 1).sum()
    mass = counts.sum(0)
    mass[:-1] += UNSEEN
    mass[-1] = UNSEEN * max(1, unseen)
    share = mass / mass.sum()
    smooth = counts + PRIOR * share
    by_class = np.stack([np.bincount(lex.class_, row, CLASSES) for row in smooth])
    prior = np.log(np.maximum(by_class, 1e-300) / smooth.sum(1)[:, None])
    weight = np.log(smooth / by_class[:, lex.class_])
    weight[:, -1] -= np.log(max(1, unseen))  # one of the others
    return Lexicon(lex.column, lex.embedding, lex.state, lex.class_, np.maximum(prior, -60).astype(np.float32), weight.astype(np.float32))


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    scale = {"a": WIDTH**-0.5, "p": 0.1, "qkv": WIDTH**-0.5, "o": WIDTH**-0.5, "w": 0.02, "b": 0.0}
    return {k: (rng.normal(size=s) * scale[k]).astype(np.float32) for k, s in SHAPES.items()}


def pack(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in SHAPES])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = np.asarray(flat[at : at + n], np.float32).reshape(s)
        at += n
    return out


def _attended(q: np.ndarray, k: np.ndarray, skip: int) -> np.ndarray:
    """Weights of the window's places for the queries from skip on. q: scaled."""
    s = q @ k.transpose(0, 2, 1)
    np.clip(s, -SCORE_BOUND, SCORE_BOUND, out=s)
    np.exp(s, out=s)
    s *= _SEEN[skip:].astype(s.dtype, copy=False)
    s /= (s.reshape(-1, WINDOW) @ _ONES[WINDOW].astype(s.dtype, copy=False)).reshape(*s.shape[:2], 1)
    return s


def _classes(p: dict[str, np.ndarray], lex: Lexicon, h: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of the classes, and the logarithms of their sums."""
    z = h @ p["w"]
    z += p["b"]
    np.clip(z, -LOGIT_BOUND, LOGIT_BOUND, out=z)
    z += lex.prior.take(state, 0)
    return z, np.log(np.exp(z) @ _ONES[CLASSES].astype(z.dtype, copy=False))


def forward(p: dict[str, np.ndarray], lex: Lexicon, inputs: np.ndarray) -> tuple[np.ndarray, tuple]:
    """inputs: windows x WINDOW columns. Log probabilities of the next class at each place, and what the way back needs."""
    n, flat = len(inputs), inputs.reshape(-1)
    given = lex.embedding.take(flat, 0).astype(p["a"].dtype, copy=False)
    x = (given @ p["a"]).reshape(n, WINDOW, WIDTH)
    x += p["p"]
    q, k, v = ((x.reshape(-1, WIDTH) @ p["qkv"][:, i * WIDTH : (i + 1) * WIDTH]).reshape(n, WINDOW, WIDTH) for i in range(3))
    q *= p["a"].dtype.type(WIDTH**-0.5)
    s = _attended(q, k, 0)
    mixed = s @ v
    h = x.reshape(-1, WIDTH) + mixed.reshape(-1, WIDTH) @ p["o"]
    z, total = _classes(p, lex, h, lex.state.take(flat))
    z -= total
    return z.reshape(n, WINDOW, CLASSES), (given, x, q, k, v, s, mixed, h)


def own_log(p: dict[str, np.ndarray], lex: Lexicon, inputs: np.ndarray, targets: np.ndarray, skip: int) -> np.ndarray:
    """Log probabilities of the target ids at the places from skip on; what stands before is context alone."""
    n = len(inputs)
    x = (lex.embedding.take(inputs.reshape(-1), 0) @ p["a"]).reshape(n, WINDOW, WIDTH)
    x += p["p"]
    flat = x.reshape(-1, WIDTH)
    k, v = ((flat @ p["qkv"][:, i * WIDTH : (i + 1) * WIDTH]).reshape(n, WINDOW, WIDTH) for i in (1, 2))
    x = np.ascontiguousarray(x[:, skip:]).reshape(-1, WIDTH)
    q = (x @ (p["qkv"][:, :WIDTH] * np.float32(WIDTH**-0.5))).reshape(n, -1, WIDTH)
    x += (_attended(q, k, skip) @ v).reshape(-1, WIDTH) @ p["o"]
    state, target = lex.state.take(inputs[:, skip:].reshape(-1)), targets[:, skip:].reshape(-1)
    z, total = _classes(p, lex, x, state)
    own = z.reshape(-1).take(np.arange(0, z.size, CLASSES) + lex.class_.take(target))
    own -= total[:, 0]
    own += lex.weight.reshape(-1).take(state * lex.weight.shape[1] + target)
    return own.reshape(n, -1)


def gradient(p: dict[str, np.ndarray], kept: tuple, logp: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss over the places with weight 1. targets: classes."""
    given, x, q, k, v, s, mixed, h = kept
    n = len(x)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    d = np.exp(logp).reshape(-1, CLASSES)
    d.reshape(-1)[np.arange(0, d.size, CLASSES) + targets.reshape(-1)] -= 1
    d *= (weight / max(1.0, weight.sum())).reshape(-1, 1)
    g = {"w": h.T @ d, "b": (np.ones((1, len(d)), d.dtype) @ d)[0]}
    dh = d @ p["w"].T
    g["o"] = flat(mixed).T @ dh
    dm = (dh @ p["o"].T).reshape(n, WINDOW, WIDTH)
    ds = dm @ v.transpose(0, 2, 1)
    dv = s.transpose(0, 2, 1) @ dm
    ds -= np.einsum("nij,nij->ni", ds, s)[..., None]
    ds *= s
    parts = [ds @ k, ds.transpose(0, 2, 1) @ q, dv]
    parts[0] *= p["a"].dtype.type(WIDTH**-0.5)  # q is scaled already
    g["qkv"] = np.concatenate([flat(x).T @ flat(y) for y in parts], 1)
    dx = dh
    for i, y in enumerate(parts):
        dx = dx + flat(y) @ p["qkv"][:, i * WIDTH : (i + 1) * WIDTH].T
    g["p"] = dx.reshape(n, WINDOW, WIDTH).sum(0)
    g["a"] = given.T @ dx
    return g


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, params: dict[str, np.ndarray], lex: Lexicon) -> None:
        self.p = {k: v.copy() for k, v in params.items()}
        self.lex = lex
        self.m, self.v = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
        self.steps = self.windows = 0

    def step(self, inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> None:
        logp, kept = forward(self.p, self.lex, inputs)
        self.steps += 1
        self.windows += len(inputs)
        for k, g in gradient(self.p, kept, logp, self.lex.class_[targets], weight).items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= RATE * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[k] / (1 - 0.99**self.steps)) + 1e-7)


def windows(columns: np.ndarray, begin: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and weights of a text's windows; the weights mark each token in exactly one of them."""
    n = len(columns)
    count = 1 if n <= WINDOW else 1 + -(-(n - WINDOW) // stride)
    starts = np.arange(count) * stride
    padded = np.zeros(starts[-1] + WINDOW + 1, columns.dtype)
    padded[0], padded[1 : n + 1] = begin, columns
    at = starts[:, None] + np.arange(WINDOW)
    weight = at < n
    weight[1:, : WINDOW - stride] = False
    return padded[at], padded[at + 1], weight


@dataclass
class Model:
    params: dict[str, np.ndarray]
    lex: Lexicon

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text of ids; the end is among the ids."""
        if not len(texts):
            return np.empty(0)
        made = [windows(self.lex.column[t], self.lex.begin) for t in texts]
        counts = np.array([len(m[0]) for m in made])
        inputs, targets, weight = (np.concatenate([m[i] for m in made]) for i in range(3))
        firsts = np.cumsum(counts) - counts
        first = np.zeros(len(inputs), bool)
        first[firsts] = True
        sums = np.empty(len(inputs))
        for which, skip in ((np.flatnonzero(first), 0), (np.flatnonzero(~first), WINDOW - STRIDE)):
            for a in range(0, len(which), PORTION):
                at = which[a : a + PORTION]
                sums[at] = (own_log(self.params, self.lex, inputs[at], targets[at], skip) * weight[at, skip:]).sum(1, dtype=np.float64)
        return np.add.reduceat(sums, firsts) / np.log(10)
