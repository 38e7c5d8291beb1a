"""A gated recurrent network in numpy with a class-factored softmax, for streams of symbols side by side in lanes."""

from __future__ import annotations

import heapq

import numpy as np

STATE, EMBED = 16, 16
#: Steps after which back-propagation is cut off.
WINDOW = 16
RATE, DECAY1, DECAY2 = 0.01, 0.9, 0.98


class Shape:
    """Sizes of a network: input symbols, output classes, classes with words of their own and the words in each."""

    def __init__(self, inputs: int, classes: int, worded: int, words: int):
        self.inputs, self.classes, self.worded, self.words = inputs, classes, worded, words
        self.parts, at = {}, 0
        for name, size in {
            "embed": (inputs, EMBED), "wx": (EMBED, 3 * STATE), "wh": (STATE, 3 * STATE), "b": (3 * STATE,),
            "class_w": (STATE, classes), "class_b": (classes,), "word_w": (worded, STATE, words), "word_b": (worded, words),
        }.items():
            n = int(np.prod(size))
            self.parts[name] = (at, at + n, size)
            at += n
        self.size = at

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {k: flat[a:b].reshape(size) for k, (a, b, size) in self.parts.items()}

    def start(self, class_counts: np.ndarray, word_counts: np.ndarray, seed: int = 3) -> np.ndarray:
        """Parameters at the start: outputs have the frequencies of classes, and of words in their class."""
        flat = (np.random.default_rng(seed).standard_normal(self.size) * 0.15).astype(np.float32)
        p = self.views(flat)
        p["b"][:], p["class_w"][:], p["word_w"][:] = 0, 0, 0
        p["class_b"][:] = np.log(class_counts + 0.5) - np.log(class_counts.sum() + 0.5)
        p["word_b"][:] = np.log(word_counts + 1e-6)
        return flat


class Lanes:
    """Streams of symbols of documents one after another, of about equal length, the longest first."""

    def __init__(self, lengths: np.ndarray, lanes: int):
        order = np.argsort(-lengths, kind="stable")
        heap = [(0, k) for k in range(min(lanes, max(len(lengths), 1)))]
        put: list[list[int]] = [[] for _ in heap]
        for d in order:
            n, k = heapq.heappop(heap)
            put[k].append(int(d))
            heapq.heappush(heap, (n + int(lengths[d]), k))
        self.docs = sorted(put, key=lambda ds: -sum(int(lengths[d]) for d in ds))
        self.sizes = np.array([sum(int(lengths[d]) for d in ds) for ds in self.docs], np.int64)

    def laid(self, first: np.ndarray) -> np.ndarray:
        """Places of the symbols, a row for each lane, -1 where a lane is over."""
        out = np.full((len(self.docs), int(self.sizes.max(initial=0))), -1, np.int32)
        for k, ds in enumerate(self.docs):
            if ds:
                out[k, : self.sizes[k]] = np.concatenate([np.arange(first[d], first[d + 1]) for d in ds])
        return out


def _run(p: dict, table: np.ndarray, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, back: bool = True) -> tuple[np.ndarray, list]:
    """States after each step (steps, lanes, STATE), and what a step back needs.

    table: the gates' input of each symbol; x: input symbols; fresh: 0 at a start.
    """
    gates, wh = table[x], p["wh"]
    states, kept = np.empty((*x.shape, STATE), np.float32), []
    for t in range(len(x)):
        h = h * fresh[t][:, None]
        u = h @ wh
        zr = gates[t, :, : 2 * STATE] + u[:, : 2 * STATE]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r, un = zr[:, :STATE], zr[:, STATE:], u[:, 2 * STATE :]
        n = np.tanh(gates[t, :, 2 * STATE :] + r * un)
        if back:
            kept.append((h, z, r, un, n))
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _softmax(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (in place), and the logarithm of the sum."""
    top = a.max(1, keepdims=True)
    a -= top
    e = np.exp(a)
    s = e.sum(1, keepdims=True)
    e /= s
    return e, (np.log(s) + top)[:, 0]


def score(shape: Shape, flat: np.ndarray, symbols: np.ndarray, classes: np.ndarray, words: np.ndarray, first: np.ndarray, begin: int, lanes: int = 384, steps: int = 32) -> np.ndarray:
    """Natural log probability of each symbol's class, and of its word where the class has words, given all before it.

    A document's state starts at zero with the symbol `begin` and is carried through it to its end.
    """
    p = shape.views(flat)
    out = np.zeros(len(symbols), np.float64)
    laid = Lanes(np.diff(first), lanes)
    places = laid.laid(first)
    before = np.empty(len(symbols), np.int32)
    if len(symbols):
        before[1:] = symbols[:-1]
        before[first[:-1]] = begin
    starts = np.zeros(len(symbols), bool)
    starts[first[:-1]] = True
    h = np.zeros((len(places), STATE), np.float32)
    table = p["embed"] @ p["wx"] + p["b"]
    for at in range(0, places.shape[1], steps):
        live = int(np.searchsorted(-laid.sizes, -at, "left"))
        cut = places[:live, at : at + steps].T
        there = cut >= 0
        states, _ = _run(p, table, before[cut], (~starts[cut]).astype(np.float32), h[:live], back=False)
        h = states[-1]
        where, s = cut[there], states[there]
        a = s @ p["class_w"] + p["class_b"]
        k = classes[where]
        chosen = a[np.arange(len(a)), k]
        top = a.max(1)
        a -= top[:, None]
        np.exp(a, out=a)
        got = (chosen - top - np.log(a.sum(1))).astype(np.float64)
        own = np.flatnonzero(k < shape.worded)
        own = own[np.argsort(k[own], kind="stable")]
        edges = np.searchsorted(k[own], np.arange(shape.worded + 1))
        for c in np.flatnonzero(np.diff(edges)):
            rows = own[edges[c] : edges[c + 1]]
            e = s[rows] @ p["word_w"][c] + p["word_b"][c]
            w = e[np.arange(len(rows)), words[where[rows]]]
            top = e.max(1)
            got[rows] += w - top - np.log(np.exp(e - top[:, None]).sum(1))
        out[where] = got
    return out


class Trainer:
    """Adam on truncated windows; take() learns from documents once, in order of their lanes."""

    def __init__(self, shape: Shape, flat: np.ndarray, lanes: int = 384, rate: float = RATE):
        self.shape, self.flat, self.lanes, self.rate = shape, flat.copy(), lanes, rate
        self.m, self.v, self.t, self.seen = np.zeros_like(flat), np.zeros_like(flat), 0, 0

    def take(self, symbols: np.ndarray, classes: np.ndarray, words: np.ndarray, first: np.ndarray, begin: int) -> None:
        laid = Lanes(np.diff(first), self.lanes)
        places = laid.laid(first)
        before = np.empty(len(symbols), np.int32)
        before[1:] = symbols[:-1]
        before[first[:-1]] = begin
        starts = np.zeros(len(symbols), bool)
        starts[first[:-1]] = True
        h = np.zeros((len(places), STATE), np.float32)
        steps = WINDOW
        at = 0
        while at < places.shape[1]:
            live = int(np.searchsorted(-laid.sizes, -at, "left"))
            steps = WINDOW * max(1, min(8, self.lanes // (4 * live)))  # few long streams are left: longer windows
            cut = places[:live, at : at + steps].T
            h = self._window(cut, before, starts, classes, words, h[:live])
            at += steps
        self.seen += len(symbols)

    def _window(self, cut, before, starts, classes, words, h) -> np.ndarray:
        shape, p = self.shape, self.shape.views(self.flat)
        grad = np.zeros_like(self.flat)
        g = shape.views(grad)
        there, x, fresh = cut >= 0, before[cut], (~starts[cut]).astype(np.float32)
        states, kept = _run(p, p["embed"] @ p["wx"] + p["b"], x, fresh, h)
        where, s = cut[there], states[there]
        n = len(where)
        e, _ = _softmax(s @ p["class_w"] + p["class_b"])
        k = classes[where]
        e[np.arange(n), k] -= 1
        e /= n
        g["class_w"][:] = s.T @ e
        g["class_b"][:] = e.sum(0)
        ds = e @ p["class_w"].T
        own = np.flatnonzero(k < shape.worded)
        own = own[np.argsort(k[own], kind="stable")]
        edges = np.searchsorted(k[own], np.arange(shape.worded + 1))
        for c in np.flatnonzero(np.diff(edges)):
            rows = own[edges[c] : edges[c + 1]]
            sc = s[rows]
            e, _ = _softmax(sc @ p["word_w"][c] + p["word_b"][c])
            e[np.arange(len(rows)), words[where[rows]]] -= 1
            e /= n
            g["word_w"][c] = sc.T @ e
            g["word_b"][c] = e.sum(0)
            ds[rows] += e @ p["word_w"][c].T
        back = np.zeros(states.shape, np.float32)
        back[there] = ds
        dgates = np.empty((*x.shape, 3 * STATE), np.float32)
        dh = np.zeros_like(h)
        wh_t = np.ascontiguousarray(p["wh"].T)
        us, hs = np.empty_like(dgates), np.empty(states.shape, np.float32)
        for t in range(len(x) - 1, -1, -1):
            h0, z, r, un, nn = kept[t]
            dh += back[t]
            dn = dh * (1 - z) * (1 - nn * nn)
            d = dgates[t]
            d[:, :STATE] = dh * (h0 - nn) * z * (1 - z)
            d[:, STATE : 2 * STATE] = dn * un * r * (1 - r)
            d[:, 2 * STATE :] = dn
            us[t] = d
            us[t, :, 2 * STATE :] *= r
            hs[t] = h0
            dh = (dh * z + us[t] @ wh_t) * fresh[t][:, None]
        flat_d = dgates.reshape(-1, 3 * STATE)
        g["wh"][:] = hs.reshape(-1, STATE).T @ us.reshape(-1, 3 * STATE)
        g["b"][:] = flat_d.sum(0)
        # By input symbol, summed before the product.
        xs = x.ravel()
        order = np.argsort(xs, kind="stable")
        names, begins = np.unique(xs[order], return_index=True)
        by_symbol = np.add.reduceat(flat_d[order], begins, axis=0)
        g["embed"][names] = by_symbol @ p["wx"].T
        g["wx"][:] = p["embed"][names].T @ by_symbol
        self.t += 1
        self.m *= DECAY1
        self.m += (1 - DECAY1) * grad
        self.v *= DECAY2
        self.v += (1 - DECAY2) * grad * grad
        step = self.rate / (1 - DECAY1**self.t)
        self.flat -= step * self.m / (np.sqrt(self.v / (1 - DECAY2**self.t)) + 1e-7)
        return states[-1]
