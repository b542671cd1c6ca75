"""Gated recurrent language model in numpy with a class-factored softmax."""

from __future__ import annotations

import numpy as np

#: Output symbols: the most frequent tokens, and one for all others; CLASSES classes of equal size.
SYMBOLS, CLASSES = 4096, 64
WITHIN = SYMBOLS // CLASSES
HIDDEN = 32
#: Steps of a training window; the state is carried into the next, its gradient is not.
WINDOW = 20
#: Lanes of documents that run side by side, and symbols after which a lane's document goes on in another lane.
LANES, SEGMENT = 192, 1000
RATE = 0.1
#: Logits are clipped to this, whose exponential is still a float32; and rows whose logits are held at once.
LIMIT, ROWS = 80, 1 << 11

Params = dict[str, np.ndarray]


def initial(counts: np.ndarray) -> Params:
    """Random weights, and output biases that give each symbol its share of the counts."""
    rng = np.random.default_rng(11)
    normal = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    p = (counts + 0.5).reshape(CLASSES, WITHIN)
    return {
        "embed": normal(SYMBOLS, HIDDEN), "into": normal(HIDDEN, 3 * HIDDEN), "over": normal(HIDDEN, 3 * HIDDEN), "gate": np.zeros(3 * HIDDEN, np.float32),
        "class": normal(CLASSES, HIDDEN) * 0.1, "class_bias": np.log(p.sum(1) / p.sum()).astype(np.float32),
        "word": normal(SYMBOLS, HIDDEN) * 0.1, "word_bias": np.log(p / p.sum(1, keepdims=True)).ravel().astype(np.float32),
    }


def _gates(p: Params, name: str) -> list[np.ndarray]:
    """The update, reset and candidate parts of a matrix or bias, each contiguous, on which numpy is quickest."""
    return [np.ascontiguousarray(x) for x in np.split(p[name], 3, axis=-1)]


def _step(g: list[np.ndarray], h: np.ndarray, over: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    z, r, un = (h @ x for x in over)
    for x, y in ((z, g[0]), (r, g[1])):
        x += y
        np.negative(x, out=x)
        np.exp(x, out=x)
        x += 1
        np.reciprocal(x, out=x)
    n = r * un
    n += g[2]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, un


def _chosen(x: np.ndarray, at: np.ndarray, back: bool) -> np.ndarray:
    """Log-softmax of x at one place a row; x becomes scratch, or with back the gradient of the loss."""
    rows = np.arange(len(at))
    own = x[rows, at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    if back:
        x /= total[:, None]
        x[rows, at] -= 1
    return own - np.log(total)


def outputs(p: Params) -> tuple[np.ndarray, np.ndarray, bool]:
    """The classes' and words' weights with their biases as a last column, and if a logit may be beyond LIMIT."""
    of_class = np.concatenate([p["class"], p["class_bias"][:, None]], axis=1)
    of_word = np.concatenate([p["word"], p["word_bias"][:, None]], axis=1)
    return of_class, of_word.reshape(CLASSES, WITHIN, HIDDEN + 1), max(float(np.abs(x).sum(1).max()) for x in (of_class, of_word)) > LIMIT


def log_probs(p: Params, states: np.ndarray, targets: np.ndarray, back: bool = False, out_of: tuple | None = None) -> tuple[np.ndarray, np.ndarray | None, dict]:
    """Natural log-probability of each target; with back, the loss's gradients by states and by weights as (rows, gradient).

    Rows are of blocks of a class for the words, and None for all. States lie between -1 and 1. Logits
    that could be beyond LIMIT are clipped. out_of: outputs(p), if at hand.
    """
    of_class, of_word, clip = out_of or outputs(p)
    order = np.argsort((targets // WITHIN).astype(np.int16), kind="stable")
    t = targets[order]
    s = np.ones((len(t), HIDDEN + 1), states.dtype)
    s[:, :-1] = states[order]
    cls, at = np.divmod(t, WITHIN)
    ends = np.searchsorted(cls, np.arange(CLASSES + 1))
    live = np.flatnonzero(ends[1:] > ends[:-1])
    parts = [(c, slice(ends[c], ends[c + 1])) for c in live.tolist()]
    x = s @ of_class.T
    y = np.empty((len(t), WITHIN), x.dtype)
    for c, own in parts:
        np.matmul(s[own], of_word[c].T, out=y[own])
    if clip:
        np.clip(x, -LIMIT, LIMIT, out=x)
        np.clip(y, -LIMIT, LIMIT, out=y)
    found = _chosen(x, cls, back)
    found += _chosen(y, at, back)
    out = np.empty_like(found)
    out[order] = found
    if not back:
        return out, None, {}
    d = np.empty((len(t), HIDDEN), x.dtype)
    g = np.empty((len(live), WITHIN, HIDDEN + 1), x.dtype)
    for k, (c, own) in enumerate(parts):
        np.matmul(y[own], of_word[c, :, :-1], out=d[own])
        np.matmul(y[own].T, s[own], out=g[k])
    d += x @ of_class[:, :-1]
    by_state = np.empty_like(d)
    by_state[order] = d
    if len(live) == CLASSES:
        live = None
    by_class = x.T @ s
    return out, by_state, {"class": (None, by_class[:, :-1].copy()), "class_bias": (None, by_class[:, -1].copy()), "word": (live, g[:, :, :-1].copy()), "word_bias": (live, g[:, :, -1].copy())}


def score(p: Params, docs: list[np.ndarray], end: int, window: int = 64) -> np.ndarray:
    """Natural log-probability of each whole document; each is its symbols with the end symbol last.

    The documents run side by side, longest first; the state is carried from window to window.
    """
    out = np.zeros(len(docs))
    if not docs:
        return out
    order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
    lengths = np.array([len(docs[k]) for k in order])
    # one array, an end symbol before each document
    flat = np.concatenate([x for k in order for x in ([end], docs[k])])
    begins = np.cumsum(lengths + 1) - lengths - 1
    tables = [(p["embed"] @ x + y).astype(np.float32) for x, y in zip(_gates(p, "into"), _gates(p, "gate"), strict=True)]
    over, out_of = _gates(p, "over"), outputs(p)
    h = np.zeros((len(docs), HIDDEN), np.float32)
    most = int(lengths[0])
    for first in range(0, most, window):
        steps = min(window, most - first)
        lives = np.searchsorted(-lengths, -np.arange(first, first + steps)).tolist()
        live = lives[0]
        grid = flat[np.minimum(begins[:live, None] + np.arange(first, first + steps + 1), len(flat) - 1)].T.copy()
        states = np.empty((sum(lives), HIDDEN), np.float32)
        at = 0
        for t, n in enumerate(lives):
            h = _step([x[grid[t, :n]] for x in tables], h[:n], over)[0]
            states[at : at + n] = h
            at += n
        owners = np.concatenate([np.arange(n) for n in lives])
        targets = np.concatenate([grid[t + 1, :n] for t, n in enumerate(lives)])
        found = np.concatenate([log_probs(p, states[k : k + ROWS], targets[k : k + ROWS], out_of=out_of)[0] for k in range(0, len(states), ROWS)])
        out[:live] += np.bincount(owners, weights=found, minlength=live)
    back = np.zeros(len(docs))
    back[order] = out
    return back


class Trainer:
    """Truncated backpropagation through time with Adagrad, over lanes that each read one document after the other.

    A lane that has read its documents takes the next one, so windows stay full whatever the documents' lengths; only
    finish() runs the lanes to their unequal ends. The state is carried from window to window and starts at
    zero with each document, and where a document of more than SEGMENT symbols goes on in another lane, which
    keeps those ends close; score() carries it through whole documents.
    """

    def __init__(self, p: Params, end: int, lanes: int = LANES) -> None:
        self.p = {k: v.copy() for k, v in p.items()}
        self.seen = {k: np.full_like(v, 1e-2) for k, v in p.items()}
        self.end, self.tokens, self.lanes = end, 0, lanes
        # what the lanes are to read, from column `at` on: symbols, those before them, and where documents start
        self.at, wide = 0, 8 * (SEGMENT + WINDOW)
        self.seen_, self.targets = (np.full((lanes, wide), end, dtype=np.int32) for _ in range(2))
        self.starts = np.zeros((lanes, wide), dtype=bool)
        self.left = np.zeros(lanes, dtype=np.int64)
        self.state = np.zeros((lanes, HIDDEN), np.float32)

    def train(self, docs: list[np.ndarray]) -> None:
        """Hand documents, their symbols with the end symbol last, to the lanes with the least to read; train on full windows."""
        for d in docs:
            for first in range(0, len(d), SEGMENT):
                own = d[first : first + SEGMENT]
                k = int(self.left.argmin())
                a = self.at + int(self.left[k])
                z = a + len(own)
                self.targets[k, a:z] = own
                self.seen_[k, a + 1 : z] = own[:-1]
                self.seen_[k, a] = d[first - 1] if first else self.end
                self.starts[k, a:z] = False
                self.starts[k, a] = True
                self.left[k] += len(own)
                while self.left.min() >= WINDOW:
                    self._next(slice(None))

    def finish(self) -> None:
        while len(live := np.flatnonzero(self.left)):
            self._next(live)

    def _next(self, live: np.ndarray | slice) -> None:
        """Train on the next window of some lanes, those with anything left."""
        own = slice(self.at, self.at + WINDOW)
        held = np.arange(WINDOW) < self.left[live][:, None]
        self.state[live] = self._window(self.seen_[live, own], self.targets[live, own], held, self.starts[live, own], self.state[live])
        self.left = np.maximum(self.left - WINDOW, 0)
        self.at += WINDOW
        if self.at > 6 * (SEGMENT + WINDOW):
            # no lane has more than a segment and a window left
            most = SEGMENT + WINDOW
            for table in (self.seen_, self.targets, self.starts):
                table[:, :most] = table[:, self.at : self.at + most]
            self.at = 0

    def _window(self, seen: np.ndarray, targets: np.ndarray, held: np.ndarray, starts: np.ndarray, h: np.ndarray) -> np.ndarray:
        p, (lanes, steps) = self.p, held.shape
        carried = (~starts.T[:, :, None]).astype(np.float32)
        tokens = seen.T.ravel()
        x = p["embed"][tokens]
        into, over = _gates(p, "into"), _gates(p, "over")
        gates = [(x @ w + b).reshape(steps, lanes, -1) for w, b in zip(into, _gates(p, "gate"), strict=True)]
        before = np.empty((steps, lanes, HIDDEN), np.float32)
        states = np.empty_like(before)
        kept = []
        for t in range(steps):
            h = np.multiply(h, carried[t], out=before[t])
            h, *rest = _step([g[t] for g in gates], h, over)
            kept.append(rest)
            states[t] = h
        mask = held.T.ravel()
        count = int(mask.sum())
        states, targets = states.reshape(-1, HIDDEN), targets.T.ravel()
        if count == len(mask):
            _, full, g = log_probs(p, states, targets, True)
        else:
            _, back, g = log_probs(p, states[mask], targets[mask], True)
            full = np.zeros_like(states)
            full[mask] = back
        full = full.reshape(steps, lanes, HIDDEN)
        # gradients by what goes into the gates, and by what the state gives the candidate before the reset
        dz, dr, dn, du = (np.empty_like(before) for _ in range(4))
        back_over = [np.ascontiguousarray(w.T) for w in over]
        dh = np.zeros_like(h)
        for t in reversed(range(steps)):
            z, r, n, un = kept[t]
            dh += full[t]
            rest = dh * z
            dh -= rest
            np.multiply(n, n, out=dn[t])
            np.subtract(1, dn[t], out=dn[t])
            dn[t] *= dh
            np.subtract(before[t], n, out=n)
            n *= z
            np.multiply(n, dh, out=dz[t])
            np.multiply(dn[t], r, out=du[t])
            np.multiply(du[t], un, out=dr[t])
            np.subtract(1, r, out=r)
            dr[t] *= r
            dh = dz[t] @ back_over[0]
            dh += dr[t] @ back_over[1]
            dh += du[t] @ back_over[2]
            dh += rest
            dh *= carried[t]
        flat = before.reshape(-1, HIDDEN).T
        by = [d.reshape(-1, HIDDEN) for d in (dz, dr, dn)]
        ones = np.ones(len(tokens), np.float32)
        g |= {
            "into": (None, np.concatenate([x.T @ d for d in by], axis=1)),
            "gate": (None, np.concatenate([ones @ d for d in by])),
            "over": (None, np.concatenate([flat @ d.reshape(-1, HIDDEN) for d in (dz, dr, du)], axis=1)),
        }
        dx = by[0] @ into[0].T
        dx += by[1] @ into[1].T
        dx += by[2] @ into[2].T
        order = np.argsort(tokens.astype(np.int16), kind="stable")
        rows, first = np.unique(tokens[order], return_index=True)
        g["embed"] = (rows, np.add.reduceat(dx[order], first, axis=0))
        for k, (own, v) in g.items():
            # rows without a gradient would not change
            v *= count ** -0.5
            np.clip(v, -5, 5, out=v)
            shape = (CLASSES, WITHIN, *p[k].shape[1:]) if k in ("word", "word_bias") else p[k].shape
            weights, seen = p[k].reshape(shape), self.seen[k].reshape(shape)
            step = v * v
            if own is None:
                v = v.reshape(shape)
                seen += step.reshape(shape)
                weights -= np.divide(v, np.sqrt(seen, out=step.reshape(shape)), out=v) * RATE
            else:
                step += seen[own]
                seen[own] = step
                weights[own] -= np.divide(v, np.sqrt(step, out=step), out=v) * RATE
        self.tokens += count
        return h


def packed(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float32)


def unpacked(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out
