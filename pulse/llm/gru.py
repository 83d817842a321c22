"""A gated recurrent language model in numpy, with a class-factored softmax over slots.

A slot is a frequent word or a class of all other words that share an ending.  Frequent words are dealt into classes of
``CLASS_WORDS`` by rank; P(word) = P(class | state) * P(word | class, state).  A class of rare words is a class of its
own.  Biases start at the slots' corpus frequencies, so the untrained model is the unigram model of the slots.
"""

from __future__ import annotations

import heapq
from math import prod

import numpy as np

CLASS_WORDS = 64
HIDDEN = 24
WINDOW = 24         # steps of truncated backpropagation, and of scoring
LANES = 256         # documents trained at once
PIECE = 1024        # tokens over which training carries the state; scoring carries it through whole documents
RATE = 0.08
ROWS = 1 << 14      # output rows computed at once


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


SAFE = 60.0         # e to the power of this, summed over a row, is far from the ends of float32


def _exp_sums(x: np.ndarray) -> np.ndarray:
    """``x`` becomes e to its power; returns the rows' sums."""
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def _log_prob(x: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
    """The log of the softmax of each row at one place; ``x`` is overwritten.  The greatest of a row is taken off it first,
    unless it is ``safe`` without."""
    if not safe:
        x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(at)), at]
    return own - np.log(_exp_sums(x))


def _softmax_less(x: np.ndarray, at: np.ndarray, n: np.floating, safe: bool) -> np.ndarray:
    """The gradient of the mean of n negative log softmaxes; ``x`` is overwritten."""
    if not safe:
        x -= x.max(axis=1, keepdims=True)
    x *= (1 / (_exp_sums(x) * n))[:, None]
    x[np.arange(len(at)), at] -= 1 / n
    return x


def _is_safe(h: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no logit of the states ``h`` is above ``SAFE`` and none that is its row's greatest below -``SAFE``; the last axis of
    ``bias`` is a row."""
    if not bias.size:
        return True
    reach = np.abs(h).max(initial=0) * weights
    return bool((bias + reach).max() < SAFE and (bias - reach).max(axis=-1).min() > -SAFE)


FEW = 8             # rows of one sum that are added one by one, all sums at once


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows`` in order, and the sum of their values."""
    small = rows.astype(np.int16) if rows.max(initial=0) < 1 << 15 else rows       # a radix sort
    order = np.argsort(small, kind="stable")
    own = rows[order]
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    counts = np.diff(np.append(heads, len(own)))
    values = values[order]
    sums = values[heads]
    for j in range(1, FEW):
        more = np.flatnonzero((counts > j) & (counts <= FEW))
        sums[more] += values[heads[more] + j]
    ones = np.ones(counts.max(initial=0), values.dtype)
    for i in np.flatnonzero(counts > FEW).tolist():
        lo, n = heads[i], counts[i]
        np.matmul(ones[:n], values[lo:lo + n], out=sums[i])
    return own[heads], sums


class GatedModel:
    """Slots 0 to words - 1 are words, the next ``rare`` ones classes of rare words; slot words + rare is the start."""

    def __init__(self, word_counts: np.ndarray, rare_counts: np.ndarray, hidden: int = HIDDEN, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.words, self.rare, self.hidden = len(word_counts), len(rare_counts), hidden
        self.classes = -(-self.words // CLASS_WORDS)
        padded = np.zeros(self.classes * CLASS_WORDS)
        padded[:self.words] = word_counts + 1.0
        table = padded.reshape(self.classes, CLASS_WORDS)
        mass = np.concatenate([table.sum(axis=1), rare_counts + 1.0])

        self.spaces: dict[str, np.ndarray] = {}

        def small(*shape):
            return (rnd.standard_normal(shape) * 0.1).astype(np.float32)
        with np.errstate(divide="ignore"):
            inside = np.log(table / np.maximum(table.sum(axis=1, keepdims=True), 1e-300))
        self.p = {
            "inputs": small(self.words + self.rare + 1, 3 * hidden),
            "recur": small(hidden, 3 * hidden),
            "out_class": small(hidden, self.classes + self.rare) * 0.1,
            "bias_class": np.log(mass / mass.sum()).astype(np.float32),
            "out_word": small(self.classes, CLASS_WORDS, hidden) * 0.1,
            "bias_word": np.maximum(inside, -60).astype(np.float32),
        }

    @property
    def start(self) -> int:
        return self.words + self.rare

    def class_of(self, slots: np.ndarray) -> np.ndarray:
        return np.where(slots < self.words, slots // CLASS_WORDS, slots - self.words + self.classes)

    def step(self, h: np.ndarray, x: np.ndarray, after: np.ndarray | None = None):
        """One token of every lane; returns the new state (in ``after``, if given) and the gates (till the next step).

        States are rows, but lie in memory with a lane a column: every operation then runs over whole lines of lanes."""
        k, n = self.hidden, len(x)
        rows, a, b = self._space("rows", n, 3 * k), self._space("a", 3 * k, n), self._space("b", 3 * k, n)
        np.take(self.p["inputs"], x, axis=0, out=rows, mode="clip")
        np.copyto(a, rows.T)
        after = np.empty((k, n), a.dtype) if after is None else after
        self._advance(self.p["recur"].T, h.T, a, b, after)
        return after.T, a

    def _advance(self, recur: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray, after: np.ndarray) -> None:
        """``after`` the token whose inputs are ``a``, which becomes the gates; ``b`` the part of the state ``h``."""
        k = self.hidden
        np.matmul(recur, h, out=b)
        gates, new = a[:2 * k], a[2 * k:]
        gates += b[:2 * k]
        _sigmoid(gates)
        np.multiply(gates[k:], b[2 * k:], out=after)
        new += after
        np.tanh(new, out=new)
        np.subtract(h, new, out=after)
        after *= gates[:k]
        after += new

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """An array kept for the next window: new memory would cost as much as filling it."""
        kind, size = self.p["inputs"].dtype, prod(shape)
        held = self.spaces.get(name)
        if held is None or held.size < size or held.dtype != kind:
            held = self.spaces[name] = np.empty(size, kind)
        return held[:size].reshape(shape)

    def log_probs(self, h: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Natural log P(slot | state) of each row."""
        out = np.empty(len(slots))
        safe_class, safe_word = self._safe(h)
        for lo in range(0, len(slots), ROWS):
            order, cls, edges = self._by_class(slots[lo:lo + ROWS])
            rows, at = h[lo + order], slots[lo + order]
            logits = self._class_logits(rows)
            part = _log_prob(logits, cls, safe_class).astype(float)
            words = edges[-1][2] if edges else 0
            part[:words] += _log_prob(self._word_logits(rows, edges, words), at[:words] % CLASS_WORDS, safe_word)
            out[lo + order] = part
        return out

    def _safe(self, h: np.ndarray) -> tuple[bool, bool]:
        p = self.p
        return (_is_safe(h, np.abs(p["out_class"]).sum(axis=0), p["bias_class"]),
                _is_safe(h, np.abs(p["out_word"]) @ np.ones(self.hidden, p["out_word"].dtype), p["bias_word"]))

    def _by_class(self, slots: np.ndarray):
        """The rows' order by class, their classes in it, and (class, first, end) of every word class; these come first."""
        cls = self.class_of(slots)
        order = np.argsort(cls.astype(np.int16), kind="stable")     # a radix sort; classes are few
        cls = cls[order]
        edges = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        return order, cls, [(c, a, b) for c, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]

    def _class_logits(self, h: np.ndarray) -> np.ndarray:
        out = np.matmul(h, self.p["out_class"], out=self._space("classes", len(h), self.classes + self.rare))
        out += self.p["bias_class"]
        return out

    def _word_logits(self, h: np.ndarray, edges: list[tuple[int, int, int]], words: int) -> np.ndarray:
        """Of every word row, in the order of ``_by_class``: the logits of its class."""
        out = self._space("words", words, CLASS_WORDS)
        for c, a, b in edges:
            np.matmul(h[a:b], self.p["out_word"][c].T, out=out[a:b])
            out[a:b] += self.p["bias_word"][c]
        return out

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each slot sequence, the state carried through the whole of it."""
        sizes = np.array([len(d) for d in docs], np.int64)
        total = np.zeros(len(docs))
        if not len(docs) or not sizes.max():
            return total
        order = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes[order])
        begins, rising = ends - sizes[order], np.sort(sizes)
        stream = np.concatenate([docs[i] for i in order])
        state = np.zeros((self.hidden, len(docs)), np.float32).T
        last = np.full(len(docs), self.start)
        longest, held = int(sizes.max()), 0
        states = self._space("states", ROWS + len(docs), self.hidden)
        targets, lanes = (np.empty(ROWS + len(docs), np.int64) for _ in range(2))
        for t, n in enumerate((len(docs) - np.searchsorted(rising, np.arange(longest), side="right")).tolist()):
            # n lanes have a token t
            state, _ = self.step(state[:n], last[:n], self._space(f"after {t % 2}", self.hidden, n))
            last = stream[begins[:n] + t]
            here = slice(held, held + n)
            states[here], targets[here], lanes[here] = state, last, np.arange(n)
            held += n
            if held >= ROWS or t + 1 == longest:
                total += np.bincount(lanes[:held], self.log_probs(states[:held], targets[:held]), len(docs))
                held = 0
        out = np.empty_like(total)
        out[order] = total
        return out

    def squares(self) -> dict[str, np.ndarray]:
        """The step sizes' state before training."""
        return {k: np.full_like(v, 1e-6) for k, v in self.p.items()}

    def train(self, docs: list[np.ndarray], rate: float = RATE, squares: dict[str, np.ndarray] | None = None) -> None:
        """One pass of truncated backpropagation: ``LANES`` documents side by side, windows of ``WINDOW`` steps.

        A lane takes up the next document (or ``PIECE`` tokens of a longer one) when one ends; the state then starts anew, else it is
        carried on.  Every token teaches.  Lanes
        end at their own length; windows in which some have ended move the weights by the share of tokens that is left.
        ``squares`` carries the step sizes on from an earlier call.
        """
        squares = self.squares() if squares is None else squares
        # pieces of long documents are dealt like documents of their own, or one of them would keep a few lanes busy alone
        docs = [d[lo:lo + PIECE] for d in docs for lo in range(0, len(d), PIECE)]
        lanes = min(LANES, max(1, len(docs)))
        streams = [[] for _ in range(lanes)]
        loads = [(0, lane) for lane in range(lanes)]
        for d in sorted(docs, key=len, reverse=True):       # the longest first, to the shortest lane
            held, lane = heapq.heappop(loads)
            streams[lane] += [np.array([-1]), d]            # -1: a document starts
            heapq.heappush(loads, (held + len(d) + 1, lane))
        rnd = np.random.default_rng(11)
        for s in streams:
            pairs = [s[i:i + 2] for i in range(0, len(s), 2)]
            s[:] = [x for i in rnd.permutation(len(pairs)) for x in pairs[i]]
        streams = [np.concatenate(s) if s else np.zeros(0, np.int64) for s in streams]
        streams.sort(key=len, reverse=True)
        sizes = np.array([len(s) for s in streams])
        tokens = np.full((lanes, -(-int(sizes.max(initial=0)) // WINDOW) * WINDOW), -2)     # -2: the lane has ended
        for lane, s in enumerate(streams):
            tokens[lane, :len(s)] = s
        state = np.zeros((lanes, self.hidden), np.float32)
        last = np.full(lanes, self.start)
        every = tokens
        for lo in range(0, every.shape[1], WINDOW):
            live = int((sizes > lo).sum())
            tokens = every[:live, lo:lo + WINDOW]
            grads, state, last = self._window(tokens, state[:live], last[:live])
            share = np.float32((tokens >= 0).sum() / (lanes * WINDOW))
            for k, g in grads.items():
                rows, g = g if isinstance(g, tuple) else (slice(None), g)       # rows of a table, or all
                own = squares[k][rows]
                own += g * g
                squares[k][rows] = own
                g *= share * rate
                g /= np.sqrt(own)
                self.p[k][rows] -= g

    def _window(self, tokens: np.ndarray, state: np.ndarray, last: np.ndarray):
        """(gradients, state, last token) of every lane; -1: a document starts, -2: the lane has ended."""
        k, p, targets = self.hidden, self.p, np.ascontiguousarray(tokens.T)
        size, lanes = targets.shape
        opens = targets == -1           # the state starts anew: what such a lane computes in this step counts for nothing
        opening = opens.any(axis=1)
        said = np.where(targets < 0, self.start, targets)
        fed = np.concatenate([last[None], said[:-1]])
        rows = self._space("rows", size * lanes, 3 * k)
        np.take(p["inputs"], fed.ravel(), axis=0, out=rows, mode="clip")
        by_lane = rows.reshape(size, lanes, 3 * k).transpose(0, 2, 1)
        a, b = (self._space(name, size, 3 * k, lanes) for name in "ab")         # lanes along the last axis
        np.copyto(a, by_lane)
        states, recur = self._space("states", size + 1, k, lanes), np.ascontiguousarray(p["recur"].T)
        states[0] = state.T
        for t in range(size):
            self._advance(recur, states[t], a[t], b[t], states[t + 1])
            if opening[t]:
                states[t + 1][:, opens[t]] = 0
        live = np.flatnonzero(targets.ravel() >= 0)
        order, cls, edges = self._by_class(targets.ravel()[live])
        place = live[order]             # of every row, sorted by class, among all steps' lanes
        every = self._space("every", size, lanes, k)
        np.copyto(every, states[1:].transpose(0, 2, 1))
        every = every.reshape(size * lanes, k)
        h, slots, n = every[place], targets.ravel()[place], every.dtype.type(max(1, len(live)))
        safe_class, safe_word = self._safe(h)
        d_class = _softmax_less(self._class_logits(h), cls, n, safe_class)
        d_h = d_class @ p["out_class"].T
        ones = np.ones(len(h), h.dtype)
        grads = {"out_class": h.T @ d_class, "bias_class": ones @ d_class}
        if edges:
            words = edges[-1][2]
            d_word = _softmax_less(self._word_logits(h, edges, words), slots[:words] % CLASS_WORDS, n, safe_word)
            d_out, d_bias = np.empty((len(edges), CLASS_WORDS, k), h.dtype), np.empty((len(edges), CLASS_WORDS), h.dtype)
            for i, (c, lo, hi) in enumerate(edges):
                np.matmul(d_word[lo:hi].T, h[lo:hi], out=d_out[i])
                np.matmul(ones[lo:hi], d_word[lo:hi], out=d_bias[i])
                d_h[lo:hi] += d_word[lo:hi] @ p["out_word"][c]
            seen = np.array([c for c, _, _ in edges])
            grads |= {"out_word": (seen, d_out), "bias_word": (seen, d_bias)}
        every[:] = 0
        every[place] = d_h
        d_h = self._space("d_h", size, k, lanes)
        np.copyto(d_h, every.reshape(size, lanes, k).transpose(0, 2, 1))
        keep, reset, new, before = a[:, :k], a[:, k:2 * k], a[:, 2 * k:], states[:-1]
        rest, by_keep, by_reset, by_new, d_new = (self._space(name, size, k, lanes) for name in ("rest", "keep", "reset", "new", "d_new"))
        np.subtract(1, keep, out=rest)
        np.subtract(before, new, out=by_keep)
        by_keep *= keep
        by_keep *= rest
        np.multiply(new, new, out=by_new)
        np.subtract(1, by_new, out=by_new)
        by_new *= rest
        np.subtract(1, reset, out=by_reset)
        by_reset *= reset
        by_reset *= b[:, 2 * k:]
        d_b, carry = b, np.zeros_like(d_h[0])       # over what is no longer needed
        for t in range(size - 1, -1, -1):
            d, db, dn = d_h[t], d_b[t], d_new[t]
            d += carry
            if opening[t]:
                d[:, opens[t]] = 0
            np.multiply(d, by_keep[t], out=db[:k])
            np.multiply(d, by_new[t], out=dn)
            np.multiply(dn, by_reset[t], out=db[k:2 * k])
            np.multiply(dn, reset[t], out=db[2 * k:])
            np.matmul(p["recur"], db, out=carry)
            d *= keep[t]
            carry += d
        d_recur = np.matmul(before, d_b.transpose(0, 2, 1)).sum(axis=0)
        np.copyto(by_lane[:, :2 * k], d_b[:, :2 * k])
        np.copyto(by_lane[:, 2 * k:], d_new)
        grads |= {"recur": d_recur, "inputs": _row_sums(fed.ravel(), rows)}
        return grads, states[-1].T.copy(), said[-1].copy()
