"""A small gated recurrent language model in numpy.

Outputs are factored: first a class, then, for classes of frequent words, the word within the class. Inputs and outputs share one
numbering: words 0 to WORDS - 1 by falling frequency, WIDTH of them to a class, then one number for each class of rare words, whose
members the caller tells apart. Texts run side by side in lanes, one after the other in each. Scoring carries the state through
whole documents. Training cuts gradients at the edges of windows of WINDOW steps, and reads a document in stretches of STRETCH
numbers, each from an empty state, so that a long document fills many lanes instead of keeping one busy alone.
"""

from __future__ import annotations

from heapq import heapreplace

import numpy as np

WORDS, WIDTH, RARE = 2048, 32, 16
HEADS = WORDS // WIDTH
EMBED, HIDDEN = 8, 16
WINDOW, STRETCH = 16, 512
#: States whose classes are worked out at a time.
NEAR = 1024
#: Exponents of less than this, either way, are far from what a number can't hold.
SAFE = 60
TINY = np.float32(1e-30)
SHAPES = {"E": (WORDS + RARE, EMBED), "Wx": (EMBED, 3 * HIDDEN), "bx": (3 * HIDDEN,), "U": (HIDDEN, 3 * HIDDEN), "Wc": (HIDDEN, HEADS + RARE), "bc": (HEADS + RARE,), "Ww": (WORDS, HIDDEN), "bw": (WORDS,)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

Params = dict[str, np.ndarray]


def initial(word_counts: np.ndarray, rare_mass: np.ndarray, seed: int = 5) -> Params:
    """A model that knows how often words and classes occur, and nothing of their order yet."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    p["bx"][:] = 0
    p["Wc"] *= 0.1
    p["Ww"] *= 0.1
    words = np.zeros(WORDS)
    words[: len(word_counts)] = word_counts
    heads = words.reshape(HEADS, WIDTH).sum(1)
    p["bc"] = np.log(np.r_[heads, rare_mass] + 1e-3).astype(np.float32)
    p["bc"] -= p["bc"].mean()
    p["bw"] = np.log(words + 1e-9).astype(np.float32)
    p["bw"] -= np.repeat(np.log(heads + 1e-9), WIDTH).astype(np.float32)
    return p


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflat(values: np.ndarray) -> Params:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _class(y: np.ndarray) -> np.ndarray:
    return np.where(y < WORDS, y // WIDTH, y - WORDS + HEADS)


class Lanes:
    """Texts (each a start and a size in one array of numbers) side by side: each lane holds one after the other, every text begins
    with an empty state. Lanes stand by falling length, so that those still running are a prefix. Row t of `targets` is step t."""

    def __init__(self, numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lanes: int, begin: int):
        ends = [(0, i) for i in range(max(1, min(lanes, len(sizes))))]
        lane, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for i in np.argsort(-sizes, kind="stable").tolist():  # the longest first, to the shortest lane
            end, k = ends[0]
            lane[i], place[i] = k, end
            heapreplace(ends, (end + int(sizes[i]), k))
        lengths = np.zeros(len(ends), np.int64)
        for end, k in ends:
            lengths[k] = end
        order = np.argsort(-lengths, kind="stable")
        at = np.empty_like(order)
        at[order] = np.arange(len(order))
        lane, lengths = at[lane], lengths[order]
        self.width, self.steps = len(lengths), int(lengths.max(initial=0))
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(self.steps), "right")
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        where = (np.repeat(place, sizes) + inside) * self.width + np.repeat(lane, sizes)
        self.targets, self.owner = np.zeros((self.steps, self.width), np.int32), np.zeros((self.steps, self.width), np.int32)
        self.targets.ravel()[where] = numbers[np.repeat(starts, sizes) + inside]
        self.owner.ravel()[where] = np.repeat(np.arange(len(sizes)), sizes)
        first = np.zeros((self.steps, self.width), bool)
        first.ravel()[where[inside == 0]] = True
        self.inputs = np.full_like(self.targets, begin)
        self.inputs[1:] = np.where(first[1:], begin, self.targets[:-1])
        self.going, self.starting = (~first).astype(np.float32), first.any(1)


def _joint(p: Params) -> np.ndarray:
    """All weights of a step in one matrix: rows for what the reset gate is applied to, for both gates (negated, as their exponent
    takes them) and for the inputs' part of the new content; columns for the state, the input and one."""
    w, gates = np.zeros((4 * HIDDEN, HIDDEN + EMBED + 1), np.float32), slice(HIDDEN, 3 * HIDDEN)
    w[:HIDDEN, :HIDDEN] = p["U"][:, 2 * HIDDEN :].T
    w[HIDDEN:, HIDDEN:-1] = p["Wx"].T
    w[HIDDEN:, -1] = p["bx"]
    w[gates, :HIDDEN] = p["U"][:, : 2 * HIDDEN].T
    w[gates] *= -1
    return w


def _blocks(p: Params, xs: np.ndarray, counts: list[int]) -> list[np.ndarray]:
    """For each of some steps, with as many lanes each, what _joint is applied to: rows for the state (left open), the input and
    one, a column for each lane. Each step's block is in one piece of memory, in an array for all."""
    size, begin, out = HIDDEN + EMBED + 1, 0, []
    every, looked_up = np.empty(size * len(xs), np.float32), p["E"][xs]
    for n in counts:
        block = every[size * begin : size * (begin + n)].reshape(size, n)
        block[HIDDEN:-1] = looked_up[begin : begin + n].T
        block[-1] = 1
        out.append(block)
        begin += n
    return out


def _step(w: np.ndarray, a: np.ndarray, before: np.ndarray):
    """The gates z and r in one array, the new content, what the reset gate is applied to, and the next state; a column for each
    lane. a: the step's block; before: its rows for the state."""
    b = w @ a
    q, gates, new = b[:HIDDEN], b[HIDDEN : 3 * HIDDEN], b[3 * HIDDEN :]
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    h = gates[HIDDEN:] * q
    new += h
    np.tanh(new, out=new)
    np.subtract(before, new, out=h)
    h *= gates[:HIDDEN]
    h += new
    return gates, new, q, h


def _with_one(states: np.ndarray) -> np.ndarray:
    """The states, a row each, and a one that carries the biases."""
    out = np.ones((len(states), HIDDEN + 1), np.float32)
    out[:, :HIDDEN] = states
    return out


class Outputs:
    """Weights of the classes and of their members with the biases as a last column. States are between -1 and 1, so that sums of
    weights tell whether exponents are safe as they are; else the largest of each row is taken off first."""

    def __init__(self, p: Params):
        self.classes = np.concatenate([p["Wc"].T, p["bc"][:, None]], 1, dtype=np.float32)
        self.members = np.concatenate([p["Ww"], p["bw"][:, None]], 1, dtype=np.float32)
        self.safe = [float(np.abs(w).sum(1).max()) < SAFE for w in (self.classes, self.members)]

    def shares(self, e: np.ndarray, of_members: bool) -> np.ndarray:
        """Exponents become shares in place, not yet divided by their sums, which are returned."""
        if not self.safe[of_members]:
            e -= e.max(1, keepdims=True)
        np.exp(e, out=e)
        return e @ np.ones(e.shape[1], np.float32)

    def of_members(self, own: np.ndarray, parts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the members of each state's class (a row for each state), and the sums. own: the states, ordered by class."""
        e = np.empty((len(own), WIDTH), np.float32)
        for c, a, b in parts:
            np.matmul(own[a:b], self.members[c * WIDTH : (c + 1) * WIDTH].T, out=e[a:b])
        return e, self.shares(e, True)


def _by_class(ys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The places that hold words, ordered by class; their numbers; and for each class its stretch of them."""
    at = np.flatnonzero(ys < WORDS)
    at = at[np.argsort((ys[at] // WIDTH).astype(np.int16), kind="stable")]
    y = ys[at]
    ends = np.cumsum(np.bincount(y // WIDTH, minlength=HEADS)).tolist()
    return at, y, [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]


def log_probs(p: Params, states: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Natural logarithm of each y's probability after the states."""
    outputs, states, kind, out = Outputs(p), _with_one(states), _class(ys), np.empty(len(ys), np.float32)
    for i in range(0, len(ys), NEAR):  # as many at a time as stay in the processor's cache
        e = states[i : i + NEAR] @ outputs.classes.T
        total = outputs.shares(e, False)
        out[i : i + NEAR] = np.log(np.maximum(e[np.arange(len(e)), kind[i : i + NEAR]], TINY)) - np.log(total)
    at, y, parts = _by_class(ys)
    e, total = outputs.of_members(states[at], parts)
    out[at] += np.log(np.maximum(e[np.arange(len(y)), y % WIDTH], TINY)) - np.log(total)
    return out


def log_likelihood(p: Params, docs: list[np.ndarray], begin: int, together: int = 8192) -> np.ndarray:
    """Natural logarithm of each whole document's probability, its state carried from its first to its last number."""
    if not docs:
        return np.zeros(0)
    sizes = np.array([len(d) for d in docs], np.int64)
    side = Lanes(np.concatenate(docs), np.cumsum(sizes) - sizes, sizes, int(np.clip(sizes.sum() // sizes.max(), 16, 512)), begin)
    w, h, total = _joint(p), np.zeros((HIDDEN, side.width), np.float32), np.zeros(len(docs))
    ends, t = np.cumsum(side.active), 0
    with np.errstate(over="ignore"):
        while t < side.steps:
            stop = max(t + 1, int(np.searchsorted(ends, ends[t] - side.active[t] + together, "right")))
            rows, end = [(s, int(side.active[s])) for s in range(t, stop)], 0
            xs = np.concatenate([side.inputs[s, :n] for s, n in rows])
            states = np.empty((len(xs), HIDDEN), np.float32)
            for (s, n), block in zip(rows, _blocks(p, xs, [n for _, n in rows])):
                np.multiply(h[:, :n], side.going[s, :n], out=block[:HIDDEN])
                h = _step(w, block, block[:HIDDEN])[-1]
                states[end : end + n] = h.T
                end += n
            ys = np.concatenate([side.targets[s, :n] for s, n in rows])
            of = np.concatenate([side.owner[s, :n] for s, n in rows])
            total += np.bincount(of, log_probs(p, states, ys), len(docs))
            t = stop
    return total


class Trainer:
    """Adagrad steps on windows; keeps its own copy of the parameters and of the sums of squared gradients."""

    def __init__(self, p: Params, past: Params, rate: float = 0.05):
        self.p, self.past, self.rate = {k: v.copy() for k, v in p.items()}, {k: v.copy() for k, v in past.items()}, rate

    def _move(self, k: str, g: np.ndarray) -> None:
        past, step = self.past[k], g * g
        past += step
        np.sqrt(past, out=step)
        np.divide(g, step, out=step)
        step *= self.rate
        self.p[k] -= step

    def fit(self, numbers: np.ndarray, sizes: np.ndarray, begin: int) -> None:
        """One pass of truncated backpropagation over texts that stand one after the other in `numbers`, in stretches."""
        starts = np.cumsum(sizes) - sizes
        cuts = -(-sizes // STRETCH)
        inside = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begins = np.repeat(starts, cuts) + inside * STRETCH
        parts = np.minimum(STRETCH, np.repeat(starts + sizes, cuts) - begins)
        side = Lanes(numbers, begins, parts, int(np.clip(len(numbers) // 2048, 16, 256)), begin)
        h = np.zeros((HIDDEN, side.width), np.float32)
        with np.errstate(over="ignore"):
            for t in range(0, side.steps, WINDOW):
                h = self._window(side, h, range(t, min(t + WINDOW, side.steps)))

    def _window(self, side: Lanes, h: np.ndarray, steps: range) -> np.ndarray:
        p, H, w, outputs = self.p, HIDDEN, _joint(self.p), Outputs(self.p)
        counts = side.active[steps.start : steps.stop].tolist()
        xs = np.concatenate([side.inputs[t, :n] for t, n in zip(steps, counts)])
        ys = np.concatenate([side.targets[t, :n] for t, n in zip(steps, counts)])
        tape, states, end = [], np.ones((len(ys), H + 1), np.float32), 0
        for t, n, block in zip(steps, counts, _blocks(p, xs, counts)):
            np.multiply(h[:, :n], side.going[t, :n], out=block[:H])
            gates, new, q, h = _step(w, block, block[:H])
            states[end : end + n, :H] = h.T
            tape.append((t, n, end, block, gates, new, q))
            end += n
        count, kind, back, gc = np.float32(len(ys)), _class(ys), np.empty((len(ys), H), np.float32), np.zeros_like(outputs.classes)
        for i in range(0, len(ys), NEAR):
            part = states[i : i + NEAR]
            d = part @ outputs.classes.T
            d *= (1 / (outputs.shares(d, False) * count))[:, None]
            d[np.arange(len(d)), kind[i : i + NEAR]] -= 1 / count
            np.matmul(d, outputs.classes[:, :H], out=back[i : i + NEAR])
            gc += d.T @ part
        at, y, parts = _by_class(ys)
        own = states[at]
        e, total = outputs.of_members(own, parts)
        e *= (1 / (total * count))[:, None]
        e[np.arange(len(y)), y % WIDTH] -= 1 / count
        gm, more = np.zeros_like(outputs.members), np.empty((len(y), H), np.float32)
        for c, a, b in parts:
            words = slice(c * WIDTH, (c + 1) * WIDTH)
            np.matmul(e[a:b], p["Ww"][words], out=more[a:b])
            np.matmul(e[a:b].T, own[a:b], out=gm[words])
        back[at] += more
        # u: a step's gradients by the rows of _joint, whose gradients add up in gw; ge: those of the inputs; lead: from u to both
        gw, ge, dh = np.zeros_like(w), np.empty((EMBED, len(ys)), np.float32), np.zeros((H, 0), np.float32)
        lead = w[:, :-1].T.copy()
        lead[:, H : 3 * H] *= -1
        for t, n, begin, block, gates, new, q in reversed(tape):
            g, u = np.ascontiguousarray(back[begin : begin + n].T), np.empty((4 * H, n), np.float32)
            g[:, : dh.shape[1]] += dh
            dh, dz, dn = g * gates[:H], u[H : 2 * H], u[3 * H :]
            np.subtract(g, dh, out=dn)
            np.subtract(block[:H], new, out=dz)
            dz *= dh
            new *= new
            new *= dn
            dn -= new
            np.multiply(dn, gates[H:], out=u[:H])
            np.multiply(u[:H], q, out=u[2 * H : 3 * H])
            np.subtract(1, gates, out=gates)
            u[H : 3 * H] *= gates
            led = lead @ u
            dh += led[:H]
            dh *= side.going[t, :n]
            gw += u @ block.T
            ge[:, begin : begin + n] = led[H:]
        gU = np.concatenate([gw[H : 3 * H, :H], gw[:H, :H]]).T
        gE = np.stack([np.bincount(xs, g, len(p["E"])) for g in ge], 1).astype(np.float32)
        found = {"Wc": gc[:, :H].T, "bc": gc[:, H], "U": gU, "Wx": gw[H:, H:-1].T, "bx": gw[H:, -1], "Ww": gm[:, :H], "bw": gm[:, H], "E": gE}
        for k, g in found.items():
            self._move(k, g)
        return h
