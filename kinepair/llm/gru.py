"""Gated recurrent language model with a class-factored softmax, in numpy.

A symbol's probability is that of its class given the state, times that of the symbol within its class given the
state. Classes are equally large runs of the symbols' frequency order. The state
is carried from window to window to a document's end; gradients stop at a window's start.

For scoring, documents run in lanes, longest first, so that the lanes still running are always the first ones. For training, a lane goes on with
another document when one ends, from a state of its own; documents of more than LONGEST symbols are learned from in pieces of that length, each from an
empty state, and dealt so that lanes are about equally long. So nearly all steps see all lanes; the gradient of the last few is scaled by the full window, so
their steps are small, and gradients are clipped.

Defined results: a document without symbols adds nothing; no documents leave the weights as they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

Params = dict[str, np.ndarray]
LONGEST = 2048
"""Symbols of a document that training follows in one piece."""
START = 0
"""Row of the input table for the start of a document; symbol s has row s + 1."""


def initial(counts: np.ndarray, classes: int, hidden: int, seed: int = 5) -> Params:
    """Small random weights; output biases that reproduce the symbols' frequencies."""
    rng, size = np.random.default_rng(seed), len(counts) // classes
    table = (counts + 0.5).reshape(classes, size)
    draw = lambda *shape: rng.normal(0, 0.1, shape)
    params = {"E": draw(len(counts) + 1, 3 * hidden), "U": draw(hidden, 3 * hidden),
              "C": draw(hidden, classes), "c": np.log(table.sum(1) / table.sum()),
              "W": draw(classes, hidden, size), "w": np.log(table / table.sum(1, keepdims=True))}
    return {k: v.astype(np.float32) for k, v in params.items()}


def windows(docs: list[np.ndarray], lanes: int, length: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(first, symbols, rows): `length` steps of up to `lanes` documents that run side by side, padded with -1.

    `rows` are the documents in the lanes. A window has only lanes that still run, so
    each window's lanes are the first ones of the window before.
    """
    order = np.argsort([-len(d) for d in docs], kind="stable")
    for at in range(0, len(order), lanes):
        mine = order[at:at + lanes]
        sizes = np.array([len(docs[i]) for i in mine])
        for start in range(0, int(sizes[0]) if len(sizes) else 0, length):
            live = int((sizes > start).sum())
            block = np.full((live, min(length, int(sizes[0]) - start)), -1, dtype=np.int64)
            for k in range(live):
                part = docs[mine[k]][start:start + length]
                block[k, :len(part)] = part
            yield start == 0, np.ascontiguousarray(block.T), mine[:live]


def run(p: Params, inputs: np.ndarray, state: np.ndarray, back: bool = False, keep: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple]]:
    """States before and after each step (steps + 1, lanes, hidden) and, with `back`, what going back needs.

    Where `keep` is false, a lane goes into the step with an empty state.
    """
    steps, hidden = len(inputs), state.shape[1]
    states = np.empty((steps + 1, *state.shape), dtype=p["U"].dtype)
    states[0], kept = state, []
    # The curves are made of exp(-x) and exp(-2x); signs and factors go into the weights once, which is exact.
    turn = np.repeat(np.array([-1, -1, -2], dtype=p["U"].dtype), hidden)
    table, product = p["E"] * turn, p["U"] * turn
    # Overflow to infinity gives 0, as it should.
    fixed, moved, gates = (np.empty((len(state), k * hidden), dtype=states.dtype) for k in (3, 3, 2))
    with np.errstate(over="ignore"):
        for t in range(steps):
            # Rows are known to exist; `clip` spares a copy.
            np.take(table, inputs[t], axis=0, out=fixed, mode="clip")
            was = states[t] if keep is None else states[t] * keep[t][:, None]
            np.matmul(was, product, out=moved)
            gate = np.add(fixed[:, :2 * hidden], moved[:, :2 * hidden], out=None if back else gates)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            r, z, m = gate[:, :hidden], gate[:, hidden:], moved[:, 2 * hidden:]
            n = r * m
            n += fixed[:, 2 * hidden:]
            # tanh(x) = 2 / (1 + exp(-2x)) - 1.
            np.exp(n, out=n)
            n += 1
            np.divide(2, n, out=n)
            n -= 1
            new = np.subtract(was, n, out=states[t + 1])
            new *= z
            new += n
            if back:
                kept.append((r, z, n, m * p["U"].dtype.type(-0.5), was))
    return states, kept


def _softmax(x: np.ndarray, chosen: np.ndarray, whole: bool, large: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of the chosen column of each row, and all probabilities if asked for. Only where values may be `large` they are looked at."""
    if large and (x.max() > 60 or x.min() < -60):
        x -= x.max(1, keepdims=True)
    picked = x[np.arange(len(x)), chosen]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], dtype=x.dtype)
    if whole:
        x /= total[:, None]
    return picked - np.log(total), x if whole else None


def output(p: Params, h: np.ndarray, symbols: np.ndarray, grads: Params | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each symbol at its state; with `grads`, adds the gradients and returns those of the states."""
    size, back = p["w"].shape[1], None
    # By class, so that each class is one product.
    order = np.argsort(symbols.astype(np.int16) if p["w"].size < 1 << 15 else symbols, kind="stable")
    h, symbols = np.take(h, order, axis=0), symbols[order]
    # No value exceeds the largest state times the sum of a column.
    reach = float(np.abs(h).max(initial=0))
    large = max(float((np.abs(p[w]).sum(-2) * reach + np.abs(p[b])).max()) for w, b in (("C", "c"), ("W", "w"))) > 60
    cls, within = symbols // size, symbols % size
    found, d = _softmax(h @ p["C"] + p["c"], cls, grads is not None, large)
    if grads is not None:
        d[np.arange(len(h)), cls] -= 1
        grads["C"] += h.T @ d
        grads["c"] += d.sum(0)
        back = d @ p["C"].T
    ends = np.searchsorted(cls, np.arange(len(p["c"]) + 1))
    for k in np.flatnonzero(np.diff(ends)):
        mine = slice(ends[k], ends[k + 1])
        got, d = _softmax(h[mine] @ p["W"][k] + p["w"][k], within[mine], grads is not None, large)
        found[mine] += got
        if grads is not None:
            d[np.arange(len(d)), within[mine]] -= 1
            grads["W"][k] += h[mine].T @ d
            grads["w"][k] += d.sum(0)
            back[mine] += d @ p["W"][k].T
    placed = [np.empty_like(x) if x is not None else None for x in (found, back)]
    for out, x in zip(placed, (found, back)):
        if x is not None:
            out[order] = x
    return placed[0], placed[1]


def _inputs(block: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Input rows of a window: the symbol before each step; padding reads the start row."""
    return np.vstack([before[None, :], block[:-1]]) + 1


def score(p: Params, docs: list[np.ndarray], lanes: int = 1024, length: int = 32) -> np.ndarray:
    """Natural log-probability of each whole document of symbols."""
    total = np.zeros(len(docs))
    for first, block, rows in windows(docs, lanes, length):
        live = len(rows)
        if first:
            state, before = np.zeros((live, p["U"].shape[0]), dtype=np.float32), np.full(live, -1)
        states, _ = run(p, _inputs(block, before[:live]), state[:live])
        at = np.flatnonzero(block.ravel() >= 0)
        # The state after reading the symbols before a step predicts the step.
        found, _ = output(p, np.take(states[1:].reshape(-1, states.shape[2]), at, axis=0), block.ravel()[at])
        total[rows] += np.bincount(at % live, weights=found, minlength=live)
        state, before = states[-1], block[-1]
    return total


def dealt(sizes: list[int], lanes: int) -> list[list[int]]:
    """Documents of each lane: longest first to the shortest lane, then in the order given; longest lanes first."""
    loads = [(0, k) for k in range(min(lanes, len(sizes)))]
    out: list[list[int]] = [[] for _ in loads]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, k = heapq.heappop(loads)
        out[k].append(i)
        heapq.heappush(loads, (load + sizes[i], k))
    return sorted((sorted(mine) for mine in out), key=lambda mine: -sum(sizes[i] for i in mine))


def streams(docs: list[np.ndarray], lanes: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, begins): windows of `length` steps over all lanes still running, padded with -1; `begins` marks first symbols of documents."""
    plan = dealt([len(d) for d in docs], lanes)
    runs = [np.concatenate([docs[i] for i in mine]) for mine in plan]
    marks = []
    for mine, run in zip(plan, runs):
        mark = np.zeros(len(run), dtype=bool)
        at = np.cumsum([0, *(len(docs[i]) for i in mine)])
        mark[at[at < len(run)]] = True
        marks.append(mark)
    sizes = np.array([len(r) for r in runs])
    for start in range(0, int(sizes.max(initial=0)), length):
        live = int((sizes > start).sum())
        steps = min(length, int(sizes[0]) - start)
        block, begins = np.full((live, steps), -1, dtype=np.int64), np.zeros((live, steps), dtype=bool)
        for k in range(live):
            part = runs[k][start:start + length]
            block[k, :len(part)], begins[k, :len(part)] = part, marks[k][start:start + length]
        yield np.ascontiguousarray(block.T), np.ascontiguousarray(begins.T)


def fresh_cache(p: Params) -> Params:
    return {k: np.full_like(v, 1e-8) for k, v in p.items()}


def train(p: Params, docs: list[np.ndarray], cache: Params | None = None, lanes: int = 256, length: int = 24, rate: float = 0.08, clip: float = 1.0) -> Params:
    """One pass of truncated backpropagation over the documents, in place, with steps by Adagrad; returns its cache."""
    cache = cache or fresh_cache(p)
    hidden = p["U"].shape[0]
    docs = [d[at:at + LONGEST] for d in docs for at in range(0, len(d), LONGEST)]
    lanes = max(1, min(lanes, len(docs)))
    state, before = np.zeros((lanes, hidden), dtype=np.float32), np.full(lanes, -1)
    for block, begins in streams(docs, lanes, length):
        live = block.shape[1]
        inputs = np.where(begins, START, _inputs(block, before[:live]))
        states, kept = run(p, inputs, state[:live], back=True, keep=~begins)
        step, lane = np.nonzero(block >= 0)
        grads = {k: np.zeros_like(v) for k, v in p.items() if k != "E"}
        _, back = output(p, states[step + 1, lane], block[step, lane], grads)
        dh = np.zeros_like(states[1:])
        dh[step, lane] = back
        moved, carry = np.empty((*inputs.shape, 3 * hidden), dtype=np.float32), np.zeros_like(state[:live])
        for t in range(len(inputs) - 1, -1, -1):
            r, z, n, m, was = kept[t]
            d = dh[t] + carry
            dn = d * (1 - z) * (1 - n * n)
            g = moved[t]
            g[:, :hidden] = dn * m * r * (1 - r)
            g[:, hidden:2 * hidden] = d * (was - n) * z * (1 - z)
            g[:, 2 * hidden:] = dn
            through = g.copy()
            through[:, 2 * hidden:] *= r
            grads["U"] += was.T @ through
            carry = (d * z + through @ p["U"].T) * ~begins[t][:, None]
        flat, at = moved.reshape(-1, 3 * hidden), inputs.ravel()
        order = np.argsort(at, kind="stable")
        rows_at, starts = np.unique(at[order], return_index=True)
        # By the full window, so that the last lanes of long documents do not step as far as all together.
        scale = np.float32(1 / (lanes * length))
        table = np.add.reduceat(flat[order], starts) * scale
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()) * float(scale) ** 2 + float(np.vdot(table, table)))
        held = np.float32(min(1.0, clip / norm) if norm > 0 else 1.0)
        table *= held
        cache["E"][rows_at] += table * table
        p["E"][rows_at] -= rate * table / np.sqrt(cache["E"][rows_at])
        for k, g in grads.items():
            g *= scale * held
            cache[k] += g * g
            p[k] -= rate * g / np.sqrt(cache[k])
        state, before = states[-1], block[-1]
    return cache
