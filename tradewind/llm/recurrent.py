"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, whole-document scores.

A model is a dict of arrays. Units are numbers in order of their frequency; M consecutive ones make a class, and
P(unit | state) = P(class | state) * P(unit | class, state). A document is its units, the last of them END; the state
is zero before the first one. Arrays of type float64 work, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

Model = dict[str, np.ndarray]

HIDDEN, CLASSES = 16, 64
#: Streams that are trained side by side, and steps that the gradient goes back.
LANES, STEPS = 128, 16
#: States of one class that are trained in one product of a batch.
CHUNK = 16
#: Adagrad's rate, and what its sums of squares begin with.
RATE, POWER = 0.1, 1e-6
#: States whose probabilities are worked out at once.
STATES = 16384


def initial(counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, dtype=np.float32) -> Model:
    """A model that knows how frequent units are, and no more: counts by unit number, all above 0."""
    size = -(-len(counts) // classes)
    share = np.full(classes * size, 1e-9)
    share[: len(counts)] = counts / counts.sum()
    share = share.reshape(classes, size)
    draw = np.random.default_rng(0)
    some = lambda *shape: draw.normal(0, 0.1, shape).astype(dtype)
    return {
        "input": some(share.size, 3 * hidden), "state": some(hidden, 3 * hidden), "bias": np.zeros(3 * hidden, dtype),
        "class": np.zeros((hidden, classes), dtype), "class_bias": np.log(share.sum(1)).astype(dtype),
        "unit": np.zeros((classes, hidden, size), dtype), "unit_bias": np.log(share / share.sum(1, keepdims=True)).astype(dtype),
    }


def _powers(states: np.ndarray, weights: np.ndarray, said: np.ndarray, bounded: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exp of the scores of what can be said in each state, their sums, logarithms of the probability of what was said).

    The last row of the weights is for a state that is 1. Scores are clipped where exp would overflow, unless they are bounded.
    """
    scores = states @ weights
    if not bounded:
        np.minimum(scores, 80, out=scores)
    own = scores[np.arange(len(said)), said]
    np.exp(scores, out=scores)
    whole = scores.sum(1)
    return scores, whole, own - np.log(whole)


def _shares(states: np.ndarray, weights: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of what can be said in each state, logarithms of what was)."""
    powers, whole, own = _powers(states, weights, said)
    powers /= whole[:, None]
    return powers, own


def _with_bias(model: Model, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states and a 1, weights of classes and their bias, weights of units and theirs)."""
    both = np.ones((len(states), states.shape[1] + 1), states.dtype)
    both[:, :-1] = states
    return both, np.concatenate([model["class"], model["class_bias"][None]]), np.concatenate([model["unit"], model["unit_bias"][:, None]], 1)


def _by_class(model: Model, units: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, places of its units, their numbers in the class)."""
    size = model["unit_bias"].shape[1]
    kind = units // size
    order = np.argsort(kind, kind="stable")
    cuts = np.searchsorted(kind[order], np.arange(len(model["class_bias"]) + 1))
    for c in np.flatnonzero(cuts[1:] > cuts[:-1]):
        at = order[cuts[c] : cuts[c + 1]]
        yield int(c), at, units[at] - c * size


def log_probability(model: Model, states: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The natural logarithm of each unit's probability in its state."""
    size = model["unit_bias"].shape[1]
    states, classes, inside = _with_bias(model, states)
    # States are below 1, and scores so below the sums of their weights.
    bounded = max(np.abs(classes).sum(0).max(), np.abs(inside).sum(1).max()) < 80
    out = _powers(states, classes, units // size, bounded)[2].astype(np.float64)
    for c, at, slot in _by_class(model, units):
        out[at] += _powers(states[at], inside[c], slot, bounded)[2]
    return out


def _halved(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(input, state) such that tanh of the gates' sums gives 2 z - 1 and 2 r - 1, the bias is in the input, and the reset state's part is halved."""
    k = model["state"].shape[0]
    into, state = model["input"] + model["bias"], model["state"] * model["state"].dtype.type(0.5)
    into[:, : 2 * k] *= 0.5
    return into, state


def _advance(into: np.ndarray, state: np.ndarray, h: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The next state, from _halved()."""
    k = h.shape[1]
    x, a = into[units], h @ state
    gates = x[:, : 2 * k]
    gates += a[:, : 2 * k]
    np.tanh(gates, out=gates)
    gates += 1
    n = a[:, 2 * k :] * gates[:, k:]
    n += x[:, 2 * k :]
    np.tanh(n, out=n)
    out = h - n
    out *= gates[:, :k]
    out *= 0.5
    out += n
    return out


def score(model: Model, documents: list[np.ndarray]) -> np.ndarray:
    """The natural logarithm of each document's probability, over all its units, however many.

    Documents are read side by side, the longest first; at the end of a window states are kept and go on.
    """
    sizes = np.array([len(d) for d in documents], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes, flat = sizes[order], np.concatenate([documents[k] for k in order]) if len(order) else np.empty(0, np.int64)
    starts, total = np.cumsum(sizes) - sizes, np.zeros(len(order))
    h, t, longest = np.zeros((len(order), model["state"].shape[0]), model["state"].dtype), 0, int(sizes.max(initial=0))
    rest = np.searchsorted(-sizes, -np.arange(longest), side="left")  # documents longer than each step
    into, state = _halved(model)
    while t < longest:
        states, units, lanes, held = [], [], [], 0
        while t < longest and held < STATES:
            n = rest[t]
            now = flat[starts[:n] + t]
            states.append(h[:n])
            units.append(now)
            lanes.append(n)
            h, held, t = _advance(into, state, h[:n], now), held + n, t + 1
        at = np.concatenate([np.arange(n) for n in lanes])
        total += np.bincount(at, log_probability(model, np.concatenate(states), np.concatenate(units)), len(total))
    out = np.empty(len(order))
    out[order] = total
    return out


def _in_chunks(kind: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of sorted classes in chunks of CHUNK rows of one class, the class of each chunk, the classes that come, their first chunks)."""
    counts = np.bincount(kind, minlength=classes)
    chunks = -(-counts // CHUNK)
    first, seen = np.cumsum(chunks) - chunks, np.flatnonzero(counts)
    place = np.arange(len(kind)) + (first * CHUNK - (np.cumsum(counts) - counts))[kind]
    return place, np.repeat(np.arange(classes), chunks), seen, first[seen]


def _window(model: Model, h: np.ndarray, units: np.ndarray, end: int) -> tuple[dict, np.ndarray, float]:
    """What gradients() gives, with the gradients of unit and its bias as (classes, one array of both, the bias last).

    Only what a step needs of the one before it is done step by step; all else is done for the whole window at once.
    """
    (lanes, steps), k, kind = units.shape, h.shape[1], h.dtype
    said = units.T.reshape(-1)
    keep = (units.T != end)[:, :, None].astype(kind)
    x, state = (model["input"][said] + model["bias"]).reshape(steps, lanes, 3 * k), model["state"].copy()
    x[:, :, : 2 * k] *= 0.5
    state[:, : 2 * k] *= 0.5
    before, gates, an, n = (np.empty((steps, lanes, w), kind) for w in (k, 2 * k, k, k))
    for t in range(steps):
        before[t], a, g, m = h, h @ state, gates[t], n[t]
        np.add(x[t, :, : 2 * k], a[:, : 2 * k], out=g)
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        an[t] = a[:, 2 * k :]
        np.multiply(g[:, k:], an[t], out=m)
        m += x[t, :, 2 * k :]
        np.tanh(m, out=m)
        h = h - m
        h *= g[:, :k]
        h += m
        h *= keep[t]
    states, size, rows = before.reshape(-1, k), model["unit_bias"].shape[1], np.arange(len(said))
    both, classes, inside = _with_bias(model, states)
    off, own = _shares(both, classes, said // size)
    loss = -float(own.sum())
    off[rows, said // size] -= 1
    grads: dict = {"class": states.T @ off, "class_bias": off.sum(0)}
    up = off @ model["class"].T

    order = np.argsort(said, kind="stable")
    by_unit = said[order]
    place, of, seen, first = _in_chunks(by_unit // size, len(inside))
    slot, padded = by_unit % size, np.zeros((len(of) * CHUNK, k + 1), kind)
    padded[place] = both[order]
    padded, weights = padded.reshape(-1, CHUNK, k + 1), inside[of]
    off = (padded @ weights).reshape(-1, size)
    np.minimum(off, 80, out=off)
    own = off[place, slot]
    np.exp(off, out=off)
    whole = off.sum(1)
    loss -= float((own - np.log(whole[place])).sum())
    off /= whole[:, None]
    off[place, slot] -= 1
    off = off.reshape(-1, CHUNK, size)
    # Rows that fill a chunk are zero, with their 1 for the bias.
    grads["inside"] = seen, np.add.reduceat(padded.transpose(0, 2, 1) @ off, first)
    up[order] += (off @ weights[:, :k].transpose(0, 2, 1)).reshape(-1, k)[place]

    up, z, r = up.reshape(steps, lanes, k), gates[:, :, :k], gates[:, :, k:]
    dn = (1 - z) * (1 - n * n) * keep
    into = np.stack([(before - n) * z * (1 - z) * keep, dn * an * r * (1 - r), dn], 2)
    down = into.copy()
    down[:, :, 2] *= r
    z, after, across = z * keep, np.zeros_like(h), np.ascontiguousarray(model["state"].T)
    for t in range(steps - 1, -1, -1):
        into[t] *= after[:, None]
        down[t] *= after[:, None]
        after = after * z[t]
        after += down[t].reshape(lanes, 3 * k) @ across
        after += up[t]
    into = into.reshape(-1, 3 * k)
    starts = np.flatnonzero(np.concatenate([[True], by_unit[1:] != by_unit[:-1]]))
    return grads | {"state": states.T @ down.reshape(-1, 3 * k), "bias": into.sum(0), "input": (by_unit[starts], np.add.reduceat(into[order], starts))}, h, loss


def gradients(model: Model, h: np.ndarray, units: np.ndarray, end: int) -> tuple[dict, np.ndarray, float]:
    """(gradients, next state, loss) of a window: units by lane and step; the gradient ends where the window begins.

    Of input, the gradient is (rows, their gradients), and of unit and unit_bias by class.
    """
    grads, h, loss = _window(model, h, units, end)
    seen, both = grads.pop("inside")
    return grads | {"unit": dict(zip(seen.tolist(), both[:, :-1], strict=True)), "unit_bias": dict(zip(seen.tolist(), both[:, -1], strict=True))}, h, loss


def train(model: Model, documents: list[np.ndarray], end: int, lanes: int = LANES, steps: int = STEPS, rate: float = RATE) -> tuple[Model, int]:
    """(a model trained on the documents, once, by Adagrad; the number of units that it has read).

    The documents are one long text, cut into a piece for each lane. A window takes so many steps of all lanes and
    hands their states on to the next; a piece that begins inside a document begins with a state of zero.
    """
    model = {k: v.copy() for k, v in model.items()}
    power = {k: np.full_like(v, POWER) for k, v in model.items()}
    text = np.concatenate(documents) if documents else np.empty(0, np.int64)
    lanes = max(1, min(lanes, len(text) // steps))
    length = -(-len(text) // lanes)
    # Pieces differ by a unit; the shorter ones end with END once more.
    cuts = np.linspace(0, len(text), lanes + 1).astype(np.int64)
    h = np.zeros((lanes, model["state"].shape[0]), model["state"].dtype)

    def move(name: str, at, grad: np.ndarray) -> None:
        power[name][at] += grad * grad
        model[name][at] -= rate * grad / np.sqrt(power[name][at])

    for t in range(0, length, steps):
        places = cuts[:-1, None] + np.arange(t, min(t + steps, length))
        window = np.where(places < cuts[1:, None], text[np.minimum(places, len(text) - 1)], end)
        grads, h, _ = _window(model, h, window, end)
        for name in ("class", "class_bias", "state", "bias"):
            move(name, ..., grads[name] / window.size)
        seen, grad = grads["input"]
        move("input", seen, grad / window.size)
        seen, grad = grads["inside"]
        move("unit", seen, grad[:, :-1] / window.size)
        move("unit_bias", seen, grad[:, -1] / window.size)
    return model, len(text)
