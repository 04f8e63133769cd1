"""A small causal self-attention model of token sequences in numpy.

One attention layer over token vectors with a bias for every distance, a hidden layer, and the next
token in two steps: its class (a block of tokens of similar frequency), then the token inside the class.
Tokens beyond the ``KNOWN`` most frequent share one place; inside it they are told apart by their counts.

Windows hold ``2 * STEP`` tokens and overlap by ``STEP``: the second half of a window is scored, so every token is
scored once, from ``STEP`` to ``2 * STEP`` tokens in front of it (fewer at the start of a text).
"""

from __future__ import annotations

import numpy as np

#: Half a window.
STEP = 16

#: Tokens with an output of their own: CLASSES blocks of BLOCK tokens, the last place for all others.
CLASSES = 64
BLOCK = 64
KNOWN = CLASSES * BLOCK - 1

#: Size of token vectors and of the hidden layer.
WIDTH = 16
HIDDEN = 32

#: Windows that are scored or trained on at once.
SCORE_WINDOWS = 256
TRAIN_WINDOWS = 128

#: Weights that are moved at once.
_PART = 1 << 13

_PAD = CLASSES * BLOCK
_FAR = np.float32(-1e4)
_SHAPES = {
    "vectors": (_PAD + 1, WIDTH),
    "query": (WIDTH, WIDTH),
    "key": (WIDTH, WIDTH),
    "value": (WIDTH, WIDTH),
    "distance": (2 * STEP,),
    "inner": (WIDTH, HIDDEN),
    "inner_bias": (HIDDEN,),
    "classes": (HIDDEN, CLASSES),
    "class_bias": (CLASSES,),
    "tokens": (CLASSES, HIDDEN, BLOCK),
    "token_bias": (CLASSES, BLOCK),
}


class Vocabulary:
    """Places of token ids by frequency, from corpus-wide counts (index: id)."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.place = np.full(len(counts), KNOWN, np.int32)
        self.place[order[:KNOWN]] = np.arange(min(KNOWN, len(counts)))
        rest = order[KNOWN:]
        self.inside = np.zeros(len(counts), np.float64)  # log of a token's share of the common place
        total = counts[rest].sum() + 0.1 * len(rest)
        self.inside[rest] = np.log((counts[rest] + 0.1) / total) if len(rest) else 0.0
        shares = np.full(CLASSES * BLOCK, 0.1)
        shares[: min(KNOWN, len(counts))] += counts[order[:KNOWN]]
        shares[KNOWN] += counts[rest].sum()
        self.shares = (shares / shares.sum()).reshape(CLASSES, BLOCK)


def start(vocabulary: Vocabulary, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights before training: the unigram model of the counts."""
    rng = np.random.default_rng(seed)

    by_class = vocabulary.shares.sum(axis=1)
    scales = {"vectors": 0.3, "query": WIDTH**-0.5, "key": WIDTH**-0.5, "value": WIDTH**-0.5, "inner": WIDTH**-0.5}
    scales |= {"classes": 0.02, "tokens": 0.02}
    weights = {n: rng.normal(0, scales.get(n, 1), shape).astype(np.float32) * (n in scales) for n, shape in _SHAPES.items()}
    weights["class_bias"] = np.log(by_class).astype(np.float32)
    weights["token_bias"] = np.log(vocabulary.shares / by_class[:, None]).astype(np.float32)
    return weights


def flatten(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[n].ravel() for n in _SHAPES])


def unflatten(flat: np.ndarray) -> dict[str, np.ndarray]:
    return _views(flat.astype(np.float32))


def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def windows(texts: list[np.ndarray], begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets (-1: none) of texts given as places, in rows of STEP, and the rows to score. A
    row's window is the row before it and itself."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = -(-(sizes + 1) // STEP)  # the end is a target too
    first_row = np.cumsum(rows + 1) - rows  # behind a row of padding
    total = int((rows + 1).sum())
    inputs = np.full(total * STEP, _PAD, np.int32)
    targets = np.full(total * STEP, -1, np.int32)
    at = first_row * STEP
    if len(texts):
        flat = np.concatenate(texts)
        place = np.arange(len(flat)) + np.repeat(at - (np.cumsum(sizes) - sizes), sizes)
        inputs[at] = begin
        inputs[place + 1] = flat
        targets[place] = flat
        targets[at + sizes] = end
    padding = np.zeros(total, bool)
    padding[first_row - 1] = True
    return inputs.reshape(-1, STEP), targets.reshape(-1, STEP), np.flatnonzero(~padding)


_FUTURE = np.where(np.arange(2 * STEP)[None, :] > np.arange(STEP)[:, None] + STEP, _FAR, 0).astype(np.float32)
_DISTANCE = np.clip(np.arange(STEP)[:, None] + STEP - np.arange(2 * STEP)[None, :], 0, 2 * STEP - 1)


class Room:
    """Arrays for the sums of ``rows`` rows, used again and again: fresh ones of this size cost more than the sums in them."""

    def __init__(self, rows: int, kind):
        self.rows, self.kind, self.held = rows, kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        """An array with room for a line per token of all rows, cut to the shape; what it holds is undefined."""
        size = int(np.prod(shape))
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(max(size, (self.rows + 1) * STEP * shape[-1]), self.kind)
        return self.held[name][:size].reshape(shape)


def _attend(weight: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Exponentials of the weights of every window, in place, and their sums. ``given``: the inputs of the rows, one more in front."""
    padded = np.flatnonzero(given[:, -1] == _PAD)  # rows next to the start or end of a text
    away = np.where(given[padded] == _PAD, _FAR, np.float32(0))[:, None, :]
    first = int(padded.size > 0 and padded[0] == 0)
    last = padded.size - int(padded.size > 0 and padded[-1] == len(weight))
    weight[padded[first:] - 1, :, STEP:] += away[first:]
    weight[padded[:last], :, :STEP] += away[:last]
    if weight.max() > 60:
        np.minimum(weight, 60, out=weight)
    np.exp(weight, out=weight)
    total = weight @ np.ones((weight.shape[2], 1), weight.dtype)
    return np.maximum(total, 1e-30, out=total)  # rows of padding see nothing


def _outputs(w: dict[str, np.ndarray], both: np.ndarray) -> np.ndarray:
    """For every class the weights of all classes beside those of its tokens, the biases in the last line, written to ``both``."""
    both[:, :HIDDEN, :CLASSES], both[:, HIDDEN, :CLASSES] = w["classes"], w["class_bias"]
    both[:, :HIDDEN, CLASSES:], both[:, HIDDEN, CLASSES:] = w["tokens"], w["token_bias"]
    return both


def _by_class(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Positions that have a target, by its class; the targets; and (class, first, end) of the classes found."""
    scored = np.flatnonzero(wanted >= 0)
    wanted = wanted.take(scored)
    of_class = (wanted // BLOCK).astype(np.uint8)
    order = np.argsort(of_class, kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(of_class, minlength=CLASSES)))).tolist()
    return scored.take(order), wanted.take(order), [(c, a, b) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]


def _logits(room: Room, inner: np.ndarray, both: np.ndarray, classes: list[tuple[int, int, int]]) -> np.ndarray:
    """A line of two halves for every target: of the classes, and of the tokens in its own class; small enough for exp."""
    logits = room("logits", len(inner), CLASSES + BLOCK)
    for c, a, b in classes:
        np.matmul(inner[a:b], both[c], out=logits[a:b])
    if logits.size and max(logits.max(), -logits.min()) > 60:  # beyond what exp holds in 32 bits
        halves = logits.reshape(-1, 2, CLASSES)
        halves -= halves.max(axis=2, keepdims=True)
    return logits


def _own(wanted: np.ndarray) -> np.ndarray:
    """Where the halves of all lines hold the target's class and the target, as places in all lines together."""
    at = np.arange(0, len(wanted) * (CLASSES + BLOCK), CLASSES + BLOCK)
    return np.stack((at + wanted // BLOCK, at + CLASSES + wanted % BLOCK))


class Scorer:
    """Log probabilities of targets under fixed weights; what depends on one token only is a table."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        vectors, inner = weights["vectors"].astype(np.float32), weights["inner"].astype(np.float32)
        query = (vectors @ weights["query"]) * WIDTH**-0.5
        self.asks = np.concatenate((query, vectors @ inner + weights["inner_bias"]), axis=1).astype(np.float32)
        self.tells = np.concatenate((vectors @ weights["key"], vectors @ (weights["value"] @ inner)), axis=1).astype(np.float32)
        self.bias = (weights["distance"][_DISTANCE] + _FUTURE).astype(np.float32)
        self.both = _outputs(weights, np.empty((CLASSES, HIDDEN + 1, CLASSES + BLOCK), np.float32))
        self.room = Room(SCORE_WINDOWS, np.float32)

    def __call__(self, inputs: np.ndarray, targets: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Log probability (natural) of every target, in order."""
        end = int(rows[-1]) + 1 if len(rows) else 1
        parts = [self._some(inputs, targets, i, min(i + SCORE_WINDOWS, end)) for i in range(1, end, SCORE_WINDOWS)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _some(self, inputs, targets, low, high) -> np.ndarray:
        """Targets of neighbouring rows; the windows are views of the same tokens."""
        room, count = self.room, high - low
        flat = inputs[low - 1 : high].ravel()
        ask = self.asks.take(flat[STEP:], axis=0, out=room("ask", count * STEP, WIDTH + HIDDEN), mode="clip").reshape(-1, STEP, WIDTH + HIDDEN)
        tell = self.tells.take(flat, axis=0, out=room("tell", (count + 1) * STEP, WIDTH + HIDDEN), mode="clip")
        line, cell = tell.strides
        seen = np.lib.stride_tricks.as_strided(tell, (count, 2 * STEP, WIDTH + HIDDEN), (STEP * line, line, cell))
        weight = np.matmul(ask[:, :, :WIDTH], seen[:, :, :WIDTH].transpose(0, 2, 1), out=room("weight", count, STEP, 2 * STEP))
        weight += self.bias
        total = _attend(weight, inputs[low - 1 : high])
        read = np.matmul(weight, seen[:, :, WIDTH:], out=room("read", count, STEP, HIDDEN))
        read /= total
        read += ask[:, :, WIDTH:]
        scored, wanted, classes = _by_class(targets[low:high].ravel())
        inner = room("inner", len(scored), HIDDEN + 1)
        np.maximum(read.reshape(-1, HIDDEN).take(scored, axis=0, out=room("used", len(scored), HIDDEN), mode="clip"), 0, out=inner[:, :HIDDEN])
        inner[:, HIDDEN] = 1
        logits = _logits(room, inner, self.both, classes)
        logs = logits.ravel().take(_own(wanted)).astype(np.float64).sum(axis=0)
        np.exp(logits, out=logits)
        sums = logits.reshape(-1, CLASSES) @ np.ones(CLASSES, logits.dtype)
        logs -= np.log(sums.astype(np.float64)).reshape(-1, 2).sum(axis=1)
        out = np.empty(count * STEP)
        out[scored] = logs
        return out[targets[low:high].ravel() >= 0]


def gradients(
    w: dict[str, np.ndarray], inputs, targets, rows, room: Room | None = None, into: dict[str, np.ndarray] | None = None
) -> tuple[float, int, dict[str, np.ndarray]]:
    """Sum of the negative log probabilities, number of targets and the gradient of their mean (written to ``into`` if given).
    ``rows`` are neighbours but for rows of padding, so their windows are views of the same tokens."""
    low, high = int(rows[0]), int(rows[-1]) + 1
    count = high - low
    kind = w["inner"].dtype.type
    room = room or Room(count, kind)
    g = into or {n: np.empty_like(w[n]) for n in _SHAPES}
    given = inputs[low - 1 : high]
    flat = given.ravel()
    scored, wanted, classes = _by_class(targets[low:high].ravel())
    number = len(scored)
    if not number:
        for x in g.values():
            x[...] = 0
        return 0.0, 0, g
    # Windows read the vectors themselves: the key matrix goes to the asking side, the value matrix behind the sums.
    x = w["vectors"].take(flat, axis=0, out=room("x", len(flat), WIDTH), mode="clip")
    query = w["query"] * kind(WIDTH**-0.5)
    meet = query @ w["key"].T
    line, cell = x.strides
    seen = np.lib.stride_tricks.as_strided(x, (count, 2 * STEP, WIDTH), (STEP * line, line, cell))
    across = seen.transpose(0, 2, 1)
    shares = room("shares", count, 2 * STEP, 2 * STEP)  # of every window the weights, then their gradients
    sides = room("sides", count, 2 * STEP, WIDTH)  # what meets them on the way back
    ask = np.matmul(x[STEP:], meet, out=room("ask", count * STEP, WIDTH)).reshape(count, STEP, WIDTH)
    weight = np.matmul(ask, across, out=room("weight", count, STEP, 2 * STEP))
    weight += w["distance"][_DISTANCE] + _FUTURE
    total = _attend(weight, given)
    weight = np.divide(weight, total, out=shares[:, :STEP])
    attended = np.matmul(weight, seen, out=room("attended", count, STEP, WIDTH)).reshape(-1, WIDTH)
    read = np.matmul(attended, w["value"], out=room("read", count * STEP, WIDTH))
    read += x[STEP:]
    used = read.take(scored, axis=0, out=room("used", number, WIDTH), mode="clip")
    before = np.matmul(used, w["inner"], out=room("before", number, HIDDEN))
    before += w["inner_bias"]
    inner = room("inner", number, HIDDEN + 1)
    np.maximum(before, 0, out=inner[:, :HIDDEN])
    inner[:, HIDDEN] = 1
    both = _outputs(w, room("both", CLASSES, HIDDEN + 1, CLASSES + BLOCK))
    chance = np.exp(logits := _logits(room, inner, both, classes), out=logits)
    halves = chance.reshape(-1, CLASSES)
    halves /= (halves @ np.ones((CLASSES, 1), kind)) * kind(number)
    own, lines = _own(wanted), chance.reshape(-1)
    of_own = lines.take(own)
    loss = -np.log(of_own * kind(number)).sum(dtype=np.float64)
    lines[own] = of_own - kind(1 / number)
    d_inner = room("d_inner", number, HIDDEN)
    of_class = chance[:, :CLASSES]
    np.matmul(of_class, w["classes"].T, out=d_inner)
    d_class = inner.T @ of_class
    g["classes"][...], g["class_bias"][...] = d_class[:HIDDEN], d_class[HIDDEN]
    g["tokens"][...], g["token_bias"][...] = 0, 0
    for c, a, b in classes:
        part = chance[a:b, CLASSES:]
        d_token = inner[a:b].T @ part
        g["tokens"][c], g["token_bias"][c] = d_token[:HIDDEN], d_token[HIDDEN]
        d_inner[a:b] += part @ w["tokens"][c].T
    d_inner *= before > 0
    g["inner"][...], g["inner_bias"][...] = used.T @ d_inner, np.ones(number, kind) @ d_inner
    d_used = room("d_used", number + 1, WIDTH)
    np.matmul(d_inner, w["inner"].T, out=d_used[:number])
    d_used[number] = 0
    place = np.full(count * STEP, number)
    place[scored] = np.arange(number)
    d_read = d_used.take(place, axis=0, out=read, mode="clip")
    d_own = sides[:, :STEP]
    d_own[...] = np.matmul(d_read, w["value"].T, out=room("d_own", count * STEP, WIDTH)).reshape(count, STEP, WIDTH)
    sides[:, STEP:] = ask
    d_logit = np.matmul(d_own, across, out=shares[:, STEP:])
    g["value"][...] = attended.T @ d_read
    attended *= room("d_own", count * STEP, WIDTH)
    d_logit -= (attended @ np.ones((WIDTH, 1), kind)).reshape(count, STEP, 1)
    d_logit *= weight
    g["distance"][...] = np.bincount(_DISTANCE.ravel(), (np.ones(count, kind) @ shares.reshape(count, -1))[2 * STEP * STEP :], 2 * STEP)
    d_ask = np.matmul(d_logit, seen, out=room("d_ask", count, STEP, WIDTH)).reshape(-1, WIDTH)
    d_seen = np.matmul(shares.transpose(0, 2, 1), sides, out=room("d_seen", count, 2 * STEP, WIDTH))
    d_meet = x[STEP:].T @ d_ask
    g["query"][...], g["key"][...] = d_meet @ w["key"] * kind(WIDTH**-0.5), d_meet.T @ query
    d_x = room("d_x", count + 1, STEP, WIDTH)
    d_x[0] = 0
    d_x[1:] = np.matmul(d_ask, meet.T, out=room("ask", count * STEP, WIDTH)).reshape(count, STEP, WIDTH)
    d_x[1:] += d_read.reshape(count, STEP, WIDTH)
    d_x[1:] += d_seen[:, STEP:]
    d_x[:-1] += d_seen[:, :STEP]
    met, at = np.unique(flat, return_inverse=True)
    cells = at[:, None] * WIDTH + np.arange(WIDTH)
    g["vectors"][...] = 0
    g["vectors"][met] = np.bincount(cells.ravel(), d_x.ravel(), met.size * WIDTH).reshape(-1, WIDTH)
    return float(loss), number, g


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.rate, self.steps = rate, 0
        self.flat = flatten(weights)
        self.weights = _views(self.flat)
        self.mean, self.square, self.grad = (np.zeros_like(self.flat) for _ in range(3))
        self.step, self.root = np.empty(_PART, self.flat.dtype), np.empty(_PART, self.flat.dtype)
        self.into, self.room = _views(self.grad), Room(TRAIN_WINDOWS, self.flat.dtype)

    def learn(self, inputs, targets, rows) -> None:
        _, count, _ = gradients(self.weights, inputs, targets, rows, self.room, self.into)
        if not count:
            return
        self.steps += 1
        fade = (1 - 0.98**self.steps) ** 0.5 / (1 - 0.9**self.steps)
        # A part of all arrays at a time, so that it stays in the cache through all of it.
        for low in range(0, self.flat.size, _PART):
            self._move(slice(low, low + _PART), np.float32(self.rate * fade))

    def _move(self, part: slice, rate: np.float32) -> None:
        grad, mean, square = self.grad[part], self.mean[part], self.square[part]
        step, root = self.step[: grad.size], self.root[: grad.size]
        mean += np.multiply(np.subtract(grad, mean, out=step), 0.1, out=step)
        grad *= grad
        square += np.multiply(np.subtract(grad, square, out=step), 0.02, out=step)
        np.sqrt(square, out=root)
        root += np.float32(1e-8)
        np.multiply(mean, rate, out=step)
        self.flat[part] -= np.divide(step, root, out=step)
