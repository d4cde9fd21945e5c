"""Character-level bidirectional LSTM with CRF transitions, in numpy: training from labelled spans and decoding."""

from __future__ import annotations

from functools import cached_property
from multiprocessing import get_context
from pathlib import Path

import numpy as np

TYPES = ("email", "phone", "national_id", "address", "person_name")
#: 0 is outside; 1 + 2k begins and 2 + 2k continues an item of type k.
LABELS = 1 + 2 * len(TYPES)
#: Characters of a window trained on; of one that is scored, and from one such to the next.
TRAINED = 80
WINDOW, STRIDE = 640, 616
WEIGHTS = Path(__file__).with_name("weights.npz")
_NEVER = -1e4


# --- characters -----------------------------------------------------------------------------------------------------


def _table() -> np.ndarray:
    """Code of each character of the basic plane: printable ASCII as it is, others by kind."""
    codes = np.full(1 << 16, 1, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        if 32 <= c < 127:
            codes[c] = c - 32 + 10
        elif ch.isspace():
            codes[c] = 2
        elif ch.isdigit():
            codes[c] = 3
        elif ch.isupper():
            codes[c] = 4
        elif ch.islower():
            codes[c] = 5 + (c in map(ord, "åäöé")) * 1
        elif ch.isalpha():
            codes[c] = 7
        elif c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2014):
            codes[c] = 8
        elif c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD):
            codes[c] = 9
    return codes


CHARS = _table()
VOCABULARY = 10 + 95


def char_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return CHARS[np.minimum(points, 0xFFFF)]


# --- network --------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.hidden = p["u0"].shape[0]
        # the input side of both directions is a row of a table, as there is nothing below the characters
        self.inputs = [(p["embed"] @ p[f"w{d}"] + p[f"b{d}"]).astype(np.float32) for d in (0, 1)]
        # a sigmoid is a tanh of half its argument: with the gates halved one tanh serves all of a step
        half = np.r_[np.full(3 * self.hidden, 0.5), np.ones(self.hidden)].astype(np.float32)
        # and as the step leaves a hidden state doubled, what multiplies it is halved too
        self.halved = [(self._by_gate(table * half), self._by_gate(p[f"u{d}"] * half * 0.5), p["out"][d * self.hidden : (d + 1) * self.hidden] * 0.5) for d, table in enumerate(self.inputs)]

    def _by_gate(self, weights: np.ndarray) -> np.ndarray:
        """(gate, row, hidden) of (row, gates): what is done to one gate runs through adjoining memory."""
        return np.ascontiguousarray(weights.reshape(len(weights), 4, self.hidden).transpose(1, 0, 2), np.float32)

    @classmethod
    def fresh(cls, hidden: int = 32, embed: int = 20, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        p = {"embed": rng.normal(0, 0.3, (VOCABULARY, embed)), "out": rng.normal(0, 0.2, (2 * hidden, LABELS)), "bias": np.zeros(LABELS), "trans": np.zeros((LABELS, LABELS))}
        for d in (0, 1):
            p[f"w{d}"] = rng.normal(0, 1 / embed**0.5, (embed, 4 * hidden))
            p[f"u{d}"] = rng.normal(0, 1 / hidden**0.5, (hidden, 4 * hidden))
            p[f"b{d}"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]  # gates: in, forget, out, new
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> Network:
        with np.load(path) as z:
            return cls({k: z[k].astype(np.float32) for k in z.files})

    def save(self, path: Path = WEIGHTS) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float32) for k, v in self.p.items()})

    def _pass(self, codes: np.ndarray, d: int, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, batch, hidden) of one direction."""
        b, t = codes.shape
        n, u = self.hidden, self.p[f"u{d}"]
        h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        out = np.empty((t, b, n), np.float32)
        table = self.inputs[d]
        for s in range(t) if d == 0 else range(t - 1, -1, -1):
            z = table[codes[:, s]]
            z += h @ u
            gate, new = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            before, last = c, h
            c = gate[:, n : 2 * n] * c
            c += gate[:, :n] * new
            squashed = np.tanh(c)
            h = gate[:, 2 * n :] * squashed
            out[s] = h
            if keep is not None:
                keep.append((s, last, before, gate, new, squashed))
        return out

    @cached_property
    def padded(self) -> tuple[np.ndarray, np.ndarray]:
        """Cells and doubled hidden states of the backward direction after so many places of padding."""
        n, (table, u, _) = self.hidden, self.halved[1]
        cells, states = np.zeros((2, WINDOW + 1, n), np.float32)
        for s in range(WINDOW):
            z = np.tanh(table[:, 0] + states[s] @ u)
            cells[s + 1] = ((z[1] + 1) * cells[s] + (z[0] + 1) * z[3]) * np.float32(0.5)
            states[s + 1] = np.tanh(cells[s + 1]) * (z[2] + 1)
        return cells, states

    def _score(self, codes: np.ndarray, sizes: np.ndarray, d: int) -> np.ndarray:
        """Scores (time, batch, labels) by one direction, without what training needs; padding isn't computed."""
        b, t = codes.shape
        n, (table, u, labels) = self.hidden, self.halved[d]
        columns, live = codes.T.astype(np.intp), np.count_nonzero(sizes > np.arange(t)[:, None], 1).tolist()
        # backwards, rows begin with the state that the padding behind them leaves
        cells, states = (x[WINDOW - sizes] for x in self.padded) if d else np.zeros((2, b, n), np.float32)
        e, gates, more = np.zeros((t, b, LABELS), np.float32), np.empty(4 * b * n, np.float32), np.empty(4 * b * n, np.float32)
        for s in range(t) if d == 0 else range(t - 1, -1, -1):
            m = live[s]
            c, h = cells[:m], states[:m]
            z = np.take(table, columns[s, :m], axis=1, out=gates[: 4 * m * n].reshape(4, m, n), mode="clip")
            z += np.matmul(h, u, out=more[: 4 * m * n].reshape(4, m, n))
            np.tanh(z, out=z)
            into, keep, show = opened = z[:3]
            opened += 1
            into *= z[3]
            c *= keep
            c += into
            c *= 0.5
            np.tanh(c, out=h)
            h *= show
            np.dot(h, labels, out=e[s, :m])
        return e

    def emissions(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(batch, time, labels) scores of rows of these sizes, longest first; behind the end of a row they mean nothing."""
        e = self._score(codes, sizes, 0)
        e += self._score(codes, sizes, 1)
        e += self.p["bias"]
        return e.transpose(1, 0, 2)

    def transitions(self) -> np.ndarray:
        return self.p["trans"] + forbidden()

    # --- training ---------------------------------------------------------------------------------------------------

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the CRF and its gradients."""
        p, n, (b, t) = self.p, self.hidden, codes.shape
        kept: list[list] = [[], []]
        states = [self._pass(codes, d, kept[d]) for d in (0, 1)]
        both = np.concatenate(states, 2)
        e = both @ p["out"] + p["bias"]
        loss, de, dtrans = _crf(e, labels.T, self.transitions())
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["trans"] = dtrans / b
        de /= b
        g["bias"] = de.sum((0, 1))
        g["out"] = both.reshape(-1, 2 * n).T @ de.reshape(-1, LABELS)
        dboth = de @ p["out"].T
        dtable = [np.zeros_like(x) for x in self.inputs]
        for d in (0, 1):
            u = p[f"u{d}"]
            dh, dc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
            for s, last, before, gate, new, squashed in reversed(kept[d]):
                dh = dh + dboth[s, :, d * n : (d + 1) * n]
                i, f, o = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :]
                dc = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], 1)
                g[f"u{d}"] += last.T @ dz
                np.add.at(dtable[d], codes[:, s], dz)
                dh, dc = dz @ u.T, dc * f
            g[f"b{d}"] = dtable[d].sum(0)
            g[f"w{d}"] = p["embed"].T @ dtable[d]
            g["embed"] += dtable[d] @ p[f"w{d}"].T
        return loss / b, g


def forbidden() -> np.ndarray:
    """A continuing label follows only a label of its own type."""
    m = np.zeros((LABELS, LABELS), np.float32)
    for k in range(len(TYPES)):
        m[:, 2 + 2 * k] = _NEVER
        m[1 + 2 * k, 2 + 2 * k] = m[2 + 2 * k, 2 + 2 * k] = 0
    return m


def _crf(e: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed loss, gradient of the scores (time, batch, labels) and of the transitions, by scaled forward and backward sums."""
    t, b, _ = e.shape
    start = (np.arange(LABELS) % 2 == 1) | (np.arange(LABELS) == 0)
    top = e.max(2)
    p, step = np.exp(e - top[:, :, None]), np.exp(trans)
    alpha, beta, scale = np.empty_like(p), np.ones_like(p), np.empty((t, b), np.float32)
    for s in range(t):
        a = p[s] * (start if s == 0 else alpha[s - 1] @ step)
        scale[s] = a.sum(1)
        alpha[s] = a / scale[s][:, None]
    for s in range(t - 2, -1, -1):
        beta[s] = (p[s + 1] * beta[s + 1] / scale[s + 1][:, None]) @ step.T
    z = (np.log(scale) + top).sum(0)
    de = alpha * beta
    ahead = p[1:] * beta[1:] / scale[1:, :, None]
    dtrans = np.einsum("sbi,sbj->ij", alpha[:-1], ahead, optimize=True) * step
    times, rows = np.arange(t)[:, None], np.arange(b)
    de[times, rows, y] -= 1
    np.add.at(dtrans, (y[:-1], y[1:]), -1)
    gold = e[times, rows, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
    return float((z - gold).sum()), de.astype(np.float32), dtrans.astype(np.float32)


def _shard(task: tuple) -> tuple[float, dict[str, np.ndarray]]:
    p, rows = task
    return Network(p).gradients(_DATA[0][rows], _DATA[1][rows])


_DATA: list[np.ndarray] = []


def train(codes: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 256, rate: float = 6e-3, seed: int = 5, workers: int = 8, say=print) -> Network:
    """Adam over shuffled batches; each batch is shared out to forked workers, whose gradients are averaged."""
    net, rng = Network.fresh(), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, total = 0, epochs * (len(codes) // batch)
    _DATA[:] = [codes, labels]
    with get_context("fork").Pool(workers) as pool:
        for epoch in range(epochs):
            order, sums = rng.permutation(len(codes)), 0.0
            for i in range(0, len(order) - batch + 1, batch):
                shards = pool.map(_shard, [(net.p, rows) for rows in np.array_split(order[i : i + batch], workers)], 1)
                g = {k: sum(s[1][k] for s in shards) / workers for k in net.p}
                norm = sum(float((x**2).sum()) for x in g.values()) ** 0.5
                step += 1
                lr = rate * min(1, step / 50) * (1 - 0.97 * step / total)
                for k, x in g.items():
                    x *= min(1, 5 / (norm + 1e-6))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x**2
                    net.p[k] -= (lr * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                sums += sum(s[0] for s in shards) / workers
            say(f"epoch {epoch + 1}: loss {sums / (len(order) // batch):.3f}", flush=True)
    return Network(net.p)


# --- decoding -------------------------------------------------------------------------------------------------------


def viterbi(e: np.ndarray, begin: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels (time, row) of rows of the scores (place, labels), longest first, each a path of its own; 0 behind its end."""
    b, t = len(sizes), int(sizes[0])
    live = b - np.searchsorted(sizes[::-1], np.arange(t), side="right")
    ends = np.cumsum(live)
    room, busy = np.empty(LABELS * int(ends[-1]), np.float32), np.empty(int(ends[-1]), bool)
    live, ends = live.tolist(), ends.tolist()
    scores = [room[LABELS * (z - m) : LABELS * z].reshape(LABELS, m) for m, z in zip(live, ends)]  # of the best path to each label
    # a continuing label has two predecessors, any other all of them
    first, again = np.arange(1, LABELS, 2), np.arange(2, LABELS, 2)
    allowed = trans.astype(np.float32)
    begins = np.ascontiguousarray(allowed[:, [0, *first]].T)[:, :, None]
    goes_on, stays_in = allowed[first, again][:, None], allowed[again, again][:, None]
    reach = np.empty(len(begins) * LABELS * b, np.float32)
    for s, m in enumerate(live):
        now = scores[s]
        now[:] = e.take(begin[:m] + s, axis=0).T
        if s == 0:
            now[2::2] += _NEVER
            continue
        last = scores[s - 1][:, :m]
        to = np.add(begins, last, out=reach[: len(begins) * LABELS * m].reshape(len(begins), LABELS, m))
        best = to.max(1)
        np.not_equal(best[0], to[0, 0], out=busy[ends[s] - m : ends[s]])  # the best path to outside doesn't come from outside
        now[0] += best[0]
        now[1::2] += best[1:]
        now[2::2] += np.maximum(last[1::2] + goes_on, last[2::2] + stays_in)
    allowed[:, 2::2] = -np.inf
    allowed[first, again], allowed[again, again] = goes_on[:, 0], stays_in[:, 0]
    out, at, known = np.zeros((t, b), np.int8), np.zeros(b, np.intp), 0
    for s in range(t - 1, -1, -1):
        m = live[s]
        if m > known:  # rows that end here
            at[known:m] = scores[s][:, known:].argmax(0)
            known = m
        inside = at.nonzero()[0]
        if len(inside):
            out[s, inside] = at[inside]
        if s:
            rows = (at[:m].astype(bool) | busy[ends[s] - m : ends[s]]).nonzero()[0]
            if len(rows):
                at[rows] = (scores[s - 1][:, rows] + allowed[:, at[rows]]).argmax(0)
    return out


def spans_of(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, type) of the items of one row of labels."""
    found, at = [], 0
    inside = np.flatnonzero(labels)
    while at < len(inside):
        a = int(inside[at])
        kind, z = (int(labels[a]) - 1) // 2, a + 1
        while z < len(labels) and labels[z] == 2 + 2 * kind:
            z += 1
        found.append((a, z, kind))
        at = int(np.searchsorted(inside, z))
    return found


#: Weight of a window's scores at each of its places: places near an edge know only one side of their context.
CENTRAL = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32) + 4


#: Characters decoded as one path, what parts of a longer stretch share on each side, and cells decoded at a time (46 MB).
PART, LAP, CELLS = 640, 160, 1 << 20
#: Characters of texts whose scores are held at a time (92 MB); a longer text is held alone.
HELD = 1 << 21


def decode(net: Network, codes: list[np.ndarray], batch: int = 768) -> list[list[tuple[int, int, int]]]:
    """Items of each text: overlapping windows are scored, their scores are joined, and one path is found through each text."""
    group = np.cumsum([len(c) for c in codes]) // HELD
    ends = (np.flatnonzero(np.diff(group)) + 1).tolist()
    return [spans for a, z in zip([0, *ends], [*ends, len(codes)]) for spans in _decoded(net, codes[a:z], batch)]


def _joined(net: Network, codes: list[np.ndarray], batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores (place, labels), and the place at which each text begins."""
    lengths, lap = np.array([len(c) for c in codes]), WINDOW - STRIDE
    begin = np.cumsum(lengths) - lengths
    count = -(-np.maximum(1, lengths - lap) // STRIDE)
    owner = np.repeat(np.arange(len(codes)), count)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    sizes = np.minimum(WINDOW, lengths[owner] - start)
    order = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]
    flat = np.concatenate([*codes, np.zeros(WINDOW, np.uint8)])
    # where two windows overlap, each has its share
    opening = (CENTRAL[:lap] / (CENTRAL[:lap] + CENTRAL[STRIDE:]))[:, None]
    sums = np.zeros((len(flat) - WINDOW, LABELS), np.float32)
    for b in range(0, len(order), batch):
        some = order[b : b + batch]
        at, t = begin[owner[some]] + start[some], int(sizes[some[0]])
        e = net.emissions(flat[at[:, None] + np.arange(t)], sizes[some])
        for scores, a, size, first, last in zip(e, at.tolist(), sizes[some].tolist(), (start[some] == 0).tolist(), (start[some] + sizes[some] == lengths[owner[some]]).tolist()):
            if not first:
                scores[:lap] *= opening[:size]
            if not last:
                scores[STRIDE:] *= 1 - opening
            sums[a : a + size] += scores[:size]
    return sums, begin


def _decoded(net: Network, codes: list[np.ndarray], batch: int) -> list[list[tuple[int, int, int]]]:
    if not codes:
        return []
    lengths = np.array([len(c) for c in codes])
    sums, begin = _joined(net, codes, batch)
    trans, out = net.transitions(), [[] for _ in codes]
    # a long stretch is decoded in parts that overlap; an item belongs to the part its beginning lies in
    parts = [(i, a, max(0, a - LAP), min(int(n), a + PART + LAP)) for i, n in enumerate(lengths) for a in range(0, int(n), PART)]
    parts.sort(key=lambda p: p[2] - p[3])
    at = 0
    while at < len(parts):
        end, cells = at, 0
        while end < len(parts) and (end == at or cells + parts[end][3] - parts[end][2] <= CELLS):
            cells += parts[end][3] - parts[end][2]
            end += 1
        some = parts[at:end]
        labels = viterbi(sums, np.array([begin[i] + a for i, _, a, _ in some]), np.array([z - a for _, _, a, z in some]), trans)
        for row in np.flatnonzero(labels.any(0)):
            i, core, a, _ = some[row]
            out[i] += [(s + a, z + a, kind) for s, z, kind in spans_of(labels[:, row]) if core <= s + a < core + PART]
        at = end
    return [_apart(sorted(spans)) for spans in out]


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in order, of which none begins inside the one before."""
    kept: list[tuple[int, int, int]] = []
    for s in spans:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept
