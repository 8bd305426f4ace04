"""Document scores by a gated recurrent language model, beside a smoothed unigram base.

Counts of all training tokens are gathered first, as a table. They give the base, the model's vocabulary (the most
frequent tokens and one for all others), its classes and its first output weights. The recurrent part gets its first
weights on the driver, from the beginnings of a bounded sample of training documents. From these every task goes on with
all its training documents, each whole, by truncated backpropagation, and the tasks' weights are averaged by tokens. So
all documents shape the model, and its weights depend on how rows lie in partitions. Its output is factored: a class,
then a token within it. A token outside the vocabulary is the class of all others times its share of the base's mass there, so
the model is a distribution over all tokens that the base knows, and its score draws on the whole corpus.

Scoring runs many documents side by side in lanes and carries each document's state across windows, so whole documents
count however long they are. Tokens that are not among the MOST_SHIPPED most frequent meet their counts in a join.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsmith.llm.common import column_slices, materialize, require, small_batches, words_of

#: The end of a document, as a token of the counts: no word is empty.
END = b""
#: Bounds: words sent to all tasks, and their bytes; vocabulary; for the first weights, documents, characters of each, and tokens.
MOST_SHIPPED, MOST_BYTES, VOCABULARY, SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOKENS = 200_000, 64, 2048, 2000, 6000, 500_000
HIDDEN, EMBEDDED, CLASSES, WINDOW, TRAIN_LANES, EPOCHS, LEAST_STEPS, RATE = 32, 16, 45, 20, 64, 2, 400, 4e-3
#: Training on all documents: lanes, steps between dealings, rate, tokens a task should have, and pieces that weights travel in.
STREAM_LANES, STREAM_BLOCK, STREAM_RATE, STREAM_TOKENS, PIECES = 256, 160, 2e-3, 2_000_000, 64
#: First steps of a task, which are of one window each, however few lanes there are.
ALONE = 50
SCORE_LANES, SCORE_WINDOW, CHUNK_TOKENS = 512, 32, 800_000
#: Positions whose output is computed at a time, and logits of which the exponentials are safe as they are.
OUTPUT_BLOCK, SAFE = 512, 60
ALPHA = 0.1


def _softmax_loss(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of the columns' entries `at`, and the sums of the columns' exponentials, which take the place of x.

    Columns are positions of the text, since sums over the first axis are several times faster than over a short last one.
    Entries are small enough for their exponentials: output() lowers those that may not be.
    """
    own = x[at, np.arange(len(at))]
    np.exp(x, out=x)
    total = x.sum(0)
    return own - np.log(total), total


def _to_gradient(x: np.ndarray, at: np.ndarray, total: np.ndarray, n: int) -> None:
    """Exponentials and their sums become the gradient of the loss's mean over n positions, in place of x."""
    x *= 1 / (total * np.float32(n))
    x[at, np.arange(len(at))] -= np.float32(1 / n)


class Adam:
    """The moments of parameters that are changed in place; gradients are clipped to a norm of 1."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.step = p, 0
        self.m1, self.m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}

    def apply(self, grad: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        norm = sum(float(np.vdot(v, v)) for v in grad.values()) ** 0.5
        # plain floats, since numpy's own would turn all into 64 bits
        scale, step, root = min(1.0, 1.0 / max(norm, 1e-9)), float(rate) / (1 - 0.9**self.step), (1 - 0.99**self.step) ** -0.5
        for k, v in grad.items():
            v *= scale
            m1, m2 = self.m1[k], self.m2[k]
            m1 *= 0.9
            m1 += 0.1 * v
            m2 *= 0.99
            v *= v
            v *= 0.01
            m2 += v
            np.sqrt(m2, out=v)
            v *= root
            v += 1e-7
            np.divide(m1, v, out=v)
            v *= step
            self.p[k] -= v


class Gru:
    """Ids 0..vocabulary-1 are tokens, 0 the end, and `vocabulary` stands for all others. Tokens are in order of class."""

    def __init__(self, log_mass: np.ndarray, log_other: float, seed: int = 5):
        m, rng = len(log_mass), np.random.default_rng(seed)
        self.m, self.classes = m, min(CLASSES, m)
        self.first = np.linspace(0, m, self.classes + 1).astype(np.int64)
        self.cls = np.append(np.repeat(np.arange(self.classes), np.diff(self.first)), self.classes).astype(np.int16)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        of_class = [np.logaddexp.reduce(log_mass[a:b]) for a, b in zip(self.first[:-1], self.first[1:], strict=True)]
        self.p = {
            "e": small(m + 1, EMBEDDED), "wx": small(EMBEDDED, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32), "wh": small(HIDDEN, 3 * HIDDEN),
            "wc": small(HIDDEN, self.classes + 1) * 0, "bc": np.array([*of_class, log_other], np.float32), "ww": small(HIDDEN, m) * 0, "bw": log_mass.astype(np.float32),
        }

    def output(self, h: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each target; with grad, also adds the gradients of the mean loss and returns that of h."""
        p, c = self.p, self.cls[target]
        order = np.argsort(c, kind="stable")  # by class, so that each class is a slice
        n, lp, dh = len(h), np.empty(len(h)), None if grad is None else np.empty_like(h)
        # a bias is the weight of one more input, which is 1
        wide, wc, ww = np.ones((n, HIDDEN + 1), h.dtype), np.concatenate([p["wc"], p["bc"][None]]), np.concatenate([p["ww"], p["bw"][None]])
        most = max(float(np.abs(w).sum(0).max()) for w in (wc, ww)) * max(float(h.max(initial=1)), -float(h.min(initial=-1)))
        wide[:, :HIDDEN] = h.take(order, 0)
        h, goal, c, ones = wide[:, :HIDDEN], target[order], c[order], np.ones(OUTPUT_BLOCK, h.dtype)
        for at in range(0, n, OUTPUT_BLOCK):  # pieces that stay in a core's cache
            rows = slice(at, min(at + OUTPUT_BLOCK, n))
            hk, ck = h[rows], c[rows]
            x = wc.T @ wide[rows].T
            if most > SAFE:
                x -= x.max(0)
            lp[rows], total = _softmax_loss(x, ck)
            if grad is not None:
                _to_gradient(x, ck, total, n)
                grad["wc"] += hk.T @ x.T
                grad["bc"] += x @ ones[: len(ck)]
                dh[rows] = x.T @ p["wc"].T
        ends = np.searchsorted(c, np.arange(self.classes + 1))
        for k in range(self.classes):
            a, b = self.first[k], self.first[k + 1]
            for at in range(ends[k], ends[k + 1], OUTPUT_BLOCK):
                rows = slice(at, min(at + OUTPUT_BLOCK, ends[k + 1]))
                hk, wk, own = h[rows], p["ww"][:, a:b], goal[rows] - a
                x = ww[:, a:b].T @ wide[rows].T
                if most > SAFE:
                    x -= x.max(0)
                lk, total = _softmax_loss(x, own)
                lp[rows] += lk
                if grad is not None:
                    _to_gradient(x, own, total, n)
                    grad["ww"][:, a:b] += hk.T @ x.T
                    grad["bw"][a:b] += x @ ones[: len(own)]
                    dh[rows] += x.T @ wk.T
        back = np.empty_like(order)
        back[order] = np.arange(n)
        return lp[back], dh if dh is None else dh.take(back, 0)

    def _halved(self) -> tuple[np.ndarray, np.ndarray]:
        """Each id's inputs, and the recurrent weights with a row for each gate. Sigmoids are made of tanh, so their weights are halved."""
        p, half = self.p, np.repeat(np.array([0.5, 1], np.float32), [2 * HIDDEN, HIDDEN])
        inputs = p["e"] @ (p["wx"] * half)
        inputs += p["b"] * half
        return inputs, (p["wh"] * half).T

    def train(self, docs: list[np.ndarray]) -> None:
        """Several epochs over a sample; states are carried from window to window and cut at documents' starts."""
        if not docs:
            return
        adam, lanes = Adam(self.p), Lanes(docs, TRAIN_LANES)
        width = int(lanes.length.max())
        epochs = max(EPOCHS, -(-LEAST_STEPS // -(-width // WINDOW)))  # small samples more often
        for epoch in range(epochs):
            h = np.zeros((len(lanes.length), HIDDEN), np.float32)
            for t0 in range(0, width, WINDOW):
                steps = [lanes.at(t, int(np.searchsorted(-lanes.length, -t, "left")))[:2] for t in range(t0, min(t0 + WINDOW, width))]
                share = sum(len(prev) for prev, _ in steps) / (WINDOW * len(lanes.length))
                rate = RATE * share * min(1, adam.step / 50 + 0.02) * (0.3 if epoch == epochs - 1 and t0 > width // 2 else 1)
                h = self.learn(steps, h, adam, rate)

    def learn(self, steps: list[tuple[np.ndarray, np.ndarray]], h: np.ndarray, adam: Adam, rate: float) -> np.ndarray:
        """A gradient step on one window of (previous, target) ids, of lanes that end the last ones first; the state after it.

        A document starts where the previous id is 0, since 0 ends each document and is nowhere else. Inside, lanes are
        columns, so that a gate is one block of memory, and products are of one step, so that they stay in a core's cache.
        More steps than a window's are several whole windows of the same lanes, and one gradient step: states are carried
        through all of them, and then, as gradients end with a window, windows lie side by side as if they were lanes.
        """
        p, n = self.p, HIDDEN
        inputs, wh = self._halved()
        saved, outs, h = [], [], h.T
        for prev, _ in steps:
            inside = (prev > 0).astype(np.float32)  # mixed types are multiplied more slowly
            h = h[:, : len(prev)] * inside
            x, hw = np.ascontiguousarray(inputs.take(prev, 0).T), wh @ h
            zr, g, hn = x[: 2 * n], x[2 * n :], hw[2 * n :]
            zr += hw[: 2 * n]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            g += zr[n:] * hn
            np.tanh(g, out=g)
            saved.append((h, zr, g, hn, inside[None]))
            h = h - g
            h *= zr[:n]
            h += g
            outs.append(h.T)
        if len(steps) > WINDOW:
            saved, outs = [[np.concatenate(x, 1) for x in zip(*saved[i::WINDOW], strict=True)] for i in range(WINDOW)], [np.concatenate(outs[i::WINDOW]) for i in range(WINDOW)]
            steps = [tuple(np.concatenate(x) for x in zip(*steps[i::WINDOW], strict=True)) for i in range(WINDOW)]
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        _, dall = self.output(np.concatenate(outs), np.concatenate([goal for _, goal in steps]), grad)
        ends = np.cumsum([0, *(len(prev) for prev, _ in steps)])
        dnext, of_input = np.zeros((n, 0), np.float32), np.empty((ends[-1], EMBEDDED), np.float32)
        # what the candidate gets from the state comes first here, and then the three gates in their order
        back, dwh = np.concatenate([p["wh"][:, 2 * n :], p["wh"][:, : 2 * n]], 1), np.zeros((n, 3 * n), np.float32)
        for i in range(len(steps) - 1, -1, -1):
            (h0, zr, g, hn, inside), prev, own = saved[i], steps[i][0], slice(ends[i], ends[i + 1])
            z, r, d, c = zr[:n], zr[n:], dall[own].T.astype(np.float32, order="C"), np.empty((4 * n, len(prev)), np.float32)
            d[:, : dnext.shape[1]] += dnext
            keep, dg = d * z, c[3 * n :]
            np.multiply(g, g, out=dg)
            np.subtract(1, dg, out=dg)
            d -= keep
            dg *= d
            np.multiply(dg, r, out=c[:n])
            np.subtract(h0, g, out=c[n : 2 * n])
            c[n : 2 * n] *= keep
            np.multiply(c[:n], hn, out=c[2 * n : 3 * n])
            c[n : 3 * n] *= 1 - zr
            dnext = back @ c[: 3 * n]
            dnext += keep
            dnext *= inside
            dwh += np.ascontiguousarray(h0.T).T @ c[: 3 * n].T  # a copy, as this product is twice as fast with it
            of_input[own] = c[n:].T @ p["wx"].T
            grad["wx"] += p["e"].take(prev, 0).T @ c[n:].T
            grad["b"] += c[n:] @ np.ones(len(prev), np.float32)
        grad["wh"] += np.concatenate([dwh[:, n:], dwh[:, :n]], 1)
        prev = np.concatenate([prev for prev, _ in steps]).astype(np.int16)  # short numbers are sorted by digits
        order = np.argsort(prev, kind="stable")
        ids, first = np.unique(prev[order], return_index=True)
        grad["e"][ids] = np.add.reduceat(of_input[order], first)
        adam.apply(grad, rate)
        return h.T

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Sum of natural log probabilities of each document's ids, each of which ends with 0."""
        total = np.zeros(len(docs))
        if not docs:
            return total
        n, lanes = HIDDEN, Lanes(docs, SCORE_LANES)
        inputs, wh = self._halved()
        h, width = np.zeros((n, len(lanes.length)), np.float32), int(lanes.length.max())
        t1 = 0
        while t1 < width:
            t0, outs = t1, []
            # fewer lanes make longer windows, of as many positions
            t1 = min(t0 + SCORE_WINDOW * SCORE_LANES // int(np.searchsorted(-lanes.length, -t0, "left")), width)
            live, at = lanes.window(t0, t1)
            prev, inside, ends = lanes.prev[at], (~lanes.starts[at]).astype(np.float32), np.cumsum([0, *live]).tolist()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                h = h[:, : b - a] * inside[a:b]
                x, hw = np.ascontiguousarray(inputs.take(prev[a:b], 0).T), wh @ h
                zr, g, hn = x[: 2 * n], x[2 * n :], hw[2 * n :]
                zr += hw[: 2 * n]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                hn *= zr[n:]
                g += hn
                np.tanh(g, out=g)
                h -= g
                h *= zr[:n]
                h += g
                outs.append(h.T)
            lp, _ = self.output(np.concatenate(outs), lanes.target[at])
            total += np.bincount(lanes.doc[at], lp, len(docs))
        return total


class Stream:
    """Training on documents as they come, each whole: a document goes to the lane with the least left to learn.

    Lanes carry their states on from block to block; whatever is left in them is learned at the end.
    """

    def __init__(self, gru: Gru):
        self.gru, self.adam, self.tokens = gru, Adam(gru.p), 0
        self.queue: list[list[np.ndarray]] = [[] for _ in range(STREAM_LANES)]
        self.left = [(0, i) for i in range(STREAM_LANES)]
        self.last, self.h = np.zeros(STREAM_LANES, np.int64), np.zeros((STREAM_LANES, HIDDEN), np.float32)

    def add(self, doc: np.ndarray) -> None:
        size, lane = self.left[0]
        self.queue[lane].append(doc.astype(np.int16))
        heapq.heapreplace(self.left, (size + len(doc), lane))
        self.tokens += len(doc)
        if self.left[0][0] >= STREAM_BLOCK:
            self._learn(STREAM_BLOCK)

    def finish(self) -> None:
        while (most := max(self.left)[0]) > 0:
            self._learn(min(most, STREAM_BLOCK * (STREAM_LANES // sum(size > 0 for size, _ in self.left))))

    def _learn(self, width: int) -> None:
        """The next `width` ids of each lane, or all that it has."""
        lanes = [i for size, i in sorted(self.left, reverse=True) if size]
        sizes, target = np.array([min(size, width) for size, _ in sorted(self.left, reverse=True) if size]), np.zeros((width, len(lanes)), np.int64)
        for at, (lane, size) in enumerate(zip(lanes, sizes.tolist(), strict=True)):
            queue, done = self.queue[lane], 0
            while done < size:
                part = queue[0][: size - done]
                target[done : done + len(part), at] = part
                done += len(part)
                if len(part) == len(queue[0]):
                    queue.pop(0)
                else:
                    queue[0] = queue[0][len(part) :]
        prev = np.concatenate([self.last[lanes][None], target[:-1]])
        live = np.searchsorted(-sizes, -np.arange(width), "left")
        h = self.h[lanes]
        t1 = 0
        while t1 < width:
            t0, same = t1, int(np.searchsorted(-live, -live[t1], "right"))
            # few lanes make a step of several windows, of no more ids than all lanes have in one
            windows = max(1, min((same - t0) // WINDOW, STREAM_LANES // int(live[t0]))) if self.adam.step >= ALONE else 1
            t1 = min(t0 + windows * WINDOW, width)
            steps = [(prev[t, : live[t]], target[t, : live[t]]) for t in range(t0, t1)]
            share = sum(len(p) for p, _ in steps) / (WINDOW * STREAM_LANES)  # a step of few ids weighs less
            h = self.gru.learn(steps, h, self.adam, STREAM_RATE * share * min(1, self.adam.step / 20 + 0.05) / np.sqrt(1 + self.adam.step / 50))
        # a lane that has ended has an empty queue; it starts anew, as its last id was 0
        full = [lane for lane, size in zip(lanes, sizes.tolist(), strict=True) if size == width]
        self.last[:] = 0
        self.last[full], self.h[full] = target[-1, : len(full)], h[: len(full)]
        self.left = [(size - min(size, width), i) for size, i in self.left]
        heapq.heapify(self.left)


class Lanes:
    """Documents one after the other in lanes of nearly equal length, the longest lane first."""

    def __init__(self, docs: list[np.ndarray], most: int):
        n = min(most, len(docs))
        heap = [(0, i) for i in range(n)]
        put: list[list[int]] = [[] for _ in range(n)]
        for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            size, lane = heapq.heappop(heap)
            put[lane].append(d)
            heapq.heappush(heap, (size + len(docs[d]), lane))
        put.sort(key=lambda ds: -sum(len(docs[d]) for d in ds))
        self.length = np.array([sum(len(docs[d]) for d in ds) for ds in put], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        order = [d for ds in put for d in ds]
        sizes = np.array([len(docs[d]) for d in order], np.int64)
        self.target = np.concatenate([docs[d] for d in order]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.prev = np.concatenate([[0], self.target[:-1]])
        self.prev[starts] = 0
        self.starts = np.zeros(len(self.target), bool)
        self.starts[starts] = True
        self.doc = np.repeat(np.array(order, np.int64), sizes)

    def at(self, t: int, live: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = self.begin[:live] + t
        return self.prev[i], self.target[i], self.starts[i]

    def window(self, t0: int, t1: int) -> tuple[np.ndarray, np.ndarray]:
        """How many lanes live at each step, and the places of all their ids, step by step."""
        t = np.arange(t0, t1)
        live = np.searchsorted(-self.length, -t, "left")
        places = self.begin[: live[0]] + t[:, None]
        return live, places[t[:, None] < self.length[: live[0]]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for part in column_slices(batches):
        for text in part["text"]:
            counts.update(words_of(text))
            counts[END] += 1
        if len(counts) > 300_000:
            yield flush()
    yield flush()


class Known:
    """The most frequent tokens with their counts, the end first, and what the base makes of them."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int):
        self.words, self.counts = words, np.array(counts, np.float64)
        self.low = total + ALPHA * (distinct + 1)
        self.m = min(VOCABULARY, len(words))
        mass = (self.counts[: self.m] + ALPHA) / self.low
        self.log_mass, self.other = np.log(mass), max(1.0 - float(mass.sum()), ALPHA / self.low)

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words) if i}

    def base(self) -> np.ndarray:
        return np.log10((self.counts + ALPHA) / self.low)


def _ids(words: list[bytes], index: dict[bytes, int], m: int) -> np.ndarray:
    at = np.fromiter(map(index.get, words, repeat(m)), np.int64, len(words))
    return np.append(np.minimum(at, m), 0)


def _learner(known: Known, gru: Gru):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, stream = {w: i for w, i in known.index().items() if i < known.m}, Stream(gru)
        for part in column_slices(batches):
            for text in part["text"]:
                stream.add(_ids(words_of(text), index, known.m))
        stream.finish()
        flat = np.concatenate([gru.p[k].ravel() for k in sorted(gru.p)]).astype(np.float64) * stream.tokens
        pieces = [p.tobytes() for p in np.array_split(flat, PIECES)] if stream.tokens else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([stream.tokens] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], ["piece", "tokens", "sums"])

    return run


def _add_up(group: pd.DataFrame) -> pd.DataFrame:
    sums = np.sum([np.frombuffer(b, np.float64) for b in group["sums"]], axis=0)
    return pd.DataFrame({"piece": group["piece"].iloc[:1], "tokens": [group["tokens"].sum()], "sums": [sums.tobytes()]})


def _learn_all(learn: DataFrame, known: Known, gru: Gru, most_tasks: int) -> None:
    """Every task goes on from the same weights with all its documents; the weights become the average by tokens."""
    learned = materialize(learn.select("text").coalesce(most_tasks).mapInArrow(_learner(known, gru), "piece int, tokens long, sums binary"), "weights")
    rows = sorted(learned.groupBy("piece").applyInPandas(_add_up, "piece int, tokens long, sums binary").collect())
    flat, at = np.concatenate([np.frombuffer(r["sums"], np.float64) / r["tokens"] for r in rows]), 0
    for k in sorted(gru.p):
        v = gru.p[k]
        gru.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size


def _scorer(known: Known, gru: Gru):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, base = known.index(), known.base()
        rows: list[tuple] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            scores = gru.score(ids) / np.log(10)
            cols = list(zip(*rows, strict=True)) or [()] * 9
            out = pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())], strict=True)), pa.array(scores)],
                ["rid", "doc_id", "n_tokens", "n_shipped", "n_other", "base", "other_base", "rare", "rare_n", "gru"],
            )
            rows.clear()
            ids.clear()
            return out

        for part in column_slices(batches):
            for rid, doc_id, text in zip(part["rid"], part["doc_id"], part["text"], strict=True):
                words = words_of(text)
                at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                at = np.append(at, 0)
                shipped = at[at >= 0]
                rare = Counter(words[i] for i in np.flatnonzero(at < 0).tolist())
                other = shipped[shipped >= known.m]
                rows.append((rid, doc_id, len(at), len(shipped), len(other) + sum(rare.values()), float(base[shipped].sum()), float(base[other].sum()), list(rare), list(rare.values())))
                ids.append(np.where((at >= 0) & (at < known.m), at, known.m))
                size += len(at)
            if size >= CHUNK_TOKENS:
                yield flush()
                size = 0
        if rows:
            yield flush()

    return run


def _most_frequent(counts: DataFrame) -> list:
    """Up to MOST_SHIPPED words, all those from some count on, the most frequent first; long words are left out.

    A histogram of counts, of a few thousand rows, tells from which count on the words are few enough to be collected.
    """
    words = counts.where((F.length("word") > 0) & (F.length("word") <= MOST_BYTES))
    n = F.col("n")
    step = F.when(n < 1024, n).otherwise(1024 + F.floor(F.log2(n / 1024) * 32)).cast("int")
    steps = dict(words.groupBy(step.alias("step")).agg(F.count(F.lit(1))).collect())
    least, total = max(steps, default=0) + 1, 0
    for k in sorted(steps, reverse=True):
        total += steps[k]
        if total > MOST_SHIPPED:
            break
        least = k
    return sorted(words.where(step >= least).collect(), key=lambda r: (-r["n"], bytes(r["word"])))


def score_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row.

    Held out are the documents with crc32(doc_id as text) mod 10 equal to 0; a null doc_id is not held out. A null or
    empty text is the end alone. If no document is left to learn from, the counts are all 0 and the model is the base.
    Repeated rows count and are scored as often as they occur. Other columns are ignored; an empty table gives no rows.
    """
    require(docs, "doc_id", "text")
    docs = small_batches(docs).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    learn = docs.where(~held_out)
    counts = materialize(learn.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("n"))), F.lit(0))).first()
    top = _most_frequent(counts)
    known = Known([END, *(bytes(r["word"]) for r in top)], [ends, *(r["n"] for r in top)], total, distinct)
    gru = Gru(known.log_mass, float(np.log(known.other)))
    # about twice as many as needed by their hash, so that few texts are sorted however many there are
    chance = min(1.0, 2 * SAMPLE_DOCS / max(1, ends))
    some = learn.where((F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < F.lit(int(chance * (1 << 30)))) & F.col("text").isNotNull())
    some = some.select("doc_id", "rid", F.substring("text", 1, SAMPLE_CHARS).alias("text"), (F.length("text") > SAMPLE_CHARS).alias("cut"))
    sample = some.orderBy(F.xxhash64("doc_id"), "rid").select("text", "cut").limit(SAMPLE_DOCS).collect()
    index, ids, size = known.index(), [], 0
    for r in sample:
        at = _ids(words_of(r["text"]), index, known.m)
        at = at[:-2] if r["cut"] else at  # the last word may be a part of one, and the end isn't one
        if len(at):
            ids.append(at)
        size += len(at)
        if size >= SAMPLE_TOKENS:
            break
    gru.train(ids)
    if total:
        _learn_all(learn, known, gru, max(1, total // STREAM_TOKENS))
    fields = "rid long, doc_id long, n_tokens long, n_shipped long, n_other long, base double, other_base double, rare array<binary>, rare_n array<int>, gru double"
    scored = materialize(docs.mapInArrow(_scorer(known, gru), fields), "scored")

    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("rid", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("k"))
    met = rare.join(counts, "word", "left").select("rid", "k", F.coalesce("n", F.lit(0)).alias("c"))
    log = F.log10((F.col("c") + F.lit(ALPHA)) / F.lit(known.low))
    by_doc = met.groupBy("rid").agg(F.sum(F.col("k") * log).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known"))
    out = scored.drop("rare", "rare_n").join(by_doc, "rid", "left").na.fill(0, ["rare_base", "rare_known"])
    shipped_known = F.col("n_shipped") if ends else F.col("n_shipped") - 1  # the end is known unless nothing was learned
    return out.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (shipped_known + F.col("rare_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_base")).alias("base_score"),
        (F.col("gru") + F.col("other_base") + F.col("rare_base") - F.col("n_other") * F.lit(float(np.log10(known.other)))).alias("score"),
    )
