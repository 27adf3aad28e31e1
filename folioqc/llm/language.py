"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time. Every byte position gets a distribution over
languages from the states that read up to it from both sides; a document's probabilities are the
means over its positions. Both directions carry their states through the whole of every text;
documents run side by side, sorted by length, so that few steps are left to a few long ones.
Training backpropagates through windows drawn from all of every sampled text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioqc.llm.common import crc_fold, sample_rows, slices

HIDDEN = 6
#: Bytes of text that run side by side, positions of a block, and bytes of backward states that are
#: kept from block to block; beyond that they are made again for each block.
POOL_BYTES, BLOCK_POSITIONS, KEPT_BYTES = 14 << 20, 1 << 18, 224 << 20
#: Bounds of the learning sample, of whole documents: rows and bytes.
MAX_DOCUMENTS, MAX_BYTES = 3000, 24 << 20
#: Training: window bytes, windows of a step, steps.
WINDOW, TRAIN_LANES, STEPS = 128, 256, 350
UNKNOWN = "und"

LETTER = regex.compile(r"\p{L}")


def _hard_sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.25
    x += 0.5
    return np.clip(x, 0, 1, out=x)


class Direction:
    """A gated recurrent layer; gates are stacked as reset, update, candidate."""

    names = ("table", "u", "c")

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.table = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        self.table[hidden : 2 * hidden] -= 0.5
        self.u = rng.normal(0, 0.6 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)
        self.c = np.zeros((hidden, 1), np.float32)

    def run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (positions, hidden, lanes) for bytes (positions, lanes)."""
        h, (steps, lanes) = self.h, x.shape
        states = np.empty((steps, h, lanes), np.float32)
        s = np.zeros((h, lanes), np.float32)
        for t in range(steps):
            i = np.take(self.table, x[t], axis=1)
            r = self.u @ s
            g = _hard_sigmoid(i[: 2 * h] + r[: 2 * h])
            inner = r[2 * h :] + self.c
            n = np.tanh(i[2 * h :] + g[:h] * inner)
            new = states[t]
            np.subtract(s, n, out=new)
            new *= g[h:]
            new += n
            if keep is not None:
                keep.append((s, g, inner, n))
            s = new
        return states

    def run_block(self, x: np.ndarray, active: np.ndarray, s: np.ndarray, backward: bool) -> np.ndarray:
        """States (positions, hidden, lanes) for bytes x (positions, lanes); at each position only the
        first `active` lanes move. s (hidden, all lanes) is carried on in place."""
        h = self.h
        inputs = np.take(self.table, x, axis=1)
        states = np.zeros((len(x), h, x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1) if backward else range(len(x)):
            k = active[t]
            i, old, new = inputs[:, t, :k], s[:, :k], states[t, :, :k]
            r = self.u @ old
            g = _hard_sigmoid(i[: 2 * h] + r[: 2 * h])
            n = r[2 * h :] + self.c
            n *= g[:h]
            n += i[2 * h :]
            np.tanh(n, out=n)
            np.subtract(old, n, out=new)
            new *= g[h:]
            new += n
            old[:] = new
        return states

    def back(self, x: np.ndarray, keep: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
        h = self.h
        grads = {k: np.zeros_like(getattr(self, k)) for k in self.names}
        ds = np.zeros_like(d_states[0])
        inputs = np.empty((3 * h, *x.shape), np.float32)
        for t in range(len(x) - 1, -1, -1):
            s, g, inner, n = keep[t]
            ds = ds + d_states[t]
            z, r = g[h:], g[:h]
            dn = ds * (1 - z) * (1 - n * n)
            live = (g > 0) & (g < 1)
            dg = np.concatenate([dn * inner, ds * (s - n)]) * 0.25 * live
            dinner = dn * r
            inputs[: 2 * h, t], inputs[2 * h :, t] = dg, dn
            drec = np.concatenate([dg, dinner])
            grads["u"] += drec @ s.T
            grads["c"] += dinner.sum(1, keepdims=True)
            ds = ds * z + self.u.T @ drec
        at = x.ravel()
        for row, values in zip(grads["table"], inputs.reshape(3 * h, -1)):
            row[:] = np.bincount(at, values, 256)
        return grads


class Network:
    """Both directions and the layer that labels positions."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.forward, self.backward = Direction(rng, hidden), Direction(rng, hidden)
        self.out = rng.normal(0, 0.3, (len(classes), 2 * hidden)).astype(np.float32)
        self.bias = np.zeros((len(classes), 1), np.float32)

    def label(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Position probabilities (positions, classes, lanes) and the states under them."""
        a = self.forward.run(x, keep and keep[0])
        b = self.backward.run(x[::-1], keep and keep[1])[::-1]
        states = np.concatenate([a, b], axis=1)
        logits = np.matmul(self.out, states)
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits, states

    def parameters(self) -> list[tuple[object, str]]:
        return [(d, k) for d in (self.forward, self.backward) for k in Direction.names] + [(self, "out"), (self, "bias")]

    def learn(self, x: np.ndarray, solid: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of all solid positions and its gradients."""
        keep: tuple[list, list] = ([], [])
        p, states = self.label(x, keep)
        lanes = np.arange(x.shape[1])
        loss = -(np.log(p[:, y, lanes] + 1e-9) * solid).sum() / solid.sum()
        d = p.copy()
        d[:, y, lanes] -= 1
        d *= (solid / solid.sum())[:, None, :]
        d_states = np.matmul(self.out.T, d)
        h = self.forward.h
        ga = self.forward.back(x, keep[0], d_states[:, :h])
        gb = self.backward.back(x[::-1], keep[1], d_states[::-1, h:])
        g_out = np.einsum("tcl,thl->ch", d, states)
        return loss, [*(ga[k] for k in Direction.names), *(gb[k] for k in Direction.names), g_out, d.sum(axis=(0, 2))[:, None]]


def train(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 11) -> Network:
    """Adam over random windows from anywhere in the sampled texts, languages drawn equally often
    and the texts of a language by their lengths."""
    classes = sorted(set(langs))
    net = Network(classes)
    if len(classes) < 2:
        return net
    raws = [t.encode() for t in texts]
    of_class = {c: [i for i, lang in enumerate(langs) if lang == c and raws[i]] for c in classes}
    ends = {c: np.cumsum([len(raws[i]) for i in of_class[c]]) for c in classes}

    def window(c: str) -> np.ndarray:
        out = np.zeros(WINDOW, np.uint8)
        if of_class[c]:
            raw = raws[of_class[c][int(np.searchsorted(ends[c], rng.integers(0, ends[c][-1]), "right"))]]
            at = int(rng.integers(0, max(1, len(raw) - WINDOW + 1)))
            part = np.frombuffer(raw, np.uint8, min(WINDOW, len(raw) - at), at)
            out[: len(part)] = part
        return out

    rng = np.random.default_rng(seed)
    moments = [[np.zeros_like(getattr(o, k)) for o, k in net.parameters()] for _ in range(2)]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(classes), TRAIN_LANES)
        x = np.stack([window(classes[c]) for c in y], axis=1)
        solid = (x > 0).astype(np.float32)
        _, grads = net.learn(x, solid, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, 1.5 * (1 - step / (steps + 1)))
        for i, ((owner, name), g) in enumerate(zip(net.parameters(), grads)):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            moments[0][i] = 0.9 * moments[0][i] + 0.1 * g
            moments[1][i] = 0.99 * moments[1][i] + 0.01 * g * g
            move = rate * (moments[0][i] / (1 - 0.9**step)) / (np.sqrt(moments[1][i] / (1 - 0.99**step)) + 1e-7)
            setattr(owner, name, (getattr(owner, name) - move).astype(np.float32))
    return net


def pooled(net: Network, texts: list[str], block_positions: int = BLOCK_POSITIONS, kept_bytes: int = KEPT_BYTES) -> np.ndarray:
    """Mean position probabilities (texts, classes) of whole non-empty texts.

    Lanes are the texts, longest first. The backward direction runs from the last position to the
    first, block by block, then the forward one from the first to the last; a position is labelled
    where both have its state. Backward states of all blocks are kept in half precision if they
    take at most kept_bytes; else only the states at the blocks' ends are, and each block's are
    made again when the forward direction is there.
    """
    raws = [t.encode() for t in texts]
    order = sorted(range(len(raws)), key=lambda i: -len(raws[i]))
    sizes = np.asarray([len(raws[i]) for i in order], np.int64)
    totals = np.zeros((len(net.classes), len(raws)))
    if len(sizes):
        flat = np.frombuffer(b"".join(raws[i] for i in order), np.uint8)
        starts = np.cumsum(sizes) - sizes
        blocks = []
        p, lanes = 0, len(sizes)
        while p < sizes[0]:
            lanes = int(np.searchsorted(-sizes[:lanes], -p, "left"))
            blocks.append((p, min(int(sizes[0]), p + max(16, min(4096, block_positions // lanes))), lanes))
            p = blocks[-1][1]

        def load(first: int, last: int, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.arange(first, last)[:, None]
            solid = at < sizes[:lanes]
            x = flat[np.minimum(starts[:lanes] + at, len(flat) - 1)]
            return x, solid, solid.sum(1)

        def backward(block: tuple[int, int, int], s: np.ndarray) -> np.ndarray:
            x, _, active = load(*block)
            return net.backward.run_block(x, active, s, True).astype(np.float16)

        keep_all = sum((b - a) * n for a, b, n in blocks) * 2 * net.backward.h <= kept_bytes
        s = np.zeros((net.backward.h, len(sizes)), np.float32)
        kept = []
        for block in reversed(blocks):
            entered = None if keep_all else s[:, : block[2]].copy()
            states = backward(block, s)
            kept.append(states if keep_all else entered)
        s = np.zeros((net.forward.h, len(sizes)), np.float32)
        h = net.forward.h
        for block in blocks:
            x, solid, active = load(*block)
            b = kept.pop()
            b = b if keep_all else backward(block, b)
            a = net.forward.run_block(x, active, s, False)
            logits = np.matmul(net.out[:, :h], a)
            logits += np.matmul(net.out[:, h:], b.astype(np.float32))
            logits += net.bias
            logits -= logits.max(axis=1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(axis=1, keepdims=True)
            logits *= solid[:, None, :]
            totals[:, : block[2]] += logits.sum(axis=0)
    found = np.empty((len(raws), len(net.classes)))
    found[order] = (totals / np.maximum(1, sizes)).T
    return found


def learning_sample(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_bytes: int = MAX_BYTES) -> tuple[list[str], list[str]]:
    """Texts and languages of a bounded sample of the learning folds: of every language in turn the
    next document by digest, so that a rare language is learnt as well."""
    rows = docs.where("lang is not null and doc_id is not null and text is not null").where(crc_fold() != 2).select("doc_id", "text", "lang")
    found = sample_rows(rows, "text", max_documents, max_bytes, "lang", "lang")
    return [r.text for r in found], [r.lang for r in found]


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    A null text, or one without a letter, is `und` with score 0; so is every text when no document
    has a language to learn from. Each row depends on its own text alone: repeated rows agree, null
    identifiers pass through and are not held out, no row gives no row. Other columns may have any
    names. A text of any length is read whole, in bounded memory but for 2 bytes a character.
    """
    net = train(*learning_sample(docs))

    def label(rows: list[tuple]) -> pa.RecordBatch:
        names, scores = [UNKNOWN] * len(rows), [0.0] * len(rows)
        at = [i for i, r in enumerate(rows) if r[2] and LETTER.search(r[2])] if net.classes else []
        for i, p in zip(at, pooled(net, [rows[i][2] for i in at])):
            names[i], scores[i] = net.classes[int(p.argmax())], float(min(1.0, p.max()))
        ids, held = [r[0] for r in rows], [r[1] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                size += len(row[2] or "")
                if size >= POOL_BYTES:
                    yield label(rows)
                    rows, size = [], 0
        yield label(rows)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(crc_fold() == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
