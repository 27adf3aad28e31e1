"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every other document of the learning folds, whatever
its label, is only unlabelled text. A linear classifier over hashed words and word stems is trained
in numpy on the class-prior-corrected risk

    prior * R+(1) + max(0, R-unlabelled - prior * R-(positives))

whose second part is clipped at zero, and stepped back up when a batch drives it below. The class
prior is estimated from margins that documents have under fits which have not seen them, and so is
the map from margins to probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioqc.llm.common import crc_fold, sample_rows, slices

TOKEN = re.compile(r"[^\W\d_]+")
STEMS = (4, 5)
#: Bounds of the learning sample, of whole documents: rows of either kind, and bytes of each kind.
MAX_POSITIVE, MAX_UNLABELLED, MAX_BYTES = 4000, 8000, 24 << 20
#: Features: buckets of hashed words and stems, the most that are kept, and the two-sample z, in
#: either direction, that one must reach between positives and unlabelled text.
BUCKETS, MAX_FEATURES, MIN_Z = 1 << 20, 4000, 5.0
#: Prior of the first fits, which only rank documents for the estimate; parts of the sample, each of
#: which gets its margins from a fit to the others.
FIRST_PRIOR, PARTS = 0.1, 3
CUTOFF = 0.3


@dataclass
class Model:
    """Weights by bucket, and the fitted map of the margin to a probability."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -4.0
    scale: float = 1.0
    shift: float = 0.0
    prior: float = 0.0


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def stems(words: set[str]) -> set[str]:
    return {w[:n] + "*" for n in STEMS for w in words if len(w) >= n}


def features(text: str | None) -> np.ndarray:
    """Buckets of the distinct words of the whole text in lower case, and of their stems."""
    words = set(TOKEN.findall((text or "").lower()))
    return np.unique(np.fromiter(map(_bucket, (*words, *stems(words))), np.int64))


def select_features(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Buckets whose share of documents differs most between positives and unlabelled text."""
    n, m = max(1, len(positive)), max(1, len(unlabelled))
    p, u = (np.bincount(np.concatenate([np.zeros(0, np.int64), *rows]), minlength=BUCKETS) for rows in (positive, unlabelled))
    pooled = (p + u + 1) / (n + m + 2)
    z = (p / n - u / m) / np.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    kept = np.flatnonzero((np.abs(z) >= MIN_Z) & (p + u >= 3))
    return kept[np.argsort(-np.abs(z[kept]), kind="stable")][:MAX_FEATURES]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(rows: list[np.ndarray], names: np.ndarray) -> np.ndarray:
    """One byte for each document and feature."""
    order = np.argsort(names)
    sorted_names = names[order]
    x = np.zeros((len(rows), len(names)), np.uint8)
    for i, row in enumerate(rows):
        at = np.searchsorted(sorted_names, row)
        at, row = at[at < len(names)], row[at < len(names)]
        x[i, order[at[sorted_names[at] == row]]] = 1
    return x


def risk_gradients(sp: np.ndarray, su: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the non-negative risk by the margins of positives and of unlabelled rows, whose
    sigmoids are given. Calling z positive costs 1 - s(z), calling it negative s(z)."""
    dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
    if su.mean() - prior * sp.mean() >= 0:
        return -2 * prior * dp, du
    return prior * dp, -du


def fit(xp: np.ndarray, xu: np.ndarray, prior: float, epochs: int = 60, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over batches."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(xp.shape[1]), -1.0
    moments = [np.zeros(len(w) + 1), np.zeros(len(w) + 1)]
    step = 0
    for _ in range(epochs):
        parts = max(1, min(len(xp), len(xu) // 512))
        for ip, iu in zip(np.array_split(rng.permutation(len(xp)), parts), np.array_split(rng.permutation(len(xu)), parts)):
            p, u = xp[ip].astype(np.float32), xu[iu].astype(np.float32)
            gp, gu = risk_gradients(_sigmoid(p @ w + b), _sigmoid(u @ w + b), prior)
            grad = np.append(p.T @ gp + u.T @ gu + 1e-4 * w, gp.sum() + gu.sum())
            step += 1
            moments[0] = 0.9 * moments[0] + 0.1 * grad
            moments[1] = 0.999 * moments[1] + 0.001 * grad**2
            move = 0.03 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def estimated_prior(zp: np.ndarray, zu: np.ndarray, delta: float = 1.0) -> float:
    """Share of positives in unlabelled rows, from margins of rows that training did not see.

    Above any cut the unlabelled share is at least prior times the positives' share. The cut is
    taken where the upper confidence bound of their quotient is least.
    """
    cuts = np.unique(zp)
    p, u = 1 - np.searchsorted(np.sort(zp), cuts, "left") / len(zp), 1 - np.searchsorted(np.sort(zu), cuts, "left") / len(zu)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(zp)) + 1 / np.sqrt(len(zu)))
    best = int(np.argmin((u + slack) / p))
    return float(np.clip(u[best] / p[best], 0.005, 0.9))


def calibrated(zp: np.ndarray, zu: np.ndarray, prior: float, ridge: float = 1e-5) -> tuple[float, float]:
    """scale and shift that make sigmoid(scale * z + shift) a probability, from margins of unseen rows.

    With logistic loss the class-prior-corrected risk is mean(softplus(m)) over unlabelled rows less
    prior * mean(m) over positives, for m = scale * z + shift: convex, so Newton steps find its least
    value; the ridge keeps it finite."""
    mean, spread = float(zu.mean()), max(1e-6, float(zu.std()))
    xp, xu = (np.stack([(z - mean) / spread, np.ones(len(z))], 1) for z in (zp, zu))
    v = np.array([1.0, float(np.log(prior / (1 - prior)))])

    def risk(v: np.ndarray) -> float:
        return float(np.logaddexp(0, xu @ v).mean() - prior * (xp @ v).mean() + ridge / 2 * v @ v)

    for _ in range(60):
        s = _sigmoid(xu @ v)
        g = xu.T @ s / len(xu) - prior * xp.mean(0) + ridge * v
        move = np.linalg.solve((xu * (s * (1 - s) / len(xu))[:, None]).T @ xu + ridge * np.eye(2), g)
        size = 1.0
        while size > 1e-4 and risk(v - size * move) > risk(v):
            size /= 2
        v = v - size * move
    return float(v[0] / spread), float(v[1] - v[0] * mean / spread)


def unseen_margins(rows_p: list[np.ndarray], rows_u: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Margins of all rows, each from features and weights that were chosen without its part."""
    zp, zu = np.zeros(len(rows_p)), np.zeros(len(rows_u))
    for k in range(PARTS):
        names = select_features([r for i, r in enumerate(rows_p) if i % PARTS != k], [r for i, r in enumerate(rows_u) if i % PARTS != k])
        xp, xu = _matrix(rows_p, names), _matrix(rows_u, names)
        p, u = np.arange(len(rows_p)) % PARTS == k, np.arange(len(rows_u)) % PARTS == k
        w, b = fit(xp[~p], xu[~u], prior)
        zp[p], zu[u] = xp[p] @ w + b, xu[u] @ w + b
    return zp, zu


def train(positive: list[str], unlabelled: list[str], prior: float | None = None) -> Model:
    """Estimate the prior, fit all rows with it, and calibrate with margins of unseen rows. Without
    enough positives or unlabelled text to divide, the model calls nothing toxic."""
    rows_p, rows_u = [features(t) for t in positive], [features(t) for t in unlabelled]
    if min(len(rows_p), len(rows_u)) < 2 * PARTS:
        return Model()
    if prior is None:
        prior = estimated_prior(*unseen_margins(rows_p, rows_u, FIRST_PRIOR))
    scale, shift = calibrated(*unseen_margins(rows_p, rows_u, prior), prior)
    names = select_features(rows_p, rows_u)
    w, b = fit(_matrix(rows_p, names), _matrix(rows_u, names), prior)
    return Model({int(n): float(x) for n, x in zip(names, w)}, b, scale, shift, prior)


class Scorer:
    """Scores texts; weights of words are looked up once each, in a bounded memo."""

    def __init__(self, model: Model, memo_words: int = 500_000):
        self.model, self.memo, self.memo_words = model, {}, memo_words

    def _known(self, word: str) -> int:
        found = self.memo.get(word)
        if found is None:
            n = _bucket(word)
            found = self.memo[word] = n if n in self.model.weights else -1
        return found

    def __call__(self, text: str | None) -> float:
        """Probability of a whole text; an empty or null text gets the score of no evidence."""
        if len(self.memo) > self.memo_words:
            self.memo.clear()
        words = set(TOKEN.findall((text or "").lower()))
        found = set(map(self._known, words))
        found.update(map(self._known, stems(words)))
        found.discard(-1)
        m = self.model
        return float(_sigmoid(np.float64(m.scale * (m.bias + sum(m.weights[n] for n in sorted(found))) + m.shift)))


def learning_sample(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_bytes: int = MAX_BYTES) -> tuple[list[str], list[str]]:
    """Texts of a bounded sample of confirmed toxic and of all other learning documents. Of the labels
    the first 2 * max_positive toxic identifiers by digest are looked for, so their list is short."""
    toxic = labels.where("doc_id is not null and toxic = 1").where(crc_fold() != 2).select("doc_id").distinct()
    toxic = F.broadcast(toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_positive))
    rows = docs.where("text is not null and doc_id is not null").where(crc_fold() != 2).select("doc_id", "text")
    positive = sample_rows(rows.join(toxic, "doc_id", "left_semi"), "text", max_positive, max_bytes, "toxic")
    unlabelled = sample_rows(rows, "text", max_unlabelled, max_bytes, "unlabelled")
    ids = {r.doc_id for r in positive}
    return [r.text for r in positive], [r.text for r in unlabelled if r.doc_id not in ids]


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    The model, a bounded list of weights, goes to the executors with the code. Each row is scored
    from its own text alone: repeated rows agree, null texts count as empty, null identifiers are
    scored and not held out. With no label there is no positive and nothing is predicted toxic; no
    row gives no row. Only doc_id and text are read of docs, doc_id and toxic of labels, so other
    columns may have any names. Texts of any length are read whole.
    """
    model = train(*learning_sample(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in slices(batches):
            scores = pa.array([score(t) for t in batch.column(2).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["doc_id", "held_out", "score"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(crc_fold() == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
