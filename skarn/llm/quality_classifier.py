"""Positive-unlabelled quality classifier.

Trusted positives are labelled rows of quality 1, unlabelled text is the corpus.
With class prior p and logistic loss l, a small network minimises the
non-negative unbiased risk

    p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)])

(when the bracket falls below 0, its gradient is reversed).  The prior comes from
positives and unlabelled text alone: a first model ranks rows that it was not
fitted on, and where only positives remain, the share of unlabelled rows above a
score is the prior times the share of positives there; the smallest such ratio,
with a margin for the sample's size, is taken.  Negative labels are never used.
Features are 40 numbers of the whole text (character classes, word and line
statistics, repetition); no label, id, language or source is among them.

Fitting takes at most ``sample`` positives, those with the smallest hash of their
id, and about 0.9 * ``sample`` unlabelled ids, those whose hash lies below a
bound; an id is one row, however often it is there.  Both come from one pass over
the texts and are all that reaches the driver.  Scoring is one pass over every
whole text with a broadcast of a few kB.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import remainder

SAMPLE = 10_000
THRESHOLD = 0.3
HIDDEN, EPOCHS, RATE, DECAY, SEED = 16, 600, 0.02, 1e-3, 7
#: Of the models that rank for the prior, and the chance that its margin is too small.
RANKER_EPOCHS, CONFIDENCE = 150, 0.1

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"#*$%&|<>", b"@", b"+=_~^\\/", b"{}[]()", b"\"'`:;", b"-"]
_CLASS = np.full(256, len(_GROUPS))
for _k, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _k
_CLASS[128:] = len(_GROUPS) + 1
_CLASSES = len(_GROUPS) + 2
N_FEATURES = _CLASSES + 23


def features(text: str | None) -> np.ndarray:
    """The numbers of one text; null is empty."""
    data = (text or "").encode()
    n = max(1, len(data))
    classes = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=_CLASSES)
    words = data.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    top = sorted(counts.values(), reverse=True)[:3] + [0, 0, 0]
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    pairs = Counter(zip(words, words[1:]))
    threes = Counter(zip(words, words[1:], words[2:]))
    line_lengths = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1)
    more = [
        np.log1p(len(data)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        len(counts) / m,
        top[0] / m,
        top[1] / m,
        top[2] / m,
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        (lengths > 15).sum() / m,
        (lengths < 3).sum() / m,
        len(set(lines)) / k,
        line_lengths.mean() / 100,
        line_lengths.std() / 100,
        len(pairs) / max(1, len(words) - 1),
        len(threes) / max(1, len(words) - 2),
        max(threes.values(), default=0) / m,
        (classes[1] / max(1, classes[0] + classes[1])),
        float(len(words) < 20),
        float(len(words) < 50),
        float(classes[9] > 0.02 * n),
        float(not words),
    ]
    return np.concatenate((np.sqrt(classes / n), np.array(more, float))).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of two sets of logits, and the step's gradient by each logit."""
    pos, neg = (1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (positive, unlabelled))
    bracket = -np.log1p(-neg + 1e-12).mean() + prior * np.log1p(-pos + 1e-12).mean()
    value = -prior * np.log(pos + 1e-12).mean() + max(0.0, bracket)
    if bracket >= 0:
        return value, prior * (pos - 1) / len(pos) - prior * pos / len(pos), neg / len(neg)
    return value, prior * pos / len(pos), -neg / len(neg)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS) -> Model:
    """Minimise the non-negative risk by Adam over all rows given; the same rows give the same model."""
    rng = np.random.default_rng(SEED)
    both = np.concatenate((positive, unlabelled)).astype(float)
    if not len(positive) or not len(unlabelled):  # nothing to learn from: the prior for every text
        logit = float(np.log(prior / (1 - prior)))
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), logit)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    z = np.clip((both - mean) / scale, -8, 8)
    p = np.arange(len(z)) < len(positive)
    params = [rng.normal(0, 0.3 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)) * 3, np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.array(0.0)]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, epochs + 1):
        w1, b1, w2, b2 = params
        h = np.tanh(z @ w1 + b1)
        logit = h @ w2 + b2
        _, *g = risk(logit[p], logit[~p], prior)
        g = np.concatenate(g)
        back = np.outer(g, w2) * (1 - h * h)
        grads = [z.T @ back + DECAY * w1, back.sum(0), h.T @ g + DECAY * w2, g.sum()]
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            params[i] = params[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, params[0], params[1], params[2], float(params[3]))


def top_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from the scores of both: the ratio where only positives are left."""
    at = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    margin = sum(np.sqrt(np.log(4 / CONFIDENCE) / (2 * len(x))) for x in (positive, unlabelled))
    best = np.argmin((above_u + margin) / above_p)  # few positives above a score make its ratio unsure
    return float(above_u[best] / above_p[best])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior of ``unlabelled``: each half ranked by a model of the other; 0.5 where there is too little to tell."""
    if min(len(positive), len(unlabelled)) < 8:
        return 0.5
    rng = np.random.default_rng(SEED)
    p, u = (x[rng.permutation(len(x))] for x in (positive, unlabelled))
    halves = [(p[0::2], u[0::2]), (p[1::2], u[1::2])]
    found = []
    for (fit_p, fit_u), (own_p, own_u) in (halves, halves[::-1]):
        model = fit(fit_p, fit_u, 0.5, RANKER_EPOCHS)
        found.append(top_ratio(model.logit(own_p), model.logit(own_u)))
    return float(np.clip(np.mean(found), 0.02, 0.98))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t.as_py()).tolist() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float32()))], names=["key", "positive", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: tuple[int, int] = (5, 0)) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    Labels of rows whose crc32(doc_id) mod held_out[0] is held_out[1] are never
    read.  A doc_id with both labels counts as not positive; null ids and null
    labels are left out.  Of rows with one id that with the smallest features
    stands for it.  Without positives every text gets 0.5.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder(F.col("doc_id"), held_out[0]) != held_out[1]))
    by_id = usable.groupBy("doc_id").agg(F.min(F.col("quality") > 0).alias("positive"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = by_id.filter("positive").orderBy(order, "doc_id").limit(sample).select("doc_id", F.lit(True).alias("positive"))
    # unlabelled: a share of the ids by their hash, so no row's text is read but those taken
    rows = docs.select("doc_id").filter("doc_id is not null").count()
    bound = int(min(1.0, 0.9 * sample / max(1, rows)) * (1 << 32))
    taken = F.pmod(F.xxhash64(F.concat(F.lit("u"), F.col("doc_id").cast("string"))), F.lit(1 << 32)) < bound
    near = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    joined = near.join(F.broadcast(chosen), "doc_id", "left")  # at most ``sample`` ids
    kept = joined.select(F.col("doc_id").cast("string").alias("key"), F.coalesce("positive", F.lit(False)).alias("positive"), "text", taken.alias("taken")).filter(F.col("positive") | F.col("taken"))
    # a sampled positive is unlabelled text as well where the hash takes it
    flags = F.array(*[F.when(F.col("positive"), F.lit(True)), F.when(F.col("taken"), F.lit(False))])
    two = kept.select("key", F.explode(F.filter(flags, lambda f: f.isNotNull())).alias("positive"), "text")
    found = two.mapInArrow(_features, "key string, positive boolean, x array<float>").groupBy("key", "positive").agg(F.min("x").alias("x")).select("positive", "x").toArrow()
    x = np.array(found.column("x").to_pylist(), np.float32).reshape(-1, N_FEATURES)
    mask = np.array(found.column("positive").to_pylist(), bool)
    order_ = np.lexsort(x.T)  # rows come in any order; the sums of the fit must not depend on it
    x, mask = x[order_], mask[order_]
    return fit(x[mask], x[~mask], estimate_prior(x[mask], x[~mask]))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: quality 1 likelier) of every row, of its whole text; null is scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([features(t.as_py()) for t in batch.column(1)]) if batch.num_rows else np.zeros((0, N_FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.3 on) for every row of ``docs``.

    Null texts are scored as empty ones, null ids stay null, repeated rows get
    the same score each; an empty table gives no rows; other columns are ignored.
    """
    scored = score_documents(docs, train(docs, labels, sample))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
