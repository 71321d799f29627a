"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

A token's vector is the sum of hashed embeddings of the whole word and of its leading 4 to 8 bytes. Filters over 1, 2
and 3 tokens, a rectifier and the maximum over the text give the features of a logistic output. The embeddings start at
random but for a coordinate of each kind (whole word, leading 4 to 8 bytes): the z-score of the bucket's log-odds
between the classes (Monroe et al., "Fightin' Words").

The model is fitted on a bounded sample of labelled rows (``POSITIVES`` and ``NEGATIVES`` rows, chosen by a hash, of
texts up to ``SAMPLE_BYTES`` bytes). The threshold of each language is calibrated on a part of that sample kept from
training; the language is predicted from the text alone. A score is shifted so that its language's threshold is 0.5.

Defined results: a null text counts as empty; an empty text has the score of the pooled zeros; contradicting labels of
one id count as toxic; null labels are not learned; of several texts of one id the first in order is learned; if a class
has no rows to learn from, every score is 0; very long texts are scored whole, one at a time; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import langid
from .batches import ODD, Spans, lower_bytes, lowered, mix, pieces, tokens

LEADING = (4, 5, 6, 7, 8)
KINDS, KIND_BUCKETS = 1 + len(LEADING), 1 << 15
BUCKETS, DIM, FILTERS, WIDTHS = KINDS * KIND_BUCKETS, KINDS + 4, 8, (1, 2, 3)
POSITIVES, NEGATIVES, SAMPLE_BYTES = 1500, 3000, 20_000
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.03, 1e-4
_SCALARS = "doc_id long, score double, predicted int, lang_pred string"


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each token (a row: the word, then its leading parts) and the first token of each document; ``data`` is in lower case."""
    start, stop = tokens(data, ends)
    first = np.searchsorted(start, ends)
    spans = Spans(mix(data.astype(np.uint64) + ODD))
    out = np.empty((len(start), KINDS), np.int32)
    out[:, 0] = spans(start, stop) % np.uint64(KIND_BUCKETS)
    for k, n in enumerate(LEADING, 1):
        out[:, k] = (spans(start, np.minimum(stop, start + n)) % np.uint64(KIND_BUCKETS)).astype(np.int32) + k * KIND_BUCKETS
    return out, first


@dataclass
class Model:
    """Embeddings, filters by width (width * DIM, FILTERS), their biases, output weights; thresholds by language."""

    embed: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0
    languages: langid.Model | None = None

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        x = self.embed[buckets[:, 0]]
        for k in range(1, buckets.shape[1]):
            x = x + self.embed[buckets[:, k]]
        return x

    def pooled(self, x: np.ndarray, first: np.ndarray, places: bool = False):
        """Maximum of each filter over each document (0 at least), and with ``places`` where it is (-1: nowhere)."""
        docs = len(first) - 1
        maxima, where = np.zeros((docs, FILTERS * len(WIDTHS)), np.float32), np.full((docs, FILTERS * len(WIDTHS)), -1)
        size = np.diff(first)
        for j, w in enumerate(WIDTHS):
            full = np.flatnonzero(size >= w)
            if not len(full):
                continue
            n = len(x) - w + 1
            y = x[:n] @ self.filters[w][:DIM]
            for k in range(1, w):
                y += x[k : n + k] @ self.filters[w][k * DIM : (k + 1) * DIM]
            y += self.biases[w]
            # windows that cross into the next document don't count
            for k in range(1, w):
                late = first[1:] - k
                late = late[(late >= 0) & (late < n)]
                y[late] = 0
            bounds = np.minimum(first[:-1][full], n - 1)
            cols = slice(j * FILTERS, (j + 1) * FILTERS)
            if places:
                for d in full:
                    own = y[first[d] : first[d + 1] - w + 1]
                    at = own.argmax(0)
                    value = own[at, np.arange(FILTERS)]
                    maxima[d, cols] = np.maximum(value, 0)
                    where[d, cols] = np.where(value > 0, at + first[d], -1)
            else:
                maxima[full, cols] = np.maximum(np.maximum.reduceat(y, bounds, axis=0), 0)
        return (maxima, where) if places else maxima

    def logits(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        buckets, first = features(data, ends)
        return (self.pooled(self.vectors(buckets), first) @ self.out + self.out_bias).astype(np.float64)


def _encode(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    raw = [np.frombuffer(lower_bytes(t), np.uint8) for t in texts]
    return [features(r, np.array([0, len(r)])) for r in raw]


def log_odds(coded: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """z-scores of the log-odds of the classes by bucket, from the documents that hold it."""
    seen = np.zeros((2, BUCKETS))
    for buckets, label in zip(coded, y):
        seen[int(label), np.unique(buckets)] += 1
    n = np.array([np.count_nonzero(y == 0), np.count_nonzero(y == 1)])[:, None]
    prior = 0.2 + 5 * seen.sum(0) / n.sum() * 0.1
    a, b = seen[1] + prior, seen[0] + prior
    odds = np.log(a / (n[1] + 1 - seen[1] + prior)) - np.log(b / (n[0] + 1 - seen[0] + prior))
    z = odds / np.sqrt(1 / a + 1 / b)
    return z


def train(texts: list[str], labels: list[int], languages: langid.Model, seed: int = 11) -> Model | None:
    """The model, or None if a class is missing."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        held[own[: len(own) // 4]] = True
    coded = [c for c, _ in _encode(texts)]
    fit = np.flatnonzero(~held)
    embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    embed[:, :KINDS] = 0
    odds = np.clip(log_odds([coded[i] for i in fit], y[fit]), -2, 8) / 4
    embed[np.arange(BUCKETS), np.arange(BUCKETS) // KIND_BUCKETS] = odds
    model = Model(embed, {}, {}, np.full(FILTERS * len(WIDTHS), 0.3, np.float32), -2.0)
    for w in WIDTHS:
        f = rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32)
        for k in range(FILTERS):  # each filter starts with a kind of its own, the last ones with all
            f[:, k if k < KINDS else slice(0, KINDS), k] += 1 / w if k < KINDS else 0.4 / w
        model.filters[w], model.biases[w] = f.reshape(w * DIM, FILTERS), np.full(FILTERS, -0.5, np.float32)
    moments: dict[str, np.ndarray] = {}

    def step(name: str, value: np.ndarray, grad: np.ndarray, rows=None) -> None:
        """Adagrad."""
        m = moments.setdefault(name, np.full_like(value, 1e-3))
        if rows is None:
            m += grad * grad
            value -= RATE * (grad + DECAY * value) / np.sqrt(m)
        else:
            m[rows] += grad * grad
            value[rows] -= RATE * grad / np.sqrt(m[rows])

    weight = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * len(fit)

    def forward(rows: np.ndarray, places: bool = False):
        first = np.concatenate(([0], np.cumsum([len(coded[i]) for i in rows])))
        flat_ = np.concatenate([coded[i] for i in rows])
        x = model.vectors(flat_)
        return flat_, x, model.pooled(x, first, places)

    def scores(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([forward(rows[at : at + 64])[2] @ model.out + model.out_bias for at in range(0, len(rows), 64)])

    held_rows, best = np.flatnonzero(held), None
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            own = fit[at : at + BATCH]
            flat_, x, (maxima, where) = forward(own, True)
            p = 1 / (1 + np.exp(-(maxima @ model.out + model.out_bias)))
            error = ((p - y[own]) * weight[own] / len(own)).astype(np.float32)
            back = error[:, None] * model.out[None, :] * (where >= 0)
            step("out", model.out, maxima.T @ error)
            model.out_bias -= RATE * float(error.sum())
            rows, grads = [], []
            for j, w in enumerate(WIDTHS):
                cols = slice(j * FILTERS, (j + 1) * FILTERS)
                d, f = np.nonzero(where[:, cols] >= 0)
                place, g = where[:, cols][d, f], back[:, cols][d, f]
                grad = np.zeros_like(model.filters[w])
                for k in range(w):
                    np.add.at(grad[k * DIM : (k + 1) * DIM].T, f, g[:, None] * x[place + k])
                    hit = g[:, None] * model.filters[w][k * DIM : (k + 1) * DIM].T[f]
                    for column in flat_[place + k].T:
                        rows.append(column)
                        grads.append(hit)
                step(f"filter{w}", model.filters[w], grad)
                bias = np.zeros(FILTERS, np.float32)
                np.add.at(bias, f, g)
                step(f"bias{w}", model.biases[w], bias)
            if rows:
                row, grad = np.concatenate(rows), np.concatenate(grads)
                used, at_row = np.unique(row, return_inverse=True)
                total = np.zeros((len(used), DIM), np.float32)
                np.add.at(total, at_row, grad)
                step("embed", model.embed, total, used)
        if len(held_rows):
            s = scores(held_rows)
            loss = float((np.logaddexp(0, np.where(y[held_rows] == 1, -s, s)) * weight[held_rows]).mean())
            if best is None or loss < best[0]:
                best = loss, model.embed.copy(), {k: v.copy() for k, v in model.filters.items()}, {k: v.copy() for k, v in model.biases.items()}, model.out.copy(), model.out_bias
    if best is not None:
        _, model.embed, model.filters, model.biases, model.out, model.out_bias = best
    model.languages = languages
    rows = held_rows if y[held_rows].any() else np.arange(len(y))
    calibrate(model, scores(rows), y[rows], langid.predict_batch(languages, pa.array([texts[i] for i in rows]))[0])
    return model


def calibrate(model: Model, logits: np.ndarray, y: np.ndarray, langs: list[str], least: int = 8) -> None:
    """The cut with the best F1 overall; for each language with ``least`` rows of both classes its own, halfway to that overall."""
    model.threshold = best_cut(logits, y)
    for lang in set(langs):
        own = np.array([x == lang for x in langs])
        if min(y[own].sum(), (1 - y[own]).sum()) >= least:
            model.thresholds[lang] = (best_cut(logits[own], y[own]) + model.threshold) / 2


def best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """In the middle of the widest gap between scores that gives the best F1."""
    order = np.argsort(-logits)
    s, t = logits[order], y[order]
    hits = np.cumsum(t)
    f1 = np.round(2 * hits / (np.arange(1, len(t) + 1) + t.sum()), 9)
    low = np.append(s[1:], s[-1] - 1)
    top = np.flatnonzero(f1 == f1.max())
    k = top[np.argmax((s - low)[top])]
    return float((s[k] + low[k]) / 2)


def sample(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from, at most so many of each class, in the order of a hash; ``learn`` is on labels.doc_id."""
    own = labels.filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.withColumn("draw", langid.draw_of(F.col("id")))
    counts = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {0: negatives, 1: positives}
    if not all(counts.get(k) for k in most):
        return [], []
    chosen = own.filter(F.when(F.col("toxic") == 1, F.col("draw") <= min(1.0, (positives * 1.1 + 50) / counts[1])).otherwise(F.col("draw") <= min(1.0, (negatives * 1.1 + 50) / counts[0])))
    texts = docs.filter(F.octet_length("text") <= SAMPLE_BYTES).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "draw", "toxic").agg(F.min("text").alias("text"))  # some 5,000 ids
    rows = sorted((r.draw, r.id, r.text, r.toxic) for r in found.collect())
    kept = [x for k in most for x in [r for r in rows if r[3] == k][: most[k]]]
    return [r[2] for r in kept], [r[3] for r in kept]


def fit(docs: DataFrame, labels: DataFrame, learn_docs: Column, learn_labels: Column) -> Model | None:
    """Languages are learned from ``learn_docs`` rows of ``docs``, toxicity from ``learn_labels`` rows of ``labels``."""
    texts, toxic = sample(docs, labels, learn_labels)
    if not texts:
        return None
    return train(texts, toxic, langid.fit(docs, learn_docs, 200))


def score_batch(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    if model is None:
        return np.zeros(len(texts)), [langid.UND] * len(texts)
    data, ends = lowered(texts)
    langs = langid.predict_batch(model.languages, texts)[0]
    cut = np.array([model.thresholds.get(x, model.threshold) for x in langs])
    return 1 / (1 + np.exp(-np.clip(model.logits(data, ends) - cut, -500, 500))), langs


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted and the predicted language of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            s, langs = score_batch(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(langs, pa.string())], ["doc_id", "score", "predicted", "lang_pred"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCALARS)


def reject(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; columns and types stay."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            s, _ = score_batch(model, batch.column("text"))
            kept = batch.filter(pa.array(s < 0.5))
            if kept.num_rows:
                yield kept

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, docs.schema)
