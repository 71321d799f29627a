"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's vector is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes of the text in lower case,
all that is no letter or digit a blank). As the classifier is linear, prediction sums each n-gram's share of every class.

The model is fitted on a bounded sample (``PER_LANG`` rows of each of the ``LANGS`` most frequent languages, chosen by a hash of
their id and text, of texts up to ``SAMPLE_BYTES`` bytes); everything is predicted. A fifth of the sample calibrates the softmax's temperature and the
confidence below which a prediction is marked as rejected.

Defined results: a null text or one without letters is "und" with score 0; an empty table gives no rows; without any
row to learn from all rows are "und"; repeated rows are answered each, and learned once; a null lang is not learned; of
languages with equal scores the first by name is predicted; very long texts are predicted whole, one at a time; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import _TOKEN, flat, lower_bytes, lowered, pieces

BUCKETS, DIM, SIZES = 1 << 15, 16, (2, 3, 4)
PER_LANG, SAMPLE_BYTES, LANGS = 800, 20_000, 256
EPOCHS, BATCH, RATE, ERROR = 6, 32, 0.5, 0.01
UND = "und"


def grams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of each document, and where each document's begin; every document has some. ``data`` is in lower case."""
    gap = max(SIZES) - 1
    folded = np.where(_TOKEN[data], data, np.uint8(32))
    sizes = np.diff(ends)
    starts = ends[:-1] + gap * np.arange(len(sizes))
    buffer = np.full(len(data) + gap * (len(sizes) + 1), 32, np.uint32)
    buffer[np.arange(len(data)) + np.repeat(gap * np.arange(1, len(sizes) + 1), sizes)] = folded
    n = len(buffer) - gap
    key, found = buffer[:n].copy(), []
    for k in range(1, max(SIZES)):
        key |= buffer[k : n + k] << np.uint32(8 * k)
        if k + 1 in SIZES:
            found.append(((key ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(17))
    return np.stack(found), starts


@dataclass
class Model:
    """Share of each bucket in each class's logit, bias, temperature and the least accepted confidence."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found, starts = grams(data, ends)
        counts = np.diff(np.append(starts, found.shape[1])) * len(found)
        out = np.empty((len(starts), len(self.langs)))
        for k in range(len(self.langs)):
            column = self.table[:, k]
            out[:, k] = sum(np.add.reduceat(column[f], starts, dtype=np.float64) for f in found) / counts + self.bias[k]
        return out / self.temperature


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def bags(texts: list[str]) -> np.ndarray:
    """Relative frequencies of the buckets, a row for each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        raw = np.frombuffer(lower_bytes(t), np.uint8)
        found, _ = grams(raw, np.array([0, len(raw)]))
        out[i] = np.bincount(found.ravel(), minlength=BUCKETS) / found.size
    return out


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = order[: len(order) // 5]
    fit = order[len(held) :]
    embed = rng.normal(0, 1, (BUCKETS, DIM)).astype(np.float32)
    weight = np.zeros((DIM, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    weights = np.bincount(y[fit], minlength=len(names)).astype(float)
    weights = np.where(weights > 0, len(fit) / np.maximum(weights, 1) / len(names), 0)
    weight = rng.normal(0, 0.1, weight.shape).astype(np.float32)
    steps, total = 0, max(1, EPOCHS * -(-len(fit) // BATCH))
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            own = fit[at : at + BATCH]
            x = bags([texts[i] for i in own])
            used = np.flatnonzero(x.any(0))
            x = x[:, used]
            hidden = x @ embed[used]
            p = softmax(hidden @ weight + bias)
            p[np.arange(len(own)), y[own]] -= 1
            p *= (weights[y[own]] / len(own))[:, None]
            rate = RATE * (1 - steps / total)
            back = p @ weight.T
            weight -= rate * hidden.T @ p
            bias -= rate * 0.1 * p.sum(0)
            embed[used] -= rate * 100 * x.T @ back
            steps += 1
    model = Model(names, embed @ weight, bias.astype(np.float64))
    if len(held):
        raw = [np.frombuffer(lower_bytes(texts[i]), np.uint8) for i in held]
        logits = np.concatenate([model.logits(r, np.array([0, len(r)])) for r in raw])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        p = softmax(logits / model.temperature)
        sure = np.sort(p.max(1))
        wrong = np.array([np.mean((p.argmax(1) != y[held])[p.max(1) >= s]) for s in sure])
        fine = np.flatnonzero(wrong <= ERROR)
        model.reject_below = float(sure[fine[0]]) if len(fine) else 1.0
    return model


def fold_of(column: Column, folds: int) -> Column:
    """crc32 of an id as text, modulo ``folds``; null ids: 0."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def draw_of(*columns: Column) -> Column:
    """A number from 0 to 1 that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / float(1 << 53)


def sample(docs: DataFrame, learn: Column, per_lang: int = PER_LANG) -> tuple[list[str], list[str]]:
    """Texts and languages to learn from: at most ``per_lang`` rows a language, in the order of a hash."""
    own = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"), draw_of(F.col("doc_id"), F.col("text")).alias("draw"))
    own = own.filter(F.octet_length("text") <= SAMPLE_BYTES)
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_lang * 1.2 / n + 20 / n))])[F.col("lang")]
    rows = sorted((r.draw, r.lang, r.text) for r in own.filter(F.col("draw") <= share).distinct().collect())
    texts, langs, taken = [], [], dict.fromkeys(counts, 0)
    for _, lang, text in rows:
        taken[lang] += 1
        if taken[lang] <= per_lang:
            texts.append(text)
            langs.append(lang)
    return texts, langs


def fit(docs: DataFrame, learn: Column, per_lang: int = PER_LANG) -> Model:
    return train(*sample(docs, learn, per_lang))


def has_letter(texts: pa.Array, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    seen = np.concatenate(([0], np.cumsum(ascii_letter[data])))
    out = seen[ends[1:]] > seen[ends[:-1]]
    for i in np.flatnonzero(~out & (np.diff(ends) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return out


def predict_batch(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    data, ends = flat(texts)
    known = has_letter(texts, data, ends)
    score, langs = np.zeros(len(texts)), [UND] * len(texts)
    if model.langs and known.any():
        p = softmax(model.logits(lowered(texts)[0], ends))
        best = p.argmax(1)
        score = np.where(known, p[np.arange(len(best)), best], 0.0)
        langs = [model.langs[b] if k else UND for b, k in zip(best, known)]
    return langs, score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and accepted (whether the confidence reaches the calibrated limit) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            langs, score = predict_batch(model, batch.column("text"))
            accepted = [lang != UND and s >= model.reject_below for lang, s in zip(langs, score)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
