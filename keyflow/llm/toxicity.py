"""Toxicity by a classifier chain: logistic models of the label categories in a row, each fed the probabilities of the
categories before it. In training those are out-of-fold predictions, so a later model meets the same kind of input as in use.

Features are the distinct words of a text and the first letters of the longer ones; each model picks those that tell its
category most. The models are fitted on the driver on a bounded sample of labelled rows (``rows``, the smallest hashes of
their ids); texts are scored where they lie, whole, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyflow.llm.common import released
from keyflow.llm.words import slices

CATEGORIES = ("quality", "toxic")
#: Labelled rows that the models are fitted on at most, features of a model, folds.
ROWS = 8000
FEATURES = 1536
FOLDS = 4
_SPACE = 1 << 22
_PREFIXES = (4, 5, 6)
_MEMO = 150_000
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Feature numbers of a word: itself, and its first letters where it is longer."""
    names = [word, *(word[:k] + "*" for k in _PREFIXES if len(word) > k)]
    return [zlib.crc32(x.encode()) % _SPACE for x in names]


def text_features(text: str | None) -> np.ndarray:
    words = set(_WORD.findall(text.lower())) if text else ()
    return np.unique(np.array([f for w in words for f in word_features(w)], np.int32))


@dataclass
class Model:
    """One category: feature numbers (sorted), their weights, those of earlier categories' logits, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Model]
    limits: list[float]


def _pick(present: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The features with the largest likelihood ratio, in three texts at least."""
    counts = []
    for value in (1, 0):
        some = [f for f, v in zip(present, y, strict=True) if v == value]
        counts.append(np.bincount(np.concatenate(some), minlength=_SPACE).astype(float) if some else np.zeros(_SPACE))
    keep = np.flatnonzero(counts[0] + counts[1] >= 3)
    a, b = counts[0][keep], counts[1][keep]
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    score = np.zeros(len(keep))
    for seen, row, column in ((a, a + b, n1), (b, a + b, n0), (n1 - a, n1 + n0 - a - b, n1), (n0 - b, n1 + n0 - a - b, n0)):
        expected = np.maximum(row * column / max(len(y), 1), 1e-12)
        score += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / expected), 0.0)
    return np.sort(keep[np.lexsort((keep, -score))[:FEATURES]])


def _table(present: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    out = np.zeros((len(present), len(features)), np.float32)
    for i, f in enumerate(present):
        at = np.searchsorted(features, f)
        at = at[(at < len(features)) & (features[np.minimum(at, len(features) - 1)] == f)] if len(features) else at[:0]
        out[i, at] = 1
    return out


def _fit(x: np.ndarray, y: np.ndarray, decay: float = 2e-4, steps: int = 150, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty by full-batch Adam."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    w, b = np.zeros(x.shape[1], np.float32), float(np.log(share / (1 - share)))
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        error = _chance(x @ w + b) - y
        g = np.append(x.T @ error.astype(np.float32) / max(len(y), 1) + decay * w, error.mean() if len(y) else 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return w, b


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _one(present: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> Model:
    features = _pick(present, y)
    w, b = _fit(np.hstack([_table(present, features), earlier.astype(np.float32)]), y)
    return Model(features, w[: len(features)], w[len(features) :], b)


def _apply(model: Model, present: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    return _chance(_table(present, model.features) @ model.weights + earlier @ model.earlier + model.intercept)


def _limit(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which out-of-fold predictions have the best F1; of equal ones the highest."""
    tries = np.arange(0.1, 0.91, 0.05)
    f1 = [2 * ((p >= t) & (y == 1)).sum() / max(1, (p >= t).sum() + (y == 1).sum()) for t in tries]
    return float(tries[len(tries) - 1 - int(np.argmax(f1[::-1]))])


def fit_chain(present: list[np.ndarray], labels: np.ndarray, categories: tuple[str, ...] = CATEGORIES) -> Chain:
    """``present``: the features of each row; ``labels``: a column of 0 and 1 for each category."""
    n = len(present)
    fold = np.arange(n) % FOLDS
    earlier, models, limits = np.zeros((n, 0)), [], []
    for c in range(len(categories)):
        y, out = labels[:, c].astype(float), np.zeros(n)
        for f in range(FOLDS):
            on, off = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(on):
                model = _one([present[i] for i in off], earlier[off], y[off])
                out[on] = _apply(model, [present[i] for i in on], earlier[on])
        models.append(_one(present, earlier, y))
        limits.append(_limit(out, y) if n else 2.0)
        earlier = np.hstack([earlier, _logit(out)[:, None]])
    return Chain(categories, models, limits)


def _labels(labels: DataFrame, id_column: str, categories: tuple[str, ...], rows: int) -> DataFrame:
    """One row for each labelled id, at most ``rows``: the smallest hashes of ids. Of labels that conflict the more frequent
    one counts, 1 if they are as many."""
    whole = labels.select(F.col(id_column).alias("doc_id"), *categories).dropna()
    one = whole.groupBy("doc_id").agg(*(F.when(F.avg(c) >= 0.5, 1).otherwise(0).alias(c) for c in categories))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", categories: tuple[str, ...] = CATEGORIES, rows: int = ROWS) -> Chain:
    """Fit the chain on at most ``rows`` labelled texts. Rows whose id, text or a label is null, and labels of ids that
    ``docs`` hasn't, aren't used; an id that repeats counts with each of its different texts, one that has conflicting
    labels with the more frequent one. Without rows no text is flagged."""
    names = list(categories)
    chosen = _labels(labels, id_column, categories, rows)
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).where("text is not null").withColumn("mark", F.xxhash64("text"))
    # Of the labelled texts, however often they repeat, at most ``rows`` are sent on.
    picked = texts.select("doc_id", "mark").join(F.broadcast(chosen), "doc_id").distinct().orderBy(F.xxhash64("doc_id", "mark"), "doc_id", "mark").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                found = [text_features(t) for t in some.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                features = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
                yield pa.record_batch([*(some.column(c) for c in ["doc_id", "mark", *names]), features], names=["doc_id", "mark", *names, "features"])

    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, mark long, " + ", ".join(f"{c} int" for c in names) + ", features array<int>"
    once = texts.join(F.broadcast(picked), ["doc_id", "mark"]).groupBy("doc_id", "mark", *names).agg(F.first("text").alias("text"))
    got = once.mapInArrow(released(run), schema).toArrow().combine_chunks()
    ids, marks = got.column("doc_id").to_pylist(), got.column("mark").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i], marks[i]))
    lists = got.column("features").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    present = [values[ends[i] : ends[i + 1]] for i in order]
    table = np.array([got.column(c).to_pylist() for c in names], np.int64).reshape(len(names), len(ids)).T
    return fit_chain(present, table[order], categories)


class Scorer:
    """Probabilities of texts: a memo has the picked features of words, so a text costs a look-up a distinct word, and a
    model's weights are added up over the features that a text has."""

    def __init__(self, chain: Chain):
        self.chain, self.known = chain, {}
        picked = np.unique(np.concatenate([m.features for m in chain.models]))
        self.number = {int(f): i for i, f in enumerate(picked)}
        self.weights = np.zeros((len(chain.models), len(picked)))
        for row, m in zip(self.weights, chain.models, strict=True):
            row[np.searchsorted(picked, m.features)] = m.weights

    def of(self, word: str) -> tuple[int, ...]:
        found = tuple(self.number[f] for f in word_features(word) if f in self.number)
        if len(self.known) >= _MEMO:
            self.known = {}
        self.known[word] = found
        return found

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        flat, size = [], []
        for text in texts:
            on: set[int] = set()
            for w in set(_WORD.findall(text.lower())) if text else ():
                found = self.known.get(w)
                on.update(self.of(w) if found is None else found)
            flat.extend(sorted(on))
            size.append(len(on))
        at, row = np.array(flat, np.int64), np.repeat(np.arange(len(texts)), size)
        earlier = np.zeros((len(texts), 0))
        out = []
        for m, weights in zip(self.chain.models, self.weights, strict=True):
            p = _chance(np.bincount(row, weights[at], minlength=len(texts)) + earlier @ m.earlier + m.intercept)
            out.append(p)
            earlier = np.hstack([earlier, _logit(p)[:, None]])
        return np.stack(out, axis=1) if texts else np.zeros((0, len(self.chain.models)))


def score(docs: DataFrame, chain: Chain, id_column: str = "doc_id", text_column: str = "text", category: str = "toxic") -> DataFrame:
    """(doc_id, p_<category>..., flagged): a row for each row of ``docs``, the probabilities rounded to 6 digits; flagged
    if that of ``category`` reaches its limit. A null text is empty. Other columns are not read."""
    frame = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    c = chain.categories.index(category)
    names = ["doc_id", *(f"p_{x}" for x in chain.categories), "flagged"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chain)
        for batch in batches:
            for some in slices(batch, "text"):
                p = scorer(some.column("text").to_pylist())
                yield pa.record_batch([some.column("doc_id"), *(pa.array(np.round(x, 6)) for x in p.T), pa.array(p[:, c] >= chain.limits[c])], names=names)

    kind = dict(frame.dtypes)["doc_id"]
    return frame.mapInArrow(released(run), f"doc_id {kind}, " + ", ".join(f"{x} double" for x in names[1:-1]) + ", flagged boolean")


def keep_clean(docs: DataFrame, chain: Chain, text_column: str = "text", category: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that aren't flagged, columns as they were; texts stay where they lie."""
    c, place = chain.categories.index(category), docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chain)
        for batch in batches:
            for some in slices(batch, batch.schema.names[place]):
                yield some.filter(pa.array(scorer(some.column(place).to_pylist())[:, c] < chain.limits[c]))

    return docs.mapInArrow(released(run), docs.schema)
