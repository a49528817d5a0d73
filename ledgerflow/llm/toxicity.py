"""Toxicity by a classifier chain.

The labels say whether a document is toxic and whether it is good. From them and the text come three categories, in the
chain's order: `dense` (toxic, and at least half as full of tell-tale words as the median toxic document), `junk`
(toxic and of low quality), and `toxic`. Each is a linear model of word features and of the probabilities of the
categories before it. Those inputs are out-of-fold in training: each row's come from models that have not seen it, whose
features were selected, and whose median was taken, without it. The labels have one toxicity column; the first two categories
are made from it, the quality label and the text, and serve the last.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import restored, set_aside, slices, views
from ledgerflow.llm.quality import bounded

#: At most so many labelled toxic and other documents, those with the smallest hashes of their ids, are learned from; of these as
#: many as have MOST_FEATURES features in all, and none longer than MOST_BYTES.
SAMPLE_TOXIC, SAMPLE_CLEAN, MOST_FEATURES, MOST_BYTES = 1500, 3000, 20_000_000, 1_000_000
CHAIN = ("dense", "junk", "toxic")
FOLDS = 5
BUCKETS = 1 << 20
SELECTED = 1200
PREFIXES = (3, 4, 5, 6, 7)
STEPS = 300
THRESHOLD = 0.5
CACHE = 300_000
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&@~^=+-_/\\«»„“”‚‘’…¡¿"


def word_features(word: str) -> tuple[int, ...]:
    """Hash buckets of a lower-cased word: itself and its proper beginnings."""
    word = word.strip(_STRIP)
    if not word:
        return ()
    own = {zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) % BUCKETS}
    own |= {zlib.crc32(b"p" + word[:k].encode("utf-8", "surrogatepass")) % BUCKETS for k in PREFIXES if len(word) > k}
    return tuple(own)


class Counter:
    """Counts of features in texts. With a selection only its features are counted; words are remembered, boundedly."""

    def __init__(self, selected: dict[int, int] | None = None) -> None:
        self.selected, self.known = selected, {}

    def of(self, word: str) -> tuple[int, ...]:
        got = word_features(word)
        if self.selected is not None:
            got = tuple(self.selected[f] for f in got if f in self.selected)
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[word] = got
        return got

    def count(self, text: str | None) -> tuple[list[int], list[int], int]:
        """(features, their counts, number of words)"""
        words = (text or "").lower().split()
        counts: dict[int, int] = {}
        known, of = self.known, self.of
        for w in words:
            got = known.get(w)
            if got is None:
                got = of(w)
            for f in got:
                counts[f] = counts.get(f, 0) + 1
        return list(counts), list(counts.values()), len(words)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter()
    for batch in slices(batches):
        rows = [counter.count(t) for t in batch.column("text").to_pylist()]
        made = [
            pa.array([len(f) for f, _, _ in rows], pa.int64()), pa.array([np.array(f, "<i4").tobytes() for f, _, _ in rows], pa.binary()),
            pa.array([np.minimum(np.array(c, np.int64), 255).astype("u1").tobytes() for _, c, _ in rows], pa.binary()), pa.array([n for _, _, n in rows], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "h", "toxic", "quality")], *made], names=["doc_id", "h", "toxic", "quality", "n", "features", "counts", "words"])


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = STEPS, penalty: float = 2e-4) -> np.ndarray:
    """Logistic regression, both classes with the same weight in all; the last weight is the constant."""
    if not len(y) or y.min() == y.max():
        return np.concatenate((np.zeros(x.shape[1]), [8.0 if len(y) and y.max() else -8.0]))
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum()).astype(x.dtype)
    w, m1, m2 = (np.zeros(x.shape[1] + 1, x.dtype) for _ in range(3))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        r = (y - p) * weight
        grad = np.concatenate((x.T @ r - penalty * w[:-1], [r.sum()]))
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        w = w + 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return w


def predict_linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Folds(Sequence):
    """For each fold which rows are in it, and features and labels of all rows as they are made without those rows. A fold's table
    is as large as that of all rows, so each is made when it is asked for, and none is kept."""

    def __init__(self, folds: int, make: Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.folds, self.make = folds, make

    def __len__(self) -> int:
        return self.folds

    def __getitem__(self, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.make(range(self.folds)[f])


def _of_fold(own: np.ndarray, x: np.ndarray, labels: np.ndarray, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are in the fold, and their probabilities by a model of the others."""
    if not own.any():
        return own, np.zeros(0, x.dtype)
    seen = np.hstack((x, probs))
    return own, predict_linear(seen[own], fit_linear(seen[~own], labels[~own]))


def fit_chain(x: np.ndarray, labels: np.ndarray, away: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """A model for each column of labels; each sees the features and the out-of-fold probabilities of those before it.

    away: for each fold which rows are in it, and features and labels of all rows as they are made without those rows.
    """
    models, probs = [], np.zeros((len(x), 0), x.dtype)
    for k in range(labels.shape[1]):
        models.append(fit_linear(np.hstack((x, probs)), labels[:, k]))
        if k + 1 < labels.shape[1]:
            out = np.zeros((len(x), 1), x.dtype)
            for f in range(len(away)):
                own, fold_x, fold_labels = away[f]
                own, out[own, 0] = _of_fold(own, fold_x, fold_labels[:, k], probs)
                del fold_x  # before the next one is made
            probs = np.hstack((probs, out))
    return models


def predict_chain(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    out = []
    for w in models:
        p = predict_linear(x, w)
        out.append(p)
        x = np.hstack((x, p[:, None].astype(x.dtype)))
    return np.column_stack(out)


def _scaled(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Feature values: the logarithm of the count, less in long texts, in which chance hits are more."""
    return np.log1p(counts) / np.sqrt(1 + np.maximum(words, 1) / 400.0)[:, None].astype(np.float32)


def select(features: list[np.ndarray], toxic: np.ndarray, most: int = SELECTED) -> dict[int, int]:
    """The features whose presence in toxic documents exceeds that in others most, by chi-square."""
    n1, n0 = max(int(toxic.sum()), 1), max(int((toxic == 0).sum()), 1)
    a, b = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    for f, t in zip(features, toxic, strict=True):
        (a if t else b)[f] += 1
    p = (a + b) / (n1 + n0)
    chi = np.where((a / n1 > 1.5 * b / n0) & (a >= 3), (a / n1 - b / n0) ** 2 / np.maximum(p * (1 - p), 1e-9), 0)
    top = np.argsort(-chi, kind="stable")[:most]
    return {int(f): i for i, f in enumerate(top[chi[top] > 0])}


def _table(features: list[np.ndarray], counts: list[np.ndarray], words: np.ndarray, selected: dict[int, int]) -> np.ndarray:
    """Values of the selected features for each row."""
    out = np.zeros((len(features), len(selected)), np.float32)
    place = np.full(BUCKETS, -1, np.int32)
    place[list(selected)] = list(selected.values())
    for i, (f, c) in enumerate(zip(features, counts, strict=True)):
        at = place[f]
        out[i, at[at >= 0]] = c[at >= 0]
    return _scaled(out, words)


def _categories(x: np.ndarray, toxic: np.ndarray, low: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The chain's labels of all rows; the median is that of the used ones."""
    density = x.sum(axis=1)
    own = density[(toxic > 0) & used]
    middle = float(np.median(own)) if len(own) else 0.0
    return np.column_stack(((toxic > 0) & (density >= middle / 2), (toxic > 0) & low, toxic > 0)).astype(np.float32)


def fitted(features: list[np.ndarray], counts: list[np.ndarray], words: np.ndarray, toxic: np.ndarray, low: np.ndarray, folds: int = FOLDS) -> dict:
    """The selected features and the chain's models."""
    selected = select(features, toxic)
    if not len(toxic):
        return {"selected": selected, "models": []}
    everything = np.ones(len(toxic), bool)
    x = _table(features, counts, words, selected)
    fold = np.arange(len(toxic)) % folds

    def without(f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = fold == f
        kept = select([v for v, o in zip(features, own, strict=True) if not o], toxic[~own])
        fold_x = _table(features, counts, words, kept)
        return own, fold_x, _categories(fold_x, toxic, low, ~own)

    return {"selected": selected, "models": fit_chain(x, _categories(x, toxic, low, everything), Folds(folds, without))}


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counted rows of the sample -> one row, the model."""
    rows = list(batches)
    column = lambda c: [x for b in rows for x in b.column(c).to_pylist()]
    each = lambda c, dtype: [v for b in rows for v in views(pa.chunked_array([b.column(c)]), dtype)]
    toxic = (np.array(column("toxic"), np.int64) > 0).astype(np.int64)
    low = np.array(column("quality"), np.int64) <= 0
    model = fitted(each("features", "<i4"), each("counts", "u1"), np.array(column("words"), np.float64), toxic, low)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN) -> dict:
    """The selected features and the chain's models. One task gets hashed counts of the bounded sample, whatever rows share an id;
    the driver gets the model, a few dozen KB."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), F.coalesce(F.min("quality"), F.lit(1)).cast("int").alias("quality"))
    known = known.withColumn("o", F.xxhash64("doc_id"))
    first = known.where("toxic > 0").orderBy("o", "doc_id").limit(toxic_rows)
    sample = first.union(known.where("toxic <= 0").orderBy("o", "doc_id").limit(clean_rows)).drop("o")
    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_BYTES).join(F.broadcast(sample), "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.select("doc_id", F.xxhash64("text").alias("h"), "toxic", "quality", "text").mapInArrow(_counted, f"doc_id {kind}, h long, toxic int, quality int, n long, features binary, counts binary, words long")
    # in the order of the ids' hashes, so folds do not depend on row order
    sample = bounded(counted, MOST_FEATURES).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    got = sample.select("toxic", "quality", "features", "counts", "words").mapInArrow(_learned, "model binary").collect()
    return pickle.loads(got[0].model) if got else {"selected": {}, "models": []}


def probabilities(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs with p_dense, p_junk and p_toxic; nothing is shuffled."""
    keep = ["doc_id"] if keep is None else keep
    kept = docs.select(*keep, F.col("text").alias("_scored"))
    kinds = {f.name: f for f in kept.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in keep) + ", p_dense double, p_junk double, p_toxic double"

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        selected, models = model["selected"], model["models"]
        counter = Counter(selected)
        for batch in slices(batches, 1000):
            texts = batch.column("_scored").to_pylist()
            p = np.zeros((len(texts), len(CHAIN)))
            if models:
                counts, words = np.zeros((len(texts), len(selected)), np.float32), np.zeros(len(texts))
                for j, t in enumerate(texts):
                    f, c, words[j] = counter.count(t)
                    counts[j, f] = c
                p = predict_chain(_scaled(counts, words), models).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(p[:, k], pa.float64()) for k in range(len(CHAIN))]], names=[*keep, "p_dense", "p_junk", "p_toxic"])

    return kept.mapInArrow(rate, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_dense, p_junk, p_toxic, toxic) for every document; toxic is 1 from THRESHOLD on.

    Null and empty texts have no words and get the constant's probability, which is low. Null and repeated ids get a row
    each, and are learned from once. Without toxic labels nothing is toxic. Null labels are left out; of repeated ones the worst
    counts.
    """
    scored = probabilities(docs.withColumn("doc_id", F.col("doc_id").cast("long")), learn(docs, labels))
    return scored.withColumn("toxic", (F.col("p_toxic") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    plain, names = set_aside(docs, "text")
    kept = probabilities(plain, learn(docs, labels), names).where(F.col("p_toxic") < THRESHOLD)
    return restored(kept, names, docs.columns)
