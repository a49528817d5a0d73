"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own and its two neighbours'; a chain ties neighbouring labels. The
forward-backward marginals that lines are good, weighted by the lines' lengths, give a document's share of good text,
and a monotone logistic curve turns that share into the score. The labels are of documents, so all lines of a document are
learned with its label: the chain learns how firmly lines of one document agree, and its features decide which way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.llm.common import cut, slices, views
from ledgerflow.llm.words import scan

#: At most so many labelled documents, those with the smallest hashes of their ids, are learned from; of these as many as have
#: MOST_LINES lines in all, and none longer than MOST_BYTES.
SAMPLE, MOST_LINES, MOST_BYTES = 4000, 400_000, 1_000_000
THRESHOLD = 0.3
STEPS = 160
_KINDS = np.zeros(256, dtype=np.int64)
for _n, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"*#$%&@^~=<>{}[]\\_", b"!?", b".,;:", b" \t"), start=1):
    _KINDS[list(_chars)] = _n
N_KINDS = 9
OWN = N_KINDS - 1 + 5
FEATURES = 3 * OWN + 3


def lines(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, weight) of each line that is not blank; a text without one counts as a single empty line."""
    data = (text or "").encode("utf-8", "surrogatepass")
    b, start, end, roll = scan(data)
    if not len(start):
        own, weight = np.zeros((1, OWN)), np.ones(1)
    else:
        row = np.cumsum(b == 10)
        used, row_of_word = np.unique(row[start], return_inverse=True)
        n_lines = len(used)
        counts = np.bincount(row * N_KINDS + _KINDS[b], minlength=(int(row[-1]) + 1) * N_KINDS).reshape(-1, N_KINDS)[used].astype(float)
        size = counts.sum(axis=1)
        h = roll.of(start, end)
        words = np.bincount(row_of_word, minlength=n_lines)
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (row_of_word[1:] == row_of_word[:-1])))
        repeats = np.bincount(row_of_word, weights=same, minlength=n_lines) / np.maximum(words - 1, 1)
        first = np.flatnonzero(np.concatenate(([True], np.diff(row_of_word) > 0)))
        whole = roll.of(start[first], end[np.concatenate((first[1:], [len(start)])) - 1])
        again = np.concatenate(([False], whole[1:] == whole[:-1]))
        long_word = np.maximum.reduceat(end - start, first)
        kinds = np.sqrt(counts[:, 1:] / size[:, None])
        own = np.column_stack((kinds, repeats, again, np.log1p(words) / 5, long_word / (long_word + 20.0), words <= 3)).astype(float)
        weight = size
    zero = np.zeros((1, OWN))
    edge = np.zeros((len(own), 3))
    edge[0, 0] = edge[-1, 1] = edge[:, 2] = 1
    return np.hstack((own, np.vstack((zero, own[:-1])), np.vstack((own[1:], zero)), edge)), weight


def _chunks(sizes: np.ndarray, most: int = 200_000) -> Iterator[np.ndarray]:
    """Indices of chains by length, so many at a time that their padded table stays small."""
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * sizes[order[j]] <= most:
            j += 1
        yield order[i:j]
        i = j


def marginals(emission: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good) for all lines of all chains, and the expected counts of the four label pairs.

    emission: a good line's score against 0 for a bad one, chain after chain; trans[a, b]: the score of b after a.
    """
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    out, pairs = np.zeros(len(emission)), np.zeros((2, 2))
    for own in _chunks(sizes):
        n = sizes[own]
        most = int(n.max())
        at = first[own][:, None] + np.arange(most)
        live = np.arange(most) < n[:, None]
        e = np.zeros((len(own), most, 2))
        e[..., 1] = np.where(live, emission[np.minimum(at, len(emission) - 1)], 0)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, most):
            step = np.logaddexp(alpha[:, t - 1, :1] + trans[:1], alpha[:, t - 1, 1:] + trans[1:]) + e[:, t]
            alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            ahead = beta[:, t + 1] + e[:, t + 1]
            step = np.logaddexp(ahead[:, :1] + trans[:, 0], ahead[:, 1:] + trans[:, 1])
            beta[:, t] = np.where(live[:, t + 1, None], step, 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha[..., 1] + beta[..., 1] - total[:, None])
        out[at[live]] = p[live]
        if most > 1:
            joint = np.exp(alpha[:, :-1, :, None] + trans + (e + beta)[:, 1:, None, :] - total[:, None, None, None])
            pairs += joint[live[:, 1:]].sum(axis=0)
    return out, pairs


def fit(x: np.ndarray, sizes: np.ndarray, weight: np.ndarray, label: np.ndarray, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights by gradient ascent on the chains' likelihood; a document's label is the label of all its lines."""
    if not len(sizes) or label.min() == label.max():
        return {"theta": np.zeros(FEATURES), "trans": np.zeros((2, 2)), "curve": np.array([0.0, 3.0 if len(label) and label.max() else -3.0 if len(label) else 0.0])}
    y = np.repeat(label, sizes).astype(float)
    chain_weight = np.repeat(1.0 / np.sqrt(sizes), sizes)
    same = np.zeros((2, 2))
    for v in (0, 1):
        same[v, v] = (sizes[label == v] - 1).sum()
    theta, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m1, m2 = np.zeros(len(theta) + 4), np.zeros(len(theta) + 4)
    for step in range(1, steps + 1):
        p, pairs = marginals(x @ theta, sizes, trans)
        grad = np.concatenate((x.T @ ((y - p) * chain_weight) / chain_weight.sum() - 1e-4 * theta, ((same - pairs) / max(same.sum(), 1) - 1e-2 * trans).ravel()))
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        theta, trans = theta + move[:-4], trans + 0.25 * move[-4:].reshape(2, 2)
    share = shares(x @ theta, sizes, weight, trans)
    a, b = 1.0, 0.0
    for _ in range(500):  # the curve of the score over the share of good text, by Newton steps with a small penalty
        p = 1 / (1 + np.exp(-(a * share + b)))
        g = np.array([((label - p) * share).sum() - 0.05 * a, (label - p).sum() - 0.05 * b])
        w = np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(w * share**2).sum() + 0.05, (w * share).sum()], [(w * share).sum(), w.sum() + 0.05]])
        da, db = np.linalg.solve(hess, g)
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-9:
            break
    return {"theta": theta, "trans": trans, "curve": np.array([max(a, 0.0), b])}


def shares(emission: np.ndarray, sizes: np.ndarray, weight: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Length-weighted share of good text of each chain."""
    p, _ = marginals(emission, sizes, trans)
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    return np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)


def score(texts: list[str | None], model: dict[str, np.ndarray]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    emission, sizes, weights = [], [], []
    for t in texts:
        x, w = lines(t)
        emission.append(x @ model["theta"])
        weights.append(w)
        sizes.append(len(w))
    share = shares(np.concatenate(emission), np.array(sizes), np.concatenate(weights), model["trans"])
    a, b = model["curve"]
    return 1 / (1 + np.exp(-(a * share + b)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [lines(t) for t in batch.column("text").to_pylist()]
        made = [pa.array([len(w) for _, w in rows], pa.int64()), pa.array([x.astype("<f4").tobytes() for x, _ in rows], pa.binary()), pa.array([w.astype("<f4").tobytes() for _, w in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "h", "label")], *made], names=["doc_id", "h", "label", "n", "x", "w"])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """One row for each doc_id, that with the smallest h, in the order of the ids' hashes, while the sum of n stays within `most`.

    rows: (doc_id, h, n, …) of a bounded number of ids; what the driver gets of them is bounded by this. A row with over a
    twentieth of `most` does not count, so that few rows cannot take all room.
    """
    rest = [c for c in rows.columns if c not in ("doc_id", "h")]
    one = cut(rows.where(F.col("n") <= most // 20).groupBy("doc_id").agg(F.min_by(F.struct(*rest), "h").alias("r")).select("doc_id", "r.*"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = one.select("doc_id", F.sum("n").over(order).alias("so_far")).where(F.col("so_far") <= most).select("doc_id")
    return one.join(F.broadcast(fits), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The model of the labelled documents that are not held out.

    The driver gets line features of at most `sample` documents and MOST_LINES lines, whatever rows share an id.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_BYTES).join(F.broadcast(known), "doc_id")
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.col("label").cast("int").alias("label"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = bounded(rows.mapInArrow(_features, f"doc_id {kind}, h long, label int, n long, x binary, w binary"), MOST_LINES).toArrow()
    xs = [v.reshape(-1, FEATURES) for v in views(got.column("x"), "<f4")]
    ws = views(got.column("w"), "<f4")
    label = (np.array(got.column("label").to_pylist(), dtype=np.int64) > 0).astype(np.int64)
    if not xs:
        return fit(np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0), label)
    return fit(np.concatenate(xs).astype(float), np.array([len(w) for w in ws]), np.concatenate(ws).astype(float), label)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document.

    Null and empty texts are one empty line, and get the score of that line. Null ids are not held out. Repeated ids get
    a row each, and are learned from once. Without labels of both kinds every score is the same. Labels, language, source and id are no features.
    Nothing is shuffled but the ids of labels.
    """
    model = learn(docs, labels, sample)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            s = score(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int")
