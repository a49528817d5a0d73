import hashlib

import numpy as np
import pytest

from ledgerflow.llm import mixing

from .helpers import EDGES, docs


@pytest.mark.parametrize("most", [0, 100_000])
def test_raking_against_numpy(spark, monkeypatch, most):
    """By one task, and grouped and joined."""
    monkeypatch.setattr(mixing, "MOST_SINGLE_CELLS", most)
    monkeypatch.setattr(mixing, "ROUNDS", 12 if most else 3)
    rng = np.random.default_rng(0)
    w = rng.integers(100, 1000, (4, 3, 2)).astype(float)
    cells = [(f"s{i}", f"l{j}", f"t{k}", int(w[i, j, k])) for i in range(4) for j in range(3) for k in range(2)]
    targets = {"source": {f"s{i}": 1 + i for i in range(4)}, "lang": {"l0": 2, "l1": 1, "l2": 1}, "topic": {"t0": 1, "t1": 1}}
    got = {(r.source, r.lang, r.topic): r.p for r in mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), targets, 0.3, mixing.ROUNDS).collect()}
    p, goal = np.full(w.shape, 0.3), 0.3 * w.sum()
    want = [np.array([1, 2, 3, 4]) / 10, np.array([2, 1, 1]) / 4, np.array([1, 1]) / 2]
    for _ in range(mixing.ROUNDS):
        for axis, t in enumerate(want):
            shape = [1, 1, 1]
            shape[axis] = -1
            now = (w * p).sum(axis=tuple(a for a in range(3) if a != axis))
            p = np.minimum(1, p * (t * goal / now).reshape(shape))
    assert all(abs(got[f"s{i}", f"l{j}", f"t{k}"] - p[i, j, k]) < 1e-9 for i in range(4) for j in range(3) for k in range(2))
    if p.max() < 1 and most:
        assert np.allclose((w * p).sum(axis=(1, 2)) / goal, want[0], atol=1e-3)


def test_unreachable_targets_stop_at_one(spark):
    cells = spark.createDataFrame([("a", "l", "t", 10), ("b", "l", "t", 1000)], "source string, lang string, topic string, tokens long")
    got = {r.source: r.p for r in mixing.rake(cells, {"source": {"a": 1, "b": 1}}, 0.5).collect()}
    assert got["a"] == 1.0 and 0 < got["b"] < 1


def test_uniform(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(7, "a"), (None, "b"), (None, None)], "doc_id long, text string").select(mixing.uniform(F.col("doc_id"), F.col("text"))).collect()
    assert [r[0] for r in got] == [int(hashlib.md5(f"{i}:{mixing.SEED}".encode()).hexdigest()[:12], 16) / 2**48 for i in ("7", hashlib.md5(b"b").hexdigest(), "")]


def test_residuals_tell_of_an_unmet_margin(spark):
    cells = spark.createDataFrame([("a", "l", "t", 10), ("b", "l", "t", 1000)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 1, "b": 1}}
    got = {(r.dimension, r.value): (r.target, r.share) for r in mixing.residuals(mixing.rake(cells, targets, 0.5), targets).collect()}
    assert got["source", "a"][0] == 0.5 and got["source", "a"][1] < 0.03 and got["lang", "l"] == (1.0, 1.0)
    met = mixing.residuals(mixing.rake(cells, {"source": {"a": 1, "b": 9}}, 0.05), {"source": {"a": 1, "b": 9}}).collect()
    assert all(abs(r.target - r.share) < 1e-6 for r in met) and mixing.residuals(mixing.rake(cells.limit(0))).count() == 0


def test_decisions_are_those_of_mix(spark):
    d = docs(spark, EDGES).drop("_tokens", "_p")
    a = sorted((str(r.doc_id), r._tokens, r._topic, round(r._p, 6), r._kept) for r in mixing.mix(d).collect())
    assert a == sorted((str(r.doc_id), r.tokens, r.topic, r.probability, r.kept) for r in mixing.decisions(d).collect())


def test_topics(spark):
    from pyspark.sql import functions as F

    texts = {None: "empty", "": "empty", "a | b | c": "table", "a*** b$$$ c###": "symbols", "ABC DEF": "shouting", "short note": "note", "word " * 500: "article", "word " * 2000: "long"}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r[0]: r[1] for r in df.select("text", mixing.topic_of(F.col("text"))).collect()} == texts
    assert [r[0] for r in spark.createDataFrame([("a b\nc",), ("",), (None,)], "text string").select(mixing.tokens_of(F.col("text"))).collect()] == [3, 0, 0]


def test_sample_follows_targets(spark):
    rows = [(i, "some words here " * (1 + i % 5)) for i in range(4000)]
    d = docs(spark, rows).drop("_tokens", "_p").na.fill({"source": "s9", "lang": "zz"})
    m = mixing.mix(d, {"source": {"s0": 1, "s1": 2, "s9": 1}}, 0.3).toPandas()
    kept = m[m._kept].groupby("source")._tokens.sum()
    share = kept / kept.sum()
    assert abs(share["s1"] - 0.5) < 0.05 and abs(m[m._kept]._tokens.sum() / m._tokens.sum() - 0.3) < 0.03


def test_edges(spark):
    for rows in (EDGES, []):
        d = docs(spark, rows)
        out = mixing.sample(d)
        assert out.columns == d.columns and out.count() <= len(rows)
        assert mixing.mix(d).count() == len(rows)
    assert sorted(map(str, mixing.sample(docs(spark, EDGES)).collect())) == sorted(map(str, mixing.sample(docs(spark, EDGES).repartition(3)).collect()))
