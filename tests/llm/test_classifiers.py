import itertools
import math
import pickle
import tracemalloc

import numpy as np
import pandas as pd

from ledgerflow.llm import quality, toxicity

from .helpers import EDGES, docs

DATA = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(0)
    sizes, trans = np.array([3, 1, 4, 2]), rng.normal(size=(2, 2))
    emission = rng.normal(size=sizes.sum())
    got, pairs = quality.marginals(emission, sizes, trans)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        e, total, p, joint = emission[at : at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            p += w * np.array(y)
            for i in range(n - 1):
                joint[y[i], y[i + 1]] += w
        want += list(p / total)
        want_pairs += joint / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_quality_on_held_out_labels(spark):
    d, labels = tables(spark)
    got = quality.score_documents(d, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].score.median() > 0.9 and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_quality_ignores_labels_of_held_out_rows(spark):
    d, labels = tables(spark)
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = quality.learn(d, labels), quality.learn(d, flipped)
    assert all(np.allclose(a[k], b[k]) for k in a)


def test_toxicity_on_unseen_labels(spark):
    d, labels = tables(spark)
    big = spark.read.parquet(DATA.replace("0.01", "0.1") + "/documents.parquet"), spark.read.parquet(DATA.replace("0.01", "0.1") + "/labels.parquet")
    seen, unseen = (big[1].where(f"doc_id % 2 = {k}") for k in (0, 1))
    got = toxicity.classify(big[0], seen).toPandas().merge(unseen.toPandas(), on="doc_id", suffixes=("", "_label"))
    table = pd.crosstab(got.toxic, got.toxic_label)
    assert table.loc[1, 1] / table[1].sum() > 0.9 and table.loc[1, 0] / table[0].sum() < 0.02


def test_chain_uses_earlier_probabilities():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    first = (x[:, 0] > 0).astype(np.float32)
    y = np.column_stack((first, first * (x[:, 1] > 0)))
    models = toxicity.fit_chain(x, y, [(np.arange(400) % 5 == f, x, y) for f in range(5)])
    assert [len(m) for m in models] == [4, 5] and models[1][3] > 0
    assert ((toxicity.predict_chain(x, models) > 0.5) == y).mean() > 0.9


def test_out_of_fold_inputs_do_not_see_their_fold(monkeypatch):
    """Labels and features of a fold are changed: what its models select and predict for it stays."""
    rng = np.random.default_rng(2)
    toxic = (np.arange(200) % 3 == 0).astype(np.int64)
    features = [np.unique(rng.integers(0, 60, 12) + 100 * t).astype("<i4") for t in toxic]
    counts = [np.ones(len(f), np.uint8) for f in features]
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda x, y, away: seen.append(away) or [])
    own = np.arange(200) % 5 == 0
    toxicity.fitted(features, counts, np.full(200, 50.0), toxic, toxic > 0)
    toxicity.fitted([f + 7 if o else f for f, o in zip(features, own, strict=True)], counts, np.full(200, 50.0), np.where(own, 1 - toxic, toxic), toxic > 0)
    (_, x0, y0), (_, x1, y1) = seen[0][0], seen[1][0]
    assert np.array_equal(x0[~own], x1[~own]) and np.array_equal(y0[~own], y1[~own]) and x0.shape == x1.shape


def test_quality_scores_against_brute_force(spark):
    """Scores of short documents by a sum over all labelings of their lines."""
    d, labels = tables(spark)
    model = quality.learn(d, labels)
    rows = [(i, t) for i, t in EDGES if t is None or len(t) < 5000] + [(100 + n, "\n".join(f"line {k} of {n}!! | {'x' * (k * n % 40)}" for k in range(n))) for n in range(1, 9)]
    want = []
    for i, t in rows:
        x, w = quality.lines(t)
        e, tr, total, share = x @ model["theta"], model["trans"], 0.0, 0.0
        for y in itertools.product((0, 1), repeat=len(w)):
            p = np.exp(sum(e[k] * y[k] for k in range(len(w))) + sum(tr[y[k], y[k + 1]] for k in range(len(w) - 1)))
            total += p
            share += p * float(w @ np.array(y)) / w.sum()
        want.append((str(i), 1 / (1 + np.exp(-(model["curve"][0] * share / total + model["curve"][1])))))
    got = quality.score_documents(docs(spark, rows).unionByName(d.limit(0), allowMissingColumns=True), labels.limit(0))
    assert got.count() == len(rows)
    scores = quality.score([t for _, t in rows], model)
    assert np.allclose(sorted(scores), sorted(p for _, p in want))


def test_toxicity_against_brute_force(spark):
    """Every probability of sf0.001 by plain loops over words, features and models."""
    small = "/root/testdata/sf0.001"
    d, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.learn(d, labels)
    got = {r.doc_id: (r.p_dense, r.p_junk, r.p_toxic, r.toxic) for r in toxicity.classify(d, labels).collect()}
    for r in d.collect():
        words = (r.text or "").lower().split()
        hits = {}
        for w in words:
            for f in toxicity.word_features(w):
                if f in model["selected"]:
                    hits[f] = hits.get(f, 0) + 1
        scale = (1 + max(len(words), 1) / 400) ** 0.5
        before = []
        for m in model["models"]:
            z = float(m[-1]) + sum(float(m[model["selected"][f]]) * math.log1p(n) / scale for f, n in hits.items()) + sum(float(a) * p for a, p in zip(m[len(model["selected"]) : -1], before, strict=True))
            before.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
        assert np.allclose(got[r.doc_id][:3], before, atol=1e-3) and (got[r.doc_id][3] == (before[2] >= 0.5) or abs(before[2] - 0.5) < 1e-3)


def test_learned_rows_are_bounded(spark):
    """One labelled id on 100,000 rows, and one document of a million lines: the driver learns from the first once, not from the second."""
    many = spark.range(100_000).selectExpr("cast(1 as long) as doc_id", "concat('text of row ', id % 50) as text")
    long = spark.createDataFrame([(2, "a\n" * 1_000_000), (3, "good words of a document"), (4, "BAD!!! $$$")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    rows = many.union(long)
    kept = quality.bounded(rows.selectExpr("doc_id", "xxhash64(text) as h", "cast(length(text) as long) as n", "text"), 1000)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert set(quality.learn(rows, labels)) == {"theta", "trans", "curve"} and len(toxicity.learn(rows, labels)["models"]) == 3


def test_toxicity_is_learned_in_a_task(spark, monkeypatch):
    """The driver gets the model only: none of what learning takes runs or is held there."""
    d, labels = tables(spark)
    for name in ("fitted", "views", "select"):
        monkeypatch.setattr(toxicity, name, None)
    model = toxicity.learn(d, labels)
    assert len(model["models"]) == 3 and 0 < len(model["selected"]) <= toxicity.SELECTED and len(pickle.dumps(model)) < 100_000


def test_tables_of_folds_are_not_held_together(monkeypatch):
    """What learning holds at once is under six tables of all rows; with those of all five folds it was over eight."""
    monkeypatch.setattr(toxicity, "BUCKETS", 4096)
    monkeypatch.setattr(toxicity, "fit_linear", lambda x, y: np.zeros(x.shape[1] + 1, np.float32))
    toxic = (np.arange(2000) % 2).astype(np.int64)
    features = [np.arange(1200 * t, 1200 * t + 1200, dtype="<i4") for t in toxic]
    counts = [np.ones(1200, np.uint8)] * 2000
    tracemalloc.start()
    model = toxicity.fitted(features, counts, np.full(2000, 50.0), toxic, toxic > 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model["selected"]) == 1200 and len(model["models"]) == 3
    assert peak < 6 * 2000 * 1200 * 4


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 0), (None, 0, 1), (9, None, None), (77, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for rows in (EDGES, []):
        d = docs(spark, rows)
        for known in (labels, none):
            q = quality.score_documents(d, known).collect()
            assert len(q) == len(rows) and all(0 <= r.score <= 1 for r in q)
            assert sorted(str(r.doc_id) for r in toxicity.classify(d, known).collect()) == sorted(str(i) for i, _ in rows)
            kept = toxicity.keep_clean(d, known)
            assert kept.columns == d.columns and kept.dtypes == d.dtypes and kept.count() <= len(rows)
        assert toxicity.keep_clean(d, none).count() == len(rows)
