import numpy as np

from ledgerflow.llm import neighbours
from ledgerflow.llm.common import cut

SCHEMA = "vec_id long, embedding array<float>, label int, id string, u string, q string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], SCHEMA)


def brute(rows, every):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if i % every == 0:
            d = sorted((float(np.sqrt(((np.float32(v).astype(float) - np.float32(w).astype(float)) ** 2).sum())), j) for j, w in good if j != i)
            out[i] = d[:10]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(15)] + [(300, rows[5][1])]
    rows += [(400, None), (500, [0.0] * 8), (600, [None, *[1.0] * 7]), (700, [float("nan"), *[1.0] * 7]), (800, [float("inf"), *[1.0] * 7]), (None, [1.0] * 8)]
    rows.append(rows[0])
    got, want = answers(neighbours.nearest(frame(spark, rows), every=10)), brute(rows, 10)
    assert {k: [j for _, j in v] for k, v in got.items()} == {k: [j for _, j in v] for k, v in want.items()}
    assert all(abs(a - b) < 1e-12 for k in want for (a, _), (b, _) in zip(got[k], want[k], strict=True))


def test_the_rounds_decide_on_small_tables_too(spark):
    """Runs are smaller than the table: without rounds the graph misses neighbours, which the rounds find."""
    rng = np.random.default_rng(21)
    x = np.float32(rng.normal(size=(1500, 48)))
    nodes = cut(neighbours.rounded(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<float>")))
    d = (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    want = [set(row[:10].tolist()) for row in np.argsort(d, axis=1)]
    recall = {}
    for rounds in (0, None):
        lists = {r.u: r.v for r in neighbours.graph(nodes, rounds).collect()}
        recall[rounds] = sum(len(set(lists[i]) & w) for i, w in enumerate(want)) / (10 * len(want))
    assert recall[0] < 0.9 < 0.95 < recall[None], recall


def test_few_or_no_rows(spark):
    for n in (0, 1, 2, 5):
        rows = [(i * 100, [1.0, float(i)]) for i in range(n)]
        got = answers(neighbours.nearest(frame(spark, rows)))
        assert {k: len(v) for k, v in got.items()} == ({i * 100: n - 1 for i in range(n)} if n > 1 else {})


def test_recall_with_a_hot_vector_and_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32))
    rows = [(i, [float(x) for x in np.float32(centres[i % 12] + 0.7 * rng.normal(size=32))]) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(1200)]
    got, want = answers(neighbours.nearest(frame(spark, rows), every=50)), brute(rows, 50)
    hits = sum(len({j for _, j in got[k]} & {j for _, j in v}) for k, v in want.items())
    assert hits / sum(map(len, want.values())) > 0.95


def test_recall_beside_a_huge_vector_and_in_a_tight_cluster(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=16))]) for i in range(1500)]
    rows += [(2000 + i, [float(x) for x in np.float32(centre + 1e-3 * rng.normal(size=16))]) for i in range(3000)]
    rows.append((9999, [1e4] * 16))
    got, want = answers(neighbours.nearest(frame(spark, rows), every=50)), brute(rows, 50)
    for part in ([k for k in want if k < 2000], [k for k in want if k >= 2000]):
        hits = sum(len({j for _, j in got[k]} & {j for _, j in want[k]}) for k in part)
        print(len(part), hits / (10 * len(part)))
        assert hits / (10 * len(part)) > 0.95


def test_vectors_that_are_not_in_the_table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=12))]) for i in range(2000)] + [(3000 + i, [1.0] * 12) for i in range(20)]
    asked = [(i, [float(x) for x in np.float32(rng.normal(size=12))]) for i in range(40)] + [(50, [1.0] * 12), (51, rows[7][1]), (52, None), (None, [1.0] * 12), (53, [1.0])]
    got = answers(neighbours.nearest_to(frame(spark, rows), frame(spark, asked)))
    hits = 0
    for i, v in asked[:42]:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in rows)[:10]
        hits += len({j for _, j in d} & {j for _, j in got[i]})
    assert set(got) == {*range(40), 50, 51} and hits / 420 > 0.95 and got[51][0] == (0.0, 7) and [j for _, j in got[50]] == list(range(3000, 3010))
    assert neighbours.nearest_to(frame(spark, []), frame(spark, asked)).count() == 0 and neighbours.nearest_to(frame(spark, rows), frame(spark, [])).count() == 0
