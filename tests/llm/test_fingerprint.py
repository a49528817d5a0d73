import hashlib
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerflow.llm import fingerprint as fp

from .helpers import EDGES, docs

PARAGRAPHS = st.lists(st.text(alphabet="abc é\t→", max_size=30), max_size=6)


@settings(max_examples=60, deadline=None)
@given(PARAGRAPHS, PARAGRAPHS, st.randoms())
def test_homomorphic(a, b, r):
    whole = fp.vector("\n".join(a + b))
    shuffled = a + b
    r.shuffle(shuffled)
    assert np.array_equal(whole, fp.vector("\n".join(shuffled)))
    assert np.array_equal(whole, fp.insert(fp.vector("\n".join(a)), "\n".join(b)))
    assert np.array_equal(fp.vector("\n".join(a)), fp.delete(whole, "\n".join(b)))
    assert np.array_equal(fp.from_text(fp.as_text(whole)), whole)


def test_likeness():
    a, b = (" ".join(f"{p}{i}" for i in range(400)) for p in "ab")
    near = fp.likeness(fp.vector(a), fp.vector(a[:1500] + b[1500:]))
    assert fp.likeness(fp.vector(a), fp.vector(a)) == 1.0
    assert near > 0.5 > 0.4 > fp.likeness(fp.vector(a), fp.vector(b))
    assert fp.likeness(fp.vector(""), fp.vector(a)) == 0.0
    assert not np.array_equal(fp.vector("a\na"), fp.vector("a"))


def signed_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def expected(rows):
    """Whole fingerprints of all texts and edited texts, in the order of ids and then of the texts' hashes."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (fp.LEAST_ID if r[0] is None else r[0], signed_hash(r[1])))
    out = []
    for n, (i, t) in enumerate(order):
        q, after = len(t) // 4, order[(n + 1) % len(order)][1]
        edited = t[: len(t) - q] + after[:q]
        own, new = fp.vector(t), fp.vector(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.as_text(own), fp.as_text(new), fp.likeness(own, new), fp.likeness(own, fp.vector(after))))
    return sorted(out, key=str)


def check(spark, rows):
    assert sorted((tuple(r) for r in fp.fingerprint_with_edit(docs(spark, rows)).collect()), key=str) == expected(rows)


def test_edges_against_brute_force(spark):
    check(spark, EDGES)


def test_many_ranges_and_small_tables(spark):
    rows = [(i * 7 % 501, f"text {i} " * (i % 9)) for i in range(501)]
    check(spark, rows)
    check(spark, rows[:1])
    check(spark, rows[:2])
    check(spark, [(None, "a"), (None, None)])
    assert fp.fingerprint_with_edit(docs(spark, [])).count() == 0


def test_one_id_and_one_text_of_many_rows(spark):
    """Of 3,000 rows a third has no id, a third the same id and text, and their ranges are divided."""
    rows = [(None, f"other text {i}") for i in range(1000)] + [(77, "the same\ntext of many")] * 1000 + [(i, f"text {i}") for i in range(1000)]
    check(spark, rows)
    ids, h = np.array([5] * 1000 + [9]), np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 1001)
    got = fp._places(ids, h, np.array([5] * 7 + [8]))
    assert set(got[:1000]) == set(range(7)) and got[1000] == 8
    assert all(a <= b for a, b in zip(got[:1000][np.argsort(h[:1000])], got[:1000][np.argsort(h[:1000])][1:]))
    assert set(fp._places(ids, np.array([-(1 << 63), (1 << 63) - 1] * 500 + [0]), np.array([5] * 7 + [8]))[:1000]) == {0, 6}


def test_a_hundred_thousand_equal_rows(spark):
    rows = spark.range(100_000).selectExpr("cast(4 as long) as doc_id", "'a text\nof two lines' as text").union(spark.createDataFrame([(9, "last")], "doc_id long, text string"))
    got = fp.fingerprint_with_edit(rows).groupBy("doc_id", "n_chars", "near_next").count().collect()
    alone = fp.likeness(fp.vector("a text\nof two lines"), fp.vector("last"))
    assert sorted(tuple(r) for r in got) == [(4, 19, alone, 1), (4, 19, 1.0, 99_999), (9, 4, alone, 1)]


def test_likeness_of_a_hundred_thousand_equal_lines():
    """Lanes do not wrap: the text and its edit agree in three quarters of their lines."""
    text = "the same line again\n" * 100_000
    n = len(text)
    edited = text[: n - n // 4] + "quite another text with other words " * 10
    for wide in (text, text * 3):
        assert fp.likeness(fp.vector(wide), fp.vector(edited)) > 0.99


def test_likeness_is_near_the_cosine_of_the_shingles():
    r = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(60)])
    for part in (0.1, 0.4, 0.8):
        a = words[r.integers(0, 60, 3000)]
        b = np.concatenate((a[: int(3000 * part)], words[r.integers(0, 60, 3000 - int(3000 * part))]))
        x, y = (Counter(zip(v, v[1:], v[2:])) for v in (a.tolist(), b.tolist()))
        cosine = sum(x[k] * y[k] for k in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        assert abs(fp.likeness(fp.vector(" ".join(a)), fp.vector(" ".join(b))) - cosine) < 0.25


def test_column(spark):
    got = fp.fingerprints(docs(spark, EDGES)).select("text", "fingerprint").collect()
    assert all(r.fingerprint == fp.as_text(fp.vector(r.text or "")) for r in got)
