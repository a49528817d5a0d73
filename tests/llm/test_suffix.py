import random
from collections import defaultdict

import pytest

from ledgerflow.llm import suffix

from .helpers import EDGES, docs


def brute(rows):
    """doc_id -> repeated word positions, by all windows of 50 words."""
    first, out, seen = {}, {}, {}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        first.setdefault(t, i)
    done = set()
    for i, t in order:
        w = t.encode().split()
        if (i, t) in done:
            continue
        done.add((i, t))
        if first[t] != i:
            if len(w) >= 50:
                out.setdefault(i, set()).update(range(len(w)))
            continue
        windows = [b" ".join(w[k : k + 50]) for k in range(len(w) - 49)]
        hit = {p for k, x in enumerate(windows) if x in seen and seen[x] != t for p in range(k, k + 50)}
        if hit:
            out[i] = hit
        for x in windows:
            seen.setdefault(x, t)
    return out


def found(df):
    out = defaultdict(set)
    for r in df.collect():
        assert r.end_word - r.start_word == r.n_words >= 50
        out[r.doc_id] |= set(range(r.start_word, r.end_word))
    return dict(out)


def corpus(seed, n, passages):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    shared = [[word() for _ in range(k)] for k in passages]
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randint(0, 120))]
        for p in r.sample(shared, r.choice((0, 1, 1, 2))):
            cut = r.randint(0, 3)
            at = r.randint(0, len(w))
            w[at:at] = p[cut:] if r.random() < 0.5 else p
        rows.append((i * 3 % 1009, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = corpus(seed, 70, (48, 49, 50, 51, 53, 60, 75, 100, 140))
    rows += [(2000 + i, t) for i, (_, t) in enumerate(rows[:5])]
    assert found(suffix.repeated_passages(docs(spark, rows))) == brute(rows)


def test_long_lists_against_brute_force(spark):
    """One passage in more documents than a list is compared for."""
    rows = corpus(7, 3 * suffix.LONG, (52, 90))
    got = suffix.repeated_passages(docs(spark, rows))
    assert found(got) == brute(rows)


def test_edges(spark):
    rows = [*EDGES, (11, "x " * 200), (12, "x " * 300), (13, suffix.MIN * "same "), (14, suffix.MIN * "same "), (15, suffix.MIN * "same ")]
    assert found(suffix.repeated_passages(docs(spark, rows))) == brute(rows)
    d = docs(spark, rows)
    out = suffix.without_repeats(d)
    assert out.columns == d.columns and out.dtypes == d.dtypes
    gone = brute(rows)
    got = sorted((str(r.doc_id), None if r.text is None else r.text.split(), r.n_chars == (None if r.text is None else len(r.text))) for r in out.collect())
    want = sorted((str(i), None if t is None else [w for k, w in enumerate(t.split()) if k not in gone.get(i, ())], True) for i, t in rows)
    assert [(a, b) for a, b, _ in got if a not in ("4",)] == [(a, b) for a, b, _ in want if a not in ("4",)] and all(c for *_, c in got)
    assert suffix.repeated_passages(docs(spark, [])).count() == 0 and suffix.without_repeats(docs(spark, [])).count() == 0


def test_minimisers_are_shared():
    r = random.Random(3)
    text = [str(r.random()) for _ in range(400)]
    a, b = " ".join(text[:300]), " ".join(["other"] * 37 + text[100:])
    ga, gb = suffix.hashes(a)[1], suffix.hashes(b)[1]
    pa, pb = set(suffix.retained(ga)), set(suffix.retained(gb))
    inside = {p for p in pa if p >= 100 + suffix.WINDOW - 1 and p + suffix.GRAM + suffix.WINDOW <= 300}
    assert inside and {p - 100 + 37 for p in inside} <= pb
    for i in range(len(ga) - suffix.WINDOW + 1):
        assert pa & set(range(i, i + suffix.WINDOW))
