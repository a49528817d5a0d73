import random
import re
from itertools import permutations

from ledgerflow.llm import audit

from .helpers import EDGES, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels, letters="ABCDE"):
    """rows: (doc_id, text, part). Applies the five filters one after the other, in every order, to the rows themselves."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    fails = []
    for i, text, part in rows:
        t = text or ""
        w = WORD.findall(t)
        smaller = i is not None and any(j is not None and j < i and (x or "") == t for j, x, _ in rows)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller}
        fails.append((i, part or "", {k for k in letters if bad[k]}))
    out, shapley = [], {}
    for part in {p for _, p, _ in fails}:
        own = [(i, f) for i, p, f in fails if p == part]
        for order in permutations(letters):
            left = own
            for k, letter in enumerate(order):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                redundant = sum(letter in f for _, f in own) - len(gone)
                out.append((part, "".join(order), k + 1, len(left), len(gone), redundant, sum(f == {letter} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def run(spark, rows, labels):
    clash = spark.createDataFrame([(i, t, p, "x", None) for i, t, p in rows], "doc_id long, text string, source string, mask string, low string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(map(tuple, audit.audit(audit.masks(clash, marks)).collect()))


def test_against_the_filters_one_by_one(spark):
    rng = random.Random(5)
    pool = ["short text", "WORDS IN CAPITALS " * 20, " ".join(f"w{i}" for i in range(60)), "same same " * 40, "a | b # c " + " ".join(f"v{i}" for i in range(55)), "", None, "x\x0by\x0cz " * 30, "É nbsp " + " ".join(f"u{i}" for i in range(50))]
    rows = [(rng.choice([n, n, n, 7, None]), rng.choice(pool), rng.choice(["a", "b", None, ""])) for n in range(120)]
    labels = [(n, rng.choice([0, 1, None]), rng.choice([0, 1])) for n in range(0, 120, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_a_text_in_two_parts_and_repeated_ids(spark):
    """The smallest id is table-wide; its own repetitions do not fail."""
    rows = [(5, "t", "a"), (5, "t", "a"), (5, "t", "b"), (6, "t", "a"), (None, "t", "a"), (9, "t", "c"), (9, "t", "c")]
    got = run(spark, rows, [(6, 1, 0), (5, 0, 1)])
    assert got == brute(rows, [(6, 1, 0), (5, 0, 1)])
    kept = {p: k for p, o, s, k, *_ in got if o == "EABCD" and s == 1}
    assert kept == {"a": 3, "b": 1, "c": 0}


def test_zeta_against_subsets(spark):
    rng = random.Random(1)
    counts = [("p", m, rng.randrange(9), rng.randrange(5), 0) for m in range(8) if m != 3]
    got = audit.survivors(spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long"), 3).first()
    for subset in range(8):
        assert got.n[subset] == sum(n for _, m, n, _, _ in counts if not m & subset) and got.good[subset] == sum(g for _, m, _, g, _ in counts if not m & subset)
    assert len(audit.steps("ABC")) == 18


def test_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs(spark, EDGES)
    rows = [(r.doc_id, r.text, r.source) for r in d.collect()]
    assert sorted(map(tuple, audit.audit(audit.masks(d, labels)).collect())) == brute(rows, [])
    assert audit.audit(audit.masks(docs(spark, []), labels)).count() == 0
