import math
import random
import re

import pytest

from ledgerflow.llm import rules

from .helpers import EDGES, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else set()
    repeat = len({i + k for i, x in enumerate(windows) if x in seen for k in range(8)})
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, len(w) < 20 or 100 * repeat > 30 * len(w)


def classes(t):
    kinds = [r"[a-z]", r"[\x20\x09-\x0D]", r"[A-Z]", r"[#*$%&|<>]", r"[0-9]", r"[!-/:-@\[-`{-~]"]
    out = [0] * 7
    for c in t:
        out[next((i for i, k in enumerate(kinds) if re.match(k, c)), 6)] += 1
    return out


def distance(counts, ref, n):
    p, q = [x / sum(counts) for x in counts], [x / sum(ref) for x in ref]
    d = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q, strict=True)) / 2
    return math.sqrt(max(0, d - (len(q) - 1) / (8 * math.log(2) * n)))


def brute(rows, share=rules.SHARE):
    """rows: (doc_id, text, lang) -> the query's rows, by plain Python."""
    rows = [(i, t or "", g or "") for i, t, g in rows]
    texts = [t for _, t, _ in rows]
    heavy = {t for t in texts if texts.count(t) >= len(rows) * share}
    out = {}
    common, crefs, wrefs, n_texts = {}, {}, {}, {}
    for lang in {g for _, _, g in rows}:
        once, done = [], set()
        for _, t, g in rows:
            if g == lang and not (t in heavy and t in done):
                done.add(t)
                once.append(t)
        df = {}
        for t in once:
            for w in {x.lower() for x in WORD.findall(t)}:
                df[w] = df.get(w, 0) + 1
        common[lang] = sorted(df, key=lambda w: (-df[w], w))[: rules.COMMON]
        n_texts[lang] = len(once)
        crefs[lang] = [sum(x) for x in zip(*map(classes, once), strict=True)]
        wrefs[lang] = [sum(x) for x in zip(*[hist(t, common[lang]) for t in once], strict=True)]
    for n, (i, t, g) in enumerate(rows):
        b = base(t)
        cd = distance(classes(t), crefs[g], len(t)) if n_texts[g] >= rules.LANGUAGE_TEXTS and len(t) >= rules.CLASS_CHARS else None
        wd = distance(hist(t, common[g]), wrefs[g], b[0]) if n_texts[g] >= rules.LANGUAGE_TEXTS and b[0] >= rules.COMMON_WORDS else None
        kept = not b[5] and (cd is None or cd <= rules.CLASS_LIMIT) and (wd is None or wd <= rules.COMMON_LIMIT)
        out[n] = (i, *b, kept, None if cd is None else round(cd, 6), None if wd is None else round(wd, 6))
    return sorted(out.values(), key=str)


def hist(t, common):
    w = [x.lower() for x in WORD.findall(t)]
    return [w.count(c) for c in common] + [sum(x not in common for x in w)]


def corpus():
    rng = random.Random(3)
    stop = {"en": "the of and to in a is that it for".split(), "de": "der die und in den von zu das mit sich".split()}
    rows = []
    for n in range(320):
        lang = "en" if n % 2 else "de"
        words = [rng.choice(stop[lang]) if rng.random() < 0.45 else "".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(70, 140))]
        t = " ".join(words)
        if n % 32 == 1:
            t = "## ".join(words)
        elif n % 32 == 3:
            t = t.upper()
        elif n % 32 == 5:
            t = " | ".join(w + "x" for w in words)
        elif n % 32 == 7:
            t = "one repeated line of text that is long\n" * 12
        elif n % 32 == 9:
            t = "short"
        rows.append((n, t, lang))
    return rows


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:-2] == y[:-2]
        assert all((p is None) == (q is None) and (p is None or abs(p - q) <= 1.1e-6) for p, q in zip(x[-2:], y[-2:], strict=True))


def run(spark, rows, share=rules.SHARE):
    df = spark.createDataFrame([(*r, "x", None) for r in rows], "doc_id long, text string, lang string, heavy string, classes string")
    return sorted(map(tuple, rules.check(df).collect()), key=str)


@pytest.mark.parametrize("share", [0.001, 0.05, 2.0])
def test_against_plain_python(spark, monkeypatch, share):
    """All texts heavy, only the copies, none."""
    monkeypatch.setattr(rules, "SHARE", share)
    rows = corpus()
    rows += [(500 + i, rows[0][1], "en") for i in range(30)] + [(3, rows[3][1], "en"), (None, None, None), (None, "", "en"), (77, " \n\t ", "de")]
    got = run(spark, rows)
    close(got, brute(rows, share))
    verdict = {r[0]: r[7] for r in got if r[0] is not None and r[0] < 320}
    junk = {n for n in range(320) if n % 32 in (1, 3, 5, 7, 9)}
    assert not any(verdict[n] for n in junk) and all(verdict[n] for n in range(320) if n not in junk)


def test_repeated_words_and_lines(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 7, 8, 9, 15, 16, 17, 40, 200)] + ["a b c d e f g h\na b c d e f g h", "x\n\nx\n \nx \ny", "\x0b\x0c\r\n", "é ü é ü", "a b c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", rules.repeated_words(rules.words_of(F.col("text"))), rules.repeated_lines(F.col("text"))).collect()
    assert [(r[1], r[2]) for r in got] == [(base(t)[4], base(t)[3]) for t in texts]


def test_classes(spark):
    texts = ["aA1 #.é\n\x7f\x0b", "", "[]{}~`!/:@", "ñ" * 5 + "<>|"]
    got = rules.with_class_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [list(r._classes) for r in got] == [classes(t) for t in texts]


def test_tables_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    rows = corpus()
    want = run(spark, rows)
    monkeypatch.setattr(rules, "MOST_BROADCAST", 0)
    assert run(spark, rows) == want


def test_edges(spark):
    d = docs(spark, EDGES)
    got = {(r.doc_id, r.n_words): r for r in rules.check(d).collect()}
    assert rules.check(d).count() == len(EDGES) and got[8, 15_000].n_repeat_words == 0 and got[5, 0].base_failed and got[10, base(EDGES[-1][1])[0]].kept is not None
    assert rules.check(docs(spark, [])).count() == 0
