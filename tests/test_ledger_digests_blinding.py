import csv
import hashlib
import io
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import redaction
from ledgerflow.operators import blinding, digests, ledger, statistics
from ledgerflow.operators.experiment import RUNS

# --- ledger ----------------------------------------------------------------------------------------------------------

LOG = "experiment string, seq long, kind string, position int, reason string, output_sha256 string"


def folded(rows, slots=6):
    """One event after the other, by the rules themselves."""
    out, state = {}, {}
    for x, seq, kind, p, reason, _ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        done, hole, gone = state.get(x, (0, None, False))
        error = None
        if p is None or not 1 <= p <= slots:
            error = "PATH_UNSAFE"
        elif kind == "completed":
            if p != (hole or (done + 1 if done < slots else None)):
                error = "RUN_ORDER_VIOLATION"
            elif hole:
                hole = None
            else:
                done += 1
        elif kind != "invalidated" or not (reason or "").strip(" ") or len(reason) > 500:
            error = "HUMAN_INPUT_INVALID"
        elif gone:
            error = "MORE_THAN_ONE_INVALID_REPLACEMENT"
        elif p > done or p == hole:
            error = "RUN_NOT_COMPLETE"
        else:
            hole, gone = p, True
        state[x] = (done, hole, gone)
        out[x, seq] = (error is None, error, done - (hole is not None), hole or (done + 1 if done < slots else None), gone)
    return out


def log(n, seed, experiments):
    rng = random.Random(seed)
    return [(rng.choice(experiments), i, rng.choice(["completed"] * 4 + ["invalidated", "other", None]), rng.choice([None, 0, 7, 1, 2, 3, 4, 5, 6, 1, 2, 3]), rng.choice(["why", " ", None, "y" * 501]), f"h{i}") for i in range(n)]


def test_replay_against_a_fold(spark):
    rows = log(900, 1, ["a"] * 8 + ["b", "c", None])  # one holds most
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that there are several ranges
    try:
        got = ledger.replay(spark.createDataFrame(rows, LOG)).collect()
        assert {(r.experiment, r.seq): tuple(r)[2:] for r in got} == folded(rows) and len(got) == 900
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert ledger.replay(spark.createDataFrame([], LOG)).count() == 0


def test_the_last_slot_and_one_replacement(spark):
    rows = [("e", i, "completed", i, None, f"h{i}") for i in range(1, 7)]
    rows += [("e", 7, "completed", 1, None, "x"), ("e", 8, "invalidated", 4, " lost ", None), ("e", 9, "completed", 5, None, "x"), ("e", 10, "completed", 4, None, "again"), ("e", 11, "invalidated", 4, "twice", None)]
    df = spark.createDataFrame(rows, LOG)
    got = {r.seq: (r.error_code, r.completed, r.pending, r.replaced) for r in ledger.replay(df).collect()}
    assert got[6] == (None, 6, None, False) and got[7] == ("RUN_ORDER_VIOLATION", 6, None, False) and got[8] == (None, 5, 4, True)
    assert got[9][0] == "RUN_ORDER_VIOLATION" and got[10] == (None, 6, None, True) and got[11][0] == "MORE_THAN_ONE_INVALID_REPLACEMENT"
    assert [tuple(r) for r in ledger.archive(df).collect()] == [("e", 4, 8, "lost", 4, "h4", 10)]


def test_as_of(spark):
    rows = log(200, 2, ["a", "b"])
    want = folded(rows)
    moments = [(x, s) for x in ("a", "b", "none") for s in (-1, 0, 57, 199, 1000)]
    got = {(r.experiment, r.seq): (r.completed, r.pending, r.replaced) for r in ledger.as_of(spark.createDataFrame(rows, LOG), spark.createDataFrame([*moments, moments[0]], "experiment string, seq long")).collect()}
    for x, s in moments:
        before = [k for k in want if k[0] == x and k[1] <= s]
        assert got[x, s] == (want[max(before)][2:] if before else (0, 1, False))
    assert len(got) == len(moments)


# --- digests ---------------------------------------------------------------------------------------------------------


def brute_tree(files):
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    folders, out = {}, [(p, p.count("/") + 1, "file", d, 1) for p, d in files]
    for p, _ in files:
        parts = p.split("/")
        for i in range(len(parts)):
            folders.setdefault("/".join(parts[:i]), None)

    def digest(folder):
        entries, n = [], 0
        for p, d in files:
            if p.rpartition("/")[0] == folder:
                entries.append((p.rpartition("/")[2], "file", d))
                n += 1
        for f in folders:
            if f and f.rpartition("/")[0] == folder:
                d, k = digest(f)
                entries.append((f.rpartition("/")[2], "folder", d))
                n += k
        groups = {}
        for name, kind, d in entries:
            groups.setdefault(h(name)[:3], []).append(f"{name}\0{kind}\0{d}")
        return h("\n".join(f"{g} {h(chr(10).join(sorted(lines)))}" for g, lines in sorted(groups.items()))), n

    return sorted(out + [(f, f.count("/") + 1 if f else 0, "folder", *digest(f)) for f in folders])


def tree(spark, files):
    return digests.tree(spark.createDataFrame(files, "path string, sha256 string"))


def test_tree_against_recursion(spark):
    files = [("top.txt", "1"), ("a/x", "2"), ("a/y", "3"), ("a/b/c/deep", "4"), ("a/b/x", "2"), ("z/x", "2"), ("twice", "5"), ("twice", "5"), ("a b/ü", "6")] + [(f"hot/{i}", str(i)) for i in range(300)]
    assert sorted(map(tuple, tree(spark, files).collect())) == brute_tree(files)
    assert tree(spark, []).count() == 0 and tree(spark, [(None, "1")]).count() == 0


def test_differences_lead_to_the_file(spark):
    files = [(f"{a}/{b}/{i}", f"{a}{b}{i}") for a in "pq" for b in "rs" for i in range(5)]
    other = [(p, d + "!" if p == "p/s/3" else d) for p, d in files if p != "q/r/0"] + [("q/new/1", "n")]
    got = {(r.path, r.kind): r.state for r in digests.differences(tree(spark, files), tree(spark, other)).collect()}
    assert got == {("", "folder"): "changed", ("p", "folder"): "changed", ("p/s", "folder"): "changed", ("p/s/3", "file"): "changed", ("q", "folder"): "changed", ("q/r", "folder"): "changed", ("q/r/0", "file"): "missing", ("q/new", "folder"): "extra", ("q/new/1", "file"): "extra"}
    assert digests.differences(tree(spark, files), tree(spark, files[::-1])).count() == 0
    turned = digests.differences(tree(spark, [("a", "1")]), tree(spark, [("a/b", "1")])).collect()
    assert {(r.path, r.kind): r.state for r in turned} == {("", "folder"): "changed", ("a", "file"): "missing", ("a", "folder"): "extra", ("a/b", "file"): "extra"}


# --- medians ---------------------------------------------------------------------------------------------------------


def test_medians_and_ranges_are_exact_and_printed_as_given(spark):
    from decimal import Decimal
    from statistics import median

    rng = random.Random(4)
    rows = [("hot", str(rng.randrange(2000) / 100), f"{i:04}") for i in range(500)] + [("odd", t, t) for t in ("4.50", "12.25", "20")] + [("even", t, t) for t in ("4.5", "12.25")] + [("tie", t, o) for t, o in (("4.50", "b"), ("4.5", "a"))]
    rows += [("whole", t, t) for t in ("4.5", "5.5")] + [(None, "1", "x"), ("none", None, "x"), ("none", "no number", "y")]
    df = spark.createDataFrame(rows, "k string, minutes string, o string")
    got = {r.k: r for r in statistics.order_statistics(df, "k", ["minutes"], "o").collect()}
    for k in ("hot", "odd", "even", "whole"):
        values = [Decimal(t) for a, t, _ in rows if a == k]
        assert got[k].median_text == str(median(values)) and f"{got[k].low_text}-{got[k].high_text}" == f"{min(values)}-{max(values)}" and got[k].n == len(values)
    assert got["odd"].low_text == "4.50" and got["tie"].median_text == "4.5" and got[None].median_text == "1" and "none" not in got
    summary = df.groupBy("k").count()
    wide = {r.k: r.range_minutes for r in statistics.with_order_statistics(summary, df, "k", ["minutes"], "o").collect()}
    assert wide["even"] == "4.5-12.25" and wide["none"] is None


# --- blinding --------------------------------------------------------------------------------------------------------


def test_permutations_are_those_of_the_library(spark):
    seeds = [(str(i), i) for i in range(1000)] + [("none", None)]
    got = {}
    for r in blinding.blind_orders(spark.createDataFrame(seeds, "experiment string, seed long").repartition(5)).collect():
        got.setdefault(r.experiment, {})[r.output_id] = r.run_id
    for name, seed in seeds[:1000]:
        want = list(RUNS)
        random.Random(seed).shuffle(want)
        assert got[name] == dict(zip("ABCDEF", want, strict=True))
    assert "none" not in got
    texts = blinding.blind_orders(spark.createDataFrame([("x", "a seed")], "experiment string, seed string")).orderBy("output_id").collect()
    assert [r.run_id for r in texts] == blinding.permuted("a seed")


def test_artifacts(spark):
    outputs = [(e, f"run_0{i}", f"Model: {e}\nText {i} of GPT-X, by sol.") for e in ("one", "two") for i in range(1, 7) if (e, i) != ("two", 6)]
    models = spark.createDataFrame([(f"run_0{i}", "terra" if i % 2 else "sol", 'id "q", x') for i in range(1, 7)], "run_id string, model_key string, model_id string")
    experiments = spark.createDataFrame([("one", 7), ("two", 8)], "experiment string, seed long")
    got = {r.experiment: r for r in blinding.artifacts(experiments, spark.createDataFrame(outputs, "experiment string, run_id string, text string"), models, ["GPT-X"], ["terra", "sol"]).collect()}
    assert got["two"].error_code == "BLINDING_FAILED" and got["two"].files is None and got["one"].error_code is None
    files = {f.name.split("/")[-1]: bytes(f.content) for f in got["one"].files}
    order = blinding.permuted(7)
    rows, out = [], io.StringIO(newline="")
    for label, run in zip("ABCDEF", order, strict=True):
        text = f"Model: one\nText {run[-1]} of GPT-X, by sol."
        assert files[f"{label}.md"] == f"Text {run[-1]} of [MODEL], by [MODEL].\n".encode()
        rows.append({"output_id": label, "run_id": run, "model_key": "terra" if int(run[-1]) % 2 else "sol", "model_id": 'id "q", x', "redaction_count": 3, "source_sha256": hashlib.sha256(text.encode()).hexdigest()})
    writer = csv.DictWriter(out, fieldnames=blinding.MAPPING, lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    assert files["blind_mapping_PRIVATE.csv"] == out.getvalue().encode()
    manifest = json.loads(files["blind_manifest.json"])
    assert manifest == {"schema_version": 1, "experiment_id": "one", "mapping_sha256": hashlib.sha256(out.getvalue().encode()).hexdigest(), "originals_preserved": True, "outputs": [{"output_id": r["output_id"], "sha256": hashlib.sha256(files[f"{r['output_id']}.md"]).hexdigest(), "redaction_count": 3} for r in rows]}
    assert files["blind_manifest.json"].decode() == json.dumps(manifest, ensure_ascii=False, sort_keys=True, indent=2) + "\n"


# --- redaction -------------------------------------------------------------------------------------------------------


def passes(text, names, words):
    """One name after the other, then the words."""
    n = 0
    for name in names:
        text, k = re.subn(re.escape(name), "[MODEL]", text, flags=re.I)
        n += k
    if words:
        text, k = re.subn(rf"\b(?:{'|'.join(map(re.escape, words))})\b", "[MODEL]", text, flags=re.I)
        n += k
    return text, n


def test_one_pass_equals_the_passes():
    rng = random.Random(11)
    alphabet = ["a", "b", "ab", "ba", "Ab", "é", "É", " ", "-", "_", "1", ".", "ſ", "s"]
    for _ in range(400):
        names = list(dict.fromkeys("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 6))))
        words = list(dict.fromkeys("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 5))))
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert redaction.redactor(tuple(names), tuple(words))(text) == passes(text, names, words), (names, words, text)


def test_names_that_reach_into_the_mark_are_refused(spark):
    for name in ("", "model", "ODE", "x[", "]y", "[", "a[MODEL]b"):
        with pytest.raises(ValueError, match="mark"):
            redaction.redactor((name,))
    with pytest.raises(ValueError, match="mark"):
        redaction.redact_many(F.col("x"), [], ["mod"])


def test_ten_thousand_names_over_conversations(spark):
    rng = random.Random(3)
    texts = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text")
    lower = [r.text.lower() for r in texts.collect()]
    said = sorted({w for r in texts.collect() for w in re.findall(r"\w{4,}", r.text)})
    names = [n for n in dict.fromkeys([*rng.sample(said, 150), *("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(10_000))]) if not redaction.touches_mark(n)]
    words = [w for w in rng.sample(said, 60) if not redaction.touches_mark(w)]
    relevant = [n for n in names if any(n.lower() in t for t in lower)]  # the passes of the others change nothing
    got = texts.select("text", redaction.redact_many(F.col("text"), names, words).alias("r")).collect()
    assert len(names) > 10_000 and sum(r.r.removed for r in got) > 100
    for r in got:
        assert tuple(r.r) == passes(r.text, relevant, words)


def test_nulls_and_case(spark):
    df = spark.createDataFrame([(None,), ("",), ("ÜBER über Übermut",)], "x string")
    got = [r[0] for r in df.select(redaction.redact_many(F.col("x"), ["ÜBERM"], ["über"])).collect()]
    assert [tuple(r) if r else None for r in got][1:] == [("", 0), ("[MODEL] [MODEL] [MODEL]ut", 3)] and (got[0] is None or got[0].text is None)
