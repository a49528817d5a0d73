import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import experiment, scripts, timing

CLAIM = "claim_id string, text string, status string, evidence_source_id string, use_in_script boolean, qualification string"
PACKAGE = f"package_id string, working_title string, claims array<struct<{CLAIM.replace(' string', ': string').replace(' boolean', ': boolean')}>>, limitations array<string>, publication_verdict string, source_references array<struct<source_id: string, canonical_url: string>>"


def package(spark, claims, verdict="READY", title="t"):
    rows = [(f"claim_{i}", t, s, "s", u, f"Оговорка номер {i}") for i, (t, s, u) in enumerate(claims)]
    return spark.createDataFrame([("p", title, rows, ["Ограничение одно."], verdict, [("s", "https://www.example.com/a")])], PACKAGE)


def words(n):
    return " ".join(["слово"] * n)


def test_claims_and_scenes(spark):
    claims = [(words(9), "VENDOR_CLAIM", True), (words(9), "UNVERIFIED", False), (words(9), "VERIFIED", True), *[(words(6), "OPINION", True)] * 5]
    s = scripts.compose(package(spark, claims, "NEEDS_TEST")).first()
    assert s.hook == f"Главный факт: {words(9)}" and s.scenes[0].claim_ids == ["claim_2"]
    assert [c.claim_ids for c in s.scenes[1:4]] == [["claim_0", "claim_3"], ["claim_4", "claim_5"], ["claim_6", "claim_7"]]
    assert scripts.NOT_TESTED in s.spoken_text and s.scenes[0].source_label == "Источник: www.example.com"
    assert [c.order for c in s.scenes] == list(range(1, len(s.scenes) + 1)) and s.error_code is None
    assert [r.error for r in scripts.script_errors(scripts.compose(package(spark, claims))).collect()] == [None]


def test_padding_is_forced_below_five_scenes(spark):
    s = scripts.compose(package(spark, [(words(100), "VERIFIED", True)])).first()
    assert s.pads == 1 and len(s.scenes) == 5 and s.scenes[3].on_screen_text == "Граница материала"


def test_padding_goes_into_the_evidence_scene_at_eight(spark):
    s = scripts.compose(package(spark, [("а", "OPINION", True)] * 9)).first()
    assert len(s.scenes) == 8 and s.pads > 0 and scripts.PADDING[0] in s.scenes[5].narration


@pytest.mark.parametrize(("claims", "code"), [([("x", "UNVERIFIED", False)], "E_SCRIPT_PACKAGE"), ([(words(200), "VERIFIED", True)], "E_SCRIPT_OUTPUT")])
def test_refused_scripts(spark, claims, code):
    assert scripts.compose(package(spark, claims)).first().error_code == code


def test_long_title_falls_back(spark):
    assert scripts.compose(package(spark, [(words(60), "VERIFIED", True)], title="x" * 301)).first().script_title == scripts.FALLBACK_TITLE


def test_changed_script_is_found(spark):
    s = scripts.compose(package(spark, [(words(60), "VERIFIED", True)]))
    assert scripts.script_errors(s.withColumn("word_count", F.lit(1))).first().error == "word_count"
    assert scripts.script_errors(s.withColumn("hook", F.lit("x"))).first().error == "hook"


def test_script_is_derived_again(spark):
    s = scripts.compose(package(spark, [(words(60), "VERIFIED", True)]))
    error = lambda x: scripts.derivation_errors(x).first().error
    assert error(s) is None
    assert error(s.withColumn("script_title", F.lit(None).cast("string"))) == "script_title"
    assert error(s.withColumn("scenes", F.transform("scenes", lambda x: x.withField("source_label", F.lit("x"))))) == "scenes"
    assert error(s.withColumn("limitations", F.array(F.lit("Другое.")))) == "scenes"
    assert scripts.derivation_errors(s.limit(0)).count() == 0


def cues(spark, rows):
    return spark.createDataFrame([("s", i, a, b, t) for i, (a, b, t) in enumerate(rows)], "script_id string, idx int, start_ms long, end_ms long, text string")


def test_repair(spark):
    got = timing.repair(cues(spark, [(0, 1000, "a"), (900, 2000, "b"), (1500, 1900, "c")]), "script_id").orderBy("idx").collect()
    assert [(r.start_ms, r.valid) for r in got] == [(0, True), (1000, True), (2000, False)]


def test_srt(spark):
    text = "1\n00:00:00,000 --> 00:00:01,000\na\nb\n\n2\r\n00:00:00,999 --> 00:00:02,000\r\nc\r\n\r\n3\n00:00:01,000 --> 00:00:03,000\nd\n\n5\n00:00:03,000 --> 00:00:04,000\ne\n"
    got = timing.parse_srt(spark.createDataFrame([("f", text)], "path string, value string")).orderBy("idx").collect()
    assert [(r.text, r.error) for r in got] == [("a b", None), ("c", None), ("d", "overlap"), ("e", "index")]


def test_split_keeps_the_bounds():
    n, step = 57, 0.4
    ends = timing.split_scene([i * step for i in range(n)], [(i + 1) * step for i in range(n)], [0 if i % 9 == 8 else 2 for i in range(n)])
    starts = [0, *ends[:-1]]
    assert ends[-1] == n and all(b - a <= 10 and 1.5 <= (b - a) * step + 1e-9 and (b - a) * step <= 6.5 for a, b in zip(starts, ends, strict=True))
    assert timing.split_scene([0.0], [1.0], [2]) == [1]
    assert timing.split_scene([0.0, 20.0], [20.0, 40.0], [2, 2]) is None


def test_timed_cards(spark):
    scenes = spark.createDataFrame([("s", 1, words(15) + ".", "H1", "L"), ("s", 2, words(12), "H2", "L")], "script_id string, order int, narration string, on_screen_text string, source_label string")
    spoken = [(0, 6000, words(15) + "."), (6000, 11_000, words(12))]
    length = spark.createDataFrame([("s", 11.5)], "script_id string, duration double")
    got = timing.timed_cards(scenes, cues(spark, spoken), length).orderBy("seq").collect()
    assert got[0].start_s == 0 and got[-1].end_s == 11.5 and all(a.end_s == b.start_s for a, b in zip(got, got[1:], strict=False))
    assert all(r.error is None for r in got) and " ".join(r.text for r in got) == f"{words(15)}. {words(12)}"
    wrong = timing.timed_cards(scenes, cues(spark, [(0, 6000, words(14) + " x."), spoken[1]]), length).collect()
    assert all(r.error == "E_VIDEO_CAPTIONS" for r in wrong)


@pytest.mark.parametrize(
    ("deltas", "want"),
    [((1, 0, 5, 0), "SOL"), ((1, 0, 6, 0), "MIXED"), ((-1, 0, -5, 0), "TERRA"), ((-1.5, -2, 0, 0), "SOL"), ((1.5, 2, 0, 0), "TERRA"), ((0, 0, 0, 2), "SOL"), ((0, 0, 0, -2), "TERRA"), ((0, 0, 0, 0), "MIXED"), ((1, 1, 0, 0), "MIXED")],
)
def test_verdict(spark, deltas, want):
    rows = [("sol", 3, *[float(d) for d in deltas]), ("terra", 3, 0.0, 0.0, 0.0, 0.0)]
    m = spark.createDataFrame(rows, "model_key string, n int, median_score double, critical_error_total double, median_correction_minutes double, accepted_within_20 double")
    assert experiment.verdict(m, "sol", "terra").first()[0] == want
    assert experiment.verdict(m.withColumn("n", F.lit(2)), "sol", "terra").first()[0] == "INCONCLUSIVE"


def test_metrics_and_costs(spark):
    runs = spark.createDataFrame([("sol", s, c, m, a, 1.5, True, "0.01", t) for s, c, m, a, t in ((10, 0, 4.5, True, 1000), (9, 1, 12.0, False, 1000), (8, 0, 5.0, True, None))], "model_key string, total_score int, critical_error_count int, minutes double, accepted boolean, latency_seconds double, cost_available boolean, direct_cost_usd string, input_tokens long")
    runs = runs.withColumns({"direct_cost_usd": F.col("direct_cost_usd").cast("decimal(20,6)"), "output_tokens": F.lit(500)})
    m = experiment.metrics(runs).first()
    assert (m.n, m.median_score, m.score_range, m.critical_error_total, m.median_correction_minutes, m.accepted_within_20, m.input_tokens_total, m.output_tokens_total) == (3, 9, "8-10", 1, 5.0, 2, None, 1500)
    assert str(m.direct_cost_total_usd).rstrip("0") == "0.03"
    price = experiment.cost(F.lit(1000), F.lit(500), F.lit("2.50").cast("decimal(10,2)"), F.lit("15.00").cast("decimal(10,2)"), F.lit(None))
    assert str(spark.range(1).select(price).first()[0]).rstrip("0") == "0.01"


def test_human_input(spark):
    rows = [("A", "20", "true", "", "true"), ("B", "20.5", "true", "", "true"), ("C", "x", "true", "", "true"), ("D", "1", "yes", "", "true"), ("E", "1", "false", "", "true"), ("F", "1", "false", "n", "no")]
    c = spark.createDataFrame([(o, m, a, "", "", "", n, t) for o, m, a, n, t in rows], "output_id string, minutes string, accepted string, critical_fixes string, major_additions string, minor_edits string, notes string, timer_complete string")
    assert {r.output_id: r.error for r in experiment.correction_errors(c).collect()} == {"A": None, "B": "minutes", "C": "minutes", "D": "accepted", "E": "notes", "F": "timer_complete"}
    assert [r[0] for r in spark.createDataFrame([("Terra wins",), ("terrain",)], "x string").select(experiment.leaks(F.col("x"), ["terra", "sol"])).collect()] == [True, False]


def test_blind_order_is_seeded():
    a = experiment.blind_order("seed")
    assert a == experiment.blind_order("seed") and sorted(r for _, r in a) == list(experiment.RUNS) and [o for o, _ in a] == list("ABCDEF")


def test_status(spark):
    args = [(5, "run_06", False, False, False), (6, None, False, False, False), (6, None, True, False, False), (6, None, True, True, False), (6, None, True, True, True)]
    df = spark.createDataFrame(args, "n int, p string, b boolean, h boolean, a boolean")
    got = [r[0] for r in df.select(experiment.next_action(*[F.col(c) for c in "npbha"])).collect()]
    assert got[0] == "execute or import run_06" and got[1] == "run blind" and got[-1].startswith("run evidence-manifest")
