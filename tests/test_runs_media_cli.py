import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerflow import cli
from ledgerflow.operators import experiment, media, runs

SLOTS = [(i, r, "ab"[i % 2], f"m-{'ab'[i % 2]}", "high") for i, r in enumerate(experiment.RUNS)]
SLOT_SCHEMA = "position int, run_id string, model_key string, model_id string, effort string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_completed_and_next(spark):
    slots = spark.createDataFrame(SLOTS, SLOT_SCHEMA)
    outputs = spark.createDataFrame([("run_01", "x"), ("run_02", "y"), ("run_04", "z")], "run_id string, content string")
    meta = spark.createDataFrame([("run_01", True, sha("x")), ("run_02", True, sha("changed")), ("run_03", True, sha("w"))], "run_id string, valid boolean, output_sha256 string")
    states = runs.completed(slots, outputs, meta)
    assert [r.state for r in states.orderBy("position").collect()] == ["completed", "partial", "partial", "partial", "pending", "pending"]
    assert tuple(runs.next_slot(states).first()) == ("run_02", "WORKSPACE_CONFLICT")
    assert tuple(runs.next_slot(states.withColumn("state", F.lit("completed"))).first()) == (None, "ALL_RUNS_COMPLETE")
    assert tuple(runs.next_slot(states.where("state <> 'partial'")).first()) == ("run_05", None)
    assert runs.approved_order(slots, [(r, m) for _, r, m, *_ in SLOTS]).first()[0] and not runs.approved_order(slots, [("run_01", "a")]).first()[0]


def test_imports_and_invalidations(spark):
    slots = spark.createDataFrame(SLOTS, SLOT_SCHEMA)
    rows = [("run_01", "m-a", "high", 1.0, "t", None), ("run_02", "m-b", "high", 1.0, "t", "RUN_ORDER_VIOLATION"), ("run_9", "m-a", "high", 1.0, "t", "PATH_UNSAFE"), ("run_01", "m-b", "high", 1.0, "t", "RUN_IDENTITY_MISMATCH"), ("run_01", "m-a", "high", 86_401.0, "t", "HUMAN_INPUT_INVALID"), ("run_01", "m-a", "high", 1.0, " \n", "HUMAN_INPUT_INVALID")]
    df = spark.createDataFrame(rows, "run_id string, model_id string, effort string, latency_seconds double, text string, want string")
    assert all(r.error_code == r.want for r in runs.import_errors(df, slots, "run_01", "chatgpt-work").collect())
    assert {r.error_code for r in runs.import_errors(df, slots, "run_01", "api").collect()} == {"MODE_MISMATCH"}
    states = spark.createDataFrame([("run_01", "completed"), ("run_02", "pending")], "run_id string, state string")
    asked = spark.createDataFrame([("run_01", "broke"), ("run_02", "broke"), ("run_01", " ")], "run_id string, reason string")
    none = states.select("run_id").limit(0)
    assert sorted(str(r.error_code) for r in runs.invalidation_errors(asked, states, none).collect()) == ["HUMAN_INPUT_INVALID", "None", "RUN_NOT_COMPLETE"]
    assert "MORE_THAN_ONE_INVALID_REPLACEMENT" in {r.error_code for r in runs.invalidation_errors(asked, states, states.select("run_id").limit(1)).collect()}


def test_manifests_and_requests(spark):
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "name string, content string")
    m = runs.fixture_manifest(files).first()
    assert [(f.path, f.sha256, f.bytes) for f in m.files] == [("fixtures/a", sha("1"), 1), ("fixtures/b", sha("2"), 1)]
    text = '{"files":[' + ",".join(f'{{"bytes":1,"path":"fixtures/{n}","sha256":"{sha(c)}"}}' for n, c in (("a", "1"), ("b", "2"))) + '],"schema_version":1}\n'
    assert m.manifest_digest == sha(text)
    r = runs.request_input(spark.createDataFrame([(1, "y", " b\n"), (0, "x", "a")], "position int, name string, value string")).first()
    assert r.value == "=== x ===\na\n\n=== y ===\nb\n" and r.character_count == len(r.value) and r.input_sha256 == sha(r.value)
    d = runs.with_digest(spark.createDataFrame([(1, "x")], "b int, a string"), ["b", "a"]).first()
    assert d.request_digest == sha('{"a":"x","b":1}\n')
    changed = runs.chain_errors(spark.createDataFrame([("a", "1"), ("b", "2")], "name string, digest string"), spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "name string, digest string"))
    assert sorted(r.name for r in changed.collect()) == ["b", "c"]


def test_fixture_checks(spark):
    events = spark.createDataFrame([("E001", "200", "5", "0"), ("E002", "x", "5", "0"), ("E003", "200", "5", "-1")], "event_id string, http_status string, response_time_ms string, retry_number string")
    assert sorted(r[0] for r in runs.numeric_errors(events).collect()) == ["E002", "E003"]
    text = spark.createDataFrame([("see E001, E009 and xE010",)], "value string")
    assert [r[0] for r in runs.unknown_mentions(text, events).collect()] == ["E009"]
    prompts = spark.createDataFrame([("Ask GPT",), ("the Reference",), ("приватный",), ("fine preferences",)], "x string")
    assert [r[0] for r in prompts.select(runs.forbidden(F.col("x"))).collect()] == ["identity", "private", "private", None]
    usage = spark.createDataFrame([('{"a": 5, "b": true, "c": -1, "d": {"e": 7}, "f": 1.5}',)], "x string")
    assert list(usage.select(*[runs.count_or_null(F.col("x"), p) for p in ("$.a", "$.b", "$.c", "$.d.e", "$.f", "$.g")]).first()) == [5, None, None, 7, None, None]
    assert [r[0] for r in spark.createDataFrame([("  a\n\n",), (" ",)], "x string").select(runs.visible_output(F.col("x"))).collect()] == ["a\n", None]


def test_evidence_and_outcomes(spark):
    e = runs.evidence(spark.createDataFrame([("b",), ("a",), ("a",)], "path string"), spark.createDataFrame([("a", 1, "h")], "path string, bytes long, sha256 string")).collect()
    assert [(r.path, r.missing) for r in e] == [("a", False), ("b", True)]
    out = runs.failures(runs.isolated([("a", 1, 2, None), ("b", None, None, "E_LIVE_FETCH")], spark)).first()
    assert tuple(out) == (1, 2, 1, "E_LIVE_HARVEST")


def test_voices(spark):
    found = spark.createDataFrame([("ru-RU", "ru-RU-BNeural"), ("ru-RU", "ru-RU-ANeural"), ("ru-RU", "ru-RU-C"), ("en-US", "en-US-ANeural")], "Locale string, ShortName string")
    assert [r[0] for r in media.voices(found).collect()] == ["ru-RU-ANeural", "ru-RU-BNeural"]
    assert tuple(media.choose_voice(found, ["ru-RU-BNeural"]).first()) == ("ru-RU-BNeural", None)
    assert tuple(media.choose_voice(found, ["x"]).first()) == ("ru-RU-ANeural", None)
    assert tuple(media.choose_voice(found, [], "en-US-ANeural").first()) == (None, "E_TTS_VOICE")
    assert media.choose_voice(found.limit(0), ["x"]).first().error_code == "E_TTS_VOICE"


def test_cover_text(spark):
    df = spark.createDataFrame([(" a  b ",), ("a​b",), (" ",), (None,), ("x" * 11,)], "x string")
    text, code = media.cover_text(F.col("x"), 10)
    assert [tuple(r) for r in df.select(text.alias("t"), code.alias("e")).collect()][0] == ("a b", None)
    assert [r[0] for r in df.select(code).collect()][1:] == ["E_VIDEO_COVER"] * 4


def test_media_logs(spark):
    log = "Duration: 00:00:45.50, x\nStream Video: h264 (High), yuv420p, 1080x1920, 30 fps\nAudio: aac (LC), 44100"
    loud = '[Parsed_loudnorm_0 @ 0x1]\n{\n\t"input_i" : "-16.1",\n\t"input_tp" : "-2.0",\n\t"input_lra" : "3.10"\n}\n'
    good = ("a", log, loud, bytearray(b"..moov..mdat"))
    rows = [good, ("b", log.replace("aac", "mp3"), *good[2:]), ("c", log.replace("1080x", "720x"), *good[2:]), ("d", log.replace("30 fps", "25 fps"), *good[2:]), ("e", log.replace("45.50", "60.5"), *good[2:]), ("f", log, loud, bytearray(b"mdat moov")), ("g", log, loud.replace("-16.1", "-20"), good[3])]
    df = spark.createDataFrame(rows, "name string, log string, loudness_log string, head binary")
    got = {r.name: r.error for r in media.media_errors(df, (38, 55)).collect()}
    assert got == {"a": None, "b": "codec", "c": "dimensions", "d": "frame_rate", "e": "duration", "f": "fast_start", "g": "loudness"}


def test_fallback(spark):
    files = spark.createDataFrame([("s", "voice.mp3", b"v"), ("s", "subtitles.srt", b"t")], "script_id string, name string, content binary")
    hashes = media.artifact_hashes(files, "script_id")
    scripts_ = spark.createDataFrame([("s", "p", "y")], "script_id string, package_id string, story_id string")
    good = scripts_.join(hashes, "script_id").withColumn("voice", F.lit("ru-RU-X"))
    error = lambda m, f=files: media.fallback_errors(m, scripts_, f).first().error
    assert error(good) is None and error(good.withColumn("package_id", F.lit("q"))) == "lineage"
    assert error(good, files.where("name = 'voice.mp3'")) == "hashes" and error(good.withColumn("voice", F.lit("en"))) == "voice"


def test_cli(spark, tmp_path, capsys):
    feed = tmp_path / "feed.xml"
    feed.write_text("<rss><channel><item><title>T</title><link>https://a.example/x</link></item></channel></rss>")
    data, out = str(tmp_path / "store"), str(tmp_path / "out")

    def call(*args):
        return cli.run(cli.parser().parse_args(["--data", data, *args]), spark)

    assert call("db", "init") == ["initialised"] and call("db", "init") == ["already initialised"]
    assert call("harvest", "run", "--fixture", str(feed)) == ["created: 1", "unchanged: 0"]
    assert call("harvest", "run", "--fixture", str(feed)) == ["created: 0", "unchanged: 1"]
    story = call("stories", "list")[0].split("\t")[0]
    assert call("package", "build", "--story", story) == ["created: 1"] and call("package", "build", "--story", story) == ["created: 0"]
    assert call("package", "export", "--story", story, "--out", out) == ["written: 2", "unchanged: 0"]
    assert call("package", "export", "--story", story, "--out", out) == ["written: 0", "unchanged: 2"]
    (md,) = (tmp_path / "out").glob("*.md")
    assert md.read_text().startswith("# Story Package\n\nGeneration mode: MOCK\n") and "Published at: null\nTitle: T\n" in md.read_text()
    for args, code in ((("package", "build", "--story", "story_none"), "E_STORY_NOT_FOUND"), (("script", "build", "--story", story, "--out", out), "E_SCRIPT_PACKAGE"), (("package", "export", "--story", "x", "--out", out), "E_PACKAGE_NOT_BUILT")):
        with pytest.raises(cli.Refused) as e:
            call(*args)
        assert e.value.code == code
