import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import identity
from ledgerflow.operators import packages
from ledgerflow.sources import feeds
from ledgerflow.streaming import repair

ITEM = "<item><title>{t}</title><link>https://example.com/{t}</link><description>d</description><pubDate>2026-07-13 10:00</pubDate></item>"
ANSWERS = "story_id string, attempt int, finish_reason string, content string"


@pytest.fixture(scope="module")
def sources(spark):
    names = [f"t{i}" for i in range(12)]
    feed = bytearray(("<rss><channel>" + "".join(ITEM.format(t=t) for t in names) + "</channel></rss>").encode())
    good = feeds.snapshots(feeds.parsed(spark.createDataFrame([("a", feed)], "path string, content binary")), "2026-01-01T00:00:00Z")[0]
    good = good.withColumn("story", identity.story_id(F.col("id")))
    return spark.createDataFrame(good.collect(), good.schema)


def draft(row, **changes):
    value = {
        "story_id": row.story, "source_id": row.id, "working_title": "t", "editorial_format": "AI_SIGNAL", "one_sentence_fact": "f", "why_it_matters": "w", "editorial_angle": "a",
        "claims": [{"claim_id": "claim_1", "text": "x", "status": "VERIFIED", "confidence": "HIGH", "evidence_source_id": row.id, "use_in_script": True, "qualification": "q"}],
        "limitations": [packages.LIMITATION], "demonstration_plan": ["p"], "publication_verdict": "READY", "source_references": [{"source_id": row.id, "canonical_url": row.canonical_url}],
    }
    return json.dumps({**value, **changes})


def answers(rows):
    """Good at once; bad and repaired; bad twice; bad without a repair; truncated; and answers about nothing known."""
    out = [("story_" + "0" * 24, 1, "stop", "{}")]
    for i, r in enumerate(rows):
        good, bad = draft(r), draft(r, working_title=5)
        out += [[(r.story, 1, "stop", good)], [(r.story, 1, "stop", bad), (r.story, 2, "stop", good)], [(r.story, 1, "stop", bad), (r.story, 2, "stop", "no")], [(r.story, 1, "stop", bad)], [(r.story, 1, "length", good), (r.story, 2, "stop", good)]][i % 5]
    return out


def streamed(spark, tmp_path, sources, batches, stored=None):
    """Each batch is a file; all outcomes, in order of arrival."""
    spark.conf.set(*repair.PROVIDER)
    landing = tmp_path / "answers"
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, ANSWERS).coalesce(1).write.parquet(str(landing / f"part={i}"))
        stream = spark.readStream.schema(ANSWERS).parquet(str(landing / "*"))
        out = repair.outcomes(stream, sources, "p", stored)
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def final(df):
    return {r.story_id: (r.package_id, r.repair_used, r.error_code) for r in df.collect() if r.action in (repair.SAVE, repair.FAIL)}


def test_replays_and_late_answers_end_as_a_batch(spark, tmp_path, sources):
    rows = sources.collect()
    everything = answers(rows)
    batch = {r.story_id: (r.package_id if r.error_code is None else None, r.repair_used, r.error_code) for r in packages.provider_payloads(spark.createDataFrame(everything, ANSWERS), sources, "p").collect()}
    waiting = {r.story for i, r in enumerate(rows) if i % 5 == 3}
    random.Random(1).shuffle(everything)
    late = [a for a in everything if a[1] == 2] + everything[:7]  # repairs before the answers they repair
    got = streamed(spark, tmp_path, sources, [late, everything, everything])
    assert final(got) == {k: v for k, v in batch.items() if k not in waiting}
    per_story = got.groupBy("story_id", "action").count().collect()
    assert all(r["count"] == 1 for r in per_story) and {r.story_id for r in per_story if r.action == repair.REPAIR} >= waiting
    saved = got.where("action = 'SAVE'").first()
    assert json.loads(saved.content)["story_id"] == saved.story_id


def test_nothing_is_made_of_a_story_that_has_its_package(spark, tmp_path, sources):
    rows = sources.collect()
    stored = spark.createDataFrame([(r.story,) for r in rows[:10]], "story_id string")
    got = streamed(spark, tmp_path, sources, [answers(rows)], stored)
    assert {r.story_id for r in got.collect()} == {r.story for r in rows[10:]}


def test_packages_reach_the_store(spark, tmp_path, sources):
    """And replaying the answers to a new query finds them there."""
    from ledgerflow import schemas
    from ledgerflow.operators import store

    spark.conf.set(*repair.PROVIDER)
    rows, db = sources.collect(), store.Store(spark, str(tmp_path / "store"))
    db.init()
    db.harvest(sources.select(*schemas.SOURCES.fieldNames(), "path", "position"))
    spark.createDataFrame(answers(rows), ANSWERS).write.parquet(str(tmp_path / "answers"))
    for n in range(2):
        stream = spark.readStream.schema(ANSWERS).parquet(str(tmp_path / "answers"))
        repair.start(stream, sources, "p", db, str(tmp_path / f"checkpoint{n}"), str(tmp_path / f"failed{n}"), "2026-01-01T00:00:00Z").awaitTermination(120)
    stored = {r.story_id: r for r in db.read("story_packages").collect()}
    assert set(stored) == {r.story for i, r in enumerate(rows) if i % 5 in (0, 1, 4)}
    payload = json.loads(stored[rows[1].story].payload_json)
    assert payload["usage_metadata"] == {"cache_hit_tokens": None, "input_tokens": None, "output_tokens": None, "repair_used": True, "total_tokens": None} and payload["generator"]["temperature"] == 0.2
    assert stored[rows[1].story].payload_json == json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert {k: payload[k] for k in json.loads(draft(rows[1]))} == json.loads(draft(rows[1]))
    left = {r.story_id for r in spark.read.parquet(str(tmp_path / "failed1")).collect()}
    assert left and not left & set(stored)


def test_decisions():
    good, bad = {"error": None}, {"error": "x"}
    assert repair.decide(None, good)[0] is None and repair.decide(good, bad)[0] == "SAVE" and repair.decide(bad, None)[0] == "REPAIR"
    assert repair.decide(bad, good) == ("SAVE", good) and repair.decide(bad, dict(bad))[0] == "FAIL"
