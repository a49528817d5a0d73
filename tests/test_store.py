import json
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerflow import schemas
from ledgerflow.functions import identity
from ledgerflow.operators import packages, store
from ledgerflow.sources import feeds, sinks
from ledgerflow.sources.files import Refused
from ledgerflow.streaming import harvest

ITEM = "<item><title>{t}</title><link>https://example.com/{t}?utm_source=fixture</link><description>Кратко</description><pubDate>2026-07-13 10:00</pubDate></item>"


def feed(*titles):
    return bytearray(("<rss><channel>" + "".join(ITEM.format(t=t) for t in titles) + "</channel></rss>").encode())


def snapshots(spark, *titles):
    docs = spark.createDataFrame([("a", feed(*titles))], "path string, content binary")
    return feeds.snapshots(feeds.parsed(docs), "2026-01-01T00:00:00Z")[0]


@pytest.fixture
def opened(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.init() and not s.init()
    return s


def test_harvest_twice_changes_nothing(spark, opened):
    assert opened.harvest(snapshots(spark, "a", "b", "a")) == (2, 1)
    assert opened.harvest(snapshots(spark, "b", "a", "c")) == (1, 2)
    assert opened.harvest(snapshots(spark, "b", "a", "c")) == (0, 3)
    listed = store.list_stories(opened.read("stories"), opened.read("sources")).collect()
    assert len(listed) == 3 and [r.id for r in listed] == sorted(r.id for r in listed)


def test_conflict_refuses_the_whole_batch(spark, opened):
    opened.harvest(snapshots(spark, "a"))
    named = snapshots(spark, "b", "a").withColumn("source_name", F.when(F.col("title") == "a", "other"))
    with pytest.raises(store.StoreError):
        opened.harvest(named)
    assert opened.read("sources").count() == 1
    moved = snapshots(spark, "a").withColumns({"original_url": F.lit("https://else.example"), "discovered_at": F.lit("later")})
    assert opened.harvest(moved) == (0, 1)


def test_tampered_snapshot_and_missing_story(spark, opened):
    with pytest.raises(store.StoreError):
        opened.harvest(snapshots(spark, "a").withColumn("title", F.lit("b")))
    opened.harvest(snapshots(spark, "a"))
    opened.commit({"stories": opened.read("stories").limit(0)})
    with pytest.raises(store.StoreError):
        opened.harvest(snapshots(spark, "a"))


def test_store_not_initialised_or_changed(spark, tmp_path, opened):
    with pytest.raises(store.StoreError) as e:
        store.Store(spark, str(tmp_path / "none")).read("sources")
    assert e.value.code == "E_DB_NOT_INITIALIZED"
    opened.commit({"schema_meta": spark.createDataFrame([(1, 3)], schemas.META)})
    with pytest.raises(store.StoreError):
        opened.check()


def test_packages(spark, opened):
    opened.harvest(snapshots(spark, "a"))
    sources = opened.read("sources")
    built = packages.mock_packages(sources, "2026-01-01T00:00:00Z")
    assert opened.save_packages(built) == 1 and opened.save_packages(built.withColumn("built_at", F.lit("later"))) == 0
    with pytest.raises(store.StoreError):
        opened.save_packages(built.withColumn("payload_json", F.lit("{}")))
    stored = opened.read("story_packages")
    assert [r.error_code for r in packages.mock_package_errors(stored, sources).collect()] == [None]
    payload = json.loads(stored.first().payload_json)
    assert payload["claims"][0]["text"] == "RSS item reports: a" and payload["publishable"] is False
    assert stored.first().payload_json == json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert sinks.package_json(stored.first().payload_json).decode().startswith('{\n  "claims": [\n    {\n      "id": "claim_')


def test_two_packages_of_one_story_in_a_batch_are_refused(spark, opened):
    opened.harvest(snapshots(spark, "a"))
    built = packages.mock_packages(opened.read("sources"), "2026-01-01T00:00:00Z")
    with pytest.raises(store.StoreError):
        opened.save_packages(built.union(built.withColumn("built_at", F.lit("later"))))
    assert opened.read("story_packages").count() == 0 and opened.save_packages(built.union(built)) == 1


def test_two_writers_of_one_batch_leave_one_row(spark, opened, monkeypatch):
    """The second is checked on the commit before the first's, and must be checked again."""
    other, batch, first = store.Store(spark, opened.path), snapshots(spark, "a"), []
    stale = other.snapshot()

    def read():
        first.append(1)
        return stale if len(first) == 1 else store.Store(spark, opened.path).snapshot()

    monkeypatch.setattr(other, "snapshot", read)
    assert opened.harvest(batch) == (1, 0)
    won = opened.snapshot()
    assert other.harvest(batch) == (0, 1)
    assert opened.read("sources").count() == 1 and opened.read("stories").count() == 1
    assert opened.snapshot() == won and len(first) > 1


def test_a_conflict_that_came_between_refuses_the_batch(spark, opened, monkeypatch):
    """What another writer has stored meanwhile counts: the batch is refused as it would be after it."""
    other, calls = store.Store(spark, opened.path), []
    stale = other.snapshot()
    monkeypatch.setattr(other, "snapshot", lambda: stale if not calls and not calls.append(1) else store.Store(spark, opened.path).snapshot())
    opened.harvest(snapshots(spark, "a"))
    with pytest.raises(store.StoreError) as e:
        other.harvest(snapshots(spark, "a").withColumn("source_name", F.lit("other")))
    assert e.value.code == "E_DB_SCHEMA" and opened.read("sources").count() == 1


def test_harvests_in_threads_equal_one_after_the_other(spark, opened):
    batches = [("a", "b", "c"), ("b", "c", "d"), ("c", "d", "e")]
    with ThreadPoolExecutor(3) as pool:
        counts = list(pool.map(lambda titles: store.Store(spark, opened.path).harvest(snapshots(spark, *titles)), batches))
    assert sum(c for c, _ in counts) == 5 and sum(u for _, u in counts) == 4
    assert sorted(r.title for r in opened.read("sources").collect()) == list("abcde")
    assert store.list_stories(opened.read("stories"), opened.read("sources")).count() == opened.read("stories").count() == 5


def test_commits_on_other_tables_do_not_disturb(spark, opened):
    at = opened.snapshot()
    opened.harvest(snapshots(spark, "a"))
    meta = opened.read("schema_meta")
    assert opened.commit({"schema_meta": meta}, at=at, reads=("schema_meta",)) == at.number + 2
    parts = {p.name for p in Path(opened.path, "sources").iterdir()}
    with pytest.raises(store.Overtaken):
        opened.commit({"sources": opened.read("sources", at)}, at=at, reads=("sources",))
    assert {p.name for p in Path(opened.path, "sources").iterdir()} == parts  # the loser leaves nothing
    assert opened.read("sources").count() == 1 and not list(Path(opened.path, "_staged").glob("*"))


def test_init_in_threads(spark, tmp_path):
    path = str(tmp_path / "s")
    with ThreadPoolExecutor(3) as pool:
        made = list(pool.map(lambda _: store.Store(spark, path).init(), range(3)))
    assert sorted(made) == [False, False, True]
    store.Store(spark, path).check()


@pytest.mark.parametrize("scheme", ["file", "viewfs"])
def test_put_if_absent(spark, opened, monkeypatch, scheme):
    """By a hard link, and by a rename that does not overwrite."""
    if scheme == "viewfs":
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.put.link./in", f"file://{opened.path}")
        one = store.Store(spark, "viewfs://put/in")
    else:
        one = opened
    assert one._put_if_absent("_commits/900", "x") and not one._put_if_absent("_commits/900", "y")
    assert Path(opened.path, "_commits/900").read_text() == "x\n"


def test_package_conflicts_of_a_provider(spark):
    row = ("pkg_" + "0" * 24, "story_" + "0" * 24, 2, "deepseek", "deepseek-v4-flash", "0" * 64, "{}", "now")
    old = spark.createDataFrame([row], schemas.PACKAGES)
    assert store.package_conflicts(old.withColumn("payload_json", F.lit("[]")), old).count() == 0
    assert store.package_conflicts(old.withColumn("input_fingerprint", F.lit("1" * 64)), old).count() == 1


def test_constraints(spark):
    good = snapshots(spark, "a").select(*schemas.SOURCES.fieldNames())
    assert schemas.same_schema(good, "sources") and schemas.violations(good, "sources").first().violation is None
    bad = good.withColumn("id", F.lit("src_XYZ"))
    assert schemas.violations(bad, "sources").first().violation == "id"
    assert schemas.duplicates(good.union(good), "id").first().n == 2
    assert schemas.orphans(good.select("id"), "id", bad, "id").count() == 1


def test_exports(tmp_path):
    pair = {tmp_path / "a.json": b"1", tmp_path / "a.md": b"2"}
    assert sinks.export_pair(pair) == (2, 0) and sinks.export_pair(pair) == (0, 2)
    (tmp_path / "a.md").write_bytes(b"3")
    with pytest.raises(Refused) as e:
        sinks.export_pair(pair)
    assert e.value.code == "E_EXPORT_CONFLICT" and sinks.export_pair(pair, force=True) == (1, 1)
    (tmp_path / "a.md").unlink()
    with pytest.raises(Refused) as e:
        sinks.export_pair(pair)
    assert e.value.code == "E_EXPORT_PARTIAL"
    assert sinks.write_once(tmp_path / "w", b"1") and not sinks.write_once(tmp_path / "w", b"1")
    with pytest.raises(Refused):
        sinks.write_once(tmp_path / "w", b"2")
    assert sinks.csv_bytes(["a", "b"], [{"a": 1, "c": 2}]) == b"a,b\n1,\n"


DRAFT = {
    "story_id": "", "source_id": "", "working_title": "t", "editorial_format": "AI_SIGNAL", "one_sentence_fact": "f", "why_it_matters": "w", "editorial_angle": "a",
    "claims": [{"claim_id": "claim_1", "text": "x", "status": "VERIFIED", "confidence": "HIGH", "evidence_source_id": "", "use_in_script": True, "qualification": "q"}],
    "limitations": [packages.LIMITATION], "demonstration_plan": ["p"], "publication_verdict": "READY", "source_references": [{"source_id": "", "canonical_url": ""}],
}


def test_provider_answers(spark):
    source = snapshots(spark, "a")
    row = source.withColumn("story", identity.story_id(F.col("id"))).first()
    good = json.loads(json.dumps(DRAFT).replace('"story_id": ""', f'"story_id": "{row.story}"').replace('source_id": ""', f'source_id": "{row.id}"').replace('"canonical_url": ""', f'"canonical_url": "{row.canonical_url}"'))
    cases = {
        "good": ([("stop", json.dumps(good))], None), "truncated": ([("length", json.dumps(good))], "TRUNCATED"), "empty": ([("stop", " ")], "EMPTY"),
        "extra": ([("stop", json.dumps({**good, "x": 1}))], "INVALID"), "number": ([("stop", json.dumps({**good, "working_title": 1}))], "INVALID"), "unverified": ([("stop", json.dumps({**good, "claims": [{**good["claims"][0], "status": "UNVERIFIED"}]}))], "INVALID"),
        "repaired": ([("stop", "no"), ("stop", json.dumps(good))], None), "lineage": ([("stop", json.dumps({**good, "story_id": "story_" + "0" * 24}))], "LINEAGE"),
    }
    for name, (answers, error) in cases.items():
        responses = spark.createDataFrame([(row.story, i + 1, f, c) for i, (f, c) in enumerate(answers)], "story_id string, attempt int, finish_reason string, content string")
        got = packages.provider_payloads(responses, source, "p").first()
        assert (got.error_code or "").startswith(error or "") and (got.error_code is None) == (error is None), (name, got.error_code)
        if error is None:
            assert got.repair_used == (name == "repaired") and got.draft.claims[0].text == "x"


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        (lambda d: d.update(story_id=5), "story_id: string"), (lambda d: d.update(working_title=True), "working_title: string"), (lambda d: d.update(one_sentence_fact=None), "one_sentence_fact: string"), (lambda d: d.update(why_it_matters=7), "why_it_matters: length"),
        (lambda d: d["claims"][0].update(use_in_script=1), "claims: fields"), (lambda d: d["claims"][0].update(text=2.5), "claims: fields"), (lambda d: d["claims"][0].update(evidence_source_id=None), "claims: fields"), (lambda d: d.update(claims={}), "claims: size"),
        (lambda d: d.update(limitations=[*d["limitations"], 3]), "limitations: size"), (lambda d: d.update(demonstration_plan=[["p"]]), "demonstration_plan: size"), (lambda d: d["claims"].append({**d["claims"][0], "claim_id": "claim_\n"}), "claims: fields"),
        (lambda d: d["source_references"][0].update(canonical_url=1, extra=2), "source_references: keys"), (lambda d: d.pop("claims"), "object: keys"),
    ],
)
def test_kinds_of_values(spark, change, rule):
    draft = json.loads(json.dumps(DRAFT))
    change(draft)
    got = packages.draft_errors(spark.createDataFrame([(json.dumps(draft),)], "content string")).first()
    assert rule in got.errors


def test_a_nested_name_does_not_stand_for_a_missing_one(spark):
    draft = {**DRAFT, "story_id": 5, "x": {"story_id": "y"}}
    assert packages.draft_errors(spark.createDataFrame([(json.dumps(draft),)], "content string")).first().errors[:2] == ["object: keys", "story_id: string"]


def test_strict_json(spark):
    texts = {"{}": True, " [1] ": True, '"x"': True, "1": True, "null": True, "": False, "{} x": False, "{}]": False, "{}}": False, "{},{}": False, "1 2": False, "{}],[1": False, '{"a":1}, "b":{}': False, "nope": False, '{"a":1,"a":2}': False}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packages.strict_json(F.col("t")).isNotNull()).collect()
    assert {r[0]: r[1] for r in got} == texts


def test_streaming_harvest(spark, tmp_path, opened):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.xml").write_bytes(feed("a", "b"))
    (landing / "bad.xml").write_bytes(b"<rss/>")
    args = (str(landing), opened, str(tmp_path / "cp"), str(tmp_path / "rejected"), "2026-01-01T00:00:00Z")
    harvest.start(spark, *args).awaitTermination(60)
    assert opened.read("sources").count() == 2
    (landing / "again.xml").write_bytes(feed("b", "c"))
    harvest.start(spark, *args).awaitTermination(60)
    assert opened.read("sources").count() == 3 and opened.read("stories").count() == 3
    assert spark.read.parquet(str(tmp_path / "rejected")).count() == 1
