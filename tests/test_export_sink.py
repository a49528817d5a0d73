import json
import pickle
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerflow.sources import export_sink
from ledgerflow.sources.export_sink import SCHEMA, export
from ledgerflow.sources.files import Refused


def groups(spark, *rows):
    """Each row: {name: text}."""
    return spark.createDataFrame([([(n, bytearray(t.encode())) for n, t in r.items()],) for r in rows], SCHEMA).repartition(3)


def files(path):
    return {str(p.relative_to(path)): p.read_text() for p in Path(path).rglob("*") if p.is_file() and "_export-results" not in str(p)}


MANY = [{f"p{i}.json": f"j{i}", f"p{i}.md": f"m{i}"} for i in range(20)]


def test_export_and_again(spark, tmp_path):
    out = str(tmp_path / "out")
    assert export(groups(spark, *MANY), out) == (40, 0) and len(files(out)) == 40 and files(out)["p7.md"] == "m7"
    assert export(groups(spark, *MANY, {"sub/x.json": "x"}), out) == (1, 40) and files(out)["sub/x.json"] == "x"
    assert export(groups(spark), out) == (0, 0)


def test_one_conflict_leaves_nothing_behind(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "p3.json").write_text("other")
    (out / "p3.md").write_text("m3")
    with pytest.raises(Refused) as e:
        export(groups(spark, *MANY), str(out))
    assert e.value.code == "E_EXPORT_CONFLICT" and "p3.json" in str(e.value) and files(out) == {"p3.json": "other", "p3.md": "m3"}
    assert [p.name for p in out.iterdir() if p.name.startswith("_export-") and p.name != "_export-results"] == []
    assert export(groups(spark, *MANY), str(out), force=True) == (39, 1) and files(out)["p3.json"] == "j3"


def test_a_part_of_a_group_refuses_all(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "p3.json").write_text("j3")
    with pytest.raises(Refused) as e:
        export(groups(spark, *MANY), str(out))
    assert e.value.code == "E_EXPORT_PARTIAL" and files(out) == {"p3.json": "j3"}
    assert export(groups(spark, *MANY), str(out), force=True) == (39, 1)


def test_a_conflict_comes_before_a_part(spark, tmp_path):
    (tmp_path / "p1.json").write_text("j1")
    (tmp_path / "p2.json").write_text("?")
    with pytest.raises(Refused) as e:
        export(groups(spark, *MANY), str(tmp_path))
    assert e.value.code == "E_EXPORT_CONFLICT"


def test_names(spark, tmp_path):
    for name in ("../x", "/x", "a//b", "", "a/../b", "_export-1/x"):
        with pytest.raises(Refused) as e:
            export(groups(spark, {"good": "1"}, {name: "2"}), str(tmp_path))
        assert e.value.code == "E_EXPORT_PATH"
    with pytest.raises(Refused):
        export(groups(spark, {"a": "1"}, {"a": "1"}), str(tmp_path))  # two groups, one name
    assert files(tmp_path) == {}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    bad = groups(spark, *MANY).withColumn("files", F.when(F.expr("files[0].name = 'p9.json'"), F.expr("cast(raise_error('lost') as array<struct<name: string, content: binary>>)")).otherwise(F.col("files")))
    with pytest.raises(Exception, match="lost"):
        export(bad, str(tmp_path / "out"))
    assert [n for n in files(tmp_path / "out") if not n.startswith("_export-")] == []  # a killed attempt may still stage a file


def test_a_decided_export_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    staged = tmp_path / "_export-dead" / "task"
    staged.mkdir(parents=True)
    (staged / "a.json").write_text("a")
    (staged / "stray").write_text("of a lost attempt")
    (tmp_path / "_export-dead" / "DECISION").write_text(json.dumps({"task": ["a.json", "b.json"]}))
    (tmp_path / "b.json").write_text("b")  # had its name already
    assert export(groups(spark, {"c": "c"}), str(tmp_path)) == (1, 0)
    assert files(tmp_path) == {"a.json": "a", "b.json": "b", "c": "c"} and export_sink.recover(str(tmp_path)) == 0
    assert export_sink.recover(str(tmp_path / "none")) == 0


def test_wrong_schema_is_refused(spark, tmp_path):
    spark.dataSource.register(export_sink.ExportSink)
    with pytest.raises(Exception, match="an export takes"):
        spark.range(3).write.format("export").mode("append").save(str(tmp_path / "x"))


def test_package_files(spark):
    mock = {"schema_version": 1, "package_id": "pkg_1", "story": {"id": "s", "title": "T*"}, "sources": [{"canonical_url": "u", "content_hash": "h", "id": "b", "published_at": None, "published_at_raw": "r", "title": "T"}], "claims": [{"id": "c", "qualifier": "q", "source_ids": ["b", "a"], "status": "UNVERIFIED", "text": "x", "type": "VENDOR_CLAIM"}]}
    real = {"schema_version": 2, "package_id": "pkg_2", "story_id": "s", "source_id": "b", "working_title": "W", "editorial_format": "AI_SIGNAL", "one_sentence_fact": "f", "why_it_matters": "w", "editorial_angle": "a", "claims": [{"claim_id": c, "text": "x", "status": "VERIFIED", "confidence": "HIGH", "evidence_source_id": "b", "use_in_script": True, "qualification": "q"} for c in ("claim_2", "claim_1")], "limitations": ["l"], "demonstration_plan": ["p"], "publication_verdict": "READY", "source_references": [{"source_id": "b", "canonical_url": "u"}], "prompt_version": "v", "generator": {"provider": "deepseek", "model": "m", "api_format": "f", "thinking": "disabled", "temperature": 0.2}, "usage_metadata": {"input_tokens": 1, "output_tokens": None, "total_tokens": 1, "cache_hit_tokens": 0, "repair_used": False}}
    rows = [("pkg_1", "mock", json.dumps(mock)), ("pkg_2", "deepseek", json.dumps(real))]
    got = {f.name: bytes(f.content).decode() for r in export_sink.package_groups(spark.createDataFrame(rows, "package_id string, generator_name string, payload_json string")).collect() for f in r.files}
    assert set(got) == {"pkg_1.json", "pkg_1.md", "pkg_2.json", "pkg_2.md"}
    assert json.loads(got["pkg_1.json"])["claims"][0]["source_ids"] == ["a", "b"] and got["pkg_2.json"].index("claim_1") < got["pkg_2.json"].index("claim_2")
    assert "Story title: T\\*" in got["pkg_1.md"] and "Generation mode: DEEPSEEK" in got["pkg_2.md"] and "Output tokens: null" in got["pkg_2.md"]


def test_what_reaches_the_driver_does_not_grow_with_the_files(tmp_path):
    many = [{"files": [{"name": f"sub/p{i}.json", "content": b"j"}, {"name": f"p{i}.md", "content": b"m"}]} for i in range(1500)]
    batch = pa.RecordBatch.from_pylist(many, pa.schema([("files", pa.list_(pa.struct([("name", pa.string()), ("content", pa.binary())])))]))
    writer = export_sink.ExportWriter({"path": str(tmp_path), "job": "j", "finish": "false"})
    message = writer.write(iter([batch]))
    assert message.written == 3000 and len(pickle.dumps(message)) < 1000
    writer.commit([message, None])
    assert not (tmp_path / "p7.md").exists() and len((tmp_path / "_export-j" / "DECISION").read_bytes()) < 100  # decided, not finished
    assert export_sink.recover(str(tmp_path)) == 1 and len(files(tmp_path)) == 3000 and files(tmp_path)["sub/p7.json"] == "j"


def test_names_twice_in_different_tasks_are_counted(spark, tmp_path):
    with pytest.raises(Refused) as e:
        export(groups(spark, *MANY, *MANY[:2]), str(tmp_path))
    assert e.value.code == "E_EXPORT_CONFLICT" and "4 files, such as p0.json, p0.md, p1.json, p1.md" in str(e.value) and files(tmp_path) == {}


def test_read_gives_the_files_that_are_there(spark, tmp_path):
    export(groups(spark, *MANY), str(tmp_path))
    names = spark.createDataFrame([(n,) for n in ("p3.json", "p4.md", "none")], "name string")
    assert sorted((r.name, r.length, bytes(r.content)) for r in export_sink.read(names, str(tmp_path)).collect()) == [("p3.json", 2, b"j3"), ("p4.md", 2, b"m4")]
    assert export_sink.read(names.limit(0), str(tmp_path)).count() == 0
