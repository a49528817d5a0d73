import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import scripts
from ledgerflow.session import cut
from ledgerflow.sources import script_files
from ledgerflow.sources.files import Refused

from .test_scripts_timing import package, words


def made(spark, n=2):
    """Scripts of n packages that differ in their titles."""
    p = package(spark, [(words(30), "VERIFIED", True), (words(12), "VENDOR_CLAIM", True), (words(9), "UNVERIFIED", False)]).drop("package_id", "working_title")
    rows = [(f"pkg_{i:024x}", f"story_{i:024x}", f"Тема *{i}*", f"{{{i}}}") for i in range(n)]
    p = p.join(spark.createDataFrame(rows, "package_id string, story_id string, working_title string, payload_json string"))
    return cut(script_files.finished(scripts.with_identity(scripts.compose(p))))


def stored(spark, path):
    return script_files.load(spark.read.format("binaryFile").option("pathGlobFilter", "script_*.json").load(str(path)))


def test_pairs_are_written_once_and_read_back(spark, tmp_path):
    done = made(spark)
    assert script_files.write(done, str(tmp_path)) == (4, 0) and script_files.write(done, str(tmp_path)) == (0, 4)
    back = stored(spark, tmp_path)
    assert sorted(map(str, back.drop("path").collect())) == sorted(map(str, done.collect())) and back.where("error_code is not null").count() == 0
    row = done.where("package_id like '%1'").first()
    raw = (tmp_path / f"{row.script_id}.json").read_text()
    value = json.loads(raw)
    assert raw == json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n" and set(value) == set(script_files.KINDS)
    assert value["target_duration_seconds"] == 60 and value["manual_approval_required"] is True and value["scenes"][0]["order"] == 1
    assert value["script_id"] == "script_" + hashlib.sha256(f"f3-script:{value['input_fingerprint']}".encode()).hexdigest()[:24]
    page = (tmp_path / f"{row.script_id}.md").read_text().split("\n")
    assert page[0] == "# Тема \\*1\\*" and page[2] == f"Script ID: `{row.script_id}`" and page[-2:] == ["Manual approval required before publication: **true**", ""]
    assert f"| 1 | {value['hook']} |" in "\n".join(page) and "| — |" in "\n".join(page) and "Target duration: 60 seconds" in page


def test_a_partial_or_changed_pair_refuses_all(spark, tmp_path):
    done = made(spark)
    script_files.write(done, str(tmp_path))
    ids = sorted(r.script_id for r in done.collect())
    (tmp_path / f"{ids[0]}.md").unlink()
    (tmp_path / f"{ids[1]}.json").unlink()
    (tmp_path / f"{ids[1]}.md").unlink()
    with pytest.raises(Refused) as e:
        script_files.write(done, str(tmp_path))
    assert e.value.code == "E_SCRIPT_PARTIAL" and not (tmp_path / f"{ids[1]}.json").exists()
    (tmp_path / f"{ids[0]}.md").write_text("other")
    with pytest.raises(Refused) as e:
        script_files.write(done, str(tmp_path))
    assert e.value.code == "E_SCRIPT_CONFLICT"


def test_scripts_with_an_error_are_not_written(spark, tmp_path):
    bad = made(spark, 1).withColumn("error_code", F.lit("E_SCRIPT_OUTPUT"))
    assert script_files.write(bad, str(tmp_path / "none")) == (0, 0) and not list(Path(tmp_path / "none").glob("*.json"))


def test_only_what_was_written_is_read(spark, tmp_path):
    script_files.write(made(spark, 1), str(tmp_path))
    (good,) = tmp_path.glob("*.json")
    value = json.loads(good.read_text())
    pretty = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, indent=2) + "\n"
    wrong = {
        "extra": pretty({**value, "x": 1}), "missing": pretty({k: v for k, v in value.items() if k != "caption"}), "kind": pretty({**value, "word_count": "100"}), "compact": json.dumps(value, ensure_ascii=False, sort_keys=True), "order": json.dumps(dict(reversed(value.items())), ensure_ascii=False, indent=2) + "\n",
        "id": pretty({**value, "script_id": "script_" + "0" * 24}), "nojson": "{}\n", "scene": pretty({**value, "scenes": [{**s, "y": None} for s in value["scenes"]]}),
    }
    for name, body in wrong.items():
        (tmp_path / f"script_{name}.json").write_text(body)
    got = {r.path.rsplit("/", 1)[1]: (r.error_code, r.script_id) for r in stored(spark, tmp_path).collect()}
    assert got.pop(good.name) == (None, value["script_id"]) and len(got) == len(wrong)
    assert set(got.values()) == {("E_SCRIPT_INVALID", None)}
