"""Exports: canonical JSON and Markdown bytes, write-once files, pairs of files, CSV with fixed columns."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.text import escape_markdown, shown
from ledgerflow.sources.files import Refused


def pretty(value: object) -> bytes:
    """Sorted keys, two blanks a level, raw Unicode, one line feed at the end."""
    return (json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n").encode()


def package_json(payload_json: str) -> bytes:
    """A package for export: its arrays in the order of ids."""
    value = json.loads(payload_json)
    if value["schema_version"] == 1:
        value["sources"].sort(key=lambda s: s["id"])
        value["claims"] = [{**c, "source_ids": sorted(c["source_ids"])} for c in sorted(value["claims"], key=lambda c: c["id"])]
    else:
        value["claims"].sort(key=lambda c: c["claim_id"])
        value["source_references"].sort(key=lambda r: r["source_id"])
    return pretty(value)


def mock_markdown(p: Column) -> Column:
    """Markdown of a parsed mock package (struct), as one expression."""
    s, c = p["sources"][0], p["claims"][0]
    tick = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    line = lambda label, x: F.concat(F.lit(label + ": "), x)
    raw = F.when(s["published_at_raw"].isNotNull(), F.array(line("Published at raw", escape_markdown(s["published_at_raw"])))).otherwise(F.array().cast("array<string>"))
    head = F.array(
        *map(F.lit, ("# Story Package", "", "Generation mode: MOCK", "Publishable: false", "Warning: Demo-only package; no human verification; do not publish.", "")),
        line("Package ID", tick(p["package_id"])), line("Story ID", tick(p["story"]["id"])), line("Story title", escape_markdown(p["story"]["title"])), F.lit(""), F.lit("## Source"), F.lit(""),
        line("Source ID", tick(s["id"])), line("Canonical URL", escape_markdown(s["canonical_url"])), line("Content hash", tick(s["content_hash"])), line("Published at", shown(s["published_at"])),
    )
    ids = F.array_join(F.transform(c["source_ids"], tick), ", ")
    tail = F.array(
        line("Title", escape_markdown(s["title"])), F.lit(""), F.lit("## Claim"), F.lit(""), line("Claim ID", tick(c["id"])), line("Text", escape_markdown(c["text"])), line("Type", c["type"]),
        line("Status", c["status"]), line("Qualifier", escape_markdown(c["qualifier"])), line("Source IDs", ids), F.lit(""),
    )
    return F.array_join(F.concat(head, raw, tail), "\n")


def provider_markdown(p: Column) -> Column:
    """Markdown of a parsed provider package (struct)."""
    tick = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    line = lambda label, x: F.concat(F.lit(label + ": "), x)
    bullets = lambda a: F.transform(a, lambda v: F.concat(F.lit("- "), escape_markdown(v)))
    lit = lambda *x: F.array(*map(F.lit, x))
    claims = F.array_sort(p["claims"], lambda a, b: F.when(a["claim_id"] < b["claim_id"], -1).when(a["claim_id"] > b["claim_id"], 1).otherwise(0))
    of_claim = F.flatten(F.transform(claims, lambda c: F.array(
        F.concat(F.lit("### "), tick(escape_markdown(c["claim_id"]))), F.lit(""), line("Text", escape_markdown(c["text"])), line("Status", c["status"]), line("Confidence", c["confidence"]),
        line("Evidence source ID", tick(c["evidence_source_id"])), line("Use in script", c["use_in_script"].cast("string")), line("Qualification", escape_markdown(c["qualification"])), F.lit(""),
    )))
    u, g = p["usage_metadata"], p["generator"]
    return F.array_join(F.concat(
        lit("# Story Package", "", "Generation mode: DEEPSEEK", "Publishable: editorial verdict only; human review required", "Warning: Evidence is limited to one official vendor feed.", ""),
        F.array(line("Package ID", tick(p["package_id"])), line("Story ID", tick(p["story_id"])), line("Source ID", tick(p["source_id"])), line("Prompt version", tick(p["prompt_version"])), line("Working title", escape_markdown(p["working_title"])), line("Editorial format", p["editorial_format"]), line("Publication verdict", p["publication_verdict"])),
        lit("", "## Editorial summary", ""), F.array(line("Fact", escape_markdown(p["one_sentence_fact"])), line("Why it matters", escape_markdown(p["why_it_matters"])), line("Angle", escape_markdown(p["editorial_angle"]))),
        lit("", "## Claims", ""), of_claim, lit("## Limitations", ""), bullets(p["limitations"]), lit("", "## Demonstration plan", ""), bullets(p["demonstration_plan"]), lit("", "## Sources", ""),
        F.transform(p["source_references"], lambda r: F.concat(F.lit("- "), tick(r["source_id"]), F.lit(" — "), escape_markdown(r["canonical_url"]))), lit("", "## Generator metadata", ""),
        F.array(line("Provider", g["provider"]), line("Model", g["model"]), line("API format", g["api_format"]), line("Thinking", g["thinking"]), line("Temperature", g["temperature"].cast("string")), line("Input tokens", shown(u["input_tokens"])), line("Output tokens", shown(u["output_tokens"])), line("Total tokens", shown(u["total_tokens"])), line("Cache-hit tokens", shown(u["cache_hit_tokens"])), line("Repair used", u["repair_used"].cast("string")), F.lit("")),
    ), "\n")


def _replace(path: Path, data: bytes) -> None:
    """The file appears whole, by a rename."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_once(path: Path, data: bytes, code: str = "WORKSPACE_CONFLICT") -> bool:
    """False if the file is there with these bytes; another file is never replaced."""
    if path.exists():
        if path.read_bytes() != data:
            raise Refused(code, "the file is there with other bytes")
        return False
    _replace(path, data)
    return True


def export_pair(files: dict[Path, bytes], force: bool = False) -> tuple[int, int]:
    """All files or none: (written, unchanged). Same bytes are left; a part of the pair, or other bytes, need force."""
    there = {p: p.read_bytes() for p in files if p.exists()}
    same = [p for p in there if there[p] == files[p]]
    if len(same) == len(files):
        return 0, len(same)
    if not force:
        if len(same) != len(there):
            raise Refused("E_EXPORT_CONFLICT", "an export is there with other bytes")
        if there:
            raise Refused("E_EXPORT_PARTIAL", "only a part of the export is there")
    todo = [p for p in files if p not in same]
    for p in todo:
        _replace(p, files[p])
    return len(todo), len(same)


def csv_bytes(columns: list[str], rows: DataFrame | list[dict]) -> bytes:
    """A small table as CSV: these columns in order, missing ones empty, line feeds."""
    values = [r.asDict() for r in rows.collect()] if isinstance(rows, DataFrame) else rows
    out = io.StringIO(newline="")
    writer = csv.DictWriter(out, fieldnames=columns, lineterminator="\n", extrasaction="ignore")
    writer.writeheader()
    writer.writerows({c: "" if r.get(c) is None else r[c] for c in columns} for r in values)
    return out.getvalue().encode()


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """A large table as CSV part files."""
    df.select(*columns).write.mode("errorifexists").csv(path, header=True)
