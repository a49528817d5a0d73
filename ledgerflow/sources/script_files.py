"""Scripts as pairs of files, JSON and Markdown: written together or not at all, and read back only as they were written."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import identity, text
from ledgerflow.operators import scripts
from ledgerflow.session import cut
from ledgerflow.sources import export_sink, sinks
from ledgerflow.sources.files import Refused

# What every script says of itself, and the fields of a stored one, in order.
GENERATOR, TEMPLATE, LANGUAGE, SECONDS = "safe-local-v1", "claim-safe-script-v1", "ru", 60
SCENE = ("claim_ids", "narration", "on_screen_text", "order", "source_label", "visual_kind")
REFERENCE = ("canonical_url", "source_id")
KINDS = {
    "caption": "string", "generator": "string", "hook": "string", "input_fingerprint": "string", "language": "string", "limitations": "array<string>", "manual_approval_required": "boolean", "package_id": "string",
    "scenes": "array<struct<claim_ids: array<string>, narration: string, on_screen_text: string, order: int, source_label: string, visual_kind: string>>", "schema_version": "int", "script_id": "string",
    "source_references": "array<struct<canonical_url: string, source_id: string>>", "spoken_text": "string", "story_id": "string", "target_duration_seconds": "int", "template_version": "string", "word_count": "int", "working_title": "string",
}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in KINDS.items())


def finished(composed: DataFrame) -> DataFrame:
    """Composed scripts with their identities (scripts.with_identity) -> the columns of KINDS, and error_code."""
    own = {
        "caption": F.lit(scripts.CAPTION), "generator": F.lit(GENERATOR), "input_fingerprint": F.col("script_fingerprint"), "language": F.lit(LANGUAGE), "manual_approval_required": F.lit(True), "schema_version": F.lit(1),
        "scenes": F.transform("scenes", lambda s: F.struct(*[s[c].alias(c) for c in SCENE])), "source_references": F.transform("source_references", lambda r: F.struct(*[r[c].alias(c) for c in REFERENCE])),
        "target_duration_seconds": F.lit(SECONDS), "template_version": F.lit(TEMPLATE), "word_count": F.col("word_count").cast("int"), "working_title": F.col("script_title"),
    }
    return composed.select(*[own.get(c, F.col(c)).alias(c) for c in KINDS], "error_code")


def json_text() -> Column:
    """The canonical JSON of a row with the columns of KINDS."""
    return text.mapped(lambda x: sinks.pretty(json.loads(x)).decode(), text.canonical_json(*[F.col(c) for c in KINDS]))


def escaped(x: Column) -> Column:
    """Text for a line of Markdown or a cell of a table."""
    return text.escape_markdown(F.replace(x, F.lit("\n"), F.lit(" ")))


def markdown() -> Column:
    """Markdown of a row with the columns of KINDS."""
    c, lit = F.col, lambda *x: F.array(*map(F.lit, x))
    tick = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    line = lambda label, x: F.concat(F.lit(label + ": "), x)
    ids = lambda s: F.when(F.size(s["claim_ids"]) > 0, F.array_join(F.transform(s["claim_ids"], tick), ", ")).otherwise("—")
    scene = lambda s: F.concat(F.lit("| "), F.concat_ws(" | ", s["order"].cast("string"), escaped(s["narration"]), escaped(s["on_screen_text"]), ids(s), escaped(s["source_label"])), F.lit(" |"))
    head = F.array(
        F.concat(F.lit("# "), escaped(c("working_title"))), F.lit(""), line("Script ID", tick(c("script_id"))), line("Story ID", tick(c("story_id"))), line("Package ID", tick(c("package_id"))), line("Generator", tick(c("generator"))),
        line("Template version", tick(c("template_version"))), F.concat(line("Target duration", c("target_duration_seconds").cast("string")), F.lit(" seconds")), line("Word count", c("word_count").cast("string")),
    )
    return F.array_join(F.concat(
        head, lit("", "## Hook", ""), F.array(escaped(c("hook"))), lit("", "## Spoken narration", ""), F.array(escaped(c("spoken_text"))), lit("", "## Scenes", "", "| # | Narration | On-screen text | Claim IDs | Source |", "|---:|---|---|---|---|"),
        F.transform("scenes", scene), lit("", "## Sources", ""), F.transform("source_references", lambda r: F.concat(F.lit("- "), tick(r["source_id"]), F.lit(" — "), escaped(r["canonical_url"]))),
        lit("", "## Limitations", ""), F.transform("limitations", lambda x: F.concat(F.lit("- "), escaped(x))), lit("", "## Caption", ""), F.array(escaped(c("caption"))), lit("", "Manual approval required before publication: **true**", ""),
    ), "\n")


def pairs(finished_scripts: DataFrame) -> DataFrame:
    """Scripts of finished() without an error -> (files): each one's JSON and Markdown. They are composed once and written before
    they are rendered, as composing is a large expression."""
    file = lambda ending, content: F.struct(F.concat("script_id", F.lit(ending)).alias("name"), F.encode(content, "UTF-8").alias("content"))
    rows = cut(finished_scripts).where("error_code is null").withColumns({"_json": json_text(), "_page": markdown()})
    return rows.select(F.array(file(".json", F.col("_json")), file(".md", F.col("_page"))).alias("files"))


def write(finished_scripts: DataFrame, path: str) -> tuple[int, int]:
    """All pairs or none: (files written, files unchanged). A pair of which one file is there, or other bytes, refuses all."""
    try:
        return export_sink.export(pairs(finished_scripts), path)
    except Refused as e:
        raise Refused(e.code.replace("E_EXPORT", "E_SCRIPT"), str(e)) from None


def load(files: DataFrame) -> DataFrame:
    """Files (path, content) of stored scripts -> (path, the columns of KINDS, error_code).

    A script is what its JSON says if its id follows from its fingerprint and writing it again gives the same bytes: then no
    field is missing, unknown or of another kind. Else it is E_SCRIPT_INVALID, and its columns are null.
    """
    value = F.from_json(F.col("content").cast("string"), SCHEMA)
    rows = files.select("path", "content", value.alias("_s")).select("path", "content", "_s.*")
    same = F.encode(json_text(), "UTF-8") == F.col("content")
    good = F.coalesce((F.col("script_id") == identity.script_id(F.col("input_fingerprint"))) & same, F.lit(False))
    checked = rows.withColumn("_good", good)
    return checked.select("path", *[F.when(F.col("_good"), F.col(c)).alias(c) for c in KINDS], F.when(~F.col("_good"), "E_SCRIPT_INVALID").alias("error_code"))
