"""Fixed table schemas and their row constraints; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 2


def _ordered(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_S, _I = T.StringType(), T.IntegerType()
# The columns of the store, in order.
SOURCES = _ordered([(n, _S) for n in "id original_url canonical_url title summary_text published_at published_at_raw discovered_at content_hash source_name".split()])
STORIES = _ordered([("id", _S), ("primary_source_id", _S)])
PACKAGES = _ordered([("package_id", _S), ("story_id", _S), ("schema_version", _I), ("generator_name", _S), ("generator_version", _S), ("input_fingerprint", _S), ("payload_json", _S), ("built_at", _S)])
META = _ordered([("singleton", _I), ("version", _I)])
TABLES = {"schema_meta": META, "sources": SOURCES, "stories": STORIES, "story_packages": PACKAGES}

# Columns of the experiment's files.
EVENT_LOG = "event_id received_at external_lead_id request_id http_status response_time_ms retry_number crm_record_id assigned_manager expected_manager result".split()
SCORES = {n: 2 if n == "factual_accuracy" else 1 for n in "factual_accuracy root_cause_reasoning idempotency timeout_retry assignment remediation uat risks_assumptions practical_usability".split()}
SCORE_COLUMNS = ["output_id", *SCORES, "critical_error_count", "critical_error_notes", "review_complete"]
CORRECTION_COLUMNS = "output_id minutes accepted critical_fixes major_additions minor_edits notes timer_complete".split()
MAPPING_COLUMNS = "output_id run_id model_key model_id redaction_count source_sha256".split()


def hex_id(x: Column, prefix: str) -> Column:
    return x.rlike(rf"\A{prefix}[0-9a-f]{{24}}\z")


def digest(x: Column) -> Column:
    return x.rlike(r"\A[0-9a-f]{64}\z")


def _filled(name: str) -> Column:
    return F.length(name) > 0


def _absent_or_filled(name: str) -> Column:
    return F.col(name).isNull() | _filled(name)


def checks(name: str) -> dict[str, Column]:
    """Row constraints of a table: name -> condition that a good row meets."""
    if name == "sources":
        return {
            "id": hex_id(F.col("id"), "src_"),
            "original_url": _filled("original_url"),
            "canonical_url": _filled("canonical_url"),
            "title": F.length("title").between(1, 500),
            "summary_text": F.length("summary_text") <= 10_000,
            "published_at": _absent_or_filled("published_at"),
            "published_at_raw": _absent_or_filled("published_at_raw"),
            "discovered_at": _filled("discovered_at"),
            "content_hash": digest(F.col("content_hash")),
            "source_name": _absent_or_filled("source_name"),
        }
    if name == "stories":
        return {"id": hex_id(F.col("id"), "story_"), "primary_source_id": F.col("primary_source_id").isNotNull()}
    if name == "story_packages":
        pair = ((F.col("generator_name") == "mock") & (F.col("generator_version") == "mock-v1")) | ((F.col("generator_name") == "deepseek") & (F.col("generator_version") == "deepseek-v4-flash"))
        return {
            "package_id": hex_id(F.col("package_id"), "pkg_"),
            "story_id": F.col("story_id").isNotNull(),
            "schema_version": F.col("schema_version").isin(1, 2),
            "generator": pair,
            "input_fingerprint": digest(F.col("input_fingerprint")),
            "payload_json": F.length("payload_json").between(2, 1_000_000),
            "built_at": _filled("built_at"),
        }
    return {"singleton": F.col("singleton") == 1, "version": F.col("version") == SCHEMA_VERSION}


def violations(df: DataFrame, name: str) -> DataFrame:
    """The rows with `violation`, the first constraint that they break, or null."""
    first = None
    for label, good in checks(name).items():
        bad = ~F.coalesce(good, F.lit(False))
        first = F.when(bad, F.lit(label)) if first is None else first.when(bad, F.lit(label))
    return df.withColumn("violation", first)


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose column has no row in parent."""
    return child.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def same_schema(df: DataFrame, name: str) -> bool:
    """Names, order and types as fixed; nullability aside, as files do not keep it."""
    return [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in TABLES[name]]
