"""Frozen experiments: fixture manifests, run slots, requests, imported runs, and a digest chain over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.text import canonical_json, sha256
from ledgerflow.operators.experiment import RUNS

# Limits of imported runs.
LATENCY_MOST, REASON_MOST, REPLACEMENTS = 86_400, 500, 1


def fixture_manifest(files: DataFrame, schema_version: int = 1, prefix: str = "fixtures/") -> DataFrame:
    """One row: files (name, content) as an array of (bytes, path, sha256) by path, and the digest of it all."""
    entry = F.struct(F.octet_length("content").cast("long").alias("bytes"), F.concat(F.lit(prefix), "name").alias("path"), F.sha2("content", 256).alias("sha256"))
    ordered = F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
    one = files.agg(ordered.alias("files"))
    return one.withColumn("manifest_digest", sha256(canonical_json(F.col("files"), F.lit(schema_version).alias("schema_version"), line_feed=True)))


def unknown_mentions(text: DataFrame, events: DataFrame, pattern: str = r"(?U)\bE\d{3}\b") -> DataFrame:
    """Event ids that a text (value) names and the log does not have."""
    said = text.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("event_id")).distinct()
    return said.join(events.select("event_id"), "event_id", "left_anti")


def numeric_errors(events: DataFrame) -> DataFrame:
    """Rows of the log (texts) whose number columns are no whole numbers, or whose retry is negative."""
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    bad = number("http_status").isNull() | number("response_time_ms").isNull() | number("retry_number").isNull() | (number("retry_number") < 0)
    return events.where(bad).select("event_id")


# What a prompt must not name.
IDENTITY_WORDS, PRIVATE_WORDS = r"gpt|terra|sol|модел[ьи]", r"\breference\b|\bприват\w*\b|\bключ\b"


def forbidden(prompt: Column, identity: str = IDENTITY_WORDS, private: str = PRIVATE_WORDS) -> Column:
    """What a prompt must not name: identity, private, or null."""
    return F.when(F.lower(prompt).rlike(f"(?U){identity}"), "identity").when(F.lower(prompt).rlike(f"(?U){private}"), "private")


def valid_run(run_id: Column) -> Column:
    return run_id.isin(*RUNS)


def approved_order(slots: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """One row (valid): slots (position, run_id, model_key) are the wanted ones in order."""
    got = F.transform(F.array_sort(F.collect_list(F.struct("position", "run_id", "model_key"))), lambda s: F.struct(s["run_id"].alias("run_id"), s["model_key"].alias("model_key")))
    want = F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(m).alias("model_key")) for r, m in wanted])
    return slots.agg(got.eqNullSafe(want).alias("valid"))


def completed(slots: DataFrame, outputs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Slots with `state`: completed (both artifacts, marked valid, hash as stored), partial (some artifact), or pending.

    outputs (run_id, content), metadata (run_id, valid, output_sha256).
    """
    o = outputs.select("run_id", F.sha2("content", 256).alias("actual"))
    m = metadata.select("run_id", F.lit(True).alias("described"), "valid", "output_sha256")
    rows = slots.join(o, "run_id", "left").join(m, "run_id", "left")
    good = F.coalesce(F.col("valid") & (F.col("output_sha256") == F.col("actual")), F.lit(False))
    state = F.when(good, "completed").when(F.col("actual").isNotNull() | F.col("described"), "partial").otherwise("pending")
    return rows.select(*slots.columns, state.alias("state"))


def next_slot(states: DataFrame) -> DataFrame:
    """One row (run_id, error_code): the first slot that is not completed; partial artifacts there are a conflict."""
    first = states.agg(F.min(F.when(F.col("state") != "completed", F.struct("position", "run_id", "state"))).alias("s"))
    code = F.when(F.col("s").isNull(), "ALL_RUNS_COMPLETE").when(F.col("s.state") == "partial", "WORKSPACE_CONFLICT")
    return first.select(F.col("s.run_id").alias("run_id"), code.alias("error_code"))


def request_input(parts: DataFrame) -> DataFrame:
    """parts (position, name, value) -> one row (value, character_count, input_sha256): titled sections in order."""
    strip = lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")
    sections = F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "value"))), lambda p: F.concat(F.lit("=== "), p["name"], F.lit(" ===\n"), strip(p["value"])))
    one = parts.agg(F.concat(F.array_join(sections, "\n\n"), F.lit("\n")).alias("value"))
    return one.select("value", F.length("value").alias("character_count"), sha256(F.col("value")).alias("input_sha256"))


def with_digest(df: DataFrame, columns: list[str], name: str = "request_digest") -> DataFrame:
    """The rows with the digest of the canonical JSON of these columns."""
    return df.withColumn(name, sha256(canonical_json(*[F.col(c) for c in sorted(columns)], line_feed=True)))


def visible_output(x: Column) -> Column:
    """The text without blanks at its ends and one line feed; null if nothing is left."""
    kept = F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")
    return F.when(kept != "", F.concat(kept, F.lit("\n")))


def count_or_null(payload: Column, path: str) -> Column:
    """A whole number of a JSON object that is not negative, else null; booleans, texts and fractions are none."""
    raw = F.get_json_object(payload, path)
    return F.when(raw.rlike(r"^\d{1,18}$"), raw.cast("long"))


def import_errors(runs: DataFrame, slots: DataFrame, pending: str, mode: str) -> DataFrame:
    """Runs (run_id, model_id, effort, latency_seconds, text) with error_code against the frozen slots."""
    frozen = slots.select("run_id", F.col("model_id").alias("slot_model"), F.col("effort").alias("slot_effort"))
    code = (
        F.when(F.lit(mode) != "chatgpt-work", "MODE_MISMATCH").when(~valid_run(F.col("run_id")), "PATH_UNSAFE").when(F.col("run_id") != pending, "RUN_ORDER_VIOLATION")
        .when(~(F.col("model_id").eqNullSafe(F.col("slot_model")) & F.col("effort").eqNullSafe(F.col("slot_effort"))), "RUN_IDENTITY_MISMATCH")
        .when(~F.coalesce(F.col("latency_seconds").between(0, LATENCY_MOST), F.lit(False)) | visible_output(F.col("text")).isNull(), "HUMAN_INPUT_INVALID")
    )
    return runs.join(frozen, "run_id", "left").withColumn("error_code", code).drop("slot_model", "slot_effort")


def invalidation_errors(requests: DataFrame, states: DataFrame, earlier: DataFrame) -> DataFrame:
    """Requests (run_id, reason) with error_code: a reason, a completed run, and no earlier replacement."""
    n = earlier.agg(F.count("*").alias("earlier"))
    reason = F.trim("reason")
    code = (
        F.when(~valid_run(F.col("run_id")), "PATH_UNSAFE").when((F.coalesce(reason, F.lit("")) == "") | (F.length("reason") > REASON_MOST), "HUMAN_INPUT_INVALID")
        .when(F.col("earlier") >= REPLACEMENTS, "MORE_THAN_ONE_INVALID_REPLACEMENT").when(~F.col("state").eqNullSafe("completed"), "RUN_NOT_COMPLETE")
    )
    return requests.join(states.select("run_id", "state"), "run_id", "left").crossJoin(F.broadcast(n)).withColumn("error_code", code).select("run_id", "reason", "error_code")  # n is one row


def chain_errors(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(name, expected, actual) of the digests that changed. Both: (name, digest)."""
    s, r = stored.alias("s"), recomputed.alias("r")
    return s.join(r, F.col("s.name") == F.col("r.name"), "full").where(~F.col("s.digest").eqNullSafe(F.col("r.digest"))).select(F.coalesce("s.name", "r.name").alias("name"), F.col("s.digest").alias("expected"), F.col("r.digest").alias("actual"))


def evidence(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, bytes, sha256, missing) of expected paths, each once, by path. found: (path, bytes, sha256)."""
    return expected.select("path").distinct().join(found, "path", "left").select("path", "bytes", "sha256", F.col("sha256").isNull().alias("missing")).orderBy("path")


def isolated(results: list[tuple[str, int | None, int | None, str | None]], spark) -> DataFrame:
    """Per-source outcomes (source, created, unchanged, error) as a table: one failing source stops no other."""
    return spark.createDataFrame(results, "source string, created long, unchanged long, error string")


def failures(outcomes: DataFrame) -> DataFrame:
    """One row (created, unchanged, failed, error_code)."""
    one = outcomes.agg(F.coalesce(F.sum("created"), F.lit(0)).alias("created"), F.coalesce(F.sum("unchanged"), F.lit(0)).alias("unchanged"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return one.withColumn("error_code", F.when(F.col("failed") > 0, "E_LIVE_HARVEST"))
