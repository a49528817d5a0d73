"""Blind evaluations: input checks, blinding, joins of human and run data, metrics by model, an ordered verdict."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import text
from ledgerflow.operators import statistics
from ledgerflow.schemas import SCORES

# Labels of outputs, their runs in order and the models of the runs.
OUTPUTS = tuple("ABCDEF")
RUNS = tuple(f"run_{i:02d}" for i in range(1, 7))
RUNS_EACH = 3


def total_score() -> Column:
    out = F.lit(0)
    for name in SCORES:
        out = out + F.col(name)
    return out


def score_errors(scores: DataFrame, ranges: dict[str, int] = SCORES) -> DataFrame:
    """Rows with total_score and `error`: the first broken rule of a score row, or null."""
    error = None
    for name, most in ranges.items():
        bad = ~F.coalesce(F.col(name).between(0, most), F.lit(False))
        error = F.when(bad, F.lit(name)) if error is None else error.when(bad, F.lit(name))
    notes = F.coalesce(F.trim("critical_error_notes"), F.lit(""))
    error = error.when(~F.coalesce(F.col("critical_error_count") >= 0, F.lit(False)), "critical_error_count").when((F.col("critical_error_count") > 0) & (notes == ""), "critical_error_notes").when(~F.coalesce(F.col("review_complete"), F.lit(False)), "review_complete")
    total = F.lit(0)
    for name in ranges:
        total = total + F.col(name)
    return scores.withColumn("total_score", total).withColumn("error", error)


def strict_bool(x: Column) -> Column:
    """true and false as written so, else null."""
    return F.when(x == "true", True).when(x == "false", False)


def correction_errors(rows: DataFrame) -> DataFrame:
    """Correction rows (texts) with minutes as a decimal and as given (minutes_text), accepted as a boolean, and `error`."""
    minutes = F.expr("try_cast(minutes as decimal(38,18))")
    accepted, timer = strict_bool(F.col("accepted")), strict_bool(F.col("timer_complete"))
    noted = F.lit(False)
    for c in ("critical_fixes", "major_additions", "minor_edits", "notes"):
        noted = noted | (F.coalesce(F.trim(c), F.lit("")) != "")
    error = F.when(minutes.isNull() | ~minutes.between(0, 20), "minutes").when(accepted.isNull(), "accepted").when(~accepted & ~noted, "notes").when(~F.coalesce(timer, F.lit(False)), "timer_complete")
    return rows.withColumn("error", error).withColumns({"minutes": minutes, "minutes_text": F.trim("minutes"), "accepted": accepted})


def leaks(x: Column, aliases: list[str]) -> Column:
    """Whether human input names a model."""
    return x.rlike(rf"(?iU)\b(?:{'|'.join(aliases)})\b")


def event_log_checks(events: DataFrame, ids: str = "event_id", leads: str = "external_lead_id", least_rows: int = 24, n_leads: int = 10) -> DataFrame:
    """One row of whole-table assertions on an event log."""
    return events.agg(
        F.count("*").alias("n_rows"), F.count_distinct(ids).alias("n_ids"), F.count_distinct(leads).alias("n_leads"),
        ((F.count("*") >= least_rows) & (F.count("*") == F.count_distinct(ids)) & (F.count_distinct(leads) == n_leads)).alias("valid"),
    )


def blind_order(seed: int | str, runs: tuple[str, ...] = RUNS) -> list[tuple[str, str]]:
    """(output label, run): a seeded permutation of the six runs, made on the driver."""
    shuffled = list(runs)
    random.Random(seed).shuffle(shuffled)
    return list(zip(OUTPUTS, shuffled, strict=True))


def blinded(outputs: DataFrame, identities: list[str], aliases: list[str], column: str = "text") -> DataFrame:
    """Outputs with blind_text, redaction_count, source_sha256, and whether an identity is left."""
    redacted, removed = text.redact(F.col(column), identities, aliases)
    out = outputs.withColumns({"blind_text": redacted, "redaction_count": removed, "source_sha256": F.sha2(F.col(column), 256)})
    return out.withColumn("residue", text.residue(F.col("blind_text"), identities, aliases))


def mapping_mismatches(actual: DataFrame, expected: DataFrame, columns: list[str], key: str = "output_id") -> DataFrame:
    """Keys that one side lacks or whose rows differ."""
    a, e = actual.alias("a"), expected.alias("e")
    joined = a.join(e, F.col(f"a.{key}") == F.col(f"e.{key}"), "full")
    bad = F.lit(False)
    for c in [key, *columns]:
        bad = bad | ~F.col(f"a.{c}").eqNullSafe(F.col(f"e.{c}"))
    return joined.where(bad).select(F.coalesce(f"a.{key}", f"e.{key}").alias(key))


def cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column, cached: Column) -> Column:
    """Price of a run at rates for a million tokens; null unless both counts are known and nothing was cached."""
    known = tokens_in.isNotNull() & tokens_out.isNotNull() & (F.coalesce(cached, F.lit(0)) == 0)
    return F.when(known, ((tokens_in * rate_in + tokens_out * rate_out) / F.lit(1_000_000)).cast("decimal(38,12)"))


def all_or_null(x: str, kind: str = "long") -> Column:
    """The sum, null if a value is null."""
    return F.when(F.bool_and(F.col(x).isNotNull()), F.sum(x)).cast(kind)


def joined_runs(mapping: DataFrame, scores: DataFrame, corrections: DataFrame, metadata: DataFrame) -> DataFrame:
    """A row for each output: who made it, how it was scored and corrected, how it ran."""
    return mapping.join(scores, "output_id").join(corrections, "output_id").join(metadata, "run_id")


def metrics(runs: DataFrame, by: str = "model_key") -> DataFrame:
    """A row for each model. Medians are exact; ranges, and median_correction_text, print the values as they were given: minutes
    from minutes_text if the runs have it, in the order of output_id if they have that."""
    minutes = "minutes_text" if "minutes_text" in runs.columns else "minutes"
    summary = runs.groupBy(by).agg(
        F.count("*").alias("n"), F.sum("critical_error_count").alias("critical_error_total"), F.count_if(F.col("critical_error_count") > 0).alias("outputs_with_critical_errors"), F.count_if("accepted").alias("accepted_within_20"),
        F.bool_and("cost_available").alias("direct_cost_available"), F.when(F.bool_and("cost_available"), F.sum("direct_cost_usd")).alias("direct_cost_total_usd"),
        all_or_null("input_tokens").alias("input_tokens_total"), all_or_null("output_tokens").alias("output_tokens_total"),
    )
    joined = statistics.with_order_statistics(summary, runs, by, ["total_score", minutes, "latency_seconds"], "output_id" if "output_id" in runs.columns else None)
    return joined.select(
        by, "n", F.col("median_total_score").cast("double").alias("median_score"), F.col("range_total_score").alias("score_range"), "critical_error_total", "outputs_with_critical_errors",
        F.col(f"median_{minutes}").alias("median_correction_minutes"), F.col(f"median_text_{minutes}").alias("median_correction_text"), F.col(f"range_{minutes}").alias("correction_range"), "accepted_within_20",
        F.col("median_latency_seconds").cast("double").alias("median_latency_seconds"), F.col("range_latency_seconds").alias("latency_range"), "direct_cost_available", "direct_cost_total_usd", "input_tokens_total", "output_tokens_total",
    )


def verdict_case(score: Column, critical: Column, correction: Column, accepted: Column, first: str, second: str) -> Column:
    """The ordered rules; arguments are the first model's values less the second's."""
    return (
        F.when((score >= 1) & (critical <= 0) & (correction <= 5), first).when((score <= -1) & (critical >= 0) & (correction >= -5), second)
        .when((critical <= -2) & (score >= -1.5), first).when((critical >= 2) & (score <= 1.5), second)
        .when((accepted >= 2) & (critical <= 0), first).when((accepted <= -2) & (critical >= 0), second).otherwise("MIXED")
    )


def verdict(by_model: DataFrame, first: str, second: str, by: str = "model_key") -> DataFrame:
    """One row: the verdict for two models, INCONCLUSIVE unless there are just these two with three runs each."""
    names = ("median_score", "critical_error_total", "median_correction_minutes", "accepted_within_20")
    pick = lambda c, m: F.max(F.when(F.col(by) == m, F.col(c)))
    deltas = [(pick(c, first) - pick(c, second)).alias(c) for c in names]
    complete = (F.count("*") == 2) & (F.count_if(F.col(by).isin(first, second) & (F.col("n") == RUNS_EACH)) == 2)
    one = by_model.agg(complete.alias("complete"), *deltas)
    rules = verdict_case(*[F.col(c) for c in names], first.upper(), second.upper())
    return one.select(F.when(F.col("complete"), rules).otherwise("INCONCLUSIVE").alias("verdict"))


def next_pending(slots: DataFrame) -> Column:
    """Of slots (position, completed): the position of the first that is not completed, as an aggregate."""
    return F.min(F.when(~F.col("completed"), F.col("position")))


def next_action(completed: Column, pending: Column, blind: Column, human: Column, analyzed: Column, wanted: int = 6) -> Column:
    return (
        F.when(completed < wanted, F.concat(F.lit("execute or import "), pending)).when(~blind, "run blind")
        .when(~human, "complete scores.csv and correction_log.csv, then validate-human-input").when(~analyzed, "run analyze").otherwise("run evidence-manifest and complete owner QA")
    )


def inventory_diff(expected: DataFrame, actual: DataFrame, key: str = "name") -> DataFrame:
    """(key, state): missing, extra, changed or same, by hash."""
    a, e = actual.select(key, F.col("sha256").alias("actual")), expected.select(key, F.col("sha256").alias("expected"))
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("actual") != F.col("expected"), "changed").otherwise("same")
    return e.join(a, key, "full").select(key, state.alias("state"))
