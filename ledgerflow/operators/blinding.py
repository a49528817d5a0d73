"""Blinding of a whole table of experiments: a seeded order of each one's runs, blind texts, the private mapping, a manifest."""

from __future__ import annotations

import json
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import text
from ledgerflow.operators.experiment import OUTPUTS, RUNS, blinded
from ledgerflow.sources import sinks

# The columns of the mapping.
MAPPING = ("output_id", "run_id", "model_key", "model_id", "redaction_count", "source_sha256")


def permuted(seed: int | str, runs: tuple[str, ...] = RUNS) -> list[str]:
    """The runs in the order that the seed gives: that of Python's own shuffle, which must be the same for good."""
    out = list(runs)
    random.Random(seed).shuffle(out)
    return out


def permutation(seed: Column, runs: tuple[str, ...] = RUNS) -> Column:
    """An array of the runs in the order of each row's seed, a whole number or a text; null without one."""

    def run(seeds: pd.Series) -> pd.Series:
        whole = pd.api.types.is_numeric_dtype(seeds)
        return seeds.map(lambda s: None if pd.isna(s) else permuted(int(s) if whole else s, runs))

    return F.pandas_udf(run, "array<string>")(seed)


def blind_orders(experiments: DataFrame, runs: tuple[str, ...] = RUNS, outputs: tuple[str, ...] = OUTPUTS) -> DataFrame:
    """experiments (experiment, seed) -> (experiment, output_id, run_id): which run each blind output is."""
    labels = F.array(*[F.lit(o) for o in outputs])
    zipped = F.arrays_zip(labels.alias("output_id"), F.col("_order").alias("run_id"))
    return experiments.select("experiment", permutation(F.col("seed"), runs).alias("_order")).where("_order is not null").select("experiment", F.inline(zipped).alias("output_id", "run_id"))


def csv_field(x: Column) -> Column:
    """A value as a CSV field: in quotes if it holds a comma, a quote or a line break."""
    value = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def artifacts(experiments: DataFrame, outputs: DataFrame, models: DataFrame, identities: list[str], aliases: list[str], runs: tuple[str, ...] = RUNS, labels: tuple[str, ...] = OUTPUTS) -> DataFrame:
    """(experiment, files, error_code): each experiment's blind texts, mapping and manifest as files for an export.

    experiments (experiment, seed), outputs (experiment, run_id, text), models (run_id, model_key, model_id). An experiment that
    lacks a run, has one twice, or keeps an identity in a text gets BLINDING_FAILED and no files.
    """
    order = blind_orders(experiments, runs, labels).join(models, "run_id")
    rows = blinded(outputs.select("experiment", "run_id", "text"), identities, aliases).drop("text")
    joined = order.join(rows, ["experiment", "run_id"])
    line = F.concat(F.array_join(F.array(*[csv_field(F.col(c)) for c in MAPPING]), ","), F.lit("\n"))
    one = F.struct("output_id", line.alias("line"), F.sha2("blind_text", 256).alias("sha256"), "redaction_count", F.col("blind_text").alias("content"))
    whole = joined.groupBy("experiment").agg(F.array_sort(F.collect_list(one)).alias("o"), F.count_distinct("run_id").alias("n"), F.bool_or("residue").alias("residue"))  # a row for each run
    mapping = F.concat(F.lit(",".join(MAPPING) + "\n"), F.array_join(F.transform("o", lambda x: x["line"]), ""))
    whole = experiments.select("experiment").distinct().join(whole, "experiment", "left").withColumn("mapping", mapping)
    listed = F.transform("o", lambda x: F.struct(x["output_id"].alias("output_id"), x["redaction_count"].alias("redaction_count"), x["sha256"].alias("sha256")))
    manifest = F.to_json(F.struct(F.col("experiment").cast("string").alias("experiment_id"), F.sha2("mapping", 256).alias("mapping_sha256"), F.lit(True).alias("originals_preserved"), listed.alias("outputs"), F.lit(1).alias("schema_version")))
    shown = text.mapped(lambda x: sinks.pretty(json.loads(x)).decode(), manifest)
    good = (F.size("o") == len(runs)) & (F.col("n") == len(runs)) & ~F.col("residue")
    file = lambda name, content: F.struct(F.concat(F.col("experiment").cast("string"), F.lit("/05_blind_review/"), name).alias("name"), F.encode(content, "UTF-8").alias("content"))
    files = F.concat(F.transform("o", lambda x: file(F.concat(x["output_id"], F.lit(".md")), x["content"])), F.array(file(F.lit("blind_mapping_PRIVATE.csv"), F.col("mapping")), file(F.lit("blind_manifest.json"), F.col("_manifest"))))
    done = whole.withColumns({"_manifest": shown, "_good": F.coalesce(good, F.lit(False))})
    return done.select("experiment", F.when(F.col("_good"), files).alias("files"), F.when(~F.col("_good"), "BLINDING_FAILED").alias("error_code"))
