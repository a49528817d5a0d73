"""CSV, JSON, TOML and text inputs with fixed schemas, and file inventories. What is not as fixed is refused."""

from __future__ import annotations

import tomllib
from decimal import Decimal
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Refused(ValueError):
    """An input that is not as fixed; code is stable."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def read_csv(spark: SparkSession, path: str, columns: list[str], code: str = "HUMAN_INPUT_INVALID") -> DataFrame:
    """All columns as text; the header must be these names in this order."""
    head = spark.read.text(path).first()
    if head is None or head[0].removeprefix("﻿").rstrip("\r") != ",".join(columns):
        raise Refused(code, "the header is not as fixed")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", multiLine=True, escape='"').na.fill("")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def read_utf8(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(path, value, error) of whole files: not empty, strict UTF-8, at most so many bytes."""
    files = spark.read.format("binaryFile").load(path)
    good = (F.col("length") > 0) & (F.col("length") <= most)
    error = F.when(~good, "size").when(~F.is_valid_utf8(F.col("content").cast("string")), "utf-8")
    return files.select("path", F.when(error.isNull(), F.col("content").cast("string")).alias("value"), error.alias("error"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, sha256) of a folder's files, each once, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256")).dropDuplicates(["name"]).orderBy("name")


def live_sources(spark: SparkSession, toml_text: str, approved: dict[str, set[str]]) -> DataFrame:
    """The registry of live sources (name, feed_url, allowed_hosts, feed_format): exactly the approved names and hosts."""
    try:
        rows = tomllib.loads(toml_text)["sources"]
        fields = {"name", "feed_url", "allowed_hosts", "feed_format", "enabled"}
        good = all(set(r) == fields and r["enabled"] is True and r["feed_format"] in ("rss2", "atom1") and r["name"] in approved for r in rows)
        good = good and sorted(r["name"] for r in rows) == sorted(approved)
        for r in rows if good else ():
            hosts, url = r["allowed_hosts"], urlsplit(r["feed_url"])
            good = good and len(set(hosts)) == len(hosts) and all(h == h.lower() for h in hosts) and set(hosts) == approved[r["name"]]
            good = good and url.scheme == "https" and url.hostname in hosts and url.username is None and url.password is None and url.port in (None, 443)
    except (tomllib.TOMLDecodeError, KeyError, TypeError, ValueError):
        good = False
    if not good:
        raise Refused("E_SOURCE_CONFIG", "the live sources are not as approved")
    return spark.createDataFrame([(r["name"], r["feed_url"], r["allowed_hosts"], r["feed_format"]) for r in rows], "name string, feed_url string, allowed_hosts array<string>, feed_format string")


def experiment_config(toml_text: str) -> dict:
    """An experiment's settings; rates as decimals, limits within bounds."""
    try:
        raw = tomllib.loads(toml_text, parse_float=Decimal)
        models = raw["models"]
        if len(models) != 2 or any(not m["id"] for m in models.values()):
            raise KeyError("models")
        rates = {k: {x: decimal(v) for x, v in m.items() if x.endswith("per_million")} for k, m in models.items()}
        limits = raw.get("limits", {})
        if not 1 <= int(limits.get("timeout_seconds", 120)) <= 600:
            raise ValueError("timeout")
    except (tomllib.TOMLDecodeError, KeyError, TypeError, ValueError, ArithmeticError) as e:
        raise Refused("CONFIG_INVALID", str(e)) from None
    return {"models": {k: m["id"] for k, m in models.items()}, "rates": rates, **{k: v for k, v in raw.items() if k != "models"}}


def decimal(value: object) -> Decimal:
    """A decimal that is finite and not negative; booleans are none."""
    if isinstance(value, bool):
        raise ValueError("boolean")
    d = Decimal(str(value))
    if not d.is_finite() or d < 0:
        raise ValueError("negative or not finite")
    return d
