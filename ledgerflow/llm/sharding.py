"""Contiguous shards of near-equal bytes from global prefix sums. DataFrame functions only.

Rows are put in one global order and cut where the running byte count passes equal targets. The running count comes from
totals of key ranges and a running sum within each, so no task sees more than its range. Equal texts stay in one shard.
For that, groups of equal texts that weigh at least SHARE of a shard come first in their shard; there are at most
shards / SHARE of them, whatever the input, so they are planned one by one. A group heavier than a shard is the only kind
that is divided, by the rank of its rows. All lighter groups follow in the order of their text's hash and fill what is
left of each shard's target. Prefix sums run over groups, not rows; where each shard's groups begin is then one key a shard,
and every row finds its shard by comparing its own key with these.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.llm.common import cut, text_key

SHARDS = 40
OVERHEAD = 16
SHARE = 0.01
ROWS_A_RANGE = 200_000
_BEFORE = (Window.unboundedPreceding, -1)


def ranges(rows: int) -> int:
    """Key ranges: about ROWS_A_RANGE rows each, at least 256."""
    return max(256, -(-rows // ROWS_A_RANGE))


def plan_large(groups: list[tuple[int, int, int, int]], target: float, shards: int) -> tuple[list[dict], list[float]]:
    """Parts of large groups with their shards, heaviest first to the lightest shard; and each shard's bytes so far.

    groups: (text_h, text_crc32, size, n). A group over the target is divided into parts of whole rows of a shard each.
    """
    loads = [(0.0, s) for s in range(shards)]
    parts = []
    for h, crc, size, n in groups:
        most = max(1, int(target // size)) if n * size > target else n
        parts += [(min(most, n - i) * size, h, crc, size, i, min(n, i + most)) for i in range(0, n, most)]
    out = []
    for weight, h, crc, size, first, end in sorted(parts, key=lambda p: (-p[0], p[1:])):
        load, s = heapq.heappop(loads)
        heapq.heappush(loads, (load + weight, s))
        out.append({"text_h": h, "text_crc32": crc, "size": size, "first": first, "end": end, "shard": s})
    by_shard = dict((s, load) for load, s in loads)
    return out, [by_shard[s] for s in range(shards)]


def _inline(spark, rows: list[dict], schema: str) -> DataFrame:
    """A bounded list of rows as a table that the JVM makes."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    size: the text's UTF-8 bytes plus OVERHEAD; a null text has none, and is equal to an empty one in text_crc32 and as a
    group. Null and repeated ids are kept, a row each. Slots are gapless within a shard. grown_shard is null under this
    law. No rows give no rows. Rows are spread over cells by their number, so neither an id nor a text that many share is
    ranked by one task.
    """
    spark = docs.sparkSession
    rows = cut(docs.select(F.col("doc_id").cast("long"), (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"), *text_key(F.col("text"))[:2], F.monotonically_increasing_id().alias("number")))
    key = ["text_h", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    target = (total or 1) / shards
    n_ranges = ranges(count)
    groups = cut(groups.withColumn("weight", F.col("n") * F.col("size")))
    large = groups.where(F.col("weight") >= target * SHARE).select(*key, "n").collect()  # at most shards / SHARE
    parts, loads = plan_large([tuple(r) for r in large], target, shards)

    wholes, divided = [], []
    sizes = {tuple(r[:3]): r[3] for r in large}
    for p in parts:
        whole = p["end"] - p["first"] == sizes[p["text_h"], p["text_crc32"], p["size"]]
        (wholes if whole else divided).append(p)
    by_group: dict[tuple, list[dict]] = {}
    for p in sorted(divided, key=lambda p: p["first"]):
        by_group.setdefault((p["text_h"], p["text_crc32"], p["size"]), []).append({"end": p["end"], "shard": p["shard"]})
    planned = [{k: p[k] for k in key} | {"own": p["shard"], "runs": []} for p in wholes] + [dict(zip(key, k, strict=True)) | {"own": None, "runs": v} for k, v in by_group.items()]
    plan = F.broadcast(_inline(spark, planned, "text_h bigint, text_crc32 bigint, size bigint, own int, runs array<struct<end: bigint, shard: int>>"))

    # light groups: running bytes = total of the ranges before + running sum in the range, through the group
    room, capacity = 0.0, []
    for load in loads:
        room += max(target - load, 0.0)
        capacity.append(room)
    spot = F.pmod(F.shiftrightunsigned("text_h", 20), F.lit(n_ranges))
    light = groups.where(F.col("weight") < target * SHARE).withColumn("range", spot)
    totals = light.groupBy("range").agg(F.sum("weight").alias("bytes"))
    before = totals.select("range", F.coalesce(F.sum("bytes").over(Window.orderBy("range").rowsBetween(*_BEFORE)), F.lit(0)).alias("before"))
    through = F.sum("weight").over(Window.partitionBy("range").orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = F.lit(capacity[:-1] or [float("inf")])
    place = light.withColumn("through", through).join(before, "range").select(*key, "range", F.size(F.filter(cuts, lambda c: c <= F.col("before") + F.col("through") - 0.5)).cast("int").alias("shard"))
    begins = place.groupBy("shard").agg(F.min(F.struct("range", *key)).alias("k")).select("k.*", "shard").collect()  # a row for each shard
    bounds = [r.asDict() for r in sorted(begins, key=lambda r: r["shard"])]
    known = F.from_json(F.lit(json.dumps(bounds)), "array<struct<range: bigint, text_h: bigint, text_crc32: bigint, size: bigint, shard: int>>")
    own_key = F.struct(spot.cast("long").alias("range"), *key)
    begun = F.filter(known, lambda b: F.struct(b["range"].alias("range"), *[b[k].alias(k) for k in key]) <= own_key)

    marked = rows.join(plan, key, "left").withColumn("cell", F.pmod(F.xxhash64("number"), F.lit(n_ranges)))
    columns = ["doc_id", "size", "text_crc32", "number", "cell", "shard"]
    direct = marked.where(F.col("own").isNotNull() | F.col("runs").isNull()).withColumn("shard", F.coalesce("own", F.try_element_at(begun, F.lit(-1))["shard"]))

    # rows of divided groups by their rank
    over = marked.where(F.col("own").isNull() & F.col("runs").isNotNull())
    counts = over.groupBy(*key, "cell").agg(F.count("*").alias("n"))
    ahead = counts.select(*key, "cell", F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("cell").rowsBetween(*_BEFORE)), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy(*key, "cell").orderBy("number")) + F.col("ahead")
    over = over.join(ahead, [*key, "cell"]).withColumn("rank", rank).withColumn("shard", F.filter("runs", lambda r: r["end"] >= F.col("rank"))[0]["shard"])

    placed = cut(direct.select(*columns).unionByName(over.select(*columns)))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    ahead = counts.select("shard", "cell", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(*_BEFORE)), F.lit(0)).alias("ahead"))
    slot = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("number")) - 1 + F.col("ahead")
    return placed.join(ahead, ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
