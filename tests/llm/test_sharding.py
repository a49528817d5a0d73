import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerflow.llm import sharding

from .helpers import EDGES, docs


def check(spark, rows, shards):
    got = sharding.shard_by_bytes(docs(spark, rows), shards).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots, load = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return got, [load[s] for s in range(shards)]


def test_balance_and_whole_groups(spark):
    rows = [(i, f"text number {i % 700} " * (1 + i % 13)) for i in range(3000)]
    got, load = check(spark, rows, 8)
    assert max(load) < 1.02 * sum(load) / 8 and min(load) > 0.98 * sum(load) / 8
    text = dict(rows)
    at = defaultdict(set)
    for r in got:
        at[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in at.values())


def test_a_group_with_most_rows_is_divided(spark):
    rows = [(i, "the same text" if i % 3 else f"own {i}") for i in range(2000)]
    _, load = check(spark, rows, 10)
    assert max(load) < 1.05 * sum(load) / 10


@pytest.mark.parametrize("rows", [EDGES, EDGES[:1], [], [(1, "a")] * 50])
def test_edges(spark, rows):
    check(spark, rows, 4)


def test_plan_covers_every_row():
    parts, loads = sharding.plan_large([(1, 1, 10, 95), (2, 2, 300, 1), (3, 3, 7, 3)], 250.0, 5)
    rows = defaultdict(list)
    for p in parts:
        rows[p["text_h"]] += range(p["first"], p["end"])
    assert {k: sorted(v) for k, v in rows.items()} == {1: list(range(95)), 2: [0], 3: [0, 1, 2]} and sum(loads) == 950 + 300 + 21


def brute(rows, shards):
    """The shard of each text by a running sum over all groups in one list; None for groups that are divided."""
    groups = Counter(t or "" for _, t in rows)
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if h >> 63 else 0)
    size = {t: len(t.encode()) + 16 for t in groups}
    key = {t: (signed(t), zlib.crc32(t.encode()), size[t]) for t in groups}
    target = sum(size[t] * n for t, n in groups.items()) / shards
    large = [t for t, n in groups.items() if n * size[t] >= target * sharding.SHARE]
    parts, loads = sharding.plan_large([(*key[t], groups[t]) for t in large], target, shards)
    out = {t: None for t in large}
    for p in parts:
        t = next(t for t in large if key[t] == (p["text_h"], p["text_crc32"], p["size"]))
        if p["end"] - p["first"] == groups[t]:
            out[t] = p["shard"]
    n = sharding.ranges(len(rows))
    at, done, ends = 0, 0, []
    for load in loads:
        at += max(target - load, 0.0)
        ends.append(at)
    for t in sorted(set(groups) - set(large), key=lambda t: (((key[t][0] % (1 << 64)) >> 20) % n, *key[t])):
        done += size[t] * groups[t]
        out[t] = sum(e <= done - 0.5 for e in ends[:-1])
    return out


@pytest.mark.parametrize("shards", [1, 4, 9])
def test_against_brute_force(spark, shards):
    rows = [(i, f"text {i % 1400} " * (1 + i % 11)) for i in range(4000)] + [(None, "no id")] * 300 + [(5, f"own {i}") for i in range(300)] + [(i, None) for i in range(40)] + EDGES
    want = brute(rows, shards)
    text = {(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())): t or "" for _, t in rows}
    got, _ = check(spark, rows, shards)
    assert sum(v is not None for v in want.values()) > 1000
    for r in got:
        shard = want[text[r.size, r.text_crc32]]
        assert shard is None or r.shard == shard


def test_a_hundred_thousand_equal_rows(spark):
    """They have no id and no text; they fill their part of each shard."""
    rows = spark.range(100_000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text")
    got = {r.shard: (r.n, r.top) for r in sharding.shard_by_bytes(rows, 7).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()}
    assert len(got) == 7 and all(top == n - 1 and abs(n - 100_000 / 7) <= 7 for n, top in got.values())
