"""Filter interaction audit: what each filter removes in every order, from one subset-zeta transform per part.

Each row fails a set of filters, its mask. Rows are counted by part and mask; the zeta transform (for one filter after the
other, add the counts without it to those with it) turns the 2^k counts into the survivors of every filter subset. What a
step of an order keeps, removes and loses is then a difference between neighbouring subsets.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import cut, set_aside, text_key

BLANKS = r"[\x20\x09-\x0D]+"
#: Weights that masks are counted with.
WEIGHTS = ("n", "good", "toxic")


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII blanks."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def text_filters(text: Column) -> dict[str, Column]:
    """Failure of each filter that looks at one text (not null): A words, B distinct words, C capitals, D symbols."""
    counts = _bound(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    counted = F.col("_counts")
    return {"_counts": counts, "A": counted["n"] < 50, "B": 100 * counted["distinct"] < 65 * counted["n"], "C": 100 * capitals > 5 * F.length(text), "D": text.rlike("[#$%&*|]")}


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows by the set of filters they fail, bit 0 for A to bit 4 for E.

    E looks at all rows: a row fails it if its text has a smaller doc_id anywhere. Equal rows count each, and the smallest
    id's own repetitions do not fail. A row without an id fails no E and has no label. A null text is an empty one, a null
    source the part "". good and toxic count rows whose id has a label row that says 1. The text is read once; from there on
    rows are a few numbers, and equal ids and equal texts are added up before they are shuffled.
    """
    plain, _ = set_aside(docs, "doc_id", "text", "source")
    t = plain.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    filters = text_filters(F.col("text"))
    bits = F.lit(0)
    for i, letter in enumerate("ABCD"):
        bits = bits + F.when(filters[letter], F.lit(1 << i)).otherwise(0)
    key = ["text_h", "text_crc32", "text_bytes"]
    rows = cut(t.withColumn("_counts", filters["_counts"]).select("doc_id", "part", bits.alias("bits"), *text_key(F.col("text"))))
    same = [*key, "part", "bits"]

    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(w) for w, c in (("good", "quality"), ("toxic", "toxic"))])
    with_id = rows.where("doc_id is not null").groupBy("doc_id", *same).agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    with_id = with_id.select("doc_id", *same, "n", *[F.coalesce(w, F.lit(0)).alias(w) for w in ("good", "toxic")])
    # of each (text, part, label): its rows, its smallest id and the rows of that id
    groups = cut(with_id.groupBy(*same, "good", "toxic").agg(F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"), F.sum("n").alias("n")))
    lowest = groups.groupBy(*key).agg(F.min("low").alias("lowest"))
    counted = groups.join(lowest, key).select("part", "bits", "good", "toxic", F.when(F.col("low") == F.col("lowest"), F.col("n_low")).otherwise(0).alias("first"), "n")
    split = counted.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("bits").alias("mask"), F.col("first").alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n")))))
    without_id = rows.where("doc_id is null").groupBy("part", F.col("bits").alias("mask")).agg(F.count("*").alias("n")).select("part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "mask", "n")
    return split.unionByName(without_id).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def survivors(counts: DataFrame, filters: int) -> DataFrame:
    """(part, n, good, toxic): arrays of 2^filters; element F + 1 is what survives the filter subset F.

    counts: what masks() gives. The zeta transform sums the counts over the submasks of each mask, one filter at a time;
    the rows that fail none of F are those whose mask lies in F's complement.
    """
    full = (1 << filters) - 1
    total = lambda w, m: f"coalesce(sum({w}) filter (where mask = {m}), 0)"
    out = counts.groupBy("part").agg(*[F.expr(f"array({', '.join(total(w, m) for m in range(full + 1))})").alias(w) for w in WEIGHTS])
    for i in range(filters):
        bit = 1 << i
        out = out.selectExpr("part", *[f"transform({w}, (x, m) -> x + if(m & {bit} != 0, get({w}, m - {bit}), 0)) as {w}" for w in WEIGHTS])
    return out.select("part", *[F.reverse(w).alias(w) for w in WEIGHTS])  # complement of F = full - F


def steps(letters: str) -> list[dict]:
    """All orders of the filters, step by step: the letter's bit, and the subset applied before."""
    out = []
    for order in permutations(range(len(letters))):
        before = 0
        for i, f in enumerate(order):
            out.append({"filter_order": "".join(letters[x] for x in order), "step": i + 1, "bit": 1 << f, "before": before})
            before |= 1 << f
    return out


def audit(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), all orders.

    counts: (part, mask, n, good, toxic), a bit for each letter. No rows give no rows. shapley is the sum over all orders of
    what the step's filter removes in them: each subset that may go before counts as often as orders have it there.
    """
    k, full = len(letters), (1 << len(letters)) - 1
    table = F.from_json(F.lit(json.dumps(steps(letters))), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = survivors(counts, k).select("part", *WEIGHTS, F.inline(table))
    at = lambda w, subset: F.get(F.col(w), subset)
    bit, before = F.col("bit"), F.col("before")
    lost = lambda w, subset: at(w, subset) - at(w, subset + bit)
    orders = [factorial(bin(m).count("1")) * factorial(k - 1 - bin(m).count("1")) if m != full else 0 for m in range(full + 1)]
    shapley = F.expr(f"aggregate(transform(array({', '.join(map(str, orders))}), (c, m) -> if(m & bit = 0, c * (get(n, m) - get(n, m + bit)), 0)), 0L, (a, x) -> a + x)")
    return rows.select(
        "part", "filter_order", "step", at("n", before + bit).alias("kept"), lost("n", before).alias("removed"), (lost("n", F.lit(0)) - lost("n", before)).alias("redundant"), lost("n", full - bit).alias("unique_fails"),
        lost("good", before).alias("good_lost"), lost("toxic", before).alias("toxic_lost"), shapley.alias("shapley"),
    )
