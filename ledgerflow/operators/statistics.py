"""Exact order statistics of groups of any size.

Values are counted by group and value, so equal ones are one row. The counted rows are sorted over all partitions by range,
every range's total is summed per group, and the one or two middle values are looked up in the ranges that hold them. No
task sees more than a range, however many rows or distinct values one group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.session import cut

#: All kinds of numbers are ordered as this.
NUMBER = "decimal(38,18)"


def fraction_digits(shown: Column) -> Column:
    """Digits after the point of a number as it is printed."""
    return F.coalesce(F.length(F.regexp_extract(shown, r"\A[+-]?[0-9]*\.([0-9]*)\z", 1)), F.lit(0))


def fixed(value: Column, digits: Column) -> Column:
    """A decimal printed with so many digits after the point; the digits it has beyond are zeros."""
    parts = F.split(value.cast("string"), r"\.")
    whole, rest = F.get(parts, F.lit(0)), F.rpad(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), 20, "0")
    return F.when(digits > 0, F.concat(whole, F.lit("."), F.substring(rest, F.lit(1), digits))).otherwise(whole)


def half_text(low: Column, high: Column, low_text: Column, high_text: Column) -> Column:
    """The mean of two decimals, printed: with the digits of the more exact one, and one more if it needs that."""
    digits = F.greatest(fraction_digits(low_text), fraction_digits(high_text))
    mean = ((low + high) / 2).cast(NUMBER)
    more = fixed(mean, digits + 1)
    return F.when(more.endswith("0"), fixed(mean, digits)).otherwise(more)


def order_statistics(rows: DataFrame, by: str, columns: list[str], order: str | None = None) -> DataFrame:
    """(by, metric, n, low, high, median, low_text, high_text, median_text): a row for each group and column.

    Values that are null, or that a decimal(38,18) cannot hold, do not count. Texts are the values as given: a column of
    texts is printed as it was, so "20" stays "20" and "4.50" stays "4.50". Of equal values printed differently the first in
    `order` counts, without one the smallest text. The mean of two middle values has as many digits as it needs.
    """
    first = F.col(order).cast("string") if order else F.lit("")
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.expr(f"try_cast(`{c}` as {NUMBER})").alias("value"), F.trim(F.col(c).cast("string")).alias("shown")) for c in columns])
    flat = rows.select(F.col(by).alias("by"), first.alias("first"), F.explode(entries).alias("e")).select("by", "first", "e.*").where("value is not null")
    key = ["by", "metric"]
    counts = cut(flat.groupBy(*key, "value").agg(F.count("*").alias("n"), F.min(F.struct("first", "shown")).alias("t")).select(*key, "value", "n", "t.shown"))
    sorted_ = cut(counts.repartitionByRange(*key, "value").withColumn("range", F.spark_partition_id()))
    totals = sorted_.groupBy(*key, "range").agg(F.sum("n").alias("m"))
    per_key = Window.partitionBy(*key)
    before = totals.select(*key, "range", "m", F.sum("m").over(per_key).alias("total"), (F.sum("m").over(per_key.orderBy("range")) - F.col("m")).alias("before"))
    wanted = F.array_distinct(F.array(((F.col("total") + 1) / 2).cast("long"), (F.col("total") / 2).cast("long") + 1))
    spots = before.where(F.exists(wanted, lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("m")))).withColumn("wanted", wanted)

    s, p = sorted_.alias("s"), spots.alias("p")
    same = F.col("s.by").eqNullSafe(F.col("p.by")) & (F.col("s.metric") == F.col("p.metric")) & (F.col("s.range") == F.col("p.range"))
    held = s.join(p, same).select("s.by", "s.metric", "s.range", "s.value", "s.n", "s.shown", "p.total", "p.before", "p.wanted")
    through = F.col("before") + F.sum("n").over(Window.partitionBy(*key, "range").orderBy("value"))
    middle = held.withColumn("through", through).where(F.exists("wanted", lambda r: (r > F.col("through") - F.col("n")) & (r <= F.col("through"))))
    middle = middle.groupBy(*key).agg(F.min("value").alias("a"), F.max("value").alias("b"), F.min_by("shown", "value").alias("x"), F.max_by("shown", "value").alias("y"), F.any_value("total").alias("n"))
    ends = counts.groupBy(*key).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("shown", "value").alias("low_text"), F.max_by("shown", "value").alias("high_text"))
    m, e = middle.alias("m"), ends.alias("e")
    joined = m.join(e, F.col("m.by").eqNullSafe(F.col("e.by")) & (F.col("m.metric") == F.col("e.metric")))
    median_text = F.when((F.col("n") % 2 == 1) | ((F.col("a") == F.col("b")) & (F.col("x") == F.col("y"))), F.col("x")).otherwise(half_text(F.col("a"), F.col("b"), F.col("x"), F.col("y")))
    return joined.select(F.col("m.by").alias(by), "m.metric", "n", "low", "high", ((F.col("a") + F.col("b")) / 2).cast(NUMBER).alias("median"), "low_text", "high_text", median_text.alias("median_text"))


def with_order_statistics(summary: DataFrame, rows: DataFrame, by: str, columns: list[str], order: str | None = None) -> DataFrame:
    """The summary (by, …) with median_, median_text_ and range_ of each column."""
    found = order_statistics(rows, by, columns, order)
    picked = lambda metric, c: F.max(F.when(F.col("metric") == metric, F.col(c)))
    wide = found.withColumn("range", F.concat("low_text", F.lit("-"), "high_text")).groupBy(F.col(by).alias("_by"))
    wide = wide.agg(*[picked(c, kind).alias(f"{name}_{c}") for c in columns for kind, name in (("median", "median"), ("median_text", "median_text"), ("range", "range"))])
    return summary.join(wide, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
