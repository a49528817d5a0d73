"""Mixing sources to target weights: iterative proportional fitting, then sampling. DataFrame functions only.

Tokens are summed by cell (source, language, topic). Raking multiplies each cell by the factor that brings one margin at
a time to its target, over and over; a cell's product of factors is the probability to keep each of its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.llm.common import cut, restored, set_aside

DIMENSIONS = ("source", "lang", "topic")
#: Without given targets a margin's target is its observed share to this power, made to sum to 1: 1 keeps, 0 levels.
FLATTEN = {"source": 0.6, "lang": 0.85, "topic": 0.9}
RATE = 0.6
ROUNDS, ROUNDS_A_JOB = 12, 4
SEED = 11
MOST_BROADCAST_CELLS = MOST_SINGLE_CELLS = 100_000
NONE = ""


def _without(text: Column, chars: str) -> Column:
    """The text without these characters; a search for bytes, many times faster than translate()."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def tokens_of(text: Column) -> Column:
    """Blank-separated tokens, at least 1 for a text that is not empty; null and empty texts have none."""
    gaps = F.octet_length(text) - F.octet_length(_without(text, " \n"))
    return F.when(F.length(text) > 0, gaps + 1).otherwise(0).cast("long")


def topic_of(text: Column) -> Column:
    """The form of a text, as its topic: table, symbols, shouting, note, article, long, or empty."""
    n = F.length(text)

    def share(rest: Column) -> Column:
        return (n - F.length(rest)) / n

    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty")
        .when(share(_without(text, "|")) > 0.03, "table")
        .when(share(_without(text, "*#$%&")) > 0.05, "symbols")
        .when(share(F.regexp_replace(text, "[A-Z]+", "")) > 0.3, "shouting")
        .when(n < 600, "note")
        .when(n < 5000, "article")
        .otherwise("long")
    )


def weighed(docs: DataFrame) -> DataFrame:
    """The documents with tokens, topic and the dimensions' keys (null: empty)."""
    keyed = docs.withColumns({"_tokens": tokens_of(F.col("text")), "_topic": topic_of(F.col("text"))})
    return keyed.withColumns({"_source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)), "_lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE))})


def _margin(cells: DataFrame, dim: str, given: dict[str, float] | None) -> DataFrame:
    """(dim, target): shares that sum to 1 over the values that have tokens."""
    seen = cells.groupBy(dim).agg(F.sum("w").alias("s"))
    if given is not None:
        want = F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, float(v))])
        seen = seen.withColumn("t", F.coalesce(want[F.col(dim)], F.lit(0.0)))
    else:
        seen = seen.withColumn("t", F.pow(F.col("s"), F.lit(FLATTEN[dim])))
    whole = seen.agg(F.sum("t").alias("whole"))
    return seen.crossJoin(F.broadcast(whole)).select(dim, (F.col("t") / F.col("whole")).alias("target"))  # one row


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE, rounds: int = ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, tokens) with probability p, so that tokens * p has the target margins of rate * tokens.

    A probability stops at 1, and later steps then raise the cells that still can grow. A margin whose target is above
    what its cells hold stays below it; residuals() tells by how much. Up to MOST_SINGLE_CELLS cells are raked by one task in
    few jobs, in which a margin's totals are window sums; more are grouped and joined, a round at a time.
    """
    targets = targets or {}
    base = cut(cells.withColumn("w", F.col("tokens").cast("double")).where("w > 0"))
    n, whole = base.agg(F.count("*"), F.sum("w")).first()
    goal = rate * (whole or 0.0)
    fitted = base.withColumn("p", F.lit(float(rate)))
    for d in DIMENSIONS:
        fitted = fitted.join(_margin(base, d, targets.get(d)).withColumnRenamed("target", f"t_{d}"), d)
    single = n <= MOST_SINGLE_CELLS
    fitted = cut(fitted).coalesce(1) if single else cut(fitted)
    rest = [*DIMENSIONS, "tokens", "w", *[f"t_{d}" for d in DIMENSIONS]]
    for i in range(rounds):
        for d in DIMENSIONS:
            now = F.sum(F.col("w") * F.col("p"))
            if single:
                now = now.over(Window.partitionBy(d))
            else:
                fitted, now = fitted.join(fitted.groupBy(d).agg(now.alias("now")), d), F.col("now")
            step = F.when(now > 0, F.col(f"t_{d}") * goal / now).otherwise(0.0)
            fitted = fitted.select(*rest, F.least(F.lit(1.0), F.col("p") * step).alias("p"))
        if not single or (i + 1) % ROUNDS_A_JOB == 0:
            fitted = cut(fitted).coalesce(1) if single else cut(fitted)
    return cut(fitted.select(*DIMENSIONS, "tokens", "w", "p"))


def residuals(fitted: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(dimension, value, target, share): of each margin's values the share of tokens wanted and that which the probabilities
    give. fitted: what rake() gives."""
    targets = targets or {}
    whole = fitted.agg(F.sum(F.col("w") * F.col("p")).alias("whole"))
    out = None
    for d in DIMENSIONS:
        got = fitted.groupBy(d).agg(F.sum(F.col("w") * F.col("p")).alias("got")).join(_margin(fitted, d, targets.get(d)), d).crossJoin(F.broadcast(whole))  # one row
        got = got.select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "target", (F.col("got") / F.col("whole")).alias("share"))
        out = got if out is None else out.union(got)
    return out


def uniform(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the id only; without an id, on the text."""
    own = F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(NONE))
    digest = F.md5(F.concat(own, F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _chances(rows: DataFrame, targets: dict[str, dict[str, float]] | None, rate: float) -> DataFrame:
    """The rows of weighed() with _p."""
    keys = {"_source": "source", "_lang": "lang", "_topic": "topic"}
    cells = rows.groupBy(*[F.col(k).alias(v) for k, v in keys.items()]).agg(F.sum("_tokens").alias("tokens"))
    chances = rake(cells, targets, rate).select(*[F.col(v).alias(k) for k, v in keys.items()], F.col("p").alias("_p"))
    small = chances.limit(MOST_BROADCAST_CELLS + 1).count() <= MOST_BROADCAST_CELLS  # else the join shuffles
    return rows.join(F.broadcast(chances) if small else chances, list(keys), "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE) -> DataFrame:
    """Every document with _tokens, _topic, _p (its probability) and _kept (whether it is sampled).

    Null or empty texts have no tokens, so no margin depends on them: they have probability 0. Null sources or languages
    are a value of their own. Rows with equal ids are kept or dropped together if their cells agree; rows without an id are drawn
    by their texts. Columns of the input stay as they are, but for those with one of the four names. No rows give no rows.
    """
    plain, names = set_aside(docs, "doc_id", "text", "source", "lang")
    joined = _chances(weighed(plain), targets, rate)
    own = {"_tokens": F.col("_tokens"), "_topic": F.col("_topic"), "_p": F.col("_p"), "_kept": uniform(F.col("doc_id"), F.col("text")) < F.col("_p")}
    back = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in own]
    return joined.select(*back, *[c.alias(k) for k, c in own.items()])


def decisions(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE) -> DataFrame:
    """What mix() decides, without the texts: (doc_id, source, lang, topic, tokens, probability, kept). Each text is read once."""
    rows = weighed(docs.select("doc_id", "text", "source", "lang"))
    small = cut(rows.select("doc_id", "source", "lang", "_source", "_lang", "_topic", "_tokens", uniform(F.col("doc_id"), F.col("text")).alias("_draw")))
    joined = _chances(small, targets, rate)
    return joined.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.round("_p", 6).alias("probability"), (F.col("_draw") < F.col("_p")).alias("kept"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE) -> DataFrame:
    """The sampled documents, with the input's columns."""
    plain, names = set_aside(docs, "doc_id", "text", "source", "lang")
    return restored(mix(plain, targets, rate).where("_kept"), names, docs.columns)
