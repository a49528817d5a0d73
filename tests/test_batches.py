"""Python takes long Arrow batches in parts, so that its memory does not grow with them."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerflow.functions import text
from ledgerflow.operators import timing
from ledgerflow.sources import feeds

MOST = 64


class Taken:
    """Stands for a table, and gives the function that its batches are to go through."""

    schema = StructType([StructField("k", LongType())])

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_feeds_are_parsed_in_parts():
    feed = b"<rss><channel><item><title>t</title><link>l</link></item></channel></rss>"
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(1000)]), pa.array([feed] * 999 + [None])], names=["path", "content"])
    out = list(feeds.parsed(Taken())(iter([batch])))
    assert max(b.num_rows for b in out) <= MOST and [p for b in out for p in b.column("path").to_pylist()] == [str(i) for i in range(1000)]
    assert [e for b in out for e in b.column("error").to_pylist()] == [None] * 999 + ["size"]


def test_cards_are_split_in_parts(spark):
    words = [{"word": w, "start_s": i * 0.5, "end_s": i * 0.5 + 0.5} for i, w in enumerate("a b c. d e f.".split())]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([words] * 999 + [None]), pa.array([[2, 2, 0, 2, 2, 0]] * 999 + [None], pa.list_(pa.int32()))], names=["k", "words", "ranks"])
    out = list(timing.cards(Taken(), "k")(iter([batch])))
    assert max(b.num_rows for b in out) <= MOST and [k for b in out for k in b.column("k").to_pylist()] == list(range(999))


def test_texts_are_mapped_in_parts(spark):
    rows = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("x"))
    got = rows.select("id", text.mapped(lambda v: None if v.endswith("5") else v + "!", F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [f"{i}!" if i % 7 and i % 10 != 5 else None for i in range(3000)]
