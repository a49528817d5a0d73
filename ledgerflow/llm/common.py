"""What several corpus operators share: table access, cutting lineage, group keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.session import clear_cuts, cut, cuts_dir, shared_dir, table

__all__ = ["clear_cuts", "cut", "cuts_dir", "partitions", "restored", "set_aside", "shared_dir", "slices", "table", "text_key", "views"]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows: what Python makes of the texts stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def views(column: pa.ChunkedArray, dtype: str) -> list[np.ndarray]:
    """The rows of a binary column without nulls as arrays over its memory: nothing is copied row by row."""
    if not len(column):
        return []
    c = column.combine_chunks()
    ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].tolist()
    data = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] is not None else np.zeros(0, np.uint8)
    return [data[a:b].view(dtype) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: Column) -> list[Column]:
    """Columns that are equal for equal texts: 64 + 32 hash bits and the length in bytes."""
    data = F.coalesce(text, F.lit(""))
    return [F.xxhash64(data).alias("text_h"), F.crc32(data).alias("text_crc32"), F.octet_length(data).cast("long").alias("text_bytes")]


def set_aside(df: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """The rows with all columns under names _0, _1, … and copies of those needed under their own, so that names which an
    operator adds cannot clash with the input's; and the new names in the order of the old."""
    names = [f"_{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    return plain.select(*names, *[F.col(names[df.columns.index(c)]).alias(c) for c in needed]), names


def restored(df: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """The columns set aside, under their old names."""
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)])
