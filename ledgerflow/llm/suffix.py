"""Repeated passages by sparse suffix arrays.

A passage of MIN words or more that two documents share holds, in every window of WINDOW consecutive GRAM-word sequences,
the same minimiser, and so both documents retain the suffix that starts there. Retained suffixes whose first GRAM words
occur in one text only are dropped. The others are dealt out by those words and sorted; neighbours are compared, and
matches are extended to the right and to the left, by up to MIN - GRAM words each, since a longer passage has more retained
suffixes. A list of more than LONG suffixes is not compared member by member: every MIN-word window around its suffixes
is hashed and linked to the smallest document that has the window. Both ways give the same definition:

A word is repeated if it lies in a window of MIN words that also occurs in a document with another text and a smaller id.
Documents with equal texts count as one, with the smallest id; the others are repeated as a whole if they have MIN words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.llm.common import cut, partitions, set_aside, slices
from ledgerflow.llm.words import Rolling, scan

MIN, GRAM = 50, 25
WINDOW = MIN - GRAM + 1
SIDE = MIN - GRAM
LONG = 32
NO_ID = -(1 << 63)


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every `width` neighbours, by doubling."""
    pick, done = np.minimum if least else np.maximum, 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and of each GRAM words."""
    _, start, end, roll = scan((text or "").encode("utf-8", "surrogatepass"))
    if len(start) < MIN:
        return np.zeros(len(start), np.uint64), np.zeros(0, np.uint64)
    words = roll.of(start, end)
    at = np.arange(len(words) - GRAM + 1)
    return words, Rolling(words).of(at, at + GRAM)


def retained(grams: np.ndarray) -> np.ndarray:
    """Positions whose hash is the smallest of some window of WINDOW."""
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    least = _sliding(grams, WINDOW, True)
    padded = np.concatenate((np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)))
    return np.flatnonzero(_sliding(padded, WINDOW, False) == grams)


class _Lists:
    """Rows with an array of positions each, gathered text by text."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.at: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.sizes: list[np.ndarray] = [np.zeros(0, np.int64)]

    def add(self, values: np.ndarray, at: np.ndarray) -> int:
        """A row for each distinct value, with its positions; returns how many."""
        order = np.argsort(values, kind="stable")
        values = values[order]
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else order
        self.keys.append(values[first].view(np.int64))
        self.at.append(at[order].astype(np.int32))
        self.sizes.append(np.diff(np.concatenate((first, [len(values)]))))
        return len(first)

    def arrays(self) -> tuple[pa.Array, pa.Array]:
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(self.sizes)))).astype(np.int32)
        return pa.array(np.concatenate(self.keys)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(self.at)))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, t, at): a text's retained suffixes, those with the same first words in one row."""
    for batch in slices(batches):
        rows, counts = _Lists(), []
        for text in batch.column("text").to_pylist():
            _, grams = hashes(text)
            at = retained(grams)
            counts.append(rows.add(grams[at], at))
        h, at = rows.arrays()
        yield pa.RecordBatch.from_arrays([h, pa.array(np.repeat(batch.column("t").to_numpy(), counts)), at], names=["h", "t", "at"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For suffixes in short lists their two contexts; for those in long lists all windows of MIN words around them, equal
    windows of a text in one row."""
    for batch in slices(batches):
        rows, counts, left, right = _Lists(), [], [], []
        for text, spots in zip(batch.column("text").to_pylist(), batch.column("spots").to_pylist(), strict=True):
            words, grams = hashes(text)
            spots = np.array(spots)
            near, far = (spots >> 1)[spots & 1 == 0], (spots >> 1)[spots & 1 == 1]
            short = (words >> np.uint64(32)).astype("<u4")
            n = 0
            for at in near.tolist():
                left.append(short[max(at - SIDE, 0) : at][::-1].tobytes())
                right.append(short[at + GRAM : at + GRAM + SIDE].tobytes())
                n += rows.add(grams[at : at + 1], np.array([at]))
            if len(far):
                first = np.unique((far[:, None] - np.arange(SIDE + 1)).ravel())
                first = first[(first >= 0) & (first + MIN <= len(words))]
                more = rows.add(Rolling(words).of(first, first + MIN), first)
                left += [None] * more
                right += [None] * more
                n += more
            counts.append(n)
        h, at = rows.arrays()
        t, d = (pa.array(np.repeat(batch.column(c).to_numpy(), counts)) for c in ("t", "d"))
        yield pa.RecordBatch.from_arrays([h, t, d, at, pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["h", "t", "d", "at", "left", "right"])


def _common(a: int, b: int, most: int) -> int:
    """Words that two contexts, as little-endian numbers of 32-bit words, share from the start."""
    x = a ^ b
    return most if not x else min(most, ((x & -x).bit_length() - 1) >> 5)


def _compared(rows: list[tuple], out: list[tuple]) -> None:
    """rows: a list's suffixes (t, d, at, left, right), sorted by their right context."""
    if len(rows) < 2:
        return
    sides = [(int.from_bytes(x[3], "little"), len(x[3]) >> 2, int.from_bytes(x[4], "little"), len(x[4]) >> 2) for x in rows]
    best: dict[int, tuple[int, int, int]] = {}
    for i in range(len(rows) - 1):
        lcp = SIDE
        for j in range(i + 1, len(rows)):
            prev, this = sides[j - 1], sides[j]
            lcp = min(lcp, _common(prev[2], this[2], min(prev[3], this[3])))  # of sorted suffixes: the least between them
            if rows[i][1] == rows[j][1]:
                continue
            left = _common(sides[i][0], this[0], min(sides[i][1], this[1]))
            if left + lcp >= SIDE:
                later, other = (i, j) if rows[i][1] > rows[j][1] else (j, i)
                was = best.get(later, (0, 0, rows[other][1]))
                best[later] = (max(was[0], left), max(was[1], lcp), min(was[2], rows[other][1]))
    for i, (left, right, first) in best.items():
        t, d, at = rows[i][:3]
        out.append((t, d, at - left, at + GRAM + right, first))


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = None, []
    for batch in batches:
        out: list[tuple] = []
        h = batch.column("h").to_numpy()
        rest = zip(*(batch.column(c).to_pylist() for c in ("t", "d", "at", "left", "right")), strict=True)
        for key, row in zip(h.tolist(), rest, strict=True):
            if key != held:
                _compared(rows, out)
                held, rows = key, []
            rows.append(row)
        yield _spans(out)
    out = []
    _compared(rows, out)
    yield _spans(out)


_SPAN = "t long, d long, start int, end int, first long"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["t", "d", "start", "end", "first"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by (t, d, start) -> those that overlap or touch as one."""
    held: tuple | None = None
    for batch in batches:
        out = []
        for t, d, start, end, first in zip(*(batch.column(c).to_pylist() for c in ("t", "d", "start", "end", "first")), strict=True):
            if held and held[:2] == (t, d) and start <= held[3]:
                held = (t, d, held[2], max(held[3], end), min(held[4], first))
            else:
                if held:
                    out.append(held)
                held = (t, d, start, end, first)
        yield _spans(out)
    if held:
        yield _spans([held])


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with t, a 64-bit key of the text, and d, the id with a number for null."""
    return docs.withColumns({"t": F.xxhash64(F.coalesce("text", F.lit(""))), "d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(t, d, start, end, first): the merged spans of repeated words [start, end) of each document, and the smallest id
    that has one of its windows. t and d are those of keyed().

    Null and short texts have none. Null ids count as smaller than all. Rows equal in id and text are one document.
    """
    spark = docs.sparkSession
    rows = keyed(docs.select("doc_id", "text")).where(F.octet_length("text") >= 2 * MIN - 1)
    # one row for each text and first words: copies of a text meet before they are shuffled
    suffixes = cut(rows.select("t", "text").mapInArrow(_suffixes, "h long, t long, at array<int>").groupBy("h", "t").agg(F.any_value("at").alias("at")))
    lists = suffixes.groupBy("h").agg(F.count("*").alias("texts"), F.sum(F.size("at")).alias("n")).where("texts > 1").select("h", (F.col("n") > LONG).alias("long"))
    spot = F.transform("at", lambda x: x * 2 + F.col("long").cast("int"))
    spots = suffixes.join(lists, "h").groupBy("t").agg(F.flatten(F.collect_list(spot)).alias("spots"))  # bounded by a text's length
    reps = rows.groupBy("t").agg(F.min("d").alias("d"))
    wanted = reps.join(spots, "t")
    texts = rows.join(wanted, ["t", "d"]).withColumn("copy", F.row_number().over(Window.partitionBy("t", "d").orderBy("d"))).where("copy = 1")
    found = texts.select("t", "d", "text", "spots").mapInArrow(_contexts, "h long, t long, d long, at array<int>, left binary, right binary")
    found = cut(found)
    n = partitions(spark)
    near = found.where("right is not null").withColumn("at", F.col("at")[0]).repartition(n, "h").sortWithinPartitions("h", "right", "d", "at").mapInArrow(_matches, _SPAN)
    windows = found.where("right is null").select("h", "t", "d", "at")
    firsts = windows.groupBy("h").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first <> last").select("h", "first")
    far = windows.join(firsts, "h").where("d > first").select("t", "d", F.explode("at").alias("start"), "first")
    far = far.select("t", "d", "start", (F.col("start") + MIN).cast("int").alias("end"), "first")
    return near.union(far).repartition(n, "t", "d").sortWithinPartitions("t", "d", "start", "end").mapInArrow(_merged, _SPAN)


def words_of(text):
    """Number of words, as scan() counts them."""
    return F.size(F.array_remove(F.split(text, "[ \\t-\\r]+"), ""))


def copies(docs: DataFrame) -> DataFrame:
    """The span of all words of each document that has MIN words and the text of a document with a smaller id."""
    rows = keyed(docs.select("doc_id", "text")).where(F.octet_length("text") >= 2 * MIN - 1)
    reps = rows.groupBy("t").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first <> last").select("t", "first")
    same = rows.join(reps, "t").where("d > first").select("t", "d", F.lit(0).alias("start"), words_of(F.col("text")).alias("end"), "first")
    return same.where(F.col("end") >= MIN).dropDuplicates(["t", "d"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc_id): a row for each passage that an earlier document has too."""
    spans = repeated_spans(docs).unionByName(copies(docs))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return spans.select(back("d").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), back("first").alias("first_doc_id"))


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the blanks after each of them."""
    data = text.encode("utf-8", "surrogatepass")
    start = scan(data).start
    ends = [*start.tolist(), len(data)]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(data[at : ends[a]])
        at = ends[b]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass").rstrip()


def without_repeats(docs: DataFrame) -> DataFrame:
    """All documents, with the input's columns; repeated passages are cut out of `text`, and n_chars counts what is left."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def shorter(text, spans):
        import pandas as pd

        return pd.Series([cut_out(t, [(x["start"], x["end"]) for x in s]) if len(s) else t for t, s in zip(text, spans, strict=True)], dtype=object)

    spans = repeated_spans(docs).unionByName(copies(docs)).groupBy("t", "d").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    plain, names = set_aside(docs, "doc_id", "text")
    joined = keyed(plain).join(spans, ["t", "d"], "left")
    out = joined.withColumn("text", shorter(F.col("text"), F.coalesce("spans", F.array())))
    columns = {c: F.col(n) for c, n in zip(docs.columns, names, strict=True)} | {"text": F.col("text")}
    if "n_chars" in columns:
        n_chars = F.when(F.col("spans").isNull(), columns["n_chars"]).otherwise(F.length("text"))
        columns["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(k) for k, c in columns.items()])
