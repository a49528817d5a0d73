"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its non-empty paragraphs (lines). Each paragraph is hashed to a wide vector and the vectors
are summed lane by lane modulo a power of two, so the sum does not depend on the paragraphs' order, and a paragraph can be
added to or taken from a fingerprint without reading the rest. The vector has two parts: EXACT lanes modulo 2^16, which are
uniformly random for each paragraph (equality of multisets), and LIKE lanes modulo 2^32, a signed count sketch of the
paragraph's three-word shingles (likeness of different multisets): no text has so many shingles that a lane wraps. Both
parts are sums over paragraphs, hence homomorphic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import partitions, slices
from ledgerflow.llm.words import scan

EXACT, LIKE = 64, 128
LANES = EXACT + LIKE
MASK = np.array([0xFFFF] * EXACT + [0xFFFFFFFF] * LIKE, dtype=np.int64)


def _like(data: bytes) -> np.ndarray:
    """Signed sketch of the three-word shingles that lie within one paragraph; shorter paragraphs give one shingle."""
    if not data:
        return np.zeros(LIKE, dtype=np.int64)
    b, start, end, roll = scan(data)
    if not len(start):
        return np.zeros(LIKE, dtype=np.int64)
    line = np.cumsum(b == 10)[start]
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    last_of_line = np.repeat(np.concatenate((first[1:], [len(start)])) - 1, np.diff(np.concatenate((first, [len(start)]))))
    at = np.arange(len(start))
    keep = (at + 2 <= last_of_line) | np.isin(at, first)
    s, e = start[keep], end[np.minimum(at + 2, last_of_line)[keep]]
    h = roll.of(s, e)
    lane = (h >> np.uint64(57)).astype(np.int64) % LIKE
    return np.bincount(lane, weights=1.0 - 2.0 * (h & np.uint64(1)), minlength=LIKE).astype(np.int64)


def vector(text: str) -> np.ndarray:
    """Sum of the paragraphs' vectors, each lane modulo its power of two; the empty multiset has the zero vector."""
    data = text.encode("utf-8", "surrogatepass")
    lines = [x for x in data.split(b"\n") if x]
    out = np.zeros(LANES, dtype=np.int64)
    if lines:
        wide = b"".join([hashlib.shake_128(x).digest(2 * EXACT) for x in lines])
        out[:EXACT] = np.frombuffer(wide, dtype="<u2").reshape(-1, EXACT).sum(axis=0, dtype=np.int64)
        out[EXACT:] = _like(data)
    return out & MASK


def insert(fingerprint: np.ndarray, paragraphs: str) -> np.ndarray:
    return (fingerprint + vector(paragraphs)) & MASK


def delete(fingerprint: np.ndarray, paragraphs: str) -> np.ndarray:
    return (fingerprint - vector(paragraphs)) & MASK


def as_text(v: np.ndarray) -> str:
    return v[:EXACT].astype("<u2").tobytes().hex() + v[EXACT:].astype("<u4").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    data = bytes.fromhex(s)
    return np.concatenate((np.frombuffer(data[: 2 * EXACT], dtype="<u2").astype(np.int64), np.frombuffer(data[2 * EXACT :], dtype="<u4").astype(np.int64)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints; otherwise the cosine of the shingle sketches, from 0 to below 1."""
    if np.array_equal(a, b):
        return 1.0
    x, y = ((((v[EXACT:] + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)).astype(float) for v in (a, b))
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return min(max(float(x @ y) / norm, 0.0), 0.999999) if norm else 0.0


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_DEALT = "bucket int, sentinel boolean, id long, h long, n long, doc_id long, text string"
LEAST_ID = -(1 << 63)


def _edited(old: str, fp: np.ndarray, text: str, own: np.ndarray) -> tuple:
    """What a text with fingerprint fp gives beside its next text with fingerprint own."""
    n = len(old)
    stay = n - n // 4
    new = old[:stay] + text[: n - stay]
    tail = old.rfind("\n", 0, stay) + 1
    changed = insert(delete(fp, old[tail:]), new[tail:])
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return n, digest, as_text(fp), as_text(changed), likeness(fp, changed), likeness(fp, own)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[]] * 7
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _edited_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, sentinel, id, h, text): each one's follower in its bucket is its next document. A row stands for
    n equal ones, of which all but the last have themselves as next."""
    held: tuple | None = None  # bucket, sentinel, doc_id, text, vector
    for batch in slices(batches):
        out: list[tuple] = []
        fields = zip(*(batch.column(c).to_pylist() for c in ("bucket", "sentinel", "n", "doc_id", "text")), strict=True)
        for bucket, sentinel, n, doc_id, text in fields:
            if held and held[0] == bucket and held[1] and sentinel:
                continue
            same = held is not None and held[3] == text
            own = held[4] if same else vector(text)
            if held and held[0] == bucket and not held[1]:
                out.append((held[2], *_edited(held[3], held[4], text, own)))
            if n > 1 and not sentinel:
                alone = _edited(text, own, text, own)
                for _ in range(n - 1):
                    out.append((doc_id, *alone))
                    if len(out) >= 4096:
                        yield _rows(out)
                        out = []
            held = (bucket, sentinel, doc_id, text, own)
        yield _rows(out)


def _places(ids: np.ndarray, h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The bucket of each row: how many cuts lie below its id. An id that several cuts equal has as many buckets, by ranges of h."""
    low, high = np.searchsorted(cuts, ids, side="left"), np.searchsorted(cuts, ids, side="right")
    share = (h.astype(np.float64) + 2.0**63) / 2.0**64
    return (low + np.minimum(np.floor(share * (high - low)), np.maximum(high - low - 1, 0))).astype(np.int32)


def fingerprint_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, whose last quarter is taken from the next document by id.

    Null texts count as empty, null ids as the smallest long; rows with equal ids follow each other by their texts' hashes; the last
    row's next is the first; a single row is its own next; no rows give no rows; other columns are ignored. Texts are
    shuffled once: rows are dealt to ranges of ids, and each range also gets a copy of the first row of the range after it,
    so no range has to be read by one task with another. An id that many rows share is dealt to several ranges by hashes of
    the texts, and rows equal in id and text become one with a count before they are shuffled. What reaches the driver is
    one id and hash for each range.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("id"), F.xxhash64("text").alias("h"), "doc_id", "text")
    n = partitions(spark) * 4
    found = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n)).first()[0]
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    cuts = np.array(sorted(found), dtype=np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = _places(batch.column("id").to_numpy(), batch.column("h").to_numpy(), cuts)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column("id"), batch.column("h")], names=["bucket", "id", "h"])

    first = rows.select("id", "h").mapInArrow(placed, "bucket int, id long, h long").groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("head"))
    heads = sorted(((r["bucket"], r["head"]["id"], r["head"]["h"]) for r in first.collect()), key=lambda r: r[0])  # a row for each range
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    to = {heads[(i + 1) % len(heads)][1:]: heads[i][0] for i in range(len(heads))}  # the range before the one that a row heads

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            if not batch.num_rows:
                continue
            ids, h = batch.column("id").to_numpy(), batch.column("h").to_numpy()
            order = np.lexsort((h, ids))
            new = np.flatnonzero(np.concatenate(([True], (np.diff(ids[order]) != 0) | (np.diff(h[order]) != 0))))
            own, counts = order[new], np.diff(np.concatenate((new, [len(order)])))
            bucket = _places(ids[own], h[own], cuts)
            copies = [(to[k], j) for j, k in zip(own.tolist(), zip(ids[own].tolist(), h[own].tolist(), strict=True), strict=True) if k in to]
            take = np.concatenate((own, np.array([j for _, j in copies], np.int64)))
            kept = batch.take(pa.array(take))
            head = [
                pa.array(np.concatenate((bucket, np.array([b for b, _ in copies], np.int32))), pa.int32()), pa.array([False] * len(own) + [True] * len(copies), pa.bool_()),
                kept.column("id"), kept.column("h"), pa.array(np.concatenate((counts, np.ones(len(copies), np.int64))), pa.int64()), kept.column("doc_id"), kept.column("text"),
            ]
            yield pa.RecordBatch.from_arrays(head, names=["bucket", "sentinel", "id", "h", "n", "doc_id", "text"])

    ranges = rows.mapInArrow(dealt, _DEALT).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "sentinel", "id", "h", "text")
    return ranges.mapInArrow(_edited_rows, SCHEMA)


def fingerprints(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The input's rows with a `fingerprint` column; no shuffle."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def of(s):
        return s.fillna("").map(lambda x: as_text(vector(x)))

    return docs.withColumn("fingerprint", of(F.col("text") if text is None else text))
