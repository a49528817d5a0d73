"""Packing documents into fixed-length token sequences: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.llm.common import cut

SEQUENCE = 2048
END = 1
#: Ranks within a length are counted in cells of about so many pieces.
ROWS_A_CELL = 10_000
#: More (length, cell) pairs than this are not broadcast.
MOST_BROADCAST_CELLS = 1_000_000
#: The fast encoder takes time by the square of a run of blanks, and stack by its length; runs from here on go to tokenizers.
MOST_BLANKS = 200
_BLANKS = re.compile(rf"\s{{{MOST_BLANKS}}}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoder(path: str):
    """text -> ids, as tokenizers gives them for the file with add_special_tokens=False.

    The file's vocabulary is loaded into tiktoken, which gives the same ids several times as fast; texts that hold a
    special token's string or a long run of blanks go to tokenizers itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    special = {x.content for x in exact.get_added_tokens_decoder().values()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    ranks = {bytes(shown[c] for c in k): v for k, v in vocab.items() if k not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or (len(text) >= MOST_BLANKS and _BLANKS.search(text)):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    probe = "It's 12,345 words\n\n  über  naïve — ok?\t!"
    if encode(probe) != exact.encode(probe, add_special_tokens=False).ids:
        return lambda text: exact.encode(text, add_special_tokens=False).ids
    return encode


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """A row for each piece of at most `sequence` ids: (doc_id, start, length, ids_crc32, doc_tokens)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END], dtype="<u4")
                for s in range(0, len(ids), sequence):
                    part = ids[s : s + sequence]
                    out.append((doc_id, s, len(part), zlib.crc32(part.tobytes()), len(ids)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_up, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a pack) and how many packs follow each.

    Lengths are placed longest first. Packs are kept as groups of equal ones; the shortest group takes the length next,
    and a group that only some of the length's rows fill is divided. A length that the shortest pack cannot take opens
    new packs. Work depends on the histogram, which has at most `sequence` lengths, and not on the number of documents.
    """
    heap: list[tuple[int, tuple[int, ...], int]] = []  # filled, lengths, packs
    for length in sorted(histogram, reverse=True):
        left, put = histogram[length], []
        while left and heap and heap[0][0] + length <= sequence:
            filled, lengths, packs = heapq.heappop(heap)
            n = min(left, packs)
            if n < packs:
                heapq.heappush(heap, (filled, lengths, packs - n))
            put.append((filled + length, (*lengths, length), n))
            left -= n
            if not heap or heap[0][0] > put[0][0]:  # the packs just filled are the shortest again
                for x in put:
                    heapq.heappush(heap, x)
                put = []
        for x in put:
            heapq.heappush(heap, x)
        if left:
            deep = sequence // length
            if deep > 1 and left >= deep:  # the shortest pack is then always one of these, until each is full
                heapq.heappush(heap, (length * deep, (length,) * deep, left // deep))
                left %= deep
            if left:
                heapq.heappush(heap, (length * (left if deep > 1 else 1), (length,) * (left if deep > 1 else 1), 1 if deep > 1 else left))
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for _, lengths, packs in heap:
        merged[lengths] += packs
    return sorted(merged.items(), reverse=True)


def slots(packs: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length, runs of ranks in order: (first rank, sequence of the first, offset in the sequence)."""
    used: dict[int, int] = defaultdict(int)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 0
    for lengths, n in packs:
        offset = 0
        for length in lengths:
            runs[length].append((used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    return runs


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    A null or empty text is the end id alone. Longer documents are cut every `sequence` ids. Rows with equal ids are
    packed each; null ids are kept; no rows give no rows; other columns are ignored. Only the histogram, at most
    `sequence` rows, and the patterns made from it reach the driver. Ranks within a length are counted in cells, as many as
    its pieces need, so that a length that a third of the pieces share is not ranked by one task; a piece's cell follows from
    its number, so equal pieces and ids do not meet in one.
    """
    spark = docs.sparkSession
    rows = cut(pieces(docs, tokenizer or default_tokenizer(), sequence).withColumn("number", F.monotonically_increasing_id()))
    histogram = {r[0]: r[1] for r in rows.groupBy("length").agg(F.count("*")).collect()}
    cells = [-(-histogram.get(k, 0) // ROWS_A_CELL) or 1 for k in range(sequence + 1)]
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("number"), F.element_at(F.lit(cells), (F.col("length") + 1).cast("int"))))
    counts = rows.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "cell", before.alias("before"))
    starts = F.broadcast(starts) if sum(cells) <= MOST_BROADCAST_CELLS else starts
    runs = slots(patterns(histogram, sequence))
    plan = {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}
    shared = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = order[a:b]
                first, base, off = plan[int(length[own[0]])]
                run = np.searchsorted(first, rank[own], side="right") - 1
                seq[own] = base[run] + rank[own] - first[run]
                offset[own] = off[run]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")], pa.array(seq), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    in_cell = F.row_number().over(Window.partitionBy("length", "cell").orderBy("number"))
    ranked = rows.withColumn("in_cell", in_cell).join(starts, ["length", "cell"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("in_cell") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
