"""Centroid clustering of quantised vectors by weighted deduplication.

Equal quantised vectors become one row with a multiplicity. Lloyd's rounds run over these distinct vectors: every task
assigns its rows and returns one weighted integer sum for each centroid, so all arithmetic is exact and does not depend on
how rows are dealt out. The last assignment is joined back to the ids of all vectors.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import cut, set_aside

DIMENSION = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: Groups of equal vectors that hold this share of all rows are told their cluster by a broadcast of at most 1 / SHARE rows.
SHARE = 0.001
#: Components up to here leave all squares and their sum within 64 bits; larger ones are computed with Python's integers.
SMALL = 1 << 27
#: Weighted sums of a part of the rows stay within 64 bits up to here.
MOST = 1 << 62


def quantised(embedding: Column, dimension: int = DIMENSION, scale: int = SCALE) -> Column:
    """The vector's integers floor(scale * x); null unless it has `dimension` components, all finite and each integer within 64 bits."""
    x = embedding.cast("array<double>")
    fits = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float((1 << 62) // scale)), F.lit(False)))
    return F.when((F.size(embedding) == dimension) & fits, F.transform(x, lambda v: F.floor(v * float(scale)).cast("long")))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest_centroid(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """Of each row the number of the nearest centroid (ties: the smaller) and the squared distance, exactly."""
    small = max(int(np.abs(points).max(initial=0)), max(abs(x) for c in centroids for x in c)) <= SMALL
    kind = np.int64 if small else object
    p = points.astype(kind)
    distances = np.stack([((p - np.array(c, dtype=kind)) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = np.array([min(range(len(row)), key=row.__getitem__) for row in distances]) if kind is object else distances.argmin(axis=1)
    return best.astype(np.int32), distances[np.arange(len(points)), best].tolist()


def _sums(centroids: list[list[int]]):
    """Batches (q, n) -> one row for each centroid that gets any: its number, count and component sums as decimal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            points, n = _matrix(batch.column(0)), batch.column(1).to_numpy()
            best, _ = nearest_centroid(points, centroids)
            fits = int(np.abs(points).max(initial=0)) * int(n.sum()) < MOST
            for c in np.unique(best).tolist():
                mine = best == c
                p, w = points[mine], n[mine]
                parts = (p * w[:, None]).sum(axis=0).tolist() if fits else (p.astype(object) * w.astype(object)[:, None]).sum(axis=0).tolist()
                new = [int(w.sum()), *map(int, parts)]
                totals[c] = [a + b for a, b in zip(totals[c], new, strict=True)] if c in totals else new
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([[str(x) for x in v] for v in totals.values()], pa.list_(pa.string()))], names=["c", "sums"])

    return run


def _assigned(centroids: list[list[int]]):
    """Batches (k1, k2, q, n) -> (k1, k2, n, cluster, distance); a distance beyond 64 bits is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best, far = nearest_centroid(_matrix(batch.column(2)), centroids)
            far = [d if d < 1 << 63 else None for d in far]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(best, pa.int32()), pa.array(far, pa.int64())], names=["k1", "k2", "n", "cluster", "distance"])

    return run


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(q, n): the distinct quantised vectors of rows (q, …) and how many rows have each."""
    return rows.groupBy("q").agg(F.count("*").alias("n"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors of the rows (vec_id, q) with the smallest sha256 of "seed:vec_id", in that order; ties by the vector."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(h.alias("h"), "q").orderBy("h", "q").limit(clusters).collect()
    return [list(r.q) for r in first]


def lloyd(points: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """The centroids after so many rounds over distinct vectors (q, n). Only centroids and their sums reach the driver.

    New components are floor(sum / count), exactly; a centroid without vectors stays.
    """
    for _ in range(rounds):
        parts = points.select("q", "n").mapInArrow(_sums(centroids), "c int, sums array<string>")
        one = parts.select("c", F.posexplode("sums").alias("i", "s")).groupBy("c", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # centroids x (dimension + 1)
        new: dict[int, dict[int, int]] = {}
        for r in one:
            new.setdefault(r.c, {})[r.i] = int(r.s)
        centroids = [[new[c][j + 1] // new[c][0] for j in range(len(old))] if c in new else old for c, old in enumerate(centroids)]
    return centroids


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, multiplicity) of every vector that takes part.

    Vectors that are null, have another dimension, a null or non-finite component, or one beyond 2^62 / scale take no
    part. Null and repeated ids are kept, a row each; rows without an id cannot start a centroid. With fewer vectors than
    clusters there are as many centroids; with no id at all no row can start one, and there are no rows. Inertias and
    distances that 64 bits cannot hold are null.
    """
    plain, _ = set_aside(vectors, "vec_id", "embedding")
    kept = plain.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), dimension, scale).alias("q")).where("q is not null")
    rows = cut(kept.select("vec_id", "q", F.xxhash64("q").alias("k1"), F.xxhash64(F.lit("second"), "q").alias("k2")))
    start = first_centroids(rows, clusters, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, multiplicity long"
    if not start:
        return vectors.sparkSession.createDataFrame([], schema)
    points = cut(distinct_vectors(rows).withColumns({"k1": F.xxhash64("q"), "k2": F.xxhash64(F.lit("second"), "q")}))
    final = lloyd(points, start, rounds)
    placed = cut(points.select("k1", "k2", "q", "n").mapInArrow(_assigned(final), "k1 long, k2 long, n long, cluster int, distance long"))

    spread = F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)"))
    totals = {r.cluster: r for r in placed.groupBy("cluster").agg(spread.alias("s"), F.sum("n").alias("n"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()}  # a row for each centroid
    as_long = lambda s, lost: int(s) if not lost and s < 1 << 63 else None
    inertia = as_long(sum(int(t.s or 0) for t in totals.values()), any(t.lost for t in totals.values()))
    facts = [{"c": c, "cluster_inertia": as_long(int(totals[c].s or 0), totals[c].lost) if c in totals else 0, "sha": hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()} for c, v in enumerate(final)]
    known = F.from_json(F.lit(json.dumps(facts)), "array<struct<c: int, cluster_inertia: long, sha: string>>")

    # groups that hold many rows are told by a broadcast of at most 1 / SHARE rows, the others by a join on their key
    least = max(1, int(SHARE * sum(t.n for t in totals.values())))
    heavy = placed.where(F.col("n") > least).select("k1", "k2", F.struct("cluster", "distance", "n").alias("h"))
    ids = rows.select("vec_id", "k1", "k2").join(F.broadcast(heavy), ["k1", "k2"], "left")
    told = ids.where("h is not null").select("vec_id", "h.cluster", "h.distance", "h.n")
    joined = ids.where("h is null").select("vec_id", "k1", "k2").join(placed.where(F.col("n") <= least), ["k1", "k2"]).select("vec_id", "cluster", "distance", "n")
    fact = F.get(known, F.col("cluster"))
    return told.unionByName(joined).select("vec_id", "cluster", "distance", fact["cluster_inertia"].alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), fact["sha"].alias("centroid_sha256"), F.col("n").alias("multiplicity"))
