"""Connected components of an edge table, without collecting vertices or components anywhere.

The graph is contracted round by round. In a round every vertex points to the least of itself and its neighbours, by a hash
that differs from round to round, and is renamed to what that one points to: two hops. A renamed edge joins two names of
one component and every component stays connected, so edges between names are the next round's graph, and names without an
edge are done. A vertex remains a name only if it is the least for some vertex near it, so their number falls by a constant
factor a round in expectation, whatever the graph looks like and however its ids are dealt: a path of n vertices keeps
about two fifths. Rounds are logarithmic, and all of them together read about as much as a few passes over the first one. What
is left when a round's graph has at most FEW edges, which is counted, is joined up by one task instead of more rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import cut

#: So many edges at most go to one task.
FEW = 50_000


def contract(edges: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """One round over edges (a, b), a < b, distinct: (node, name) of all vertices, and the edges between different names."""
    both = edges.select("a", "b").union(edges.select("b", "a").toDF("a", "b"))
    ranked = lambda c: F.struct(F.xxhash64(F.lit(number), c).alias("h"), F.col(c).alias("v"))
    near = both.groupBy("a").agg(F.min(ranked("b")).alias("least"))
    points = near.select(F.col("a").alias("node"), F.least("least", ranked("a"))["v"].alias("to"))
    names = cut(points.join(points.select(F.col("node").alias("to"), F.col("to").alias("name")), "to").select("node", "name"))
    one = edges.join(names.select(F.col("node").alias("a"), F.col("name").alias("x")), "a").select("x", "b")
    two = one.join(names.select(F.col("node").alias("b"), F.col("name").alias("y")), "b").where("x <> y")
    return names, cut(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of one small graph -> (node, name) with one name for each component."""
    name: dict[int, int] = {}

    def find(x: int) -> int:
        while name.setdefault(x, x) != x:
            name[x] = name[name[x]]
            x = name[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            name[max(x, y)] = min(x, y)
    nodes = list(name)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "name"])


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, root): root is the smallest node reachable. Vertices without an edge do not appear.

    No edges give no rows; loops, repeated edges and edges with a null do no harm. The names of a round are resolved by those
    of the next, from the last round back, so each round's table is joined once.
    """
    given = cut(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    loops, left, rounds = given.where("a = b").select(F.col("a").alias("node")), given.where("a < b"), []
    while n := left.limit(FEW + 1).count():
        if n <= FEW:
            rounds.append(cut(left.select("a", "b").coalesce(1).mapInArrow(_joined, "node long, name long")))
            break
        names, left = contract(left, len(rounds))
        rounds.append(names)
    found = given.select(F.col("a").alias("node"), F.col("b").alias("name")).limit(0)
    for names in reversed(rounds):
        later = found.select(F.col("node").alias("name"), F.col("name").alias("last"))
        found = cut(names.join(later, "name", "left").select("node", F.coalesce("last", "name").alias("name")))
    smallest = found.groupBy("name").agg(F.min("node").alias("root"))
    rooted = found.join(smallest, "name").select("node", "root")
    alone = loops.join(rooted.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return cut(rooted.union(alone))
