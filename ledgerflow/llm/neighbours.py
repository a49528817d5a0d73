"""Approximate nearest neighbours: NN-descent graph, greedy graph search.

Distinct vectors are nodes. The graph starts from exact neighbours within bounded runs of several random-hyperplane orders.
Each NN-descent round then joins every node's neighbours, forward and reverse, with each other: members of one list
are neighbours of neighbours. Only pairs with a neighbour that came in the round before are compared, lists without one are left
out, and a pair is emitted only if it would enter one of the two neighbour lists. Rounds end when few neighbours still change.
Queries walk the graph best first until none of the best BEAM found is unexpanded: from their own node, or, if they are no
vectors of the table, from ENTRIES nodes. Distances in graph and walk are of vectors rounded to 32-bit floats; the nodes a walk
ends with are ranked by exact distances of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.llm.common import cut, partitions

K = 32
REVERSE = 32
ORDERS, RUN, PLANES = 4, 256, 8
#: Rows of the orders in one task.
ROWS_A_TASK = 8192
#: Rounds end when fewer than this share of all neighbours are new, or after so many.
CHANGED, ROUNDS = 0.01, 6
BEAM, STEP = 192, 64
TOP = 10
ENTRIES = 64
SEED = 5


def usable(v: Column) -> Column:
    """Not null, all components finite numbers, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1) if rows else np.zeros((0, 1), np.float32)


def _edges(u, v, d) -> pa.RecordBatch:
    """Edges found in this round."""
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(v, np.int64)), pa.array(np.asarray(d, np.float64))], names=["u", "v", "d"])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.maximum(d, 0)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, id, q) in order: exact neighbours among RUN rows of one order at a time, fewer than twice as many at its end."""

    def exact(ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        a = q.astype(np.float64)
        d = _squares(a, a)
        np.fill_diagonal(d, np.inf)
        k = min(K, len(ids) - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), np.int64)
        return _edges(np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(d, near, axis=1).ravel())

    tree, ids, q = None, np.zeros(0, np.int64), None
    for batch in batches:
        trees, new_ids, new_q = batch.column("tree").to_numpy(), batch.column("id").to_numpy(), _matrix(batch.column("q"))
        bounds = np.flatnonzero(np.diff(trees, prepend=-1, append=-1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if trees[a] != tree:
                if len(ids):
                    yield exact(ids, q)
                tree, ids, q = trees[a], new_ids[a:b], new_q[a:b]
            else:
                ids, q = np.concatenate((ids, new_ids[a:b])), np.concatenate((q, new_q[a:b]))
            while len(ids) >= 2 * RUN:
                yield exact(ids[:RUN], q[:RUN])
                ids, q = ids[RUN:], q[RUN:]
    if len(ids):
        yield exact(ids, q)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, pa.Array | np.ndarray]]:
    """Batches cut so that no group of equal keys is divided. Rows come sorted by the key; a group must be bounded."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        keys = t.column(key).to_numpy()
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        held = t.slice(last)
        if last:
            yield t.slice(0, last).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (c, m, fresh, q, kth): the pairs (u, v) of a list, one of them fresh, that would enter u's neighbours."""
    for t in _grouped(batches, "c"):
        c, m, fresh, kth = (t.column(x).to_numpy(zero_copy_only=False) for x in ("c", "m", "fresh", "kth"))
        q = _matrix(t.column("q").combine_chunks()).astype(np.float64)
        bounds = np.flatnonzero(np.diff(c, prepend=c[0] - 1, append=c[-1] - 1))
        us, vs, ds = [], [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            order = a + np.lexsort((~fresh[a:b], m[a:b]))
            ids, first = np.unique(m[order], return_index=True)
            own = order[first]
            new = np.flatnonzero(fresh[own])
            d = _squares(q[own][new], q[own])
            d[np.arange(len(new)), new] = np.inf
            x, y = np.nonzero(d < kth[own][new][:, None])
            old = ~fresh[own]
            z, w = np.nonzero((d < kth[own][None]) & old[None])
            us += [ids[new][x], ids[w]]
            vs += [ids[y], ids[new][z]]
            ds += [d[x, y], d[z, w]]
        yield _edges(np.concatenate(us), np.concatenate(vs), np.concatenate(ds))


def _best(most: int):
    """Edges sorted by (u, d, v) -> (u, v array, d array, fresh array): the `most` nearest, each once. An edge is fresh if it was not
    known before. Groups are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vs, ds, known = None, [], [], {}
        for batch in batches:
            out = ([], [], [], [])
            for u, v, d, fresh in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "d", "fresh")), strict=True):
                if u != held:
                    if held is not None:
                        for x, y in zip(out, (held, vs, ds, list(known.values())), strict=True):
                            x.append(y)
                    held, vs, ds, known = u, [], [], {}
                if v in known:
                    known[v] = known[v] and fresh
                elif len(vs) < most:
                    known[v] = fresh
                    vs.append(v)
                    ds.append(d)
            yield _lists(*out)
        if held is not None:
            yield _lists([held], [vs], [ds], [list(known.values())])

    return run


def _lists(u, v, d, fresh) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((u, v, d, fresh), kinds, strict=True)], names=["u", "v", "d", "fresh"])


_EDGE, _LIST = "u long, v long, d double", "u long, v array<long>, d array<double>, fresh array<boolean>"


def _top(found: DataFrame, most: int, known: DataFrame | None = None) -> DataFrame:
    """The lists of edges found and of those in `known` lists."""
    edges = found.withColumn("fresh", F.lit(True))
    if known is not None:
        edges = edges.union(_flat(known).withColumn("fresh", F.lit(False)))
    n = partitions(edges.sparkSession)
    return edges.repartition(n, "u").sortWithinPartitions("u", "d", "v").mapInArrow(_best(most), _LIST)


def _flat(lists: DataFrame) -> DataFrame:
    return lists.select("u", F.explode(F.arrays_zip("v", "d")).alias("e")).select("u", "e.v", "e.d")


def _adjacent(graph: DataFrame, seed: int) -> DataFrame:
    """(c, m, fresh): neighbours of c, and REVERSE of the nodes that have c as neighbour, fresh ones first, drawn by hash."""
    out = graph.select(F.col("u").alias("c"), F.explode(F.arrays_zip(F.col("v").alias("m"), "fresh")).alias("e")).select("c", "e.m", "e.fresh")
    back = out.select(F.col("m").alias("c"), F.col("c").alias("m"), "fresh")
    order = Window.partitionBy("c").orderBy(F.desc("fresh"), F.xxhash64("c", "m", F.lit(seed)), "m")
    return out.union(back.withColumn("r", F.row_number().over(order)).where(F.col("r") <= REVERSE).drop("r"))


def _scale(nodes: DataFrame) -> tuple[float, int]:
    """The largest component and the length of the vectors; length 0 without any."""
    first = nodes.agg(F.max(F.array_max(F.transform("vec", F.abs))), F.max(F.size("vec"))).first()
    return float(first[0] or 1.0), int(first[1] or 0)


def rounded(nodes: DataFrame, scale: tuple[float, int] | None = None) -> DataFrame:
    """(id, q, keys): vectors as 32-bit floats, and their place in each random order. nodes: (id, vec)."""
    largest, dim = scale or _scale(nodes)
    rng = np.random.default_rng(SEED)
    planes = rng.standard_normal((ORDERS, PLANES, dim)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("vec").to_pylist()
            if not rows:
                continue
            x = np.array(rows, dtype=np.float64) / largest
            q = x.astype(np.float32)
            side = np.einsum("ni,tpi->ntp", x.astype(np.float32), planes)
            bits = (side[..., :-1] > 0).astype(np.int64)
            gray = np.bitwise_xor.accumulate(bits, axis=-1)  # neighbouring codes differ in one plane
            code = gray @ (1 << np.arange(PLANES - 2, -1, -1))
            sign = np.where(code % 2 == 0, 1, -1)
            keys = code + 0.5 + 0.49 * np.tanh(side[..., -1]) * sign
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v.tobytes() for v in q], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.float64()))], names=["id", "q", "keys"])

    return nodes.select("id", "vec").mapInArrow(run, "id long, q binary, keys array<double>")


def graph(nodes: DataFrame, rounds: int | None = None) -> DataFrame:
    """(u, v, d): each node's K nearest found, nearest first. nodes: what rounded() gives, already cut."""
    count = nodes.count()
    placed = nodes.select("id", "q", F.posexplode("keys").alias("tree", "key"))
    n = max(1, -(-count * ORDERS // ROWS_A_TASK))
    ordered = placed.repartitionByRange(n, "tree", "key").sortWithinPartitions("tree", "key", "id")
    lists = cut(_top(ordered.select("tree", "id", "q").mapInArrow(_runs, _EDGE), K))
    for i in range(ROUNDS if rounds is None else rounds):
        kth = F.when(F.size("d") >= K, F.element_at("d", -1)).otherwise(float("inf")).cast("double")
        state = lists.select(F.col("u").alias("m"), kth.alias("kth")).join(nodes.select(F.col("id").alias("m"), "q"), "m")
        near = _adjacent(lists, i).groupBy("c").agg(F.collect_list(F.struct("m", "fresh")).alias("near"), F.max("fresh").alias("any"))  # at most K + REVERSE
        joined = near.where("any").select("c", F.inline("near")).join(state, "m").select("c", "m", "fresh", "q", "kth")
        found = joined.repartition(partitions(nodes.sparkSession), "c").sortWithinPartitions("c").mapInArrow(_pairs, _EDGE)
        lists = cut(_top(found, K, lists))
        changed = lists.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        if changed < CHANGED * K * count:
            break
    return lists


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, m, q) -> (c, ms, qs): all neighbours of a node in one row, each once."""
    for t in _grouped(batches, "c"):
        c, m = t.column("c").to_numpy(), t.column("m").to_numpy()
        q = t.column("q").to_pylist()
        bounds = np.flatnonzero(np.diff(c, prepend=c[0] - 1, append=c[-1] - 1))
        own = [np.unique(m[a:b], return_index=True)[1] + a for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c[bounds[:-1]]), pa.array([m[i].tolist() for i in own], pa.list_(pa.int64())), pa.array([b"".join([q[j] for j in i]) for i in own], pa.binary())], names=["c", "ms", "qs"])


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, q, bound, ms, qs): the neighbours of an expanded node that are nearer to query u than its bound."""
    for batch in batches:
        us, vs, ds = [], [], []
        for u, q, bound, ms, qs in zip(*(batch.column(c).to_pylist() for c in ("u", "q", "bound", "ms", "qs")), strict=True):
            x = np.frombuffer(q, np.float32).astype(np.float64)[None]
            a = np.frombuffer(qs, np.float32).reshape(len(ms), -1).astype(np.float64)
            d = _squares(x, a)[0]
            m = np.array(ms)
            good = (d < bound) & (m != u)
            us.append(np.full(int(good.sum()), u))
            vs.append(m[good])
            ds.append(d[good])
        if us:
            yield _edges(np.concatenate(us), np.concatenate(vs), np.concatenate(ds))


def search(lists: DataFrame, nodes: DataFrame, wanted: DataFrame, start: DataFrame, beam: int | None = None, step: int | None = None) -> DataFrame:
    """(u, v, d): for each query u of wanted (u, q), the `beam` nearest nodes that its walk found. The walk begins at its nodes of
    start (u, v, d): arrays, nearest first. A query that has a node's number never finds that node."""
    beam, step = BEAM if beam is None else beam, STEP if step is None else step
    n = partitions(nodes.sparkSession)
    vectors = nodes.select(F.col("id").alias("m"), "q")
    near = _adjacent(lists, -1).select("c", "m").join(vectors, "m").select("c", "m", "q").repartition(n, "c").sortWithinPartitions("c").mapInArrow(_packed, "c long, ms array<long>, qs binary")
    near = near.repartition(n, "c").persist(StorageLevel.MEMORY_AND_DISK)  # joined by c in every round
    wanted = cut(wanted)
    state = cut(start.select("u", "v", "d", F.array().cast("array<long>").alias("done")))
    while True:
        bound = F.when(F.size("v") >= beam, F.element_at("d", -1)).otherwise(float("inf")).cast("double")
        todo = F.slice(F.array_except("v", "done"), 1, step)
        ahead = cut(state.select("u", "v", "d", "done", bound.alias("bound"), todo.alias("todo")))
        if not ahead.where(F.size("todo") > 0).limit(1).count():
            near.unpersist()
            return ahead.select("u", "v", "d")
        steps = ahead.select("u", "bound", F.explode("todo").alias("c")).join(wanted, "u").repartition(n, "c").join(near, "c")
        found = steps.select("u", "q", "bound", "ms", "qs").mapInArrow(_expanded, _EDGE)
        best = _top(found, beam, ahead).select("u", "v", "d")
        state = best.join(ahead.select("u", F.array_union("done", "todo").alias("done")), "u")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.array(batch.column(c).to_pylist(), np.float64) for c in ("x", "y"))
        d = np.sqrt(((a - b) ** 2).sum(axis=1)) if len(a) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(d)], names=["u", "v", "score"])


class Index:
    """A table's graph. members: (node, id, vec, r), at most `top` + 1 ids of each distinct vector; heads: (id, vec) of the nodes."""

    def __init__(self, rows: DataFrame, top: int) -> None:
        """rows: (id, vec), usable and distinct."""
        ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= top + 1)
        self.top = top
        self.members = cut(ranked.withColumn("node", F.min("id").over(Window.partitionBy("vec"))))
        self.heads = self.members.where("r = 1").select("id", "vec")
        self.nodes = cut(rounded(self.heads))
        self.lists = graph(self.nodes)

    def ranked(self, pairs: DataFrame, vectors: DataFrame, asked: DataFrame) -> DataFrame:
        """Of the pairs (u, v) of a vector (u, vec) and a node, the `top` nearest ids for each of asked (query_id, u)."""
        top = self.top
        exact = pairs.join(vectors.select("u", F.col("vec").alias("x")), "u").join(self.heads.select(F.col("id").alias("v"), F.col("vec").alias("y")), "v")
        scored = exact.select("u", "v", "x", "y").mapInArrow(_scored, "u long, v long, score double")
        listed = scored.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("score", "v"))).where(F.col("r") <= top + 1)
        rows_of = listed.select("u", "v", "score").join(self.members.select(F.col("node").alias("v"), F.col("id").alias("vec_id")), "v")
        answers = asked.join(rows_of, "u").where(~F.col("query_id").eqNullSafe(F.col("vec_id")) | ~F.col("inside"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return answers.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))


def _length(rows: DataFrame) -> int:
    """The length that most vectors have."""
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sizes["n"] if sizes else 0


def nearest(vectors: DataFrame, every: int = 100, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found of each row whose id is divisible by `every`.

    Rows with a null id, and vectors that are null, zero, not finite or of another length than most, take no part. Equal
    vectors are one node and come back as rows, smallest ids first; `top` + 1 of a node's ids are enough for that,
    as all of them are equally near. Rows equal in id and vector count once. No rows give no rows.
    """
    rows = _usable(vectors, id_col, vec_col)
    rows = rows.where(F.size("vec") == _length(rows)).dropDuplicates(["id", "vec"])
    index = Index(rows, top)
    asked = rows.where(F.col("id") % every == 0).withColumnRenamed("id", "query_id").join(index.heads.withColumnRenamed("id", "u"), "vec")
    asked = cut(asked.select("query_id", "u", F.lit(True).alias("inside")))
    walkers = asked.select("u").distinct()
    found = search(index.lists, index.nodes, walkers.join(index.nodes.select(F.col("id").alias("u"), "q"), "u"), index.lists.join(walkers, "u"))
    pairs = found.select("u", F.explode("v").alias("v")).union(walkers.select("u", F.col("u").alias("v")))
    return index.ranked(pairs, index.heads.withColumnRenamed("id", "u"), asked)


def nearest_to(vectors: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found of each query, whose vectors need not be in the table.

    Walks begin at the nearest of ENTRIES nodes, those with the smallest hashes. queries has the columns of vectors, and an id for
    each row; queries without an id or a usable vector of the table's length get no rows.
    """
    rows = _usable(vectors, id_col, vec_col)
    length = _length(rows)
    index = Index(rows.where(F.size("vec") == length).dropDuplicates(["id", "vec"]), top)
    own = _usable(queries, id_col, vec_col).where(F.size("vec") == length).dropDuplicates(["id"])
    own = cut(own.select(F.col("id").alias("query_id"), (-1 - F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1)) - F.lit(1 << 62)).alias("u"), "vec", F.lit(False).alias("inside")))
    scale = _scale(index.heads)
    floats = own.select(F.col("u").alias("id"), "vec")
    wanted = rounded(floats, scale).select(F.col("id").alias("u"), "q") if scale[1] else floats.select(F.col("id").alias("u"), F.lit(None).cast("binary").alias("q")).limit(0)
    entries = F.broadcast(index.nodes.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).agg(F.collect_list("id").alias("ms"), F.collect_list("q").alias("list")).select("ms", F.col("list")))
    first = wanted.crossJoin(entries).where(F.size("ms") > 0).select("u", "q", F.lit(float("inf")).alias("bound"), "ms", F.expr("aggregate(list, cast('' as binary), (a, x) -> concat(a, x))").alias("qs"))  # one row
    found = search(index.lists, index.nodes, wanted, _top(first.mapInArrow(_expanded, _EDGE), ENTRIES))
    return index.ranked(found.select("u", F.explode("v").alias("v")), own.select("u", "vec"), own.select("query_id", "u", "inside"))
