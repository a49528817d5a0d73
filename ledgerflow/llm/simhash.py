"""SimHash near-duplicates: byte-position inverted index with count filtering.

Two 64-bit fingerprints at most two bits apart differ in at most two of their eight bytes, so they share at least six
positional bytes. Posting lists of single positional bytes would each hold 1/256 of all documents, so the index takes its
entries four positional bytes at a time: bytes are taken in four aligned pairs, two differing bytes spoil at most two of
the pairs, and the other two pairs make one of the six posting keys. Within a list every member is posted again under each of
its four other positional bytes; the postings that two members share are tallied, pairs with fewer than two of them, which
makes fewer than the guaranteed six bytes, are dropped, and the rest are verified bit by bit.

A list longer than LONG is not paired off. Its members share the key's 32 bits, so two of them are at most two bits apart
exactly if some value is at most one bit from both: each member is entered under itself and its 32 one-bit changes outside
the key, and all members under one value are linked to the smallest. That is exact and linear in the list's length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.llm.common import cut, partitions, slices
from ledgerflow.llm.components import components
from ledgerflow.llm.words import Rolling, scan

SEED = 42
WORDS = 3
BITS = 2
MIN_BYTES = 6
LONG = 24
_KEYS = list(combinations(range(4), 2))

#: The wider signature of keep_one(): five-word shingles. Of two texts with a similarity of 0.8, SHARED bytes agree but for
#: a chance of 1e-4, and one of the KEYS is equal but for 3e-5; what passes is verified on the shingles.
SIMILAR_WORDS, POSITIONS, KEYS, LEADERS = 5, 128, 20, 32
SHARED = round(0.66 * POSITIONS)
#: A member that shares fewer bytes with every leader than this becomes one itself; so many members are compared in one go, and so
#: many are led at a time.
SURE, PIECE, LED = round(0.9 * POSITIONS), 512, 4096
#: Members that meet are compared by so many of their smallest shingle hashes; where a text has more, a similarity of 0.8 is
#: estimated below ESTIMATE with a chance of 1e-4.
BOTTOM, ESTIMATE = 1024, 0.753
_FACTORS = (np.random.default_rng(SEED).integers(1 << 31, 1 << 32, POSITIONS, dtype=np.uint64) | 1).astype(np.uint32)


def simhash(text: str | None) -> int:
    """The fingerprint, unsigned. Words are runs of non-blanks; no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - WORDS + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[s:e], SEED) for s, e in zip(start, end[WORDS - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = np.array([simhash(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(h)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long. Texts are not shuffled."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_hashed, "doc_id long, fp long")


def _masks() -> list[tuple[int, int, list[int]]]:
    """For each posting key: its number, its mask as a signed long, the bits outside it."""
    out = []
    for n, pairs in enumerate(_KEYS):
        bits = {b for p in pairs for b in range(16 * p, 16 * p + 16)}
        mask = sum(1 << b for b in bits)
        out.append((n, mask - (1 << 64) if mask >> 63 else mask, [b for b in range(64) if b not in bits]))
    return out


def links(fps: DataFrame) -> DataFrame:
    """(a, b) with a < b: distinct fingerprints at most two bits apart; of a long list's, enough to connect the same ones."""
    entries = F.array(*[F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for n, mask, _ in _masks()])
    posted = fps.select("fp", F.explode(entries).alias("e")).select("fp", "e.n", "e.key")
    sizes = posted.groupBy("n", "key").agg(F.count("*").alias("size")).where("size > 1")
    posted = cut(posted.join(sizes, ["n", "key"]))

    byte = lambda i: F.struct(F.lit(i).alias("at"), F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)).alias("byte"))
    others = F.coalesce(*[F.when(F.col("n") == n, F.array(*[byte(i) for i in range(8) if i // 2 not in pairs])) for n, pairs in enumerate(_KEYS)])
    postings = posted.where(F.col("size") <= LONG).select("n", "key", "fp", F.explode(others).alias("o")).select("n", "key", "fp", "o.at", "o.byte")
    place = ["n", "key", "at", "byte"]
    meetings = postings.withColumnRenamed("fp", "a").join(postings.withColumnRenamed("fp", "b"), place).where("a < b")
    tallied = meetings.groupBy("n", "key", "a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= MIN_BYTES - 4)
    found = tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")

    def one(b: int) -> int:
        return (1 << b) - (1 << 64) if b == 63 else 1 << b

    near = F.coalesce(*[F.when(F.col("n") == n, F.array(F.lit(0).cast("long"), *[F.lit(one(b)).cast("long") for b in free])) for n, _, free in _masks()])
    values = posted.where(F.col("size") > LONG).select("n", "fp", F.explode(near).alias("change")).select("n", "fp", F.col("fp").bitwiseXOR(F.col("change")).alias("value"))
    heads = values.groupBy("n", "value").agg(F.min("fp").alias("a"), F.count("*").alias("size")).where("size > 1").drop("size")
    starred = values.join(heads, ["n", "value"]).where("a < fp").select("a", F.col("fp").alias("b"))
    return found.union(starred).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of (doc_id, text).

    Null and blank texts have fingerprint zero and link like any other. Rows with equal ids each get a row. component_id
    is the smallest id reachable over links; null ids take part but are never it, unless a component has no other.
    Equal fingerprints count once in the index and are linked by their smallest id. No rows give no rows.
    """
    hashed = cut(fingerprints(docs))
    classes = hashed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("fp")))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "component_id")
    return hashed.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's five-word shingles, sorted; shorter texts have one, of all their words. Blanks
    between words do not matter."""
    _, start, end, roll = scan((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(start):
        return np.zeros(0, np.uint64)
    at = np.arange(max(len(start) - SIMILAR_WORDS + 1, 1))
    return np.unique(Rolling(roll.of(start, end)).of(at, np.minimum(at + SIMILAR_WORDS, len(start))))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of 0.8 or more."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def signature(text: str | None) -> np.ndarray:
    """POSITIONS bytes: at each, the lowest byte of the smallest hash of the text's five-word shingles under a hash of its
    own. Two texts agree at a position with a chance of about their shingles' Jaccard similarity."""
    return _lowest(shingles(text))


def _lowest(found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(POSITIONS, np.uint8)
    h = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 1 << 12):
        np.minimum(out, np.multiply.outer(_FACTORS, h[i : i + (1 << 12)]).min(axis=1), out=out)
    return (out >> np.uint32(5)).astype(np.uint8)


def _class(found: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, g, sig): g is the same for texts with the same shingles."""
    for batch in slices(batches):
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_class(x) for x in sets], pa.int64()), pa.array([_lowest(x).tobytes() for x in sets], pa.binary())], names=["doc_id", "g", "sig"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_class(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["g", "shingles"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
        good = pa.array([alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], names=["a", "b"])


def _of_classes(wanted: DataFrame, signed: DataFrame, docs: DataFrame, run: Callable, column: str) -> DataFrame:
    """(g, column): what run makes of one text of each class in wanted (g). Only texts of these are read again."""
    ids = signed.join(wanted, "g").groupBy("g").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    return texts.mapInArrow(run, f"g long, {column} binary").join(wanted, "g", "left_semi").groupBy("g").agg(F.any_value(column).alias(column))


def verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of classes g those whose shingles are alike. Only texts of classes in pairs are read again."""
    pairs = cut(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("g")).distinct()
    sets = cut(_of_classes(wanted, signed, docs, _shingled, "shingles"))
    sides = pairs.join(sets.select(F.col("g").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("g").alias("b"), F.col("shingles").alias("y")), "b")
    return cut(sides.select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long"))


def _central(sigs: np.ndarray) -> np.ndarray:
    """The rows in the order of how many positions agree with what most rows have there: the middle of a group of copies first."""
    if len(sigs) < 4:
        return np.arange(len(sigs))
    most = np.array([np.bincount(sigs[:, p], minlength=256).argmax() for p in range(sigs.shape[1])], np.uint8)
    return np.argsort(-(sigs == most).sum(axis=1), kind="stable")


def _to_leaders(ids: np.ndarray, sigs: np.ndarray, leaders: list[tuple[int, np.ndarray]]) -> list[tuple]:
    """Links (leader, member) of a piece of a list: each member to the leader that shares most positional bytes, if they are enough.
    A member that shares fewer than SURE with all leaders becomes one, the most central first, up to LEADERS of a piece."""
    best, who = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)

    def ask(leader: int, sig: np.ndarray) -> None:
        shared = (sigs == sig).sum(axis=1)
        shared[ids == leader] = 0
        better = shared > best
        best[better], who[better] = shared[better], leader

    for leader, sig in leaders:
        ask(leader, sig)
    new: list[tuple[int, np.ndarray]] = []
    for i in _central(sigs).tolist():
        if best[i] < SURE:
            new.append((int(ids[i]), sigs[i].copy()))
            ask(*new[-1])
            if len(new) >= LEADERS:
                break
    leaders[:] = (leaders + new)[:LEADERS]
    good = best >= SHARED
    return list(zip(who[good].tolist(), ids[good].tolist(), strict=True))


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists sorted by (n, key), in pieces of LED members; the first leaders of a list go on to its later pieces."""
    held, leaders, ids, sigs = None, [], [], []

    def flush() -> list[tuple]:
        found = _to_leaders(np.array(ids, np.int64), np.frombuffer(b"".join(sigs), np.uint8).reshape(len(ids), -1), leaders) if ids and len(ids) + len(leaders) > 1 else []
        ids.clear()
        sigs.clear()
        return found

    for batch in batches:
        out: list[tuple] = []
        keys = zip(batch.column("n").to_pylist(), batch.column("key").to_pylist(), strict=True)
        for key, doc_id, sig in zip(keys, batch.column("doc_id").to_pylist(), batch.column("sig").to_pylist(), strict=True):
            if key != held or len(ids) >= LED:
                out += flush()
                if key != held:
                    held = key
                    leaders.clear()
            ids.append(doc_id)
            sigs.append(sig)
        yield _pairs(out)
    yield _pairs(flush())


def sketch(found: np.ndarray) -> np.ndarray:
    """The BOTTOM smallest of the shingles' upper 32 bits: all of most texts' shingles."""
    return np.unique((found >> np.uint64(32)).astype("<u4"))[:BOTTOM]


def _near(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which sketches can be of texts alike to one's: by their similarity if they are whole, else by an estimate that misses one
    of 0.8 with a chance of 1e-4."""
    sizes = np.array([len(o) for o in others])
    held = np.concatenate(others) if others else own[:0]
    spot = np.minimum(np.searchsorted(own, held), max(len(own) - 1, 0))
    hit = own[spot] == held if len(own) else np.zeros(len(held), bool)
    both = np.bincount(np.repeat(np.arange(len(others)), sizes)[hit], minlength=len(others))
    out = 5 * both >= 4 * (len(own) + sizes - both)
    for j in np.flatnonzero((sizes == BOTTOM) | (len(own) == BOTTOM)).tolist():
        least = np.union1d(own, others[j])[:BOTTOM]
        out[j] = np.isin(least, own[np.isin(own, others[j])]).sum() >= ESTIMATE * len(least)
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_class(x) for x in sets], pa.int64()), pa.array([sketch(x).tobytes() for x in sets], pa.binary())], names=["g", "top"])


def _compared(rows: list[tuple]) -> list[tuple]:
    """(a, b) with a < b: of the rows (side, doc_id, root, sig, top) of two pieces, or of one, those under different roots that
    share enough positional bytes and whose sketches, if there are any, are near."""
    if len(rows) < 2:
        return []
    side, ids, roots = (np.array(x) for x in list(zip(*rows, strict=True))[:3])
    sigs = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
    tops = [np.frombuffer(r[4], "<u4") if r[4] is not None else None for r in rows]
    out = []
    for i in range(len(rows) - 1):
        near = np.flatnonzero((roots[i + 1 :] != roots[i]) & ((side[i + 1 :] != side[i]) | (side[i] < 0))) + i + 1
        if len(near):
            near = near[(sigs[near] == sigs[i]).sum(axis=1) >= SHARED]
        if len(near) and tops[i] is not None:
            near = near[_near(tops[i], [tops[j] for j in near.tolist()])]
        out += [(min(x, y), max(x, y)) for x, y in ((int(ids[i]), int(ids[j])) for j in near)]
    return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = None, []
    for batch in batches:
        out: list[tuple] = []
        keys = zip(*(batch.column(c).to_pylist() for c in ("n", "key", "p", "q")), strict=True)
        rest = zip(*(batch.column(c).to_pylist() for c in ("side", "doc_id", "root", "sig", "top")), strict=True)
        for key, row in zip(keys, rest, strict=True):
            if key != held:
                out += _compared(rows)
                held, rows = key, []
            rows.append(row)
        yield _pairs(out)
    yield _pairs(_compared(rows))


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def _posted(nodes: DataFrame) -> DataFrame:
    """(n, key, size, doc_id, root) of nodes (doc_id, root, sig): the lists with more than one root. Posting keys are again
    four positional bytes; a pair with a similarity of 0.8 misses all KEYS lists with a chance of 3e-5."""
    at = lambda k: F.conv(F.hex(F.substring("sig", 4 * k + 1, 4)), 16, 10).cast("long")
    entries = F.array(*[F.struct(F.lit(k).alias("n"), at(k).alias("key")) for k in range(KEYS)])
    posted = nodes.select("doc_id", "root", F.explode(entries).alias("e")).select("e.n", "e.key", "doc_id", "root")
    lists = posted.groupBy("n", "key").agg(F.count("*").alias("size"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    return cut(posted.join(lists.select("n", "key", "size"), ["n", "key"]))


def _rooted(signatures: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(doc_id, root, sig) with the roots (node, root) known so far, and otherwise each its own."""
    nodes = signatures.select("doc_id", "sig", F.col("doc_id").alias("root"))
    if roots is None:
        return nodes
    known = roots.select(F.col("node").alias("doc_id"), F.col("root").alias("r"))
    return nodes.join(known, "doc_id", "left").select("doc_id", "sig", F.coalesce("r", "root").alias("root"))


def leading(signatures: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(a, b): candidates between members and leaders of the lists; linear in their length, but not all there are.

    With the links (a, b) known already, lists under one root drop out, and members with most links come first and lead: the
    middle of a group that fills many pieces of a list then leads all of them.
    """
    n = partitions(signatures.sparkSession)
    roots = degrees = None
    if known is not None:
        roots = components(known)
        degrees = known.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("degree"))
    nodes = cut(_rooted(signatures, roots))
    posted = _posted(nodes).join(nodes.select("doc_id", "sig"), "doc_id")
    posted = posted.withColumn("degree", F.lit(0)) if degrees is None else posted.join(degrees, "doc_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ordered = posted.select("n", "key", "degree", "doc_id", "sig").repartition(n, "n", "key").sortWithinPartitions("n", "key", F.desc("degree"), "doc_id")
    return ordered.select("n", "key", "doc_id", "sig").mapInArrow(_led, "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def prefix(size: int) -> int:
    """How many of a sketch's values, in any order that all sketches share, hold one that it has in common with the same part of
    the sketch of every text alike to its own: two sets that share `need` values cannot do so in what is behind them only."""
    need = min((4 * size + 4) // 5, math.ceil(ESTIMATE * BOTTOM))
    return size - need + 1


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, root, top) -> a row for each value of the sketch, with the length of its prefix."""
    for batch in slices(batches):
        tops = [np.frombuffer(x, "<u4") for x in batch.column("top").to_pylist()]
        sizes = np.array([len(t) for t in tops], np.int64)
        spread = lambda column: np.repeat(column.to_numpy(zero_copy_only=False), sizes)  # noqa: B023, E731
        made = [spread(batch.column("doc_id")), spread(batch.column("root")), np.concatenate([*tops, np.zeros(0, "<u4")]).astype(np.int64), np.repeat(np.array([prefix(n) for n in sizes.tolist()], np.int32), sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["doc_id", "root", "value", "prefix"])


def rare_lists(members: DataFrame, tops: DataFrame) -> DataFrame:
    """(n, key, size, doc_id, root) of members (doc_id, root) of lists that are too long to compare: lists of those that share a
    rare value of their sketches (doc_id, top).

    The values of a sketch are put in order of how many members have them, rarest first, and only its prefix is entered. What
    very many members share, such as a license or the frame of a page, comes last and is in no prefix, unless there is hardly
    anything else; so the lists of unlike texts are short, whatever else they have in common. n is -1 for these lists.
    """
    flat = cut(members.join(tops, "doc_id").select("doc_id", "root", "top").mapInArrow(_values, "doc_id long, root long, value long, prefix int"))
    held = flat.groupBy("value").agg(F.count("*").alias("held"), F.min("root").alias("least"), F.max("root").alias("most"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("held", "value"))
    entered = cut(flat.join(held, "value").withColumn("place", order).where("place <= prefix and least <> most").select("value", "doc_id", "root"))
    lists = entered.groupBy("value").agg(F.count("*").alias("size"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    return entered.join(lists.select("value", "size"), "value").select(F.lit(-1).alias("n"), F.col("value").alias("key"), "size", "doc_id", "root")


def dealt(lists: DataFrame) -> DataFrame:
    """The members of lists (n, key, size, doc_id, …) in pieces of about PIECE, each two pieces of a list in a group (p, q) of
    their own; side tells the piece, or is -1 where a piece meets itself. Lists of one piece, as nearly all are, cost a row a member."""
    own = F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int")
    rows = lists.withColumn("pieces", F.ceil(F.col("size") / PIECE).cast("int")).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))
    return rows.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other"), "side": side}).drop("pieces", "own", "other")


def similar(signatures: DataFrame, roots: DataFrame | None = None, sketches: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b) with a < b: all documents that meet in a list and share SHARED of their positional bytes, without those that
    have the same root in roots (node, root) already, and those whose sketches are not near. sketches gives (doc_id, top) of the
    documents (doc_id) that are in lists, so that texts that are alike, but not enough, are told apart where they meet.

    Lists under one root drop out. Members of lists longer than PIECE meet in the lists of their rare values instead. Without
    sketches, and where a rare value is still that of very many, the pieces of a list meet two by two.
    """
    n = partitions(signatures.sparkSession)
    nodes = cut(_rooted(signatures, roots))
    posted = _posted(nodes)
    if sketches:
        tops = sketches(posted.select("doc_id").distinct())
        members = posted.where(F.col("size") > PIECE).select("doc_id", "root").distinct()
        lists = posted.where(F.col("size") <= PIECE).select("n", "key", "size", "doc_id", "root").unionByName(rare_lists(members, tops))
        lists = lists.join(tops, "doc_id")
    else:
        lists = posted.withColumn("top", F.lit(None).cast("binary"))
    rows = dealt(lists.join(nodes.select("doc_id", "sig"), "doc_id")).select("n", "key", "p", "q", "side", "doc_id", "root", "sig", "top")
    groups = rows.repartition(n, "n", "key", "p", "q").sortWithinPartitions("n", "key", "p", "q", "doc_id")
    return groups.mapInArrow(_met, "a long, b long").distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but the one with the smallest id of each near-duplicate group.

    Groups are connected over two kinds of links: those of near_duplicates(), and a similarity of 0.8 or more on five-word
    shingles. An index of POSITIONS positional bytes finds candidates, and their shingles decide; first those between the
    leaders and members of long lists, then all between documents that are not in one group yet. Blank texts are alike.
    Rows with equal ids stay or go together; rows without an id stay.
    """
    found = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    found = cut(found)
    signed = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(_signed, "doc_id long, g long, sig binary"))
    classes = cut(signed.groupBy("g").agg(F.min("doc_id").alias("least"), F.any_value("sig").alias("sig")))
    signatures, least = classes.select(F.col("g").alias("doc_id"), "sig"), classes.select("g", "least")
    led = verified(leading(signatures), signed, docs)
    led = led.union(verified(leading(signatures, led), signed, docs))
    tops = lambda ids: cut(_of_classes(ids.toDF("g"), signed, docs, _sketched, "top")).toDF("doc_id", "top")
    pairs = led.union(verified(similar(signatures, components(led), tops), signed, docs))
    near = pairs.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = signed.join(least, "g").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    gone = components(found.union(near).union(same)).where("node <> root").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti")
