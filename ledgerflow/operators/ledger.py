"""Runs as an append-only log: what each event did, the state after any of them, and the archive of replaced runs.

An experiment has its slots done in order, and at most one completed run may be declared invalid and done again. Its state
is how many slots are completed, which of them is open again, and whether that has happened: few states, whatever the
log's length. An event is a function from state to state, and such functions can be composed. So the log is cut into ranges
of events, each range's function is composed in one task, the few functions of an experiment give the state before each
range, and each range is then replayed from there. One experiment may hold most of the events.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.operators.runs import REASON_MOST
from ledgerflow.session import cut

SLOTS = 6
COMPLETED, INVALIDATED = "completed", "invalidated"
STATE = "accepted boolean, error_code string, completed int, pending int, replaced boolean"


class State(NamedTuple):
    """done: slots completed at some time, in order; open: the slot of them to be done again, or 0; replaced: whether one was."""

    done: int = 0
    open: int = 0
    replaced: bool = False

    def pending(self, slots: int) -> int | None:
        """The slot whose run is next; none if all are completed."""
        return self.open or (self.done + 1 if self.done < slots else None)


def step(state: State, kind: str | None, position: int | None, reason_ok: bool, slots: int = SLOTS) -> tuple[State, str | None]:
    """The state after an event, and why it was refused; a refused event changes nothing."""
    if position is None or not 1 <= position <= slots:
        return state, "PATH_UNSAFE"
    if kind == COMPLETED:
        if position != state.pending(slots):
            return state, "RUN_ORDER_VIOLATION"
        return (state._replace(open=0) if state.open else state._replace(done=state.done + 1)), None
    if kind != INVALIDATED:
        return state, "HUMAN_INPUT_INVALID"
    if not reason_ok:
        return state, "HUMAN_INPUT_INVALID"
    if state.replaced:
        return state, "MORE_THAN_ONE_INVALID_REPLACEMENT"
    if position > state.done or position == state.open:
        return state, "RUN_NOT_COMPLETE"
    return State(state.done, position, True), None


def states(slots: int = SLOTS) -> list[State]:
    """All states there are, the first one at the beginning."""
    return [State(d, o, r) for d in range(slots + 1) for o in range(d + 1) for r in (False, True) if not o or r]


def _composed(slots: int):
    """Sorted events -> (experiment, range, to): the number of the state after a range for each one before it."""
    every = states(slots)
    number = {s: i for i, s in enumerate(every)}
    moves: dict[tuple, list[int]] = {}

    def move(event: tuple) -> list[int]:
        if event not in moves:
            moves[event] = [number[step(s, *event, slots)[0]] for s in every]
        return moves[event]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, to = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([held[1]], pa.int32()), pa.array([to], pa.list_(pa.int32()))], names=["experiment", "range", "to"])

        for batch in batches:
            for e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if e[:2] != held:
                    if held is not None:
                        yield row()
                    held, to = e[:2], list(range(len(every)))
                m = move(e[2:])
                to = [m[i] for i in to]
        if held is not None:
            yield row()

    return run


def _replayed(slots: int):
    """Sorted events with the state before their range -> each event's outcome."""
    every = states(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, every[0]
        for batch in batches:
            out: list[tuple] = []
            for experiment, range_, seq, kind, position, ok, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (experiment, range_) != held:
                    held, state = (experiment, range_), every[start]
                state, error = step(state, kind, position, ok, slots)
                out.append((experiment, seq, error is None, error, state.done - bool(state.open), state.pending(slots), state.replaced))
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=["experiment", "seq", "accepted", "error_code", "completed", "pending", "replaced"])

    return run


def replay(events: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Events (experiment, seq, kind, position, reason) -> (experiment, seq, accepted, error_code, completed, pending, replaced).

    seq orders an experiment's events and is unique in it. The last four columns are the state after the event, so the state
    as of any moment is that of the last event before it. Events without an experiment belong to one of their own.
    """
    n = events.sparkSession.conf.get("spark.sql.shuffle.partitions")
    reason = F.trim(F.coalesce("reason", F.lit("")))
    known = events.select(F.col("experiment").cast("string").alias("experiment"), F.col("seq").cast("long").alias("seq"), "kind", F.col("position").cast("int").alias("position"), ((reason != "") & (F.length("reason") <= REASON_MOST)).alias("ok"))
    ranged = cut(known.repartitionByRange("experiment", "seq").withColumn("range", F.spark_partition_id()).sortWithinPartitions("experiment", "seq"))
    inputs = ranged.select("experiment", "range", "kind", "position", "ok", "seq")
    by_range = inputs.repartition(int(n), "experiment", "range").sortWithinPartitions("experiment", "range", "seq").select("experiment", "range", "kind", "position", "ok")
    functions = cut(by_range.mapInArrow(_composed(slots), "experiment string, range int, to array<int>"))
    # the state before a range: the functions of the experiment's ranges before it, applied to the first state
    before = F.collect_list("to").over(Window.partitionBy("experiment").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = functions.select("experiment", "range", F.aggregate(before, F.lit(0), lambda s, to: F.get(to, s)).alias("start"))
    r, s = ranged.alias("r"), starts.alias("s")
    joined = r.join(s, F.col("r.experiment").eqNullSafe(F.col("s.experiment")) & (F.col("r.range") == F.col("s.range"))).select("r.experiment", "r.range", "r.seq", "r.kind", "r.position", "r.ok", "s.start")
    sorted_ = joined.repartition(int(n), "experiment", "range").sortWithinPartitions("experiment", "range", "seq")
    return sorted_.mapInArrow(_replayed(slots), f"experiment string, seq long, {STATE}")


def as_of(events: DataFrame, moments: DataFrame, slots: int = SLOTS) -> DataFrame:
    """moments (experiment, seq) -> (experiment, seq, completed, pending, replaced): the state after the last event up to each.

    Moments are replayed with the events, as such that change nothing and come after an event of the same seq.
    """
    columns = ["experiment", "seq", "kind", "position", "reason"]
    asked = moments.select("experiment", (2 * F.col("seq") + 1).alias("seq"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("position"), F.lit("").alias("reason")).distinct()
    both = events.select(*columns).withColumn("seq", 2 * F.col("seq")).unionByName(asked)
    return replay(both, slots).where("seq % 2 <> 0").select("experiment", F.floor((F.col("seq") - 1) / 2).cast("long").alias("seq"), "completed", "pending", "replaced")


def archive(events: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The replaced runs: (experiment, position, invalidated_seq, reason, completed_seq, output_sha256, replaced_seq).

    completed_seq and output_sha256 are those of the run that was declared invalid, replaced_seq that of the run in its
    place, or null. There is at most one for each experiment. events: as for replay(), with output_sha256.
    """
    outcome = replay(events, slots).where("accepted").select("experiment", "seq")
    rows = events.withColumns({"experiment": F.col("experiment").cast("string"), "seq": F.col("seq").cast("long")}).alias("x")
    good = cut(rows.join(outcome.alias("o"), F.col("x.experiment").eqNullSafe(F.col("o.experiment")) & (F.col("x.seq") == F.col("o.seq"))).select("x.*"))
    invalid = good.where(F.col("kind") == INVALIDATED).select("experiment", "position", F.col("seq").alias("invalidated_seq"), F.trim("reason").alias("reason")).alias("i")
    done = good.where(F.col("kind") == COMPLETED).select("experiment", "position", "seq", "output_sha256").alias("d")
    runs = invalid.join(done, F.col("i.experiment").eqNullSafe(F.col("d.experiment")) & (F.col("i.position") == F.col("d.position")), "left")
    first, later = F.col("d.seq") < F.col("i.invalidated_seq"), F.col("d.seq") > F.col("i.invalidated_seq")
    return runs.groupBy("i.experiment", "i.position", "i.invalidated_seq", "i.reason").agg(F.max(F.when(first, F.col("d.seq"))).alias("completed_seq"), F.max(F.when(first, F.col("d.output_sha256"))).alias("output_sha256"), F.min(F.when(later, F.col("d.seq"))).alias("replaced_seq"))
