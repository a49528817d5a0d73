"""Provider answers as a stream: one answer, at most one repair, and nothing asked for a story whose package is stored.

The rules of an answer are columns (packages.draft_errors); what is left for each story is a small machine, kept as keyed
state. It takes answers in any order and as often as they come: a repair that arrives before the first answer waits for
it, and an answer that was taken already changes nothing. So a replayed or a late stream ends as a batch does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerflow.operators import packages
from ledgerflow.operators.store import Store

STATE = "first string, second string, outcome string"
OUTPUT = "story_id string, action string, package_id string, input_fingerprint string, content string, repair_used boolean, error_code string"
ANSWER = ("package_id", "input_fingerprint", "content", "error")
#: The state store that this needs, and its name in the session.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SAVE, REPAIR, FAIL, REUSE = "SAVE", "REPAIR", "FAIL", "REUSE"


def judged(answers: DataFrame, sources: DataFrame, prompt_sha256: str) -> DataFrame:
    """answers (story_id, attempt, finish_reason, content) -> (story_id, attempt, package_id, input_fingerprint, content, error).

    sources are those that were asked about, a table that does not stream; answers about other stories are left out.
    """
    rows = packages.judged_answers(answers, sources, prompt_sha256)
    return rows.select("story_id", F.col("attempt").cast("int").alias("attempt"), "package_id", "input_fingerprint", "content", "error")


def decide(first: dict | None, second: dict | None) -> tuple[str | None, dict]:
    """What follows from the answers known so far, and the answer it follows from. Nothing without a first answer."""
    if first is None:
        return None, {}
    if first["error"] is None:
        return SAVE, first
    if second is None:
        return REPAIR, first
    return (SAVE if second["error"] is None else FAIL), second


class Machine(StatefulProcessor):
    """The machine of one story. Its state is the first answer, the second one, and what came of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("answers", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else (None, None, None)
        first, second, outcome = (json.loads(held[0]) if held[0] else None, json.loads(held[1]) if held[1] else None, held[2])
        out = []
        for row in sorted(rows, key=lambda r: (r.attempt, r.content or "")):
            if outcome == REUSE:
                continue
            answer = {c: getattr(row, c) for c in ANSWER}
            if row.attempt == 1 and first is None:
                first = answer
            elif row.attempt == 2 and second is None:
                second = answer
        action, by = decide(first, second)
        if outcome not in (SAVE, FAIL, REUSE) and action is not None and action != outcome:
            outcome = action
            saved = {c: by[c] if action == SAVE else None for c in ANSWER[:3]}
            out.append(Row(story_id=key[0], action=action, **saved, repair_used=by is second, error_code=by["error"]))
        self.state.update((json.dumps(first) if first else None, json.dumps(second) if second else None, outcome))
        yield from out

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:
        """A story whose package is stored: whatever is answered, it is used again."""
        self.state.update((None, None, REUSE))

    def close(self) -> None:
        pass


def outcomes(answers: DataFrame, sources: DataFrame, prompt_sha256: str, stored: DataFrame | None = None) -> DataFrame:
    """What each answer of a stream leads to: SAVE with the package's draft, REPAIR or FAIL with the error.

    A story gives at most one SAVE or FAIL, and at most one REPAIR before. stored (story_id, …): stories with a package of this
    generator, which give nothing. The stream must run with PROVIDER as state store. If an attempt is answered twice, the one that
    arrives first counts.
    """
    rows = judged(answers, sources, prompt_sha256).where("attempt in (1, 2)")
    known = stored.select("story_id").distinct().groupBy("story_id") if stored is not None else None
    return rows.groupBy("story_id").transformWithState(statefulProcessor=Machine(), outputStructType=OUTPUT, outputMode="Append", timeMode="None", initialState=known)


def start(answers: DataFrame, sources: DataFrame, prompt_sha256: str, store: Store, checkpoint: str, failed: str, built_at: str) -> StreamingQuery:
    """A query that takes the answers that are there and ends: packages go to the store, failures and requests for a repair to a
    table, a folder for each batch. Stories with a package of the provider in the store when the query first starts give nothing."""
    known = store.read("story_packages").where(F.col("generator_name") == "deepseek").select("story_id")

    def merge(batch: DataFrame, number: int) -> None:
        saved = batch.where(F.col("action") == SAVE).withColumn("draft", F.from_json("content", packages.DRAFT))
        store.save_packages(packages.provider_packages(saved, built_at))
        batch.where(F.col("action") != SAVE).write.mode("overwrite").parquet(f"{failed}/batch={number}")

    made = outcomes(answers, sources, prompt_sha256, known)
    return made.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
