"""Exports of many files as one: a data sink with a two-phase commit.

    spark.dataSource.register(ExportSink)
    groups.write.format("export").mode("append").save("s3://bucket/exports")

A row is a group of files that belong together, such as a package's JSON and Markdown. Tasks compare each group with what is
there and stage what is new; the driver looks at the outcome of all groups and decides once. If one file is there with
other bytes, or only a part of a group is there, nothing is exported. Otherwise the decision is written down, in one
step, and then the staged files get their names; an export that dies after the decision is finished by the next one.
Each task writes down the names that it has staged; export() and read() move and read the files in tasks.
"""

from __future__ import annotations

import json
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ledgerflow.functions import text
from ledgerflow.sources import sinks
from ledgerflow.sources.feed_source import opened
from ledgerflow.sources.files import Refused

SCHEMA = "files array<struct<name: string, content: binary>>"
STAGED, DECISION, RESULT, NAMES = "_export-", "DECISION", "_export-results", "names"
# The payloads of packages, so far as Markdown shows them.
MOCK = "package_id string, story struct<id: string, title: string>, sources array<struct<canonical_url: string, content_hash: string, id: string, published_at: string, published_at_raw: string, title: string>>, claims array<struct<id: string, qualifier: string, source_ids: array<string>, status: string, text: string, type: string>>"
REAL = (
    "package_id string, story_id string, source_id string, prompt_version string, working_title string, editorial_format string, publication_verdict string, one_sentence_fact string, why_it_matters string, editorial_angle string, "
    "claims array<struct<claim_id: string, text: string, status: string, confidence: string, evidence_source_id: string, use_in_script: boolean, qualification: string>>, limitations array<string>, demonstration_plan array<string>, source_references array<struct<source_id: string, canonical_url: string>>, "
    "generator struct<provider: string, model: string, api_format: string, thinking: string, temperature: double>, usage_metadata struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint, cache_hit_tokens: bigint, repair_used: boolean>"
)
#: So many of the names that stand against an export are told.
TOLD = 5
#: So many files are looked up at once, and so many bytes are read before they are passed on.
AT_ONCE, MOST_BYTES = 1000, 8 << 20


@dataclass
class Found:
    """How many files stand against an export, and some of their names."""

    n: int = 0
    told: list[str] = field(default_factory=list)

    def add(self, names: list[str]) -> None:
        self.n += len(names)
        self.told = sorted([*self.told, *names])[:TOLD]


@dataclass
class Staged(WriterCommitMessage):
    """What one task has found and staged: the folder of its staged files, how many, and what stands against the export."""

    folder: str
    written: int = 0
    unchanged: int = 0
    conflicts: Found = field(default_factory=Found)
    partial: Found = field(default_factory=Found)
    invalid: Found = field(default_factory=Found)


def valid_name(name: str | None) -> bool:
    """A relative path without steps upwards, and not one of the sink's own."""
    return bool(name) and "\\" not in name and all(p not in ("", ".", "..") and not p.startswith(STAGED) for p in name.split("/"))


def _there(store: arrow_fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type == arrow_fs.FileType.File


def _read(store: arrow_fs.FileSystem, path: str) -> bytes | None:
    if not _there(store, path):
        return None
    with store.open_input_stream(path) as f:
        return f.read()


def _write(store: arrow_fs.FileSystem, path: str, data: bytes) -> None:
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)


def _files(store: arrow_fs.FileSystem, paths: list[str]) -> list[bool]:
    """For each path, whether a file is there."""
    return [i.type == arrow_fs.FileType.File for i in store.get_file_info(paths)]


def _chunks(store: arrow_fs.FileSystem, staged: str, folder: str) -> Iterator[list[tuple[str, bool]]]:
    """The names that a task has staged, each with whether it is new, a thousand at a time."""
    with store.open_input_stream(f"{staged}/{NAMES}/{folder}") as f:
        held: list[tuple[str, bool]] = []
        rest = b""
        while data := f.read(1 << 20):
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                _, name, new = json.loads(line)
                held.append((name, new))
                if len(held) == AT_ONCE:
                    yield held
                    held = []
        if held:
            yield held


def _move(store: arrow_fs.FileSystem, root: str, staged: str, files: list[tuple[str, str]], made: set[str]) -> None:
    """Gives staged files (folder, name) their names; those that have them already are left. made: folders that are there."""
    for (folder, name), there in zip(files, _files(store, [f"{staged}/{folder}/{name}" for folder, name in files]), strict=True):
        if there:
            target = f"{root}/{name}"
            if (parent := target.rpartition("/")[0]) not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            store.move(f"{staged}/{folder}/{name}", target)


def finish(store: arrow_fs.FileSystem, root: str, staged: str) -> None:
    """Gives all staged files of a decided export their names. The decision has the names, or null if the task wrote them down."""
    made: set[str] = set()
    for folder, names in json.loads(_read(store, f"{staged}/{DECISION}")).items():
        for chunk in [[(n, True) for n in names]] if names is not None else _chunks(store, staged, folder):
            _move(store, root, staged, [(folder, n) for n, _ in chunk], made)
    store.delete_dir(staged)


def recover(path: str) -> int:
    """Finishes the exports into a folder that were decided but not finished: their number."""
    store, root, _ = opened(path)
    if store.get_file_info(root).type != arrow_fs.FileType.Directory:
        return 0
    open_ = [i.path for i in store.get_file_info(arrow_fs.FileSelector(root)) if i.base_name.startswith(STAGED) and _there(store, f"{i.path}/{DECISION}")]
    for staged in open_:
        finish(store, root, staged)
    return len(open_)


class ExportWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.force = options["path"], options.get("force", "false").lower() == "true"
        self.job, self.finishes = options.get("job") or uuid.uuid4().hex, options.get("finish", "true").lower() == "true"
        if not self.path:
            raise ValueError("the export sink needs a path")
        recover(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root, _ = opened(self.path)
        out, made = Staged(uuid.uuid4().hex), set()
        names = None
        for batch in iterator:
            for files in (x for part in text.slices([batch]) for x in part.column(0).to_pylist()):
                new = self._group(store, root, {f["name"]: f["content"] or b"" for f in files or [] if f}, out, len(files or []), made)
                if new and names is None:
                    store.create_dir(f"{root}/{STAGED}{self.job}/{NAMES}", recursive=True)
                    names = store.open_output_stream(f"{root}/{STAGED}{self.job}/{NAMES}/{out.folder}")
                for name, is_new in new:
                    names.write(json.dumps([out.folder, name, is_new]).encode() + b"\n")
        if names is not None:
            names.close()
        return out

    def _group(self, store: arrow_fs.FileSystem, root: str, files: dict[str, bytes], out: Staged, given: int, made: set[str]) -> list[tuple[str, bool]]:
        """Stages what is to be written of a group: its names, each with whether it is new."""
        bad = [str(n) for n in files if not valid_name(n)]
        if bad or len(files) != given:
            out.invalid.add(bad or ["a name is twice in a group"])
            return []
        there = {n: _read(store, f"{root}/{n}") if known else None for n, known in zip(files, _files(store, [f"{root}/{n}" for n in files]), strict=True)}
        known = [n for n in files if there[n] is not None]
        same = [n for n in known if there[n] == files[n]]
        if len(same) < len(files) and not self.force and known:
            (out.conflicts if len(same) < len(known) else out.partial).add([n for n in known if len(same) == len(known) or n not in same])
        out.unchanged += len(same)
        todo = [n for n in files if n not in same]
        for n in todo:
            path = f"{root}/{STAGED}{self.job}/{out.folder}/{n}"
            if (parent := path.rpartition("/")[0]) not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            with store.open_output_stream(path) as f:
                f.write(files[n])
        out.written += len(todo)
        return [(n, n not in known) for n in todo]

    def commit(self, messages: list[Staged | None]) -> None:
        """Counts reach the driver, which reads the names a thousand at a time and keeps eight bytes of each."""
        store, root, _ = opened(self.path)
        staged, found = f"{root}/{STAGED}{self.job}", [m for m in messages if m is not None]
        try:
            self._check(store, root, staged, found)
        except Refused:
            self.abort(messages)
            raise
        written = sum(m.written for m in found)
        if written:
            _write(store, f"{staged}/{DECISION}.tmp", json.dumps({m.folder: None for m in found if m.written}).encode())
            store.move(f"{staged}/{DECISION}.tmp", f"{staged}/{DECISION}")
            if self.finishes:
                finish(store, root, staged)
        _write(store, f"{root}/{RESULT}/{self.job}", json.dumps({"written": written, "unchanged": sum(m.unchanged for m in found)}).encode())

    def _check(self, store: arrow_fs.FileSystem, root: str, staged: str, found: list[Staged]) -> None:
        invalid, conflicts, partial = Found(), Found(), Found()
        for m in found:
            for of_all, of_task in ((invalid, m.invalid), (conflicts, m.conflicts), (partial, m.partial)):
                of_all.add(of_task.told)
                of_all.n += of_task.n - len(of_task.told)
        hashes = array("q")
        for m in found:
            for chunk in _chunks(store, staged, m.folder) if m.written else ():
                hashes.extend(hash(n) for n, _ in chunk)
                new = [] if self.force else [n for n, is_new in chunk if is_new]
                conflicts.add([n for n, late in zip(new, _files(store, [f"{root}/{n}" for n in new]), strict=True) if late])
        ordered = np.sort(np.frombuffer(hashes, np.int64)) if hashes else np.zeros(0, np.int64)
        suspects = set(ordered[1:][ordered[1:] == ordered[:-1]].tolist())
        if suspects:
            seen: set[str] = set()
            for m in found:
                for chunk in _chunks(store, staged, m.folder) if m.written else ():
                    conflicts.add([n for n, _ in chunk if hash(n) in suspects and (n in seen or seen.add(n))])
        for code, what in (("E_EXPORT_PATH", invalid), ("E_EXPORT_CONFLICT", conflicts), ("E_EXPORT_PARTIAL", partial)):
            if what.n:
                raise Refused(code, f"{code}: nothing is exported because of {what.n} files, such as {', '.join(what.told)}")

    def abort(self, messages: list[Staged | None]) -> None:
        store, root, _ = opened(self.path)
        staged = f"{root}/{STAGED}{self.job}"
        if store.get_file_info(staged).type == arrow_fs.FileType.Directory and not _there(store, f"{staged}/{DECISION}"):
            store.delete_dir(staged)


class ExportSink(DataSource):
    """Format "export". Options: path, force (other bytes and parts of groups are replaced)."""

    @classmethod
    def name(cls) -> str:
        return "export"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: object, overwrite: bool) -> ExportWriter:
        if schema.simpleString() != "struct<files:array<struct<name:string,content:binary>>>":
            raise ValueError(f"an export takes {SCHEMA}")
        return ExportWriter(dict(self.options))


def package_groups(packages: DataFrame) -> DataFrame:
    """Stored packages (package_id, generator_name, payload_json) -> (files): each one's JSON and Markdown."""
    mock, real = F.from_json("payload_json", MOCK), F.from_json("payload_json", REAL)
    page = F.when(F.col("generator_name") == "mock", sinks.mock_markdown(F.col("_mock"))).otherwise(sinks.provider_markdown(F.col("_real")))
    data = text.mapped(lambda payload: sinks.package_json(payload).decode(), F.col("payload_json"))
    file = lambda ending, content: F.struct(F.concat("package_id", F.lit(ending)).alias("name"), F.encode(content, "UTF-8").alias("content"))
    return packages.withColumns({"_mock": mock, "_real": real, "_json": data}).select(F.array(file(".json", F.col("_json")), file(".md", page)).alias("files"))


def _moved(path: str, job: str):
    """Gives the files of lines of names their names, in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root, _ = opened(path)
        made: set[str] = set()
        for batch in text.slices(batches, AT_ONCE):
            _move(store, root, f"{root}/{STAGED}{job}", [tuple(json.loads(x)[:2]) for x in batch.column(0).to_pylist()], made)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return run


def read(names: DataFrame, path: str) -> DataFrame:
    """Names of exported files (name) -> (name, length, content) of those that are there: no folder is listed, and each task reads its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root, _ = opened(path)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array([len(d) for _, d in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], names=["name", "length", "content"])
        held: list[tuple[str, bytes]] = []
        size = 0
        for batch in text.slices(batches, AT_ONCE):
            for name in batch.column(0).to_pylist():
                data = _read(store, f"{root}/{name}")
                if data is not None:
                    held.append((name, data))
                    size += len(data)
                if size > MOST_BYTES:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    return names.select("name").repartition("name").mapInArrow(run, "name string, length long, content binary")


def export(groups: DataFrame, path: str, force: bool = False) -> tuple[int, int]:
    """Exports all groups (files) or none: (written, unchanged). Raises Refused with the code of what stands against it."""
    spark = groups.sparkSession
    spark.dataSource.register(ExportSink)
    job = uuid.uuid4().hex
    try:
        groups.select("files").write.format("export").options(path=path, force=str(force).lower(), job=job, finish="false").mode("append").save()
    except Exception as e:
        code = next((c for c in ("E_EXPORT_PATH", "E_EXPORT_CONFLICT", "E_EXPORT_PARTIAL") if f"{c}: nothing is exported" in str(e)), None)
        if code is None:
            raise
        raise Refused(code, str(e)[str(e).index(f"{code}: ") :].split("\n")[0]) from None
    store, root, before = opened(path)
    staged = f"{root}/{STAGED}{job}"
    if _there(store, f"{staged}/{DECISION}"):
        spark.read.text(f"{before}{staged}/{NAMES}").mapInArrow(_moved(path, job), "n long").agg(F.sum("n")).collect()
        store.delete_dir(staged)
    counts = json.loads(_read(store, f"{root}/{RESULT}/{job}"))
    store.delete_file(f"{root}/{RESULT}/{job}")
    return counts["written"], counts["unchanged"]
