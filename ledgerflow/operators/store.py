"""The store of sources, stories and packages: Parquet tables, idempotent merges, conflict and lineage checks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple, TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow import schemas
from ledgerflow.functions import identity

T = TypeVar("T")

#: Columns in which two snapshots of one identity must agree.
IDENTITY = ("canonical_url", "title", "summary_text", "published_at", "published_at_raw", "content_hash", "source_name")
PACKAGE_IDENTITY = ("package_id", "story_id", "schema_version", "generator_name", "generator_version", "input_fingerprint")


#: How often a batch is checked again because another writer's commit came between its checks and its own.
ATTEMPTS = 20
#: Set on files that object stores write only if there is none of that name.
CONDITIONAL = "fs.option.create.conditional.overwrite"


class StoreError(Exception):
    """A rule of the store that a batch breaks."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


class Overtaken(StoreError):
    """Another commit changed a table that the refused one was checked against."""

    def __init__(self) -> None:
        super().__init__("E_DB_WRITE", "another writer has committed")


class Snapshot(NamedTuple):
    """One commit: its number and the parts of each table."""

    number: int
    parts: dict[str, list[str]]


def differs(left: str, right: str, columns: tuple[str, ...]) -> Column:
    """Null-safe inequality in any of the columns."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def first_wins(batch: DataFrame, key: str = "id", position: str = "position") -> DataFrame:
    """One row of each key, the first in batch order."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(position))
    return batch.withColumn("_first", first).where("_first = 1").drop("_first")


def new_rows(batch: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """The first row of each key that the store does not have."""
    return first_wins(batch.join(existing.select(key), key, "left_anti"), key)


def conflicts(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of the batch whose id the store or an earlier row has with another content."""
    first = first_wins(batch)
    stored = existing.select("id", *IDENTITY)
    base = first.join(stored.select("id"), "id", "left_anti").select("id", *IDENTITY).unionByName(stored)
    return batch.alias("b").join(base.alias("e"), F.col("b.id") == F.col("e.id")).where(differs("b", "e", IDENTITY)).select("b.*")


def stories_of(sources: DataFrame) -> DataFrame:
    return sources.select(identity.story_id(F.col("id")).alias("id"), F.col("id").alias("primary_source_id"))


def story_conflicts(batch: DataFrame, existing_sources: DataFrame, stories: DataFrame) -> DataFrame:
    """Stored sources of the batch whose story is missing or is another; a missing story is not made again."""
    known = batch.join(existing_sources.select("id"), "id", "left_semi").select(F.col("id").alias("source")).distinct()
    found = known.join(stories.select(F.col("primary_source_id").alias("source"), F.col("id").alias("story")), "source", "left")
    return found.where(~F.col("story").eqNullSafe(identity.story_id(F.col("source"))))


def invalid_identities(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose hash or id does not follow from their content."""
    h = identity.content_hash(*[F.col(c) for c in ("title", "summary_text", "published_at", "published_at_raw")])
    return snapshots.where(~(F.col("content_hash").eqNullSafe(h) & F.col("id").eqNullSafe(identity.source_id(F.col("canonical_url"), h))))


def merge_counts(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """One row (created, unchanged)."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("position")) == 1
    marked = batch.join(existing.select("id", F.lit(True).alias("known")), "id", "left").select((F.col("known").isNull() & first).alias("new"))
    return marked.agg(F.count_if("new").alias("created"), F.count_if(~F.col("new")).alias("unchanged"))


def list_stories(stories: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, primary_source_id, title) in the order of ids."""
    titles = sources.select(F.col("id").alias("primary_source_id"), "title")
    return stories.join(titles, "primary_source_id").select("id", "primary_source_id", "title").orderBy("id")


def lineage_errors(stories: DataFrame, sources: DataFrame) -> DataFrame:
    """(story_id, error_code): null, or the first check that fails: story's source, its hash, its id, the story's id."""
    s = stories.select(F.col("id").alias("story_id"), "primary_source_id").join(sources.withColumnRenamed("id", "source_id"), F.col("primary_source_id") == F.col("source_id"), "left")
    h = identity.content_hash(*[F.col(c) for c in ("title", "summary_text", "published_at", "published_at_raw")])
    code = (
        F.when(F.col("source_id").isNull(), "SOURCE_MISSING").when(~h.eqNullSafe(F.col("content_hash")), "CONTENT_HASH")
        .when(~F.col("source_id").eqNullSafe(identity.source_id(F.col("canonical_url"), h)), "SOURCE_ID").when(~F.col("story_id").eqNullSafe(identity.story_id(F.col("source_id"))), "STORY_ID")
    )
    return s.select("story_id", code.alias("error_code"))


def package_conflicts(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of (story_id, generator_name) that the store has with other inputs.

    A provider's stored package with the same inputs stays, whatever the new payload says; a mock's payload must agree.
    """
    key = ["story_id", "generator_name"]
    b, e = batch.alias("b"), existing.alias("e")
    same = b.join(e, [F.col(f"b.{k}") == F.col(f"e.{k}") for k in key])
    payload = (F.col("b.generator_name") == "mock") & ~F.col("b.payload_json").eqNullSafe(F.col("e.payload_json"))
    return same.where(differs("b", "e", PACKAGE_IDENTITY) | payload).select("b.*")


def cardinality(packages: DataFrame, stories: DataFrame) -> DataFrame:
    """(story_id, n, state): E_PACKAGE_NOT_BUILT, E_PACKAGE_AMBIGUOUS or OK."""
    n = packages.groupBy("story_id").agg(F.count("*").alias("n"))
    out = stories.select(F.col("id").alias("story_id")).join(n, "story_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("state", F.when(F.col("n") == 0, "E_PACKAGE_NOT_BUILT").when(F.col("n") > 1, "E_PACKAGE_AMBIGUOUS").otherwise("OK"))


class Store:
    """A folder with Parquet parts for each table. A commit adds parts, or replaces a table's, and then names the parts of all
    tables in one small file; readers see a commit whole or not at all, and old rows are not written again.

    Commits are serialisable. A batch is checked against one commit, and its own names that commit: if another came between
    and changed a table that the checks read, nothing is committed and the batch is checked again on the newer one. Commits
    that changed other tables only do not disturb it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def snapshot(self) -> Snapshot:
        """The newest commit; number 0 without tables if there is none."""
        fs, path = self._fs()
        folder = path(f"{self.path}/_commits")
        numbers = [int(n) for s in (fs.listStatus(folder) if fs.exists(folder) else []) if (n := s.getPath().getName()).isdigit()]
        if not numbers:
            return Snapshot(0, {})
        return Snapshot(max(numbers), json.loads(self.spark.read.text(f"{self.path}/_commits/{max(numbers)}").first()[0]))

    def init(self) -> bool:
        """Makes empty tables; false if they are there and as they should be. Of several that start at once one makes them."""
        at = self.snapshot()
        if not at.parts:
            empty = {n: self.spark.createDataFrame([(1, schemas.SCHEMA_VERSION)] if n == "schema_meta" else [], s) for n, s in schemas.TABLES.items()}
            try:
                self.commit(empty, at=at, reads=tuple(empty))
                return True
            except Overtaken:
                pass
        self.check()
        return False

    def check(self, at: Snapshot | None = None) -> None:
        at = at or self.snapshot()
        if not at.parts:
            raise StoreError("E_DB_NOT_INITIALIZED", "the store is not initialised")
        if set(at.parts) != set(schemas.TABLES) or any(not schemas.same_schema(self.read(n, at), n) for n in at.parts):
            raise StoreError("E_DB_SCHEMA", "the store's tables are not as they should be")
        if [tuple(r) for r in self.read("schema_meta", at).limit(2).collect()] != [(1, schemas.SCHEMA_VERSION)]:
            raise StoreError("E_DB_SCHEMA", "the store has another version")

    def read(self, name: str, at: Snapshot | None = None) -> DataFrame:
        """A table as of a commit, or of the newest."""
        parts = (at or self.snapshot()).parts
        if name not in parts:
            raise StoreError("E_DB_NOT_INITIALIZED", "the store is not initialised")
        return self.spark.read.parquet(*[f"{self.path}/{name}/{n}" for n in parts[name]])

    def commit(self, tables: dict[str, DataFrame], append: bool = False, at: Snapshot | None = None, reads: tuple[str, ...] = ()) -> int:
        """New parts of these tables: the only ones, or beside those there are. The number of the commit.

        at: the commit that the tables were checked against, and reads: the tables that the checks read. If a later commit has
        changed one of these, the parts just written are deleted and Overtaken is raised. Without `at` nothing is checked.
        """
        own = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{name}/{own}")
        while True:
            now = self.snapshot()
            if at is not None and any(now.parts.get(t) != at.parts.get(t) for t in reads):
                self._delete(*[f"{name}/{own}" for name in tables])
                raise Overtaken
            parts = now.parts | {name: [*(now.parts.get(name, []) if append else []), own] for name in tables}
            if self._put_if_absent(f"_commits/{now.number + 1}", json.dumps(parts)):
                return now.number + 1

    def _delete(self, *names: str) -> None:
        fs, path = self._fs()
        for name in names:
            fs.delete(path(f"{self.path}/{name}"), True)

    def _put_if_absent(self, name: str, content: str) -> bool:
        """Writes a small file whole, unless there is one of that name: false then.

        Object stores that can do so write under a condition. Elsewhere the file is staged first: a local one gets its name by a
        hard link, one on a file system such as HDFS by a rename that does not overwrite. Both are one step.
        """
        fs, path = self._fs()
        jvm, target = self.spark.sparkContext._jvm, path(f"{self.path}/{name}")
        fs.mkdirs(target.getParent())
        data = (content + "\n").encode()
        if fs.hasPathCapability(target, CONDITIONAL):
            try:
                out = fs.createFile(target).overwrite(False).must(CONDITIONAL, True).recursive().build()
                out.write(data)
                out.close()
                return True
            except Py4JJavaError as e:
                return _refused(e)
        staged = path(f"{self.path}/_staged/{uuid.uuid4().hex}")
        out = fs.create(staged)
        out.write(data)
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                to_path = lambda p: jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(to_path(target), to_path(staged))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, target, none)
            return True
        except Py4JJavaError as e:
            return _refused(e)
        finally:
            fs.delete(staged, False)

    def _checked(self, batch: DataFrame, write: Callable[[DataFrame, Snapshot], T]) -> T:
        """write(batch, commit), again on the newest commit as often as another writer was first. The batch is computed once."""
        own = f"_staged/{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.path}/{own}")
        try:
            fixed = self.spark.read.schema(batch.schema).parquet(f"{self.path}/{own}")
            for _ in range(ATTEMPTS):
                try:
                    return write(fixed, self.snapshot())
                except Overtaken:
                    continue
            raise Overtaken
        finally:
            self._delete(own)

    def harvest(self, snapshots: DataFrame) -> tuple[int, int]:
        """All of a batch or nothing: (created, unchanged). Batches of writers at the same time give what they give one after the
        other."""
        return self._checked(snapshots, self._harvest)

    def _harvest(self, snapshots: DataFrame, at: Snapshot) -> tuple[int, int]:
        self.check(at)
        sources, stories = self.read("sources", at), self.read("stories", at)
        for bad, what in ((invalid_identities(snapshots), "identity"), (conflicts(snapshots, sources), "conflict"), (story_conflicts(snapshots, sources, stories), "story")):
            if bad.limit(1).count():
                raise StoreError("E_DB_SCHEMA", f"the batch is refused: {what}")
        created, unchanged = merge_counts(snapshots, sources).first()
        if created:
            new = new_rows(snapshots, sources).select(*sources.columns)
            self.commit({"sources": new, "stories": stories_of(new)}, True, at, ("schema_meta", "sources", "stories"))
        return created, unchanged

    def save_packages(self, packages: DataFrame) -> int:
        """Number of packages that are new; conflicts, with stored ones or within the batch, refuse the whole batch."""
        return self._checked(packages.distinct(), self._save_packages)

    def _save_packages(self, packages: DataFrame, at: Snapshot) -> int:
        existing = self.read("story_packages", at)
        if schemas.duplicates(packages, "story_id", "generator_name").limit(1).count():
            raise StoreError("E_DB_SCHEMA", "two packages of the batch have one story and generator")
        if schemas.orphans(packages, "story_id", self.read("stories", at), "id").limit(1).count():
            raise StoreError("E_STORY_NOT_FOUND", "a package's story is not stored")
        if schemas.violations(packages, "story_packages").where("violation is not null").limit(1).count() or package_conflicts(packages, existing).limit(1).count():
            raise StoreError("E_DB_SCHEMA", "a package conflicts with its inputs")
        new = packages.join(existing.select("story_id", "generator_name"), ["story_id", "generator_name"], "left_anti").select(*existing.columns)
        n = new.count()
        if n:
            self.commit({"story_packages": new}, True, at, ("stories", "story_packages"))
        return n


def _refused(e: Py4JJavaError) -> bool:
    """False if the error says that the file is there, or that another writer of it was first; else the error goes on."""
    if any(x in str(e.java_exception.getClass().getName()) + str(e.java_exception) for x in ("FileAlreadyExists", "PreconditionFailed", "RemoteFileChanged")):
        return False
    raise e
