"""Digest trees of folders: every folder has a digest of its entries, so a changed file is found by the path that leads to it.

Digests are made level by level from the deepest folder up. A folder's entries are first put together in 4096 groups by the
hash of their names, then the groups: a folder may hold a third of all files, and no task gets more than a group of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.session import cut

#: Hex digits of a name's hash that tell its group within the folder.
GROUP_DIGITS = 3
FILE, FOLDER = "file", "folder"


def parent_of(path: Column) -> Column:
    """The folder that holds a path; the top folder is the empty text."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)).otherwise("")


def depth_of(path: Column) -> Column:
    """Folders above a path and the path itself; 0 for the top folder."""
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/"))).cast("int")


def folder_digests(entries: DataFrame) -> DataFrame:
    """Entries (path, kind, digest, files) -> their folders (path, kind, digest, files).

    A group's digest is that of its entries' lines in order, each the name, a NUL, the kind, a NUL and the digest; a folder's
    is that of its groups' lines. files: how many lie in the folder and below.
    """
    name = F.substring_index("path", "/", -1)
    line = F.concat(name, F.lit("\x00"), "kind", F.lit("\x00"), "digest")
    lines = entries.select(parent_of(F.col("path")).alias("folder"), F.substring(F.sha2(name, 256), 1, GROUP_DIGITS).alias("group"), line.alias("line"), "files")
    groups = lines.groupBy("folder", "group").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"), F.sum("files").alias("files"))
    listed = F.sort_array(F.collect_list(F.concat("group", F.lit(" "), "digest")))
    return groups.groupBy("folder").agg(F.sha2(F.array_join(listed, "\n"), 256).alias("digest"), F.sum("files").alias("files")).select(F.col("folder").alias("path"), F.lit(FOLDER).alias("kind"), "digest", "files")


def tree(files: DataFrame) -> DataFrame:
    """Files (path, sha256) -> every file and folder: (path, depth, kind, digest, files); the top folder is "".

    Paths are relative, with single slashes. A path given twice counts twice. Rows without a path are left out; no files give
    no rows.
    """
    leaves = cut(files.where("path is not null").select("path", F.lit(FILE).alias("kind"), F.col("sha256").alias("digest"), F.lit(1).cast("long").alias("files")).withColumn("depth", depth_of(F.col("path"))))
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    levels, below = [leaves], None
    for depth in range(deepest, 0, -1):
        entries = leaves.where(F.col("depth") == depth).drop("depth")
        below = folder_digests(entries if below is None else entries.unionByName(below.drop("depth")))
        below = cut(below.withColumn("depth", F.lit(depth - 1)))
        levels.append(below)
    return reduce(DataFrame.unionByName, levels).select("path", "depth", "kind", "digest", "files")


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, depth, kind, state) of what differs between two trees: changed, missing or extra, from the top down.

    Only what lies in a folder whose digest differs is compared, level by level; equal trees are told by their top folders.
    """
    columns = ["path", "depth", "kind", "digest"]
    sides = [cut(t.select(*columns).withColumn("parent", F.when(F.col("depth") > 0, parent_of(F.col("path"))))) for t in (expected, actual)]
    deepest = max(t.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0] for t in sides)
    found, open_ = [], None
    for depth in range(deepest + 1):
        e, a = (t.where(F.col("depth") == depth) for t in sides)
        if open_ is not None:
            e, a = (t.join(open_, t["parent"] == open_["folder"], "left_semi") for t in (e, a))
        e, a = e.alias("e"), a.alias("a")
        both = e.join(a, (F.col("e.path") == F.col("a.path")) & (F.col("e.kind") == F.col("a.kind")), "full").where(~F.col("e.digest").eqNullSafe(F.col("a.digest")))
        state = F.when(F.col("a.path").isNull(), "missing").when(F.col("e.path").isNull(), "extra").otherwise("changed")
        level = cut(both.select(F.coalesce("e.path", "a.path").alias("path"), F.lit(depth).alias("depth"), F.coalesce("e.kind", "a.kind").alias("kind"), state.alias("state")))
        found.append(level)
        open_ = level.where(F.col("kind") == FOLDER).select(F.col("path").alias("folder")).distinct()
    return reduce(DataFrame.unionByName, found)
