"""Command line over the operators: python -m ledgerflow.cli --help. Sources are folders of fetched feed files."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import functions as F

from ledgerflow.operators import packages, scripts, store
from ledgerflow.session import session, ship
from ledgerflow.sources import export_sink, feeds, script_files, sinks
from ledgerflow.sources.files import Refused


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _harvest(db: store.Store, path: str, live: bool, limit: int | None, source: str | None) -> tuple[int, int]:
    raw = feeds.parsed(feeds.scan(db.spark, path), live, limit)
    good, bad = feeds.snapshots(raw, now(), live, source)
    first = bad.orderBy("path").first()
    if first is not None:
        raise Refused(first.error_code, f"{first.path}: {first.error or 'an item is invalid'}")
    return db.harvest(good.withColumn("position", F.concat("path", F.lit("#"), F.lpad(F.col("position").cast("string"), 8, "0"))))


def _one(packages_: object, story: str, generator: str | None):
    rows = packages_.where(F.col("story_id") == story)
    rows = rows.where(F.col("generator_name") == generator) if generator else rows
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise Refused("E_PACKAGE_AMBIGUOUS" if found else "E_PACKAGE_NOT_BUILT", "the story has not just one package")
    return found[0]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerflow")
    p.add_argument("--data", required=True, help="the store's folder")
    groups = p.add_subparsers(dest="group", required=True)

    def command(group: argparse._SubParsersAction, name: str, **arguments: dict) -> None:
        c = group.add_parser(name)
        for k, v in arguments.items():
            c.add_argument(f"--{k}", **v)

    verbs = {g: groups.add_parser(g).add_subparsers(dest="verb", required=True) for g in ("db", "harvest", "stories", "package", "script")}
    path, story = {"required": True}, {"required": True}
    command(verbs["db"], "init")
    command(verbs["harvest"], "run", fixture=path)
    command(verbs["harvest"], "live", landing=path, source={"required": True}, limit={"type": int, "default": 10})
    command(verbs["stories"], "list")
    command(verbs["package"], "build", story=story)
    command(verbs["package"], "export", story=story, out=path, generator={}, format={"choices": ("json", "markdown", "all"), "default": "all"}, force={"action": "store_true"})
    command(verbs["package"], "export-all", out=path, force={"action": "store_true"})
    command(verbs["script"], "build", story=story, out=path)
    return p


def run(args: argparse.Namespace, spark) -> list[str]:
    db = store.Store(spark, args.data)
    what = (args.group, args.verb)
    if what == ("db", "init"):
        return ["initialised" if db.init() else "already initialised"]
    if args.group == "harvest":
        live = args.verb == "live"
        counts = _harvest(db, args.landing if live else args.fixture, live, args.limit if live else None, args.source if live else None)
        return [f"created: {counts[0]}", f"unchanged: {counts[1]}"]
    if args.group == "stories":
        return [f"{r.id}\t{r.title}" for r in store.list_stories(db.read("stories"), db.read("sources")).toLocalIterator()]
    sources, stories, stored = db.read("sources"), db.read("stories"), db.read("story_packages")
    if what == ("package", "export-all"):
        written, unchanged = export_sink.export(export_sink.package_groups(stored), args.out, args.force)
        return [f"written: {written}", f"unchanged: {unchanged}"]
    own = stories.where(F.col("id") == args.story)
    own_source = sources.join(own.select(F.col("primary_source_id").alias("id")), "id", "left_semi")
    if what == ("package", "build"):
        if own.limit(1).count() == 0:
            raise Refused("E_STORY_NOT_FOUND", "the story is not stored")
        bad = store.lineage_errors(own, sources).where("error_code is not null").first()
        if bad is not None:
            raise Refused("E_DB_SCHEMA", bad.error_code)
        created = db.save_packages(packages.mock_packages(own_source, now()))
        return [f"created: {created}"]
    found = _one(stored, args.story, getattr(args, "generator", None))
    one = stored.where((F.col("story_id") == args.story) & (F.col("generator_name") == found.generator_name))
    if found.generator_name == "mock":
        bad = packages.mock_package_errors(one, own_source).where("error_code is not null").first()
        if bad is not None:
            raise Refused("E_DB_SCHEMA", bad.error_code)
    out = Path(args.out)
    if what == ("package", "export"):
        kind = spark.range(1).select(F.schema_of_json(F.lit(found.payload_json))).first()[0]
        render = sinks.mock_markdown if found.generator_name == "mock" else sinks.provider_markdown
        if found.generator_name == "mock":
            kind = "STRUCT<claims: ARRAY<STRUCT<id: STRING, qualifier: STRING, source_ids: ARRAY<STRING>, status: STRING, text: STRING, type: STRING>>, package_id: STRING, sources: ARRAY<STRUCT<canonical_url: STRING, content_hash: STRING, id: STRING, published_at: STRING, published_at_raw: STRING, title: STRING>>, story: STRUCT<id: STRING, title: STRING>>"
        text = one.select(render(F.from_json("payload_json", kind))).first()[0]
        files = {"json": (f"{found.package_id}.json", sinks.package_json(found.payload_json)), "markdown": (f"{found.package_id}.md", text.encode())}
        wanted = files if args.format == "all" else {args.format: files[args.format]}
        written, unchanged = sinks.export_pair({out / n: b for n, b in wanted.values()}, args.force)
        return [f"written: {written}", f"unchanged: {unchanged}"]
    if found.generator_name == "mock":
        raise Refused("E_SCRIPT_PACKAGE", "a demo package gives no script")
    draft = one.withColumn("p", F.from_json("payload_json", packages.DRAFT)).select("package_id", "payload_json", "p.*")
    made = script_files.finished(scripts.with_identity(scripts.compose(draft)))
    one_script = made.first()
    if one_script.error_code or found_verdict(draft) in ("HOLD", "REJECT"):
        raise Refused(one_script.error_code or "E_SCRIPT_VERDICT", "the package gives no script")
    written, _ = script_files.write(made, str(out))
    return [json.dumps({"script_id": one_script.script_id, "created": bool(written)})]


def found_verdict(draft) -> str:
    return draft.select("publication_verdict").first()[0]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    ship(spark)
    try:
        print("\n".join(run(args, spark)))
    except (Refused, store.StoreError) as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
