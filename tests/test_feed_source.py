import pytest
from pyspark.sql import functions as F

from ledgerflow.sources import feed_source, feeds
from ledgerflow.sources.feed_source import FeedSource

ITEM = "<item><title>{t}</title><link>https://example.com/{t}</link><description>d</description><pubDate>2026-07-13 10:00</pubDate></item>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="https://example.com/a"/><updated>2026-07-14T10:30:00+03:00</updated></entry></feed>'


def rss(*titles):
    return "<rss><channel>" + "".join(ITEM.format(t=t) for t in titles) + "</channel></rss>"


@pytest.fixture
def landing(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    folder = tmp_path / "in"
    (folder / "sub dir").mkdir(parents=True)
    (folder / "a.xml").write_text(rss("a", "b", "c"))
    (folder / "sub dir" / "b.xml").write_text(rss("d"))
    (folder / "bad.xml").write_text("<rss/>")
    (folder / "empty.xml").write_text("<rss><channel/></rss>")
    (folder / "_SUCCESS").write_text("")
    (folder / ".hidden.xml").write_text(rss("x"))
    return folder


def shown(df):
    return sorted((r.path.rsplit("/", 1)[1], r.position, r.title, r.error) for r in df.collect())


def test_batch_equals_the_parser_over_binary_files(spark, landing):
    got = spark.read.format("feed").load(str(landing))
    assert shown(got) == [("a.xml", 0, "a", None), ("a.xml", 1, "b", None), ("a.xml", 2, "c", None), ("b.xml", 0, "d", None), ("bad.xml", 0, None, "channel")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(str(landing))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, feeds.parsed(files.where("path not like '%hidden%'")).collect()), key=str)
    assert shown(spark.read.format("feed").load(f"file:{landing}")) == shown(got)
    good, bad = feeds.snapshots(got, "2026-01-01T00:00:00Z")
    assert good.count() == 4 and bad.count() == 1


def test_a_partition_holds_files_up_to_its_bytes(spark, landing):
    one = spark.read.format("feed").option("partitionBytes", 1).load(str(landing))
    assert one.rdd.getNumPartitions() == 4 and spark.read.format("feed").load(str(landing)).rdd.getNumPartitions() == 1
    assert shown(one) == shown(spark.read.format("feed").load(str(landing)))


def test_live_documents_and_their_limit(spark, landing):
    (landing / "atom.xml").write_text(ATOM)
    got = spark.read.format("feed").option("live", "true").option("limit", 2).load(str(landing))
    assert [r[:3] for r in shown(got) if r[0] in ("a.xml", "atom.xml")] == [("a.xml", 0, "a"), ("a.xml", 1, "b"), ("atom.xml", 0, "A")]
    for limit in (0, 51):
        with pytest.raises(Exception, match="limit"):
            spark.read.format("feed").option("live", "true").option("limit", limit).load(str(landing)).count()


def test_a_filter_on_path_picks_files(spark, landing):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        (landing / "unreadable.xml").mkdir()
        path = next(f.path for f in feed_source.listed(str(landing)) if f.path.endswith("/a.xml"))
        got = spark.read.format("feed").options(partitionBytes=1, pushdown="true").load(str(landing)).where(F.col("path") == path)
        assert [r[2] for r in shown(got)] == ["a", "b", "c"] and got.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_too_large_a_file_is_an_error_row(spark, landing, monkeypatch):
    (landing / "large.xml").write_bytes(b" " * (feeds.MAX_BYTES + 1))
    assert ("large.xml", 0, None, "size") in shown(spark.read.format("feed").load(str(landing)))


def test_stream_takes_each_file_once(spark, landing, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        rows = spark.readStream.format("feed").load(str(landing))
        rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(once=True).start(out).awaitTermination(60)
        return shown(spark.read.parquet(out))

    first = run()
    assert [r[2] for r in first] == ["a", "b", "c", "d", None]
    (landing / "late.xml").write_text(rss("z"))
    assert sorted(run(), key=str) == sorted([*first, ("late.xml", 0, "z", None)], key=str)
    assert len(run()) == 6


def test_empty_folder(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    (tmp_path / "none").mkdir()
    assert spark.read.format("feed").load(str(tmp_path / "none")).count() == 0
