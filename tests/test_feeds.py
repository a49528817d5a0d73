import pytest
from pyspark.sql import functions as F

from ledgerflow.sources import feeds, files

ITEM = "<item><title>T</title><link>https://a.example/x</link><description>d</description></item>"
WRAP = "<rss><channel>{}</channel></rss>"


def parse(data, **more):
    return feeds.items(data if isinstance(data, bytes) else data.encode(), **more)


@pytest.mark.parametrize(
    "data",
    [b"\xff", '<?xml version="1.0" encoding="windows-1251"?><rss/>', "<feed/>", "<rss><channel/><channel/></rss>", "<!DOCTYPE x><rss/>", '<!ENTITY a "b"><rss/>', "<rss>", WRAP.format("<item><link>x</link></item>"), WRAP.format(ITEM.replace("</title>", "</title><title>U</title>")), b"x" * (feeds.MAX_BYTES + 1)],
)
def test_rejected(data):
    (row,) = parse(data)
    assert row[5]


def test_counts_and_bom():
    assert parse(WRAP.format("")) == []
    assert len(parse(WRAP.format(ITEM * 500))) == 500
    assert parse(WRAP.format(ITEM * 501))[0][5] == "items"
    assert parse(b"\xef\xbb\xbf" + WRAP.format(ITEM).encode())[0][1:3] == ("T", "https://a.example/x")


def test_description_beats_summary_and_text_is_joined():
    item = "<item><title>a<b>c</b>d</title><link>l</link><summary>s</summary><description>d</description><pubDate>now</pubDate></item>"
    assert parse(WRAP.format(item)) == [(0, "acd", "l", "d", "now", None)]


def test_live_limit_comes_before_checks():
    two = WRAP.format(ITEM + "<item/>")
    assert len(parse(two, live=True, limit=1)) == 1 and parse(two, live=True, limit=1)[0][5] is None
    assert parse(two, live=True, limit=2)[0][5] and parse(two, live=True, limit=51)[0][5] == "limit"


def test_atom():
    head = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title>'
    good = head + '<link rel="self" href="s"/><link href="u"/><content>c</content><updated>2026-07-14T10:30:00+03:00</updated></entry></feed>'
    assert parse(good, live=True, limit=5) == [(0, "t", "u", "c", "2026-07-14T10:30:00+03:00", None)]
    assert parse(head + '<link href="u"/><link href="v"/></entry></feed>', live=True, limit=5)[0][5] == "link"
    assert parse(good)[0][5] == "root"


def test_one_bad_item_rejects_its_document(spark):
    bad = ITEM.replace("https://a.example/x", "file:///x")
    docs = spark.createDataFrame([("a", bytearray(WRAP.format(ITEM + bad).encode())), ("b", bytearray(WRAP.format(ITEM).encode()))], "path string, content binary")
    good, rejected = feeds.snapshots(feeds.parsed(docs), "2026-01-01T00:00:00Z")
    assert [r.path for r in good.collect()] == ["b"]
    assert [tuple(r)[:3] for r in rejected.collect()] == [("a", 1, "E_FIXTURE_INVALID")]


def test_live_snapshot(spark):
    item = "<item><title>&lt;b&gt;T&lt;/b&gt;</title><link>https://a.example/x</link><description>Useful &amp;amp; safe&lt;script&gt;x&lt;/script&gt;</description><pubDate>Tue, 14 Jul 2026 12:00:00 GMT</pubDate></item>"
    docs = spark.createDataFrame([("a", bytearray(WRAP.format(item).encode()))], "path string, content binary")
    good, _ = feeds.snapshots(feeds.parsed(docs, live=True, limit=3), "", live=True, source_name="s")
    row = good.first()
    assert (row.title, row.summary_text, row.published_at, row.published_at_raw, row.source_name) == ("T", "Useful & safe", "2026-07-14T12:00:00Z", None, "s")


def test_scan_and_inventory(spark, tmp_path):
    (tmp_path / "a.xml").write_text(WRAP.format(ITEM))
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    assert feeds.scan(spark, str(tmp_path)).count() == 2
    assert [r.name for r in files.inventory(spark, str(tmp_path)).collect()] == ["a.xml", "b.txt"]
    texts = {r.path[-5:]: (r.value is not None, r.error) for r in files.read_utf8(spark, str(tmp_path), 1000).collect()}
    assert texts == {"a.xml": (True, None), "b.txt": (False, "utf-8")}


def test_csv_header_is_exact(spark, tmp_path):
    good, bad = tmp_path / "g.csv", tmp_path / "b.csv"
    good.write_text("a,b\n1,\n")
    bad.write_text("b,a\n1,2\n")
    assert [tuple(r) for r in files.read_csv(spark, str(good), ["a", "b"]).collect()] == [("1", "")]
    with pytest.raises(files.Refused) as e:
        files.read_csv(spark, str(bad), ["a", "b"])
    assert e.value.code == "HUMAN_INPUT_INVALID"


def test_live_source_registry(spark):
    text = '[[sources]]\nname="n"\nfeed_url="https://a.example/f"\nallowed_hosts=["a.example"]\nfeed_format="rss2"\nenabled=true\n'
    assert files.live_sources(spark, text, {"n": {"a.example"}}).count() == 1
    for old, new in (("https", "http"), ("true", "false"), ("rss2", "csv"), ('["a.example"]', '["b.example"]'), ("a.example/f", "u@a.example/f")):
        with pytest.raises(files.Refused):
            files.live_sources(spark, text.replace(old, new), {"n": {"a.example"}})


def test_experiment_config():
    text = '[models.a]\nid="x"\ninput_per_million=2.50\n[models.b]\nid="y"\ninput_per_million=5\n'
    got = files.experiment_config(text)
    assert got["models"] == {"a": "x", "b": "y"} and str(got["rates"]["a"]["input_per_million"]) == "2.50"
    for bad in (text.replace("2.50", "-1"), text.replace('"x"', '""'), text + "[limits]\ntimeout_seconds=0\n", "["):
        with pytest.raises(files.Refused):
            files.experiment_config(bad)


def test_dates_columns(spark):
    when, raw = feeds.dates(F.col("x"), iso=True)
    rows = spark.createDataFrame([("2026-07-13 10:00",), (None,), (" ",), ("2026-07-13T10:00:00Z",)], "x string").select(when, raw).collect()
    assert [tuple(r) for r in rows] == [(None, "2026-07-13 10:00"), (None, None), (None, None), ("2026-07-13T10:00:00Z", None)]
