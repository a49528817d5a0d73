"""Vectors of text, web and identity functions."""

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import identity, text, web


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(*columns).first()


@pytest.mark.parametrize(
    ("raw", "title"),
    [("Café", "Café"), ("  a \r\n\t b  c ", "a b c"), ("a\rb", "a b"), ("x" * 500, "x" * 500), ("가", "가")],
)
def test_title(spark, raw, title):
    x = F.col("x")
    assert tuple(one(spark, raw, text.title(x), text.title_error(x, text.title(x)))) == (title, None)


@pytest.mark.parametrize("raw", ["", " \n ", "x" * 501, "a\x00b", "a\x0bb", "a\x7fb"])
def test_title_refused(spark, raw):
    x = F.col("x")
    assert one(spark, raw, text.title_error(x, text.title(x)))[0] == "E_FIXTURE_INVALID"


def test_summary(spark):
    x = F.col("x")
    assert one(spark, "  a  b\r\nc ", text.summary(x))[0] == "a  b\nc"
    assert one(spark, "x" * 10_000, text.summary_error(x, text.summary(x)))[0] is None
    assert one(spark, "x" * 10_001, text.summary_error(x, text.summary(x)))[0] == "E_FIXTURE_INVALID"


@pytest.mark.parametrize(("raw", "n"), [("GPT-4 это д’Артаньян, don't", 4), ("", 0), ("— … !", 0), ("a-b-c d", 2)])
def test_spoken_words(spark, raw, n):
    assert one(spark, raw, text.spoken_words(F.col("x")))[0] == n


def test_small_text_functions(spark):
    x = F.col("x")
    assert one(spark, "a*b\\c|d", text.escape_markdown(x))[0] == "a\\*b\\\\c\\|d"
    assert one(spark, "so", text.sentence(x))[0] == "so." and one(spark, "so!", text.sentence(x))[0] == "so!"
    assert [one(spark, v, text.boundary_rank(x))[0] for v in ('a."', "a;", "a")] == [0, 1, 2]
    assert one(spark, "a\x1b[0m\n\x9f", text.terminal_safe(x))[0] == "a\\u001b[0m\n\\u009f"
    assert one(spark, None, text.shown(x))[0] == "null"
    assert one(spark, "E001 xE002 E003. E001", text.tokens(x, r"(?U)\bE\d{3}\b"))[0] == ["E001", "E003"]


def test_redaction(spark):
    raw = "Model: alpha-1\nrun_id: 7\nThe ALPHA-1 model, alpha and alphabet.  \n\n"
    blind, n = text.redact(F.col("x"), ["alpha-1"], ["alpha", "beta"])
    assert tuple(one(spark, raw, blind, n)) == ("The [MODEL] model, [MODEL] and alphabet.\n", 4)


@pytest.mark.parametrize(
    ("url", "canonical"),
    [
        (" HTTP://Example.COM:80/a?b=1&utm_source=x&b=2&c=#f ", "http://example.com/a?b=1&b=2&c="), ("https://example.com", "https://example.com/"), ("https://example.com:8443/", "https://example.com:8443/"),
        ("https://bücher.example/ä", "https://xn--bcher-kva.example/ä"), ("https://[2001:DB8::1]:443/x", "https://[2001:db8::1]/x"), ("https://a.example/?UTM_x=1&FBCLID=2&gclid=3&q=a+b", "https://a.example/?q=a+b"),
        ("https://a.example/p?x=1#top", "https://a.example/p?x=1"), ("https://a.example/p?x&y=2", "https://a.example/p?x=&y=2"), ("https://u:p@a.example/", None), ("ftp://a.example/", None),
        ("https://a.example:99999/", None), ("", None), ("https://", None), ("https://a.example/" + "x" * 4096, None), ("https://a.example.com/x\n", "https://a.example.com/x"), ("https://" + "a" * 64 + ".example.com/x", None),
        ("https://" + "a" * 63 + ".example.com/x", "https://" + "a" * 63 + ".example.com/x"), ("https://a.example:/x", "https://a.example/x"), ("https://a.example:0080/", "https://a.example:80/"), ("https://a..example/", None), ("https://a.example./", "https://a.example./"),
        ("https://[::1", None), ("https://[1.2.3.4]/", None), ("https://@a.example/", None), ("https://a.example:8x/", None), ("https:/a.example/", None), ("https://a.exa\tmple/b\nc", "https://a.example/bc"), ("https://a.example?x=%41+b=c&utm_%41=1", "https://a.example/?x=A+b%3Dc"),
        ("https://a.example/?q=a%20b&x=%2f", "https://a.example/?q=a+b&x=%2F"), ("http://LOCALHOST:443/#", "http://localhost:443/"), ("https://ａ.example／b", None),
    ],
)
def test_canonical_url(spark, url, canonical):
    assert one(spark, url, web.canonical_url(text.strip(F.col("x"))))[0] == canonical


def test_destinations(spark):
    good = web.allowed_destination(F.col("x"), F.array(F.lit("a.example")))
    urls = {"https://a.example/f": True, "https://A.example:443": True, "http://a.example": False, "https://b.example": False, "https://u@a.example": False, "https://a.example:8443": False}
    assert {u: one(spark, u, good)[0] for u in urls} == urls


@pytest.mark.parametrize(
    ("raw", "iso", "when"),
    [("Mon, 13 Jul 2026 10:00:00 +0300", False, "2026-07-13T07:00:00Z"), ("2026-07-14T10:30:00+03:00", True, "2026-07-14T07:30:00Z"), ("2026-07-14T10:30:00+03:00", False, None), ("2026-07-13 10:00", True, None), ("2026-07-13T10:00:00.9Z", True, "2026-07-13T10:00:00Z"), ("x", True, None)],
)
def test_dates(raw, iso, when):
    assert web.date_or_none(raw, iso) == when


def test_html():
    assert web.html_text("<style>bad</style><p>A<br>B</p>") == "A B"
    assert web.html_text("Useful &amp; safe<script>x()</script>") == "Useful & safe"


def test_srt_times(spark):
    assert one(spark, "01:02:03,004", web.srt_ms(F.col("x")))[0] == 3_723_004
    assert one(spark, "1:02:03,004", web.srt_ms(F.col("x")))[0] is None
    assert one(spark, 3_723_004, web.srt_text(F.col("x")), kind="long")[0] == "01:02:03,004"


def test_identity_chain(spark):
    """The published vector of the identity algebra."""
    h = identity.content_hash(F.lit("Тест AI"), F.lit("Кратко"), F.lit(None).cast("string"), F.lit("2026-07-13 10:00"))
    row = spark.range(1).select(h.alias("h"))
    row = row.withColumn("id", identity.source_id(F.lit("https://example.com/news"), F.col("h"))).withColumn("story", identity.story_id(F.col("id")))
    row = row.withColumn("claim", identity.claim_id(F.col("id"), identity.claim_text(F.lit("Тест AI"))))
    row = row.withColumn("fp", identity.mock_fingerprint(F.col("story"), F.array(F.struct(F.col("h").alias("content_hash"), "id"))))
    got = row.select("h", "id", "story", "claim", identity.mock_package_id(F.col("fp"))).first()
    assert got[0].startswith("e004ecf4") and got[0].endswith("dbc7d")
    assert tuple(got)[1:] == ("src_58343a9a5ffae3037a3f73bf", "story_55c2bc7f60628d20cb9acd4c", "claim_11806810946d69ba4de2ccd4", "pkg_17e9b7502f7bc00db437b993")


def test_sources_are_sorted_before_hashing(spark):
    a, b = (F.struct(F.lit("h").alias("content_hash"), F.lit(i).alias("id")) for i in ("a", "b"))
    fps = spark.range(1).select(identity.mock_fingerprint(F.lit("s"), F.array(a, b)), identity.mock_fingerprint(F.lit("s"), F.array(b, a))).first()
    assert fps[0] == fps[1]


def test_experiment_and_script_identities(spark):
    import hashlib
    import json

    value = {"effort": "high", "models": {"a": "x", "b": "y"}, "schema_version": 1}
    text_ = json.dumps(value, sort_keys=True, separators=(",", ":")) + "\n"
    models = F.struct(F.lit("x").alias("a"), F.lit("y").alias("b")).alias("models")
    got = spark.range(1).select(identity.experiment_id(F.lit("high").alias("effort"), models, F.lit(1).alias("schema_version"))).first()[0]
    assert got == "gpt56-ts-" + hashlib.sha256(text_.encode()).hexdigest()[:24]
    core = {"generator_version": "safe-local-v1", "package_id": "p", "package_json_sha256": hashlib.sha256(b"{}").hexdigest(), "script_schema_version": 1, "template_version": "claim-safe-script-v1"}
    fp = hashlib.sha256(json.dumps(core, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    got = spark.range(1).select(identity.script_fingerprint(F.lit("p"), F.lit("{}")).alias("f")).select("f", identity.script_id(F.col("f"))).first()
    assert tuple(got) == (fp, "script_" + hashlib.sha256(f"f3-script:{fp}".encode()).hexdigest()[:24])
