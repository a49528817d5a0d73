"""Queries that apply the operators to whole tables of the test data, each with DuckDB SQL for the same rows.

Documents stand for feed summaries, pages for live items, events for the event log, labels for review scores, and
conversations for ordered claims, scenes and subtitle cues.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow import schemas
from ledgerflow.functions import identity, redaction, text, web
from ledgerflow.operators import blinding, digests, experiment, ledger, packages, scripts, statistics, store, timing
from ledgerflow.session import cut, cuts_dir, table
from ledgerflow.sources import export_sink, feeds, script_files, sinks
from ledgerflow.sources.feed_source import FeedSource

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Parts of SQL that several oracles share.
_BLANK = r"[\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
_WORD = r"[0-9A-Za-z\x{400}-\x{4ff}]+(?:[-\x{2019}''][0-9A-Za-z\x{400}-\x{4ff}]+)*"
_NL = "regexp_replace({}, '\\r\\n?', chr(10), 'g')"


def _collapse(x: str) -> str:
    return f"nfc_normalize(trim(regexp_replace({_NL.format(x)}, '{_BLANK}+', ' ', 'g')))"


def _strip(x: str) -> str:
    return f"nfc_normalize(regexp_replace({_NL.format(x)}, '^{_BLANK}+|{_BLANK}+$', '', 'g'))"


def _words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{_WORD}'))::bigint"


def _hash_sql(at: str = "published_at", raw: str = "published_at_raw", summary: str = "summary_text", title: str = "title") -> str:
    return f"sha256(json_object('published_at', {at}, 'published_at_raw', {raw}, 'summary_text', {summary}, 'title', {title})::varchar)"


def _short(prefix: str, x: str) -> str:
    return f"'{prefix}' || substr(sha256({x}), 1, 24)"


_SNAP = f"""
raw as (select doc_id as position, lang, source, 'https://' || source || '.example.com/' || lang as canonical_url,
  'Report from ' || source || ' in ' || lang as title, {_strip("text")} as summary_text, text, null::varchar as published_at,
  case when lang = 'de' then 'gestern' end as published_at_raw from documents),
good as (select * from raw where not regexp_matches(text, '{_CONTROL}') and length(summary_text) <= 10000),
hashed as (select *, {_hash_sql()} as content_hash from good),
snap as (select *, {_short("src_", "canonical_url || chr(10) || content_hash")} as id from hashed)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of all documents that are valid summaries."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(
        F.col("doc_id").alias("position"), "lang", "source", F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang").alias("canonical_url"),
        F.concat(F.lit("Report from "), "source", F.lit(" in "), "lang").alias("title"), "text", F.lit(None).cast("string").alias("published_at"), F.when(F.col("lang") == "de", F.lit("gestern")).alias("published_at_raw"),
    ).withColumn("summary_text", text.summary(F.col("text")))
    rows = rows.where(text.summary_error(F.col("text"), F.col("summary_text")).isNull())
    h = identity.content_hash(*[F.col(c) for c in ("title", "summary_text", "published_at", "published_at_raw")])
    rows = rows.withColumn("content_hash", h).withColumn("id", identity.source_id(F.col("canonical_url"), F.col("content_hash")))
    return rows.withColumns({"original_url": F.col("canonical_url"), "discovered_at": F.lit("2026-01-01T00:00:00Z"), "source_name": F.lit(None).cast("string")}).drop("text")


# --- text ------------------------------------------------------------------------------------------------------------


@query(f"""with t as (select conv_id, turn, text, {_collapse("text")} as n from conversations)
select conv_id, turn, case when e is null then n end as title, e as error_code from
(select *, case when regexp_matches(text, '{_CONTROL}') or length(n) not between 1 and 500 then 'E_FIXTURE_INVALID' end as e from t)""")
def text_normalize_title(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("n", text.title(F.col("text")))
    rows = rows.withColumn("error_code", text.title_error(F.col("text"), F.col("n")))
    return rows.select("conv_id", "turn", F.when(F.col("error_code").isNull(), F.col("n")).alias("title"), "error_code")


@query(f"""with t as (select doc_id, text, {_strip("text")} as n from documents)
select doc_id, case when e is null then n end as summary, e as error_code from
(select *, case when regexp_matches(text, '{_CONTROL}') or length(n) > 10000 then 'E_FIXTURE_INVALID' end as e from t)""")
def text_normalize_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("n", text.summary(F.col("text")))
    rows = rows.withColumn("error_code", text.summary_error(F.col("text"), F.col("n")))
    return rows.select("doc_id", F.when(F.col("error_code").isNull(), F.col("n")).alias("summary"), "error_code")


@query(f"""select lang, count(*)::bigint as n, count(*) filter (length({_strip("text")}) > 10000)::bigint as n_oversize, max(length(text))::bigint as longest from documents group by lang""")
def text_reject_oversize(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "text", text.summary(F.col("text")).alias("n"))
    bad = F.length("n") > text.SUMMARY_LIMIT
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_oversize"), F.max(F.length("text")).cast("long").alias("longest"))


@query(f"""select 'd' || doc_id as item, {_words("text")} as n_words from documents union all select 'c' || conv_id || '.' || turn, {_words("text")} from conversations""")
def text_word_count(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("item"), "text")
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("item"), "text")
    return d.unionByName(c).select("item", text.spoken_words(F.col("text")).alias("n_words"))


@query(r"""select doc_id, regexp_replace(text, '([\\`*_{}\[\]<>()#+\-.!|])', '\\\1', 'g') as escaped from documents""")
def text_markdown_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.escape_markdown(F.col("text")).alias("escaped"))


_IDENTITIES, _ALIASES = ["the of", "le la"], ["was", "this"]


@query(r"""with a as (select conv_id, turn, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10) as t0 from conversations),
b as (select *, regexp_replace(t0, '(?i)the of', '[MODEL]', 'g') as t1, len(regexp_extract_all(t0, '(?i)the of')) as n1 from a),
c as (select *, regexp_replace(t1, '(?i)le la', '[MODEL]', 'g') as t2, len(regexp_extract_all(t1, '(?i)le la')) as n2 from b)
select conv_id, turn, regexp_replace(t2, '(?i)\b(?:was|this)\b', '[MODEL]', 'g') as blind_text, (n1 + n2 + len(regexp_extract_all(t2, '(?i)\b(?:was|this)\b')))::bigint as redaction_count, sha256(text) as source_sha256 from c""")
def text_redact_identity(spark, sf_dir):
    out = experiment.blinded(table(spark, sf_dir, "conversations"), _IDENTITIES, _ALIASES)
    return out.select("conv_id", "turn", "blind_text", "redaction_count", "source_sha256")


_TOKEN = r"\b[A-Z][a-z]{9}\b"


@query(r"""with d as (select distinct unnest(regexp_split_to_array(text, '[^\p{L}\p{M}\p{N}_]+')) as token from documents),
b as (select distinct unnest(regexp_split_to_array(text, '[^\p{L}\p{M}\p{N}_]+')) as token from benchmark) select token from d where regexp_full_match(token, '[A-Z][a-z]{9}') and token not in (select token from b)""")
def text_token_extract_antijoin(spark, sf_dir):
    of = lambda name: table(spark, sf_dir, name).select(F.explode(text.tokens(F.col("text"), "(?U)" + _TOKEN)).alias("token"))
    return of("documents").join(of("benchmark"), "token", "left_anti").distinct()


@query(r"""select conv_id, turn, case when regexp_matches(text, '[.!?]["»)]*$') then 0 when regexp_matches(text, '[,;:]["»)]*$') then 1 else 2 end as rank,
case when regexp_matches(text, '[.!?]$') then text else text || '.' end as sentence from conversations""")
def text_sentence_boundaries(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.boundary_rank(F.col("text")).alias("rank"), text.sentence(F.col("text")).alias("sentence"))


# --- web -------------------------------------------------------------------------------------------------------------


@query(r"""with p as (select page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) as h, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path, regexp_extract(url, '\?([^#]*)', 1) as q from pages),
k as (select *, list_filter(str_split(q, '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(?:utm_[^=]*|fbclid|gclid)(?:=|$)')) as pairs from p)
select page_id, h || case when path = '' then '/' else path end || case when len(pairs) > 0 then '?' || array_to_string(pairs, '&') else '' end as canonical_url from k""")
def url_canonicalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.canonical_url(F.col("url")).alias("canonical_url"))


_HOSTS = ["blog.tionsh.example.com", "tionble.example.org", "www.ththon.example.org"]


@query(f"""select page_id, url like 'https://%' and regexp_extract(url, '^https://([^/?#]+)', 1) in ({", ".join(f"'{h}'" for h in _HOSTS)}) as allowed from pages""")
def url_host_allowlist(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.allowed_destination(F.col("url"), F.array(*[F.lit(h) for h in _HOSTS])).alias("allowed"))


@query(r"""with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script[^>]*>', '', 'g'), '(?is)<style[^>]*>.*?</style[^>]*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') as h from pages),
b as (select page_id, regexp_replace(regexp_replace(h, '(?i)<(/[a-z][^>]*|(br|p|div|li|section|article)(\s[^>]*|/)?)>', ' ', 'g'), '<[!a-zA-Z][^>]*>', '', 'g') as h from a),
c as (select page_id, replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') as h from b)
select page_id, trim(regexp_replace(h, '[\s\x{a0}]+', ' ', 'g')) as text from c""")
def html_to_text_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.html_to_text(F.col("html")).alias("text"))


_DATES = ["Mon, 13 Jul 2026 10:00:00 +0300", "14 Jul 2026 12:00:00 GMT", "2026-07-13 10:00", "not a date", " "]


@query("""select doc_id, case doc_id % 5 when 0 then '2026-07-13T07:00:00Z' when 1 then '2026-07-14T12:00:00Z' end as published_at, case doc_id % 5 when 2 then '2026-07-13 10:00' when 3 then 'not a date' end as published_at_raw from documents""")
def date_normalize(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(d) for d in _DATES]), (F.col("doc_id") % 5 + 1).cast("int"))
    when, kept = feeds.dates(raw)
    return table(spark, sf_dir, "documents").select("doc_id", when.alias("published_at"), kept.alias("published_at_raw"))


# --- identity and store ----------------------------------------------------------------------------------------------


@query(f"select doc_id, {_hash_sql('null', 'source', 'text', 'lang')} as content_hash from documents")
def identity_content_hash(spark, sf_dir):
    h = identity.content_hash(F.col("lang"), F.col("text"), F.lit(None).cast("string"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("content_hash"))


_CHAIN = f"""{_SNAP},
chain as (select *, {_short("story_", "id")} as story_id, 'RSS item reports: ' || title as claim_text from snap),
full_chain as (select *, {_short("claim_", "id || chr(10) || claim_text || chr(10) || 'VENDOR_CLAIM' || chr(10) || 'UNVERIFIED'")} as claim_id,
  sha256(json_object('generator_name', 'mock', 'generator_version', 'mock-v1', 'schema_version', 1, 'sources', [json_object('content_hash', content_hash, 'id', id)], 'story_id', story_id)::varchar) as fp from chain),
packaged as (select *, {_short("pkg_", "'story-package' || chr(10) || fp")} as package_id from full_chain)"""


@query(f"with {_CHAIN} select position, content_hash, id as source_id, story_id, claim_id, fp as input_fingerprint, package_id from packaged")
def identity_chain(spark, sf_dir):
    s = _snapshots(spark, sf_dir).withColumn("story", identity.story_id(F.col("id")))
    fp = identity.mock_fingerprint(F.col("story"), F.array(F.struct("content_hash", "id")))
    s = s.withColumn("input_fingerprint", fp)
    claim = identity.claim_id(F.col("id"), identity.claim_text(F.col("title")))
    return s.select("position", "content_hash", F.col("id").alias("source_id"), F.col("story").alias("story_id"), claim.alias("claim_id"), "input_fingerprint", identity.mock_package_id(F.col("input_fingerprint")).alias("package_id"))


@query(f"with {_SNAP} select id, min(position) as position from snap group by id")
def harvest_dedup_first_wins(spark, sf_dir):
    return store.first_wins(_snapshots(spark, sf_dir)).select("id", "position")


@query(f"""with {_SNAP}, old as (select distinct id from snap where position % 2 = 0), new as (select id, position from snap where position % 2 = 1)
select count(distinct id) filter (id not in (select id from old))::bigint as created, (count(*) - count(distinct id) filter (id not in (select id from old)))::bigint as unchanged from new""")
def harvest_merge_counts(spark, sf_dir):
    """The even half is stored, the odd half is harvested."""
    s = _snapshots(spark, sf_dir)
    return store.merge_counts(s.where("position % 2 = 1"), store.first_wins(s.where("position % 2 = 0")))


@query(f"""with {_SNAP}, named as (select *, case when position % 3 > 0 then 'feed ' || (position % 3) end as source_name from snap),
old as (select id, source_name from (select *, row_number() over (partition by id order by position) as r from named where position % 2 = 0) where r = 1),
new as (select * from named where position % 2 = 1), firsts as (select id, source_name from (select *, row_number() over (partition by id order by position) as r from new) where r = 1),
base as (select * from old union all select * from firsts where id not in (select id from old))
select new.id, new.position, new.source_name from new join base using (id) where new.source_name is distinct from base.source_name""")
def harvest_conflicts(spark, sf_dir):
    """Copies of a document that name another source conflict with the stored one."""
    s = _snapshots(spark, sf_dir).withColumn("source_name", F.when(F.col("position") % 3 > 0, F.concat(F.lit("feed "), (F.col("position") % 3).cast("string"))))
    return store.conflicts(s.where("position % 2 = 1"), store.first_wins(s.where("position % 2 = 0"))).select("id", "position", "source_name")


@query(f"with {_SNAP}, one as (select id, min(title) as title from snap group by id) select {_short('story_', 'id')} as id, id as primary_source_id, title from one")
def stories_list(spark, sf_dir):
    s = store.first_wins(_snapshots(spark, sf_dir))
    return store.list_stories(store.stories_of(s), s)


@query(f"""with {_SNAP}, one as (select * from (select *, row_number() over (partition by id order by position) as r from snap) where r = 1)
select {_short("story_", "id")} || case when position % 11 = 0 then 'x' else '' end as story_id, case when position % 7 = 0 then 'CONTENT_HASH' when position % 5 = 0 then 'SOURCE_ID' when position % 11 = 0 then 'STORY_ID' end as error_code from one""")
def lineage_validate(spark, sf_dir):
    """Rows with a changed title, address or story id are found by the check that they break."""
    s = store.first_wins(_snapshots(spark, sf_dir))
    stories = store.stories_of(s).join(s.select(F.col("id").alias("primary_source_id"), "position"), "primary_source_id")
    stories = stories.withColumn("id", F.when(F.col("position") % 11 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id"))).drop("position")
    changed = s.withColumns({"title": F.when(F.col("position") % 7 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")), "canonical_url": F.when(F.col("position") % 5 == 0, F.concat("canonical_url", F.lit("/x"))).otherwise(F.col("canonical_url"))})
    return store.lineage_errors(stories, changed)


@query(f"""with {_SNAP} select position, case when not regexp_matches(content_hash, '^[0-9a-f]{{64}}$') then 'content_hash' when position % 4 = 0 then 'source_name' end as violation from snap""")
def store_constraints(spark, sf_dir):
    s = _snapshots(spark, sf_dir).withColumn("source_name", F.when(F.col("position") % 4 == 0, F.lit("")))
    return schemas.violations(s, "sources").select("position", "violation")


@query(f"""with {_SNAP}, k as (select canonical_url, content_hash, count(*) as n from snap group by 1, 2 having count(*) > 1) select canonical_url, content_hash, n::bigint as n from k""")
def store_unique_violations(spark, sf_dir):
    return schemas.duplicates(_snapshots(spark, sf_dir), "canonical_url", "content_hash")


@query("""select l.doc_id from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id and length(d.text) <= 10000)""")
def store_orphans(spark, sf_dir):
    """Labels whose document is no valid summary."""
    good = table(spark, sf_dir, "documents").where(F.length("text") <= text.SUMMARY_LIMIT)
    return schemas.orphans(table(spark, sf_dir, "labels"), "doc_id", good, "doc_id").select("doc_id")


# --- packages --------------------------------------------------------------------------------------------------------

_PAYLOAD = f"""json_object('claims', [json_object('id', claim_id, 'qualifier', '{packages.QUALIFIER}', 'source_ids', [id], 'status', 'UNVERIFIED', 'text', claim_text, 'type', 'VENDOR_CLAIM')],
 'generation_mode', 'MOCK', 'generator', json_object('name', 'mock', 'version', 'mock-v1'), 'input_fingerprint', fp, 'mock_notice', '{packages.NOTICE}', 'package_id', package_id, 'publishable', false, 'schema_version', 1,
 'sources', [json_object('canonical_url', canonical_url, 'content_hash', content_hash, 'id', id, 'published_at', published_at, 'published_at_raw', published_at_raw, 'title', title)], 'story', json_object('id', story_id, 'title', title))::varchar"""


@query(f"with {_CHAIN}, one as (select * from (select *, row_number() over (partition by id order by position) as r from packaged) where r = 1) select package_id, story_id, fp as input_fingerprint, {_PAYLOAD} as payload_json from one")
def package_mock_payload(spark, sf_dir):
    return packages.mock_packages(store.first_wins(_snapshots(spark, sf_dir))).select("package_id", "story_id", "input_fingerprint", "payload_json")


@query(f"""with {_CHAIN}, one as (select * from (select *, row_number() over (partition by id order by position) as r from packaged) where r = 1)
select package_id, case when position % 6 = 0 then 'PAYLOAD' when position % 5 = 0 then 'IDENTITY' end as error_code from one""")
def package_revalidate(spark, sf_dir):
    """Stored packages with a changed payload or fingerprint are found by deriving them anew."""
    s = store.first_wins(_snapshots(spark, sf_dir))
    p = packages.mock_packages(s).join(s.select(identity.story_id(F.col("id")).alias("story_id"), "position"), "story_id")
    at = F.col("position")
    p = p.withColumns({"payload_json": F.when(at % 6 == 0, F.concat("payload_json", F.lit(" "))).otherwise(F.col("payload_json")), "input_fingerprint": F.when((at % 5 == 0) & (at % 6 != 0), F.reverse("input_fingerprint")).otherwise(F.col("input_fingerprint"))})
    return packages.mock_package_errors(p, s)


@query(f"""with {_SNAP}, one as (select id, min(position) as position from snap group by id)
select {_short("story_", "id")} as story_id, (position % 3)::bigint as n, case position % 3 when 0 then 'E_PACKAGE_NOT_BUILT' when 2 then 'E_PACKAGE_AMBIGUOUS' else 'OK' end as state from one""")
def package_cardinality(spark, sf_dir):
    """Stories with none, one or two packages."""
    s = store.first_wins(_snapshots(spark, sf_dir))
    stories = store.stories_of(s)
    p = s.select(identity.story_id(F.col("id")).alias("story_id"), F.explode(F.array_repeat(F.lit(1), (F.col("position") % 3).cast("int"))))
    return store.cardinality(p, stories)


@query(f"""with {_SNAP}, one as (select * from (select *, row_number() over (partition by id order by position) as r from snap) where r = 1),
f as (select id, {_short("story_", "id")} as story_id, sha256(json_object('generator', json_object('api_format', 'openai-chat-completions', 'model', 'deepseek-v4-flash', 'provider', 'deepseek', 'temperature', 0.2, 'thinking', 'disabled'),
 'prompt_sha256', 'test', 'prompt_version', 'f1f2-story-package-v1', 'request', json_object('max_tokens', 3000, 'response_format', json_object('type', 'json_object'), 'stream', false), 'schema_version', 2,
 'source', json_object('canonical_url', canonical_url, 'published_at', published_at, 'published_at_raw', published_at_raw, 'source_id', id, 'source_name', source || '.example.com', 'summary_text', summary_text, 'title', title), 'story_id', {_short("story_", "id")})::varchar) as input_fingerprint from one)
select id, story_id, input_fingerprint, {_short("pkg_", "'deepseek-story-package' || chr(10) || input_fingerprint")} as package_id from f""")
def package_provider_identity(spark, sf_dir):
    return packages.provider_identities(store.first_wins(_snapshots(spark, sf_dir)), "test")


@query(f"""with {_CHAIN}, one as (select * from (select *, row_number() over (partition by id order by position) as r from packaged) where r = 1)
select package_id, '# Story Package' || chr(10) || chr(10) || 'Generation mode: MOCK' || chr(10) || 'Publishable: false' || chr(10) || 'Warning: {packages.NOTICE}' || chr(10) || chr(10) || 'Package ID: `' || package_id || '`' || chr(10) || 'Story ID: `' || story_id || '`' || chr(10)
 || 'Story title: ' || regexp_replace(title, '([\\\\`*_{{}}\\[\\]<>()#+\\-.!|])', '\\\\\\1', 'g') || chr(10) || chr(10) || '## Source' || chr(10) || chr(10) || 'Source ID: `' || id || '`' || chr(10) || 'Canonical URL: ' || regexp_replace(canonical_url, '([\\\\`*_{{}}\\[\\]<>()#+\\-.!|])', '\\\\\\1', 'g') || chr(10)
 || 'Content hash: `' || content_hash || '`' || chr(10) || 'Published at: null' || chr(10) || coalesce('Published at raw: ' || published_at_raw || chr(10), '') || 'Title: ' || regexp_replace(title, '([\\\\`*_{{}}\\[\\]<>()#+\\-.!|])', '\\\\\\1', 'g') || chr(10) || chr(10) || '## Claim' || chr(10) || chr(10)
 || 'Claim ID: `' || claim_id || '`' || chr(10) || 'Text: ' || regexp_replace(claim_text, '([\\\\`*_{{}}\\[\\]<>()#+\\-.!|])', '\\\\\\1', 'g') || chr(10) || 'Type: VENDOR_CLAIM' || chr(10) || 'Status: UNVERIFIED' || chr(10) || 'Qualifier: ' || regexp_replace('{packages.QUALIFIER}', '([\\\\`*_{{}}\\[\\]<>()#+\\-.!|])', '\\\\\\1', 'g') || chr(10) || 'Source IDs: `' || id || '`' || chr(10) as markdown from one""")
def package_markdown(spark, sf_dir):
    p = packages.mock_packages(store.first_wins(_snapshots(spark, sf_dir)))
    kind = "package_id string, story struct<id: string, title: string>, sources array<struct<canonical_url: string, content_hash: string, id: string, published_at: string, published_at_raw: string, title: string>>, claims array<struct<id: string, qualifier: string, source_ids: array<string>, status: string, text: string, type: string>>"
    return p.withColumn("p", F.from_json("payload_json", kind)).select("package_id", sinks.mock_markdown(F.col("p")).alias("markdown"))


def _pretty_sql() -> str:
    """The package's JSON with sorted keys and two blanks a level, and a line feed; none of its values needs an escape."""
    q = lambda x: f"'\"' || {x} || '\"'"
    claim = {"id": q("claim_id"), "qualifier": q(f"'{packages.QUALIFIER}'"), "source_ids": [q("id")], "status": q("'UNVERIFIED'"), "text": q("claim_text"), "type": q("'VENDOR_CLAIM'")}
    source = {"canonical_url": q("canonical_url"), "content_hash": q("content_hash"), "id": q("id"), "published_at": "'null'", "published_at_raw": f"coalesce({q('published_at_raw')}, 'null')", "title": q("title")}
    value = {
        "claims": [claim], "generation_mode": q("'MOCK'"), "generator": {"name": q("'mock'"), "version": q("'mock-v1'")}, "input_fingerprint": q("fp"), "mock_notice": q(f"'{packages.NOTICE}'"), "package_id": q("package_id"), "publishable": "'false'",
        "schema_version": "'1'", "sources": [source], "story": {"id": q("story_id"), "title": q("title")},
    }

    def shown(x: object, deep: int) -> str:
        pad, end = " " * 2 * (deep + 1), " " * 2 * deep
        if isinstance(x, str):
            return x
        parts = [f"'{pad}\"{k}\": ' || {shown(v, deep + 1)}" for k, v in x.items()] if isinstance(x, dict) else [f"'{pad}' || {shown(v, deep + 1)}" for v in x]
        left, right = "{}" if isinstance(x, dict) else "[]"
        return f"'{left}' || chr(10) || " + " || ',' || chr(10) || ".join(parts) + f" || chr(10) || '{end}{right}'"

    return shown(value, 0) + " || chr(10)"


@query(f"""with {_CHAIN}, one as (select * from (select *, row_number() over (partition by id order by position) as r from packaged) where r = 1), p as (select package_id, {_pretty_sql()} as json from one),
f as (select package_id || '.json' as name, json as content from p union all select package_id || '.md', markdown from ({ORACLES["package_markdown"]}))
select name, strlen(content)::bigint as length, sha256(content) as sha256 from f""")
def package_exports(spark, sf_dir):
    """All packages exported as pairs of files, all at once, and the files that are there then."""
    p = cut(packages.mock_packages(store.first_wins(_snapshots(spark, sf_dir))).select("package_id", "generator_name", "payload_json"))
    out = f"{cuts_dir(spark)}/exports-{uuid.uuid4().hex}"
    export_sink.export(export_sink.package_groups(p.repartition("package_id")), out)
    names = p.select(F.explode(F.array(*[F.concat("package_id", F.lit(ending)) for ending in (".json", ".md")])).alias("name"))
    return export_sink.read(names, out).select("name", "length", F.sha2("content", 256).alias("sha256"))


_BROKEN = {  # rule: the answers (doc_id % 24) that break it; 22 is no JSON, 23 breaks none
    "object: keys": (0,), "story_id: string": (1,), "source_id: string": (2,), "working_title: string": (3,), "one_sentence_fact: string": (4,), "working_title: length": (3, 5), "editorial_format: literal": (6,),
    "one_sentence_fact: length": (4, 7), "why_it_matters: length": (8,), "editorial_angle: length": (9,), "claims: size": (10,), "claims: keys": (11,), "claims: fields": (12,), "claims: unique": (13,), "claims: evidence": (2, 14),
    "limitations: size": (15,), "limitations: required": (16,), "demonstration_plan: size": (17,), "publication_verdict: literal": (18,), "source_references: size": (19,), "source_references: keys": (20,), "source_references: source": (2, 21),
}
_LONG_FACT = " or (k not in (4, 7) and length(text) not between 1 and 2000)"
_RULES = ", ".join(f"""case when k in {(*ks, 22)}{_LONG_FACT if name == "one_sentence_fact: length" else ""} then '{name}' end""" for name, ks in _BROKEN.items())


@query(f"""with d as (select doc_id, text, doc_id % 24 as k from documents)
select doc_id, array_to_string(list_filter([{_RULES}], lambda x: x is not null)[1:8], '; ') as errors from d""")
def provider_answer_rules(spark, sf_dir):
    """An answer for each document, of which every 24th breaks the same rule: numbers, booleans, nulls and objects for texts,
    keys too many, repeated claims, something behind the answer."""
    k = F.col("doc_id") % 24

    def quoted(x: Column) -> Column:
        listed = F.to_json(F.array(x))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    def made(good: Column, **bad: str | Column) -> Column:
        for n, value in bad.items():
            good = F.when(k == int(n[1:]), F.lit(value) if isinstance(value, str) else value).otherwise(good)
        return good

    def obj(**values: Column) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), v) for n, v in values.items()]), F.lit("}"))

    def listed(*values: Column) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]"))

    word = lambda x: quoted(F.lit(x))
    own = quoted(F.concat(F.lit("src_"), "doc_id"))
    claim = dict(claim_id=word("claim_1"), text=quoted(F.coalesce("source", F.lit("-"))), status=word("VERIFIED"), confidence=word("HIGH"), evidence_source_id=made(own, k14='"src_x"'), use_in_script=made(F.lit("true"), k12='"true"'), qualification=word("q"))
    one, wide = obj(**claim), obj(**claim, note=F.lit('{"claim_id":"y"}'))
    reference = dict(source_id=made(own, k21='"src_x"'), canonical_url=word("https://example.com/"))
    limitation = word(packages.LIMITATION)
    answer = dict(
        story_id=made(quoted(F.concat(F.lit("story_"), "doc_id")), k1="5"), source_id=made(own, k2="true"), working_title=made(word('a "story_id": "title"'), k3="null", k5='""'), editorial_format=made(word("AI_SIGNAL"), k6='"AI_NOTE"'),
        one_sentence_fact=made(quoted(F.col("text")), k4='{"one_sentence_fact":"x"}', k7='""'), why_it_matters=made(word("w"), k8="7"), editorial_angle=made(word("a"), k9='""'), claims=made(listed(one), k10="[]", k11=listed(wide), k13=listed(one, one)),
        limitations=made(listed(limitation), k15=listed(limitation, F.lit("5")), k16='["other"]'), demonstration_plan=made(listed(word("p")), k17="{}"), publication_verdict=made(word("READY"), k18="false"),
        source_references=made(listed(obj(**reference)), k19=listed(obj(**reference), obj(**reference)), k20=listed(obj(**reference, x=F.lit("1")))),
    )
    content = made(obj(**answer), k0=obj(**answer, x=F.lit('{"story_id":"y"}')), k22=F.concat(obj(**answer), F.lit(" x")))
    rows = packages.draft_errors(table(spark, sf_dir, "documents").select("doc_id", content.alias("content")))
    return rows.select("doc_id", F.array_join("errors", "; ").alias("errors"))


# --- feeds -----------------------------------------------------------------------------------------------------------


@query("select source, doc_id, position from (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as position from documents) where position < 5")
def feed_limit_per_source(spark, sf_dir):
    """The first five items of each source, by position."""
    at = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return table(spark, sf_dir, "documents").select("source", "doc_id", at.cast("long").alias("position")).where("position < 5")


def _xml(x: str) -> F.Column:
    out = F.col(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@query(f"with {_SNAP} select id, canonical_url, title, summary_text, content_hash, published_at_raw from snap")
def feed_parse_rss(spark, sf_dir):
    """Each document becomes a feed of one item, is parsed, and must give its snapshot again."""
    d = table(spark, sf_dir, "documents")
    date = F.when(F.col("lang") == "de", F.lit("<pubDate>gestern</pubDate>")).otherwise("")
    xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><item><title>Report from '), "source", F.lit("  in "), "lang", F.lit(" </title><link> https://"), "source", F.lit(".example.com/"), "lang", F.lit("?utm_source=x</link><description>"), _xml("text"), F.lit("</description>"), date, F.lit("</item></channel></rss>"))
    raw = feeds.parsed(d.select(F.col("doc_id").cast("string").alias("path"), F.encode(xml, "UTF-8").alias("content")))
    return feeds.snapshots(raw, "2026-01-01T00:00:00Z")[0].select("id", "canonical_url", "title", "summary_text", "content_hash", "published_at_raw")


@query("""select doc_id::varchar as path, 'https://' || source || '.example.com/' as canonical_url, lang as title, '2026-07-14T07:30:00Z' as published_at from documents where length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 10000""")
def feed_parse_atom(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    xml = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), "lang", F.lit('</title><link rel="self" href="x"/><link href="https://'), "source", F.lit('.example.com"/><updated>2026-07-14T10:30:00+03:00</updated><summary>'), _xml("text"), F.lit("</summary></entry><entry><title/></entry></feed>"))
    raw = feeds.parsed(d.select(F.col("doc_id").cast("string").alias("path"), F.encode(xml, "UTF-8").alias("content")), live=True, limit=1)
    return feeds.snapshots(raw, "2026-01-01T00:00:00Z", live=True, source_name="atom")[0].select("path", "canonical_url", "title", "published_at")


@query(f"with {_SNAP} select position::varchar as path, 'E_FIXTURE_INVALID' as error_code from raw where position not in (select position from good)")
def feed_rejections(spark, sf_dir):
    """The documents that a feed parse rejects, with the code of the first error."""
    d = table(spark, sf_dir, "documents")
    xml = F.concat(F.lit("<rss><channel><item><title>t</title><link>https://a.example.com</link><description>"), _xml("text"), F.lit("</description></item></channel></rss>"))
    raw = feeds.parsed(d.select(F.col("doc_id").cast("string").alias("path"), F.encode(xml, "UTF-8").alias("content")))
    return feeds.snapshots(raw, "")[1].select("path", "error_code")


_XML = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_FEED_ITEM = f"""'<item><title>Report ' || doc_id || '</title><link>https://example.com/' || doc_id || '</link><description>' || {_XML} || '</description></item>'"""


@query(f"""with d as (select coalesce(source, '') || '-' || coalesce(lang, '') || '-' || (doc_id // 2000) as feed, doc_id, coalesce(text, '') as text from documents),
i as (select feed, doc_id, text, strlen({_FEED_ITEM}) as size from d),
n as (select *, row_number() over (partition by feed order by doc_id) - 1 as position, count(*) over (partition by feed) as items, sum(size) over (partition by feed) + {len("<rss><channel></channel></rss>") + 1} as bytes from i)
select feed, position::integer as position, 'Report ' || doc_id as title, text as summary, null::varchar as error from n where bytes <= {feeds.MAX_BYTES} and items <= {feeds.MAX_ITEMS}
union all select distinct feed, 0, null, null, case when bytes > {feeds.MAX_BYTES} then 'size' else 'items' end from n where bytes > {feeds.MAX_BYTES} or items > {feeds.MAX_ITEMS}""")
def feed_source_items(spark, sf_dir):
    """Documents written as feed files, and their items read back by the data source."""
    feed = F.concat(F.coalesce("source", F.lit("")), F.lit("-"), F.coalesce("lang", F.lit("")), F.lit("-"), F.floor(F.col("doc_id") / 2000))
    escaped = F.coalesce("text", F.lit(""))
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(name))
    item = F.concat(F.lit("<item><title>Report "), "doc_id", F.lit("</title><link>https://example.com/"), "doc_id", F.lit("</link><description>"), escaped, F.lit("</description></item>"))
    items = F.array_sort(F.collect_list(F.struct("doc_id", "item")))
    xml = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(items, lambda x: x["item"]), ""), F.lit("</channel></rss>"))
    landing = f"{cuts_dir(spark)}/feeds-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select(feed.alias("feed"), "doc_id", item.alias("item")).groupBy("feed").agg(xml.alias("value")).write.partitionBy("feed").text(landing)
    spark.dataSource.register(FeedSource)
    rows = spark.read.format("feed").load(landing)
    return rows.select(F.regexp_extract("path", "feed=([^/]*)/", 1).alias("feed"), "position", "title", "summary", "error")


# --- experiment ------------------------------------------------------------------------------------------------------


@query("select count(*)::bigint as n_rows, count(distinct event_id)::bigint as n_ids, count(distinct user_id)::bigint as n_leads, count(*) >= 24 and count(*) = count(distinct event_id) and count(distinct user_id) = 10 as valid from events")
def events_quality_checks(spark, sf_dir):
    return experiment.event_log_checks(table(spark, sf_dir, "events"), leads="user_id")


@query("""select event_type, count(*)::bigint as n, median(user_id)::double as median_user, min(user_id)::varchar || '-' || max(user_id)::varchar as user_range, sum(user_id)::bigint as user_total,
count(*) filter (value > 10)::bigint as n_high, case when bool_and(value is not null) then sum(value::decimal(18,2)) end::double as value_total from events group by event_type""")
def events_group_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("amount", F.col("value").cast("decimal(18,2)"))
    out = e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("user_total"), F.count_if(F.col("value") > 10).alias("n_high"), experiment.all_or_null("amount", "double").alias("value_total"))
    out = statistics.with_order_statistics(out, e, "event_type", ["user_id"])
    return out.select("event_type", "n", F.col("median_user_id").cast("double").alias("median_user"), F.col("range_user_id").alias("user_range"), "user_total", "n_high", "value_total")


# The mean of two decimals is printed with the digits of the more exact one, or one more.
_DIGITS = "length(regexp_extract({}, '\\.([0-9]*)$', 1))"
_PLAIN = "case when {0} then rtrim(rtrim({1}::varchar, '0'), '.') else {1}::varchar end"


@query(f"""with v as (select case when l_orderkey % 10 = 0 then l_returnflag else 'most' end as k, l_extendedprice::decimal(18,2) as x, {_PLAIN.format("l_linenumber % 2 = 0", "l_extendedprice::decimal(18,2)")} as t,
  l_orderkey * 10 + l_linenumber as o from lineitem),
r as (select *, row_number() over (partition by k order by x, o) as i, count(*) over (partition by k) as n from v),
m as (select k, n, min_by(t, i) as a, max_by(t, i) as b, min(x) as p, max(x) as q from r where i in ((n + 1) // 2, n // 2 + 1) group by k, n),
h as (select *, ((p + q) * 500)::decimal(38,0)::bigint as thousandths, greatest({_DIGITS.format("a")}, {_DIGITS.format("b")}) as d from m),
f as (select *, (thousandths // 1000)::varchar as whole, lpad((thousandths % 1000)::varchar, 3, '0') || '0' as rest from h),
g as (select k, n, (p + q)::double / 2 as median, case when n % 2 = 1 then a when substr(rest, d + 1, 1) <> '0' then whole || '.' || substr(rest, 1, d + 1) when d = 0 then whole else whole || '.' || substr(rest, 1, d) end as median_text from f),
u as (select k, x, min_by(t, o) as t from v group by k, x),
e as (select k, min_by(t, x) || '-' || max_by(t, x) as range from u group by k)
select k, n::bigint as n, median, median_text, range from g join e using (k)""")
def analysis_exact_medians(spark, sf_dir):
    """Medians and ranges of prices as decimals, some printed with trailing zeros; one group has nine tenths of all rows."""
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    shown = F.when(F.col("l_linenumber") % 2 == 0, F.regexp_replace(F.regexp_replace(price, "0+$", ""), r"\.$", "")).otherwise(price)
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 10 == 0, F.col("l_returnflag")).otherwise("most").alias("k"), shown.alias("price"), F.lpad((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"), 20, "0").alias("o"))
    found = statistics.order_statistics(rows, "k", ["price"], "o")
    return found.select("k", "n", F.col("median").cast("double").alias("median"), "median_text", F.concat("low_text", F.lit("-"), "high_text").alias("range"))


@query("""select doc_id, quality + toxic as total_score, case when quality not between 0 and 1 then 'quality' when toxic not between 0 and 1 then 'toxic' when toxic > 0 and doc_id % 2 = 0 then 'critical_error_notes' when doc_id % 13 = 0 then 'review_complete' end as error from labels""")
def scores_total_and_rules(spark, sf_dir):
    s = table(spark, sf_dir, "labels").withColumns({"critical_error_count": F.col("toxic"), "critical_error_notes": F.when(F.col("doc_id") % 2 == 1, F.lit("seen")), "review_complete": F.col("doc_id") % 13 != 0})
    return experiment.score_errors(s, {"quality": 1, "toxic": 1}).select("doc_id", "total_score", "error")


@query("""select doc_id, case when doc_id % 4 = 3 then 'minutes' when doc_id % 5 = 4 then 'accepted' when doc_id % 5 = 1 and toxic = 0 then 'notes' end as error from labels""")
def corrections_rules(spark, sf_dir):
    d = F.col("doc_id")
    accepted = F.when(d % 5 == 4, "yes").when(d % 5 == 1, "false").otherwise("true")
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(d % 4 == 3, "20.5").otherwise("4.5").alias("minutes"), accepted.alias("accepted"), F.when(F.col("toxic") > 0, "x").otherwise("").alias("notes"), *[F.lit("").alias(c) for c in ("critical_fixes", "major_additions", "minor_edits")], F.lit("true").alias("timer_complete"))
    return experiment.correction_errors(rows).select("doc_id", "error")


_RUNS = """runs as (select l.doc_id, d.source as model_key, l.quality * 2 + l.toxic as total_score, l.toxic as critical_error_count, (d.n_chars % 41)::decimal(10,1) / 2 as minutes, l.quality = 1 as accepted, d.n_chars as latency, d.n_chars % 17 <> 0 as cost_available,
  (d.n_chars::decimal(18,6) / 1000000)::decimal(18,6) as direct_cost_usd, case when d.n_chars % 50 <> 0 then d.n_chars end as input_tokens from labels l join documents d using (doc_id))"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    n = F.col("n_chars")
    return labels.join(d, "doc_id").select(
        "doc_id", F.col("source").alias("model_key"), (F.col("quality") * 2 + F.col("toxic")).alias("total_score"), F.col("toxic").alias("critical_error_count"), F.regexp_replace(((n % 41).cast("decimal(10,1)") / 2).cast("decimal(10,1)").cast("string"), r"\.0$", "").alias("minutes_text"),
        (F.col("quality") == 1).alias("accepted"), n.cast("double").alias("latency_seconds"), (n % 17 != 0).alias("cost_available"), (n.cast("decimal(18,6)") / 1_000_000).cast("decimal(18,6)").alias("direct_cost_usd"), F.when(n % 50 != 0, n).alias("input_tokens"), n.alias("output_tokens"),
    )


@query(f"""with {_RUNS} select model_key, count(*)::bigint as n, median(total_score)::double as median_score, min(total_score)::varchar || '-' || max(total_score)::varchar as score_range, sum(critical_error_count)::bigint as critical_error_total,
count(*) filter (critical_error_count > 0)::bigint as outputs_with_critical_errors, median(minutes::double) as median_correction_minutes, rtrim(rtrim(min(minutes)::varchar, '0'), '.') || '-' || rtrim(rtrim(max(minutes)::varchar, '0'), '.') as correction_range, count(*) filter (accepted)::bigint as accepted_within_20, median(latency::double) as median_latency_seconds,
bool_and(cost_available) as direct_cost_available, coalesce(case when bool_and(input_tokens is not null) then sum(input_tokens) end, -1)::bigint as input_tokens_total, sum(latency)::bigint as output_tokens_total from runs group by model_key""")
def analysis_join_metrics(spark, sf_dir):
    m = experiment.metrics(_runs(spark, sf_dir))
    return m.select("model_key", "n", "median_score", "score_range", "critical_error_total", "outputs_with_critical_errors", F.col("median_correction_minutes").cast("double").alias("median_correction_minutes"), "correction_range", "accepted_within_20", "median_latency_seconds", "direct_cost_available", F.coalesce("input_tokens_total", F.lit(-1)).alias("input_tokens_total"), "output_tokens_total")


@query("""with d as (select a.doc_id as a, b.doc_id as b, (a.quality - b.quality) * 2 as score, (a.toxic - b.toxic) * 2 as critical, (a.doc_id % 21 - b.doc_id % 21) as correction, (a.quality - b.quality) * 3 as accepted from labels a join labels b on b.doc_id = a.doc_id + 1)
select a, b, case when score >= 1 and critical <= 0 and correction <= 5 then 'A' when score <= -1 and critical >= 0 and correction >= -5 then 'B' when critical <= -2 and score >= -1.5 then 'A' when critical >= 2 and score <= 1.5 then 'B'
when accepted >= 2 and critical <= 0 then 'A' when accepted <= -2 and critical >= 0 then 'B' else 'MIXED' end as verdict from d""")
def verdict_rules(spark, sf_dir):
    """The ordered rules on the differences between neighbouring labels."""
    one = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    two = one.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("quality").alias("q2"), F.col("toxic").alias("t2"))
    d = one.join(two, "doc_id")
    score, critical, accepted = (F.col("quality") - F.col("q2")) * 2, (F.col("toxic") - F.col("t2")) * 2, (F.col("quality") - F.col("q2")) * 3
    return d.select(F.col("doc_id").alias("a"), "b", experiment.verdict_case(score, critical, F.col("doc_id") % 21 - F.col("b") % 21, accepted, "A", "B").alias("verdict"))


@query("""select coalesce(a.doc_id, e.doc_id) as output_id from labels a full join (select doc_id, lang from documents) e using (doc_id) where a.doc_id is null or (a.quality = 1) <> (e.lang <> 'de')""")
def blind_mapping_validate(spark, sf_dir):
    """Rows of two mappings that differ, or that only one has."""
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("output_id"), (F.col("quality") == 1).alias("good"))
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("output_id"), (F.col("lang") != "de").alias("good"))
    return experiment.mapping_mismatches(a, e, ["good"])


@query("""select doc_id, case when quality = 1 and toxic = 0 then ((doc_id * 2.50 + (doc_id + 7) * 15.00) / 1000000)::double end as cost_usd from labels""")
def token_cost(spark, sf_dir):
    d = F.col("doc_id").cast("decimal(20,0)")
    price = experiment.cost(d, F.when(F.col("quality") == 1, d + 7), F.lit("2.50").cast("decimal(10,2)"), F.lit("15.00").cast("decimal(10,2)"), F.col("toxic"))
    return table(spark, sf_dir, "labels").select("doc_id", price.cast("double").alias("cost_usd"))


@query("""with e as (select doc_id as name, sha256(text) as h from documents), a as (select doc_id as name, sha256(case when doc_id % 10 = 0 then text || '!' else text end) as h from documents where doc_id % 9 <> 0 union all select -item_id - 1, sha256(text) from benchmark)
select coalesce(e.name, a.name) as name, case when a.h is null then 'missing' when e.h is null then 'extra' when a.h <> e.h then 'changed' else 'same' end as state from e full join a on e.name = a.name""")
def inventory_hash_diff(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    e = d.select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    a = d.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("name"), F.sha2(changed, 256).alias("sha256")).union(b.select(-F.col("item_id") - 1, F.sha2("text", 256)))
    return experiment.inventory_diff(e, a)


@query("""with s as (select conv_id, count(*) filter (role = 'assistant')::bigint as done, min(case when role <> 'assistant' then turn end) as pending, count(*) as n from conversations group by conv_id)
select conv_id, pending, case when done < 2 then 'execute or import turn ' || pending when n % 2 = 1 then 'run blind' when conv_id % 3 = 0 then 'complete scores.csv and correction_log.csv, then validate-human-input' when conv_id % 5 = 0 then 'run analyze' else 'run evidence-manifest and complete owner QA' end as next_action from s""")
def status_next_action(spark, sf_dir):
    slots = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), (F.col("role") == "assistant").alias("completed"))
    s = slots.groupBy("conv_id").agg(F.count_if("completed").alias("done"), experiment.next_pending(slots).alias("pending"), F.count("*").alias("n"))
    action = experiment.next_action(F.col("done"), F.concat(F.lit("turn "), F.col("pending").cast("string")), F.col("n") % 2 == 0, F.col("conv_id") % 3 != 0, F.col("conv_id") % 5 != 0, wanted=2)
    return s.select("conv_id", "pending", action.alias("next_action"))


# --- ledgers, digests, blinding ---------------------------------------------------------------------------------------

_LOG = """log as (select user_id as x, event_id as seq, case when event_type in (select min(event_type) from events) then 'invalidated' else 'completed' end as kind, (event_id % 8)::integer as p, case when event_id % 5 = 0 then '  ' else ' broke ' end as reason,
 sha256(event_id::varchar) as output_sha256, row_number() over (partition by user_id order by event_id) as n from events),
r as (select distinct x, 0::bigint as n, 0 as done, 0 as op, false as rep, null::bigint as seq, null::varchar as error from log
 union all select x, n, case when error is null and kind = 'completed' and op = 0 then done + 1 else done end, case when error is not null then op when kind = 'completed' then 0 else p end, rep or (error is null and kind = 'invalidated'), seq, error
 from (select log.x, log.n, r.done, r.op, r.rep, log.seq, log.kind, log.p, case when log.p not between 1 and 6 then 'PATH_UNSAFE' when log.kind = 'completed' then case when log.p <> case when r.op > 0 then r.op else r.done + 1 end then 'RUN_ORDER_VIOLATION' end
   when trim(log.reason) = '' then 'HUMAN_INPUT_INVALID' when r.rep then 'MORE_THAN_ONE_INVALID_REPLACEMENT' when log.p > r.done or log.p = r.op then 'RUN_NOT_COMPLETE' end as error from r join log on log.x = r.x and log.n = r.n + 1))"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of completed and invalidated runs, an experiment for each user."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type")).first()[0]
    return e.select(
        F.col("user_id").alias("experiment"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == first, ledger.INVALIDATED).otherwise(ledger.COMPLETED).alias("kind"), (F.col("event_id") % 8).cast("int").alias("position"),
        F.when(F.col("event_id") % 5 == 0, "  ").otherwise(" broke ").alias("reason"), F.sha2(F.col("event_id").cast("string"), 256).alias("output_sha256"),
    )


@query(f"""with recursive {_LOG} select x::varchar as experiment, seq, error is null as accepted, error as error_code, done - (op > 0)::integer as completed, case when op > 0 then op when done < 6 then done + 1 else 0 end as pending, rep as replaced from r where n > 0""")
def run_ledger_states(spark, sf_dir):
    """What every event of the log did, and the state after it."""
    return ledger.replay(_log(spark, sf_dir)).withColumn("pending", F.coalesce("pending", F.lit(0)))


@query(f"""with recursive {_LOG}, good as (select log.* from log join r on r.x = log.x and r.seq = log.seq where r.error is null),
i as (select * from good where kind = 'invalidated')
select i.x::varchar as experiment, i.p as position, i.seq as invalidated_seq, trim(i.reason) as reason, max(d.seq) filter (d.seq < i.seq) as completed_seq, max(d.output_sha256) filter (d.seq < i.seq) as output_sha256, coalesce(min(d.seq) filter (d.seq > i.seq), -1) as replaced_seq
from i left join good d on d.x = i.x and d.p = i.p and d.kind = 'completed' group by 1, 2, 3, 4""")
def run_ledger_archive(spark, sf_dir):
    """The runs that were declared invalid, and those in their place."""
    return ledger.archive(_log(spark, sf_dir)).withColumn("replaced_seq", F.coalesce("replaced_seq", F.lit(-1)))


@query(f"""with recursive {_LOG}, m as (select x, (seq // 3) * 3 as moment from log group by 1, 2), s as (select m.x, m.moment, max(r.n) as n from m join r on r.x = m.x and (r.seq <= m.moment or r.n = 0) group by 1, 2)
select x::varchar as experiment, moment as seq, done - (op > 0)::integer as completed, case when op > 0 then op when done < 6 then done + 1 else 0 end as pending, rep as replaced from s join r using (x, n)""")
def run_ledger_as_of(spark, sf_dir):
    """The state as of moments that mostly are no event's own."""
    log = _log(spark, sf_dir)
    return ledger.as_of(log, log.select("experiment", (F.floor(F.col("seq") / 3) * 3).alias("seq"))).withColumn("pending", F.coalesce("pending", F.lit(0)))


_TREE = """leaf as (select s || '/' || l || '/' || doc_id || '.txt' as path, doc_id || '.txt' as name, s, l, sha256(t) as digest from (select doc_id, coalesce(source, 'none') as s, coalesce(lang, 'none') as l, coalesce(text, '') as t from documents)),
a1 as (select s, l, substr(sha256(name), 1, 3) as g, sha256(string_agg(name || chr(0) || 'file' || chr(0) || digest, chr(10) order by name || chr(0) || 'file' || chr(0) || digest)) as d, count(*) as n from leaf group by all),
a2 as (select s, l, sha256(string_agg(g || ' ' || d, chr(10) order by g)) as d, sum(n) as n from a1 group by s, l),
b1 as (select s, substr(sha256(l), 1, 3) as g, sha256(string_agg(l || chr(0) || 'folder' || chr(0) || d, chr(10) order by l)) as d, sum(n) as n from a2 group by all),
b2 as (select s, sha256(string_agg(g || ' ' || d, chr(10) order by g)) as d, sum(n) as n from b1 group by s),
c1 as (select substr(sha256(s), 1, 3) as g, sha256(string_agg(s || chr(0) || 'folder' || chr(0) || d, chr(10) order by s)) as d, sum(n) as n from b2 group by all),
c2 as (select sha256(string_agg(g || ' ' || d, chr(10) order by g)) as d, sum(n) as n from c1)"""


def _as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in folders by source and language."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query(f"""with {_TREE} select path, 3 as depth, 'file' as kind, digest, 1::bigint as files from leaf union all select s || '/' || l, 2, 'folder', d, n::bigint from a2 union all select s, 1, 'folder', d, n::bigint from b2 union all select '', 0, 'folder', d, n::bigint from c2 where d is not null""")
def digest_tree(spark, sf_dir):
    return digests.tree(_as_files(spark, sf_dir))


@query("""with leaf as (select doc_id, coalesce(source, 'none') as s, coalesce(lang, 'none') as l, doc_id % 211 = 0 as changed, doc_id % 223 = 0 as gone, doc_id % 227 = 0 as new from documents),
state as (select *, case when gone and new then null when gone then 'missing' when new then 'extra' when changed then 'changed' end as st, case when not new then s || '/' || l end as old, case when not gone then s || '/' || l end as cur from leaf),
dirs as (select s, s || '/' || l as d, bool_or(not new) as had, bool_or(not gone) as has, bool_or(st is not null) as touched from state group by all),
tops as (select s, bool_or(had) as had, bool_or(has) as has, bool_or(touched) as touched from dirs group by s)
select s || '/' || l || '/' || doc_id || '.txt' as path, 3 as depth, 'file' as kind, st as state from state join tops using (s) where st is not null
and exists (select 1 from dirs where dirs.d = s || '/' || l and dirs.touched)
union all select d, 2, 'folder', case when not has then 'missing' when not had then 'extra' else 'changed' end from dirs where touched and (had or has)
union all select s, 1, 'folder', case when not has then 'missing' when not had then 'extra' else 'changed' end from tops where touched and (had or has)
union all select '', 0, 'folder', 'changed' where exists (select 1 from tops where touched)""")
def digest_differences(spark, sf_dir):
    """Files that were changed, lost or added, and the folders that lead to them."""
    files = _as_files(spark, sf_dir)
    expected = digests.tree(files.where("doc_id % 227 <> 0"))
    changed = F.when(F.col("doc_id") % 211 == 0, F.reverse("sha256")).otherwise(F.col("sha256"))
    return digests.differences(expected, digests.tree(files.where("doc_id % 223 <> 0").withColumn("sha256", changed)))


@query()
def blind_orders(spark, sf_dir):
    """The seeded order of six runs for each customer. SQL has no such generator."""
    return blinding.blind_orders(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("experiment"), F.concat("c_name", F.lit("/"), "c_mktsegment").alias("seed")))


@query()
def blind_artifacts(spark, sf_dir):
    """Every six documents are the runs of an experiment: its blind files, their lengths and hashes, or why it has none."""
    d = table(spark, sf_dir, "documents")
    outputs = d.select(F.floor(F.col("doc_id") / 6).alias("experiment"), F.concat(F.lit("run_0"), F.col("doc_id") % 6 + 1).alias("run_id"), "text")
    models = spark.range(1, 7).select(F.concat(F.lit("run_0"), "id").alias("run_id"), F.when(F.col("id") % 2 == 0, "sol").otherwise("terra").alias("model_key"), F.when(F.col("id") % 2 == 0, _IDENTITIES[0]).otherwise(_IDENTITIES[1]).alias("model_id"))
    out = blinding.artifacts(outputs.select("experiment", F.col("experiment").alias("seed")).distinct(), outputs, models, _IDENTITIES, _ALIASES)
    return out.select("experiment", "error_code", F.explode_outer("files").alias("f")).select("experiment", "error_code", F.col("f.name").alias("name"), F.octet_length("f.content").alias("length"), F.sha2("f.content", 256).alias("sha256"))


_SYLLABLES = "an ar as at ea ed en er es ha he in is it nd ng nt on or re st th ti".split()


@query(rf"""with s as (select unnest({_SYLLABLES}) as x), names as (select a.x || b.x || c.x as name from s a, s b, s c),
t as (select row_number() over () as r, conv_id, turn, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') as parts from conversations),
p as (select r, conv_id, turn, unnest(parts) as part, unnest(range(len(parts))) as i from t)
select conv_id, turn, string_agg(case when name is null then part else '[MODEL]' end, '' order by i) as text, count(name) as removed from p left join names on lower(part) = name group by r, conv_id, turn""")
def redact_many_words(spark, sf_dir):
    """More than 12,000 names, all combinations of three syllables, taken out of all conversations as whole words in one pass."""
    names = [a + b + c for a in _SYLLABLES for b in _SYLLABLES for c in _SYLLABLES]
    done = redaction.redact_many(F.col("text"), [], names)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", done.alias("r")).select("conv_id", "turn", "r.text", "r.removed")


# --- scripts and timing ----------------------------------------------------------------------------------------------

_CLAIMS = """c0 as (select conv_id, turn, 'claim_' || turn as claim_id, text, case when turn % 5 = 4 then 'UNVERIFIED' when role = 'assistant' then 'VENDOR_CLAIM' when turn % 3 = 2 then 'VERIFIED' else 'OPINION' end as status, turn % 7 <> 6 and turn % 5 <> 4 as used, 'Said in turn ' || turn as qualification from conversations),
allowed as (select *, row_number() over (partition by conv_id order by turn) - 1 as pos from c0 where used and status <> 'UNVERIFIED'),
best as (select conv_id, arg_min(turn, case status when 'VERIFIED' then 0 when 'VENDOR_CLAIM' then 1000 else 2000 end + turn) as turn from (select *, row_number() over (partition by conv_id, status order by turn) as r from allowed) where r = 1 and (status in ('VERIFIED', 'VENDOR_CLAIM')) group by conv_id
  union all select conv_id, min(turn) from allowed group by conv_id having count(*) filter (status in ('VERIFIED', 'VENDOR_CLAIM')) = 0),
rest as (select a.*, row_number() over (partition by a.conv_id order by a.turn) - 1 as k, count(*) over (partition by a.conv_id) as n from allowed a join best b on a.conv_id = b.conv_id and a.turn <> b.turn),
parted as (select *, k // greatest(1, (n + 3) // 4) as part from rest)"""


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a package: its turns are the claims, in order."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    status = F.when(t % 5 == 4, "UNVERIFIED").when(F.col("role") == "assistant", "VENDOR_CLAIM").when(t % 3 == 2, "VERIFIED").otherwise("OPINION")
    claim = F.struct("turn", F.concat(F.lit("claim_"), t.cast("string")).alias("claim_id"), F.col("text").alias("text"), status.alias("status"), F.lit("LOW").alias("confidence"), F.lit("src").alias("evidence_source_id"), ((t % 7 != 6) & (t % 5 != 4)).alias("use_in_script"), F.concat(F.lit("Said in turn "), t.cast("string")).alias("qualification"))
    p = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(claim)).alias("claims"))  # bounded by a conversation's turns
    return p.select(
        "conv_id", F.concat(F.lit("pkg_"), "conv_id").alias("package_id"), F.lit("A title").alias("working_title"), "claims", F.array(F.lit("Only this was read.")).alias("limitations"),
        F.when(F.col("conv_id") % 2 == 0, "NEEDS_TEST").otherwise("READY").alias("publication_verdict"), F.array(F.struct(F.lit("src").alias("source_id"), F.lit("https://www.example.com/a").alias("canonical_url"))).alias("source_references"),
    )


@query(f"with {_CLAIMS} select a.conv_id, count(*)::bigint as n_allowed, any_value('claim_' || b.turn) as strongest from allowed a join best b using (conv_id) group by a.conv_id")
def claims_allowed_strongest(spark, sf_dir):
    p = _packages(spark, sf_dir).withColumn("allowed", packages.allowed_claims(F.col("claims"))).where(F.size("allowed") > 0)
    return p.select("conv_id", F.size("allowed").cast("long").alias("n_allowed"), scripts.strongest(F.col("allowed"))["claim_id"].alias("strongest"))


@query(f"""with {_CLAIMS} select conv_id, part::bigint as part, string_agg(claim_id, ',' order by turn) as claim_ids, string_agg(case k % 4 when 0 then '{scripts.TRANSITIONS[0]}' when 1 then '{scripts.TRANSITIONS[1]}' when 2 then '{scripts.TRANSITIONS[2]}' else '{scripts.TRANSITIONS[3]}' end, '|' order by turn) as transitions from parted group by conv_id, part""")
def claims_chunk_scenes(spark, sf_dir):
    p = _packages(spark, sf_dir).withColumn("allowed", packages.allowed_claims(F.col("claims"))).where(F.size("allowed") > 0)
    p = p.withColumn("best", scripts.strongest(F.col("allowed"))).withColumn("rest", F.filter("allowed", lambda c: c["claim_id"] != F.col("best.claim_id"))).withColumn("step", scripts.chunk_size(F.size("rest")))
    parts = p.select("conv_id", "step", F.posexplode(scripts.chunks(F.col("rest"))).alias("part", "claims"))
    said = F.transform("claims", lambda c, i: scripts.transition(F.col("part") * F.col("step") + i))
    return parts.select("conv_id", F.col("part").cast("long").alias("part"), F.array_join(F.transform("claims", lambda c: c["claim_id"]), ",").alias("claim_ids"), F.array_join(said, "|").alias("transitions"))


_EVIDENCE = "case b.status " + " ".join(f"when '{k}' then '{v}'" for k, v in scripts.EVIDENCE.items()) + " end"
_COMPOSE = f"""{_CLAIMS},
b as (select a.* from allowed a join best using (conv_id, turn)),
told as (select conv_id, part, string_agg(case k % 4 when 0 then '{scripts.TRANSITIONS[0]}' when 1 then '{scripts.TRANSITIONS[1]}' when 2 then '{scripts.TRANSITIONS[2]}' else '{scripts.TRANSITIONS[3]}' end || ' ' || text || ' ' || qualification || '.', ' ' order by turn) as narration from parted group by conv_id, part),
base as (select conv_id, 0 as o, '{scripts.HEADINGS[0]}: ' || text as narration from b union all select conv_id, 1 + part, narration from told
  union all select b.conv_id, 10, b.qualification || '. ' || {_EVIDENCE} || case when b.conv_id % 2 = 0 then ' {scripts.NOT_TESTED}' else '' end from b union all select conv_id, 11, 'Only this was read.' from b union all select conv_id, 12, '{scripts.TAKEAWAY}' from b),
sized as (select conv_id, count(*) as scenes, sum({_words("narration")}) as words from base group by conv_id),
needed as (select *, case when words >= 110 then 0 when words + 11 >= 110 then 1 when words + 18 >= 110 then 2 when words + 24 >= 110 then 3 else 4 end as k0 from sized),
pads as (select *, case when scenes < 5 then greatest(1, k0) else k0 end as k from needed),
phrases as (select *, array_to_string((['{scripts.PADDING[0]}', '{scripts.PADDING[1]}', '{scripts.PADDING[2]}', '{scripts.PADDING[3]}'])[1:k], ' ') as said from pads),
scenes as (select b.conv_id, case when b.o = 10 and p.k > 0 and p.scenes >= 8 then b.narration || ' ' || p.said else b.narration end as narration, b.o from base b join phrases p using (conv_id)
  union all select conv_id, said, 11.5 from phrases where k > 0 and scenes < 8)"""


@query(f"with {_COMPOSE}, t as (select conv_id, count(*) as scenes, string_agg(narration, ' ' order by o) as spoken_text from scenes group by conv_id) select conv_id, scenes::bigint as n_scenes, spoken_text, {_words('spoken_text')} as word_count, case when {_words('spoken_text')} not between 90 and 170 or scenes not between 5 and 8 then 'E_SCRIPT_OUTPUT' end as error_code from t")
def script_compose(spark, sf_dir):
    s = scripts.compose(_packages(spark, sf_dir).where(F.exists("claims", lambda c: c["use_in_script"] & (c["status"] != "UNVERIFIED"))))
    return s.select("conv_id", F.size("scenes").cast("long").alias("n_scenes"), "spoken_text", "word_count", "error_code")


@query(f"""with {_COMPOSE}, t as (select conv_id, count(*) as scenes, string_agg(narration, ' ' order by o) as spoken_text from scenes group by conv_id), w as (select *, {_words("spoken_text")} as n from t)
select {_short("pkg_", "conv_id::varchar")} as package_id, spoken_text, n::integer as word_count, scenes::integer as n_scenes from w where n between 90 and 170 and scenes between 5 and 8""")
def script_files_reload(spark, sf_dir):
    """Scripts written as pairs of files and read back, all of them valid."""
    rows = _packages(spark, sf_dir).where(F.exists("claims", lambda c: c["use_in_script"] & (c["status"] != "UNVERIFIED")))
    rows = rows.withColumns({"package_id": identity.short("pkg_", F.col("conv_id").cast("string")), "story_id": identity.short("story_", F.col("conv_id").cast("string")), "payload_json": F.to_json(F.struct("conv_id", "claims"))})
    out = f"{cuts_dir(spark)}/scripts-{uuid.uuid4().hex}"
    done = cut(script_files.finished(scripts.with_identity(scripts.compose(rows))))
    script_files.write(done, out)
    names = done.where("error_code is null").select(F.concat("script_id", F.lit(".json")).alias("name"))
    stored = script_files.load(export_sink.read(names, out).withColumnRenamed("name", "path"))
    return stored.where("error_code is null").select("package_id", "spoken_text", "word_count", F.size("scenes").alias("n_scenes"))


@query(f"with {_COMPOSE} select conv_id, k::bigint as n_padding from pads")
def script_padding(spark, sf_dir):
    s = scripts.compose(_packages(spark, sf_dir).where(F.exists("claims", lambda c: c["use_in_script"] & (c["status"] != "UNVERIFIED"))))
    return s.select("conv_id", F.col("pads").cast("long").alias("n_padding"))


@query(f"with {_COMPOSE} select distinct conv_id, null::varchar as error from pads")
def script_validate(spark, sf_dir):
    """Every composed script keeps the rules of shape and coverage."""
    s = scripts.compose(_packages(spark, sf_dir).where(F.exists("claims", lambda c: c["use_in_script"] & (c["status"] != "UNVERIFIED"))))
    errors = scripts.script_errors(s.withColumn("package_id", F.col("conv_id")))
    # texts without Cyrillic words have the fixed Russian phrases, so the language rule holds
    return errors.select(F.col("package_id").alias("conv_id"), "error")


#: What is changed in a script -> the rule that must find it.
_CHANGES = {v: v for v in ("order", "hook", "spoken_text", "word_count", "language", "unique", "unknown", "told", "coverage", "qualification")} | {"on_screen_text": "scenes", "title": "script_title"}


@query(f"with {_COMPOSE} select p.conv_id, c.variant, c.error from (select distinct conv_id from pads) p cross join (values {', '.join(f"('{v}', '{e}')" for v, e in _CHANGES.items())}) c(variant, error)")
def script_changes_found(spark, sf_dir):
    """Every composed script once for each rule of shape, coverage and derivation, with one change that this rule must find."""
    s = scripts.compose(_packages(spark, sf_dir).where(F.exists("claims", lambda c: c["use_in_script"] & (c["status"] != "UNVERIFIED"))))
    s = s.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in _CHANGES]))).withColumn("package_id", F.struct("conv_id", "variant"))

    def when(variant: str, changed: Column, column: Column) -> Column:
        return F.when(F.col("variant") == variant, changed).otherwise(column)

    def scene(x: Column, i: Column) -> Column:
        first = lambda variant, changed, kept: F.when((F.col("variant") == variant) & (i == 0), changed).otherwise(kept)
        ids, said = x["claim_ids"], when("language", F.regexp_replace(x["narration"], "[\\u0400-\\u04ff]", "x"), x["narration"])
        ids = first("unique", F.concat(ids, ids), first("unknown", F.concat(ids, F.array(F.lit("claim_none"))), first("coverage", F.array().cast("array<string>"), ids)))
        shown = first("on_screen_text", F.lit("x"), x["on_screen_text"])
        return x.withField("order", first("order", F.lit(2), x["order"])).withField("narration", first("told", F.lit("Нет."), said)).withField("on_screen_text", shown).withField("claim_ids", ids)

    s = s.withColumn("scenes", F.transform("scenes", scene))
    s = s.withColumn("hook", when("hook", F.lit("x"), F.col("scenes")[0]["narration"]))
    s = s.withColumn("spoken_text", F.array_join(F.transform("scenes", lambda x: x["narration"]), " "))
    s = s.withColumn("word_count", when("word_count", F.lit(1), text.spoken_words(F.col("spoken_text")))).withColumn("spoken_text", when("spoken_text", F.lit("Нет."), F.col("spoken_text")))
    s = s.withColumn("claims", F.transform("claims", lambda c: c.withField("qualification", when("qualification", F.lit("Never said"), c["qualification"]))))
    s = s.withColumn("script_title", when("title", F.lit("x"), F.col("script_title")))
    derived = F.col("variant").isin("on_screen_text", "title")
    found = scripts.script_errors(s.where(~derived)).union(scripts.derivation_errors(s.where(derived)))
    return found.select("package_id.conv_id", "package_id.variant", "error")


_CUES = "cues as (select conv_id, turn, text, turn * 4000 + (conv_id % 3) * 100 as start_ms, turn * 4000 + 4200 + length(text) % 500 as end_ms from conversations)"


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn") * 4000
    return c.select("conv_id", F.col("turn").alias("idx"), "text", (t + F.col("conv_id") % 3 * 100).alias("start_ms"), (t + 4200 + F.length("text") % 500).alias("end_ms"))


@query(f"""with {_CUES}, r as (select *, greatest(start_ms, coalesce(lag(end_ms) over (partition by conv_id order by turn), 0)) as s from cues)
select conv_id, turn as idx, s as start_ms, end_ms, end_ms > s as valid from r""")
def cues_normalize(spark, sf_dir):
    return timing.repair(_cues(spark, sf_dir), "conv_id").select("conv_id", "idx", "start_ms", "end_ms", "valid")


@query(f"""with {_CUES}, s as (select *, list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda w: w <> '') as w from cues), e as (select *, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from s)
select conv_id, turn as idx, i::bigint as word_idx, word, start_ms / 1000.0::double + (end_ms - start_ms) / 1000.0::double / len(w) * i as start_s from e""")
def cues_to_words(spark, sf_dir):
    return timing.cue_words(_cues(spark, sf_dir), "conv_id").select("conv_id", "idx", F.col("word_idx").cast("long").alias("word_idx"), "word", "start_s")


@query(f"""with {_CUES}, w as (select conv_id, turn, end_ms / 1000.0::double as end_s, len(list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda w: w <> '')) as n from cues)
select conv_id, turn as idx, n::bigint as n_words, coalesce(sum(n) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as first_word,
coalesce(lag(end_s) over (partition by conv_id order by turn), 0) as start_s, case when lead(turn) over (partition by conv_id order by turn) is null then 99.5 else end_s end::double as end_s from w""")
def cards_contiguous(spark, sf_dir):
    words = F.size(timing.words_of(F.col("text")))
    c = timing.offsets(_cues(spark, sf_dir), "conv_id", "idx", words).withColumn("end_s", F.col("end_ms") / 1000.0)
    c = timing.contiguous(c, "conv_id", "idx", F.lit(99.5))
    return c.select("conv_id", "idx", F.col("n_words").cast("long").alias("n_words"), F.col("first_word").cast("long").alias("first_word"), "start_s", "end_s")


_SPLIT = f"""recursive w as (select conv_id, turn as idx, list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda x: x <> '') as words from conversations),
k as (select *, len(words) as n, (len(words) * 330) / 1000.0::double / len(words) as step from w where len(words) > 0),
s as (select *, step * n as length, least(greatest(1, ceil(step * n / 5.5), ceil(n / 10.0)), greatest(1, floor(step * n / 1.5)))::bigint as wanted from k),
c as (select conv_id, idx, words, n, step, wanted as lft, 0::bigint as first, null::bigint as stop, 0 as card from s
union all select conv_id, idx, words, n, step, case when stop is null then 0 else lft - 1 end, coalesce(stop, n), stop, card + 1 from (
  select c.conv_id, c.idx, c.words, c.n, c.step, c.lft, c.card, case when c.lft = 1 then c.n else (
    select arg_min(e, (case when regexp_matches(c.words[e], '[.!?]["»)]*$') then 0 when regexp_matches(c.words[e], '[,;:]["»)]*$') then 1 else 2 end) * 10 + abs(c.step * e - (c.step * c.first + (c.step * c.n - c.step * c.first) / c.lft)) + abs(e - (c.first + round_even((c.n - c.first) / c.lft::double, 0))) * 0.2)
    from unnest(range(c.first + 1, least(c.n, c.first + 11))) as u(e) where c.step * e - c.step * c.first between 1.5 and 6.5 and c.n - e between c.lft - 1 and 10 * (c.lft - 1) and c.step * c.n - c.step * e <= 6.5 * (c.lft - 1) + 0.01) end as stop
  from c where c.lft > 0))"""


@query(f"""with {_SPLIT}, d as (select c.*, lag(stop, 1, 0) over (partition by conv_id, idx order by card) as b from c where card > 0), bad as (select distinct conv_id, idx from d where stop is null)
select d.conv_id, d.idx, (case when stop is null then 0 else card - 1 end)::int as card, case when stop is not null then array_to_string(words[b + 1 : stop], ' ') end as text, round(case when stop is null then 0.0 else step * b end, 3) as start_s,
round(step * coalesce(stop, n), 3) as end_s, case when stop is null then 'E_VIDEO_CAPTIONS' end as error from d left join bad on bad.conv_id = d.conv_id and bad.idx = d.idx where stop is null or bad.idx is null""")
def cards_partition(spark, sf_dir):
    """Each turn, spoken at three words a second, split into cards."""
    c = table(spark, sf_dir, "conversations").withColumn("w", timing.words_of(F.col("text")))
    step = F.size("w") * 330 / 1000.0 / F.size("w")
    words = F.transform("w", lambda x, i: F.struct(x.alias("word"), (F.lit(0.0) + step * i).alias("start_s"), (F.lit(0.0) + step * (i + 1)).alias("end_s")))
    scenes = c.select("conv_id", F.col("turn").alias("idx"), words.alias("words"))
    return timing.cards(scenes, "conv_id", "idx").select("conv_id", "idx", "card", "text", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "error")


@query("""select conv_id, turn as idx, printf('%02d:%02d:%02d,%03d', turn * 3661500 // 3600000, turn * 3661500 // 60000 % 60, turn * 3661500 // 1000 % 60, turn * 3661500 % 1000) as stamp, turn * 3661500 as ms from conversations""")
def srt_timestamps(spark, sf_dir):
    """Milliseconds to text and back."""
    ms = F.col("turn") * 3_661_500
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), web.srt_text(ms).alias("stamp")).withColumn("ms", web.srt_ms(F.col("stamp")))


@query(f"""with {_CUES}, x as (select *, lag(end_ms, 1, 0) over (partition by conv_id order by turn) as last from cues)
select conv_id::varchar as path, (turn + 1)::bigint as idx, start_ms, end_ms, trim(regexp_replace(replace(text, chr(10), ' '), ' +', ' ', 'g')) as text, case when start_ms < last - 1 then 'overlap' end as error from x""")
def srt_parse(spark, sf_dir):
    """Conversations written as subtitle files and parsed back."""
    cue = F.concat((F.col("idx") + 1).cast("string"), F.lit("\n"), web.srt_text(F.col("start_ms")), F.lit(" --> "), web.srt_text(F.col("end_ms")), F.lit("\n"), F.trim(F.regexp_replace(F.replace("text", F.lit("\n"), F.lit(" ")), " +", " ")))
    files = _cues(spark, sf_dir).groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("idx", cue.alias("cue")))).alias("cues"))
    files = files.select("path", F.array_join(F.transform("cues", lambda c: c["cue"]), "\n\n").alias("value"))
    return timing.parse_srt(files).withColumn("idx", F.col("idx").cast("long")).select("path", "idx", "start_ms", "end_ms", "text", "error")
