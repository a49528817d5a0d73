"""Content-addressed identities: pure functions of normalised content, free of time, path and row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.functions.text import canonical_json, sha256


def short(prefix: str, preimage: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(sha256(preimage), 1, 24))


def joined(*parts: Column) -> Column:
    """Parts on lines of their own; null if one is null."""
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit("\n"), p)
    return out


def content_hash(title: Column, summary: Column, published_at: Column, published_at_raw: Column) -> Column:
    return sha256(canonical_json(published_at.alias("published_at"), published_at_raw.alias("published_at_raw"), summary.alias("summary_text"), title.alias("title")))


def source_id(canonical_url: Column, digest: Column) -> Column:
    return short("src_", joined(canonical_url, digest))


def story_id(source: Column) -> Column:
    return short("story_", source)


def claim_text(title: Column) -> Column:
    return F.concat(F.lit("RSS item reports: "), title)


def claim_id(source: Column, text: Column) -> Column:
    return short("claim_", joined(source, text, F.lit("VENDOR_CLAIM"), F.lit("UNVERIFIED")))


def mock_fingerprint(story: Column, sources: Column) -> Column:
    """sources: array of structs (content_hash, id); sorted by id before hashing."""
    ordered = F.array_sort(sources, lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    return sha256(canonical_json(F.lit("mock").alias("generator_name"), F.lit("mock-v1").alias("generator_version"), F.lit(1).alias("schema_version"), ordered.alias("sources"), story.alias("story_id")))


def mock_package_id(fingerprint: Column) -> Column:
    return short("pkg_", joined(F.lit("story-package"), fingerprint))


def provider_fingerprint(story: Column, source: Column, prompt_sha256: str) -> Column:
    """source: struct (canonical_url, published_at, published_at_raw, source_id, source_name, summary_text, title)."""
    generator = F.struct(F.lit("openai-chat-completions").alias("api_format"), F.lit("deepseek-v4-flash").alias("model"), F.lit("deepseek").alias("provider"), F.lit(0.2).alias("temperature"), F.lit("disabled").alias("thinking"))
    request = F.struct(F.lit(3000).alias("max_tokens"), F.struct(F.lit("json_object").alias("type")).alias("response_format"), F.lit(False).alias("stream"))
    return sha256(canonical_json(generator.alias("generator"), F.lit(prompt_sha256).alias("prompt_sha256"), F.lit("f1f2-story-package-v1").alias("prompt_version"), request.alias("request"), F.lit(2).alias("schema_version"), source.alias("source"), story.alias("story_id")))


def provider_package_id(fingerprint: Column) -> Column:
    return short("pkg_", joined(F.lit("deepseek-story-package"), fingerprint))


def script_fingerprint(package_id: Column, package_json: Column) -> Column:
    return sha256(canonical_json(F.lit("safe-local-v1").alias("generator_version"), package_id.alias("package_id"), sha256(package_json).alias("package_json_sha256"), F.lit(1).alias("script_schema_version"), F.lit("claim-safe-script-v1").alias("template_version")))


def script_id(fingerprint: Column) -> Column:
    return short("script_", F.concat(F.lit("f3-script:"), fingerprint))


def experiment_id(*fields: Column) -> Column:
    """From canonical JSON that ends in a line feed, unlike the others."""
    return short("gpt56-ts-", canonical_json(*fields, line_feed=True))
