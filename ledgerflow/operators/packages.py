"""Packages: derived from sources, from provider responses, and checked against what they are derived from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import identity, text, web
from ledgerflow.operators.store import differs

# Texts and enumerations of payloads.
NOTICE = "Demo-only package; no human verification; do not publish."
QUALIFIER = "Fixture metadata only; no independent or human verification."
LIMITATION = "Доказательная база ограничена содержимым официальной ленты поставщика; независимая проверка не проводилась."
MODEL, PROMPT_VERSION = "deepseek-v4-flash", "f1f2-story-package-v1"
STATUSES = ("VERIFIED", "VENDOR_CLAIM", "INFERENCE", "OPINION", "UNVERIFIED")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")
FORMATS = ("AI_SIGNAL", "TESTED_FOR_YOU", "AI_WORKFLOW")
VERDICTS = ("READY", "READY_WITH_QUALIFICATION", "NEEDS_TEST", "HOLD", "REJECT")
DRAFT = "story_id string, source_id string, working_title string, editorial_format string, one_sentence_fact string, why_it_matters string, editorial_angle string, claims array<struct<claim_id: string, text: string, status: string, confidence: string, evidence_source_id: string, use_in_script: boolean, qualification: string>>, limitations array<string>, demonstration_plan array<string>, publication_verdict string, source_references array<struct<source_id: string, canonical_url: string>>"
DRAFT_KEYS = sorted(p.split()[0] for p in DRAFT.split("struct<")[0].split(", ")[:7]) + ["claims", "demonstration_plan", "limitations", "publication_verdict", "source_references"]
CLAIM_KEYS = ["claim_id", "text", "status", "confidence", "evidence_source_id", "use_in_script", "qualification"]


def mock_packages(sources: DataFrame, built_at: str = "") -> DataFrame:
    """The one package that each source gives, as rows of the store's table."""
    src = F.col
    story, claim = identity.story_id(src("id")), identity.claim_text(src("title"))
    rows = sources.withColumns({"story": story, "claim": claim})
    rows = rows.withColumn("fp", identity.mock_fingerprint(src("story"), F.array(F.struct("content_hash", "id"))))
    rows = rows.withColumn("pkg", identity.mock_package_id(src("fp")))
    claims = F.array(F.struct(identity.claim_id(src("id"), src("claim")).alias("id"), F.lit(QUALIFIER).alias("qualifier"), F.array("id").alias("source_ids"), F.lit("UNVERIFIED").alias("status"), src("claim").alias("text"), F.lit("VENDOR_CLAIM").alias("type")))
    listed = F.array(F.struct("canonical_url", "content_hash", "id", "published_at", "published_at_raw", "title"))
    payload = text.canonical_json(
        claims.alias("claims"), F.lit("MOCK").alias("generation_mode"), F.struct(F.lit("mock").alias("name"), F.lit("mock-v1").alias("version")).alias("generator"), src("fp").alias("input_fingerprint"),
        F.lit(NOTICE).alias("mock_notice"), src("pkg").alias("package_id"), F.lit(False).alias("publishable"), F.lit(1).alias("schema_version"), listed.alias("sources"), F.struct(src("story").alias("id"), src("title").alias("title")).alias("story"),
    )
    return rows.select(src("pkg").alias("package_id"), src("story").alias("story_id"), F.lit(1).alias("schema_version"), F.lit("mock").alias("generator_name"), F.lit("mock-v1").alias("generator_version"), src("fp").alias("input_fingerprint"), payload.alias("payload_json"), F.lit(built_at).alias("built_at"))


def mock_package_errors(packages: DataFrame, sources: DataFrame) -> DataFrame:
    """(package_id, error_code): null if the stored package is what its source gives."""
    expected = mock_packages(sources).drop("built_at")
    p, e = packages.alias("p"), expected.alias("e")
    joined = p.join(e, F.col("p.story_id") == F.col("e.story_id"), "left")
    columns = tuple(c for c in expected.columns if c != "payload_json")
    code = F.when(F.col("e.story_id").isNull(), "E_STORY_NOT_FOUND").when(differs("p", "e", columns), "IDENTITY").when(~F.col("p.payload_json").eqNullSafe(F.col("e.payload_json")), "PAYLOAD")
    return joined.select("p.package_id", code.alias("error_code"))


def public_source(name: str = "source_name") -> Column:
    """The seven fields of a source that a provider sees, in the order of their names."""
    site = web.host(F.col("canonical_url"))
    named = F.coalesce(F.when(F.col(name) != "", F.col(name)), F.when(site != "", site), F.lit("unknown"))
    return F.struct("canonical_url", "published_at", "published_at_raw", F.col("id").alias("source_id"), named.alias("source_name"), "summary_text", "title")


def provider_identities(sources: DataFrame, prompt_sha256: str) -> DataFrame:
    """(id, story_id, input_fingerprint, package_id) of each source's provider package."""
    fp = identity.provider_fingerprint(identity.story_id(F.col("id")), public_source(), prompt_sha256)
    return sources.select("id", identity.story_id(F.col("id")).alias("story_id"), fp.alias("input_fingerprint")).withColumn("package_id", identity.provider_package_id(F.col("input_fingerprint")))


def strict_json(text: Column) -> Column:
    """A JSON text as a variant, null if it is not one value and nothing else.

    try_parse_json() stops after the first value. In brackets whatever follows it must be a comma or a closing bracket, as the
    value of a key a comma or a closing brace: what is one value in both has nothing behind it. A key given twice makes it no
    JSON, unless the session sets spark.sql.variant.allowDuplicateKeys, with which the last one counts.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(named.isNotNull() & (F.size(listed) == 1), F.get(listed, F.lit(0)))


def kind(x: Column) -> Column:
    """The kind of a variant: OBJECT, ARRAY, STRING, BOOLEAN, VOID, BIGINT, DECIMAL, DOUBLE; null if there is none."""
    return F.regexp_extract(F.schema_of_variant(x), r"\A[A-Z]+", 0)


def fields(x: Column) -> Column:
    """An object's keys with their values; null for any other kind."""
    return F.try_variant_get(x, "$", "map<string,variant>")


def elements(x: Column) -> Column:
    """An array's elements; null for any other kind."""
    return F.when(kind(x) == "ARRAY", F.try_variant_get(x, "$", "array<variant>"))


def text_of(x: Column) -> Column:
    """The text of a variant that is one; a number or a boolean is none."""
    return F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _keys(x: Column, names: list[str]) -> Column:
    """Whether an object has exactly these keys."""
    return F.array_sort(F.map_keys(fields(x))).eqNullSafe(F.array(*[F.lit(n) for n in sorted(names)]))


def _claim_ok(c: Column) -> Column:
    """A claim whose fields have the right kinds, lengths and values."""
    t = lambda name: text_of(c[name])
    used = F.when(kind(c["use_in_script"]) == "BOOLEAN", F.try_variant_get(c["use_in_script"], "$", "boolean"))
    return (
        t("claim_id").rlike(r"\Aclaim_[a-z0-9_]{1,64}\z") & F.length(t("text")).between(1, 2000) & t("status").isin(*STATUSES) & t("confidence").isin(*CONFIDENCES)
        & used.isNotNull() & t("evidence_source_id").isNotNull() & F.length(t("qualification")).between(1, 1000) & ~((t("status") == "UNVERIFIED") & used)
    )


def draft_rules(answer: Column) -> dict[str, Column]:
    """The rules of a provider's answer, a map of variants, by name and in order; true if the answer keeps them."""
    f = lambda name: F.try_element_at(answer, F.lit(name))
    t = lambda name: text_of(f(name))
    sized = lambda name, most: F.length(t(name)).between(1, most)
    texts = lambda name: F.size(elements(f(name))).between(1, 20) & F.forall(elements(f(name)), lambda x: kind(x) == "STRING")
    claims, references = elements(f("claims")), elements(f("source_references"))
    first = fields(F.get(references, F.lit(0)))
    return {
        "object: keys": F.array_sort(F.map_keys(answer)).eqNullSafe(F.array(*[F.lit(n) for n in sorted(DRAFT_KEYS)])),
        **{f"{n}: string": t(n).isNotNull() for n in ("story_id", "source_id", "working_title", "one_sentence_fact")},
        "working_title: length": sized("working_title", 500),
        "editorial_format: literal": t("editorial_format").isin(*FORMATS),
        "one_sentence_fact: length": sized("one_sentence_fact", 2000),
        "why_it_matters: length": sized("why_it_matters", 4000),
        "editorial_angle: length": sized("editorial_angle", 4000),
        "claims: size": F.size(claims).between(1, 20),
        "claims: keys": F.forall(claims, lambda c: _keys(c, CLAIM_KEYS)),
        "claims: fields": F.forall(F.transform(claims, fields), _claim_ok),
        "claims: unique": F.size(F.array_distinct(F.transform(claims, lambda c: text_of(fields(c)["claim_id"])))) == F.size(claims),
        "claims: evidence": F.forall(claims, lambda c: text_of(fields(c)["evidence_source_id"]) == t("source_id")),
        "limitations: size": texts("limitations"),
        "limitations: required": F.exists(elements(f("limitations")), lambda x: F.coalesce(text_of(x) == LIMITATION, F.lit(False))),
        "demonstration_plan: size": texts("demonstration_plan"),
        "publication_verdict: literal": t("publication_verdict").isin(*VERDICTS),
        "source_references: size": F.size(references) == 1,
        "source_references: keys": F.forall(references, lambda c: _keys(c, ["source_id", "canonical_url"])),
        "source_references: source": text_of(first["source_id"]) == t("source_id"),
    }


def draft_errors(drafts: DataFrame, content: str = "content") -> DataFrame:
    """The rows with `draft`, parsed, and `errors`: the rules that a provider's answer breaks, at most eight, in order.

    Kinds are those of the parsed values, so a number is no text wherever it stands. What is no JSON object breaks every rule.
    """
    parsed = drafts.withColumn("_answer", fields(strict_json(F.col(content))))
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in draft_rules(F.col("_answer")).items()]
    rows = parsed.withColumn("errors", F.slice(F.filter(F.array(*broken), lambda x: x.isNotNull()), 1, 8))
    return rows.withColumn("draft", F.from_json(F.col(content), DRAFT)).drop("_answer")


def judged_answers(responses: DataFrame, sources: DataFrame, prompt_sha256: str) -> DataFrame:
    """responses (story_id, attempt, finish_reason, content) with draft, package_id, input_fingerprint and `error`, null for a valid
    answer. Each answer is judged by itself; those about stories without a source are left out."""
    asked = provider_identities(sources, prompt_sha256).join(sources.select("id", "canonical_url"), "id")
    rows = draft_errors(responses).join(asked.select("story_id", F.col("id").alias("own_source"), "canonical_url", "input_fingerprint", "package_id"), "story_id")
    lineage = (F.col("draft.story_id") == F.col("story_id")) & (F.col("draft.source_id") == F.col("own_source")) & (F.element_at("draft.source_references", 1)["canonical_url"] == F.col("canonical_url"))
    code = (
        F.when(F.col("finish_reason") == "length", "TRUNCATED").when(F.coalesce(F.trim("content"), F.lit("")) == "", "EMPTY")
        .when(F.size("errors") > 0, F.concat(F.lit("INVALID: "), F.array_join("errors", "; "))).when(~F.coalesce(lineage, F.lit(False)), "LINEAGE")
    )
    return rows.withColumn("error", code)


def provider_payloads(responses: DataFrame, sources: DataFrame, prompt_sha256: str) -> DataFrame:
    """responses (story_id, attempt, finish_reason, content) -> the first valid answer's package, or the last error.

    Columns: story_id, package_id, input_fingerprint, draft, repair_used, error_code.
    """
    rows = judged_answers(responses, sources, prompt_sha256).where("attempt in (1, 2)")
    best = F.struct(F.col("error").isNotNull().alias("bad"), F.when(F.col("error").isNull(), F.col("attempt")).otherwise(-F.col("attempt")).alias("order"))
    return rows.groupBy("story_id").agg(F.min_by(F.struct("package_id", "input_fingerprint", "draft", (F.col("attempt") == 2).alias("repair_used"), F.col("error").alias("error_code")), best).alias("r")).select("story_id", "r.*")


def provider_packages(judged: DataFrame, built_at: str = "") -> DataFrame:
    """Valid answers (story_id, package_id, input_fingerprint, draft, repair_used; usage if known) as rows of the store's table.

    usage: a struct of input_tokens, output_tokens, total_tokens and cache_hit_tokens, each a whole number or null.
    """
    d = lambda name: F.col(f"draft.{name}").alias(name)
    counts = "struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint, cache_hit_tokens: bigint>"
    usage = F.col("usage").cast(counts) if "usage" in judged.columns else F.lit(None).cast(counts)
    claims = F.transform("draft.claims", lambda c: F.struct(*[c[k].alias(k) for k in sorted(CLAIM_KEYS)]))
    references = F.transform("draft.source_references", lambda r: F.struct(r["canonical_url"].alias("canonical_url"), r["source_id"].alias("source_id")))
    generator = F.struct(F.lit("openai-chat-completions").alias("api_format"), F.lit(MODEL).alias("model"), F.lit("deepseek").alias("provider"), F.lit(0.2).alias("temperature"), F.lit("disabled").alias("thinking"))
    spent = F.struct(usage["cache_hit_tokens"].alias("cache_hit_tokens"), usage["input_tokens"].alias("input_tokens"), usage["output_tokens"].alias("output_tokens"), F.col("repair_used").alias("repair_used"), usage["total_tokens"].alias("total_tokens"))
    payload = text.canonical_json(
        claims.alias("claims"), d("demonstration_plan"), d("editorial_angle"), d("editorial_format"), generator.alias("generator"), F.col("input_fingerprint"), d("limitations"), d("one_sentence_fact"), F.col("package_id"),
        F.lit(PROMPT_VERSION).alias("prompt_version"), d("publication_verdict"), F.lit(2).alias("schema_version"), d("source_id"), references.alias("source_references"), d("story_id"), spent.alias("usage_metadata"), d("why_it_matters"), d("working_title"),
    )
    return judged.select("package_id", "story_id", F.lit(2).alias("schema_version"), F.lit("deepseek").alias("generator_name"), F.lit(MODEL).alias("generator_version"), "input_fingerprint", payload.alias("payload_json"), F.lit(built_at).alias("built_at"))


def allowed_claims(claims: Column) -> Column:
    return F.filter(claims, lambda c: c["use_in_script"] & (c["status"] != "UNVERIFIED"))


def publishable(verdict: Column, mode: Column) -> Column:
    """Whether a script may be made of a package."""
    return ~verdict.isin("HOLD", "REJECT") & (mode != "MOCK")
