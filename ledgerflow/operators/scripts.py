"""Scripts from packages: claims are chosen, grouped into scenes, padded to length and checked. One plan for all packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import identity, text, web
from ledgerflow.operators.packages import allowed_claims

# The template's limits and texts.
WORDS_WANTED, WORDS_LEAST, WORDS_MOST = 110, 90, 170
SCENES_LEAST, SCENES_MOST = 5, 8
NOT_TESTED = "В отдельном практическом тесте это пока не проверено."
FALLBACK_TITLE = "Разбор официального AI-анонса"
CAPTION = "Краткий разбор официального AI-анонса.\nИсточник и ограничения указаны в ролике.\nМатериал требует ручной редакционной проверки."
TAKEAWAY = "Практический вывод: перед использованием проверьте первоисточник, доступность функции и указанные ограничения."
TRANSITIONS = ("Что известно:", "Ещё один подтверждённый пункт:", "При этом важно уточнить:", "Источник также указывает:")
PADDING = (
    "Это важно отделять от рекламной формулировки и от результата независимого теста.",
    "В этом пилоте мы не проверяли функцию самостоятельно.",
    "Поэтому вывод ограничен содержимым указанного первоисточника.",
    "Перед рабочим применением потребуется отдельная практическая проверка.",
)
EVIDENCE = {
    "VERIFIED": "Это утверждение отмечено в пакете как подтверждённое указанным источником.",
    "VENDOR_CLAIM": "Это заявление поставщика, а не результат независимого теста.",
    "INFERENCE": "Этот вывод отмечен как интерпретация и требует отдельной проверки.",
    "OPINION": "Это редакционная оценка, а не результат независимого теста.",
}
HEADINGS = ("Главный факт", "Что известно", "Статус доказательств", "Ограничения", "Практический вывод", "Граница материала")


def strongest(claims: Column) -> Column:
    """The first VERIFIED claim, else the first VENDOR_CLAIM, else the first; null if there is none."""
    of = lambda status: F.filter(claims, lambda c: c["status"] == status)
    return F.when(F.size(of("VERIFIED")) > 0, F.get(of("VERIFIED"), F.lit(0))).when(F.size(of("VENDOR_CLAIM")) > 0, F.get(of("VENDOR_CLAIM"), F.lit(0))).otherwise(F.get(claims, F.lit(0)))


def chunk_size(n: Column) -> Column:
    """So that n claims make four chunks at most."""
    return F.greatest(F.lit(1), F.floor((n + 3) / 4)).cast("int")


def chunks(claims: Column) -> Column:
    """The claims in order, in arrays of chunk_size."""
    size = chunk_size(F.size(claims))
    starts = F.when(F.size(claims) > 0, F.sequence(F.lit(0), F.size(claims) - 1, size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(claims, s + 1, size))


def transition(position: Column) -> Column:
    """The words before the claim at a position, from 0, over and over."""
    return F.element_at(F.array(*[F.lit(t) for t in TRANSITIONS]), F.pmod(position, F.lit(len(TRANSITIONS))).cast("int") + 1)


def padding_needed(words: Column, scenes: Column) -> Column:
    """How many padding phrases: the fewest that reach WORDS_WANTED, at most all; at least one below SCENES_LEAST scenes."""
    sizes = [len(p.split()) for p in PADDING]
    reached, k = F.lit(0), F.lit(len(PADDING))
    for i in range(len(PADDING) - 1, -1, -1):
        reached = words + sum(sizes[:i])
        k = F.when(reached >= WORDS_WANTED, F.lit(i)).otherwise(k)
    return F.when(scenes < SCENES_LEAST, F.greatest(F.lit(1), k)).otherwise(k)


def hosts_label(claim_ids: Column, claims: Column, references: Column) -> Column:
    """The sources of a scene as hosts, each once in first order; null if a source is unknown."""
    of_claim = F.map_from_entries(F.transform(claims, lambda c: F.struct(c["claim_id"], c["evidence_source_id"])))
    of_source = F.map_from_entries(F.transform(references, lambda r: F.struct(r["source_id"], F.coalesce(F.when(web.host(r["canonical_url"]) != "", web.host(r["canonical_url"])), r["source_id"]))))
    ids = F.when(F.size(claim_ids) > 0, F.transform(claim_ids, lambda c: F.try_element_at(of_claim, c))).otherwise(F.transform(references, lambda r: r["source_id"]))
    hosts = F.array_distinct(F.transform(ids, lambda s: F.try_element_at(of_source, s)))
    return F.when(~F.exists(hosts, lambda h: h.isNull()), F.concat(F.lit("Источник: "), F.array_join(hosts, ", ")))


def compose(packages: DataFrame) -> DataFrame:
    """Packages (package_id, story_id, working_title, claims, limitations, publication_verdict, source_references) -> the
    same with hook, scenes (order, narration, on_screen_text, source_label, claim_ids, visual_kind), spoken_text, word_count
    and error_code.
    """
    rows = packages.withColumn("allowed", allowed_claims(F.col("claims")))
    rows = rows.withColumn("best", strongest(F.col("allowed")))
    rows = rows.withColumn("rest", F.filter("allowed", lambda c: c["claim_id"] != F.col("best.claim_id")))
    rows = rows.withColumn("parts", chunks(F.col("rest"))).withColumn("step", chunk_size(F.size("rest")))

    def scene(narration: Column, heading: str, ids: Column) -> Column:
        return F.struct(narration.alias("narration"), F.lit(heading).alias("on_screen_text"), ids.alias("claim_ids"))

    none = F.array().cast("array<string>")

    def told(part: Column, i: Column) -> Column:
        lines = F.transform(part, lambda c, j: F.concat_ws(" ", transition(i * F.col("step") + j), c["text"], text.sentence(c["qualification"])))
        return scene(F.array_join(lines, " "), HEADINGS[1], F.transform(part, lambda c: c["claim_id"]))

    evidence = F.concat_ws(" ", text.sentence(F.col("best.qualification")), F.element_at(F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv]), F.col("best.status")), F.when(F.col("publication_verdict") == "NEEDS_TEST", F.lit(NOT_TESTED)))
    first = F.array(scene(F.concat(F.lit(HEADINGS[0] + ": "), F.col("best.text")), HEADINGS[0], F.array("best.claim_id")))
    middle = F.transform("parts", told)
    last = F.array(scene(evidence, HEADINGS[2], none), scene(F.array_join("limitations", " "), HEADINGS[3], none), scene(F.lit(TAKEAWAY), HEADINGS[4], none))
    rows = rows.withColumn("base", F.concat(first, middle, last))
    rows = rows.withColumn("base_words", text.spoken_words(F.array_join(F.transform("base", lambda s: s["narration"]), " ")))
    rows = rows.withColumn("pads", padding_needed(F.col("base_words"), F.size("base")))
    phrases = F.array_join(F.slice(F.array(*[F.lit(p) for p in PADDING]), F.lit(1), F.col("pads")), " ")
    n = F.size("base")
    own = F.concat(F.slice("base", F.lit(1), n - 1), F.array(scene(phrases, HEADINGS[5], none)), F.slice("base", n, F.lit(1)))
    into = F.transform("base", lambda s, i: F.when(i == n - 3, s.withField("narration", F.concat_ws(" ", s["narration"], phrases))).otherwise(s))
    rows = rows.withColumn("padded", F.when(F.col("pads") == 0, F.col("base")).when(n < SCENES_MOST, own).otherwise(into))
    label = lambda s: hosts_label(s["claim_ids"], F.col("claims"), F.col("source_references"))
    scenes = F.transform("padded", lambda s, i: F.struct((i + 1).cast("int").alias("order"), s["narration"].alias("narration"), s["on_screen_text"].alias("on_screen_text"), label(s).alias("source_label"), s["claim_ids"].alias("claim_ids"), F.lit("TEXT_CARD").alias("visual_kind")))
    rows = rows.withColumn("scenes", scenes).withColumn("hook", F.col("padded")[0]["narration"])
    rows = rows.withColumn("spoken_text", F.array_join(F.transform("scenes", lambda s: s["narration"]), " "))
    rows = rows.withColumn("word_count", text.spoken_words(F.col("spoken_text")))
    bad_label = F.exists("scenes", lambda s: s["source_label"].isNull() | (F.length(s["source_label"]) > 100))
    code = F.when(F.size("allowed") == 0, "E_SCRIPT_PACKAGE").when(bad_label | ~F.col("word_count").between(WORDS_LEAST, WORDS_MOST) | ~F.size("scenes").between(SCENES_LEAST, SCENES_MOST), "E_SCRIPT_OUTPUT")
    title = F.when(F.length("working_title") <= 300, F.col("working_title")).otherwise(F.lit(FALLBACK_TITLE))
    return rows.withColumn("error_code", code).withColumn("script_title", title).drop("allowed", "best", "rest", "parts", "step", "base", "base_words", "padded")


def with_identity(scripts: DataFrame, package_json: str = "payload_json") -> DataFrame:
    fp = identity.script_fingerprint(F.col("package_id"), F.col(package_json))
    return scripts.withColumn("script_fingerprint", fp).withColumn("script_id", identity.script_id(F.col("script_fingerprint")))


def script_errors(scripts: DataFrame) -> DataFrame:
    """Scripts with their packages' claims -> (package_id, error): the first rule of shape or coverage that is broken."""
    scenes = F.col("scenes")
    ids = F.flatten(F.transform(scenes, lambda s: s["claim_ids"]))
    allowed = allowed_claims(F.col("claims"))
    allowed_ids = F.transform(allowed, lambda c: c["claim_id"])
    known = F.transform("claims", lambda c: c["claim_id"])
    told = F.forall(scenes, lambda s: F.forall(F.filter("claims", lambda c: F.array_contains(s["claim_ids"], c["claim_id"])), lambda c: s["narration"].contains(c["text"])))
    rules = {
        "order": F.transform(scenes, lambda s: s["order"]).eqNullSafe(F.sequence(F.lit(1), F.size(scenes))),
        "hook": scenes[0]["narration"].eqNullSafe(F.col("hook")),
        "spoken_text": F.array_join(F.transform(scenes, lambda s: s["narration"]), " ").eqNullSafe(F.col("spoken_text")),
        "word_count": text.spoken_words(F.col("spoken_text")).eqNullSafe(F.col("word_count")),
        "language": F.col("spoken_text").rlike("[\\u0400-\\u04ff]"),
        "unique": F.forall(scenes, lambda s: F.size(F.array_distinct(s["claim_ids"])) == F.size(s["claim_ids"])),
        "unknown": F.size(F.array_except(ids, known)) == 0,
        "told": told,
        "coverage": F.array_sort(ids).eqNullSafe(F.array_sort(allowed_ids)),
        "qualification": F.forall(allowed, lambda c: F.col("spoken_text").contains(c["qualification"])),
    }
    first = None
    for name, ok in rules.items():
        bad = ~F.coalesce(ok, F.lit(False))
        first = F.when(bad, F.lit(name)) if first is None else first.when(bad, F.lit(name))
    return scripts.select("package_id", first.alias("error"))


#: What a script has from its package alone.
DERIVED = ("script_title", "hook", "scenes", "spoken_text", "word_count")


def derivation_errors(scripts: DataFrame) -> DataFrame:
    """Scripts with their packages' columns -> (package_id, error): the first of DERIVED that composing the package again does
    not give. A script is composed beside itself, so nothing is joined or shuffled.
    """
    kept = scripts.withColumn("kept", F.struct(*DERIVED)).drop(*DERIVED, "pads", "error_code")
    differs = [F.when(~F.col(c).eqNullSafe(F.col("kept")[c]), F.lit(c)) for c in DERIVED]
    return compose(kept).select("package_id", F.coalesce(*differs).alias("error"))
