"""What is checked around speech and video: voices, cover texts, probe logs, audio lineage. Their makers stay outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.text import collapse

# The frame, its rate, and the loudness that is accepted.
FRAME, RATE = (1080, 1920), 30
LOUDNESS, PEAK = (-17.5, -14.5), -1.0


def voices(found: DataFrame, locale: str = "ru-RU", suffix: str = "Neural") -> DataFrame:
    """The names of a locale's voices of one kind, in order."""
    return found.where((F.col("Locale") == locale) & F.col("ShortName").endswith(suffix)).select("ShortName").distinct().orderBy("ShortName")


def choose_voice(found: DataFrame, preferred: list[str], requested: str | None = None, locale: str = "ru-RU") -> DataFrame:
    """One row (voice, error_code): the requested voice if it is there, else the first preferred, else the first by name."""
    names = voices(found, locale).agg(F.array_sort(F.collect_set("ShortName")).alias("names"))
    wanted = [requested] if requested is not None else preferred
    first = F.coalesce(*[F.when(F.array_contains("names", w), F.lit(w)) for w in wanted], *([] if requested is not None else [F.get("names", F.lit(0))]), F.lit(None).cast("string"))
    return names.select(first.alias("voice")).withColumn("error_code", F.when(F.col("voice").isNull(), "E_TTS_VOICE"))


def cover_text(x: Column, most: int) -> tuple[Column, Column]:
    """(text with blanks collapsed, error_code): not blank, without control, format or private characters, not too long."""
    text = collapse(x)
    bad = x.isNull() | (text == "") | x.rlike(r"\p{C}") | (F.length(text) > most)
    return text, F.when(bad, "E_VIDEO_COVER")


def _line(log: Column, label: str) -> Column:
    """What follows the label in the log's first line that has it, in fields between commas; null without one."""
    line = F.get(F.filter(F.split(log, "\n"), lambda x: F.contains(x, F.lit(label))), F.lit(0))
    return F.transform(F.split(F.substring_index(line, label, -1), ","), lambda f: F.trim(f))


def _field(fields: Column, shape: str) -> Column:
    """The first field that begins so, up to its first blank."""
    return F.substring_index(F.get(F.filter(fields, lambda f: f.rlike(rf"\A{shape}")), F.lit(0)), " ", 1)


def probe(log: Column) -> dict[str, Column]:
    """Figures that a media probe's log reports: a line for each stream, its codec first, and fields between commas."""
    video, audio, clock = _line(log, "Video:"), _line(log, "Audio:"), F.split(F.get(_line(log, "Duration:"), F.lit(0)), ":")
    coded = F.startswith(F.get(video, F.lit(0)), F.lit("h264"))
    size = F.split(F.when(coded, _field(video, "[0-9]+x[0-9]+")), "x")
    rate = F.get(F.filter(video, lambda f: f.endswith(" fps")), F.lit(0))
    return {
        "duration_s": (F.get(clock, F.lit(0)).try_cast("double") * 60 + F.get(clock, F.lit(1)).try_cast("double")) * 60 + F.get(clock, F.lit(2)).try_cast("double"),
        "width": F.get(size, F.lit(0)).try_cast("int"), "height": F.get(size, F.lit(1)).try_cast("int"), "frame_rate": F.substring_index(rate, " ", 1).try_cast("double"),
        "pixels": coded & _field(video, "yuv").rlike(r"\Ayuv420p\b"), "audio": F.regexp_replace(F.get(audio, F.lit(0)), " ", "").startswith("aac(LC)"),
    }


def loudness(log: Column) -> dict[str, Column]:
    """The figures of the JSON object that a loudness pass writes into its log."""
    body = F.concat(F.lit("{"), F.substring_index(F.substring_index(log, "{", -1), "}", 1), F.lit("}"))
    found = F.from_json(body, "input_i string, input_tp string")
    return {"loudness": found["input_i"].try_cast("double"), "peak": found["input_tp"].try_cast("double")}


def fast_start(content: Column) -> Column:
    """Whether the index of a media file comes before its data. content: its first bytes."""
    text = F.decode(content, "ISO-8859-1")
    index, data = F.instr(text, "moov"), F.instr(text, "mdat")
    return (index > 0) & (data > 0) & (index < data)


def media_errors(files: DataFrame, bounds: tuple[float, float] | None = None, frame: tuple[int, int] = FRAME) -> DataFrame:
    """files (name, log, loudness_log, head) with the probe's figures and `error`, the first rule that is broken."""
    p = probe(F.col("log")) | loudness(F.col("loudness_log"))
    rows = files.withColumns(p)
    within = F.col("duration_s").between(*bounds) if bounds else F.lit(True)
    rules = {
        "codec": F.col("width").isNotNull() & F.col("pixels") & F.col("audio"), "dimensions": (F.col("width") == frame[0]) & (F.col("height") == frame[1]), "frame_rate": F.abs(F.coalesce("frame_rate", F.lit(0.0)) - RATE) <= 0.1,
        "duration": F.col("duration_s").isNotNull() & within, "fast_start": fast_start(F.col("head")), "loudness": F.col("loudness").between(*LOUDNESS) & (F.col("peak") <= PEAK),
    }
    error = None
    for name, ok in rules.items():
        bad = ~F.coalesce(ok, F.lit(False))
        error = F.when(bad, F.lit(name)) if error is None else error.when(bad, F.lit(name))
    return rows.withColumn("error", error)


def artifact_hashes(files: DataFrame, by: str) -> DataFrame:
    """(by, artifact_sha256): a map of file names to hashes for each group. files: (by, name, content)."""
    return files.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.sha2("content", 256).alias("sha256"))))).alias("artifact_sha256"))


def fallback_errors(manifests: DataFrame, scripts: DataFrame, files: DataFrame, needed: tuple[str, ...] = ("voice.mp3", "subtitles.srt"), voice: str = "ru-RU-") -> DataFrame:
    """(script_id, error): whether earlier audio may serve a script again.

    manifests (script_id, package_id, story_id, voice, artifact_sha256 map), scripts (the three ids), files (script_id, name,
    content).
    """
    m, s = manifests.alias("m"), scripts.alias("s")
    hashed = artifact_hashes(files, "script_id").withColumnRenamed("artifact_sha256", "actual")
    joined = s.join(m, F.col("s.script_id") == F.col("m.script_id"), "left").join(hashed.alias("h"), F.col("s.script_id") == F.col("h.script_id"), "left")
    lineage = F.col("m.package_id").eqNullSafe(F.col("s.package_id")) & F.col("m.story_id").eqNullSafe(F.col("s.story_id")) & F.col("m.script_id").isNotNull()
    same = F.lit(True)
    for name in needed:
        same = same & F.coalesce(F.try_element_at("m.artifact_sha256", F.lit(name)) == F.try_element_at("h.actual", F.lit(name)), F.lit(False))
    error = F.when(~lineage, "lineage").when(~same, "hashes").when(~F.coalesce(F.col("m.voice").startswith(voice), F.lit(False)), "voice")
    return joined.select("s.script_id", error.alias("error"))
