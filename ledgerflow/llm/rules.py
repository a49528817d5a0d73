"""Quality rules: counts of a text, and how far its histograms lie from those of its language. DataFrame functions only.

A document has two histograms: its characters by class, and its words by the commonest words of its language and all
others. The references are those of all documents of the language, each distinct heavy text once. A document fails if the
Jensen-Shannon distance (base 2, from 0 to 1) to a reference is over its limit. A sample of n from k classes has a divergence
of about (k - 1) / (8 n ln 2) from its own source; that much is taken off first, so that one limit serves all lengths. Texts
too short for a histogram to mean anything, and languages with too few texts, are not compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.llm.common import cut, set_aside, text_key

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Classes of characters; point: the rest of ASCII's punctuation, other: whatever is left.
CLASSES = ("lower", "blank", "upper", "symbol", "digit", "point", "other")
_PATTERNS = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "point": r"[!-/:-@\[-`{-~]+"}
#: Words of a repeated window.
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Commonest words of a language, by the number of texts that hold them.
COMMON = 24
#: Guards: characters and words of a document, texts of a language.
CLASS_CHARS, COMMON_WORDS, LANGUAGE_TEXTS = 200, 60, 20
#: Limits of the two distances.
CLASS_LIMIT, COMMON_LIMIT = 0.25, 0.2
#: A text that makes up this share of all rows counts once in a reference; there are at most 1 / SHARE such texts.
SHARE = 0.001
MOST_BROADCAST = 10_000
KEY = ["text_h", "text_crc32", "text_bytes"]


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of so many words which the text has twice or more, each counted once.

    Windows are compared by 64-bit hashes; only texts with equal ones are sorted.
    """

    def of_hashes(h: Column) -> Column:
        starts = F.when(F.size(h) >= window, F.sequence(F.lit(1), F.size(h) - (window - 1))).otherwise(F.array().cast("array<int>"))
        return _bound(F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, window))), of_windows)

    def of_windows(w: Column) -> Column:
        sorted_w = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), _bound(sorted_w, of_sorted)).otherwise(0)

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)))
        return _bound(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(window), F.get(p, k + 1) - x))  # the last has no next: least() skips null
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    return _bound(F.transform(words, lambda w: F.xxhash64(w)), of_hashes).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    return _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def with_class_counts(rows: DataFrame) -> DataFrame:
    """The rows (text, …) with _classes: characters by class, in the order of CLASSES. Each class is taken out of what the
    classes before it have left, so that all but the first look at little."""
    left, names = F.col("text"), []
    for i, name in enumerate(CLASSES[:-1]):
        rest = _without(left, {"blank": BLANK_CHARS, "symbol": SYMBOLS}[name]) if name in ("blank", "symbol") else F.regexp_replace(left, _PATTERNS[name], "")
        rows = rows.withColumn(f"_left{i}", rest)
        names.append(F.length(left) - F.length(f"_left{i}"))
        left = F.col(f"_left{i}")
    return rows.withColumn("_classes", F.array(*[n.cast("long") for n in names], F.length(left).cast("long"))).drop(*[f"_left{i}" for i in range(len(CLASSES) - 1)])


def js_distance(p: Column, q: Column, n: Column | None = None) -> Column:
    """Square root of the Jensen-Shannon divergence, base 2, of two arrays of shares of equal length; if p is of a sample of n,
    less the divergence that such a sample is expected to have."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    both = F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a))
    divergence = F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2
    if n is not None:
        divergence = divergence - (F.size(q) - 1) / (8 * math.log(2) * n)
    return F.sqrt(F.greatest(F.lit(0.0), divergence))


def shares(counts: Column) -> Column:
    """Counts as shares; null if there are none."""
    return _bound(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), lambda n: F.when(n > 0, F.transform(counts, lambda x: x / n)))


def heavy_texts(rows: DataFrame) -> DataFrame:
    """Keys of the texts that make up at least SHARE of the rows (KEY); at most 1 / SHARE rows."""
    total = rows.count()
    return cut(rows.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") >= total * SHARE).select(*KEY, F.lit(True).alias("heavy")))


def common_words(rows: DataFrame, most: int = COMMON) -> DataFrame:
    """(lang, common): the words that most texts of a language hold, in lower case, most first, ties by the word.

    rows: (lang, text, heavy, KEY). All copies of a heavy text count as one.
    """
    words = rows.select("lang", F.when(F.col("heavy"), F.struct(*KEY)).alias("copy"), F.explode(F.array_distinct(words_of(F.lower("text")))).alias("word"))
    held = words.groupBy("lang", "word", "copy").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("copy").isNull(), F.col("n")).otherwise(1))
    held = held.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = held.withColumn("rank", rank).where(F.col("rank") <= most)
    return top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("l")).select("lang", F.transform("l", lambda x: x["word"]).alias("common"))


def measured(rows: DataFrame, common: DataFrame) -> DataFrame:
    """rows (doc_id, lang, text, heavy, KEY) with the base counts and both histograms instead of the text."""
    words = _bound(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), F.filter(F.transform(w, lambda x: F.array_position("common", F.lower(x))), lambda i: i > 0).alias("ids")),
    )
    listed = with_class_counts(rows.join(small(common), "lang", "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>"))))
    out = listed.withColumn("_words", words).withColumn("_lines", repeated_lines(F.col("text")))
    of = lambda name: F.get("_classes", F.lit(CLASSES.index(name)))
    ids = F.col("_words.ids")
    counts = _bound(ids, lambda ids: F.transform("common", lambda _, k: F.size(F.filter(ids, lambda i: i == k + 1)).cast("long")))
    return out.select(
        "doc_id", "lang", "heavy", *KEY, F.length("text").cast("long").alias("n_chars"), F.col("_words.n_words").alias("n_words"), (F.length("text") - of("blank")).cast("long").alias("word_chars"), of("symbol").alias("n_symbols"),
        F.col("_lines").alias("n_dup_lines"), F.col("_words.n_repeat_words").alias("n_repeat_words"), F.col("_classes").alias("classes"), F.concat(counts, F.array(F.col("_words.n_words") - F.size(ids))).alias("commons"),
    )


def small(df: DataFrame) -> DataFrame:
    """The table for a broadcast if it has few rows, else as it is: then the join shuffles."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def references(counted: DataFrame) -> DataFrame:
    """(lang, texts, class_ref, common_ref): the shares of a language's characters and words, from whole numbers only.

    counted: what measured() gives. Of the copies of a heavy text one counts.
    """
    once = counted.where("heavy").groupBy("lang", *KEY).agg(F.first("classes").alias("classes"), F.first("commons").alias("commons")).drop(*KEY)
    rows = counted.where("not heavy").select("lang", "classes", "commons").unionByName(once)
    n, m = len(CLASSES), COMMON + 1
    # the last element of commons is the rest; a language with few words has fewer than COMMON before it
    rest = F.element_at("commons", -1)
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n)] + [F.sum(F.when(F.size("commons") > i + 1, F.get("commons", F.lit(i)))).alias(f"w{i}") for i in range(m - 1)]
    out = rows.groupBy("lang").agg(F.count("*").alias("texts"), *sums, F.sum(rest).alias("rest"))
    commons = F.concat(F.filter(F.array(*[F.col(f"w{i}") for i in range(m - 1)]), lambda x: x.isNotNull()), F.array("rest"))
    return out.select("lang", "texts", shares(F.array(*[F.col(f"c{i}") for i in range(n)])).alias("class_ref"), shares(commons).alias("common_ref"))


def check(docs: DataFrame, class_limit: float = CLASS_LIMIT, common_limit: float = COMMON_LIMIT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, common_distance).

    A null text has no words and fails the base rules. Documents without a language are a language of their own. A distance is
    null where a guard holds it back, and then decides nothing. Null and repeated ids are kept, a row each; no rows give
    no rows. Texts are read three times: for the heavy ones, for the commonest words, for everything else.
    """
    plain, _ = set_aside(docs, "doc_id", "text", "lang")
    rows = plain.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", *text_key(F.col("text")))
    heavy = heavy_texts(rows)
    rows = rows.join(F.broadcast(heavy), KEY, "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))  # at most 1 / SHARE rows
    counted = cut(measured(rows, cut(common_words(rows))))
    known = cut(references(counted))
    judged = counted.join(small(known), "lang", "left")
    far = lambda counts, ref, n: js_distance(shares(F.col(counts)), F.col(ref), F.col(n))
    enough = F.col("texts") >= LANGUAGE_TEXTS
    judged = judged.withColumns({
        "class_distance": F.when(enough & (F.col("n_chars") >= CLASS_CHARS), far("classes", "class_ref", "n_chars")),
        "common_distance": F.when(enough & (F.col("n_words") >= COMMON_WORDS), far("commons", "common_ref", "n_words")),
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
    })
    near = F.coalesce(F.col("class_distance") <= class_limit, F.lit(True)) & F.coalesce(F.col("common_distance") <= common_limit, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"))
