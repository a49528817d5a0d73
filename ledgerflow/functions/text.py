"""Text functions as Column builders; only Unicode composition and HTML need Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_LIMIT, SUMMARY_LIMIT = 500, 10_000

# The blanks of Unicode text, the control characters that are refused, the letters of spoken words.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
WORD = r"[0-9A-Za-z\u0400-\u04ff]+(?:[-\u2019'][0-9A-Za-z\u0400-\u04ff]+)*"
NAMED_LINE = r"^\s*(?:model|модель|run[ _-]?id)\s*:"  # lines that name a model or run
MARKDOWN = r"([\\`*_{}\[\]<>()#+\-.!|])"


def newlines(x: Column) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def has_controls(x: Column) -> Column:
    return x.rlike(CONTROLS)


def collapse(x: Column) -> Column:
    """Runs of Unicode blanks become one space, none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE + "+", " "))


def strip(x: Column) -> Column:
    """No Unicode blanks at the ends."""
    return F.btrim(x, F.lit(BLANKS))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows: what Python makes of them stays small however long a batch is."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def mapped(f: Callable[[str | None], str | None], x: Column) -> Column:
    """A Python function of one text, sent in Arrow batches and taken from them in parts; null stays null."""

    def run(values: pa.Array) -> pa.Array:
        parts = (values.slice(i, 256).to_pylist() for i in range(0, len(values), 256))
        made = [pa.array([None if v is None else f(v) for v in part], pa.string()) for part in parts]
        return pa.concat_arrays(made) if made else pa.array([], pa.string())

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}  # Spark reads types, not their names
    return F.arrow_udf(run, "string")(x)


def _composed(value: str) -> str:
    return unicodedata.normalize("NFC", value)


def nfc(x: Column) -> Column:
    """NFC. Text below U+0300 is composed already; Python gets null for it, so hardly anything is sent."""
    return F.coalesce(mapped(_composed, F.when(x.rlike(r"[^\x00-\u02ff]"), x)), x)


def title(x: Column) -> Column:
    return nfc(collapse(newlines(x)))


def title_error(x: Column, normalized: Column, code: str = "E_FIXTURE_INVALID") -> Column:
    """Null for a good title; x is the raw text."""
    return F.when(has_controls(newlines(x)) | ~F.length(normalized).between(1, TITLE_LIMIT), F.lit(code))


def summary(x: Column) -> Column:
    return nfc(strip(newlines(x)))


def summary_error(x: Column, normalized: Column, code: str = "E_FIXTURE_INVALID") -> Column:
    return F.when(has_controls(newlines(x)) | (F.length(normalized) > SUMMARY_LIMIT), F.lit(code))


def spoken_words(x: Column) -> Column:
    """Number of words as they are spoken: letters and digits, with inner hyphens and apostrophes."""
    return F.regexp_count(x, F.lit(WORD)).cast("long")


def sentence(x: Column) -> Column:
    """With a full stop, unless it ends as a sentence."""
    return F.when(x.rlike(r"[.!?]\z"), x).otherwise(F.concat(x, F.lit(".")))


def boundary_rank(x: Column) -> Column:
    """0 after a sentence, 1 after a clause, else 2; closing quotes and brackets may follow."""
    return F.when(x.rlike(r'[.!?]["»)]*$'), 0).when(x.rlike(r'[,;:]["»)]*$'), 1).otherwise(2)


def escape_markdown(x: Column) -> Column:
    return F.regexp_replace(x, MARKDOWN, r"\\$1")


def shown(x: Column) -> Column:
    """Escaped text, or the word null."""
    return F.coalesce(escape_markdown(x.cast("string")), F.lit("null"))


def tokens(x: Column, pattern: str) -> Column:
    """All matches, distinct, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))


def terminal_safe(x: Column) -> Column:
    """Control characters other than LF, CR and tab as \\uXXXX."""
    code = lambda c: F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0")
    out = F.transform(F.split(x, ""), lambda c: F.when(c.rlike(r"^[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]$"), F.concat(F.lit("\\u"), code(c))).otherwise(c))
    return F.array_join(out, "")


def without_identity_lines(x: Column) -> tuple[Column, Column]:
    """The text without lines that name a model or run, ending in one LF; and how many lines went."""
    lines = F.split(newlines(x), "\n")
    kept = F.filter(lines, lambda v: ~v.rlike(f"(?iU){NAMED_LINE}"))
    return F.concat(F.regexp_replace(F.array_join(kept, "\n"), rf"{SPACE}+\z", ""), F.lit("\n")), F.size(lines) - F.size(kept)


def redact(x: Column, identities: list[str], aliases: list[str], mark: str = "[MODEL]") -> tuple[Column, Column]:
    """Text with identities and whole-word aliases replaced in order, and how many lines and names went."""
    import re

    text, removed = without_identity_lines(x)
    patterns = [rf"(?iu){re.escape(i)}" for i in identities]
    if aliases:
        patterns.append(rf"(?iuU)\b(?:{'|'.join(map(re.escape, aliases))})\b")
    for p in patterns:
        removed = removed + F.regexp_count(text, F.lit(p))
        text = F.regexp_replace(text, p, mark.replace("[", "\\[").replace("]", "\\]"))
    return text, removed.cast("long")


def residue(x: Column, identities: list[str], aliases: list[str]) -> Column:
    """Whether an identity is still there."""
    import re

    patterns = [rf"(?iu){re.escape(i)}" for i in identities] + [rf"(?iuU)\b(?:{'|'.join(map(re.escape, aliases))})\b"]
    return reduce(lambda a, b: a | b, [x.rlike(p) for p in patterns])


def canonical_json(*fields: Column, line_feed: bool = False) -> Column:
    """Compact JSON with sorted keys and nulls kept; fields must be given in the order of their names, inside too."""
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return F.concat(text, F.lit("\n")) if line_feed else text


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)
