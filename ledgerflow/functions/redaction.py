"""Redaction of very many names in one pass over a text, with the result of replacing one name after the other.

One automaton finds every place where any name stands. The places are then taken in the order of the names, each name's
from the left, and what overlaps a place that is taken is passed over: that is what is left for a name when those before it
are replaced. Whole words come last, as one pattern for all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[MODEL]"


def _folded(c: str) -> str:
    """A character without its case, always one character."""
    if c == "İ":
        return "i"
    upper = c.upper() if len(c.upper()) == 1 else c
    return upper.lower() if len(upper.lower()) == 1 else upper


def folded(x: str) -> str:
    return x.lower() if x.isascii() else "".join(map(_folded, x))


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def touches_mark(name: str, mark: str = MARK) -> bool:
    """Whether a name could stand in, or reach into, a mark: replacing names one by one would then find it there."""
    n, m = folded(name), folded(mark)
    return n in m or any(n.startswith(m[-k:]) or n.endswith(m[:k]) for k in range(1, len(m) + 1)) or m in n


@lru_cache(maxsize=8)
def redactor(names: tuple[str, ...], words: tuple[str, ...] = (), mark: str = MARK) -> Callable[[str], tuple[str, int]]:
    """text -> (text, number of names replaced). names stand anywhere, words as whole words; case does not matter.

    Names that could reach into a mark are refused, as are empty ones.
    """
    import ahocorasick

    bad = [n for n in (*names, *words) if not n or touches_mark(n, mark)]
    if bad:
        raise ValueError(f"names that reach into the mark cannot be redacted in one pass: {bad[:5]}")
    automaton = ahocorasick.Automaton()
    spots: dict[str, tuple[int | None, int | None]] = {}
    for i, n in enumerate(names):
        spots.setdefault(folded(n), (i, None))
    for i, n in enumerate(words):  # at one start the first of the words in the list is taken
        key = folded(n)
        spots[key] = (spots.get(key, (None, None))[0], spots[key][1] if key in spots and spots[key][1] is not None else i)
    for key, ranks in spots.items():
        automaton.add_word(key, (len(key), *ranks))
    if not spots:
        return lambda text: (text, 0)
    automaton.make_automaton()

    def redact(text: str) -> tuple[str, int]:
        low = folded(text)
        found: list[tuple[int, int, int]] = []
        whole: list[tuple[int, int, int]] = []
        for last, (size, name, word) in automaton.iter(low):
            start = last + 1 - size
            if name is not None:
                found.append((name, start, last + 1))
            if word is not None:
                whole.append((start, word, last + 1))
        if not found and not whole:
            return text, 0
        taken = bytearray(len(text) + 1)
        spans: list[tuple[int, int]] = []

        def take(start: int, end: int) -> None:
            taken[start:end] = b"\x01" * (end - start)
            spans.append((start, end))

        for _, start, end in sorted(found):
            if not any(taken[start:end]):
                take(start, end)

        def bounded(at: int) -> bool:
            """Whether words begin or end here: one of the characters beside it belongs to a word. Those of a mark do not."""
            left = at > 0 and not taken[at - 1] and _word(text[at - 1])
            right = at < len(text) and not taken[at] and _word(text[at])
            return left != right

        done = 0  # the words are one pattern: what it has taken is behind it, and still text for the bounds of the next
        for start, _, end in sorted(whole):
            if start >= done and not any(taken[start:end]) and bounded(start) and bounded(end):
                spans.append((start, end))
                done = end
        spans.sort()
        out, at = [], 0
        for start, end in spans:
            out += [text[at:start], mark]
            at = end
        return "".join([*out, text[at:]]), len(spans)

    return redact


def redact_many(x: Column, names: list[str], words: list[str] | None = None, mark: str = MARK) -> Column:
    """struct(text, removed) of a text; null stays null. The automaton is built once in each Python worker."""
    key = tuple(names), tuple(words or ()), mark
    redactor(*key)  # names that cannot be redacted are refused when the query is made

    def run(values: pd.Series) -> pd.DataFrame:
        redact = redactor(*key)
        rows = [(None, None) if v is None else redact(v) for v in values]
        return pd.DataFrame(rows, columns=["text", "removed"])

    return F.pandas_udf(run, "text string, removed long")(x)
