import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerflow.llm import packing

from .helpers import EDGES, docs

PATH = packing.default_tokenizer()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert packing.encoder(PATH)(text) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_special_strings():
    exact = Tokenizer.from_file(PATH)
    for t in ("a<|endoftext|>b", "", " \n\n x", "don't 12 ½ é"):
        assert packing.encoder(PATH)(t) == exact.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_patterns(histogram):
    packs = packing.patterns(histogram, 64)
    assert all(sum(p) <= 64 and n > 0 for p, n in packs)
    used = Counter()
    for p, n in packs:
        for length in p:
            used[length] += n
    assert used == Counter(histogram)
    seen = defaultdict(set)
    for length, runs in packing.slots(packs).items():
        firsts = [r[0] for r in runs] + [histogram[length]]
        for (first, base, offset), end in zip(runs, firsts[1:], strict=True):
            for rank in range(first, end):
                seen[base + rank - first].add((offset, length))
    for spots in seen.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length


def check(spark, rows):
    exact = Tokenizer.from_file(PATH)
    got = packing.pack(docs(spark, rows), sequence=2048).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want[i, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    packs = defaultdict(list)
    for r in got:
        packs[r.sequence_id].append((r.offset, r.length))
    assert sorted(packs) == list(range(len(packs)))
    for spots in packs.values():
        ends = [o + n for o, n in sorted(spots)]
        assert [o for o, _ in sorted(spots)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert Counter(sum(n for _, n in spots) for spots in packs.values()) == shortest_first([r.length for r in got], 2048)
    return len(packs)


def shortest_first(lengths, sequence):
    """How many packs are filled how far: each length, longest first, into the shortest pack, or a new one if it does not fit."""
    packs = []
    for n in sorted(lengths, reverse=True):
        if packs and packs[0] + n <= sequence:
            heapq.heapreplace(packs, packs[0] + n)
        else:
            heapq.heappush(packs, n)
    return Counter(packs)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_patterns_against_brute_force(lengths):
    packs = Counter()
    for p, n in packing.patterns(dict(Counter(lengths)), 64):
        packs[sum(p)] += n
    assert packs == shortest_first(lengths, 64)


def test_very_long_runs():
    exact = Tokenizer.from_file(PATH)
    encode = packing.encoder(PATH)
    for unit in (" ", "\n", "a", "!", "\n ", "\u00a0"):
        text = "x" + unit * (1_000_000 // len(unit)) + "y"
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids


def test_one_length_and_id_of_many_rows(spark, monkeypatch):
    """A length that all rows share is ranked in many cells, whatever their ids and texts."""
    monkeypatch.setattr(packing, "ROWS_A_CELL", 50)
    check(spark, [(7, "the same")] * 1500 + [(None, "no id")] * 700 + [(i, "w " * (i % 300)) for i in range(600)])


def test_round_trip(spark):
    check(spark, EDGES)
    check(spark, [])
    rows = [(i, "word " * (i * 37 % 1500)) for i in range(800)]
    n = check(spark, rows)
    tokens = sum(i * 37 % 1500 + (2 if i * 37 % 1500 else 1) for i in range(800))
    assert tokens / (n * 2048) > 0.95


def test_runs_of_blanks_of_any_length():
    """Ids are the library's around the length from which it does them itself, and quadratic time is out of reach."""
    import time

    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    encode, exact = packing.encoder(path), Tokenizer.from_file(path)
    encode("warm"), exact.encode("warm")
    for run in (1, 2, packing.MOST_BLANKS - 1, packing.MOST_BLANKS, packing.MOST_BLANKS + 1, 9_999):
        for blanks in (" ", "\n", "\t ", " \n\n"):
            text = ((blanks * run)[:run] + "a") * max(3, 20_000 // run)
            assert encode(text) == exact.encode(text, add_special_tokens=False).ids
    text = (" " * 9_999 + "a") * 40
    began = time.perf_counter()
    exact.encode(text, add_special_tokens=False)
    library = time.perf_counter() - began
    encode(text)
    assert time.perf_counter() - began - library < 4 * library + 0.5
