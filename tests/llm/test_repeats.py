import random

import brute
import numpy as np
import pytest

from panelrd.llm import substring_dedup, suffix_dedup


def passages(seed, n=60):
    """Texts with shared passages at several places, copies, near copies, runs of one byte, and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    text = lambda k: rng.choice([" ", "\n"]).join(word() for _ in range(k))
    shared = [text(60) for _ in range(3)]
    rows = []
    for i in range(n):
        rows.append((i * 3, text(rng.randint(0, 20)) + " " + rng.choice(shared) + " " + text(rng.randint(0, 20)) if rng.random() < 0.6 else text(rng.randint(1, 90))))
    base = rows[0][1]
    rows += [(1000 + i, base) for i in range(5)]
    rows += [(2000 + i, base.replace(" ", "  ", 1 + i)) for i in range(5)]
    rows += [(3000, "a" * 700), (3001, "b " * 300), (3002, None), (3003, ""), (3004, " \t\n"), (None, base), (7, shared[0]), (7, shared[1])]
    return rows + [rows[0], rows[3]]


def test_suffix_array_is_sorted_and_finds_repeats():
    rng = random.Random(5)
    for _ in range(100):
        alphabet = rng.choice([b"ab", b"a", b"\x00\xff\x01", bytes(range(256))])
        pieces = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8))]
        array, text = suffix_dedup.suffix_array(pieces, 6)
        assert sorted(array.tolist()) == list(range(len(text)))
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        keys = [tuple(text[i : min(i + 6, ends[np.searchsorted(ends, i)])]) for i in array]
        assert keys == sorted(keys)


@pytest.mark.parametrize("limit", [4096, 3])
def test_suffix_dedup(frame, limit):
    rows = passages(1)
    got = [tuple(r)[:5] for r in suffix_dedup.dedup(frame(rows), length=40, limit=limit).drop("kept").collect()]
    assert sorted(got, key=str) == sorted(brute.suffix(rows, 40), key=str)


@pytest.mark.parametrize("limit", [4096, 3])
def test_substring_dedup(frame, limit):
    rows = passages(2)
    got = [tuple(r)[:4] for r in substring_dedup.dedup(frame(rows), length=12, limit=limit).drop("kept").collect()]
    assert sorted(got, key=str) == sorted(brute.substring(rows, 12), key=str)


def test_kept_text(frame):
    rows = [(1, "x " * 3 + "one two three four five six"), (2, "one two three four five six and more")]
    kept = {r.doc_id: r.kept for r in substring_dedup.dedup(frame(rows), length=4).collect()}
    assert kept == {1: "x x x one two three four five six", 2: "and more"}
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(frame(rows), length=10).collect()} == {1: b"x x x ", 2: b" and more"}


def test_empty_tables(frame):
    for op in (suffix_dedup.op1_suffix_dedup, substring_dedup.op5_substring_dedup):
        assert op(frame([(1, "a")]).filter("doc_id < 0")).count() == 0
        assert op(frame([(None, None)])).count() == 1


def test_nearest_earlier_and_parse():
    left, right = substring_dedup.nearest_earlier(np.array([3, 1, 2, 2, 0]))
    assert left.tolist() == [-1, -1, 1, 1, -1] and right.tolist() == [1, 4, 4, 4, -1]
    found = substring_dedup.relative_parse(np.array([0, 6, 5, 0, 5]), 5)
    assert {i for a, b in found for i in range(a, b)} == set(range(1, 9))
