import random
import zlib

import numpy as np
import pytest

from panelrd.llm import packing

pytest.importorskip("public_tokenizers")
ODD = ["It's I'LL <|endoftext|> x", "<|ENDOFTEXT|>", "Σίσυφος ΣΑΣ", "İstanbul éa", "a\u0085b c", "日本語 text１２", "''s don't 12ab", "\x1c a\x1fb", "ﬁn ǅ ß", "", "   \n\t ", "é é", "x" * 5000, "a'sb 'Re", "a_. b_, c", "x!. y", "..., a. b", "(a). b", "a.\nb,\nc", ". . ,", "a.b,c", "3,5. 7"]


def test_tokens_equal_the_tokenizers():
    words = packing.WordTokenizer(packing.default_tokenizer())
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abC .,\n'é1_") for _ in range(200)) for _ in range(100)]
    expected = [np.asarray(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.encode(texts) == expected
    words.known.clear()
    assert [words.encode([t])[0] for t in texts] == expected


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    words = packing.WordTokenizer(packing.default_tokenizer())
    words.known.clear()
    for k in range(20):
        texts = [" ".join(f"{a}{b}q" for a in "abcdef" for b in "xyz"[: 1 + (k + j) % 3]) for j in range(3)]
        assert words.encode(texts) == [np.asarray(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert len(words.known) <= 50


def test_plan_is_gapless_and_near_the_bound():
    rng = random.Random(3)
    for histogram in ({4096: 3, 1: 10000}, {3000: 7, 1096: 5, 2: 9}, {rng.randint(1, 4096): rng.randint(1, 400) for _ in range(300)}):
        slots = packing.plan_slots(histogram, 4096)
        filled, placed = {}, {}
        for s in slots:
            for k in range(s.count):
                assert filled.get(q := s.sequence + k // s.each, 0) == s.offset + k % s.each * s.length
                filled[q] = filled.get(q, 0) + s.length
            assert placed.get(s.length, 0) == s.first
            placed[s.length] = placed.get(s.length, 0) + s.count
        assert placed == histogram and max(filled.values()) <= 4096
        bound = max(-(-sum(k * v for k, v in histogram.items()) // 4096), sum(v for k, v in histogram.items() if k > 2048))
        assert len(filled) <= bound * 1.02 + 1


def test_pack(frame):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor", "X1"]) for _ in range(rng.choice([1, 5, 60, 900])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "word " * 3000), rows[0], (None, "no id")]
    table = frame(rows)
    got = packing.pack(table, capacity=512, with_ids=True).collect()
    words = packing.WordTokenizer(packing.default_tokenizer())
    expected = []
    for i, t in rows:
        ids = words.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        expected += [(i, k // 512, k, len(ids[k : k + 512]), zlib.crc32(np.asarray(ids[k : k + 512], "<u4").tobytes()), ids[k : k + 512]) for k in range(0, len(ids), 512)]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got], key=str) == sorted(expected, key=str)
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 512 and len(by) <= max(-(-sum(by.values()) // 512), sum(r.length > 256 for r in got)) + 1
    assert packing.op4_best_fit_packing(table.filter("doc_id < 0")).count() == 0
