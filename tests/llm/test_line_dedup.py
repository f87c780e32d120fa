import random

import brute

from panelrd.llm import line_dedup


def logs(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows = []
    for i in range(120):
        ls = [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.5:
            ls.insert(rng.randint(0, len(ls)), f"Page {rng.randint(1, 99)} of the {word()} report by {rng.choice(['ann', 'bob'])} today")
        if rng.random() < 0.3:
            ls.append("All rights are reserved here")
        if rng.random() < 0.4:
            ls.append("too short")
        rows.append((i * 2, "\n".join(ls)))
    return rows + [(1, None), (3, ""), (5, "\n\n"), (7, "x" * 5000 + "\n" + "All rights are reserved here\r")]


def test_matches_brute_force(frame):
    rows = logs(1)
    for least in (5, 12):
        expected = brute.lines(rows, least)
        got = {r.doc_id: (r._n_lines, r._n_removed, r._kept or "") for r in line_dedup.dedup_lines(frame(rows), min_docs=least).collect()}
        assert got == {i: (n, len(gone), text) for i, (n, gone, text) in expected.items()}
        assert sum(v[1] for v in got.values()) > 30


def test_short_lines_and_shares_match_brute_force(frame):
    rows = logs(2)
    rows += [(1000 + i, f"Page {i} of the same old report now here\nAll rights\nLes.\nthe cat sat {'abcdefgh'[i % 8]}") for i in range(60)]
    expected = brute.lines(rows, 10, short=True)
    got = {r.doc_id: (r._n_lines, r._n_removed, r._kept or "") for r in line_dedup.dedup_lines(frame(rows), short_lines=True).collect()}
    assert got == {i: (n, len(gone), text) for i, (n, gone, text) in expected.items()}
    assert sum(v[1] for v in got.values()) > 200


def test_lines_that_share_only_their_first_words_stay(frame):
    """However many documents begin a line alike, its rest must recur."""
    for n in (12, 150):
        rows = [(i, f"the cat sat {i % 7}q{i}x w{chr(97 + i % 26)}{i // 26}z {'abcdefghij'[i % 10]}{'klmnopq'[i % 7]}v") for i in range(n)]
        rows = [(i, "".join(chr(97 + int(c)) if c.isdigit() else c for c in t)) for i, t in rows]
        assert not any(r._n_removed for r in line_dedup.dedup_lines(frame(rows), short_lines=True).collect())


def test_own_column_names_do_not_clash(frame):
    from pyspark.sql import functions as F

    table = frame([(i, "these words come again and again") for i in range(12)]).withColumns({c: F.lit("mine") for c in ("_rid", "_lines", "rid_", "lines", "_kept")})
    found = line_dedup.dedup_lines(table)
    assert {(r._rid, r._lines, r.rid_, r.lines) for r in found.collect()} == {("mine",) * 4} and found.columns.count("_kept") == 1


def test_variable_fields_are_generalised(frame):
    rows = [(i, f"Order {i} was shipped to {'abcdefghijklm'[i]}x at noon") for i in range(13)]
    got = {r.doc_id: r._n_removed for r in line_dedup.dedup_lines(frame(rows), min_docs=10).collect()}
    assert got == {0: 0, **{i: 1 for i in range(1, 13)}}


def test_exact_short_lines_recur(frame):
    rows = [(i, f"own text {i}\nAll rights reserved.\nPage {i}\n{'ab'[i % 2]}\n2024 \n\nLes.") for i in range(12)]
    got = {r.doc_id: r for r in line_dedup.op6_line_dedup(frame(rows)).collect()}
    assert {i: (r.n_lines, r.n_removed) for i, r in got.items()} == {0: (7, 0), **{i: (7, 3) for i in range(1, 12)}}
    assert got[5].kept_sha256 == brute.sha(b"own text 5\nPage 5\nb\n")


def test_odd_rows(frame):
    line = "these words come again and again"
    rows = [(None, line), (1, line), (1, line), (2, line), (2, line + "\nmore"), (3, None), (4, "")]
    table = frame(rows)
    found = line_dedup.dedup_lines(table, min_docs=2)
    assert found.columns == table.columns + ["_n_lines", "_n_removed", "_kept"]
    got = sorted(((r.doc_id, r._n_removed, r._kept) for r in found.collect()), key=str)
    assert got == sorted([(None, 1, ""), (1, 0, line), (1, 0, line), (2, 1, ""), (2, 1, "more"), (3, 0, None), (4, 0, "")], key=str)
    assert line_dedup.op6_line_dedup(table.filter("doc_id > 99")).count() == 0
