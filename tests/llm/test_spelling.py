import random
import zlib
from collections import Counter

import brute
import pytest

from panelrd.llm import spelling


def plain(rows):
    """The contract by loops over all pairs."""
    import re

    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}
    near = {w: [x for x in n if brute.one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def texts(seed, alphabet):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    for w in list(words):
        for _ in range(3):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:]]))
    weights = [rng.choice([1, 1, 5, 30, 200]) for _ in words]
    return [(i if i % 7 else None, " ".join(rng.choices(words, weights, k=rng.randint(0, 400))) + rng.choice(["", "\n", "Zz9", " \u00df\u00c9t\u00e9\u00e9\u00e9"])) for i in range(60)]


@pytest.mark.parametrize("seed,alphabet,frequent", [(1, "ab", 256), (2, "ab\u00e9", 4), (3, "abcdefgh", 16), (4, "aA", 1)])
def test_all_words_against_brute_force(spark, frame, seed, alphabet, frequent):
    rows = texts(seed, alphabet)
    got = spelling.group_variants(frame(rows), frequent=frequent).collect()
    assert len({r.word for r in got}) == len(got)
    assert {tuple(r) for r in got} == plain(rows)


def test_odd_tables(spark, frame):
    run = "x" * 6_000
    rows = [(1, None), (2, ""), (3, "abcdef"), (3, "abcdef"), (None, "abcdef abcdef ABCDEF abcdeg"), (4, f"{run} {run}y " * 6), (5, "abcdeg " * 30)]
    got = spelling.group_variants(frame(rows)).collect()
    assert {tuple(r) for r in got} == plain(rows)
    assert spelling.group_variants(frame(rows).limit(0)).count() == 0


def test_no_table_is_sent_through_the_driver(frame, monkeypatch):
    plans = []
    keep = spelling.written

    def seen(df, *a):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, *a)

    monkeypatch.setattr(spelling, "written", seen)
    last = spelling.group_variants(frame(texts(1, "ab")))
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert last.count() and sum("SortMergeJoin" in p for p in plans) >= 5
    assert not [p for p in plans if "Broadcast" in p]
