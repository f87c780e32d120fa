import pytest
from pyspark.sql import functions as F

from panelrd.llm import mixing


def rows():
    out = [(i, "w " * (i % 7), "en", f"src{i % 6}") for i in range(300)]
    out += [(1000 + i, "x y z", "en", "src0") for i in range(400)]  # a hot source
    return out + [(2000, None, "en", None), (2001, "a b", "en", None), (2002, "", "en", "blank"), (None, "null id", "en", "src1"), (5, "w " * 5, "en", "src5")]


def water_filling(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: rate * weight[s] for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def test_targets_and_taken(frame):
    found = mixing.op10_mix_sources(frame(rows())).collect()
    table = rows()
    assert len(found) == len(table)
    sizes = {}
    for _, t, _, s in table:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = water_filling(sizes)
    plan = mixing.mix(frame(rows())).collect()
    for s in sizes:
        mine = [r for r in plan if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(target[s]) for r in mine)
        assert abs(sum(r.taken * r.n_rows for r in mine) - target[s]) <= max(r.size * r.n_rows for r in mine)
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    assert sorted(found, key=str) == sorted(mixing.op10_mix_sources(frame(rows(), 7)).collect(), key=str)


def test_positions_follow_the_schedules(frame):
    plan = mixing.mix(frame([(i, "a b c", "en", "s") for i in range(900)]), slopes=(0.8,)).select(F.explode("positions").alias("t")).collect()
    times = [r.t for r in plan]
    assert 0 <= min(times) and max(times) <= 1
    early = sum(t < 0.5 for t in times) / len(times)
    assert early == pytest.approx(0.5 - 0.8 / 4, abs=0.01)  # the integral of 1 + 0.8 (2t - 1) up to 1/2


def test_mixed_documents_are_in_order_and_whole(frame):
    table = frame(rows())
    mixed = mixing.mixed_documents(table)
    assert mixed.columns == table.columns
    plan = {(r.doc_id, r.source, r.size): r.copies for r in mixing.mix(table).collect()}
    got = {}
    for r in mixed.collect():
        key = (r.doc_id, r.source, len((r.text or "").split()))
        got[key] = got.get(key, 0) + 1
    repeated = (5, "src5", 5)
    assert got == {k: v * (2 if k == repeated else 1) for k, v in plan.items() if v}


def test_empty_tables(frame):
    assert mixing.op10_mix_sources(frame([(1, "a")]).filter("doc_id < 0")).count() == 0
    only = mixing.op10_mix_sources(frame([(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)] * 2


def test_plan_is_native(frame):
    text = mixing.mixed_documents(frame(rows()))._jdf.queryExecution().toString()
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))
