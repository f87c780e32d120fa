import hashlib
import random

from panelrd.llm import fingerprints as fp


def one_by_one(text):
    track, n = fp.classes(text).tolist() + [fp._END], len(text)
    of, keep, at, out = fp.levels(3 * n + 1), fp.level_of(n), 0, []
    for t in range(3 * n):
        if of[t] >= keep:
            out.append(int(fp._MARK[t % fp.PERIOD][track[at]]))
        at += int(fp._MOVE[t % fp.PERIOD][track[at]])
    return f"{n}:{keep}:" + "".join("%x" % m for m in out).rstrip("0")


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abc dé\U0001f600") for _ in range(rng.choice([1, 7, 60, 700, 4500]))) for _ in range(n)]


def test_walk_matches_one_by_one(monkeypatch):
    some = ["", "a", *texts(1, 40)]
    expected = [one_by_one(t) for t in some]
    for together in (2, 32, 1000):
        monkeypatch.setattr(fp, "TOGETHER", together)
        assert fp.fingerprints(some) == expected


def test_likeness_falls_with_edits():
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefghij klmn") for _ in range(4000))
    near = []
    for edits in (0, 8, 80, 800):
        t = list(base)
        for _ in range(edits):
            p = rng.randrange(len(t))
            t[p : p + rng.randint(0, 1)] = rng.choice(["", "z"])
        near.append(fp.likeness(*fp.fingerprints([base, "".join(t)])))
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[1] > 0.9 and near[3] < 0.5
    assert fp.likeness(*fp.fingerprints(["", base])) == 0 and fp.likeness(*fp.fingerprints(["", ""])) == 1


def test_next_document(frame, spark):
    rows = [(i * 5, t) for i, t in enumerate(texts(3, 50))] + [(999, None), (998, ""), (997, "x" * 20000)]
    by = sorted(rows, key=lambda r: -r[0])
    expected = {}
    for k, (i, t) in enumerate(by):
        t, following = t or "", by[(k + 1) % len(by)][1] or ""
        changed = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        p, e, q = (one_by_one(x) for x in (t, changed, following))
        expected[i] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), p, e, fp.likeness(p, e), fp.likeness(p, q))
    for parts in (1, 4):
        got = {r[0]: tuple(r)[1:] for r in fp.op2_edit_fingerprints(frame(rows, parts)).collect()}
        assert got == expected
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r[0]: tuple(r)[1:] for r in fp.op2_edit_fingerprints(frame(rows)).collect()} == expected  # many ranges, some empty
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_tables(frame):
    assert fp.op2_edit_fingerprints(frame([(1, "a")]).filter("doc_id < 0")).count() == 0
    alone = fp.op2_edit_fingerprints(frame([(1, "abcdef")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1 and alone[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    got = fp.op2_edit_fingerprints(frame([(None, "a"), (1, "b"), (1, "b"), (None, None)])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None", "None"]


def test_banded_links(frame):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefghij klmn") for _ in range(1500)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:700] + "#" + t[701:]) for i, t in enumerate(base)] + [(200, base[0]), (None, base[1]), (201, None)]
    got = {(r.doc_id, r.near_id) for r in fp.near_documents(frame(rows)).collect()}
    assert {(100 + i, i) for i in range(12)} | {(200, 0)} <= got | {(b, a) for a, b in got}
    assert all(a % 100 == b % 100 for a, b in got)
