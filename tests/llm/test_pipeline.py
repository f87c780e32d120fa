import random

import brute
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def documents(tmp_path, frame):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(150):
        ls = [" ".join(word() for _ in range(rng.randint(5, 12))) for _ in range(rng.randint(1, 5))]
        if i % 4 == 0:
            ls.insert(0, "this line is found all over the place")
        rows.append((i, "\n".join(ls), "en", f"src{i % 4}"))
    rows += [(200 + i, rows[i][1], "en", "src1") for i in range(10)]
    rows += [(300 + i, rows[i][1] + " more", "en", "src2") for i in range(20, 30)]
    rows += [(400, None, "en", "src1"), (401, "", "en", None), (402, "123 456", None, "src1"), (403, "this line is found all over the place", "en", "src1")]
    frame(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def test_stages_against_brute_force(spark, frame, tmp_path):
    rows = documents(tmp_path, frame)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()} if name != "best_fit_packing" else None
        copies = now.collect()
        now = corpus_pipeline.written(stage(spark, now, str(tmp_path)), name)
        after = now.collect()
        if name != "best_fit_packing":
            assert now.columns == columns
        if name == "language_id":
            assert {r.doc_id for r in after} == {i for i, *_ in rows} - {400, 401, 402}
        elif name == "line_dedup":
            expected = brute.lines([(i, r.text) for i, r in before.items()], 10, short=True)
            text = {i: t for i, (_, gone, t) in expected.items() if not gone or t.split()}
            assert {r.doc_id: r.text for r in after} == text and 403 not in text
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "minhash_dedup":
            found = brute.near_duplicates([(i, r.text) for i, r in before.items()])
            assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in found})
        elif name == "mix_sources":
            assert {r.doc_id for r in after} <= set(before) and max(sum(r.doc_id == i for r in after) for i in before) <= 2
        else:
            by = {}
            for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
                assert by.get(r.sequence_id, 0) == r.offset
                by[r.sequence_id] = r.offset + r.length
            assert len(after) >= len(copies) and max(by.values()) <= 4096


def test_run_equals_the_stages_in_turn(spark, frame, tmp_path):
    documents(tmp_path, frame)
    a, b = (corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32") for _ in range(2))
    assert a.count() > 100 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
