import numpy as np

from panelrd.llm import langid
from panelrd.llm.common import table


def test_held_out_accuracy(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    found = langid.op8_language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in found if r.held_out]
    assert len(out) > 150 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert np.mean([r.rejected for r in found]) < 0.01 and all(0 <= r.score <= 1 for r in found)


def test_odd_rows(frame):
    rows = [(i, "the quick brown fox jumps " + "over " * (i % 5), "en") for i in range(40)] + [(100 + i, "ärger über größe ßtraße und " + "öl " * (i % 5), "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "12 34 !!", "en"), (203, "über größe", None), (None, "brown fox", "en"), (3, "quick brown", "en"), (204, "你好 " * 30, None)]
    table_ = frame(rows)
    model = langid.fit(table_.filter(~langid.held_out()))
    assert model.langs == ["de", "en"]
    found = langid.identify(table_, model)
    assert found.columns == table_.columns + ["_lang_pred", "_lang_score", "_lang_rejected"]
    got = {(r.doc_id, r.text): (r._lang_pred, r._lang_rejected) for r in found.collect()}
    assert len(got) == len(rows)
    assert all(got[r[:2]] == ("und", True) for r in rows if r[0] in (200, 201, 202))
    assert got[203, "über größe"] == ("de", False) and got[None, "brown fox"] == ("en", False)
    assert got[204, "你好 " * 30][1]  # far from every centroid


def test_without_labels(frame):
    rows = [(1, "some text", None), (2, None, "en")]
    assert langid.fit(frame(rows)) is None
    assert [r.lang_pred for r in langid.op8_language_id(frame(rows)).collect()] == ["und", "und"]
    assert langid.op8_language_id(frame(rows).filter("doc_id > 9")).count() == 0


def test_kmeans_separates_clusters():
    rng = np.random.default_rng(1)
    centres = np.eye(3, 20)
    v = np.repeat(centres, 30, axis=0) + rng.normal(0, 0.02, (90, 20))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert (np.max(langid.spherical_kmeans(v, 3) @ centres.T, axis=0) > 0.99).all()
