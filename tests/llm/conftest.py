import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, n long, bucket string, kept string, key int, place int, size int, class string, spans string, h string, ord string"


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source) rows, with columns of clashing names."""
    from panelrd.llm.common import ship_package

    ship_package(spark)

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 1, 2, "b", "k", 3, 4, 5, "c", "s", "h", "o") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.01"
