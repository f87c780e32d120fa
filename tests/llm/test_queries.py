import duckdb
import pytest

import __spark_entry__ as entry
from panelrd.llm import common, queries


def test_registered():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_gives_the_same_rows(spark, sf_small, name):
    got = queries.QUERIES[name](spark, sf_small).toPandas()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    expected = con.sql(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, expected))
    assert a.equals(b.astype(a.dtypes.to_dict()))


def test_shared_folder_is_never_made_up_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        common.shared_folder(Session())
