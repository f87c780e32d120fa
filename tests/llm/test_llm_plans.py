import pytest

import __spark_entry__ as entry
from panelrd.llm import queries
from test_plans import check_shape


@pytest.mark.parametrize("name", [*sorted(queries.QUERIES), "pipeline"])
def test_plan_shape(spark, name):
    check_shape(spark, name, entry.queries()[name])
