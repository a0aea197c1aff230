"""Every registered query of the library against its SQL."""

import pytest
from compare import same_rows

from lodeweave import plans


#: Queries without SQL, which other tests hold against plain loops: test_closed_forms (chunks), test_sources (streams).
ELSEWHERE = {"t2_packed_chunks", "st2_pager_stream", "st4_log_tail"}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, small, name):
    df = plans.QUERIES[name](spark, small)
    if name not in ELSEWHERE:
        same_rows(df, plans.SQL[name], duck)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["id", "token_count", "used"]
