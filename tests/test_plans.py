"""What Catalyst makes of the queries."""

import pytest

from lodeweave import plans

#: Joins with a side of one row or a request's few fragments, where no key exists.
KEYLESS = {"p4_path_fragment", "k5_limit_per_fragment", "p17_level_filter", "a9_complexity", "a11_duplicate_rate", "k6_worst_functions", "e4_plug_ins"}
#: Queries that run jobs of their own to build their result.
EAGER = tuple(f"st{i}_" for i in range(1, 10)) + tuple(f"s{i}_" for i in range(1, 15)) + ("m5_", "m6_", "index_")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in plans.QUERIES if not n.startswith(EAGER)))
def test_no_cross_join(spark, small, name):
    text = plan(plans.QUERIES[name](spark, small))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text or name in KEYLESS


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(plans.QUERIES["m4_delete_where"](spark, small))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in text
    text = plan(plans.QUERIES["p5_edge_kind"](spark, small))
    assert "PushedFilters: [IsNotNull(l_orderkey)" in text and "l_quantity" not in text
    assert "ReadSchema: struct<lang:string>" in plan(plans.QUERIES["a2_files_per_language"](spark, small))


def test_top_k_does_not_sort_everything(spark, small):
    for name in ("k1_vector_top_k", "k3_latest", "k4_smallest_candidates"):
        assert "TakeOrderedAndProject" in plan(plans.QUERIES[name](spark, small))


def test_ascending_budget_is_over_the_candidates_only(spark, small):
    text = plan(plans.QUERIES["w1_budget_fill_ascending"](spark, small))
    assert text.index("Window") < text.index("TakeOrderedAndProject")
