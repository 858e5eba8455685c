"""Physical-plan guards: no cartesian products or nested-loop joins, no
row-at-a-time Python in relational queries, pruned scans, partial
aggregation before the first exchange, top-k as an ordered limit."""

import contextlib
import io

import pytest

import __spark_entry__ as entry

MODEL_QUERIES = {"m1_m8_forest_report", "m14_feature_importance", "m15_class_probabilities_long",
                 "m6_m10_text_quality_report", "m7_m24_image_mlp_eval"}


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - MODEL_QUERIES))
def test_no_cross_join_or_python_rows(spark, sf_small, name):
    p = plan(entry.queries()[name](spark, sf_small))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in p, f"{name}: {bad}"


def test_flagship_scan_is_pruned_and_pre_aggregated(spark, sf_small):
    p = plan(entry.queries()["a4_source_stats"](spark, sf_small))
    assert "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double,l_returnflag:string>" in p
    # node (3), right after the scan and projection, is the map-side partial
    # aggregate; the first exchange (4) moves its output, not raw lines
    agg = p[p.index("(3) HashAggregate"):p.index("(4) Exchange")]
    assert "partial_count" in agg and "partial_sum" in agg


def test_top_k_is_an_ordered_limit(spark, sf_small):
    p = plan(entry.queries()["t1_top_revenue"](spark, sf_small))
    assert "TakeOrderedAndProject" in p
