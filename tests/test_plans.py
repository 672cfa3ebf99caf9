"""Plans of the engine's queries: everything stays in the JVM, no join is a product, scans read what is asked for."""

import re

import pytest

from lectern.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_native(spark, name):
    text = plan(spark, name)
    assert not re.search(r"Python|MapInArrow|MapInPandas|CartesianProduct|BroadcastNestedLoopJoin", text)


@pytest.mark.parametrize(
    ("name", "columns"),
    [("word_counts", {"doc_id", "text"}), ("discover_formats", {"page_id", "url", "html"}), ("run_counts", {"o_orderstatus"}), ("position_join", {"l_orderkey", "l_partkey", "l_linenumber", "l_quantity"}), ("manifest", {"doc_id", "text", "lang", "source", "n_chars"}), ("ordered_concat", {"conv_id", "turn", "text"})],
)
def test_columns_read(spark, name, columns):
    read = set()
    for found in re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name)):
        read |= {x.split(":")[0] for x in found.split(",") if x}
    assert read and read <= columns


def test_filters_reach_the_scan(spark):
    text = plan(spark, "pending_anti_join")
    assert "EqualTo(o_orderstatus,F)" in text


@pytest.mark.parametrize(("name", "most"), [("fast_lint", 0), ("manifest", 0), ("content_filter", 0), ("lint_fixed_count", 0), ("pending_anti_join", 2), ("progress_upsert_latest", 1), ("region_merge", 2), ("ordered_concat", 1), ("xref_dedup", 2), ("index_lines", 1)])
def test_exchanges(spark, name, most):
    """No more shuffles than the operator needs."""
    assert len(re.findall(r"\bExchange (?:hash|range|Single)", plan(spark, name))) <= most
