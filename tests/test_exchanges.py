"""Blocks are dealt by their document once; what follows needs no exchange."""

import re

import pytest

from sheaf.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [
    "page_word_stats", "page_text", "page_text_sync", "doc_forms", "doc_forms_legacy", "doc_table_cells", "doc_table_cells_legacy",
    "doc_table_grid", "doc_assembly", "doc_assembly_sync", "doc_assembly_legacy", "table_preview"])
def test_blocks_are_dealt_once(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = set(re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan))
    # line items and orders, each by the order; the blocks are not written
    assert {re.sub(r"#\d+L?", "", k) for k in keys} == {"l_orderkey", "doc_id"}
    assert "order-blocks" not in plan


def test_partitions_grow_with_the_tables(spark, monkeypatch):
    from sheaf.plans import queries_blocks as Q
    before = Q.blocks_of(spark, SF).rdd.getNumPartitions()
    monkeypatch.setattr(Q, "ROWS_PER_PARTITION", 100)
    assert Q.blocks_of(spark, SF).rdd.getNumPartitions() > before
