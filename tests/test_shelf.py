"""Bed tables are stored when they are asked for."""

import os

import pytest
from conftest import DATA

from lociflow.plans import lookups
from lociflow.sources import bed

SF = f"{DATA}/sf0.001"


def test_only_what_is_asked_for(spark, tmp_path):
    """A list of genes stored every fact table, its copies and all pairs before."""
    shelf = bed.Shelf(spark, SF, "1", f"file://{tmp_path}/shelf")
    there = lambda: {n.removesuffix(".parquet") for n in os.listdir(tmp_path / "shelf")}
    shelf.path("ld_blocks")
    assert there() == {"variants", "ld_blocks"}
    shelf.path("rollups")
    assert there() == {"variants", "ld_blocks", "rows", "rollups"}
    shelf.path("study_extractions_by_gene_id")
    assert "study_extractions" not in there() and shelf.path("rows") == f"file://{tmp_path}/shelf/rows.parquet"


def test_counts_and_near_variants_equal_the_sql(spark, tmp_path):
    shelf = bed.Shelf(spark, SF, "1", f"file://{tmp_path}/shelf")
    for name in ("rollups", "ld"):
        got, want = spark.read.parquet(shelf.path(name)), bed.table(spark, SF, name)
        assert got.count() == want.count() > 0 and got.select(want.columns).exceptAll(want).count() == 0, name
    plan = shelf._near_variants()._jdf.queryExecution().executedPlan().toString()
    assert "_bin" in plan.split("Join", 1)[1].split("\n", 1)[0], "variants of a block meet in bins"


def test_a_failure_is_tried_again(spark, tmp_path):
    shelf, calls = bed.Shelf(spark, SF, "1", f"file://{tmp_path}/shelf"), []

    def make():
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("once")
        return 7

    with pytest.raises(ValueError, match="once"):
        shelf._once("x", make)
    assert shelf._once("x", make) == shelf._once("x", make) == 7 and len(calls) == 2


def test_components_open_no_table_before_they_are_read(spark):
    opened = []
    bundle = lookups.Bundle(spark.range(1), lambda: opened.append("coloc") or spark.range(2), variants=lambda: opened.append("variants") or spark.range(3))
    assert not opened and bundle.rare_results is None
    assert bundle.variants.count() == 3 and bundle.variants is bundle.variants and opened == ["variants"]
