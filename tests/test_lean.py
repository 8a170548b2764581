"""Queries over large tables store, shuffle and broadcast no more than they need."""

import os
from pathlib import Path

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lociflow import registry
from lociflow.catalog import Catalog
from lociflow.plans import lookups
from lociflow.sources import bed

SF = f"{DATA}/sf0.001"


@pytest.fixture
def cat(spark, monkeypatch):
    """A catalog whose folder is empty."""
    monkeypatch.setattr(bed, "_SHELVES", {})
    return Catalog.from_bed(spark, SF)


def stored(cat):
    root = Path(cat._folder.removeprefix("file://"))
    return {n.removesuffix(".parquet") for n in os.listdir(root)} if root.exists() else set()


# Stored before, too: F1 coloc_pairs and study_extractions_by_ld_block_id, F4 coloc_pairs and study_extractions, F3 coloc_groups, rare_results, postings and associations, F2 the three facts.
@pytest.mark.parametrize("name, want", [("region_pairs", {"rows", "variants"}), ("trait_coloc_pairs", {"rows", "variants", "traits"}), ("forest_frame", {"rows", "variants", "genes", "traits"}), ("rollups_maintained", {"rows"})])
def test_what_a_query_stores(spark, cat, name, want):
    assert registry.QUERIES[name](spark, SF).count() > 0
    assert stored(cat) == want


def test_keys_are_the_tables_as_sets(spark, cat):
    """ids and blocks of the facts come from the stored rows; what those do not have is derived with the table."""
    for name, columns in (("study_extractions", ["id", "ld_block_id"]), ("study_extractions", ["id", "cis_trans"]), ("coloc_groups", ["coloc_group_id", "trait_id"]), ("rare_results", ["rare_result_group_id", "study_extraction_id", "gene_id"])):
        want = getattr(cat, name).select(columns)
        for c in (cat, Catalog.open(spark, cat.root)):
            got = c.keys(name, *columns, by="gene_id")
            assert got.schema == want.schema and got.distinct().exceptAll(want.distinct()).count() == want.distinct().exceptAll(got.distinct()).count() == 0 < got.count()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_not_broadcast(spark, cat, monkeypatch):
    """files of few bytes hold ids and names of many, which the driver collects to broadcast them."""
    frames = lambda: (cat.narrow("coloc_groups", "coloc_group_id", "trait_id"), registry.QUERIES["all_traits"](spark, SF))
    assert all("BroadcastHashJoin" in plan(df) for df in frames())
    monkeypatch.setattr(bed, "_SHELVES", {})
    monkeypatch.setattr(bed, "MANY", 0)
    cat = Catalog.from_bed(spark, SF)
    rows, traits = (cat.narrow("coloc_groups", "coloc_group_id", "trait_id"), registry.QUERIES["all_traits"](spark, SF))
    assert plan(rows).count("SortMergeJoin") >= 3 and "BroadcastHashJoin [trait_id" not in plan(rows) and "BroadcastHashJoin" not in plan(traits)
    assert rows.exceptAll(cat.coloc_groups.select(rows.columns)).count() == 0 < rows.count()


def test_summary_broadcasts_clusters_not_names(spark, cat):
    """the names of all traits were broadcast to a few clustered ones."""
    joins = [line for line in plan(registry.QUERIES["cluster_summary"](spark, SF)).split("\n") if "Join" in line and "trait_id" in line]
    assert joins and all("BroadcastHashJoin" in j and "BuildLeft" in j for j in joins), joins


def test_closures_with_associations(spark, cat, monkeypatch):
    """a closure that stores no table equals one that reads the stored ones, of ids and of symbols, with and without trans rows."""
    calls = [lambda c: lookups.gene(c, 3, include_associations=True), lambda c: lookups.genes(c, [2, "Supplier#000000008"], include_associations=True, include_trans=False), lambda c: lookups.trait(c, 5, include_associations=True)]
    parts = [(call, part) for call in calls for part in ("coloc_groups", "rare_results")]
    got = [getattr(call(cat), part) for call, part in parts]
    assert not stored(cat) & {"coloc_groups", "rare_results", "postings", "associations"}
    whole = Catalog.open(spark, cat.root)
    for df, (call, part) in zip(got, parts):
        want = getattr(call(whole), part)
        assert df.columns == want.columns and df.exceptAll(want).count() == want.exceptAll(df).count() == 0 < df.count()
