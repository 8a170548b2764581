"""Queries that read few columns of a table, once, do not store it."""

import os
from pathlib import Path

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lociflow import registry
from lociflow.catalog import Catalog
from lociflow.functions import cluster
from lociflow.operators.rollups import KINDS, counts_of, counts_of_kind, state_of
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


# What a query stored before: F4 study_extractions_by_variant_id, F5 the three tables, F6, F7, F9, F10 coloc_groups, F8 study_extractions.
@pytest.mark.parametrize("name, want", [
    ("variant_summary_stats", {"rows", "variants", "summary_stats"}), ("associations_full", {"rows", "variants", "traits", "associations"}), ("bundle_envelopes", {"rows", "variants"}),
    ("disease_genes", {"rows", "variants", "traits"}), ("dedupe_traits", {"rows", "variants", "traits", "rollups"}), ("trait_clusters", {"rows", "variants", "traits", "rollups"}),
    ("cluster_summary", {"rows", "variants", "traits", "rollups"}), ("all_traits", {"rows", "traits", "rollups"}),
])
def test_what_a_query_stores(spark, cat, name, want):
    assert registry.QUERIES[name](spark, SF).count() > 0
    assert stored(cat) == want


def test_counts_of_one_kind(spark, cat):
    """a list of traits counted, dealt and stored genes and symbols, too."""
    registry.QUERIES["all_traits"](spark, SF).count()
    assert {n for n in os.listdir(f"{cat._folder.removeprefix('file://')}/rollups.parquet") if "=" in n} == {"kind=trait"}
    facts = {n: getattr(cat, n) for n in ("study_extractions", "coloc_groups", "rare_results")}
    want = counts_of(state_of(facts))
    for kind in KINDS:
        rows = want.filter(F.col("kind") == kind)
        for got in (counts_of_kind(kind, facts), cat.counts_for(kind), Catalog.open(spark, cat.root).counts_for(kind)):
            assert got.columns == rows.columns and got.count() == rows.count() > 0 and got.exceptAll(rows).count() == 0, kind
    odd = spark.createDataFrame([(1, None, "g"), (1, 7, None), (None, 7, None)], "id bigint, trait_id bigint, gene string").withColumn("gene_id", F.lit(None).cast("bigint"))
    for kind in KINDS:
        assert list(map(tuple, counts_of_kind(kind, {"study_extractions": odd}).collect())) == list(map(tuple, counts_of(state_of({"study_extractions": odd})).filter(F.col("kind") == kind).collect()))


def test_narrow_equals_the_table(spark, cat):
    for name in ("study_extractions", "coloc_groups", "rare_results"):
        columns = ["trait_id", "gene", "min_p"]
        for other in (getattr(cat, name).select(columns), Catalog.open(spark, cat.root).narrow(name, *columns)):
            got = cat.narrow(name, *columns)
            assert got.schema.names == columns and got.exceptAll(other).count() == other.exceptAll(got).count() == 0 < got.count()


def test_envelopes_are_compressed(spark, cat):
    """the documents were plain text, most of the query's disk."""
    found = registry.QUERIES["bundle_envelopes"](spark, SF)
    assert found.count() > 0
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    newest = max(folder.glob("json-*"), key=os.path.getmtime)
    assert {p.suffix for p in newest.glob("part-*")} == {".gz"}


def test_clusters_derive_the_matrix_once(spark):
    """the shared groups were derived three times, with all they are derived from."""
    seen = spark.sparkContext.accumulator(0)

    def look(rows):
        for r in rows:
            seen.add(1)
            yield r

    rows = [(a, b, 5 if a == b else 1) for a in range(6) for b in range(6)]
    shared = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).mapPartitions(look), "trait1 bigint, trait2 bigint, shared_colocs bigint")
    assert cluster.trait_clusters(spark, shared, 3).count() == 6 and seen.value == 36
