"""Registered queries do their whole job."""

from conftest import DATA

from lociflow import registry
from lociflow.catalog import Catalog
from lociflow.plans import lookups

SF = f"{DATA}/sf0.001"


def test_clusters_hold_all_deduped_traits(spark):
    want = sorted(r["trait_id"] for r in registry.QUERIES["dedupe_traits"](spark, SF).collect())
    got = registry.QUERIES["trait_clusters"](spark, SF).collect()
    assert sorted(r["trait_id"] for r in got) == want and {r["cluster_id"] for r in got} == set(range(1, 11))
    assert sum(r["n_traits"] for r in registry.QUERIES["cluster_summary"](spark, SF).collect()) == len(want)


def test_all_pairs_are_decoded(spark):
    cat = Catalog.from_bed(spark, SF)
    assert registry.QUERIES["decode_rows"](spark, SF).count() == cat.coloc_pairs.count() > 0


def test_ld_matrix_of_more_than_fifty(spark):
    cat = Catalog.from_bed(spark, f"{DATA}/sf0.01")
    ids = cat.variants.filter("ld_block_id = 4").select("id")
    some = [r["id"] for r in ids.collect()]
    assert len(some) > 50
    assert lookups.ld_matrix(cat, some).count() == lookups.ld_matrix(cat, ids).count() == registry.QUERIES["ld_matrix"](spark, f"{DATA}/sf0.01").count() > 0
