"""Readers, guards, uploads, search and clustering on small inputs."""

import gzip
import math
import re
import zipfile

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lociflow import __version__
from lociflow.catalog import Catalog
from lociflow.functions.cluster import complete_linkage
from lociflow.operators.merge import merge_trait_result, merge_upload_associations
from lociflow.operators.ops import distinct_counts, solo_filter
from lociflow.plans import lookups, search
from lociflow.sources import bed, formats, uploads
from lociflow.sources.upload_store import UploadStore
from lociflow.streaming import ingest

SF = f"{DATA}/sf0.001"
GUID = "0123abcd-0123-4567-89ab-0123456789ab"


@pytest.fixture(scope="module")
def cat(spark):
    return Catalog.from_bed(spark, SF)


def test_version_gate(spark, tmp_path, cat):
    (tmp_path / "manifest.json").write_text('{"version": "0.0.0"}')
    with pytest.raises(ValueError, match="version"):
        Catalog.open(spark, str(tmp_path))
    assert cat.version == __version__ and Catalog.open(spark, cat.root).traits.count() == cat.traits.count()
    assert Catalog.from_bed(spark, SF).root == cat.root, "stored once for a session"
    with pytest.raises(AttributeError):
        cat.no_such_table
    (tmp_path / "manifest.json").write_text('{"version": "%s"}' % __version__)
    cat.genes.write.parquet(str(tmp_path / "genes.parquet"))
    assert Catalog.open(spark, str(tmp_path)).genes.count() == cat.genes.count()


def test_stored_tables_equal_the_derived(spark, cat):
    for name in ("rows", "coloc_pairs", "ld"):
        stored, derived = spark.read.parquet(f"{cat.root}/{name}.parquet"), bed.table(spark, SF, name)
        assert stored.count() == derived.count() and stored.exceptAll(derived).count() == 0


def test_filters_reach_the_files(spark, tmp_path, cat):
    """A stored table is normal already: a filter on a double is pushed down; another table is normalised when read."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(min_p", plan(cat.coloc_groups.filter("min_p < 1e-8")))
    (tmp_path / "manifest.json").write_text('{"version": "%s"}' % __version__)
    spark.sql("SELECT 1L AS lead_variant_id, double('NaN') AS r").write.parquet(str(tmp_path / "ld.parquet"))
    row = Catalog.open(spark, str(tmp_path)).ld.first()
    assert row["r"] is None and row["proxy_variant_id"] is None


def test_distinct_counts(spark):
    a = spark.createDataFrame([(1, 10, 5), (1, 10, 6), (1, None, 6), (2, None, None), (None, 7, None)], "k long, x long, y long")
    b = spark.createDataFrame([(1, 10), (3, 1), (3, 1)], "k long, z long")
    out = {r["k"]: (r["nx"], r["ny"], r["nz"]) for r in distinct_counts(["k"], (a, {"x": "nx", "y": "ny"}), (b, {"z": "nz"})).collect()}
    assert out == {1: (1, 2, 1), 3: (0, 0, 1), None: (1, 0, 0)}
    assert distinct_counts(["k"], (a.limit(0), {"x": "nx"})).count() == 0


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from lociflow.storage import shared_dir

    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    assert shared_dir(spark).startswith("file:/")


def test_statistics_files(spark, tmp_path):
    text = "SNP\tCHR\tBP\tBETA\tP\tLBF_1\n1:1\t1\t10\t0.5\tNA\t2.0\nrs2\tX\t20\tNA\t1e-9\tNA\n"
    with gzip.open(tmp_path / "study_a_with_lbfs.tsv.gz", "wt") as f:
        f.write(text)
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write("snp\tse\nrs3\t1\n")
    a = formats.read_stats(spark, str(tmp_path / "study_a_with_lbfs.tsv.gz")).orderBy("bp").collect()
    assert [(r["study_id"], r["snp"], r["chr"], r["bp"], r["beta"], r["p"], r["lbf_1"], r["se"], r["lbf_10"]) for r in a] == [("study_a", "1:1", "1", 10, 0.5, None, 2.0, None, None), ("study_a", "rs2", "X", 20, None, 1e-9, None, None, None)]
    b = formats.read_stats(spark, [str(tmp_path / "b.tsv.gz")]).first()
    assert (b["study_id"], b["snp"], b["se"], b["bp"]) == ("b", "rs3", 1.0, None)
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for name in ("study_a_with_lbfs.tsv.gz", "b.tsv.gz"):
            z.write(tmp_path / name, f"inside/{name}")
        z.writestr("inside/readme.txt", "no table")
    rows = formats.read_stats_zip(spark, str(tmp_path / "all.zip")).orderBy("study_id", "bp").collect()
    assert [tuple(r) for r in rows[1:]] == [tuple(r) for r in a] and tuple(rows[0]) == tuple(b)


def test_upload_guards():
    good = dict(name="n", email="a@b", sample_size=10)
    uploads.check_upload(**good, compare_with=[GUID])
    for bad in ({"name": ""}, {"email": ""}, {"sample_size": None}, {"sample_size": 0}, {"category": "other"}, {"ancestry": "AFR"}, {"reference_build": "hg17"}, {"p_value_threshold": 1e-4}, {"p_value_threshold": 0}, {"n_bytes": (1 << 30) + 1}, {"compare_with": ["x"]}):
        with pytest.raises(ValueError):
            uploads.check_upload(**{**good, **bad})
    names = {c: c for c in ("CHR", "BP", "EA", "OA", "P")}
    uploads.check_columns(names | {"BETA": "b", "SE": "s"})
    uploads.check_columns(names | {"OR": "o", "LB": "l", "UB": "u"})
    for bad in (names, names | {"BETA": "b"}, names | {"OR": "o", "LB": "l"}, {"BETA": "b", "SE": "s"}):
        with pytest.raises(ValueError):
            uploads.check_columns(bad)


def test_upload_of_odds_ratios(spark, tmp_path):
    raw = spark.createDataFrame([("1", 5, 1.5, 1.2, 1.875, 1e-9), ("1", 6, 0.0, 1.0, 2.0, 1e-9), ("1", 7, 2.0, 1.0, 4.0, 0.5)], "c string, b int, `o.r` double, l double, u double, p double")
    out = uploads.upload_normalise(raw, {"CHR": "c", "BP": "b", "OR": "o.r", "LB": "l", "UB": "u", "P": "p"}).orderBy("bp").collect()
    assert len(out) == 2 and math.isclose(out[0]["beta"], math.log(1.5)) and math.isclose(out[0]["se"], (math.log(1.875) - math.log(1.2)) / 3.92) and out[1]["beta"] is None
    df = uploads.upload_normalise(raw, {"CHR": "c", "BP": "b", "OR": "o.r", "LB": "l", "UB": "u", "P": "p"})
    store = UploadStore(spark, f"file://{tmp_path}")
    for _ in range(2):
        store.write(GUID, df.withColumn("guid", F.lit(GUID)), [{"guid": GUID}])
    got = store.rows(GUID)
    assert got.count() == 2 and got.first()["guid"] == GUID
    with pytest.raises(ValueError):
        store.upload(raw, {"CHR": "c", "BP": "b", "EA": "c", "OA": "c", "OR": "o.r", "LB": "l", "UB": "u", "P": "p"}, "n", "a@b", 10, "x")


def test_ids_and_bundles(cat):
    for bad in ([], [None], None):
        with pytest.raises(ValueError):
            lookups.traits(cat, bad)
    with pytest.raises(ValueError):
        lookups.genes(cat, [3] * 11)
    with pytest.raises(ValueError):
        lookups.variants(cat, list(range(51)))
    with pytest.raises(ValueError):
        lookups.variants(cat, list(range(11)), expand=True)
    with pytest.raises(ValueError):
        lookups.get_upload(cat, "x")
    guid = cat.uploads.agg(F.min("guid")).first()[0]
    both, one, up = lookups.traits(cat, [5, guid], include_coloc_pairs=True), lookups.trait(cat, 5, include_coloc_pairs=True), lookups.get_upload(cat, guid, include_coloc_pairs=True)
    for part in ("subject", "coloc_groups", "rare_results", "study_extractions", "coloc_pairs"):
        assert getattr(both, part).count() == getattr(one, part).count() + getattr(up, part).count(), part
    assert both.full_associations is None and both.summary_stats is None and lookups.trait(cat, 5).coloc_pairs is None
    assert set(lookups.trait(cat, 5, include_full_associations=True).full_associations.columns) == {"variant_id", "study_id", "beta", "se", "p", "eaf", "imputed"}
    merged = lookups.trait(cat, 5, include_associations=True)
    assert {"beta", "se", "p", "eaf"} <= set(merged.coloc_groups.columns) & set(merged.rare_results.columns)


def test_merge_without_keys(spark):
    rows = spark.createDataFrame([(1, None, 7), (None, 2, 7), (None, None, 8)], "study_id int, existing_study_id int, variant_id int")
    values = spark.createDataFrame([(7, 0.5, 1)], "variant_id int, beta double, ord int")
    assert [r["variant_id"] for r in merge_upload_associations(rows, values).collect()] == [8]
    assert merge_upload_associations(rows.filter("variant_id = 7"), values).count() == 2
    assert merge_upload_associations(rows, None) is rows and merge_trait_result(None, rows) is rows and merge_trait_result(rows, None) is rows


def test_search_text(cat):
    with pytest.raises(ValueError):
        search.search(cat, "")
    for bad in ("a{", "alz ("):
        with pytest.raises(ValueError):
            search.search(cat, bad)
        assert search.search(cat, bad, literal=True).count() == 0
    some = cat.search_terms.filter("type = 'trait'").first()["name"]
    hits = search.search(cat, some, literal=True).collect()
    assert some in {r["name"] for r in hits} and all(some.lower() in r["name"].lower() for r in hits)
    assert cat.cached_search_terms is cat.cached_search_terms and cat.cached_search_terms.is_cached


def test_solo_filter_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "g int, x string")
    of = lambda **k: sorted(r["x"] for r in solo_filter(df, "g", **k).collect())
    assert of() == ["a", "b", "d", "e"] and of(least=3) == [] and of(least=3, keep_null=True) == ["d", "e"]


def closest_pairs(points, k):
    """Complete linkage by its definition: the pair of clusters whose farthest members are closest, one merge at a time."""
    groups = [[i] for i in range(len(points))]
    far = lambda a, b: max(float(np.linalg.norm(points[i] - points[j])) for i in a for j in b)
    while len(groups) > k:
        a, b = min(((a, b) for a in range(len(groups)) for b in range(a)), key=lambda p: far(groups[p[0]], groups[p[1]]))
        groups[b] += groups.pop(a)
    return {frozenset(g) for g in groups}


def test_complete_linkage():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 40):
        points = rng.standard_normal((n, 5))
        for k in (1, 3, 10):
            got = complete_linkage(points, k)
            assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got.tolist())} == closest_pairs(points, k)
            assert list(dict.fromkeys(got.tolist())) == list(range(1, max(got) + 1))
    assert len(complete_linkage(np.zeros((0, 0)), 10)) == 0
    assert len(set(complete_linkage(rng.standard_normal((3000, 20)), 10).tolist())) == 10


def test_uploads_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join('{"guid": "%s", "name": "n", "received": "2024-01-01T00:0%d:00", "trait_id": 1}' % (g, i) for i, g in enumerate((GUID, GUID, "other"))))
    q = ingest.read_uploads(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("landed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert sorted(r["guid"] for r in spark.table("landed").collect()) == sorted([GUID, "other"])


def test_guid_pattern():
    assert re.match(uploads.GUID, GUID) and not re.match(uploads.GUID, GUID + "0")


def test_matrix_and_record(spark, monkeypatch):
    from lociflow.plans import analyses

    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 5), (3, 7), (None, 5)], "coloc_group_id int, trait_id int")
    dense = analyses.shared_groups(rows, dense=True)
    want = {(5, 5): 2, (5, 6): 1, (6, 5): 1, (6, 6): 1, (7, 7): 1}
    assert {(r["trait1"], r["trait2"]): r["shared_colocs"] for r in dense.collect()} == {(a, b): want.get((a, b), 0) for a in (5, 6, 7) for b in (5, 6, 7)}
    wide = analyses.matrix(analyses.shared_groups(rows), "trait1", "trait2", "shared_colocs").orderBy("trait1")
    assert wide.columns == ["trait1", "5", "6", "7"] and [tuple(r) for r in wide.collect()] == [(5, 2, 1, 0), (6, 1, 1, 0), (7, 0, 0, 1)]
    monkeypatch.setattr(analyses, "MOST_DENSE", 2)
    for f in (lambda: analyses.shared_groups(rows, dense=True), lambda: analyses.matrix(rows, "coloc_group_id", "trait_id", "trait_id")):
        with pytest.raises(ValueError):
            f()
    one = analyses.record(spark, {"id": 4, "trait_name": "t"}, "id bigint, trait_name string, p double")
    assert [tuple(r) for r in one.collect()] == [(4, "t", None)]
