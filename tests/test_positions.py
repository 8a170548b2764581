"""Intervals, blocks by their starts, leads, lookups by key, order of arrival and the store of uploads."""

import bisect
import gzip
import re

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lociflow.catalog import Catalog
from lociflow.operators.intervals import as_of, overlaps
from lociflow.operators.ops import between_ids, keep_first, mark_first
from lociflow.plans import lookups
from lociflow.sources import formats, uploads
from lociflow.sources.upload_store import UploadStore
from lociflow.streaming import ingest

SF = f"{DATA}/sf0.001"
GUIDS = [f"0123abcd-0123-4567-89ab-{i:012d}" for i in range(4)]


@pytest.fixture(scope="module")
def cat(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # whole paths in plans
    yield Catalog.from_bed(spark, SF)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_overlaps(spark):
    rng = np.random.default_rng(4)
    sides = []
    for n in (300, 200):
        start = rng.integers(0, 200_000, n)
        size = (10 ** rng.uniform(0, 6, n)).astype(int) - 1
        rows = [(i, str(int(rng.integers(1, 4))), int(a), int(a + b)) for i, (a, b) in enumerate(zip(start, size))]
        rows += [(1000, "1", 5, 5), (1000, "1", 5, 5), (1001, "1", 8, 7), (1002, None, 1, 9), (1003, "1", None, 9), (1004, "2", 0, 0), (1005, "9", 0, 1 << 40), (1006, "1", -3, 9)]
        sides.append(rows)
    a, b = (spark.createDataFrame(rows, "id int, chr string, start_bp bigint, stop_bp bigint") for rows in sides)
    ok = lambda r: r[1] is not None and r[2] is not None and 0 <= r[2] <= r[3]
    want = sorted((x[0], y[0]) for x in sides[0] for y in sides[1] if ok(x) and ok(y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    out = overlaps(a, b)
    assert sorted((r["left"]["id"], r["right"]["id"]) for r in out.collect()) == want and len(want) > 1000
    assert "NestedLoop" not in plan(out.join(a, F.col("left.id") == a["id"]).filter("right.id > 3")).replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    assert overlaps(a.filter("false"), b).count() == overlaps(a, b.filter("false")).count() == 0


def test_as_of(spark):
    rng = np.random.default_rng(5)
    starts = [(c, int(s), i) for i, (c, s) in enumerate((c, s) for c in ("1", "2") for s in rng.integers(0, 50_000_000, 20))] + [("1", 7_000_000, 900), ("1", 7_000_000, 901), (None, 3, 902), ("2", None, 903)]
    rows = [(str(int(rng.integers(1, 4))), int(x)) for x in rng.integers(0, 60_000_000, 2000)] + [("1", 7_000_000)] * 50 + [(None, 5), ("1", None)]
    df = spark.createDataFrame(rows, "chr string, bp bigint").withColumn("start_bp", F.lit("other"))
    got = as_of(df, spark.createDataFrame(starts, "chr string, start_bp bigint, id int"), "chr", "bp", "start_bp", ["id"])
    assert got.columns == ["chr", "bp", "start_bp", "id"]
    of = {c: sorted((s, i) for k, s, i in starts if k == c and s is not None) for c in ("1", "2")}

    def last(c, x):
        at = of.get(c, []) if x is not None else []
        i = bisect.bisect_right(at, (x, 1 << 30)) if at else 0
        return at[i - 1][1] if i else None

    key = lambda t: tuple((v is not None, v) for v in t)
    assert sorted(((r["chr"], r["bp"], r["id"]) for r in got.collect()), key=key) == sorted(((c, x, last(c, x)) for c, x in rows), key=key)


def test_one_lead_a_block(spark):
    names = {"CHR": "c", "BP": "b", "BETA": "e", "SE": "s", "P": "p"}
    raw = spark.createDataFrame([("1", 5, 0.1, 1.0, 1e-9), ("1", 6, 0.1, 1.0, 1e-8), ("1", 7, 0.1, 1.0, 1e-10), ("1", 7, 0.1, 1.0, 1e-10), (None, 7, 0.1, 1.0, 1e-12), ("1", None, 0.1, 1.0, 1e-12), ("2", 3, 0.1, 1.0, 1e-9)], "c string, b bigint, e double, s double, p double")
    for given, frame in ((names, raw), (names | {"SNP": "rs"}, raw.withColumn("rs", F.lit("rs1")))):
        for options in ({}, {"blocks": spark.createDataFrame([("1", 6, 11), ("1", 0, 10)], "chr string, start_bp bigint, id int")}):
            out = uploads.upload_normalise(frame, given, **options).collect()
            assert len(out) == 7
            leads = sorted((r["chr"], r["bp"]) for r in out if r["is_lead"])
            assert leads == ([("1", 5), ("1", 7)] if options else [("1", 7), ("2", 3)]), "one of two equal rows, none without a place"
            assert all(r["ld_block"] is None for r in out if r["chr"] is None or r["bp"] is None)
    with pytest.raises(ValueError):
        uploads.upload_normalise(raw, {"CHR": "c", "BP": "b", "P": "p", "BETA": "e"})
    hot = spark.range(0, 5000, 1, 7).select(F.lit("b").alias("k"), (F.col("id") % 10).alias("x"))
    assert mark_first(hot, ["k"], ["x"], "first").filter("first").select("x").collect() == [(0,)]


def test_lookups_by_key(cat):
    """A variant's associations are cut by key before the first of each is taken, and read from the copy in their order."""
    out = lookups.variant(cat, 7)
    text = plan(out.coloc_groups, "optimizedPlan")
    assert text.index("Window") < text.index("Filter", text.index("Window")) and "variant_id#" in text[text.index("Window") :]
    physical = plan(out.coloc_groups)
    assert re.search(r"associations_by_variant_id.*PushedFilters: \[[^\]]*EqualTo\(variant_id,7\)", physical), physical
    assert re.search(r"study_extractions_by_variant_id.*PushedFilters: \[[^\]]*EqualTo\(variant_id,7\)", plan(out.study_extractions))
    first = {(r["study_id"], r["variant_id"]): r["beta"] for r in keep_first(cat.associations, ["study_id", "variant_id"], ["ord"]).collect()}
    for rows in (out.coloc_groups, lookups.variants(cat, ["rs7", 20], expand=True, include_associations=True).coloc_groups, lookups.gene(cat, 3, include_associations=True).coloc_groups, lookups.region(cat, 4, include_associations=True).rare_results):
        rows = rows.collect()
        assert rows and all(r["beta"] == first.get((r["study_id"], r["variant_id"])) for r in rows)


def test_closures_read_posting_lists(cat):
    """No shuffle of the group table, and the lists are read by subject; without lists the answer is the same."""
    plain = Catalog(cat.spark, {n: getattr(cat, n) for n in ("traits", "genes", "variants", "ld_blocks", "study_extractions", "coloc_groups", "rare_results", "associations", "coloc_pairs")}, normal=("coloc_groups",))
    assert cat.has_postings and not plain.has_postings
    size = cat.spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for call in (lambda c: lookups.trait(c, 5), lambda c: lookups.genes(c, [3, "Supplier#000000008"])):
        for part in ("coloc_groups", "rare_results"):
            a, b = getattr(call(cat), part), getattr(call(plain), part)
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 0
    try:
        cat.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        text = plan(lookups.trait(cat, 5).coloc_groups)
    finally:
        cat.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert re.search(r"postings.*PushedFilters: \[[^\]]*EqualTo\(subject,5\)", text)
    fact = text[: text.index("Exchange")]
    assert "Bucketed: true" in text and "coloc_groups" in text and "SortMergeJoin" in fact and text.count("Exchange") <= 3, text


def test_catalog_of_another_session(cat):
    """Tables in buckets are known to a session that did not write them."""
    other = Catalog.open(cat.spark.newSession(), cat.root)
    assert other.coloc_groups.count() == cat.coloc_groups.count() and other.by("associations", "variant_id").count() == cat.associations.count()
    ids = cat.genes.filter("id in (2, 3)").select("id")
    assert between_ids(cat.study_extractions, "gene_id", ids, "id").count() == cat.study_extractions.filter("gene_id in (2, 3)").count()
    for bad in ("staging", ""):
        with pytest.raises(ValueError, match="target"):
            Catalog.target(cat.spark, bad)
    with pytest.raises(ValueError, match="spark.lociflow.dev"):
        Catalog.target(cat.spark, "dev")
    cat.spark.conf.set("spark.lociflow.dev", cat.root)
    assert Catalog.target(cat.spark, "dev").traits.count() == cat.traits.count()
    cat.spark.conf.unset("spark.lociflow.dev")


def test_neighbours(cat):
    bundle = lookups.gene(cat, 3, near=5_000_000)
    own = cat.genes.filter("id = 3").first()
    want = {r["id"] for r in cat.genes.filter((F.col("chr") == own["chr"]) & (F.col("id") != 3)).collect()}
    assert {r["id"] for r in bundle.neighbours.collect()} == want
    region = lookups.region(cat, 4)
    assert region.genes_in_region.columns == cat.genes.columns


def test_order_of_arrival(spark, tmp_path):
    """Ordinals are the same however the files are dealt to tasks, so that the first row of a key is."""
    for f in range(5):
        with gzip.open(tmp_path / f"s{f}.tsv.gz", "wt") as out:
            out.write("SNP\tBP\tP\n" + "".join(f"k{i % 7}\t{f * 1000 + i}\t0.5\n" for i in range(100 + f)))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.csv").write_text("x\n" + "".join(f"{i}\n" for i in range(20_000)))
    seen, cut = [], []
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "1k" else "4m")
        try:
            rows = formats.read_stats(spark, str(tmp_path / "*.tsv.gz"), ordered=True)
            assert sorted((r["ord"], r["bp"]) for r in rows.collect()) == list(enumerate(f * 1000 + i for f in range(5) for i in range(100 + f)))
            seen.append(sorted(tuple(r) for r in keep_first(rows, ["snp"], ["ord"]).select("snp", "bp", "ord").collect()))
            plain = formats.arrival(spark.read.option("header", True).schema("x int").csv(str(tmp_path / "plain/a.csv")))
            cut.append(plain.rdd.getNumPartitions())
            assert plain.filter("x <> ord").count() == 0 and plain.count() == 20_000
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == seen[1] and len(seen[0]) == 7


def test_upload_store(spark, tmp_path, cat):
    store = UploadStore(spark, f"file://{tmp_path}/store")
    assert store.records().count() == 0 and store.rows().count() == 0 and store.rows(GUIDS[0]).count() == 0 and store.vacuum() == 0
    raw = spark.createDataFrame([("1", 5, "A", "C", 0.1, 1.0, 1e-9), ("1", 6, "A", "C", 0.1, 1.0, 1e-12), ("2", 6, "A", "C", 0.1, 1.0, 0.5)], "c string, b bigint, x string, y string, e double, s double, p double")
    names = {"CHR": "c", "BP": "b", "EA": "x", "OA": "y", "BETA": "e", "SE": "s", "P": "p"}
    put = lambda frame, guid, **more: store.upload(frame, names, "study", "a@b", 100, guid, is_published=True, doi="10.1/x", should_be_added=True, **more)
    assert put(raw, GUIDS[0]) == GUIDS[0] and put(raw, GUIDS[1]) == GUIDS[1]
    assert re.match(uploads.GUID, put(raw, None))
    for _ in range(2):
        put(raw, GUIDS[0])
    assert store.rows(GUIDS[0]).count() == 2 and store.rows().count() == 6
    record = store.records().filter(F.col("guid") == GUIDS[0]).first()
    assert (record["name"], record["is_published"], record["doi"], record["should_be_added"], record["sample_size"]) == ("study", True, "10.1/x", True, 100)
    bundle = lookups.get_upload(cat, GUIDS[0], store=store, include_associations=True)
    assert [(r["chr"], r["bp"], r["is_lead"]) for r in bundle.upload_study_extractions.collect()] == [("1", 6, True)]
    assert bundle.full_associations.count() == 2 and bundle.subject.first()["doi"] == "10.1/x"
    bad = raw.withColumn("p", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        put(bad, GUIDS[0])
    assert store.rows(GUIDS[0]).count() == 2, "a write that fails leaves the old rows"
    with pytest.raises(ValueError):
        store.upload(raw, {"CHR": "c", "BP": "b", "P": "p"}, "study", "a@b", 100)
    with pytest.raises(ValueError):
        store.write("../x", raw, [])
    assert store.vacuum() >= 2 and store.rows().count() == 6 and store.vacuum() == 0
    assert f"guid={GUIDS[1]}" not in "".join(store.rows(GUIDS[0]).inputFiles())


def test_uploads_written_as_a_stream(spark, tmp_path, cat):
    store = UploadStore(spark, f"file://{tmp_path}/store")
    kind = "guid string, name string, snp string, chr string, bp bigint, ea string, oa string, eaf double, beta double, se double, p double, ld_block bigint"
    rows = spark.createDataFrame([(g, f"n{i}", None, "1", i + j, "A", "C", None, 0.1, 1.0, 10.0 ** -(9 + j), 1) for i, g in enumerate(GUIDS) for j in range(3)] + [(None, "x", None, "1", 1, "A", "C", None, 0.1, 1.0, 1e-9, 1), (GUIDS[0], "n0", None, "1", 1, "A", "C", None, 0.1, 1.0, 0.5, 1)], kind)
    rows.filter("guid <> 'x'").coalesce(1).write.json(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(kind).json(str(tmp_path / "in"))
    ingest.write_uploads(source(), store, "landing", str(tmp_path / "ck")).awaitTermination(120)
    assert store.rows().count() == 12 and store.records().count() == 4
    leads = lookups.get_upload(cat, GUIDS[2], store=store).upload_study_extractions.collect()
    assert [(r["bp"], r["guid"]) for r in leads] == [(4, GUIDS[2])]
    ingest.write_uploads(source(), store, "landing", str(tmp_path / "ck2")).awaitTermination(120)  # the batch runs again
    assert store.rows().count() == 12 and store.vacuum() == 1
