"""Counts that are kept up to date, bundles as JSON, files that a table names."""

import gzip
import json

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lociflow.catalog import Catalog
from lociflow.operators.rollups import METRICS, RollupStore, counts_of, state_of
from lociflow.plans import lookups, search
from lociflow.schemas import SCHEMAS
from lociflow.sources import envelopes, formats

SF = f"{DATA}/sf0.001"
FACTS = ("study_extractions", "coloc_groups", "rare_results")


@pytest.fixture(scope="module")
def cat(spark):
    return Catalog.from_bed(spark, SF)


def test_counts_after_increments(spark, cat, tmp_path):
    store = RollupStore(spark, f"file://{tmp_path}/rollups")
    assert store.counts().count() == 0
    facts = {n: getattr(cat, n) for n in FACTS}
    seen = {n: df.limit(0) for n, df in facts.items()}
    for i, part in enumerate(("trait_id % 3 = 0", "trait_id % 3 < 2", "study_id % 2 = 0")):
        new = {n: df.filter(part) for n, df in facts.items()}
        if i == 2:
            new = {"coloc_groups": new["coloc_groups"]}  # a table alone
        store.add(new)
        seen = {n: seen[n].unionByName(new[n]) if n in new else seen[n] for n in seen}
        want = counts_of(state_of(seen))
        got = store.counts()
        assert got.count() == want.count() > 0 and got.exceptAll(want.select(got.columns)).count() == 0, i
    before = sorted(map(tuple, store.counts().collect()))
    with pytest.raises(Exception, match="broken"):
        store.add({"coloc_groups": facts["coloc_groups"].withColumn("study_id", F.raise_error(F.lit("broken")).cast("bigint"))})
    assert sorted(map(tuple, store.counts().collect())) == before, "a failure leaves the version before it"
    store.add({n: df.filter("trait_id % 3 = 0") for n, df in facts.items()})
    assert sorted(map(tuple, store.counts().collect())) == before, "rows that are there change nothing"


def test_lists_and_searches_read_counts(cat):
    paths = lambda df: {f.split(".parquet/")[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
    assert paths(lookups.all_traits(cat)) == {"traits", "rollups"} and paths(lookups.all_genes(cat)) == {"genes", "rollups"}
    assert not paths(search.search(cat, "brand")) & {*FACTS}
    plain = Catalog(cat.spark, {n: getattr(cat, n) for n in ("traits", *FACTS)})
    a, b = lookups.all_traits(cat), lookups.all_traits(plain)
    assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect())) and set(METRICS) - {"num_rare"} < set(b.columns)


def test_envelopes(spark, cat, tmp_path):
    path = f"file://{tmp_path}/json"
    tables = {"coloc_groups": cat.coloc_groups, "associations": cat.associations.withColumn("trait_id", F.lit(None).cast("bigint"))}
    envelopes.write_envelopes(tables, path, "trait_id", rows=50)
    schemas = {n: SCHEMAS[n] for n in tables}
    (tmp_path / "json/extra.json").write_text("\n".join([
        '{"trait_id": 1, "coloc_groups": [{"coloc_group_id": 1, "min_p": 0.5, "unknown": [1]}]}', '{"coloc_groups": [{"coloc_group_id": "no number"}]}', '{"coloc_groups": ', "", '{"trait_id": 7}', '{"coloc_groups": 5}',
    ]))
    out = envelopes.read_envelopes(spark, path, schemas)
    for n, df in tables.items():
        got = out.tables[n]
        want = df.select(got.columns)
        if n == "coloc_groups":
            got = got.filter("coloc_group_id <> 1 or min_p <> 0.5")
        assert got.schema == SCHEMAS[n] and got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < got.count()
    bad = out.bad.collect()
    assert len(bad) == 3 and all(r["file"].endswith("extra.json") for r in bad) and '{"coloc_groups": ' in {r["text"] for r in bad}
    assert out.tables["coloc_groups"].filter("coloc_group_id = 1 and min_p = 0.5 and study_id is null").count() == 1
    most = max(len(json.loads(line).get("coloc_groups", [])) for f in (tmp_path / "json").glob("part-*") for line in f.read_text().splitlines())
    assert most <= 50


def test_located_files(spark, tmp_path):
    for name, body in (("a_with_lbfs", "SNP\tP\nrs1\t0.5\nrs2\tNA\n"), ("b", "SNP\tP\nrs3\t0.1\n"), ("c", "SNP\tP\nrs9\t0.9\n")):
        with gzip.open(tmp_path / f"{name}.tsv.gz", "wt") as f:
            f.write(body)
    rows = [(1, f"{tmp_path}/a_with_lbfs.tsv.gz", "x"), (2, f"file://{tmp_path}/b.tsv.gz", "y"), (3, f"{tmp_path}/none.tsv.gz", "z"), (4, f"{tmp_path}/no/folder.tsv.gz", "z"), (5, None, "n"), (6, f"{tmp_path}/a_with_lbfs.tsv.gz", "again")]
    table = spark.createDataFrame(rows, "gwas_id int, file string, snp string")
    found, missing = formats.read_located(spark, table, "file")
    assert sorted((r["gwas_id"], r["study_id"], r["snp"], r["p"]) for r in found.collect() if r["p"] is not None) == [(1, "a", "rs1", 0.5), (2, "b", "rs3", 0.1), (6, "a", "rs1", 0.5)] and found.count() == 5
    assert sorted(r["gwas_id"] for r in missing.collect()) == [3, 4, 5]
    none, missing = formats.read_located(spark, table.filter("gwas_id = 3"), "file")
    assert none.count() == 0 and missing.count() == 1


def test_archives(spark, tmp_path):
    """A task a member; what is missing or broken is a row of errors, and other members are read."""
    import zipfile

    from lociflow.sources import archives

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(100):
            z.writestr(f"in/s{i}_with_lbfs.tsv.gz", gzip.compress("".join(["SNP\tBP\tP\textra\n", *(f"1:{j}\t{j}\t{'NA' if j % 2 else 0.5}\tx\n" for j in range(i))]).encode()))
        z.writestr("broken.tsv.gz", gzip.compress(b"SNP\tP\n" + b"rs1\t0.1\n" * 9999)[:-20])
        z.writestr("none.tsv.gz", b"no gzip")
        z.writestr("odd.tsv.gz", gzip.compress(b'snp\tbp\tp\n"q"\tx\tNA\n\t7\t1e-9\n'))
        z.writestr("readme.txt", "no table")
    (tmp_path / "b.zip").write_text("no archive")
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.zip",), (f"{tmp_path}/b.zip",), (f"{tmp_path}/c.zip",), (None,)], "path string")
    out = archives.read_archives(spark, paths)
    assert out.rdd.getNumPartitions() == 105
    rows = out.collect()
    good = [r for r in rows if r["study_id"] and r["study_id"][1:].isdigit()]
    assert sorted((r["study_id"], r["snp"], r["bp"], r["p"]) for r in good) == sorted((f"s{i}", f"1:{j}", j, None if j % 2 else 0.5) for i in range(100) for j in range(i))
    bad = {(r["archive"].rsplit("/", 1)[-1], r["member"]) for r in rows if r["error"]}
    assert bad == {("a.zip", "broken.tsv.gz"), ("a.zip", "none.tsv.gz"), ("b.zip", ""), ("c.zip", "")}
    assert [(r["snp"], r["bp"], r["p"]) for r in rows if r["member"] == "odd.tsv.gz"] == [("q", None, None), ("", 7, 1e-9)]


def test_catalog_from_json(spark, cat, tmp_path):
    path = f"file://{tmp_path}/json"
    names = ("traits", "study_extractions", "coloc_groups", "rare_results", "coloc_pairs", "associations")
    envelopes.write_envelopes({n: getattr(cat, n).withColumn("of", F.lit(1)) for n in names}, path, "of")
    found, bad = Catalog.from_json(spark, path)
    assert bad.count() == 0 and found.traits.exceptAll(cat.traits.select(found.traits.columns)).count() == 0
    a, b = (lookups.trait(c, 5, include_coloc_pairs=True) for c in (found, cat))
    for part in ("subject", "coloc_groups", "rare_results", "study_extractions", "coloc_pairs"):
        x, y = getattr(a, part), getattr(b, part)
        assert sorted(map(str, x.select(sorted(x.columns)).collect())) == sorted(map(str, y.select(sorted(x.columns)).collect())), part


def test_small_members_share_tasks(spark, tmp_path):
    """A task a member, each reading the archive's directory, before: 300 tasks here."""
    import zipfile

    from lociflow.sources import archives

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(300):
            z.writestr(f"{i}_with_lbfs.tsv.gz", b"broken" if i == 7 else gzip.compress(f"SNP\tBP\tSE\n1:{i}\t{i}\tNA\n".encode()))
    out = archives.read_archives(spark, [f"file://{tmp_path}/a.zip"], tasks=20)
    assert out.rdd.getNumPartitions() <= 40
    rows = out.collect()
    assert sorted(int(r["study_id"]) for r in rows) == list(range(300))
    assert all(r["error"] if r["study_id"] == "7" else (r["snp"], r["bp"], r["se"], r["error"]) == (f"1:{r['study_id']}", int(r["study_id"]), None, None) for r in rows)


def test_many_studies_are_written_by_tasks(spark, tmp_path):
    """Ids and cells of any text come back, nothing half-written stays, and a folder of a study has its files alone."""
    path = f"file://{tmp_path}/stats"
    rows = [(f"s{i % 500}", f"1:{i}", i, None if i % 3 else i / 7) for i in range(2000)] + [("a b", 'q"uo\tte', 1, 1e-300), ("a b", "back\\slash", 2, -0.0)]
    formats.write_stats(spark.createDataFrame(rows, "study_id string, snp string, bp bigint, beta double"), path)
    got = sorted((r["study_id"], r["snp"], r["bp"], r["beta"]) for r in formats.read_stats(spark, path).collect())
    assert got == sorted(rows, key=lambda r: r[:3])
    files = [f for f in (tmp_path / "stats").rglob("*") if f.is_file()]
    assert len({f.parent for f in files}) == 501 and all(f.name.startswith("part-") and f.name.endswith(".tsv.gz") for f in files)
