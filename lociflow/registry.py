"""Every query of the engine over the conformance bed, and its oracle as DuckDB SQL written apart from the plan."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalog import Catalog
from .functions import cluster
from .functions.scalars import is_guid, source_url
from .operators import merge
from .operators.intervals import overlaps
from .operators.rollups import KINDS, METRICS, RollupStore
from .plans import analyses as A, lookups as L, search as S
from .schemas import SCHEMAS
from .sources import archives, bed, envelopes, formats, uploads
from .sources.upload_store import UploadStore
from .storage import fresh_path, shared_dir

#: Subjects of the registered queries: ids of the bed.
ANCHOR, OTHER, GENE, VARIANT, BLOCK, GENE_NAME = 5, 55, 3, 7, 4, "Supplier#000000003"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = lambda spark, sf_dir: f(Catalog.from_bed(spark, sf_dir))
        if sql:
            ORACLES[name] = bed.oracle(sql)
        return f

    return add


def _disease(cat: Catalog) -> DataFrame:
    return cat.traits.filter("id % 50 = 0").select(F.col("id").alias("trait_id"))


def _gene_rank(cat: Catalog) -> DataFrame:
    return A.rank_pleiotropy(A.disease_genes(cat.coloc_groups, _disease(cat)), L.gene_pleiotropy(cat))


def _anchored(cat: Catalog, table: str, group: str) -> DataFrame:
    siblings = cat.traits.filter("id % 97 = 0").select(F.col("id").alias("trait_id"))
    seen = L.closure(getattr(cat, table), group, F.col("trait_id") == ANCHOR)
    return A.anchor_filter(seen, group, ANCHOR, siblings)


_COLOC = "coloc_group_id, study_extraction_id, study_id, variant_id, trait_id, gene_id, min_p, cis_trans, data_type, tissue"
_COLS = _COLOC.split(", ")
_FIRST = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id, variant_id ORDER BY ord) AS rn FROM b_associations) x WHERE rn = 1)"


def _anchor_sql(table: str, group: str, name: str, siblings: str = "trait_id % 97 = 0") -> str:
    return f"""{name}_seen AS (SELECT * FROM {table} WHERE {group} IN (SELECT {group} FROM {table} WHERE trait_id = {ANCHOR})),
    {name}_kept AS (SELECT * FROM {name}_seen WHERE NOT ({siblings}) AND min_p < 5.0e-8
      AND {group} NOT IN (SELECT {group} FROM {name}_seen WHERE trait_id = {ANCHOR} AND min_p > 5.0e-8)),
    {name}_a AS (SELECT * FROM {name}_kept WHERE {group} IN (SELECT {group} FROM {name}_kept GROUP BY {group} HAVING count(*) > 1))"""


#: The anchor as one of eleven families of traits, so that many groups hold it.
_FAMILIES = ", ".join(f"{k} AS (SELECT * REPLACE (trait_id % 11 AS trait_id) FROM {t})" for k, t in (("fc", "b_coloc_groups"), ("fr", "b_rare_results")))
_LOCI = ",\n loci AS (" + " UNION ALL ".join(
    f"""SELECT p.display_snp, p.chr, p.bp, p.min_p, n.n_studies, round(-log10(greatest(p.min_p, 2.2250738585072014e-308)), 9) AS neg_log10_p, '{k}' AS variant_type
    FROM (SELECT display_snp, chr, bp, min(min_p) AS min_p FROM {k}_a WHERE trait_id = {ANCHOR} GROUP BY 1, 2, 3) p
    JOIN (SELECT display_snp, chr, bp, count(*) AS n_studies FROM {k}_a GROUP BY 1, 2, 3) n USING (display_snp, chr, bp)""" for k in ("common", "rare")) + ")"  # fmt: skip
_LOCUS = "WITH " + _anchor_sql("b_coloc_groups", "coloc_group_id", "common") + ", " + _anchor_sql("b_rare_results", "rare_result_group_id", "rare") + _LOCI
_WIDE = f"WITH {_FAMILIES}, " + _anchor_sql("fc", "coloc_group_id", "common", "trait_id = 3") + ", " + _anchor_sql("fr", "rare_result_group_id", "rare", "trait_id = 3") + _LOCI


def _wide(cat: Catalog, table: str, group: str) -> DataFrame:
    rows = getattr(cat, table).withColumn("trait_id", F.col("trait_id") % 11)
    return A.anchor_filter(L.closure(rows, group, F.col("trait_id") == ANCHOR), group, ANCHOR, cat.spark.range(3, 4).select(F.col("id").alias("trait_id")))


def _wide_loci(cat: Catalog) -> DataFrame:
    return A.locus_agg(_wide(cat, "coloc_groups", "coloc_group_id"), _wide(cat, "rare_results", "rare_result_group_id"), ANCHOR).withColumn("neg_log10_p", F.round("neg_log10_p", 9))


def locus_agg(cat: Catalog) -> DataFrame:
    return A.locus_agg(_anchored(cat, "coloc_groups", "coloc_group_id"), _anchored(cat, "rare_results", "rare_result_group_id"), ANCHOR).withColumn("neg_log10_p", F.round("neg_log10_p", 9))


@query("SELECT CASE WHEN (SELECT count(*) FROM b_coloc_groups) > 0 AND (SELECT count(*) FROM b_traits) > 0 THEN 'healthy' ELSE 'unhealthy' END AS status")
def q_health(cat):
    return cat.health()


#: One component of each bundle that the queries above it do not check: (query, plan, SQL).
def _component(name: str, plan, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(Catalog.from_bed(spark, sf_dir))
    ORACLES[name] = bed.oracle(sql)


_RARE = "rare_result_group_id, study_extraction_id, study_id, variant_id, trait_id, gene_id, min_p"
_EXT = "id, study_id, variant_id, trait_id, gene_id, min_p, cis_trans, tissue"
_rare = lambda b: b.rare_results.select(_RARE.split(", "))
_ext = lambda b: b.study_extractions.select(_EXT.split(", "))
for _name, _call, _seed in (
    ("trait", lambda cat: L.trait(cat, ANCHOR), f"trait_id = {ANCHOR}"), ("gene", lambda cat: L.gene(cat, GENE), f"gene_id = {GENE}"),
):
    _component(f"{_name}_rare", lambda cat, call=_call: _rare(call(cat)), f"SELECT {_RARE} FROM b_rare_results WHERE rare_result_group_id IN (SELECT rare_result_group_id FROM b_rare_results WHERE {_seed})")
    _component(f"{_name}_extractions", lambda cat, call=_call: _ext(call(cat)), f"SELECT {_EXT} FROM b_study_extractions WHERE {_seed}")
for _name, _call, _seed in (
    ("variant", lambda cat: L.variant(cat, VARIANT, include_coloc_pairs=True, include_summary_stats=True), f"variant_id = {VARIANT}"), ("region", lambda cat: L.region(cat, BLOCK, include_coloc_pairs=True), f"ld_block_id = {BLOCK}"),
):
    _component(f"{_name}_rare", lambda cat, call=_call: _rare(call(cat)), f"SELECT {_RARE} FROM b_rare_results WHERE {_seed}")
    _component(f"{_name}_extractions", lambda cat, call=_call: _ext(call(cat)), f"SELECT {_EXT} FROM b_study_extractions WHERE {_seed}")
    _component(f"{_name}_pairs", lambda cat, call=_call: call(cat).coloc_pairs, f"WITH ids AS (SELECT id FROM b_study_extractions WHERE {_seed}) SELECT DISTINCT * FROM b_coloc_pairs WHERE h4 >= 0.8e0 AND (study_extraction_a_id IN (SELECT id FROM ids) OR study_extraction_b_id IN (SELECT id FROM ids))")
_component("region_coloc", lambda cat: L.region(cat, BLOCK).coloc_groups.select(_COLS), f"SELECT {_COLOC} FROM b_coloc_groups WHERE ld_block_id = {BLOCK}")
_component("region_variants", lambda cat: L.region(cat, BLOCK).variants, f"SELECT * FROM b_variants WHERE ld_block_id = {BLOCK}")
_component("gene_variants", lambda cat: L.gene(cat, GENE).variants, f"SELECT * FROM b_variants WHERE id IN (SELECT variant_id FROM b_study_extractions WHERE gene_id = {GENE})")
_component("variant_summary_stats", lambda cat: L.variant(cat, VARIANT, include_summary_stats=True).summary_stats, f"SELECT * FROM b_summary_stats WHERE study_id IN (SELECT study_id FROM b_study_extractions WHERE variant_id = {VARIANT})")
_component("variants_expanded", lambda cat: L.variants(cat, [VARIANT, 20], expand=True).coloc_groups.select(_COLS), f"SELECT {_COLOC} FROM b_coloc_groups WHERE variant_id IN ({VARIANT}, 20)")
_UPLOAD = """u AS (SELECT c.* FROM b_upload_coloc_groups c JOIN b_uploads b ON c.gwas_upload_id = b.upload_id WHERE b.guid IN (SELECT min(guid) FROM b_uploads)),
    k AS (SELECT DISTINCT coalesce(study_id, existing_study_id) AS s, variant_id AS v FROM u WHERE coalesce(study_id, existing_study_id) IS NOT NULL)"""
_upload = lambda cat, **options: L.get_upload(cat, cat.uploads.agg(F.min("guid")).first()[0], **options)
_RICH = """b.guid IN (SELECT min(x.guid) FROM b_uploads x JOIN b_upload_coloc_groups y ON y.gwas_upload_id = x.upload_id JOIN b_rare_results z
    ON z.study_id = coalesce(y.study_id, y.existing_study_id) AND z.variant_id = y.variant_id)"""


def _rich(cat: Catalog) -> str:
    """The first upload that shares a study and variant with a rare result."""
    rows = cat.upload_coloc_groups.select(F.coalesce("study_id", "existing_study_id").alias("study_id"), "variant_id", F.col("gwas_upload_id").alias("upload_id"))
    return rows.join(cat.rare_results, ["study_id", "variant_id"], "left_semi").join(cat.uploads, "upload_id").agg(F.min("guid")).first()[0]


_component("upload_rare", lambda cat: _rare(L.get_upload(cat, _rich(cat))), f"WITH {_UPLOAD.replace('b.guid IN (SELECT min(guid) FROM b_uploads)', _RICH)} SELECT {_RARE} FROM b_rare_results JOIN k ON study_id = s AND variant_id = v")
_component("upload_extractions", lambda cat: _ext(_upload(cat)), f"WITH {_UPLOAD} SELECT {_EXT} FROM b_study_extractions JOIN k ON study_id = s AND variant_id = v")
_component("upload_summary_stats", lambda cat: _upload(cat, include_summary_stats=True).summary_stats, f"WITH {_UPLOAD} SELECT * FROM b_summary_stats WHERE study_id IN (SELECT s FROM k)")
_component("traits_with_upload", lambda cat: _ext(L.traits(cat, [ANCHOR, cat.uploads.agg(F.min("guid")).first()[0]])), f"WITH {_UPLOAD} SELECT {_EXT} FROM b_study_extractions WHERE trait_id = {ANCHOR} UNION ALL SELECT {_EXT} FROM b_study_extractions JOIN k ON study_id = s AND variant_id = v")


def _scanned(cat: Catalog) -> DataFrame:
    """All statistics, written as `*.tsv.gz` of one study each, and read by the reader of such files."""
    path = f"{shared_dir(cat.spark)}/stats-{uuid.uuid4().hex}"
    formats.write_stats(cat.summary_stats, path)
    return formats.read_stats(cat.spark, path).select(F.col("study_id").cast("bigint").alias("study_id"), "snp", "chr", "bp", "beta", "se", "lbf_1")


_component("sumstats_scan", _scanned, "SELECT study_id, snp, chr, bp, beta, se, lbf_1 FROM b_summary_stats")


def _decoded(cat: Catalog) -> DataFrame:
    """All pairs, packed as columnar JSON of at most 1,000 rows and decoded again."""
    names = ["study_extraction_a_id", "study_extraction_b_id", "h4"]
    rows = cat.coloc_pairs.select(*names, F.floor(F.monotonically_increasing_id() / 1000).alias("pack"))
    packed = rows.groupBy("pack").agg(F.to_json(F.struct(F.array(*map(F.lit, names)).alias("coloc_pair_column_names"), F.collect_list(F.array(*(F.col(n).cast("string") for n in names))).alias("coloc_pair_rows"))).alias("j"))
    return formats.decode_rows(packed, "j", "coloc_pair", SCHEMAS["coloc_pairs"]).select(names)


@query("SELECT study_extraction_a_id, study_extraction_b_id, h4 FROM b_coloc_pairs")
def q_decode_rows(cat):
    return _decoded(cat)


@query("""SELECT t.*, coalesce(e.n, 0) AS num_study_extractions, coalesce(c.n, 0) AS num_coloc_groups, coalesce(c.m, 0) AS num_coloc_studies, coalesce(r.n, 0) AS num_rare_results
    FROM b_traits t LEFT JOIN (SELECT trait_id, count(DISTINCT id) AS n FROM b_study_extractions GROUP BY 1) e ON t.id = e.trait_id
    LEFT JOIN (SELECT trait_id, count(DISTINCT coloc_group_id) AS n, count(DISTINCT study_id) AS m FROM b_coloc_groups GROUP BY 1) c ON t.id = c.trait_id
    LEFT JOIN (SELECT trait_id, count(DISTINCT rare_result_group_id) AS n FROM b_rare_results GROUP BY 1) r ON t.id = r.trait_id""")
def q_all_traits(cat):
    return L.all_traits(cat)


@query("""SELECT t.*, coalesce(e.n, 0) AS num_study_extractions, coalesce(c.n, 0) AS num_coloc_groups, coalesce(c.m, 0) AS num_coloc_studies, coalesce(r.n, 0) AS num_rare_groups
    FROM b_genes t LEFT JOIN (SELECT gene_id, count(DISTINCT id) AS n FROM b_study_extractions GROUP BY 1) e ON t.id = e.gene_id
    LEFT JOIN (SELECT gene_id, count(DISTINCT coloc_group_id) AS n, count(DISTINCT study_id) AS m FROM b_coloc_groups GROUP BY 1) c ON t.id = c.gene_id
    LEFT JOIN (SELECT gene_id, count(DISTINCT rare_result_group_id) AS n FROM b_rare_results GROUP BY 1) r ON t.id = r.gene_id""")
def q_all_genes(cat):
    return L.all_genes(cat)


@query(f"SELECT {_COLOC} FROM b_coloc_groups WHERE coloc_group_id IN (SELECT coloc_group_id FROM b_coloc_groups WHERE trait_id = {ANCHOR})")
def q_trait_closure(cat):
    return L.trait(cat, ANCHOR).coloc_groups.select(_COLS)


@query(f"""WITH ids AS (SELECT id FROM b_study_extractions WHERE trait_id = {ANCHOR})
    SELECT DISTINCT * FROM b_coloc_pairs WHERE h4 >= 0.8e0 AND (study_extraction_a_id IN (SELECT id FROM ids) OR study_extraction_b_id IN (SELECT id FROM ids))""")
def q_trait_coloc_pairs(cat):
    return L.trait(cat, ANCHOR, include_coloc_pairs=True).coloc_pairs


@query(f"SELECT variant_id, study_id, beta, se, p, eaf, imputed FROM b_associations WHERE study_id IN (SELECT study_id FROM b_study_extractions WHERE trait_id = {ANCHOR})")
def q_associations_full(cat):
    return L.trait(cat, ANCHOR, include_full_associations=True).full_associations


@query(f"SELECT DISTINCT {_COLOC} FROM b_coloc_groups WHERE coloc_group_id IN (SELECT coloc_group_id FROM b_coloc_groups WHERE trait_id IN ({ANCHOR}, {OTHER}))")
def q_traits_multi(cat):
    return L.traits(cat, [ANCHOR, OTHER, ANCHOR]).coloc_groups.select(_COLS)


@query(f"""WITH ids AS (SELECT id FROM b_study_extractions WHERE trait_id IN ({ANCHOR}, {OTHER}))
    SELECT DISTINCT * FROM b_coloc_pairs WHERE h4 >= 0.8e0 AND (study_extraction_a_id IN (SELECT id FROM ids) OR study_extraction_b_id IN (SELECT id FROM ids))""")
def q_traits_pairs_union(cat):
    return L.traits(cat, [ANCHOR, OTHER], include_coloc_pairs=True).coloc_pairs


@query(f"SELECT {_COLOC} FROM b_coloc_groups WHERE cis_trans = 'cis' AND coloc_group_id IN (SELECT coloc_group_id FROM b_coloc_groups WHERE gene_id = {GENE})")
def q_gene_closure(cat):
    return L.gene(cat, GENE, include_trans=False).coloc_groups.select(_COLS)


@query(f"SELECT {_COLOC} FROM b_coloc_groups WHERE coloc_group_id IN (SELECT coloc_group_id FROM b_coloc_groups WHERE gene_id = {GENE} OR gene = 'Supplier#000000008')")
def q_genes_multi(cat):
    return L.genes(cat, [GENE, "Supplier#000000008"]).coloc_groups.select(_COLS)


@query(f"WITH {_FIRST} SELECT {', '.join('c.' + c for c in _COLS)}, f.beta, f.se, f.p, f.eaf, f.imputed FROM b_coloc_groups c LEFT JOIN first f ON c.study_id = f.study_id AND c.variant_id = f.variant_id WHERE c.variant_id = {VARIANT}")
def q_variant_lookup(cat):
    return L.variant(cat, VARIANT).coloc_groups.select(*_COLS, "beta", "se", "p", "eaf", "imputed")


@query(f"SELECT * FROM b_variants WHERE id IN ({VARIANT}, 11) OR snp = 'rs20' OR concat(chr, ':', CAST(bp AS varchar(20))) = (SELECT concat(chr, ':', CAST(bp AS varchar(20))) FROM b_variants WHERE id = 31)")
def q_variants_multi(cat):
    place = cat.variants.filter("id = 31").select(F.concat_ws(":", "chr", "bp")).first()
    return L.variants(cat, [VARIANT, "11", "RS20", *([place[0]] if place else [])])


@query("SELECT * FROM b_variants WHERE chr = '5' AND bp BETWEEN 1000 AND 90000")
def q_variants_grange(cat):
    return L.variants_grange(cat, "5", 1000, 90000)


@query(f"SELECT * FROM b_genes WHERE id IN (SELECT gene_id FROM b_study_extractions WHERE ld_block_id = {BLOCK})")
def q_region_lookup(cat):
    return L.genes_with_extractions(cat, BLOCK)


@query(f"""WITH span AS (SELECT chr, min(bp) AS a, max(bp) AS b FROM b_variants WHERE ld_block_id = {BLOCK} GROUP BY 1)
    SELECT g.* FROM b_genes g JOIN span s ON g.chr = s.chr AND g.start_bp <= s.b AND s.a <= g.stop_bp""")
def q_region_genes(cat):
    return L.region(cat, BLOCK).genes_in_region


#: Bases between neighbours in the registered queries.
_NEAR = 20_000


@query(f"""SELECT a.id AS gene_id, b.*, greatest(0, b.start_bp - a.stop_bp, a.start_bp - b.stop_bp) AS distance
    FROM b_genes a JOIN b_genes b ON a.chr = b.chr AND a.id <> b.id AND b.start_bp <= a.stop_bp + {_NEAR} AND b.stop_bp >= greatest(a.start_bp - {_NEAR}, 0)""")
def q_gene_neighbours(cat):
    """Of all genes."""
    return L.gene_neighbours(cat.genes, cat.genes, _NEAR)


@query("SELECT g.id AS gene_id, b.* FROM b_genes g JOIN b_ld_blocks b ON g.chr = b.chr AND g.start_bp <= b.stop_bp AND b.start_bp <= g.stop_bp")
def q_gene_regions(cat):
    """Of all genes."""
    return L.gene_regions(cat.genes, cat.ld_blocks)


@query("""SELECT b.id AS block_id, v.id AS variant_id, g.id AS gene_id FROM b_ld_blocks b JOIN b_genes g ON g.chr = b.chr AND g.start_bp <= b.stop_bp + 200000 AND b.start_bp <= g.stop_bp + 200000
    JOIN b_variants v ON v.chr = b.chr AND v.bp BETWEEN b.start_bp AND b.stop_bp""")
def q_block_overlaps(cat):
    """All blocks with the variants inside them and the genes at most 200,000 bases from them: intervals of very different sizes."""
    places = cat.variants.select("chr", F.col("id").alias("variant_id"), F.col("bp").alias("start_bp"), F.col("bp").alias("stop_bp"))
    wide = cat.genes.withColumns({"start_bp": F.greatest(F.col("start_bp") - 200_000, F.lit(0)), "stop_bp": F.col("stop_bp") + 200_000})
    inside = overlaps(cat.ld_blocks, places).select(F.col("left.id").alias("block_id"), "right.variant_id")
    near = overlaps(cat.ld_blocks, wide).select(F.col("left.id").alias("block_id"), F.col("right.id").alias("gene_id"))
    return inside.join(near, "block_id")


@query("""SELECT 'coloc' AS part, study_extraction_id AS id, trait_id, min_p, tissue, cis_trans FROM b_coloc_groups
    UNION ALL SELECT 'rare', study_extraction_id, trait_id, min_p, tissue, NULL FROM b_rare_results UNION ALL SELECT 'own', id, trait_id, min_p, tissue, cis_trans FROM b_study_extractions""")
def q_bundle_envelopes(cat):
    """The rows of all traits as JSON documents, read again."""
    path, names = fresh_path(cat.spark, "json"), ("coloc_groups", "rare_results", "study_extractions")
    envelopes.write_envelopes({n: cat.narrow(n, *SCHEMAS[n].names) for n in names}, path, "trait_id", compression="gzip")
    t = envelopes.read_envelopes(cat.spark, path, {n: SCHEMAS[n] for n in names}).tables
    part = lambda name, n, c, cis=F.col("cis_trans"): t[n].select(F.lit(name).alias("part"), F.col(c).alias("id"), "trait_id", "min_p", "tissue", cis.cast("string").alias("cis_trans"))
    return part("coloc", "coloc_groups", "study_extraction_id").unionByName(part("rare", "rare_results", "study_extraction_id", F.lit(None))).unionByName(part("own", "study_extractions", "id"))


@query("SELECT s.study_id, g.gene, s.snp, s.bp, s.lbf_1 FROM b_summary_stats s JOIN b_genes g ON s.study_id = g.id")
def q_located_stats(cat):
    """All statistics as files of a study each; those that a table of genes names by the study's folder, one gene's file being missing."""
    path = f"{shared_dir(cat.spark)}/stats-{uuid.uuid4().hex}"
    formats.write_stats(cat.summary_stats, path)
    files = cat.spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", r"study_id=(\d+)", 1).cast("bigint").alias("file_of"))
    named = cat.genes.select("id", "gene").join(files, F.col("id") == F.col("file_of")).select("gene", F.col("path").alias("file"))
    rows, _ = formats.read_located(cat.spark, named.unionByName(named.limit(1).select(F.lit("none").alias("gene"), F.concat("file", F.lit(".none")).alias("file"))), "file")
    return rows.select(F.col("study_id").cast("bigint").alias("study_id"), "gene", "snp", "bp", "lbf_1")


@query("SELECT study_id, snp, chr, bp, beta, se, lbf_1, concat(CAST(study_id AS varchar), '_with_lbfs.tsv.gz') AS member FROM b_summary_stats")
def q_archived_stats(cat):
    """All statistics as zip archives of a member a study, eight archives, read by a task a member."""
    path = fresh_path(cat.spark, "stats")
    formats.write_stats(cat.summary_stats, path)
    files = cat.spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", r"study_id=(\d+)", 1).alias("study"))
    files = files.select((F.col("study").cast("bigint") % 8).alias("archive"), F.concat("study", F.lit("_with_lbfs.tsv.gz")).alias("member"), "path")
    rows = archives.read_archives(cat.spark, archives.write_archives(files, fresh_path(cat.spark, "archives")))
    return rows.select(F.col("study_id").cast("bigint").alias("study_id"), "snp", "chr", "bp", "beta", "se", "lbf_1", "member")


@query("SELECT * FROM b_rollups")
def q_rollups(cat):
    return cat.rollups


@query("SELECT * FROM b_rollups")
def q_rollups_maintained(cat):
    """All rows taken in by three increments, of which the second and third hold rows that came before."""
    store = RollupStore(cat.spark, fresh_path(cat.spark, "rollups"))
    facts = [(n, "id" if n == "study_extractions" else "study_extraction_id", [c for t, c in METRICS.values() if t == n]) for n in ("study_extractions", "coloc_groups", "rare_results")]
    for least, below in ((0, 5), (3, 8), (6, 10)):
        part = lambda df, c, a=least, b=below: df.filter(F.pmod(F.xxhash64(c), F.lit(10)).between(a, b - 1))
        store.add({n: part(cat.keys(n, *{c, *columns}, *KINDS.values()), c) for n, c, columns in facts})
    return store.counts()


@query("SELECT family, kind, subject, grp FROM b_postings")
def q_postings(cat):
    return cat.postings


@query(f"SELECT * FROM b_ld WHERE lead_variant_id IN ({VARIANT}, 20)")
def q_ld_proxies(cat):
    return L.ld_proxies(cat, [VARIANT, "rs20"])


@query(f"SELECT a.* FROM b_ld a WHERE lead_variant_id IN (SELECT id FROM b_variants WHERE ld_block_id = {BLOCK}) AND proxy_variant_id IN (SELECT id FROM b_variants WHERE ld_block_id = {BLOCK})")
def q_ld_matrix(cat):
    return L.ld_matrix(cat, cat.variants.filter(F.col("ld_block_id") == BLOCK).select("id"))


@query("SELECT variant_id, study_id, beta, se, p, eaf, imputed FROM b_associations WHERE variant_id IN (7, 8, 10, 11) AND study_id IN (1, 2, 3)")
def q_associations(cat):
    return L.associations(cat, [7, 8, 10, 11], [1, 2, 3]).drop("ord")


@query("""WITH own AS (SELECT DISTINCT coloc_group_id, gene_id, gene FROM b_coloc_groups WHERE gene_id IS NOT NULL)
    SELECT o.gene_id, o.gene, count(DISTINCT c.trait_category) AS distinct_trait_categories,
           count(DISTINCT CASE WHEN g.gene_biotype = 'protein_coding' AND c.gene_id <> o.gene_id THEN c.gene_id END) AS distinct_protein_coding_genes
    FROM own o JOIN b_coloc_groups c USING (coloc_group_id) LEFT JOIN b_genes g ON c.gene_id = g.id GROUP BY 1, 2""")
def q_gene_pleiotropy(cat):
    return L.gene_pleiotropy(cat)


@query("""SELECT variant_id, display_snp, count(DISTINCT trait_category) AS distinct_trait_categories,
    count(DISTINCT CASE WHEN g.gene_biotype = 'protein_coding' THEN c.gene_id END) AS distinct_protein_coding_genes
    FROM b_coloc_groups c LEFT JOIN b_genes g ON c.gene_id = g.id GROUP BY 1, 2""")
def q_variant_pleiotropy(cat):
    return L.variant_pleiotropy(cat)


@query("SELECT * FROM b_search_terms")
def q_search_terms(cat):
    return cat.search_terms


_COUNTS = """SELECT {k} AS type_id, count(DISTINCT coloc_group_id) AS g, count(DISTINCT study_id) AS s FROM b_coloc_groups GROUP BY 1"""


@query("""WITH c AS (SELECT 'trait' AS type, CAST(trait_id AS varchar) AS type_id, count(DISTINCT coloc_group_id) AS g, count(DISTINCT study_id) AS s FROM b_coloc_groups GROUP BY 1, 2
      UNION ALL SELECT 'gene', gene, count(DISTINCT coloc_group_id), count(DISTINCT study_id) FROM b_coloc_groups GROUP BY 1, 2),
    r AS (SELECT 'trait' AS type, CAST(trait_id AS varchar) AS type_id, count(DISTINCT rare_result_group_id) AS n FROM b_rare_results GROUP BY 1, 2
      UNION ALL SELECT 'gene', gene, count(DISTINCT rare_result_group_id) FROM b_rare_results GROUP BY 1, 2),
    e AS (SELECT 'trait' AS type, CAST(trait_id AS varchar) AS type_id, count(DISTINCT id) AS n FROM b_study_extractions GROUP BY 1, 2
      UNION ALL SELECT 'gene', gene, count(DISTINCT id) FROM b_study_extractions GROUP BY 1, 2)
    SELECT CASE WHEN t.type = 'trait' THEN concat('trait(', t.type_id, ')') ELSE concat('gene(''', t.type_id, ''')') END AS call,
      CASE WHEN alt_name IS NULL THEN name ELSE concat(name, ' (', alt_name, ')') END AS name, t.type, t.type_id, sample_size,
      coalesce(c.g, 0) AS num_coloc_groups, coalesce(c.s, 0) AS num_coloc_studies, coalesce(r.n, 0) AS num_rare_results, coalesce(e.n, 0) AS num_study_extractions
    FROM b_search_terms t LEFT JOIN c ON t.type = c.type AND t.type_id = c.type_id LEFT JOIN r ON t.type = r.type AND t.type_id = r.type_id
    LEFT JOIN e ON t.type = e.type AND t.type_id = e.type_id
    WHERE regexp_matches(lower(name), '(brand#1|0003)') OR coalesce(regexp_matches(lower(alt_name), '(brand#1|0003)'), false)""")
def q_search_text(cat):
    return S.search(cat, "(brand#1|0003)")


@query("""WITH lead AS (SELECT * FROM b_variants WHERE snp = 'rs7'),
    hit AS (SELECT 'original_variant' AS type, display_snp, id, CAST(NULL AS double) AS rsq FROM lead
      UNION SELECT 'proxy_variant', v.display_snp, v.id, round_even(l.r * l.r, 2) FROM b_ld l JOIN lead ON l.lead_variant_id = lead.id JOIN b_variants v ON l.proxy_variant_id = v.id
      WHERE l.r * l.r >= 0.8e0 AND l.lead_variant_id <> l.proxy_variant_id AND v.id IN (SELECT variant_id FROM b_coloc_groups))
    SELECT concat('variant(', CAST(id AS varchar), ')') AS call, display_snp AS name, type, CAST(id AS varchar) AS type_id,
      coalesce(g.a, 0) AS num_coloc_groups, coalesce(g.b, 0) AS num_coloc_studies, coalesce(r.c, 0) AS num_rare_results, CAST(NULL AS bigint) AS num_study_extractions
    FROM hit LEFT JOIN (SELECT variant_id, count(DISTINCT coloc_group_id) AS a, count(*) AS b FROM b_coloc_groups GROUP BY 1) g ON hit.id = g.variant_id
    LEFT JOIN (SELECT variant_id, count(*) AS c FROM b_rare_results GROUP BY 1) r ON hit.id = r.variant_id""")
def q_search_variant(cat):
    return S.search(cat, "rs7")


@query("""SELECT c.coloc_group_id, c.ord, c.gwas_upload_id, c.variant_id FROM b_upload_coloc_groups c JOIN b_uploads u ON c.gwas_upload_id = u.upload_id WHERE u.guid IN (SELECT min(guid) FROM b_uploads)""")
def q_get_upload(cat):
    guid = cat.uploads.agg(F.min("guid")).first()[0]
    return L.get_upload(cat, guid).coloc_groups.select("coloc_group_id", "ord", "gwas_upload_id", "variant_id")


@query("""WITH n AS (SELECT snp, chr, bp, beta, se, lbf_1 AS z, abs(lbf_1) * 1.0e-7 AS p, concat(chr, ':', CAST(bp // 1000000 AS varchar)) AS ld_block FROM b_summary_stats),
    k AS (SELECT *, row_number() OVER (PARTITION BY ld_block ORDER BY p, bp, snp) AS rn FROM n WHERE p <= 5.0e-6)
    SELECT snp, chr, bp, beta, se, p, ld_block, rn = 1 AS is_lead FROM k""")
def q_upload_normalise(cat):
    uploads.check_upload("study", p_value_threshold=5e-6, sample_size=1000, email="a@b")
    raw = cat.summary_stats.withColumn("p", F.abs("lbf_1") * 1e-7)
    names = {"SNP": "snp", "CHR": "chr", "BP": "bp", "BETA": "beta", "SE": "se", "P": "p"}
    return uploads.upload_normalise(raw, names, 5e-6).select("snp", "chr", "bp", "beta", "se", "p", "ld_block", "is_lead")


#: An upload of all statistics whose SNP column is not mapped, and places that many rows share, in the LD blocks that the bed has.
_STAGED = """n AS (SELECT study_id, chr, (bp * 97) % 1000003 // 1000 * 1000 AS bp, beta, se, abs(lbf_1) * 1.0e-7 AS p FROM b_summary_stats),
    k AS (SELECT n.*, b.id AS ld_block FROM n ASOF LEFT JOIN b_ld_blocks b ON n.chr = b.chr AND n.bp >= b.start_bp WHERE p <= 5.0e-6),
    l AS (SELECT *, ld_block IS NOT NULL AND row_number() OVER (PARTITION BY ld_block ORDER BY p, bp, beta, se) = 1 AS is_lead FROM k)"""


def _raw_upload(cat) -> DataFrame:
    place = F.floor(((F.col("bp") * 97) % 1000003) / 1000) * 1000
    return cat.summary_stats.select("chr", place.alias("bp"), F.lit("A").alias("ea"), F.lit("C").alias("oa"), "beta", "se", (F.abs("lbf_1") * 1e-7).alias("p"))


_MAPPED = {"CHR": "chr", "BP": "bp", "EA": "ea", "OA": "oa", "BETA": "beta", "SE": "se", "P": "p"}


@query(f"WITH {_STAGED} SELECT chr, bp, beta, se, p, ld_block, is_lead FROM l")
def q_upload_leads(cat):
    return uploads.upload_normalise(_raw_upload(cat), _MAPPED, 5e-6, blocks=cat.ld_blocks).select("chr", "bp", "beta", "se", "p", "ld_block", "is_lead")


@query(f"WITH {_STAGED} SELECT '0123abcd-0123-4567-89ab-0123456789ab' AS guid, chr, bp, beta, se, p, CAST(ld_block AS varchar) AS ld_block FROM l WHERE is_lead")
def q_upload_fetched(cat):
    """The upload committed to a store, twice, and fetched again by its GUID: its leads."""
    guid, store = "0123abcd-0123-4567-89ab-0123456789ab", UploadStore(cat.spark, fresh_path(cat.spark, "uploads"))
    for _ in range(2):
        store.upload(_raw_upload(cat), _MAPPED, "study", "a@b", 1000, guid, 5e-6, blocks=cat.ld_blocks)
    found = L.get_upload(cat, guid, store=store).upload_study_extractions
    return found.filter(F.col("guid") == guid).select("guid", "chr", "bp", "beta", "se", "p", "ld_block")


@query(f"WITH {_FIRST} SELECT {', '.join('c.' + c for c in _COLS)}, f.beta, f.se, f.p, f.eaf, f.imputed FROM b_coloc_groups c LEFT JOIN first f ON c.study_id = f.study_id AND c.variant_id = f.variant_id")
def q_merge_associations(cat):
    return merge.merge_associations(cat.coloc_groups, cat.associations).select(*_COLS, "beta", "se", "p", "eaf", "imputed")


@query(f"""WITH {_FIRST} SELECT c.coloc_group_id, c.gwas_upload_id, c.study_id, c.existing_study_id, c.variant_id, c.trait_id, c.ord, f.beta, f.se, f.p, f.eaf, f.imputed
    FROM b_upload_coloc_groups c LEFT JOIN first f ON coalesce(c.study_id, c.existing_study_id) = f.study_id AND c.variant_id = f.variant_id""")
def q_merge_upload_assoc(cat):
    return merge.merge_upload_associations(cat.upload_coloc_groups, cat.associations.withColumn("existing_study_id", F.col("study_id")))


@query(f"SELECT coloc_group_id, trait_id, variant_id, CAST(NULL AS bigint) AS gwas_upload_id FROM b_coloc_groups WHERE trait_id = {ANCHOR} UNION ALL SELECT coloc_group_id, trait_id, variant_id, gwas_upload_id FROM b_upload_coloc_groups WHERE trait_id = {ANCHOR}")
def q_merge_trait_result(cat):
    own, up = (t.filter(F.col("trait_id") == ANCHOR) for t in (cat.coloc_groups, cat.upload_coloc_groups))
    return merge.merge_trait_result(own.select("coloc_group_id", "trait_id", "variant_id"), up.select("coloc_group_id", "trait_id", "variant_id", "gwas_upload_id"))


@query("SELECT guid, regexp_matches(guid, '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$') AS ok, false AS ok_name FROM b_uploads")
def q_is_guid(cat):
    return cat.uploads.select("guid", is_guid(F.col("guid")).alias("ok"), is_guid(F.col("name")).alias("ok_name"))


@query("SELECT guid, concat('data:/', regexp_extract(guid, '^([^-]*-[^-]*-[^-]*)', 1), replace(regexp_extract(guid, '^[^-]*-[^-]*-[^-]*(.*)$', 1), '-', '_')) AS url FROM b_uploads")
def q_source_url(cat):
    return cat.uploads.select("guid", source_url(F.col("guid"), "data:/").alias("url"))


@query("""WITH c AS (SELECT DISTINCT study_extraction_id AS id FROM b_coloc_groups), r AS (SELECT DISTINCT study_extraction_id AS id FROM b_rare_results), s AS (SELECT DISTINCT id FROM b_study_extractions)
    SELECT 'coloc_groups' AS source, count(*) AS n_extractions FROM c UNION ALL SELECT 'rare_results', count(*) FROM r
    UNION ALL SELECT 'study_extractions_only', count(*) FROM (SELECT id FROM s EXCEPT SELECT id FROM c EXCEPT SELECT id FROM r) UNION ALL SELECT 'study_extractions', count(*) FROM s""")
def q_extraction_membership(cat):
    return A.extraction_membership(cat.coloc_groups, cat.rare_results, cat.study_extractions)


@query(f"WITH c AS (SELECT * FROM b_coloc_groups WHERE cis_trans = 'cis') SELECT {_COLOC} FROM c WHERE coloc_group_id IN (SELECT coloc_group_id FROM c GROUP BY 1 HAVING count(*) > 1)")
def q_cis_nonsolo(cat):
    return A.cis_nonsolo(cat.coloc_groups).select(_COLS)


@query("""SELECT p.*, a.trait_name AS trait_name_a, a.data_type AS data_type_a, a.tissue AS tissue_a, b.trait_name AS trait_name_b, b.data_type AS data_type_b, b.tissue AS tissue_b
    FROM b_coloc_pairs p LEFT JOIN b_study_extractions a ON p.study_extraction_a_id = a.id LEFT JOIN b_study_extractions b ON p.study_extraction_b_id = b.id WHERE p.h4 >= 0.8e0""")
def q_hydrate_pairs(cat):
    return A.hydrate_pairs(cat.coloc_pairs.filter("h4 >= 0.8"), cat.study_extractions)


_DISEASE = """hit AS (SELECT DISTINCT coloc_group_id FROM b_coloc_groups WHERE trait_id % 50 = 0),
    dis AS (SELECT DISTINCT gene_id, gene FROM b_coloc_groups WHERE coloc_group_id IN (SELECT * FROM hit) AND NOT coalesce(regexp_matches(lower(data_type), 'methyl'), false) AND gene_id IS NOT NULL),
    own AS (SELECT DISTINCT coloc_group_id, gene_id FROM b_coloc_groups WHERE gene_id IS NOT NULL),
    pleio AS (SELECT o.gene_id, count(DISTINCT c.trait_category) AS distinct_trait_categories, count(DISTINCT CASE WHEN g.gene_biotype = 'protein_coding' AND c.gene_id <> o.gene_id THEN c.gene_id END) AS distinct_protein_coding_genes
      FROM own o JOIN b_coloc_groups c USING (coloc_group_id) LEFT JOIN b_genes g ON c.gene_id = g.id GROUP BY 1),
    ranked AS (SELECT dis.gene_id, dis.gene, distinct_trait_categories, distinct_protein_coding_genes FROM dis JOIN pleio USING (gene_id)),
    best AS (SELECT * FROM ranked ORDER BY distinct_trait_categories, gene_id LIMIT 40),
    ev AS (SELECT b.gene, b.distinct_trait_categories, b.distinct_protein_coding_genes,
      (SELECT count(DISTINCT tissue) FROM b_coloc_groups c WHERE c.coloc_group_id IN (SELECT coloc_group_id FROM own WHERE own.gene_id = b.gene_id)) AS n_tissues,
      (SELECT count(DISTINCT c.coloc_group_id) FROM b_coloc_groups c WHERE c.trait_id % 50 = 0 AND c.coloc_group_id IN (SELECT coloc_group_id FROM own WHERE own.gene_id = b.gene_id)) AS n_coloc_groups,
      (SELECT count(DISTINCT c.rare_result_group_id) FROM b_rare_results c WHERE c.trait_id % 50 = 0 AND c.rare_result_group_id IN (SELECT rare_result_group_id FROM b_rare_results r WHERE r.gene_id = b.gene_id)) AS n_rare_groups
      FROM best b)"""


@query(f"WITH {_DISEASE} SELECT * FROM dis")
def q_disease_genes(cat):
    return A.disease_genes(cat.narrow("coloc_groups", "coloc_group_id", "trait_id", "data_type", "gene_id", "gene"), _disease(cat))


@query(f"WITH {_DISEASE} SELECT * FROM ranked")
def q_rank_pleiotropy(cat):
    return _gene_rank(cat)


def _evidence(cat):
    return A.gene_evidence(_gene_rank(cat), cat.coloc_groups, cat.rare_results, _disease(cat))


@query(f"WITH {_DISEASE} SELECT * FROM ev")
def q_gene_evidence(cat):
    return _evidence(cat)


@query(f"""WITH {_DISEASE} SELECT gene, 'Trait categories' AS metric, CAST(distinct_trait_categories AS double) AS value, 1 AS metric_ord FROM ev
    UNION ALL SELECT gene, 'Protein-coding genes', distinct_protein_coding_genes, 2 FROM ev UNION ALL SELECT gene, 'Distinct tissues', n_tissues, 3 FROM ev
    UNION ALL SELECT gene, 'Colocalization groups', n_coloc_groups, 4 FROM ev UNION ALL SELECT gene, 'Rare result groups', n_rare_groups, 5 FROM ev""")
def q_evidence_long(cat):
    return A.evidence_long(_evidence(cat))


_GENE_GROUPS = f"""WITH c AS (SELECT * FROM b_coloc_groups WHERE coloc_group_id IN (SELECT coloc_group_id FROM b_coloc_groups WHERE gene_id = {GENE})),
    r AS (SELECT * FROM b_rare_results WHERE rare_result_group_id IN (SELECT rare_result_group_id FROM b_rare_results WHERE gene_id = {GENE})),
    gg AS (SELECT coloc_group_id AS group_id, study_extraction_id, study_id, variant_id, trait_id, trait_name, data_type, tissue, display_snp, 'coloc' AS kind FROM c WHERE coloc_group_id IN (SELECT coloc_group_id FROM c WHERE trait_id % 50 = 0)
      UNION ALL SELECT rare_result_group_id, study_extraction_id, study_id, variant_id, trait_id, trait_name, data_type, tissue, display_snp, 'rare' FROM r WHERE rare_result_group_id IN (SELECT rare_result_group_id FROM r WHERE trait_id % 50 = 0)),
    {_FIRST}, fr AS (SELECT gg.*, f.beta, f.se, f.eaf FROM gg LEFT JOIN first f ON gg.study_id = f.study_id AND gg.variant_id = f.variant_id),
    maf AS (SELECT variant_id, min(least(eaf, 1 - eaf)) AS maf FROM fr WHERE eaf IS NOT NULL GROUP BY 1)"""


def _gene_groups(cat, associations=False):
    g = L.gene(cat, GENE, include_associations=associations)
    return A.gene_disease_groups(g.coloc_groups, g.rare_results, _disease(cat))


@query(_GENE_GROUPS + " SELECT group_id, study_extraction_id, trait_id, kind FROM gg")
def q_gene_disease_groups(cat):
    return _gene_groups(cat).select("group_id", "study_extraction_id", "trait_id", "kind")


@query("WITH m AS (SELECT variant_id, min(least(eaf, 1 - eaf)) AS maf FROM b_associations WHERE eaf IS NOT NULL GROUP BY 1) SELECT variant_id, round(maf, 9) AS maf FROM m")
def q_variant_maf(cat):
    return A.variant_maf(cat.associations).withColumn("maf", F.round("maf", 9))


@query(_GENE_GROUPS + """ SELECT group_id, study_extraction_id, kind, round(beta - 1.96e0 * se, 9) AS lo, round(beta + 1.96e0 * se, 9) AS hi,
    CASE WHEN length(raw) > 50 THEN concat(substr(raw, 1, 47), '...') ELSE raw END AS row_label,
    concat(coalesce(display_snp, concat('variant ', CAST(variant_id AS varchar))), CASE WHEN maf IS NULL THEN '' ELSE printf(' (MAF=%.3f)', maf) END) AS panel_id, data_type AS data_type_label,
    row_number() OVER (PARTITION BY group_id ORDER BY beta, study_extraction_id) AS row_ord
    FROM (SELECT fr.*, maf.maf, concat(coalesce(trait_name, 'NA'), ' — ', coalesce(data_type, 'NA'), ' — ', coalesce(tissue, '')) AS raw FROM fr LEFT JOIN maf USING (variant_id) WHERE beta IS NOT NULL AND se > 0) x""")
def q_forest_frame(cat):
    return A.forest_frame(_gene_groups(cat, True)).select("group_id", "study_extraction_id", "kind", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "row_label", "panel_id", "data_type_label", "row_ord")


@query("WITH " + _anchor_sql("b_coloc_groups", "coloc_group_id", "common") + f" SELECT {_COLOC} FROM common_a")
def q_anchor_filter(cat):
    return _anchored(cat, "coloc_groups", "coloc_group_id").select(_COLS)


@query(_WIDE + " SELECT coloc_group_id, study_extraction_id, trait_id, min_p FROM common_a")
def q_anchor_filter_families(cat):
    return _wide(cat, "coloc_groups", "coloc_group_id").select("coloc_group_id", "study_extraction_id", "trait_id", "min_p")


@query(_WIDE + " SELECT * FROM loci")
def q_locus_agg_families(cat):
    return _wide_loci(cat)


@query(_LOCUS + " SELECT * FROM loci")
def q_locus_agg(cat):
    return locus_agg(cat)


_OFFSETS = """lens AS (SELECT chr AS chr_lab, max(stop_bp) AS chr_len, CASE WHEN chr = 'X' THEN 23 WHEN chr = 'Y' THEN 24 WHEN CAST(chr AS int) <= 22 THEN CAST(chr AS int) ELSE 999 END AS ord FROM b_genes GROUP BY chr),
    offs AS (SELECT chr_lab, chr_len, ord, CAST(coalesce(sum(chr_len) OVER (ORDER BY ord, chr_lab ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS "offset" FROM lens)"""


@query(f"WITH {_OFFSETS} SELECT * FROM offs")
def q_chr_offsets(cat):
    return A.chr_offsets(cat.genes)


@query(_LOCUS + f", {_OFFSETS} " + """SELECT l.display_snp, l.chr, l.bp, l.variant_type, round((l.bp + o."offset") / 1.0e6, 9) AS x_mbp, round((o."offset" + o.chr_len / 2.0e0) / 1.0e6, 9) AS x_mbp_mid FROM loci l LEFT JOIN offs o ON l.chr = o.chr_lab""")
def q_genome_positions(cat):
    return A.genome_positions(locus_agg(cat), A.chr_offsets(cat.genes)).select("display_snp", "chr", "bp", "variant_type", F.round("x_mbp", 9).alias("x_mbp"), F.round("x_mbp_mid", 9).alias("x_mbp_mid"))


@query(_WIDE + f", {_OFFSETS} " + """SELECT l.display_snp, l.chr, l.bp, l.variant_type, round((l.bp + o."offset") / 1.0e6, 9) AS x_mbp FROM loci l LEFT JOIN offs o ON l.chr = o.chr_lab""")
def q_genome_positions_families(cat):
    return A.genome_positions(_wide_loci(cat), A.chr_offsets(cat.genes)).select("display_snp", "chr", "bp", "variant_type", F.round("x_mbp", 9).alias("x_mbp"))


_PROP = f"""WITH n AS (SELECT trait_id, count(*) AS n_colocs FROM b_coloc_groups GROUP BY 1),
    meta AS (SELECT DISTINCT trait_id, trait_name, data_type, trait_category FROM b_coloc_groups WHERE data_type IN ('Cell Trait', 'Plasma Protein', 'Phenotype')),
    hits AS (SELECT trait_id, count(DISTINCT id) AS n_studyhits FROM b_study_extractions GROUP BY 1),
    prop AS (SELECT *, n_colocs / CAST(n_studyhits AS double) * 100 AS prop_colocing_hits, CASE WHEN n_colocs > 20 THEN '(20,∞)' WHEN n_colocs > 10 THEN '(10,20]' WHEN n_colocs > 5 THEN '(5,10]' WHEN n_colocs > 1 THEN '(1,5]' END AS colocs_cut
      FROM n JOIN meta USING (trait_id) JOIN hits USING (trait_id) WHERE trait_id <> {ANCHOR} AND n_colocs > 1 AND trait_category IS NOT NULL AND n_studyhits > 0)"""


def _proportion(cat):
    rows = cat.narrow("coloc_groups", "trait_id", "trait_name", "data_type", "trait_category")
    return A.category_proportion(rows, L.all_traits(cat), ANCHOR)


@query(_PROP + """ SELECT trait_id, n_colocs, n_studyhits, trait_category, round(prop_colocing_hits, 9) AS prop_colocing_hits, colocs_cut,
    CASE WHEN (prop_colocing_hits = max(prop_colocing_hits) OVER (PARTITION BY trait_category) AND prop_colocing_hits > 10) OR prop_colocing_hits > 25 THEN trait_name END AS label FROM prop""")
def q_category_proportion(cat):
    return _proportion(cat).select("trait_id", "n_colocs", "n_studyhits", "trait_category", F.round("prop_colocing_hits", 9).alias("prop_colocing_hits"), "colocs_cut", F.regexp_replace("label", "\n", " ").alias("label"))


@query(f"""SELECT coloc_group_id, count(DISTINCT coalesce(data_type, '?')) AS n_data_types FROM b_coloc_groups
    WHERE coloc_group_id IN (SELECT coloc_group_id FROM b_coloc_groups WHERE gene = '{GENE_NAME}') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def q_richest_group(cat):
    return A.richest_group(cat.coloc_groups, GENE_NAME)


@query("WITH s AS (SELECT *, lbf_1 / max(abs(lbf_1)) OVER (PARTITION BY study_id) AS x FROM b_summary_stats WHERE se <> 1) SELECT study_id, snp, bp, round(x, 9) AS scaled_lbf FROM s WHERE bp BETWEEN 100 AND 800")
def q_scaled_lbf(cat):
    return A.scaled_lbf(cat.summary_stats, 100, 800).select("study_id", "snp", "bp", F.round("scaled_lbf", 9).alias("scaled_lbf"))


@query("""SELECT s.study_id, s.snp, round(-s.beta, 9) AS beta_alt, m.trait_id, CASE WHEN m.data_type IS NULL THEN NULL WHEN m.data_type <> 'Phenotype' THEN 'Molecular' ELSE m.trait_category END AS trait_category
    FROM b_summary_stats s LEFT JOIN (SELECT DISTINCT study_id, trait_id, data_type, trait_category FROM b_coloc_groups WHERE variant_id = 7) m ON s.study_id = m.study_id WHERE s.snp LIKE '7:%'""")
def q_betas_at_snp(cat):
    meta = cat.coloc_groups.filter("variant_id = 7").select("study_id", "trait_id", "data_type", "trait_category").distinct()
    return A.betas_at_snp(cat.summary_stats, "7:", meta).select("study_id", "snp", F.round("beta_alt", 9).alias("beta_alt"), "trait_id", "trait_category")


_DEDUPE = _PROP + ", cut AS (SELECT *, regexp_replace(trait_name, ' \\(.*\\)', '') AS name_cut FROM prop), ded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name_cut ORDER BY n_studyhits DESC, trait_id) AS rn FROM cut) x WHERE rn = 1)"


@query(_DEDUPE + " SELECT trait_id, name_cut, n_studyhits FROM ded")
def q_dedupe_traits(cat):
    return A.dedupe_traits(_proportion(cat)).select("trait_id", "name_cut", "n_studyhits")


_SHARED = "WITH m AS (SELECT DISTINCT coloc_group_id, trait_id FROM b_coloc_groups), sh AS (SELECT a.trait_id AS trait1, b.trait_id AS trait2, count(*) AS shared_colocs FROM m a JOIN m b USING (coloc_group_id) GROUP BY 1, 2)"


@query(_SHARED + " SELECT * FROM sh")
def q_shared_groups(cat):
    return A.shared_groups(cat.coloc_groups)


@query(_SHARED + " SELECT trait1, trait2, shared_colocs, round(log10(shared_colocs), 9) AS log_coloc_hits FROM sh")
def q_shared_groups_log(cat):
    return A.shared_groups_log(A.shared_groups(cat.coloc_groups)).withColumn("log_coloc_hits", F.round("log_coloc_hits", 9))


def _clusters(cat):
    """All traits that dedupe_traits leaves, by the groups that they share."""
    keep = A.dedupe_traits(_proportion(cat)).select("trait_id")
    return cluster.trait_clusters(cat.spark, A.shared_groups(cat.keys("coloc_groups", "coloc_group_id", "trait_id").join(keep, "trait_id", "left_semi")), 10)


@query()
def q_trait_clusters(cat):
    return _clusters(cat)


@query()
def q_cluster_summary(cat):
    return A.cluster_summary(F.broadcast(_clusters(cat)), cat.traits)  # a row a clustered trait, whose number the matrix bounds; else all names may be broadcast


@query("""SELECT cluster_id, CASE WHEN length(x) > 500 THEN concat(substr(x, 1, 497), '...') ELSE x END AS traits, n_traits
    FROM (SELECT id % 7 AS cluster_id, string_agg(trait_name, ', ' ORDER BY id) AS x, count(*) AS n_traits FROM b_traits GROUP BY 1
      UNION ALL SELECT 1000 + id, trait_name, 1 FROM b_traits) y""")
def q_cluster_names(cat):
    """Summaries of given clusters of all traits: seven large ones, and each trait by itself."""
    given = cat.traits.select(F.col("id").alias("trait_id"), (F.col("id") % 7).alias("cluster_id")).unionByName(cat.traits.select(F.col("id").alias("trait_id"), (1000 + F.col("id")).alias("cluster_id")))
    return A.cluster_summary(given, cat.traits)


_PAIR = f"""{_FIRST}, rows_ AS (SELECT c.*, f.beta, f.se FROM b_coloc_groups c LEFT JOIN first f ON c.study_id = f.study_id AND c.variant_id = f.variant_id)"""
_SIDES = f"""{_PAIR}, side AS (SELECT *, CASE WHEN gene_id % 2 = 0 THEN 1 ELSE 2 END AS tid FROM rows_),
    bth AS (SELECT * FROM side WHERE coloc_group_id IN (SELECT coloc_group_id FROM side WHERE tid = 1) AND coloc_group_id IN (SELECT coloc_group_id FROM side WHERE tid = 2)),
    clean AS (SELECT * FROM bth WHERE coloc_group_id NOT IN (SELECT coloc_group_id FROM bth WHERE se IS NULL OR se = 1)),
    leads AS (SELECT *, CAST(coloc_group_id AS varchar) AS group_id, CASE tid WHEN 1 THEN 'left' ELSE 'right' END AS side FROM
      (SELECT *, row_number() OVER (PARTITION BY coloc_group_id, tid ORDER BY min_p, study_extraction_id) AS rn FROM clean WHERE beta IS NOT NULL AND se > 0 AND min_p IS NOT NULL) x WHERE rn = 1),
    two AS (SELECT group_id FROM leads GROUP BY 1 HAVING count(*) = 2 ORDER BY group_id LIMIT 5)"""


def _leads(cat):
    """Two traits as genes of even and odd id, so that many groups hold both."""
    rows = merge.merge_associations(cat.coloc_groups, cat.associations)
    return A.compare_leads(rows.withColumn("trait_id", F.when(F.col("gene_id") % 2 == 0, 1).otherwise(2)), 1, 2)


@query(f"WITH {_SIDES} SELECT group_id, side, study_extraction_id, min_p FROM leads")
def q_compare_leads(cat):
    return _leads(cat).select("group_id", "side", "study_extraction_id", "min_p")


@query(f"WITH {_SIDES} SELECT group_id, side, study_extraction_id FROM leads WHERE group_id IN (SELECT group_id FROM two)")
def q_both_sides(cat):
    return A.both_sides(_leads(cat)).select("group_id", "side", "study_extraction_id")


@query("""WITH f AS (SELECT gene_id AS group_id, display_snp, min(study_extraction_id) AS o FROM b_coloc_groups WHERE display_snp IS NOT NULL GROUP BY 1, 2)
    SELECT g.group_id, coalesce(string_agg(f.display_snp, ' · ' ORDER BY f.o), CAST(g.group_id AS varchar)) AS strip_lbl
    FROM (SELECT DISTINCT gene_id AS group_id FROM b_coloc_groups) g LEFT JOIN f ON g.group_id = f.group_id GROUP BY g.group_id""")
def q_strip_labels(cat):
    return A.strip_labels(cat.coloc_groups.withColumn("group_id", F.col("gene_id")))


@query(f"""WITH {_PAIR}, cov AS (SELECT DISTINCT ld_block_id FROM b_coloc_groups WHERE trait_id = {ANCHOR}),
    sig AS (SELECT DISTINCT ld_block_id FROM b_coloc_pairs WHERE h4 > 0.8e0 AND ld_block_id NOT IN (SELECT ld_block_id FROM cov))
    SELECT ld_block_id, study_extraction_id, min_p FROM (SELECT *, row_number() OVER (PARTITION BY ld_block_id ORDER BY min_p, study_extraction_id) AS rn
      FROM rows_ WHERE ld_block_id IN (SELECT ld_block_id FROM sig) AND beta IS NOT NULL AND se > 0 AND min_p IS NOT NULL) x WHERE rn = 1""")
def q_pair_only_loci(cat):
    rows = merge.merge_associations(cat.coloc_groups, cat.associations)
    return A.pair_only_loci(cat.coloc_pairs, cat.coloc_groups.filter(F.col("trait_id") == ANCHOR), rows).select("ld_block_id", "study_extraction_id", "min_p")


@query("SELECT study_extraction_a_id, study_extraction_b_id, ld_block_id, h3, h4, spurious FROM b_coloc_pairs WHERE h4 > 0.8e0 ORDER BY 1, 2 LIMIT 20")
def q_pairs_top(cat):
    return A.pairs_top(cat.coloc_pairs, ["study_extraction_a_id", "study_extraction_b_id", "ld_block_id", "h3", "h4", "false_positive", "spurious"])
