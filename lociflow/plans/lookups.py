"""Lookups by trait, gene, variant, region and upload.

The evaluating service is not public; group closure (a result holds every row of every group that the subject is in), h4 >=
threshold and inclusive ranges are this engine's reading of its documentation. Members of a bundle are lazy and independent.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from types import FunctionType

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import Catalog
from ..functions.scalars import GUID
from ..operators.intervals import overlaps
from ..operators.merge import merge_associations, merge_trait_result, merge_upload_associations
from ..operators.ops import between_ids, closure, null_safe_join, union_fill
from ..schemas import SCHEMAS
from ..sources.upload_store import UploadStore

H4 = 0.8
#: Bases between a gene and its neighbours at most.
NEAR = 1_000_000
#: Group tables with the name of their posting lists.
_GROUPS = {"coloc_groups": ("coloc", "coloc_group_id"), "rare_results": ("rare", "rare_result_group_id")}


@dataclass(frozen=True)
class Bundle:
    """One metadata frame and the components that were asked for.

    A component may be given as a function without arguments; it is called when the component is first read, so that a component
    that nobody reads opens no table.
    """

    subject: DataFrame
    coloc_groups: DataFrame | None = None
    rare_results: DataFrame | None = None
    study_extractions: DataFrame | None = None
    variants: DataFrame | None = None
    full_associations: DataFrame | None = None
    upload_study_extractions: DataFrame | None = None
    coloc_pairs: DataFrame | None = None
    genes_in_region: DataFrame | None = None
    summary_stats: DataFrame | None = None
    regions: DataFrame | None = None
    neighbours: DataFrame | None = None

    def __getattribute__(self, name: str):
        value = object.__getattribute__(self, name)
        if isinstance(value, FunctionType):
            value = value()
            object.__setattr__(self, name, value)
        return value


def _ids(values: Sequence, most: int, what: str) -> list:
    """Required, no null, at most `most` counted before repeats go."""
    values = [values] if isinstance(values, (str, int)) else list(values or [])
    if not values or any(v is None for v in values):
        raise ValueError(f"{what}: at least one id, none of them null")
    if len(values) > most:
        raise ValueError(f"{what}: at most {most} ids")
    return list(dict.fromkeys(values))


def all_traits(cat: Catalog) -> DataFrame:
    return _rollup(cat, cat.traits, "trait", "num_rare_results")


def all_genes(cat: Catalog) -> DataFrame:
    return _rollup(cat, cat.genes, "gene", "num_rare_groups")


def _rollup(cat: Catalog, base: DataFrame, kind: str, rare: str) -> DataFrame:
    """The table with its subjects' counts, 0 where there is nothing to count; no fact table is read if the counts are stored."""
    counts = cat.counts_for(kind).drop("kind").withColumnRenamed("num_rare", rare)
    out = base.join(counts, F.col("id").cast("string") == F.col("subject"), "left").drop("subject")
    return out.fillna(0, [c for c in counts.columns if c != "subject"])


def coloc_pairs_of(cat: Catalog, extraction_ids: DataFrame, h4_threshold: float = H4) -> DataFrame:
    """Pairs where either side is one of the extractions (a column `id`) and h4 reaches the threshold; distinct."""
    ids = extraction_ids.select(F.col("id").alias("_id")).distinct()
    pairs = cat.narrow("coloc_pairs", *SCHEMAS["coloc_pairs"].names).filter(F.col("h4") >= h4_threshold)
    sides = pairs.withColumn("_id", F.explode(F.array("study_extraction_a_id", "study_extraction_b_id")))
    return sides.join(ids, "_id", "left_semi").drop("_id").distinct()


def associations_full(cat: Catalog, trait_ids: Sequence[int]) -> DataFrame:
    """All association rows of the traits' studies."""
    studies = cat.narrow("study_extractions", "trait_id", "study_id").filter(F.col("trait_id").isin(list(trait_ids))).select("study_id").distinct()
    return cat.associations.join(studies, "study_id", "left_semi").select("variant_id", "study_id", "beta", "se", "p", "eaf", "imputed")


def associations(cat: Catalog, variant_ids: Sequence[int], study_ids: Sequence[int]) -> DataFrame:
    """Every (variant, study) of the two sets, not pairwise."""
    return cat.associations.filter(F.col("variant_id").isin(list(variant_ids)) & F.col("study_id").isin(list(study_ids)))


def group_closure(cat: Catalog, table: str, kind: str, ids: Sequence[int] | DataFrame, seed: Column) -> DataFrame:
    """All rows of every group that a subject is in: of a trait, gene or variant (`kind`) by its id, in a list or the column `id`.

    The groups come from the posting lists, which are in the order of subjects; the table is in buckets of its groups, so that its rows are
    not shuffled. A catalog without posting lists looks for the groups of the rows that satisfy `seed`.
    """
    family, group = _GROUPS[table]
    if not cat.has_postings:
        return closure(getattr(cat, table), group, seed)
    lists = cat.postings.filter((F.col("family") == family) & (F.col("kind") == kind))
    lists = between_ids(lists, "subject", ids, "id") if isinstance(ids, DataFrame) else lists.filter(F.col("subject").isin(list(ids)))
    found = lists.select(F.col("grp").alias("_g")).distinct()
    return getattr(cat, table).join(found, F.col(group) == F.col("_g"), "left_semi")


def merged_closure(cat: Catalog, table: str, kind: str, ids: Sequence[int] | DataFrame, seed: Column, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """`group_closure` with the rows' associations. Where the group table is not stored, it and the associations are not stored for it: the
    subject's groups, their rows and the merged rows are settled one after the other, and each is looked for in the stored rows."""
    if cat.is_stored(table):
        return merge_associations(cut(group_closure(cat, table, kind, ids, seed)), cat.associations, keys_first=True)
    group, subject = _GROUPS[table][1], f"{kind}_id"
    rows = cat.keys(table, group, subject).filter(F.col(group).isNotNull())
    rows = rows.join(ids.select(F.col("id").alias("_id")), F.col(subject) == F.col("_id"), "left_semi") if isinstance(ids, DataFrame) else rows.filter(F.col(subject).isin(list(ids)))
    found = cat.settled(rows.select(F.col(group).alias("_g")).distinct())
    whole = cat.narrow(table, *SCHEMAS[table].names)
    rows = cat.settled(cut(whole.join(found, F.col(group) == F.col("_g"), "left_semi")))
    return cat.settled(merge_associations(rows, cat.narrow("associations", *SCHEMAS["associations"].names), keys_first=True))


def _bundle(cat: Catalog, subject: DataFrame, kind: str, ids: Sequence[int] | DataFrame, seed: Column, own: Callable[[], DataFrame], keys: Callable[[], DataFrame], include_associations: bool, include_coloc_pairs: bool, h4: float, row_filter: Column | None = None, **more) -> Bundle:
    cut = lambda df: df if row_filter is None else df.filter(row_filter)
    closed = merged_closure if include_associations else lambda cat, table, kind, ids, seed, cut=lambda df: df: cut(group_closure(cat, table, kind, ids, seed))
    coloc, rare = lambda: closed(cat, "coloc_groups", kind, ids, seed, cut), lambda: closed(cat, "rare_results", kind, ids, seed)
    pairs = (lambda: coloc_pairs_of(cat, cut(keys()), h4)) if include_coloc_pairs else None
    return Bundle(subject, coloc, rare, lambda: cut(own()), coloc_pairs=pairs, **more)


def traits(cat: Catalog, trait_ids: Sequence[int | str], include_associations=False, include_coloc_pairs=False, h4_threshold=H4, include_full_associations=False) -> Bundle:
    """Up to ten traits, collapsed; ids that are GUIDs name uploads, whose groups, rare results, extractions and pairs are appended."""
    ids = _ids(trait_ids, 10, "traits")
    guids = [i for i in ids if isinstance(i, str) and re.match(GUID, i)]
    nums = [int(i) for i in ids if i not in guids]
    seed = F.col("trait_id").isin(nums)
    more = {"full_associations": lambda: associations_full(cat, nums)} if include_full_associations else {}
    out = _bundle(cat, cat.traits.filter(F.col("id").isin(nums)), "trait", nums, seed, lambda: cat.study_extractions.filter(seed), lambda: cat.keys("study_extractions", "id", "trait_id").filter(seed), include_associations, include_coloc_pairs, h4_threshold, **more)
    for g in guids:
        up = get_upload(cat, g, include_associations, include_coloc_pairs, h4_threshold)
        both = lambda c, base=out, up=up: lambda: merge_trait_result(getattr(base, c), getattr(up, c))
        full = (lambda base=out: base.full_associations) if include_full_associations else None
        out = Bundle(**{c: both(c) for c in ("subject", "coloc_groups", "rare_results", "study_extractions", "coloc_pairs", "upload_study_extractions")}, full_associations=full)
    return out


def trait(cat: Catalog, trait_id: int | str, **options) -> Bundle:
    return traits(cat, [trait_id], **options)


def gene_regions(genes: DataFrame, blocks: DataFrame) -> DataFrame:
    """The LD blocks that each gene lies in: gene_id and the block's row."""
    return overlaps(genes, blocks).select(F.col("left.id").alias("gene_id"), "right.*")


def gene_neighbours(genes: DataFrame, among: DataFrame, near: int = NEAR) -> DataFrame:
    """Pairs of a gene and another one that is at most `near` bases from it, on either side or overlapping: gene_id, the other's row, distance."""
    around = genes.withColumns({"start_bp": F.greatest(F.col("start_bp") - near, F.lit(0)), "stop_bp": F.col("stop_bp") + near, "_start": F.col("start_bp"), "_stop": F.col("stop_bp")})
    gap = F.greatest(F.lit(0), F.col("right.start_bp") - F.col("left._stop"), F.col("left._start") - F.col("right.stop_bp"))
    pairs = overlaps(around, among).filter(F.col("left.id") != F.col("right.id"))
    return pairs.select(F.col("left.id").alias("gene_id"), "right.*", gap.alias("distance"))


def genes(cat: Catalog, gene_ids: Sequence[int | str], include_associations=False, include_coloc_pairs=False, include_trans=True, h4_threshold=H4, near: int = NEAR) -> Bundle:
    """Up to ten genes by id or symbol, collapsed; without trans effects only cis rows stay. A symbol is looked up in the genes.

    `regions` are the LD blocks that a gene lies in, `neighbours` the genes at most `near` bases from it (each with its gene_id).
    """
    ids = _ids(gene_ids, 10, "genes")
    nums, names = [i for i in ids if isinstance(i, int)], [i for i in ids if isinstance(i, str)]
    subject = cat.genes.filter(F.col("id").isin(nums) | F.col("gene").isin(names))
    keys = subject.select("id") if names else nums
    seed = F.col("gene_id").isin(nums) | F.col("gene").isin(names)
    cis = None if include_trans else F.col("cis_trans") == "cis"

    def cut(rows: DataFrame) -> DataFrame:
        return between_ids(rows, "gene_id", keys, "id") if names else rows.filter(F.col("gene_id").isin(nums))

    own = lambda: cut(cat.by("study_extractions", "gene_id"))
    paired = lambda: cut(cat.keys("study_extractions", "id", "gene_id", *([] if include_trans else ["cis_trans"]), by="gene_id"))
    variants = lambda: cat.variants.join(own().select(F.col("variant_id").alias("_v")).distinct(), F.col("id") == F.col("_v"), "left_semi")
    regions, others = lambda: gene_regions(subject, cat.ld_blocks), lambda: gene_neighbours(subject, cat.genes, near)
    return _bundle(cat, subject, "gene", keys, seed, own, paired, include_associations, include_coloc_pairs, h4_threshold, cis, variants=variants, regions=regions, neighbours=others)


def gene(cat: Catalog, gene_id: int | str, **options) -> Bundle:
    return genes(cat, [gene_id], **options)


def resolve_variants(cat: Catalog, variants: Sequence[int | str]) -> DataFrame:
    """Variant rows by id, rsid, display name or chr:bp."""
    nums = [int(v) for v in variants if isinstance(v, int) or str(v).isdigit()]
    names = [str(v) for v in variants if not (isinstance(v, int) or str(v).isdigit())]
    lower = [n.lower() for n in names]
    place = F.concat_ws(":", "chr", "bp")
    return cat.variants.filter(F.col("id").isin(nums) | F.lower("snp").isin(lower) | F.lower("display_snp").isin(lower) | place.isin(names))


def variants(cat: Catalog, ids: Sequence[int | str], expand=False, include_associations=False, include_coloc_pairs=False, h4_threshold=H4, include_summary_stats=False) -> DataFrame | Bundle:
    """Minimal rows (up to 50 ids), or with `expand` the bundle (up to 10)."""
    ids = _ids(ids, 10 if expand else 50, "variants")
    rows = resolve_variants(cat, ids)
    if not expand:
        return rows
    nums = [int(i) for i in ids if isinstance(i, int) or str(i).isdigit()]
    known = len(nums) == len(ids)  # else the smallest and largest id are looked up when the files are read

    def cut(table: DataFrame) -> DataFrame:
        return table.filter(F.col("variant_id").isin(nums)) if known else between_ids(table, "variant_id", rows, "id")

    at = lambda name: cut(cat.by(name, "variant_id"))
    studies = lambda: cut(cat.narrow("study_extractions", "variant_id", "study_id")).select("study_id").distinct()
    merged = lambda df: merge_associations(df, at("associations"), keys_first=True) if include_associations else df
    own, coloc, rare = lambda: at("study_extractions"), lambda: merged(at("coloc_groups")), lambda: merged(at("rare_results"))
    stats = (lambda: cat.summary_stats.join(studies(), "study_id", "left_semi")) if include_summary_stats else None
    paired = lambda: cut(cat.keys("study_extractions", "id", "variant_id", by="variant_id"))
    pairs = (lambda: coloc_pairs_of(cat, paired(), h4_threshold)) if include_coloc_pairs else None
    return Bundle(rows, coloc, rare, own, coloc_pairs=pairs, summary_stats=stats)


def variant(cat: Catalog, variant_id: int | str, include_coloc_pairs=False, h4_threshold=H4, include_summary_stats=False) -> Bundle:
    """One variant; associations are always merged."""
    return variants(cat, [variant_id], True, True, include_coloc_pairs, h4_threshold, include_summary_stats)


def variants_grange(cat: Catalog, chr: str, start: int, stop: int) -> DataFrame:
    """Variants of a chromosome from start to stop, both included."""
    return cat.variants.filter((F.col("chr") == str(chr)) & F.col("bp").between(start, stop))


def genes_with_extractions(cat: Catalog, region_id: int) -> DataFrame:
    """Genes that have an extraction in an LD block."""
    own = cat.by("study_extractions", "ld_block_id").filter(F.col("ld_block_id") == region_id)
    return cat.genes.join(own.select(F.col("gene_id").alias("_g")).distinct(), F.col("id") == F.col("_g"), "left_semi")


def region(cat: Catalog, region_id: int, include_associations=False, include_coloc_pairs=False, h4_threshold=H4) -> Bundle:
    """All components of an LD block; its genes are those that overlap what its variants span, with or without an extraction."""
    block = _ids([region_id], 1, "region")[0]
    seed = F.col("ld_block_id") == block
    own, inside = lambda: cat.by("study_extractions", "ld_block_id").filter(seed), cat.variants.filter(seed)
    span = inside.groupBy("chr").agg(F.min("bp").alias("start_bp"), F.max("bp").alias("stop_bp"))
    merged = lambda df: merge_associations(df, cat.associations, keys_first=True) if include_associations else df
    coloc, rare = lambda: merged(cat.coloc_groups.filter(seed)), lambda: merged(cat.rare_results.filter(seed))
    paired = lambda: cat.keys("study_extractions", "id", "ld_block_id", by="ld_block_id").filter(seed)
    pairs = (lambda: coloc_pairs_of(cat, paired(), h4_threshold)) if include_coloc_pairs else None
    return Bundle(lambda: own().select("ld_block_id").distinct(), coloc, rare, own, inside, coloc_pairs=pairs, genes_in_region=lambda: overlaps(cat.genes, span).select("left.*"))


def ld_proxies(cat: Catalog, ids: Sequence[int | str]) -> DataFrame:
    """LD rows whose lead is one of the variants."""
    v = resolve_variants(cat, _ids(ids, 50, "ld_proxies")).select(F.col("id").alias("_v"))
    return cat.ld.join(v, F.col("lead_variant_id") == F.col("_v"), "left_semi")


def ld_matrix(cat: Catalog, ids: Sequence[int | str] | DataFrame) -> DataFrame:
    """LD rows between the variants, long form; any number of them, as a frame with the column `id` or as a list."""
    v = (ids if isinstance(ids, DataFrame) else resolve_variants(cat, _ids(ids, float("inf"), "ld_matrix"))).select(F.col("id").alias("_v"))
    w = v.withColumnRenamed("_v", "_w")
    return cat.ld.join(v, F.col("lead_variant_id") == F.col("_v"), "left_semi").join(w, F.col("proxy_variant_id") == F.col("_w"), "left_semi")


def gene_pleiotropy(cat: Catalog) -> DataFrame:
    """Per gene, over all rows of its coloc groups: distinct trait categories, distinct other protein-coding genes.

    A group's categories and coding genes are made distinct first, however many rows have them, and meet the group's genes in one join.
    """
    rows = cat.coloc_groups.select("coloc_group_id", "gene_id", "gene", "trait_category")
    own = rows.filter(F.col("gene_id").isNotNull()).select("coloc_group_id", "gene_id", "gene").distinct()
    coding = cat.genes.filter("gene_biotype = 'protein_coding'").select(F.col("id").alias("_id"))
    kind = lambda category, gene: F.struct(category.cast("string").alias("_category"), gene.cast("bigint").alias("_coding"))
    both = rows.select("coloc_group_id", "trait_category", "gene_id").join(coding, F.col("gene_id") == F.col("_id"), "left")
    found = both.select("coloc_group_id", F.inline(F.array(kind(F.col("trait_category"), F.lit(None)), kind(F.lit(None), F.col("_id")))))
    found = found.filter("_category is not null or _coding is not null").distinct()
    each = own.join(found, "coloc_group_id", "left").select("gene_id", "gene", "_category", "_coding").distinct()
    other = F.count(F.when(F.col("_coding") != F.col("gene_id"), 1))
    return each.groupBy("gene_id", "gene").agg(F.count("_category").alias("distinct_trait_categories"), other.alias("distinct_protein_coding_genes"))


def variant_pleiotropy(cat: Catalog) -> DataFrame:
    """Per variant with coloc rows: distinct trait categories and protein-coding genes."""
    coding = cat.genes.filter("gene_biotype = 'protein_coding'").select(F.col("id").alias("coding_id"))
    rows = cat.coloc_groups.select("variant_id", "display_snp", "gene_id", "trait_category").distinct().join(coding, F.col("gene_id") == F.col("coding_id"), "left")
    return rows.groupBy("variant_id", "display_snp").agg(F.countDistinct("trait_category").alias("distinct_trait_categories"), F.countDistinct("coding_id").alias("distinct_protein_coding_genes"))


def get_upload(cat: Catalog, guid: str, include_associations=False, include_coloc_pairs=False, h4_threshold=H4, include_summary_stats=False, store: UploadStore | None = None) -> Bundle:
    """An uploaded study by GUID: its groups, the rare results and extractions of the studies that they are shared with, its own
    extractions (`upload_study_extractions`), pairs, and statistics of those studies if asked for.

    With a store, what was uploaded there is part of it: the record in `subject`, the leads in `upload_study_extractions`, and all its rows
    in `full_associations` if associations are asked for.
    """
    if not isinstance(guid, str) or not re.match(GUID, guid):
        raise ValueError("not a GUID")
    up = cat.uploads.filter(F.col("guid") == guid)
    rows = cat.upload_coloc_groups.join(up.select(F.col("upload_id").alias("_u")), F.col("gwas_upload_id") == F.col("_u"), "left_semi")
    shared = rows.select(F.coalesce("study_id", "existing_study_id").alias("_s"), F.col("variant_id").alias("_v")).filter("_s is not null").distinct()
    at = lambda df: df.join(shared, (F.col("study_id") == F.col("_s")) & (F.col("variant_id") == F.col("_v")), "left_semi")
    extractions, rare = lambda: at(cat.study_extractions), lambda: at(cat.rare_results)
    own = rows.filter("study_id is null and existing_study_id is null")
    pairs = (lambda: coloc_pairs_of(cat, at(cat.keys("study_extractions", "id", "study_id", "variant_id")), h4_threshold)) if include_coloc_pairs else None
    stats = (lambda: cat.summary_stats.join(shared.select(F.col("_s").alias("study_id")).distinct(), "study_id", "left_semi")) if include_summary_stats else None
    groups = rows
    if include_associations:
        near = lambda: null_safe_join(cat.associations, shared.select(F.col("_s").alias("study_id"), F.col("_v").alias("variant_id")), ["study_id", "variant_id"], "left_semi")
        groups = lambda: merge_upload_associations(rows, near().withColumn("existing_study_id", F.col("study_id")))
        rare = lambda: merge_associations(at(cat.rare_results), near())
    full = None
    if store is not None:
        up, staged = union_fill(up, store.records().filter(F.col("guid") == guid)), store.rows(guid)
        own, full = union_fill(own, staged.filter("is_lead")), staged if include_associations else None
    return Bundle(up, groups, rare, extractions, upload_study_extractions=own, coloc_pairs=pairs, summary_stats=stats, full_associations=full)
