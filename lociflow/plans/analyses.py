"""Set-oriented versions of the documented downstream analyses; each takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import chr_order, cut_right, is_guid, least_strict, neg_log10, relabel, truncate, wrap  # noqa: F401
from ..operators.ops import keep_first, lead_per_group, members, n_distinct_na, null_safe_join, solo_filter, union_fill, unpivot_ordered

GWS = 5e-8
#: Traits of a dense matrix, or columns of a wide one, at most.
MOST_DENSE = 10_000
#: Fixed labels of the evidence metrics, in their order.
METRICS = [("distinct_trait_categories", "Trait categories"), ("distinct_protein_coding_genes", "Protein-coding genes"), ("n_tissues", "Distinct tissues"), ("n_coloc_groups", "Colocalization groups"), ("n_rare_groups", "Rare result groups")]
#: Fixed labels of data types.
DATA_TYPES = {"splice_variant": "Splice Variant", "transcript": "Transcript", "gene_expression": "Gene Expression", "protein": "Protein", "methylation": "Methylation", "metabolome": "Metabolome", "cell_trait": "Cell Trait", "plasma_protein": "Plasma Protein", "phenotype": "Phenotype"}


def extraction_membership(coloc: DataFrame, rare: DataFrame, extractions: DataFrame) -> DataFrame:
    """Distinct extraction ids by source, as four rows."""
    ids = lambda df, c: df.filter(F.col(c).isNotNull()).select(F.col(c).alias("id")).distinct()
    c, r, s = ids(coloc, "study_extraction_id"), ids(rare, "study_extraction_id"), ids(extractions, "id")
    only = s.join(c, "id", "left_anti").join(r, "id", "left_anti")
    count = lambda df, name: df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n_extractions"))
    return count(c, "coloc_groups").unionAll(count(r, "rare_results")).unionAll(count(only, "study_extractions_only")).unionAll(count(s, "study_extractions"))


def cis_nonsolo(coloc: DataFrame) -> DataFrame:
    return solo_filter(coloc.filter("cis_trans = 'cis'"), "coloc_group_id")


def hydrate_pairs(pairs: DataFrame, extractions: DataFrame) -> DataFrame:
    """Pairs with the trait, data type and tissue of either side."""
    side = lambda s: extractions.select(F.col("id").alias(f"study_extraction_{s}_id"), *(F.col(c).alias(f"{c}_{s}") for c in ("trait_name", "data_type", "tissue")))
    return pairs.join(side("a"), "study_extraction_a_id", "left").join(side("b"), "study_extraction_b_id", "left")


def disease_genes(coloc: DataFrame, trait_ids: DataFrame) -> DataFrame:
    """Distinct genes of the groups of the traits (a column trait_id), without methylation rows."""
    ids = trait_ids.select(F.col("trait_id").alias("_t")).distinct()
    groups = coloc.join(ids, coloc["trait_id"] == ids["_t"], "left_semi").select(F.col("coloc_group_id").alias("_g")).distinct()
    rows = coloc.join(groups, coloc["coloc_group_id"] == groups["_g"], "left_semi")
    keep = ~F.coalesce(F.lower("data_type").rlike("methyl"), F.lit(False))
    return rows.filter(keep & F.col("gene_id").isNotNull()).select("gene_id", "gene").distinct()


def rank_pleiotropy(genes: DataFrame, pleiotropy: DataFrame) -> DataFrame:
    return genes.join(pleiotropy.drop("gene"), "gene_id").orderBy(F.asc_nulls_last("distinct_trait_categories"), "gene_id")


def gene_evidence(ranked: DataFrame, coloc: DataFrame, rare: DataFrame, trait_ids: DataFrame, top: int = 40) -> DataFrame:
    """For the `top` ranked genes: their groups that the traits are in, tissues of all rows of their groups, rare groups."""
    best = ranked.orderBy(F.asc_nulls_last("distinct_trait_categories"), "gene_id").limit(top)
    ids = trait_ids.select(F.col("trait_id").alias("_t")).distinct().withColumn("hit", F.lit(True))
    wanted = best.select(F.col("gene_id").alias("_gene"))

    kind = lambda df, k, group, tissue: df.select(F.lit(k).alias("_kind"), F.col(group).alias("_group"), "gene_id", "trait_id", tissue.alias("_tissue"))
    long = kind(coloc, "c", "coloc_group_id", F.col("tissue")).unionByName(kind(rare, "r", "rare_result_group_id", F.lit(None).cast("string")))
    own = long.join(F.broadcast(wanted), F.col("gene_id") == F.col("_gene")).select("_gene", "_kind", "_group").distinct()
    seen = own.join(long.select("_kind", "_group", "trait_id", "_tissue").distinct(), ["_kind", "_group"]).join(ids, F.col("trait_id") == F.col("_t"), "left")
    distinct = lambda c, on, name: F.countDistinct(F.when(on, F.col(c))).alias(name)
    common = F.col("_kind") == "c"
    n = seen.groupBy(F.col("_gene").alias("gene_id")).agg(distinct("_group", common & F.col("hit"), "n_coloc_groups"), distinct("_tissue", common, "n_tissues"), distinct("_group", ~common & F.col("hit"), "n_rare_groups"))
    out = best.join(n, "gene_id", "left").fillna(0, ["n_coloc_groups", "n_tissues", "n_rare_groups"])
    return out.select("gene", "distinct_trait_categories", "distinct_protein_coding_genes", "n_tissues", "n_coloc_groups", "n_rare_groups")


def evidence_long(evidence: DataFrame) -> DataFrame:
    return unpivot_ordered(evidence, ["gene"], METRICS, "metric", "value")


def gene_disease_groups(coloc: DataFrame, rare: DataFrame, trait_ids: DataFrame) -> DataFrame:
    """Rows, within one gene's results, of the groups that a trait of the list is in; common and rare rows stacked."""
    def part(df: DataFrame, group: str, kind: str) -> DataFrame:
        hit = members(df, "trait_id", trait_ids).select(F.col(group).alias("_g")).distinct()
        return df.join(hit, df[group] == hit["_g"], "left_semi").withColumn("group_id", F.col(group)).drop(group).withColumn("kind", F.lit(kind))

    return union_fill(part(coloc, "coloc_group_id", "coloc"), part(rare, "rare_result_group_id", "rare"))


def variant_maf(rows: DataFrame) -> DataFrame:
    return rows.filter("eaf is not null").groupBy("variant_id").agg(F.min(least_strict(F.col("eaf"), 1 - F.col("eaf"))).alias("maf"))


def forest_frame(rows: DataFrame, max_chars: int = 50) -> DataFrame:
    """Effect sizes with 95% intervals and labels; `row_ord` is the order of rows in their group by beta."""
    maf = variant_maf(rows)
    raw = F.concat(F.coalesce("trait_name", F.lit("NA")), F.lit(" — "), F.coalesce("data_type", F.lit("NA")), F.lit(" — "), F.coalesce("tissue", F.lit("")))
    panel = F.concat(F.coalesce("display_snp", F.concat(F.lit("variant "), F.col("variant_id").cast("string"))), F.when(F.col("maf").isNull(), "").otherwise(F.format_string(" (MAF=%.3f)", F.col("maf"))))
    out = rows.filter("beta is not null and se > 0").join(maf, "variant_id", "left").withColumns({"lo": F.col("beta") - 1.96 * F.col("se"), "hi": F.col("beta") + 1.96 * F.col("se"), "row_label": truncate(raw, max_chars), "panel_id": panel, "data_type_label": relabel(F.col("data_type"), DATA_TYPES)})
    return out.withColumn("row_ord", F.row_number().over(Window.partitionBy("group_id").orderBy("beta", "study_extraction_id")))


def anchor_filter(rows: DataFrame, group: str, anchor: int, siblings: DataFrame | None = None) -> DataFrame:
    """Genome-wide significant rows of groups whose anchor is significant, without sibling traits and solo groups."""
    out_groups = rows.filter((F.col("trait_id") == anchor) & (F.col("min_p") > GWS)).select(group)
    kept = rows if siblings is None else members(rows, "trait_id", siblings, negate=True)
    return solo_filter(members(kept.filter(F.col("min_p") < GWS), group, out_groups, negate=True), group, keep_null=True)


def locus_agg(common: DataFrame, rare: DataFrame, anchor: int) -> DataFrame:
    """Per locus of the anchor: rows, smallest p, -log10 p; common and rare stacked."""
    keys = ["display_snp", "chr", "bp"]

    def part(df: DataFrame, kind: str) -> DataFrame:
        own = F.col("trait_id") == anchor
        loci = df.groupBy(*keys).agg(F.min(F.when(own, F.col("min_p"))).alias("min_p"), F.count(F.lit(1)).alias("n_studies"), F.count(F.when(own, 1)).alias("_own"))
        return loci.filter("_own > 0").drop("_own").withColumns({"neg_log10_p": neg_log10(F.col("min_p")), "variant_type": F.lit(kind)})

    return part(common, "common").unionByName(part(rare, "rare"))


def chr_offsets(genes: DataFrame) -> DataFrame:
    """Cumulative start of each chromosome in genome order."""
    lens = genes.groupBy(F.col("chr").alias("chr_lab")).agg(F.max("stop_bp").alias("chr_len")).withColumn("ord", chr_order(F.col("chr_lab")))
    w = Window.orderBy("ord", "chr_lab").rowsBetween(Window.unboundedPreceding, -1)  # one row per chromosome
    return lens.withColumn("offset", F.coalesce(F.sum("chr_len").over(w), F.lit(0)).cast("bigint"))


def genome_positions(loci: DataFrame, offsets: DataFrame) -> DataFrame:
    """Loci with their place on the genome axis, in millions of bases, and the middle of their chromosome."""
    o = F.broadcast(offsets)  # one row per chromosome
    return loci.join(o, loci["chr"] == o["chr_lab"], "left").withColumns({"x_mbp": (F.col("bp") + F.col("offset")) / 1e6, "x_mbp_mid": (F.col("offset") + F.col("chr_len") / 2) / 1e6})


def category_proportion(rows: DataFrame, traits: DataFrame, anchor: int) -> DataFrame:
    """Share of each trait's hits that colocalise with the anchor; labels for the top of a category."""
    kinds = ["Cell Trait", "Plasma Protein", "Phenotype"]
    meta = rows.filter(F.col("data_type").isin(kinds)).select("trait_id", "trait_name", "data_type", "trait_category").distinct()
    n = rows.groupBy("trait_id").agg(F.count(F.lit(1)).alias("n_colocs"))
    hits = traits.select(F.col("id").alias("trait_id"), F.col("num_study_extractions").alias("n_studyhits"))
    out = n.join(meta, "trait_id").join(hits, "trait_id").filter((F.col("trait_id") != anchor) & (F.col("n_colocs") > 1) & F.col("trait_category").isNotNull() & (F.col("n_studyhits") > 0))
    out = out.withColumns({"prop_colocing_hits": F.col("n_colocs") / F.col("n_studyhits") * 100, "colocs_cut": cut_right(F.col("n_colocs"), [1, 5, 10, 20, float("inf")])})
    top = F.max("prop_colocing_hits").over(Window.partitionBy("trait_category"))
    show = ((F.col("prop_colocing_hits") == top) & (F.col("prop_colocing_hits") > 10)) | (F.col("prop_colocing_hits") > 25)
    return out.withColumn("label", F.when(show, wrap(F.col("trait_name"), 25)))


def richest_group(rows: DataFrame, gene: str) -> DataFrame:
    """The group with the gene that has most distinct data types; ties to the smaller id."""
    ids = rows.filter(F.col("gene") == gene).select("coloc_group_id").distinct()
    n = rows.join(ids, "coloc_group_id", "left_semi").groupBy("coloc_group_id").agg(n_distinct_na("data_type").alias("n_data_types"))
    return n.orderBy(F.desc("n_data_types"), "coloc_group_id").limit(1)


def scaled_lbf(stats: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """LBF over the largest absolute LBF of its study, padded points (se = 1) removed, then cut to a window."""
    rows = stats.filter("se <> 1")
    top = rows.groupBy("study_id").agg(F.max(F.abs("lbf_1")).alias("_top"))  # one row a study; a study is no single task
    cut = rows if low is None else rows.filter(F.col("bp").between(low, high))
    return null_safe_join(cut, top, ["study_id"]).withColumn("scaled_lbf", F.col("lbf_1") / F.col("_top")).drop("_top")


def betas_at_snp(stats: DataFrame, prefix: str, meta: DataFrame) -> DataFrame:
    """Effects at a SNP across studies on the other allele, with trait labels; molecular traits share one category."""
    rows = stats.filter(F.col("snp").startswith(prefix)).withColumn("beta_alt", -F.col("beta"))
    out = rows.join(meta, "study_id", "left")
    return out.withColumn("trait_category", F.when(F.col("data_type") != "Phenotype", "Molecular").when(F.col("data_type") == "Phenotype", F.col("trait_category")))


def dedupe_traits(traits: DataFrame) -> DataFrame:
    """One trait per name without its parenthesised suffix: the one with most study hits, then the smallest id."""
    stem = traits.withColumn("name_cut", F.regexp_replace("trait_name", r" \(.*\)", ""))
    return keep_first(stem, ["name_cut"], [F.desc_nulls_last("n_studyhits"), "trait_id"])


def shared_groups(rows: DataFrame, dense: bool = False) -> DataFrame:
    """Groups that two traits share, both directions and the diagonal; `dense` adds zeros for the traits' other pairs.

    A group of n traits gives n squared pairs, which is the result asked for; they are added up before the shuffle. The dense form is a
    matrix, for at most MOST_DENSE traits: their ids are what is broadcast. More are a ValueError.
    """
    m = rows.select("coloc_group_id", "trait_id").filter("coloc_group_id is not null").distinct()
    a, b = m.withColumnRenamed("trait_id", "trait1"), m.withColumnRenamed("trait_id", "trait2")
    out = a.join(b, "coloc_group_id").groupBy("trait1", "trait2").agg(F.count(F.lit(1)).alias("shared_colocs"))
    if not dense:
        return out
    t = m.select("trait_id").distinct()
    if t.limit(MOST_DENSE + 1).count() > MOST_DENSE:
        raise ValueError(f"at most {MOST_DENSE} traits make a dense matrix")
    return t.select(F.col("trait_id").alias("trait1")).crossJoin(F.broadcast(t.select(F.col("trait_id").alias("trait2")))).join(out, ["trait1", "trait2"], "left").fillna(0, ["shared_colocs"])


def matrix(long: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """The wide form of a long one: a row per `row`, a column per value of `column`, in their order; missing cells are 0. At most MOST_DENSE columns."""
    names = sorted(r[0] for r in long.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST_DENSE + 1).collect())
    if len(names) > MOST_DENSE:
        raise ValueError(f"at most {MOST_DENSE} columns make a matrix")
    return long.groupBy(row).pivot(column, names).agg(F.first(value)).fillna(0) if names else long.select(row).distinct()


def record(spark: SparkSession, fields: dict[str, object], kinds: str) -> DataFrame:
    """A named record as a frame of one row; `kinds` is its schema, fields that it lacks are null."""
    schema = spark.range(0).select(F.from_json(F.lit("{}"), kinds).alias("r")).select("r.*").schema
    return spark.createDataFrame([tuple(fields.get(f.name) for f in schema.fields)], schema)


def shared_groups_log(shared: DataFrame) -> DataFrame:
    return shared.withColumn("log_coloc_hits", F.when(F.col("shared_colocs") > 0, F.log10("shared_colocs")))


def cluster_summary(clusters: DataFrame, traits: DataFrame, width: int = 500) -> DataFrame:
    """Names of each cluster's traits in id order, cut to `width`; no more names are gathered than can be seen, two characters part them."""
    named = clusters.join(traits.select(F.col("id").alias("trait_id"), "trait_name"), "trait_id").filter("trait_name is not null")
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("trait_id"))
    some = named.withColumn("_rank", rank).filter(F.col("_rank") <= width // 2 + 2)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("trait_id", "trait_name"))), lambda x: x["trait_name"]), ", ")
    seen = some.groupBy("cluster_id").agg(names.alias("_names"))
    n = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_traits"))
    return n.join(seen, "cluster_id", "left").select("cluster_id", truncate(F.coalesce("_names", F.lit("")), width).alias("traits"), "n_traits")


def no_padded_groups(rows: DataFrame, group: str) -> DataFrame:
    """Drops every group with a row whose se is 1 or null."""
    ok = F.min(F.coalesce(F.col("se") != 1, F.lit(False)).cast("int")).over(Window.partitionBy(group))
    return rows.withColumn("_ok", ok).filter("_ok = 1").drop("_ok")


def pick_lead(rows: DataFrame, group: str) -> DataFrame:
    """The row of smallest p per group among rows with an effect; ties to the smaller extraction."""
    return lead_per_group(rows.filter("beta is not null and se > 0 and min_p is not null"), [group], ["min_p", "study_extraction_id"])


def compare_leads(rows: DataFrame, left: int, right: int) -> DataFrame:
    """Leads of two traits in the groups that both are in, as one frame with `side`."""
    of = lambda t: rows.filter(F.col("trait_id") == t).select("coloc_group_id").distinct()
    both = rows.join(of(left).join(of(right), "coloc_group_id", "left_semi"), "coloc_group_id", "left_semi").filter(F.col("trait_id").isin(left, right))
    clean = no_padded_groups(both, "coloc_group_id")
    side = lambda t, name: pick_lead(clean.filter(F.col("trait_id") == t), "coloc_group_id").withColumn("side", F.lit(name))
    return side(left, "left").unionByName(side(right, "right")).withColumn("group_id", F.col("coloc_group_id").cast("string"))


def both_sides(leads: DataFrame, most: int = 5) -> DataFrame:
    """Rows of the first groups, by id as text, that have both sides."""
    ids = leads.groupBy("group_id").count().filter("count = 2").orderBy("group_id").limit(most).select("group_id")
    return leads.join(F.broadcast(ids), "group_id", "left_semi")  # at most `most` rows


def strip_labels(rows: DataFrame) -> DataFrame:
    """Distinct SNP names of a group in order of extraction, else the group's id."""
    seen = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("display_snp").isNotNull(), F.struct("study_extraction_id", "display_snp")))), lambda x: x["display_snp"]))
    out = rows.groupBy("group_id").agg(F.array_join(seen, " · ").alias("strip_lbl"))
    return out.withColumn("strip_lbl", F.when(F.col("strip_lbl") == "", F.col("group_id").cast("string")).otherwise(F.col("strip_lbl")))


def pair_only_loci(pairs: DataFrame, covered: DataFrame, rows: DataFrame, h4: float = 0.8) -> DataFrame:
    """Leads per LD block that pairs support (h4 above the cut) and no shared group covers."""
    sig = members(pairs.filter(F.col("h4") > h4), "ld_block_id", covered, negate=True).select("ld_block_id").distinct()
    return pick_lead(members(rows, "ld_block_id", sig), "ld_block_id")


def pairs_top(pairs: DataFrame, wanted: Sequence[str], h4: float = 0.8, most: int = 20) -> DataFrame:
    """The first pairs above the cut by the ids of both sides; columns of `wanted` that there are."""
    cols = [c for c in wanted if c in pairs.columns]
    return pairs.filter(F.col("h4") > h4).orderBy("study_extraction_a_id", "study_extraction_b_id").limit(most).select(*cols)
