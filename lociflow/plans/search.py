"""Search by text (a regular expression by default) or by variant with its LD proxies."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, functions as F

from ..catalog import Catalog

VARIANT_TEXT = re.compile(r"^rs|^\d+:\d+")


def search(cat: Catalog, text: str, rsquared_threshold: float = 0.8, literal: bool = False, keep_rsq: bool = False) -> DataFrame:
    """Rows that match, with the call that looks each of them up.

    Text that starts with `rs` or `number:number` goes to the variant branch, any other to names and alternative names.
    """
    if not text:
        raise ValueError("search text is required")
    text = text.lower()
    out = _variants(cat, text, rsquared_threshold) if VARIANT_TEXT.search(text) else _terms(cat, text, literal)
    return out if keep_rsq else out.drop("rsq")


def _terms(cat: Catalog, text: str, literal: bool) -> DataFrame:
    pattern = re.escape(text) if literal else text
    try:  # by the engine that will run it
        cat.spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        raise ValueError(f"not a regular expression: {text}") from e
    hit = lambda c: F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    rows = cat.cached_search_terms.filter(hit("name_lower") | hit("alt_name_lower"))
    name = F.when(F.col("alt_name").isNull(), F.col("name")).otherwise(F.concat("name", F.lit(" ("), "alt_name", F.lit(")")))
    call = F.when(F.col("type") == "trait", F.concat(F.lit("trait("), "type_id", F.lit(")"))).when(F.col("type") == "gene", F.concat(F.lit("gene('"), "type_id", F.lit("')")))
    kind = F.when(F.col("kind") == "symbol", "gene").otherwise(F.col("kind")).alias("type")  # a gene's call is by its symbol
    counts = cat.counts_for("trait").unionByName(cat.counts_for("symbol")).select(kind, F.col("subject").alias("type_id"), "num_coloc_groups", "num_coloc_studies", F.col("num_rare").alias("num_rare_results"), "num_study_extractions")
    out = rows.join(counts, ["type", "type_id"], "left")
    out = out.fillna(0, ["num_coloc_groups", "num_coloc_studies", "num_rare_results", "num_study_extractions"])
    return out.select(call.alias("call"), name.alias("name"), "type", "type_id", "sample_size", "num_coloc_groups", "num_coloc_studies", "num_rare_results", "num_study_extractions")


def _variants(cat: Catalog, text: str, threshold: float) -> DataFrame:
    v = cat.variants
    found = v.filter((F.lower("snp") == text) | (F.concat_ws(":", "chr", "bp") == text.split(" ")[0]))
    original = found.select(F.lit("original_variant").alias("type"), F.col("display_snp").alias("name"), F.col("id").alias("type_id"), F.lit(None).cast("double").alias("rsq"))
    lead = found.select(F.col("id").alias("_lead"))
    ld = cat.ld.join(lead, F.col("lead_variant_id") == F.col("_lead"), "left_semi").filter((F.col("r") * F.col("r") >= threshold) & (F.col("lead_variant_id") != F.col("proxy_variant_id")))
    coloc = cat.coloc_groups.select(F.col("variant_id").alias("_c")).distinct()
    proxies = ld.join(coloc, F.col("proxy_variant_id") == F.col("_c"), "left_semi").join(v, F.col("proxy_variant_id") == v["id"])
    proxy = proxies.select(F.lit("proxy_variant").alias("type"), F.col("display_snp").alias("name"), F.col("id").alias("type_id"), F.bround(F.col("r") * F.col("r"), 2).alias("rsq"))
    out = original.unionByName(proxy).distinct()
    of_hits = lambda df: df.join(out.select(F.col("type_id").alias("variant_id")).distinct(), "variant_id", "left_semi")
    groups = of_hits(cat.coloc_groups).groupBy(F.col("variant_id").alias("type_id")).agg(F.countDistinct("coloc_group_id").alias("num_coloc_groups"), F.count(F.lit(1)).alias("num_coloc_studies"))
    rare = of_hits(cat.rare_results).groupBy(F.col("variant_id").alias("type_id")).agg(F.count(F.lit(1)).alias("num_rare_results"))
    out = out.join(groups, "type_id", "left").join(rare, "type_id", "left").fillna(0, ["num_coloc_groups", "num_coloc_studies", "num_rare_results"])
    return out.select(F.concat(F.lit("variant("), F.col("type_id").cast("string"), F.lit(")")).alias("call"), "name", "type", F.col("type_id").cast("string").alias("type_id"), "rsq", "num_coloc_groups", "num_coloc_studies", "num_rare_results", F.lit(None).cast("bigint").alias("num_study_extractions"))
