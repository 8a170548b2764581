"""Canonical schemas and the ingest normaliser."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_L, _D, _S, _B, _I = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType()


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_ROW = dict(study_id=_L, study_extraction_id=_L, variant_id=_L, ld_block_id=_L, chr=_S, bp=_L, min_p=_D, display_snp=_S, gene=_S, gene_id=_L, trait_id=_L, trait_name=_S, trait_category=_S, data_type=_S, tissue=_S)

SCHEMAS: dict[str, T.StructType] = {
    "traits": _schema(id=_L, trait_name=_S, trait_category=_S, data_type=_S, sample_size=_I, category=_S),
    "genes": _schema(id=_L, gene=_S, ensembl_id=_S, chr=_S, start_bp=_L, stop_bp=_L, gene_biotype=_S),
    "variants": _schema(id=_L, snp=_S, display_snp=_S, chr=_S, bp=_L, ld_block_id=_L),
    "ld_blocks": _schema(id=_L, chr=_S, start_bp=_L, stop_bp=_L),
    "study_extractions": _schema(id=_L, snp=_S, cis_trans=_S, **{k: v for k, v in _ROW.items() if k != "study_extraction_id"}),
    "coloc_groups": _schema(coloc_group_id=_L, snp=_S, cis_trans=_S, **_ROW),
    "rare_results": _schema(rare_result_group_id=_L, snp=_S, **_ROW),
    "associations": _schema(study_id=_L, variant_id=_L, beta=_D, se=_D, p=_D, eaf=_D, imputed=_B, ord=_L),
    "coloc_pairs": _schema(study_extraction_a_id=_L, study_extraction_b_id=_L, ld_block_id=_L, h3=_D, h4=_D, spurious=_B),
    "ld": _schema(lead_variant_id=_L, proxy_variant_id=_L, ld_block_id=_L, r=_D),
    "search_terms": _schema(type=_S, name=_S, alt_name=_S, type_id=_S, sample_size=_I),
    "summary_stats": _schema(study_id=_L, snp=_S, chr=_S, bp=_L, se=_D, lbf_1=_D, beta=_D),
    "postings": _schema(family=_S, kind=_S, subject=_L, grp=_L),
    "rollups": _schema(kind=_S, subject=_S, num_study_extractions=_L, num_coloc_groups=_L, num_coloc_studies=_L, num_rare=_L),
    "uploads": _schema(upload_id=_L, guid=_S, name=_S),
    "upload_coloc_groups": _schema(coloc_group_id=_L, gwas_upload_id=_L, study_id=_L, existing_study_id=_L, variant_id=_L, trait_id=_L, ord=_L),
}


def normalise(df: DataFrame, name: str) -> DataFrame:
    """Cast to the canonical types, add missing columns as typed nulls, turn NaN into null, keep other columns as they are."""
    known, have = {f.name: f.dataType for f in SCHEMAS[name].fields}, {f.name: f.dataType for f in df.schema.fields}

    def column(k: str, kind: T.DataType):
        c = F.col(f"`{k}`") if k in have else F.lit(None)
        c = c if have.get(k) == kind else c.cast(kind)
        return (F.when(~F.isnan(c), c) if isinstance(kind, T.DoubleType) and k in have else c).alias(k)

    return df.select(*(column(k, v) for k, v in known.items()), *(f"`{k}`" for k in have if k not in known))
