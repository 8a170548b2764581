"""Upload of a study: checks, column mapping, threshold, leads and the staged table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import GUID
from ..operators.intervals import as_of
from ..operators.ops import mark_first

MAX_BYTES = 1 << 30
CATEGORIES, ANCESTRIES, BUILDS = ("continuous", "categorical"), ("EUR",), ("GRCh37", "GRCh38")
COLUMNS = ("SNP", "CHR", "BP", "EA", "OA", "EAF", "BETA", "SE", "P")
#: Effects come as BETA and SE, or as an odds ratio with the bounds of its 95 % interval.
ODDS, Z95 = ("OR", "LB", "UB"), 1.96


def check_columns(column_names: dict[str, str]) -> None:
    """ValueError unless the mapping has the places, p-values and one of the two kinds of effects."""
    missing = [c for c in ("CHR", "BP", "EA", "OA", "P") if not column_names.get(c)]
    if missing:
        raise ValueError(f"columns are required: {', '.join(missing)}")
    if not all(column_names.get(c) for c in ("BETA", "SE")) and not all(column_names.get(c) for c in ODDS):
        raise ValueError("either BETA and SE or OR, LB and UB are required")


def check_upload(name: str, p_value_threshold: float = 5e-8, category: str = "continuous", ancestry: str = "EUR", sample_size: int | None = None, reference_build: str = "GRCh38", n_bytes: int = 0, compare_with: Sequence[str] = (), email: str = "") -> None:
    """ValueError for the first argument that is not acceptable, before any plan is built; name, email and sample size are required."""
    for bad, what in (
        (not name, "name is required"), (not email, "email is required"), (n_bytes > MAX_BYTES, "the file is larger than 1 GiB"), (category not in CATEGORIES, f"category is one of {CATEGORIES}"),
        (ancestry not in ANCESTRIES, f"ancestry is one of {ANCESTRIES}"), (reference_build not in BUILDS, f"reference build is one of {BUILDS}"),
        (not 0 < p_value_threshold <= 1e-5, "p-value threshold is above 0 and at most 1e-5"), (sample_size is None or sample_size <= 0, "sample size is above 0"),
        (any(not re.match(GUID, g or "") for g in compare_with), "uploads to compare with are GUIDs"),
    ):
        if bad:
            raise ValueError(what)


def upload_normalise(raw: DataFrame, column_names: dict[str, str], p_value_threshold: float = 5e-8, block: Column | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """Canonical columns by the caller's mapping, rows up to the threshold, their LD block, and whether a row leads it.

    `blocks` (chr, start_bp, id) gives the LD blocks by their starts: a row is in the last that starts at or before it on its chromosome.
    Without them `block` is an expression over the canonical columns, or else a block is a million bases of a chromosome. A row without a
    chromosome or place, or before the first start, has no block and leads none. The lead is the row of smallest p, then place and
    alleles: one row a block, whether SNP is mapped, repeats or not. The mapping must have P and what a block is made of (CHR, BP), and
    effects by both of BETA and SE, or by OR, LB and UB, or none; `check_columns` asks for what an upload needs.

    Without BETA and SE they come from the odds ratio: ln OR, and the width of its interval's logarithm over twice 1.96. An odds ratio or
    a bound that is not above 0 gives null.
    """
    given = [c for c in ("BETA", "SE", *ODDS) if column_names.get(c)]
    if not column_names.get("P") or any(0 < len([c for c in kind if c in given]) < len(kind) for kind in (("BETA", "SE"), ODDS)):
        raise ValueError("P, and both of BETA and SE or all of OR, LB and UB")
    kinds = {"BP": "bigint", **dict.fromkeys(("EAF", "BETA", "SE", "P", *ODDS), "double")}
    of = lambda c: (F.col(f"`{column_names[c]}`") if column_names.get(c) else F.lit(None)).cast(kinds.get(c, "string"))
    log = lambda c: F.when(of(c) > 0, F.log(of(c)))
    values = {c: of(c) for c in COLUMNS}
    if "BETA" not in given and "OR" in given:
        values |= {"BETA": log("OR"), "SE": (log("UB") - log("LB")) / (2 * Z95)}
    out = raw.select(*(v.alias(c.lower()) for c, v in values.items())).filter(F.col("p") <= p_value_threshold)
    if blocks is not None:
        out = as_of(out, blocks.select("chr", "start_bp", F.col("id").alias("ld_block")), "chr", "bp", "start_bp", ["ld_block"])
    else:
        out = out.withColumn("ld_block", F.concat("chr", F.lit(":"), F.floor(F.col("bp") / 1_000_000).cast("string")) if block is None else block)
    return mark_first(out, ["ld_block"], ["p", "bp", "chr", "snp", "ea", "oa", "beta", "se", "eaf"], "is_lead")
