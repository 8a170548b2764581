"""Scalar expressions of the analyses, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Smallest positive normal double: the floor of p-values before a logarithm.
DOUBLE_XMIN = 2.2250738585072014e-308
GUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Chromosomes in order; others come last, at 999.
CHROMOSOMES = [*(str(i) for i in range(1, 23)), "X", "Y"]


def is_guid(c: Column) -> Column:
    return F.coalesce(c.rlike(GUID), F.lit(False))


def source_url(name: Column, base: str) -> Column:
    """`base`, and all but the first two hyphens as underscores."""
    head = F.substring_index(name, "-", 3)
    return F.concat(F.lit(base), head, F.translate(F.substring(name, F.length(head) + 1, F.length(name)), "-", "_"))


def neg_log10(p: Column) -> Column:
    """-log10 with p floored at the smallest normal double; null stays null."""
    return F.when(p.isNotNull(), -F.log10(F.greatest(p, F.lit(DOUBLE_XMIN))))


def least_strict(a: Column, b: Column) -> Column:
    """least() that is null if either side is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def chr_order(c: Column) -> Column:
    out = F.lit(999)
    for i, name in reversed(list(enumerate(CHROMOSOMES, 1))):
        out = F.when(c == name, i).otherwise(out)
    return out


def cut_right(x: Column, breaks: list[float]) -> Column:
    """Right-closed bins (a,b]; values outside are null; an infinite last break is open."""
    out = F.lit(None).cast("string")
    for a, b in reversed(list(zip(breaks, breaks[1:]))):
        top = "∞)" if b == float("inf") else f"{b:g}]"
        out = F.when((x > a) & (F.lit(True) if b == float("inf") else x <= b), f"({a:g},{top}").otherwise(out)
    return out


def truncate(c: Column, width: int, ellipsis: str = "...") -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - len(ellipsis)), F.lit(ellipsis))).otherwise(c)


def wrap(c: Column, width: int) -> Column:
    """Greedy line filling by words; lines are shorter than `width` as long as words allow."""
    last = lambda acc: F.element_at(acc, -1)
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    step = lambda acc, w: F.when(F.size(acc) == 0, F.array(w)).when(F.length(last(acc)) + 1 + F.length(w) < width, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last(acc), F.lit(" "), w)))).otherwise(F.concat(acc, F.array(w)))
    return F.when(c.isNotNull(), F.array_join(F.aggregate(words, F.array().cast("array<string>"), step), "\n"))


def relabel(c: Column, labels: dict[str, str]) -> Column:
    """Named lookup; a value without a label stays."""
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), c)
