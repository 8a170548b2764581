"""Line dedup by a log-template tree, with SQL functions only.

A line is squeezed (runs of spaces, tabs and carriage returns to one space) and every token with a digit becomes `<*>`. The tree has
a fixed depth: token count, then the first `depth` tokens; a leaf holds the lines that agree in these. Of a leaf's lines a token is
constant if, at its place, more than half of them have it, each different line counted once for each document that holds it; the other
fields are variable. A line of which at least `similarity` of the tokens are leading or constant ones has the leaf's template. The other
lines go on to a branch of their leaf: each to that of its token that most of the leaf's lines share, but not all; ties to the first
place. There the same is done, `levels` times in all. A line that never finds its like is a template of its own. As all is by shares, a
value of a variable field stays variable however often it is seen.

Templates of at least `min_docs` documents recur; the first document (smallest id) keeps its lines of a template, all others lose theirs.

Only hashes of lines are shuffled, but for lines of leaves with several different ones; those are found with a Bloom filter, which lets
some others through: they are dropped by a join after it. Templates that hold more than 1 of HOT lines, HOT at most by that, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import bloom
from .shared import delete, fresh_names, written

DEPTH, MIN_DOCS, SIMILARITY, LEVELS, HOT, BUCKETS = 4, 2, 0.75, 3, 4096, 1024
_MASK = "(?<!\\S)[^\\s0-9]*+[0-9]\\S*"


def squeeze(line: Column) -> Column:
    odd = F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r"))
    return F.trim(F.when(odd, F.regexp_replace(line, "[ \t\r]+", " ")).otherwise(line))


def _bucket(raw: Column) -> Column:
    return F.pmod(raw, F.lit(BUCKETS)).cast("int")


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """Of each document (_id, _text) the different lines, with hashes of the leaf, the masked and the squeezed line."""
    line = F.explode(F.array_distinct(F.transform(F.split("_text", "\n", -1), squeeze))).alias("line")
    rows = docs.filter("_id is not null").select("_id", line).filter("line <> ''")
    rows = rows.withColumn("masked", F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", _MASK, "<*>")).otherwise(F.col("line")))
    n = F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(" "), F.lit(""))) + 1
    return rows.select("_id", "masked", F.xxhash64("line").alias("raw"), F.xxhash64("masked").alias("own"), F.xxhash64(n, F.substring_index("masked", " ", depth)).alias("leaf"))


def _templates(docs: DataFrame, pairs: DataFrame, mixed: DataFrame, similarity: float, depth: int, levels: int, paths: list[str]) -> DataFrame:
    """(leaf, own, template) of lines that have the template of a leaf or branch; `pairs` are those of mixed leaves.

    The text of each different line is read again from one document that has it, so only such documents are parsed again.
    """
    def keep(df: DataFrame, name: str) -> DataFrame:
        df, path = written(df, name)
        paths.append(path)
        return df

    reps = keep(pairs.select("_id", "leaf", "own").distinct().groupBy("leaf", "own").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("n_docs")), "reps")
    again = bloom.may_have(docs, reps.select("_id").distinct(), "_id")
    texts = bloom.may_have(_lines(again, depth).select("_id", "leaf", "own", "masked"), mixed, "leaf")
    tokens = F.transform(F.slice(F.split("masked", " "), depth + 1, 1 << 30), lambda t: F.xxhash64(t))
    lines = texts.join(reps, ["leaf", "own", "_id"]).select("leaf", "own", "n_docs", tokens.alias("tokens")).dropDuplicates(["leaf", "own"])
    rest = keep(lines.filter(F.size("tokens") > 0).withColumn("branch", F.col("leaf")), "templates")
    found = None
    for level in range(levels):
        each = rest.select("branch", "leaf", "own", "n_docs", F.posexplode("tokens").alias("pos", "token"))
        total = rest.groupBy("branch").agg(F.sum("n_docs").alias("total"))
        support = each.groupBy("branch", "pos", "token").agg(F.sum("n_docs").alias("support")).join(total, "branch")
        if level < levels - 1:
            support = keep(support, "support")
        constant = support.filter(2 * F.col("support") > F.col("total")).groupBy("branch").agg(F.collect_list(F.xxhash64("pos", "token")).alias("constant"))
        same = F.size(F.array_intersect(F.transform("tokens", lambda t, i: F.xxhash64(i, t)), "constant"))  # by hash, a place is there once
        judged = rest.join(constant, "branch", "left").withColumn("_fits", F.coalesce(same, F.lit(0)) + depth >= similarity * (F.size("tokens") + depth)).drop("constant")
        judged = keep(judged, "judged")
        fits = judged.filter("_fits").select("leaf", "own", F.col("branch").alias("template"))
        found = fits if found is None else found.unionByName(fits)
        if level < levels - 1:
            others = judged.filter("not _fits").drop("_fits")
            each = others.select("branch", "leaf", "own", "n_docs", F.posexplode("tokens").alias("pos", "token"))
            shared = each.join(support, ["branch", "pos", "token"]).filter("support > n_docs and support < total")
            best = shared.groupBy("branch", "leaf", "own").agg(F.max(F.struct("support", (-F.col("pos")).alias("place"), "token")).alias("_b"))
            split = best.select("leaf", "own", "branch", F.xxhash64("branch", "_b.place", "_b.token").alias("_new"))
            rest = keep(others.join(split, ["leaf", "own", "branch"]).withColumn("branch", F.col("_new")).drop("_new"), "branches")
    return found


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, levels: int = LEVELS) -> tuple[DataFrame, list[str]]:
    """One row per document that loses lines: _id and `_drop`, the hashes of its squeezed lines to drop, in BUCKETS by their remainder. And
    the tables it reads, for `delete`."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    pairs, path = written(_lines(src, depth).select("_id", "raw", "own", "leaf"), "lines")
    paths = [path]
    leaves = pairs.groupBy("leaf").agg(F.min("own").alias("a"), F.max("own").alias("b"), F.min("_id").alias("c"), F.max("_id").alias("d"))
    mixed, path = written(leaves.filter("a <> b and c <> d").select("leaf"), "leaves")
    paths.append(path)
    inside = bloom.may_have(pairs, mixed, "leaf").join(mixed, "leaf", "left_semi")
    templates, path = written(_templates(src, inside, mixed, similarity, depth, levels, paths), "generalised")
    delete(docs.sparkSession, *paths[2:])
    paths[2:] = [path]
    some = bloom.may_have(pairs, templates.select("own").distinct(), "own").join(templates, ["leaf", "own"]).select("_id", "raw", "leaf", "template")
    keyed = pairs.select("_id", "raw", "leaf", F.col("own").alias("template"))
    docs_of = [F.countDistinct("_id").alias("n")] if min_docs > 2 else []
    found = f"n >= {min_docs}" if min_docs > 2 else "first <> last" if min_docs == 2 else "true"
    most = pairs.count() / HOT

    def recurring(rows: DataFrame) -> DataFrame:
        """(_id, raw) of the lines of `rows` that another document has first."""
        stats = rows.groupBy("leaf", "template").agg(F.min("_id").alias("first"), F.max("_id").alias("last"), F.count(F.lit(1)).alias("_lines"), *docs_of)
        stats, path = written(stats.filter(found).select("leaf", "template", "first", "_lines"), "recurring")
        paths.append(path)
        key = ["leaf", "template"]
        hot = F.broadcast(stats.filter(F.col("_lines") > most).select(*key, F.col("first").alias("_hot")))  # fewer than HOT, by their share
        cold = stats.filter(F.col("_lines") <= most).select(*key, "first", F.lit(0).alias("_salt"))
        some = bloom.may_have(rows, stats.select("template").distinct(), "template").join(hot, key, "left")
        salt = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("_id"), F.lit(997))).cast("int")  # rows of hot ones spread and meet nothing
        out = some.withColumn("_salt", salt).join(cold, [*key, "_salt"], "left")
        return out.filter(F.col("_id") != F.coalesce("_hot", "first")).select("_id", "raw")

    found = recurring(keyed).unionByName(recurring(some)).repartition("_id").groupBy("_id", _bucket(F.col("raw")).alias("_b")).agg(F.collect_set("raw").alias("_raws"))
    return found.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_b", "_raws"))).alias("_drop")), paths


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, levels: int = LEVELS) -> DataFrame:
    """All rows and columns; the text without the lines that recur, and `n_lines`, `n_dropped` (columns of those names are replaced).

    Null text stays null with no lines; an empty text is one blank line; rows with a null id count nowhere and stay as they are. Blank lines
    are never dropped. Of rows that repeat an id, all lose the same lines. A text that loses no line is unchanged to the byte. The result
    reads tables in the shared folder until its caller has written it.
    """
    drops, _ = dropped_lines(docs, id_col, text_col, depth, min_docs, similarity, levels)
    base = docs.drop("n_lines", "n_dropped")
    key, drop, stay = fresh_names(base.select("*", F.lit(0).alias("n_lines"), F.lit(0).alias("n_dropped")), "_id", "_drop", "_kept")
    joined = base.join(drops.select(F.col("_id").alias(key), F.col("_drop").alias(drop)), F.col(id_col) == F.col(key), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    hit = lambda h: F.coalesce(F.array_contains(F.try_element_at(F.col(drop), _bucket(h)), h), F.lit(False))
    kept = F.filter(lines, lambda x: ~F.transform(F.array(F.xxhash64(squeeze(x))), hit)[0])  # a line is hashed once
    breaks = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    out = joined.withColumns({stay: F.when(F.col(drop).isNotNull(), kept), "n_lines": F.coalesce(breaks + 1, F.lit(0))})
    out = out.withColumn("n_dropped", F.when(F.col(drop).isNotNull(), F.col("n_lines") - F.size(stay)).otherwise(0))
    out = out.withColumn(text_col, F.when(F.col(drop).isNotNull(), F.array_join(stay, "\n")).otherwise(F.col(text_col)))
    return out.drop(key, drop, stay)
