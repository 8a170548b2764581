"""Conformance bed: the domain tables derived from the driver's star schema (FIXTURES.md section 2).

The text of each table is SQL that Spark and DuckDB read alike, so that an oracle can start from the same inputs: Spark stores the
tables once, and the oracle derives them in its own statement. Only the bed is shared; every operator on top of it is written once with the DataFrame API and once, by hand, in oracle SQL.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Collection, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.rollups import KINDS, counts_of_kind
from ..schemas import SCHEMAS, normalise
from ..storage import shared_dir

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

BED: dict[str, str] = {
    "b_traits": """
        SELECT p_partkey AS id, concat(p_name, ' (', p_brand, ')') AS trait_name,
               CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END AS trait_category,
               CASE p_size % 5 WHEN 0 THEN 'Phenotype' WHEN 1 THEN 'Gene Expression' WHEN 2 THEN 'Plasma Protein'
                    WHEN 3 THEN 'Cell Trait' ELSE 'Methylation' END AS data_type,
               CAST(p_size * 1000 AS int) AS sample_size,
               CASE WHEN p_size % 2 = 0 THEN 'continuous' ELSE 'categorical' END AS category
        FROM part""",
    "b_genes": """
        SELECT s_suppkey AS id, s_name AS gene, concat('ENSG', CAST(s_suppkey AS varchar(20))) AS ensembl_id,
               CAST(s_nationkey + 1 AS varchar(20)) AS chr, s_suppkey * 1000 AS start_bp, s_suppkey * 1000 + 500 AS stop_bp,
               CASE WHEN s_suppkey % 2 = 0 THEN 'protein_coding' ELSE 'lncRNA' END AS gene_biotype
        FROM supplier""",
    "b_variants": """
        SELECT c_custkey AS id, concat('rs', CAST(c_custkey AS varchar(20))) AS snp, c_name AS display_snp,
               CAST(c_nationkey + 1 AS varchar(20)) AS chr, (c_custkey * 1009) % 1000003 AS bp, c_nationkey AS ld_block_id
        FROM customer""",
    "b_ld_blocks": """
        SELECT CAST(chr AS bigint) * 100 + CAST(floor(bp / 250000.0e0) AS bigint) AS id, chr, min(bp) AS start_bp, max(bp) AS stop_bp
        FROM b_variants GROUP BY chr, CAST(floor(bp / 250000.0e0) AS bigint)""",
    "b_rows": """
        SELECT l_orderkey AS grp,
               l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS study_extraction_id,
               l_suppkey AS study_id, l_suppkey AS gene_id, o_custkey AS variant_id, l_partkey AS trait_id,
               l_linenumber AS ln, l_returnflag AS rf, l_linestatus AS ls, CAST(l_quantity AS double) AS q,
               CAST(l_discount AS double) AS d, CAST(l_tax AS double) AS t
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber
                     ORDER BY l_shipdate, l_extendedprice, l_discount, l_tax, l_quantity) AS rn FROM lineitem) x
        JOIN orders ON l_orderkey = o_orderkey WHERE rn = 1""",
    "b_study_extractions": """
        SELECT r.study_extraction_id AS id, r.study_id, r.variant_id, v.snp, v.ld_block_id, v.chr, v.bp, r.d * 1.0e-6 AS min_p,
               CASE WHEN r.ls = 'F' THEN 'cis' ELSE 'trans' END AS cis_trans, g.gene, r.gene_id, r.trait_id, tr.trait_name,
               tr.trait_category, tr.data_type, CASE WHEN tr.data_type = 'Phenotype' THEN NULL ELSE n.n_name END AS tissue,
               v.display_snp, r.grp, r.ln, r.rf
        FROM b_rows r LEFT JOIN b_variants v ON r.variant_id = v.id LEFT JOIN b_genes g ON r.gene_id = g.id
        LEFT JOIN b_traits tr ON r.trait_id = tr.id LEFT JOIN supplier s ON r.gene_id = s.s_suppkey
        LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "b_coloc_groups": """
        SELECT grp AS coloc_group_id, study_id, id AS study_extraction_id, variant_id, ld_block_id, chr, bp, min_p, cis_trans,
               snp, display_snp, gene, gene_id, trait_id, trait_name, trait_category, data_type, tissue
        FROM b_study_extractions WHERE rf <> 'R' AND ln <= 5""",
    "b_rare_results": """
        SELECT grp AS rare_result_group_id, study_id, id AS study_extraction_id, variant_id, ld_block_id, chr, bp, min_p,
               snp, display_snp, gene, gene_id, trait_id, trait_name, trait_category, data_type, tissue
        FROM b_study_extractions WHERE rf = 'R' AND ln <= 5""",
    "b_associations": """
        SELECT study_id, variant_id, (q - 25) / 10.0e0 AS beta, CASE WHEN ln = 7 THEN NULL WHEN t = 0.08e0 THEN 1.0e0 ELSE t END AS se,
               d * 1.0e-6 AS p, CASE WHEN ln = 3 THEN NULL ELSE d * 10 END AS eaf, rf = 'A' AS imputed, study_extraction_id AS ord
        FROM b_rows""",
    "b_coloc_pairs": """
        SELECT a.study_extraction_id AS study_extraction_a_id, b.study_extraction_id AS study_extraction_b_id, v.ld_block_id,
               1 - round((a.d + b.d) * 5, 6) AS h3, round((a.d + b.d) * 5, 6) AS h4, a.t = b.t AS spurious
        FROM b_rows a JOIN b_rows b ON a.grp = b.grp AND a.study_extraction_id < b.study_extraction_id
        LEFT JOIN b_variants v ON a.variant_id = v.id WHERE a.rf <> 'R' AND b.rf <> 'R'""",
    "b_ld": """
        SELECT a.id AS lead_variant_id, b.id AS proxy_variant_id, a.ld_block_id, 1 - abs(a.id - b.id) / 400.0e0 AS r
        FROM b_variants a JOIN b_variants b ON a.ld_block_id = b.ld_block_id AND abs(a.id - b.id) <= 100""",
    "b_search_terms": """
        SELECT 'trait' AS type, trait_name AS name, CAST(NULL AS varchar(20)) AS alt_name, CAST(id AS varchar(20)) AS type_id,
               sample_size FROM b_traits
        UNION ALL SELECT 'gene', gene, ensembl_id, gene, CAST(NULL AS int) FROM b_genes""",
    "b_summary_stats": """
        SELECT user_id AS study_id, concat(CAST(user_id % 22 + 1 AS varchar(20)), ':', CAST(event_id AS varchar(20))) AS snp,
               CAST(user_id % 22 + 1 AS varchar(20)) AS chr, event_id AS bp, CASE WHEN event_type = 'error' THEN 1.0e0 ELSE 0.1e0 END AS se,
               CAST(value AS double) AS lbf_1, CAST(value AS double) / 100 AS beta
        FROM events""",
    "b_uploads": """
        SELECT o_orderkey AS upload_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-',
               substr(h, 17, 4), '-', substr(h, 21, 12)) AS guid, name
        FROM (SELECT o_orderkey, md5(CAST(o_orderkey AS varchar(20))) AS h, o_orderpriority AS name FROM orders
              WHERE o_orderpriority = '1-URGENT') x""",
    "b_upload_coloc_groups": """
        SELECT r.grp AS coloc_group_id, u.upload_id AS gwas_upload_id, CASE WHEN ln % 3 = 0 THEN r.study_id END AS study_id,
               CASE WHEN ln % 3 = 1 THEN r.study_id END AS existing_study_id, r.variant_id, r.trait_id,
               r.study_extraction_id AS ord
        FROM b_rows r JOIN b_uploads u ON r.grp = u.upload_id""",
    # Counts by trait, gene and symbol, which lists and searches read.
    "b_rollups": """
        SELECT kind, subject, CAST(count(DISTINCT e) AS bigint) AS num_study_extractions, CAST(count(DISTINCT c) AS bigint) AS num_coloc_groups,
               CAST(count(DISTINCT s) AS bigint) AS num_coloc_studies, CAST(count(DISTINCT r) AS bigint) AS num_rare
        FROM (SELECT 'trait' AS kind, CAST(trait_id AS varchar(20)) AS subject, id AS e, NULL AS c, NULL AS s, NULL AS r FROM b_study_extractions
              UNION ALL SELECT 'gene', CAST(gene_id AS varchar(20)), id, NULL, NULL, NULL FROM b_study_extractions
              UNION ALL SELECT 'symbol', gene, id, NULL, NULL, NULL FROM b_study_extractions
              UNION ALL SELECT 'trait', CAST(trait_id AS varchar(20)), NULL, coloc_group_id, study_id, NULL FROM b_coloc_groups
              UNION ALL SELECT 'gene', CAST(gene_id AS varchar(20)), NULL, coloc_group_id, study_id, NULL FROM b_coloc_groups
              UNION ALL SELECT 'symbol', gene, NULL, coloc_group_id, study_id, NULL FROM b_coloc_groups
              UNION ALL SELECT 'trait', CAST(trait_id AS varchar(20)), NULL, NULL, NULL, rare_result_group_id FROM b_rare_results
              UNION ALL SELECT 'gene', CAST(gene_id AS varchar(20)), NULL, NULL, NULL, rare_result_group_id FROM b_rare_results
              UNION ALL SELECT 'symbol', gene, NULL, NULL, NULL, rare_result_group_id FROM b_rare_results) x
        WHERE subject IS NOT NULL GROUP BY kind, subject""",
    # Posting lists of the groups: which a subject has rows in.
    "b_postings": """
        SELECT DISTINCT 'coloc' AS family, kind, subject, grp FROM (
          SELECT 'trait' AS kind, trait_id AS subject, coloc_group_id AS grp FROM b_coloc_groups
          UNION ALL SELECT 'gene', gene_id, coloc_group_id FROM b_coloc_groups
          UNION ALL SELECT 'variant', variant_id, coloc_group_id FROM b_coloc_groups) x WHERE subject IS NOT NULL AND grp IS NOT NULL
        UNION ALL SELECT DISTINCT 'rare', kind, subject, grp FROM (
          SELECT 'trait' AS kind, trait_id AS subject, rare_result_group_id AS grp FROM b_rare_results
          UNION ALL SELECT 'gene', gene_id, rare_result_group_id FROM b_rare_results
          UNION ALL SELECT 'variant', variant_id, rare_result_group_id FROM b_rare_results) y WHERE subject IS NOT NULL AND grp IS NOT NULL""",
}


def _needs(text: str) -> list[str]:
    """Names of bed tables that a text uses, dependencies first."""
    out: list[str] = []

    def visit(body: str) -> None:
        for name in BED:
            if re.search(rf"\b{name}\b", body) and name not in out:
                visit(BED[name])
                out.append(name)

    visit(text)
    return out


def oracle(text: str) -> str:
    """A self-contained DuckDB statement: the bed tables that `text` uses, then `text`, which may itself begin with WITH."""
    ctes = [f"{n} AS ({BED[n].strip()})" for n in _needs(text)]
    body = text.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*ctes, body[5:]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body



#: How the stored tables are laid out: range-partitioned and sorted by what lookups ask for, so that files and row groups are skipped.
LAYOUT = {"variants": ("chr", "bp"), "study_extractions": ("trait_id", "id"), "postings": ("family", "kind", "subject"), "associations": ("study_id", "variant_id"), "coloc_pairs": ("study_extraction_a_id",), "ld": ("lead_variant_id",), "summary_stats": ("study_id", "chr", "bp")}
#: Second copies in another order: of a table, by the column that they are asked by.
COPIES = {"associations": {"variant_id": ("variant_id", "study_id")}, "study_extractions": {c: (c, "id") for c in ("gene_id", "variant_id", "ld_block_id")}}
#: Tables in buckets of a column, about ROWS rows a bucket: joins and closures on it shuffle the other side only.
BUCKETS, ROWS, LEAST, AT_ONCE = {"coloc_groups": "coloc_group_id", "rare_results": "rare_result_group_id"}, 1_000_000, 8, 4
_SHELVES: dict[tuple[str, str], Shelf] = {}
_SEEN: dict[tuple[str, str], str] = {}


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Of the source files' paths, lengths and times, listed once for a session."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known in _SEEN:
        return _SEEN[known]
    jvm, conf, seen = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for t in RAW:
        at = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        files = at.getFileSystem(conf).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    _SEEN[known] = hashlib.md5(repr(sorted(seen)).encode()).hexdigest()
    return _SEEN[known]


def bucket_table(path: str) -> str:
    """The session's name for a table in buckets, which Spark knows by its catalog, not by its files."""
    return f"lociflow_{hashlib.md5(path.encode()).hexdigest()}"


def store_buckets(frame: DataFrame, path: str, column: str, n: int) -> None:
    """Writes a table of `n` buckets, a file each."""
    dealt = frame.repartition(n, column).sortWithinPartitions(column)
    dealt.write.bucketBy(n, column).sortBy(column).option("path", path).format("parquet").saveAsTable(bucket_table(path))


def open_buckets(spark: SparkSession, path: str, schema: StructType, column: str, n: int) -> DataFrame:
    """A table in buckets; a session that did not write it is told of its buckets first."""
    name = bucket_table(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _laid(frame: DataFrame, order: tuple | None) -> DataFrame:
    return frame.repartitionByRange(*order).sortWithinPartitions(*order) if order else frame


#: Tables that others read from their files; what else a table is derived from is derived again with it, cut to the columns that it needs.
KEPT = ("rows", "variants", "uploads")


#: Fact tables as filters of the stored rows, with the names that they give to the rows' columns.
FACTS = {
    "study_extractions": ("true", {"study_extraction_id": "id"}),
    "coloc_groups": ("rf <> 'R' and ln <= 5", {"grp": "coloc_group_id"}),
    "rare_results": ("rf = 'R' and ln <= 5", {"grp": "rare_result_group_id"}),
}


class Shelf:
    """The bed tables of `sf_dir` as Parquet in one folder of the session, each derived and written when it is first asked for.

    So a query writes the tables that it reads, and a table does not wait for those that only others read. The folder belongs to the
    session, which may delete it when it ends.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, version: str, folder: str):
        self.spark, self.sf_dir, self.version, self.folder = spark, sf_dir, version, folder
        self._schemas: dict[str, StructType] = {}
        self._buckets: dict[str, list] = {}
        self._made: dict[str, Future] = {}
        self._lock = Lock()

    def _once(self, key: str, make: Callable[[], object]):
        """What `make` gives, called by the first that asks; others wait for it. After a failure the next one tries again."""
        with self._lock:
            mine = key not in self._made
            made = self._made.setdefault(key, Future())
        if mine:
            try:
                made.set_result(make())
            except BaseException as e:
                del self._made[key]
                made.set_exception(e)
        return made.result()

    def path(self, name: str) -> str:
        """The path of a table, or of its copy in the order of a column (`<table>_by_<column>`), which is written if it is not there."""
        self._once(name, lambda: self._store(name))
        return f"{self.folder}/{name}.parquet"

    def counts_path(self, kind: str) -> str:
        """The path of the counts of one kind of subjects, which is a part of the table `rollups`."""
        path = f"{self.folder}/rollups.parquet/kind={kind}"

        def make() -> None:  # as they are kept up to date, not as the oracle counts them
            frame = normalise(counts_of_kind(kind, self._subjects(kind)), "rollups")
            self._schemas["rollups"] = frame.schema
            _laid(frame.drop("kind"), ("subject",)).write.mode("overwrite").parquet(path)

        self._once(f"rollups/{kind}", make)
        return path

    def derived(self, name: str) -> DataFrame:
        """A table for a query that reads few of its columns once: derived when it is read, and not stored, unless it was stored before."""
        if name not in BUCKETS and self.has(name):
            return self.spark.read.schema(self._schemas[name]).parquet(self.path(name))
        return self._derived(name)

    def has(self, name: str) -> bool:
        """Whether a table is stored."""
        made = self._made.get(name)
        return bool(made and made.done() and not made.exception())

    def keys(self, name: str, columns: Collection[str]) -> DataFrame:
        """Columns of a fact table as often as the stored rows have them: a table that is joined for none of them changes only how often a
        row is there. Columns that the rows, variants and genes do not have are derived with the table."""
        condition, names = FACTS[name]
        rows = self.spark.read.parquet(self.path("rows")).filter(condition).withColumnsRenamed(names)
        if "ld_block_id" in columns:
            places = self.spark.read.parquet(self.path("variants")).select(F.col("id").alias("_v"), "ld_block_id")
            rows = rows.join(places, F.col("variant_id") == F.col("_v"), "left")
        if "gene" in columns:
            genes = table(self.spark, self.sf_dir, "genes").select(F.col("id").alias("_g"), "gene")
            rows = rows.join(genes, F.col("gene_id") == F.col("_g"), "left")
        if not set(columns) <= set(rows.columns):
            return self.derived(name).select(*columns)
        kinds = {f.name: f.dataType for f in SCHEMAS[name].fields}
        return rows.select(*(F.col(c).cast(kinds[c]).alias(c) for c in columns))

    def schema(self, name: str) -> StructType:
        self.path(name)
        return self._schemas[name]

    def buckets(self, name: str) -> list | None:
        self.path(name)
        return self._buckets.get(name)

    def _derived(self, name: str) -> DataFrame:
        if name == "ld":
            frame = self._near_variants()
        else:
            kept = {d: self.path(d) for d in KEPT if d != name and f"b_{d}" in _needs(BED[f"b_{name}"])}
            frame = table(self.spark, self.sf_dir, name, kept, self.is_large)
        return normalise(frame, name) if name in SCHEMAS else frame

    def is_large(self, path: str) -> bool:
        """Whether a table has more than MANY rows, by its files' footers, counted once."""
        return self._once(f"large/{path}", lambda: self.spark.read.parquet(path).count() > MANY)

    def _subjects(self, kind: str) -> dict[str, DataFrame]:
        """The facts with the columns that are counted. No other table is joined: how often a row is repeated changes no number of different values."""
        rows = self.spark.read.parquet(self.path("rows")).withColumnRenamed("study_extraction_id", "id")
        if kind == "symbol":
            genes = table(self.spark, self.sf_dir, "genes").select(F.col("id").alias("_g"), "gene")
            rows = rows.join(genes, F.col("gene_id") == F.col("_g"), "left")
        rows = rows.select("id", "grp", "study_id", KINDS[kind], "rf", "ln")
        return {
            "study_extractions": rows,
            "coloc_groups": rows.filter("rf <> 'R' and ln <= 5").withColumnRenamed("grp", "coloc_group_id"),
            "rare_results": rows.filter("rf = 'R' and ln <= 5").withColumnRenamed("grp", "rare_result_group_id"),
        }

    def _near_variants(self, most: int = 100) -> DataFrame:
        """LD: variants of a block meet in bins of `most` ids and the two beside them, so that a block's pairs are not all looked at."""
        v = self.spark.read.parquet(self.path("variants")).select("id", "ld_block_id", F.floor(F.col("id") / most).alias("_bin"))
        a = v.select(F.col("id").alias("lead_variant_id"), "ld_block_id", F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)).alias("_bin"))
        apart = F.abs(F.col("lead_variant_id") - F.col("proxy_variant_id"))
        near = a.join(v.withColumnRenamed("id", "proxy_variant_id"), ["ld_block_id", "_bin"]).filter(apart <= most)
        return near.select("lead_variant_id", "proxy_variant_id", "ld_block_id", (1 - apart / 400.0).alias("r"))

    def _store(self, name: str) -> None:
        if name == "rollups":
            for kind in KINDS:
                self.counts_path(kind)
            return
        base, _, column = name.partition("_by_")
        path = f"{self.folder}/{name}.parquet"
        frame = self._derived(base)
        self._schemas[name] = frame.schema
        if name in BUCKETS:
            rows = self.spark.read.parquet(self.path("rows")).count()  # from the files' footers; the table has no more
            self._buckets[name] = [BUCKETS[name], max(LEAST, rows // ROWS)]
            store_buckets(frame, path, *self._buckets[name])
        else:
            _laid(frame, COPIES[base][column] if column else LAYOUT.get(name)).write.mode("overwrite").parquet(path)

    def whole(self) -> str:
        """The folder with every table, copy and a manifest, which is written last."""

        def make() -> str:
            names = [n.removeprefix("b_") for n in BED]
            with ThreadPoolExecutor(AT_ONCE) as pool:
                list(pool.map(self.path, [*names, *(f"{t}_by_{c}" for t in COPIES for c in COPIES[t])]))
            copies = {t: sorted(c) for t, c in COPIES.items()}
            tables = {n: self._schemas[n].jsonValue() for n in names}
            manifest = {"version": self.version, "tables": tables, "normal": [n for n in names if n in SCHEMAS], "copies": copies, "buckets": self._buckets}
            self.spark.range(1).select(F.lit(json.dumps(manifest)).alias("value")).write.mode("overwrite").text(f"{self.folder}/manifest.json")
            return self.folder

        return self._once("manifest", make)


def shelf(spark: SparkSession, sf_dir: str, version: str) -> Shelf:
    """The one shelf of a session and state of the sources."""
    key = (spark.sparkContext.applicationId, _fingerprint(spark, sf_dir))
    if key not in _SHELVES:
        _SHELVES[key] = Shelf(spark, sf_dir, version, f"{shared_dir(spark)}/tables-{key[1]}-{uuid.uuid4().hex}")
    return _SHELVES[key]


#: Tables with a row for each row of a raw one.
_SAME_ROWS = {"b_traits": "part", "b_genes": "supplier", "b_variants": "customer"}
#: Rows of a table that a join may broadcast at most. Spark goes by bytes in the files, and a column of ids is few there and many in memory.
MANY = 250_000
#: How the raw tables are read where Spark derives from them: the lines of an order together, as the first step and the join with orders need them.
_READ = {"lineitem": "/*+ REPARTITION(l_orderkey) */ "}


def table(spark: SparkSession, sf_dir: str, name: str, kept: Mapping[str, str] | None = None, large: Callable[[str], bool] = lambda path: False) -> DataFrame:
    """The bed table `name` (without its prefix) over the Parquet tables of `sf_dir`, and over the files `kept` of tables that it is derived
    from; those that are `large` are never broadcast."""
    kept, body, deps = kept or {}, BED[f"b_{name}"], []

    def visit(text: str) -> None:
        for d in BED:
            if re.search(rf"\b{d}\b", text) and d not in deps:
                if d.removeprefix("b_") not in kept:
                    visit(BED[d])
                deps.append(d)

    def merged(text: str) -> str:
        """The text with Spark's hint of a sort-merge join for those of its joined tables that are large."""
        of = lambda t: kept.get(t.removeprefix("b_")) or f"{sf_dir}/{_SAME_ROWS.get(t, t)}.parquet"
        many = [alias or t for t, alias in re.findall(r"JOIN (\w+)(?: (?!ON\b)(\w+))? ON", text) if (t[2:] in kept or _SAME_ROWS.get(t, t) in RAW) and large(of(t))]
        return re.sub(r"^\s*SELECT", f"SELECT /*+ MERGE({', '.join(many)}) */" if many else "SELECT", text.strip(), count=1)

    visit(body)
    of = [f"{d} AS (SELECT * FROM parquet.`{kept[d[2:]]}`)" if d[2:] in kept else f"{d} AS ({merged(BED[d])})" for d in deps]
    text = " ".join([body, *of])
    raws = [f"{t} AS (SELECT {_READ.get(t, '')}* FROM parquet.`{sf_dir}/{t}.parquet`)" for t in RAW if re.search(rf"\b{t}\b", text)]
    return spark.sql(("WITH " + ",\n".join([*raws, *of]) + "\n" if raws or of else "") + merged(body))
