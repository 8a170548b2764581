"""Readers of exchanged formats: columnar JSON, and gzipped tab-separated statistics, zipped or not."""

from __future__ import annotations

import gzip
import io
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..storage import file_system

STATS = T.StructType([T.StructField(n, T.StringType()) for n in ("SNP", "CHR")] + [T.StructField("BP", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("EA", "OA")] + [T.StructField(n, T.DoubleType()) for n in ("EAF", "Z", "BETA", "SE", "P")] + [T.StructField("imputed", T.BooleanType())] + [T.StructField(f"LBF_{i}", T.DoubleType()) for i in range(1, 11)])


def decode_rows(df: DataFrame, json_column: str, prefix: str, schema: T.StructType) -> DataFrame:
    """`{<prefix>_column_names: [...], <prefix>_rows: [[...], ...]}` to rows of `schema`; no rows give an empty frame."""
    kind = f"struct<{prefix}_column_names:array<string>,{prefix}_rows:array<array<string>>>"
    j = df.select(F.from_json(json_column, kind).alias("j"))
    rows = j.select(F.col(f"j.{prefix}_column_names").alias("n"), F.explode(f"j.{prefix}_rows").alias("r"))
    cell = lambda name: F.try_element_at("r", F.array_position("n", F.lit(name)).cast("int"))
    return rows.select(*(F.when(F.array_contains("n", f.name), cell(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields))


def open_path(path: str):
    """pyarrow's file system and its own path of an absolute path or URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """Statistics as gzipped tab-separated files with upper-case headers, in a folder for each study (`study_id=<id>`).

    Tasks write the files of their studies one after the other, under a name that readers skip until a file is whole: a study of few rows
    costs its own bytes, and the driver moves no file. A study of many rows is dealt to several tasks, a file each; a task that runs
    again makes the same files. Where pyarrow knows no file system for the path, Spark writes them.
    """
    known = {f.name.lower(): f.name for f in STATS.fields}
    columns = [F.col(c).alias(known[c.lower()]) for c in stats.columns if c.lower() in known]
    dealt = stats.select("study_id", *columns).hint("rebalance", "study_id")
    try:
        open_path(path)
    except (OSError, ValueError, ImportError):
        dealt.write.partitionBy("study_id").option("sep", "\t").option("header", True).option("nullValue", "NA").option("emptyValue", "").option("compression", "gzip").csv(path)
        return
    cells = dealt.select(F.col("study_id").cast("string").alias("study_id"), *(F.col(c.name).cast("string").alias(c.name) for c in dealt.schema.fields[1:]))
    header = "\t".join(cells.columns[1:])

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = open_path(path)
        task, study, out, n = TaskContext.get().partitionId(), None, None, 0

        def close():
            out[0].close(), out[1].close()
            fs.move(out[2], out[3])

        for batch in batches:
            ids, *values = (c.to_pylist() for c in batch.columns)
            for i, row in zip(ids, zip(*values) if values else ((),) * len(ids)):
                if out is None or i != study:
                    if out:
                        close()
                    study, n = i, n + 1
                    folder = f"{root}/study_id={_NO_STUDY if i is None else _folder(i)}"
                    fs.create_dir(folder)
                    draft = f"{folder}/.part-{task:05d}-{uuid.uuid4().hex}"
                    raw = fs.open_output_stream(draft)
                    out = io.TextIOWrapper(gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6, mtime=0), "utf-8", newline=""), raw, draft, f"{folder}/part-{task:05d}.tsv.gz"
                    out[0].write(header + "\n")
                out[0].write("\t".join(map(_cell, row)) + "\n")
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    cells.sortWithinPartitions("study_id").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()  # one row


#: The folder of rows without a study, as Spark names it.
_NO_STUDY = "__HIVE_DEFAULT_PARTITION__"


def _folder(study: str) -> str:
    """A study's id with the characters escaped that Spark escapes in names of folders."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\\x7f{[]^" or ord(c) < 32 else c for c in study) or _NO_STUDY


def _cell(value: str | None) -> str:
    """A value as Spark's reader of tab-separated text takes it: NA is null, and what would end a cell or begin a quoted one is quoted."""
    if value is None:
        return "NA"
    if any(c in value for c in "\t\n\r\"") or value != value.strip():
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return value


def arrival(df: DataFrame) -> DataFrame:
    """A frame read from files, with `ord`: the place of each row in the files by path, from 0, without gaps.

    A task reads the rows of a piece of a file in their order, so that a row's place is its place in the piece, and the number of rows in
    the pieces before it: of all files by path, and of a file by the piece's start. The numbers do not depend on how files are cut or dealt
    to tasks; counting the pieces reads the files once more, without their columns.
    """
    mark = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    pieces = mark.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    files = pieces.groupBy("_file").agg(F.sum("_n").alias("_rows"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("_file", before("_rows", Window.orderBy("_file")).alias("_past"))  # a row a file
    pieces = pieces.select("_file", "_block", (before("_n", Window.partitionBy("_file").orderBy("_block")) - F.col("_first")).alias("_shift"))
    out = mark.join(pieces.join(files, "_file"), ["_file", "_block"])
    return out.select(*df.columns, (F.col("_at") + F.col("_shift") + F.col("_past")).alias("ord"))


def read_stats(spark: SparkSession, paths: str | Sequence[str], ordered: bool = False, located: bool = False) -> DataFrame:
    """`*.tsv.gz` files with a header that may miss columns; NA is null, names are lower-cased.

    study_id is the folder's where files lie in folders `study_id=<id>`, else the file's base name without `_with_lbfs`. `ordered` adds
    `ord`, the order of arrival (see `arrival`), which keep-first operators need; `located` adds `_uri`, the file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/study_id=([^/]+)/[^/]*$", 1)  # of a file that is named itself
    name = F.when(folder != "", folder).otherwise(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:_with_lbfs)?\.[^.]+\.[^.]+$", 1))
    raw = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).option("nullValue", "NA").csv(paths)
    raw = raw.withColumn("study_id", F.col("study_id").cast("string")) if "study_id" in raw.columns else raw.select("*", name.alias("study_id"))
    raw = raw.withColumn("_uri", F.regexp_replace(F.col("_metadata.file_path"), "^file:///", "file:/")) if located else raw
    raw = arrival(raw) if ordered else raw
    have = {c.lower(): c for c in raw.columns}
    return raw.select("study_id", *(["ord"] if ordered else []), *(["_uri"] if located else []), *((F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name.lower()) for f in STATS.fields))


def read_located(spark: SparkSession, rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Statistics of the files that the column `path` of a table names, and the rows of the table whose file is missing.

    Rows of the files have the table's path and its other columns too, those of a name that statistics have left out. Files that several
    rows name are read once. The driver sees names of files only, and lists each of their folders once.
    """
    given = [r[0] for r in rows.select(path).filter(F.col(path).isNotNull()).distinct().collect()]
    there, seen = {}, {}
    for name in given:
        fs, at = file_system(spark, name)
        at = fs.makeQualified(at)
        folder = at.getParent().toString()
        if folder not in seen:
            seen[folder] = {s.getPath().toString() for s in fs.listStatus(at.getParent())} if fs.exists(at.getParent()) else set()
        if at.toString() in seen[folder]:
            there[name] = at.toString()
    found = spark.createDataFrame(list(there.items()), f"`{path}` string, _uri string")
    missing = rows.join(found, path, "left_anti")
    stats = read_stats(spark, list(there.values()), located=True) if there else spark.createDataFrame([], T.StructType([T.StructField("study_id", T.StringType()), T.StructField("_uri", T.StringType()), *(T.StructField(f.name.lower(), f.dataType) for f in STATS.fields)]))
    keep = [c for c in rows.columns if c == path or c.lower() not in {x.lower() for x in stats.columns}]
    return stats.join(found, "_uri").drop("_uri").join(rows.select(keep), path), missing


def read_stats_zip(spark: SparkSession, path: str) -> DataFrame:
    """Zip files of `*.tsv.gz` members: each archive is read whole by one task, each member's rows carry its base name."""
    names = [f.name.lower() for f in STATS.fields]
    schema = T.StructType([T.StructField("study_id", T.StringType()), *(T.StructField(n, T.StringType()) for n in names)])

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(m for m in z.namelist() if m.endswith(".tsv.gz")):
                        base = member.rsplit("/", 1)[-1].rsplit(".", 2)[0].removesuffix("_with_lbfs")
                        for part in pd.read_csv(io.BytesIO(gzip.decompress(z.read(member))), sep="\t", dtype=str, na_values=["NA"], keep_default_na=False, chunksize=100_000):
                            part.columns = [c.lower() for c in part.columns]
                            part = part.reindex(columns=names)
                            yield part.astype(object).where(part.notna(), None).assign(study_id=base)[["study_id", *names]]

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)
    return raw.select("study_id", *(F.col(f.name.lower()).cast(f.dataType) for f in STATS.fields))
