"""Zip archives of gzipped tab-separated statistics: a Spark data source that plans tasks for members and streams these.

    spark.dataSource.register(StatsArchives)
    spark.read.format("stats_archives").option("paths", json.dumps([...])).load()

Archives are opened where they lie, by the file systems that pyarrow knows (local folders that all workers share, HDFS, object stores): of
an archive the plan reads its directory only, a task its own members, in batches. Up to TASKS members have a task each; of more, small
ones that follow each other in an archive share one, as a task reads the archive's directory again.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zipfile
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .formats import STATS, open_path

#: Bytes of a member that are parsed at once.
BATCH = 1 << 20
#: Members that have a task each, whatever their size; bytes after which a task that several share takes no further one, at most.
TASKS, SHARED = 1000, 64 << 20
_NAMES = [f.name.lower() for f in STATS.fields]


class Members(InputPartition):
    def __init__(self, archive: str, names: Sequence[str], error: str | None = None):
        self.archive, self.names, self.error = archive, list(names), error


class _Reader(DataSourceReader):
    def __init__(self, paths: Sequence[str], tasks: int):
        self.paths, self.tasks = list(paths), tasks

    def partitions(self) -> Sequence[InputPartition]:
        found, broken = [], []
        for path in self.paths:
            try:
                fs, at = open_path(path)
                with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    found += sorted((path, m.filename, m.compress_size) for m in z.infolist() if m.filename.endswith(".tsv.gz"))
            except (OSError, ValueError, zipfile.BadZipFile) as e:
                broken.append(Members(path, [""], f"{type(e).__name__}: {e}"))
        most = 0 if len(found) <= self.tasks else min(SHARED, sum(size for *_, size in found) // self.tasks)
        out, room = [], 0
        for path, name, size in found:
            if room <= 0 or out[-1].archive != path:
                out.append(Members(path, []))
                room = most
            out[-1].names.append(name)
            room -= size
        return out + broken

    def read(self, partition: Members) -> Iterator:
        import pyarrow as pa
        from pyarrow import csv

        names = ["archive", "member", *_NAMES, "error"]
        text = lambda value, n: pa.array([value] * n, pa.string())

        def batch(columns, member, n):
            columns = columns | {"archive": text(partition.archive, n), "member": text(member, n)}
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, pa.string())) for c in names], names)

        failures = (OSError, EOFError, KeyError, ValueError, zipfile.BadZipFile)
        left = iter(partition.names)
        try:
            if partition.error:
                raise OSError(partition.error)
            fs, at = open_path(partition.archive)
            with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                for member in left:
                    try:
                        with z.open(member) as packed, gzip.open(packed) as plain:
                            for part in _parsed(plain, csv, pa):
                                yield batch({c.lower(): part.column(i) for i, c in enumerate(part.schema.names) if c.lower() in _NAMES}, member, len(part))
                    except failures as e:
                        yield batch({"error": text(str(e) or type(e).__name__, 1)}, member, 1)
        except failures as e:  # of the archive: none of its members is read
            for member in left:
                yield batch({"error": text(str(e) or type(e).__name__, 1)}, member, 1)


def _parsed(plain, csv, pa) -> Iterator:
    """Batches of a member's rows, all columns as text."""
    header = plain.readline().decode().rstrip("\r\n").split("\t")
    convert = csv.ConvertOptions(column_types={c: pa.string() for c in header}, null_values=["NA"], strings_can_be_null=True, quoted_strings_can_be_null=False)
    try:
        yield from csv.open_csv(plain, csv.ReadOptions(column_names=header, block_size=BATCH), csv.ParseOptions(delimiter="\t"), convert)
    except pa.ArrowInvalid as e:
        if "Empty CSV" not in str(e):
            raise


class StatsArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stats_archives"

    def schema(self) -> str:
        return ", ".join(f"{n} string" for n in ("archive", "member", *_NAMES, "error"))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]), int(self.options.get("tasks", TASKS)))


def read_archives(spark: SparkSession, archives: DataFrame | Sequence[str], path: str = "path", tasks: int = TASKS) -> DataFrame:
    """Rows of all `*.tsv.gz` members of the archives that a list or a column names: archive, member, study_id, statistics, error.

    study_id is the member's base name without `_with_lbfs`; columns that a member lacks are null, and so are values that are no number of
    their column's kind. An archive or member that is missing or broken is a row with `error` and without statistics, after the rows that
    could be read. The driver sees names of archives and members only. Of more than `tasks` members, small ones that follow each other in
    an archive share a task.
    """
    if isinstance(archives, DataFrame):
        archives = sorted(r[0] for r in archives.select(path).filter(F.col(path).isNotNull()).distinct().collect())
    spark.dataSource.register(StatsArchives)
    raw = spark.read.format("stats_archives").option("paths", json.dumps(list(archives))).option("tasks", tasks).load()
    study = F.regexp_extract("member", r"([^/]*?)(?:_with_lbfs)?\.tsv\.gz$", 1)
    return raw.select("archive", "member", F.when(study != "", study).alias("study_id"), *(F.col(f.name.lower()).try_cast(f.dataType).alias(f.name.lower()) for f in STATS.fields), "error")


def write_archives(files: DataFrame, root: str) -> DataFrame:
    """Zip archives `<root>/<archive>.zip` of files, by rows (archive, member, path); the archives' paths.

    An archive is one task, which streams a file after the other into a new name and moves it to its own when it is whole; a task that
    runs again makes the same archive.
    """

    def pack(key, rows):
        import pandas as pd

        fs, folder = open_path(root)
        draft, done = f"{folder}/.{key[0]}-{uuid.uuid4().hex}", f"{folder}/{key[0]}.zip"
        fs.create_dir(folder)
        with fs.open_output_stream(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for member, path in sorted(zip(rows["member"], rows["path"])):
                source, at = open_path(path)
                with source.open_input_file(at) as f, z.open(zipfile.ZipInfo(member), "w", force_zip64=True) as to:
                    while chunk := f.read(BATCH):
                        to.write(chunk)
        fs.move(draft, done)
        return pd.DataFrame({"path": [f"{root}/{key[0]}.zip"]})

    return files.select("archive", "member", "path").groupBy("archive").applyInPandas(pack, "path string")
