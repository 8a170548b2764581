"""Where uploads are kept: Parquet folders that a reader sees once a commit names them.

    <root>/data/folder=<commit>-<random>/guid=<guid>/*.parquet     rows of a write, never changed
    <root>/commits/<commit>.json                                   the folder that holds the commit's rows, and the uploads' records

A write makes a new folder, then its commit file under a name of its own, and last moves that over the commit file. So a reader sees the
old rows or the new ones, whatever fails on the way, and a write that is repeated replaces itself: a commit is named by the upload's GUID,
or by the stream and its batch. Folders that no commit names are left behind by failed and by replaced writes; `vacuum` removes them. Two
writers of one commit are not told from each other: the later one stays.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.scalars import GUID
from ..storage import file_system, replace_text
from .uploads import check_columns, check_upload, upload_normalise

RECORD = "guid string, name string, email string, category string, is_published boolean, doi string, should_be_added boolean, ancestry string, sample_size bigint, reference_build string, p_value_threshold double, compare_with array<string>"
COMMIT = f"commit string, folder string, records array<struct<{RECORD}>>"
ROWS = "snp string, chr string, bp bigint, ea string, oa string, eaf double, beta double, se double, p double, ld_block string, is_lead boolean"


class UploadStore:
    """Uploads under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _commit(self, commit: str, folder: str, records: Sequence[dict]) -> None:
        schema = T._parse_datatype_string(COMMIT)
        text = self.spark.createDataFrame([(commit, folder, [tuple(r.get(f.name) for f in schema["records"].dataType.elementType.fields) for r in records])], schema).select(F.to_json(F.struct("*"))).first()[0]
        replace_text(self.spark, f"{self.root}/commits/{commit}.json", text)

    def write(self, commit: str, rows: DataFrame, records: Sequence[dict]) -> None:
        """`rows`, with a column guid, as the rows of a commit."""
        if not re.match(r"^[0-9A-Za-z_-]+$", commit):
            raise ValueError("a commit is named by letters, digits, hyphens and underscores")
        folder = f"{commit}-{uuid.uuid4().hex}"
        rows.write.partitionBy("guid").parquet(f"{self.root}/data/folder={folder}")
        self._commit(commit, folder, records)

    def commits(self) -> DataFrame:
        """The commits there are: a row each, with the folder and the records of its uploads."""
        fs, at = file_system(self.spark, f"{self.root}/commits")
        return self.spark.read.schema(COMMIT).json(f"{self.root}/commits") if fs.exists(at) else self.spark.createDataFrame([], COMMIT)

    def records(self) -> DataFrame:
        """One row of each upload: its record, that of the last commit by name if it came with several."""
        return self.commits().select("commit", F.inline("records")).groupBy("guid").agg(F.max_by(F.struct("*"), "commit").alias("r")).select("r.*").drop("commit")

    def rows(self, guid: str | None = None) -> DataFrame:
        """Rows of all commits, or of one upload: then only the folders of commits that name it are read, and of these its own files."""
        found = self.commits()
        if guid is not None:
            found = found.filter(F.exists("records", lambda r: r["guid"] == guid))
        folders = [r["folder"] for r in found.select("folder").collect()]  # names of commits, not of rows
        schema = f"{ROWS}, guid string"
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/data/folder={f}" for f in sorted(folders)]
        out = self.spark.read.schema(f"{schema}, folder string").option("basePath", f"{self.root}/data").parquet(*paths).drop("folder")
        return out if guid is None else out.filter(F.col("guid") == guid)

    def vacuum(self) -> int:
        """Removes folders that no commit names; to be called when nothing writes. How many there were."""
        keep = {r["folder"] for r in self.commits().select("folder").collect()}
        fs, at = file_system(self.spark, f"{self.root}/data")
        gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().removeprefix("folder=") not in keep] if fs.exists(at) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def upload(self, raw: DataFrame, column_names: dict[str, str], name: str, email: str, sample_size: int, guid: str | None = None, p_value_threshold: float = 5e-8, category: str = "continuous", ancestry: str = "EUR", reference_build: str = "GRCh38", is_published: bool = False, doi: str | None = None, should_be_added: bool = False, compare_with: Sequence[str] = (), n_bytes: int = 0, blocks: DataFrame | None = None) -> str:
        """Checks, normalises and commits a study; its GUID, a new one unless it is given. A repeated upload of a GUID replaces it."""
        check_upload(name, p_value_threshold, category, ancestry, sample_size, reference_build, n_bytes, compare_with, email)
        check_columns(column_names)
        guid = guid or str(uuid.uuid4())
        if not re.match(GUID, guid):
            raise ValueError("not a GUID")
        rows = upload_normalise(raw, column_names, p_value_threshold, blocks=blocks)
        rows = rows.withColumn("ld_block", F.col("ld_block").cast("string")).withColumn("guid", F.lit(guid))
        given = dict(guid=guid, name=name, email=email, category=category, is_published=is_published, doi=doi, should_be_added=should_be_added, ancestry=ancestry, sample_size=sample_size, reference_build=reference_build, p_value_threshold=p_value_threshold, compare_with=list(compare_with))
        self.write(guid, rows, [given])
        return guid
