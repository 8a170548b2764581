"""Extension: uploads that arrive as a stream, announced in a landing folder as JSON lines, or with their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ops import mark_first
from ..sources.upload_store import ROWS, UploadStore

UPLOAD = "guid string, name string, received timestamp, trait_id bigint"
_COLUMNS = [c.split(" ")[0] for c in ROWS.split(", ")]


def read_uploads(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """A stream of uploads, each GUID once within the watermark."""
    rows = spark.readStream.schema(UPLOAD).json(path)
    return rows.withWatermark("received", delay).dropDuplicatesWithinWatermark(["guid"])


def write_uploads(rows: DataFrame, store: UploadStore, name: str, checkpoint: str, p_value_threshold: float = 5e-8, **trigger) -> StreamingQuery:
    """Commits a stream of rows (guid, name of the upload, snp, chr, bp, ea, oa, eaf, beta, se, p, ld_block) to the store, a commit a batch.

    A batch that runs again, as after a failure, has the same name and replaces its own rows. Leads are those of a batch's rows of an
    upload, so that an upload should come in one batch. Rows without a GUID or above the threshold are not kept.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        kept = batch.filter(F.col("guid").isNotNull() & (F.col("p") <= p_value_threshold)).withColumn("ld_block", F.col("ld_block").cast("string")).persist()
        try:
            led = mark_first(kept, ["guid", "ld_block"], ["p", "bp", "chr", "snp", "ea", "oa"], "is_lead")
            records = kept.groupBy("guid").agg(F.min("name").alias("name")).collect()  # a row for each upload of the batch
            store.write(f"{name}-{batch_id:012d}", led.select("guid", *_COLUMNS), [r.asDict() | {"p_value_threshold": p_value_threshold} for r in records])
        finally:
            kept.unpersist()

    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
