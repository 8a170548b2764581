"""Token counts by a separator scan over flat, unindexed token files.

Files hold ids of a fixed width and nothing else; a document ends at an end id. They are read in blocks of a fixed size, wherever
documents begin: a vectorised search finds the end ids of a block, and gives the lengths of the documents that lie inside it. The
document that a block begins in is stitched by a prefix scan over the blocks of the file: tokens since the last end id before it, and
the number of documents before it. The scan has one short row a block; lengths stay where they were found.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import fresh_path, written

BLOCK_TOKENS, WIDTH = 1 << 20, 2


def _fs(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, path: str, ranks: bytes, pattern: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Flat files of 16-bit ids under `path` (a URI that all executors reach), one per partition, documents in order, an end id after each.

    Returns where each document went: doc_id, file, ordinal. A file's name holds its attempt, so that a task that is run again, for a
    lost executor, never touches a file that others may read; files that no row names are left-overs. `ranks`: a tiktoken file.
    """
    def write(batches):
        import base64
        import uuid

        import numpy as np
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        coder = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        fs, base = _fs(path)
        fs.create_dir(base, recursive=True)
        name, out, n, found = f"{uuid.uuid4().hex}.bin", None, 0, []
        for pdf in batches:
            for i, t in zip(pdf["_id"], pdf["_text"]):
                out = out or fs.open_output_stream(f"{base}/{name}")
                ids = coder.encode_ordinary(t) if isinstance(t, str) else []
                out.write(np.array([*ids, end], dtype="<u2").tobytes())
                found.append(i)
            if out:
                yield pd.DataFrame({"doc_id": pd.Series(found, dtype=object), "file": name, "ordinal": range(n, n + len(found))})
                n, found = n + len(found), []
        if out:
            out.close()

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return src.mapInPandas(write, f"doc_id {kind}, file string, ordinal bigint")


def count_tokens(spark: SparkSession, path: str, end: int, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document of the files under `path`: file (base name), ordinal (from 0), n_tokens without the end id, ended.

    Tokens after the last end id of a file are one more document, with ended false. An empty file has none. Bytes after the last whole
    id of a file are ignored.
    """
    files = spark.read.format("binaryFile").load(path).select("path", (F.col("length") / width).cast("bigint").alias("total"))
    blocks = files.filter("total > 0").select("path", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / block_tokens))).alias("block"))

    def scan(batches):
        import numpy as np
        for pdf in batches:
            for p, total, block in zip(pdf["path"], pdf["total"], pdf["block"]):
                fs, at = _fs(p)
                n = min(block_tokens, total - block * block_tokens)
                with fs.open_input_file(at) as f:
                    f.seek(block * block_tokens * width)
                    ids = np.frombuffer(f.read(n * width), dtype=f"<u{width}")
                ends = np.flatnonzero(ids == end)
                some = len(ends) > 0
                yield pd.DataFrame({"file": [p.rsplit("/", 1)[-1]], "block": [block], "n_tokens": [n], "n_ends": [len(ends)], "first": [int(ends[0]) if some else -1], "last": [int(ends[-1]) if some else -1], "inner": [(np.diff(ends) - 1).astype(np.int64) if some else np.array([], dtype=np.int64)]})

    few = max(8, spark.sparkContext.defaultParallelism * 2)
    found, _ = written(blocks.repartition(few, "path", "block").mapInPandas(scan, "file string, block bigint, n_tokens bigint, n_ends bigint, first bigint, last bigint, inner array<bigint>"), "blocks")
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("block") * block_tokens
    after = F.when(F.col("n_ends") > 0, begin + F.col("last") + 1)
    scanned = found.select("file", "block", (begin - F.coalesce(F.max(after).over(w), F.lit(0))).alias("carry"), F.coalesce(F.sum("n_ends").over(w), F.lit(0)).alias("before"))
    inside = found.filter("n_ends > 0").join(scanned, ["file", "block"])
    docs = inside.select("file", "before", F.posexplode(F.concat(F.array(F.col("carry") + F.col("first")), F.col("inner"))).alias("pos", "n_tokens"))
    docs = docs.select("file", (F.col("before") + F.col("pos")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = found.groupBy("file").agg(F.sum("n_ends").alias("ordinal"), (F.sum("n_tokens") - F.coalesce(F.max(after), F.lit(0))).alias("n_tokens"))
    return docs.unionByName(rest.filter("n_tokens > 0").select("file", "ordinal", "n_tokens", F.lit(False).alias("ended")))


def document_token_counts(docs: DataFrame, ranks: bytes, pattern: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every document, through flat files in the shared folder: written, then scanned without an index.

    Null and empty texts have no token. Rows that repeat an id are counted each; a null id stays null; other columns, whatever their
    names, are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    where, _ = written(write_token_files(docs, path, ranks, pattern, end, id_col, text_col), "where")
    if where.isEmpty():
        return where.select("doc_id", F.lit(0).cast("bigint").alias("n_tokens"))
    counts = count_tokens(spark, path, end)
    return where.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
