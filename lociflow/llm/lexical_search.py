"""Ranked lexical search as a product of sparse matrices, in blocks.

Scores are the product of the item-term matrix of multiplicities and the term-document matrix of int64 impacts. Items are dealt into
blocks of about ENTRIES entries, whose rows and vocabulary go to every task; documents are blocks as they are read. In a block of
documents the impacts are put in order of terms, so that a term is a row of the right matrix; a row of the product is merged from the
rows of its item's terms, each times its multiplicity (Gustavson). A task keeps the k best of each item over all its blocks; what the
tasks leave is reduced in two steps, by item and a part of the documents, then by item.

Texts are read once for each block of items: of a document its number of terms and the counts of the block's terms are written to the
shared folder. From that table come the number of documents, the number of terms and the documents of each term, over all documents.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import bound_batches, delete, uses_worker, written

K = 10
#: Entries of a block of items, about; bytes of a text that are split into terms at once; parts of the first reduction.
ENTRIES, CHUNK, PARTS = 1_000_000, 1 << 22, 64
#: Bytes of terms to themselves, A-Z to a-z; all other ASCII separates.
_TERMS = bytes(i if i > 127 else ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(256))


def count_terms(text: bytes, known: dict[bytes, int] | None = None) -> tuple[int, Counter]:
    """How many terms a text in UTF-8 has, and the counts of the known ones by their number (of all, by the term itself)."""
    data, n, counts, at = text.translate(_TERMS), 0, Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        n, at = n + len(words), end
        if known is None:
            counts.update(words)
            continue
        for word, c in Counter(words).items():
            if word in known:
                counts[known[word]] += c
    return n, counts


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """weight * (1e9 tf div (1000 tf + 8 m)) in int64, with m of the document's own number of terms."""
    m = 25 + (75 * n * docs) // terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest, ties to smaller ids."""
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _counted(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(_id, n, terms, tf): a sparse row for each document with a term; `docs` has _id and the text's bytes."""

    def rows(batches):
        uses_worker("lexical_search")
        for batch in batches:
            ids, n, lengths, terms, tf = [], [], [0], [], []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                size, counts = count_terms(text.as_py(), known)
                if size:
                    ids.append(own)
                    n.append(size)
                    terms.extend(counts)
                    tf.extend(counts.values())
                    lengths.append(len(terms))
            at = pa.array(lengths, pa.int32())
            of = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays(of, ["_id", "n", "terms", "tf"])

    return docs.mapInArrow(rows, "_id bigint, n bigint, terms array<int>, tf array<bigint>")


def _product(counted: DataFrame, items: list[tuple], weight: np.ndarray, docs: int, terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each task and item the k best; `items` are (number of the item, its terms, their multiplicities)."""

    def rows(batches):
        uses_worker("lexical_search")
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            each = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
            row = np.repeat(np.arange(len(ids)), each)
            value = impacts(weight[term], tf, batch.column(1).to_numpy(zero_copy_only=False)[row], docs, terms)
            order = np.argsort(term, kind="stable")
            row, value = row[order], value[order]
            start = np.searchsorted(term[order], np.arange(len(weight) + 1))
            total = np.zeros(len(ids), dtype=np.int64)
            for item, own, times in items:
                total[:] = 0
                for t, c in zip(own, times):
                    a, b = start[t], start[t + 1]
                    total[row[a:b]] += c * value[a:b]  # a document is there once
                old = found.get(item)
                hit = np.flatnonzero(total >= (old[0][-1] if old is not None and len(old[0]) == k else 1))
                if len(hit):
                    new = best(total[hit], ids[hit], k)
                    found[item] = new if old is None else best(*(np.concatenate(x) for x in zip(old, new)), k)
        item = [np.full(len(s), i, dtype=np.int64) for i, (s, _) in found.items()]
        of = [np.concatenate(x) if item else np.empty(0, dtype=np.int64) for x in (item, [d for _, d in found.values()], [s for s, _ in found.values()])]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in of], ["item", "doc_id", "score"])

    return counted.mapInArrow(rows, "item bigint, doc_id bigint, score bigint")


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of each item up to k documents with a score above 0, the highest first, ties to the smaller id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased; null and empty texts have none.
    Every row of documents counts in all statistics; those that repeat an id are documents of their own, one with a null id is never a
    result. Of items that repeat an id, null among them, the smallest text is asked. An item without a term that a document has gives no
    row, nor do empty tables. Other columns, whatever their names, are left out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("_text")).groupBy("item_id").agg(F.min("_text").alias("_text"))
    asked, path = written(asked.filter("_text is not null").withColumn("item", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * ENTRIES)))  # a term and its separator are about six characters
    source = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    parts, paths = [], []
    for block in range(blocks):
        known: dict[bytes, int] = {}
        rows = []
        for r in asked.filter(F.pmod("item", F.lit(blocks)) == block).select("item", F.col("_text").cast("binary").alias("_text")).toLocalIterator():
            counts = count_terms(bytes(r["_text"]))[1]
            rows.append((r["item"], [known.setdefault(t, len(known)) for t in counts], list(counts.values())))
        counted, at = written(_counted(source, known), "terms")
        n, terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(len(known), dtype=np.int64)
        for term, df in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # the block's terms at most
            weight[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        named = counted.filter(F.col("_id").isNotNull() & (F.size("terms") > 0))
        found, kept = written(_product(named, rows, weight, n, max(terms, 1), k), "found")
        delete(spark, at)
        parts.append(found)
        paths.append(kept)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = _top(found.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), ["item", "_part"], k)
    out, _ = written(_top(found, ["item"], k).join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    delete(spark, path, *paths)
    return out
