"""Language ID by compression: the language whose dictionary makes the text smallest.

Text is lower-cased and everything but letters becomes one space; then it is cut into blocks of BLOCK bytes, all of them, and each is
compressed with one zstandard raw-content dictionary per language. The language of the smallest sum wins; equal sums go to the
language with more labelled rows, then to the smaller name. The margin is the share of bytes that the winner saves over the next.

A block that would not shrink is stored raw, with one size for all dictionaries; short texts often are. Where the two smallest sums are
equal, the text is measured again in overlapping pieces at the finest level, each behind a carrier that always shrinks, so that nothing
is stored raw. Sums that are equal even then say nothing about the language: the margin is 0 and rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import bound_batches, fresh_names, uses_worker

#: Bound of the sample that a dictionary is made from: different texts a language, characters a row, bytes of the dictionary.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 20_000, 65_536
#: The sample is the first of SPARE times as many different texts, which come below a share of the hashes.
SPARE = 4
LEVEL, BLOCK = 5, 4096
#: Of the second measure: level, bytes of a piece at least, pieces of a text up to PIECES * BLOCK bytes at most, and the carrier, of no letters.
FINE, PIECE, PIECES, CARRIER = 19, 12, 512, b"0" * 256
#: A narrower margin than this is a rejection.
MARGIN = 0.005


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, the language with most labelled rows first."""

    dictionaries: tuple[tuple[str, bytes], ...]


def letters(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}]+", " "))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learns from rows with text and language. What the driver gets is bounded by the sample, for any number of rows."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("_l"), F.col(text).alias("_t"))
    some = F.length("_t").between(1, SAMPLE_CHARS)
    stats = rows.groupBy("_l").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.when(some, F.xxhash64("_t"))).alias("d")).collect()  # one row a language
    counts = {r["_l"]: r["n"] for r in stats}
    share = F.create_map(*(F.lit(x) for r in stats for x in (r["_l"], min(1.0, SPARE * SAMPLE_ROWS / max(r["d"], 1))))) if stats else F.lit(None)
    place = F.shiftright("_h", 11) / float(1 << 53) + 0.5  # of the hash among all, from 0 to 1
    short = rows.filter(some).withColumn("_h", F.xxhash64("_t"))
    near = short.filter(place <= F.try_element_at(share, F.col("_l"))) if stats else short  # about SPARE * SAMPLE_ROWS different texts a language
    unlike = near.groupBy("_l", "_h").agg(F.min("_t").alias("_t"))
    first = unlike.withColumn("_n", F.row_number().over(Window.partitionBy("_l").orderBy("_h"))).filter(F.col("_n") <= SAMPLE_ROWS)
    texts: dict[str, dict[str, None]] = {k: {} for k in counts}
    for r in first.select("_l", letters(F.col("_t")).alias("_t"), "_n").orderBy("_l", "_n").collect():
        texts[r["_l"]][r["_t"]] = None
    made = ((k, "\n".join(texts[k]).encode()[:DICTIONARY_BYTES]) for k in sorted(counts, key=lambda k: (-counts[k], k)))
    return Model(tuple(made))


def _classifier(model: Model):
    import zstandard

    @F.pandas_udf("struct<lang:string,score:double>")
    def classify(texts: pd.Series) -> pd.DataFrame:
        uses_worker("language")
        coders = []
        for lang, data in model.dictionaries:
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if data else None
            if d:
                d.precompute_compress(level=LEVEL)
            coders.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress))
        fine = []

        @lru_cache(4096)
        def pieces(b: bytes) -> list[int]:
            """Sums over pieces that overlap and cover the whole text, without what the carrier takes."""
            for _, data in model.dictionaries if not fine else ():
                p = zstandard.ZstdCompressionParameters.from_level(FINE, dict_size=len(data), source_size=len(CARRIER) + PIECE, write_content_size=False, write_checksum=False, write_dict_id=False)
                c = zstandard.ZstdCompressor(compression_params=p, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if data else None).compress
                fine.append((c, len(c(CARRIER))))
            b = b" " + b + b" "
            step = min(BLOCK, -(-len(b) // PIECES))
            cut = [b[i : i + max(PIECE, step)] for i in range(0, max(1, len(b) - PIECE + step), step)]
            return [sum(len(c(CARRIER + x)) - own for x in cut) for c, own in fine]

        def best_of(sizes: list[int]) -> tuple[int, float]:
            best = min(range(len(sizes)), key=sizes.__getitem__)
            rest = min((s for i, s in enumerate(sizes) if i != best), default=0)
            return best, (1 - sizes[best] / rest if rest > 0 else 0.0) if len(sizes) > 1 else 1.0

        langs, scores = [], []
        for t in texts:
            if not t or not coders:
                langs.append("und")
                scores.append(0.0)
                continue
            b = t.encode()
            blocks = [b[i : i + BLOCK] for i in range(0, len(b), BLOCK)]
            best, score = best_of([sum(len(c(x)) for x in blocks) for _, c in coders])
            if score == 0:
                best, score = best_of(pieces(b))
            langs.append(coders[best][0])
            scores.append(score)
        return pd.DataFrame({"lang": langs, "score": scores})

    return classify


def identify(docs: DataFrame, model: Model, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """All rows and columns, and `lang_pred`, `score` (the margin, 0 to 1), `rejected` (columns of these names are replaced).

    Null texts and texts without a letter are `und` with score 0 and rejected; so is everything under a model without languages. Other
    texts of score 0 tell no two languages apart and are not rejected. With one language every other text has score 1. Whole texts are read, however long; repeated rows get the same answer.
    """
    bound_batches(docs.sparkSession)
    src = docs.drop("lang_pred", "score", "rejected")
    (p,) = fresh_names(src, "_p")
    out = src.withColumn(p, _classifier(model)(letters(F.col(text))))
    return out.withColumns({"lang_pred": F.col(f"{p}.lang"), "score": F.col(f"{p}.score")}).withColumn("rejected", (F.col("lang_pred") == "und") | ((F.col("score") > 0) & (F.col("score") < margin))).drop(p)
