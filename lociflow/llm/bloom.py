"""Bloom filters made and asked with SQL functions only.

A `Bloom` is a byte string of at most `bits` / 8 bytes that goes into the plan; the driver gets it as one 4 KB bitmap per 32,768 bits.
It suits small filters: a literal of a megabyte makes planning slow. `may_have` is a filter of 4 KB bitmaps, each
for one range of hashes, as many as the number of keys asks for up to a bound, that is broadcast as a table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .shared import fresh_names

BUCKET = 32768
#: Of `may_have`: bits and hash functions a key, and bitmaps at most (32 MB).
PER_KEY, HASHES, MOST = 8, 4, 8192


@dataclass(frozen=True)
class Bloom:
    bits: int
    hashes: int
    data: bytes
    seed: int = 0

    def has(self, key: Column) -> Column:
        """False for no key that was put in; null keys are not in."""
        bits = F.unhex(F.lit(self.data.hex()))
        out = F.lit(True)
        for pos in positions(key, self.bits, self.hashes, self.seed):
            out = out & _bit(bits, pos)
        return key.isNotNull() & out


def positions(key: Column, bits: int, hashes: int, seed: int = 0) -> list[Column]:
    a, b = F.pmod(F.xxhash64(key, F.lit(2 * seed)), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(2 * seed + 1)), F.lit(bits))
    return [F.pmod(a + b * i, F.lit(bits)) if i else a for i in range(hashes)]


def sized(keys: float, rate: float) -> tuple[int, int]:
    """Bits and hash functions for so many keys at a rate of false positives."""
    per_key = max(1.0, 1.4427 * math.log2(1 / rate))
    return max(64, math.ceil(per_key * max(keys, 1))), max(1, round(per_key * 0.6931))


def build(keys: DataFrame, column: str, bits: int, hashes: int, seed: int = 0) -> Bloom:
    """The filter of all non-null keys, gathered as bitmaps that are merged before the shuffle."""
    k = F.col(column)
    pos = keys.filter(k.isNotNull()).select(F.explode(F.array(*positions(k, bits, hashes, seed))).alias("p"))
    maps = pos.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bitmap"))
    data = bytearray(math.ceil(bits / BUCKET) * BUCKET // 8)
    for r in maps.collect():  # one row of 4 KB per bucket of the chosen size
        at = (r["bucket"] - 1) * BUCKET // 8
        data[at : at + BUCKET // 8] = r["bitmap"]
    return Bloom(bits, hashes, bytes(data[: math.ceil(bits / 8)]), seed)


def _asked(df: DataFrame, keys: DataFrame, column: str, buckets: int | None, how: str) -> tuple[DataFrame, Column]:
    """`df` with the bitmaps of its keys' ranges, and whether a row's key may be among `keys`."""
    k, (bucket, bitmap) = F.col(column), fresh_names(df, "_bucket", "_bitmap")
    if buckets is None:
        buckets = min(MOST, max(16, 1 << max(0, math.ceil(math.log2(max(1, keys.count()) * PER_KEY / BUCKET)))))
    at = F.pmod(F.xxhash64(k), F.lit(buckets)).alias(bucket)
    spots = lambda: positions(F.xxhash64(k, F.lit(2)), BUCKET, HASHES)
    maps = keys.filter(k.isNotNull()).select(at, F.explode(F.array(*spots())).alias("p")).groupBy(bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias(bitmap))
    cond = F.lit(True)
    for pos in spots():
        cond = cond & _bit(F.col(bitmap), pos)
    return df.withColumn(bucket, at).join(F.broadcast(maps), bucket, how), cond


def may_have(df: DataFrame, keys: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """Rows of `df` whose key may be in `keys`, never without one that is.

    Broadcasts one bitmap of 4 KB a bucket: as many as the count of keys asks for, at most MOST. With more keys than those hold well,
    more rows pass, and whoever joins after it shuffles more.
    """
    out, cond = _asked(df, keys, column, buckets, "inner")
    return out.filter(cond).select(df.columns)


def has_not(df: DataFrame, keys: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """The rows that `may_have` leaves out, those of a null key among them."""
    out, cond = _asked(df, keys, column, buckets, "left")
    return out.filter(~F.coalesce(cond, F.lit(False))).select(df.columns)


def _bit(bits: Column, pos: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return F.getbit(byte, (pos % 8).cast("int")) == 1
