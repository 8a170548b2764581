"""Best-fit packing with Martello-Toth dominance reduction.

Documents become tokens and one end id each; only those longer than a sequence are cut. Then only the number of pieces of each length
matters: at most `capacity` counts, which the driver gets. On these it plans whole classes of equal sequences at once:

1. Reduction. A piece of length j whose best companion k (the longest that fits) completes the sequence, or beside which nothing, or
   one piece only, or two whose sum never exceeds k, can fit: {j, k} (or {j}) dominates every other set with j, so that some best
   packing holds it, and it is fixed. This is repeated until nothing more can be fixed.
2. The rest is packed best fit decreasing.

The plan is a list of runs (length, first rank, first sequence, offset), a few for each length. Pieces get their rank among those of
their length from ranks in hashed parts of it and the parts' counts, so a length that a third of all pieces has is no single task.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .shared import bound_batches, memory, uses_worker, written

CAPACITY, END = 2048, 0
#: Pieces of one length that are ranked together, about.
PART = 200_000
#: Most entries in a worker's memory of encoded words.
KEPT = 500_000


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, word by word through the tokenizers library.

    The vocabulary drops white space, so text between white space is encoded alone; words of letters go to the model without the steps
    before it, which are applied here: composed form, lower case by character, bytes as letters. Texts with separators that Python
    takes for white space and Unicode does not are encoded whole.
    """

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        from .bpe import byte_letters

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letter = {b: c for c, b in byte_letters().items()}
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        import unicodedata

        core = word.rstrip(".,")
        plain = core.lower() if core.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", core)))
        if not plain.isalpha():  # also where lower case ends in a mark, which the vocabulary joins with what follows
            return self._whole(word)
        if len(core) < len(word):
            return self._get(core) + self._get(word[len(core) :])
        return _bytes([t.id for t in self.model.tokenize(plain if plain.isascii() else "".join(map(self.letter.__getitem__, plain.encode())))])

    def _get(self, word: str) -> bytes:
        x = self.known.get(word)
        if x is None:
            x = self._word(word)
            if len(word) <= 64:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[word] = x
        return x

    def encode(self, text: str) -> bytes:
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return self._whole(text)
        known, get = self.known.get, self._get
        return b"".join([known(w) or get(w) for w in text.split()])


_ENCODERS: dict[int, Encoder] = {}
memory("packing", _ENCODERS.clear)


def encoder(text: str) -> Encoder:
    key = hash(text)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(text)
    return _ENCODERS[key]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids if asked for. `tokenizer` is the file's text."""
    kind = "array<struct<length:bigint,crc:bigint,ids:binary>>" if with_ids else "array<struct<length:bigint,crc:bigint>>"

    @F.pandas_udf(kind)
    def cut(texts: pd.Series) -> pd.Series:
        uses_worker("packing")
        e, last = encoder(tokenizer), end.to_bytes(4, "little")
        out = []
        for t in texts:
            b = (e.encode(t) if t else b"") + last
            parts = [b[i : i + 4 * capacity] for i in range(0, len(b), 4 * capacity)]
            out.append([{"length": len(p) // 4, "crc": zlib.crc32(p)} | ({"ids": p} if with_ids else {}) for p in parts])
        return pd.Series(out, dtype=object)

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(cut(F.col(text_col))).alias("piece", "_p"))
    more = [F.col("_p.ids").alias("ids")] if with_ids else []
    return rows.select("doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.col("_p.length").alias("length"), F.col("_p.crc").alias("ids_crc32"), *more)


class Plan:
    """Runs of equal sequences for counts of lengths; see the module."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.n, self.sequences = capacity, [0] * (capacity + 1), 0
        for length, count in counts.items():
            self.n[length] += count
        self.ranks: dict[int, int] = defaultdict(int)
        self.runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length: first rank, first sequence, offset
        while self._reduce():
            pass
        self.reduced = self.sequences
        self._best_fit()

    def _put(self, length: int, bins: int, first: int, offset: int) -> None:
        if bins:
            self.runs[length].append((self.ranks[length], first, offset))
            self.ranks[length] += bins
            self.n[length] -= bins

    def _fix(self, bins: int, *lengths: int) -> None:
        offset = 0
        for x in lengths:
            self._put(x, bins, self.sequences, offset)
            offset += x
        self.sequences += bins

    def _reduce(self) -> bool:
        n, cap, changed = self.n, self.capacity, False
        for j in range(cap, 0, -1):
            while n[j]:
                room = cap - j
                n[j] -= 1
                small = self._smallest(3)
                k = next((x for x in range(room, 0, -1) if n[x]), 0)
                n[j] += 1
                if not k:
                    self._fix(n[j], j)
                elif k == room or len(small) < 2 or small[0] + small[1] > room or ((len(small) < 3 or sum(small) > room) and self._pair(j, room) <= k):
                    self._fix(n[j] // 2 if k == j else min(n[j], n[k]), j, k)
                else:
                    break
                changed = True
        return changed

    def _smallest(self, most: int) -> list[int]:
        out: list[int] = []
        for x in range(1, self.capacity + 1):
            out += [x] * min(self.n[x], most - len(out))
            if len(out) == most:
                break
        return out

    def _pair(self, j: int, room: int) -> int:
        """Largest sum up to `room` of two pieces besides one of length j."""
        self.n[j] -= 1
        sizes = [x for x in range(1, room) if self.n[x]]
        best, a, b = 0, 0, len(sizes) - 1
        while a <= b:
            s = sizes[a] + sizes[b]
            if s > room or a == b and self.n[sizes[a]] < 2:
                b -= 1
            else:
                best = max(best, s)
                a += 1
        self.n[j] += 1
        return best

    def _best_fit(self) -> None:
        n, cap = self.n, self.capacity
        open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: first sequence, number of sequences
        for s in range(cap, 0, -1):
            while n[s]:
                room = next((r for r in range(s, cap) if open_.get(r)), 0)
                each = (room or cap) // s
                if room:
                    first, bins = open_[room].pop()
                else:
                    room, first, bins = cap, self.sequences, -(-n[s] // each)
                    self.sequences += bins
                full, offset = min(bins, n[s] // each), cap - room
                rest = n[s] - full * each if full < bins else 0
                for i in range(each):
                    self._put(s, full, first, offset + i * s)
                for i in range(rest):
                    self._put(s, 1, first + full, offset + i * s)
                for left, at, count in ((room - each * s, first, full), (room - rest * s, first + full, 1 if rest else 0), (room, first + full + bool(rest), bins - full - bool(rest))):
                    if left and count:
                        open_[left].append((at, count))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (see `pieces`) with sequence_id and offset. They are written to the shared folder first: tokens are made once."""
    cut, _ = written(cut, "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = Plan(counts, capacity)
    runs = {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in plan.runs.items()}
    parts = max(16, -(-sum(counts.values()) // PART))

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for x in np.unique(lengths):
            at = np.flatnonzero(lengths == x)
            first, sequence, offset = runs[int(x)]
            run = np.searchsorted(first, ranks[at], side="right") - 1
            seq[at], off[at] = sequence[run] + ranks[at] - first[run], offset[run]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    dealt = cut.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = before.select(F.col("length").alias("_l"), F.col("_part").alias("_q"), F.coalesce(F.sum("_c").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("_own", own).join(before, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_q")))
    out = ranked.withColumn("_s", place("length", (F.col("_own") + F.col("_before")).cast("bigint")))
    return out.select(*cut.columns, F.col("_s.sequence_id").alias("sequence_id"), F.col("_s.offset").alias("offset"))


def best_fit_packing(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece with its place; other columns of the documents are left out, whatever their names.

    Null and empty texts are one piece of one end id. Rows that repeat an id are documents of their own; a null id stays null. An empty
    table gives an empty result. Sequences hold their pieces without gaps.
    """
    return pack(pieces(docs, tokenizer, id_col, text_col, capacity, end, with_ids), capacity)
