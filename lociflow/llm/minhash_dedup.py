"""MinHash near-dedup with order MinHash.

Shingles are five words (\\w+, lower case), labelled with their occurrence in the text, so that all differ. Each of BANDS hash functions
takes the ORDER smallest of a text's and keeps them in text order: texts agree in a band if they share those and have them in the same
order. Texts of few shingles draw too few alike: up to SHORT they enter every pair, in text order, of their smallest shingles instead, so
many that any partner above the threshold has one of the pairs, too; those a partner of theirs may have enter both. Texts of equal words
are one class first, known by a hash of their words, whatever their ids. Candidates are verified by a banded alignment of the labelled shingles: the longest
common subsequence inside the band that the threshold leaves, L, and similarity L / (n1 + n2 - L).

A bucket of a band never becomes all its pairs. Each member is verified with one representative of the bucket; in further rounds, with
other representatives, only members that are not yet in the component of the bucket's first. What is left after ROUNDS rounds meets
every member outside its component, so that no link that joins two components in a bucket is lost: pair by pair in buckets of at most
SMALL members, and in larger ones in tiles of bounded size. A tile counts the shingles that its texts have in common by products of
incidence matrices, aligns only pairs that have enough of them, and gives links between components, never its pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import bloom
from .components import connected_components
from .shared import bound_batches, delete, fresh_names, memory, uses_worker, written

K, SIMILARITY, BANDS, ORDER, ROUNDS = 5, 0.8, 16, 4, 1
#: Most shingles of a text that enters pairs of its smallest ones and no bands.
SHORT = 16
#: Pairs of one representative that are verified together: its text is sent once for each so many.
STAR = 256
#: Members of a bucket that is taken pair by pair; left-over and other texts of a tile, and shingles of either side, about.
SMALL, HOMES, OTHERS, TILE = 16, 512, 2048, 500_000
#: Shingles of so few texts of a tile are counted pair by pair; columns of a matrix of the others.
RARE, COLUMNS = 8, 4096
_WORD = re.compile(r"\w+").findall
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(29).integers(1, 1 << 63, BANDS, dtype=np.uint64)
#: Most entries of a worker's memory of word hashes; numbers held at once by a sketch.
KEPT, AT_ONCE = 100_000, 4_000_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        x = self[word] = xxhash.xxh3_64_intdigest(word)
        return x


_HASHES = _Hashes()
memory("minhash", _HASHES.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_HASHES) > KEPT:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(text: str, k: int = K) -> np.ndarray:
    """Occurrence-labelled hashes of k words in text order; all words are one shingle if they are fewer than k."""
    words = _WORD(text.lower())
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = _word_hashes(words)
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * _ODD + h[i : i + len(out)]
    out = _mix(out)
    order = np.argsort(out, kind="stable")
    s = out[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if not new.all():
        at = np.arange(len(s))
        occurrence = np.empty(len(s), dtype=np.uint64)
        occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        out = _mix(out + occurrence * _ODD)
    return out


def sketch(x: np.ndarray, bands: int = BANDS, order: int = ORDER) -> np.ndarray:
    """One hash a band: the `order` smallest labelled shingles, in text order."""
    n, take = len(x), min(order, len(x))
    out = np.empty(bands, dtype=np.uint64)
    step = max(1, min(bands, AT_ONCE // n))
    for b in range(0, bands, step):
        seeds = _SEEDS[b : b + step]
        h = (x[None, :] ^ seeds[:, None]) * _ODD
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.sort(np.argpartition(h, take - 1, axis=1)[:, :take], axis=1)
        acc = seeds.copy()
        for i in range(take):
            acc = _mix(acc * _ODD + x[at[:, i]])
        out[b : b + step] = acc
    return out


def few(x: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Hashes of all pairs, in text order, of a short text's smallest shingles.

    A partner has at least need = ceil(least * n) of a text's n shingles in common and in order. The two smallest of those are among the
    n - need + 2 smallest of either text, so the two texts share the pair.
    """
    n = len(x)
    take = n - int(np.ceil(least * n - 1e-9)) + 2
    if n < 2 or n > SHORT / least:
        return np.empty(0, dtype=np.uint64)
    at = np.sort(np.argsort(_mix(x ^ _SEEDS[0]), kind="stable")[:take])
    i, j = np.triu_indices(len(at), 1)
    return _mix(_mix(x[at[i]]) * _ODD + x[at[j]])


def similarity(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> float:
    """Of two texts' labelled shingles by banded alignment; 0 if it cannot reach `least`."""
    n1, n2 = len(x), len(y)
    if not n1 or not n2 or min(n1, n2) < least * max(n1, n2):
        return 0.0
    need = least * (n1 + n2) / (1 + least)
    band = n1 + n2 - 2 * need
    order = np.argsort(x)
    at = np.minimum(np.searchsorted(x[order], y), n1 - 1)
    i = order[at]
    j = np.flatnonzero(x[i] == y)
    i = i[j]
    i = i[np.abs(i - j) <= band]
    if len(i) < need - 1e-9:
        return 0.0
    if (np.diff(i) > 0).all():
        common = len(i)
    else:
        tails: list[int] = []
        for v in i.tolist():
            p = bisect_left(tails, v)
            if p == len(tails):
                tails.append(v)
            else:
                tails[p] = v
        common = len(tails)
    s = common / (n1 + n2 - common)
    return s if s >= least - 1e-12 else 0.0


def _sketch_series(texts: pd.Series) -> pd.DataFrame:
    import xxhash

    uses_worker("minhash")
    rows, none = [], np.empty(0, dtype=np.int64)
    for t in texts:
        t = t or ""
        words = _WORD(t.lower())
        if words:
            d = xxhash.xxh3_128_digest(" ".join(words))
            x = shingles(t)
            a, b = np.frombuffer(d, dtype=np.int64).tolist()
            rows.append((a, b, len(x), sketch(x).view(np.int64) if len(x) > SHORT else none, few(x).view(np.int64)))
        elif t.strip():
            a, b = np.frombuffer(xxhash.xxh3_128_digest("\0" + t.strip()), dtype=np.int64).tolist()
            rows.append((a, b, 0, none, none))
        else:
            rows.append((None, None, 0, none, none))
    a, b, n, bands, pairs = zip(*rows) if rows else ((), (), (), (), ())
    return pd.DataFrame({"a": pd.array(a, dtype="Int64"), "b": pd.array(b, dtype="Int64"), "n": n, "bands": pd.Series(bands, dtype=object), "few": pd.Series(pairs, dtype=object)})


def _alike_series(x: pd.Series, y: pd.Series) -> pd.Series:
    last, memory, out = None, None, []
    for s, t in zip(x, y):
        if s != last:
            last, memory = s, shingles(s)
        out.append(similarity(memory, shingles(t)) > 0)
    return pd.Series(out, dtype=bool)


def _sketches(text):
    return F.pandas_udf(_sketch_series, "struct<a:bigint,b:bigint,n:int,bands:array<bigint>,few:array<bigint>>")(text)


def _alike(x, y):
    return F.pandas_udf(_alike_series, "boolean")(x, y)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that are alike; the text of b travels, that of a is joined last.

    A representative of more than STAR pairs is dealt into parts, so that no task gets all texts that are near one.
    """
    t = texts.select(F.col("cid").alias("_c"), F.col("text").alias("_t"))
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("_parts")).filter("_parts > 1").withColumnRenamed("a", "_c")
    dealt = pairs.join(hubs, F.col("a") == F.col("_c"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("_parts", F.lit(1))).cast("int").alias("_part"))
    one = dealt.join(t, F.col("b") == F.col("_c")).select("a", "b", "_part", F.col("_t").alias("_tb"))
    more = bloom.may_have(t, hubs, "_c").join(hubs, "_c").select("_c", "_t", F.explode(F.sequence(F.lit(1), F.col("_parts") - 1)).alias("_p"))
    home = t.withColumn("_p", F.lit(0)).unionByName(more)
    both = one.join(home, (F.col("a") == F.col("_c")) & (F.col("_part") == F.col("_p")))
    return both.filter(_alike("_t", "_tb")).select("a", "b")


def common(texts: list[np.ndarray], home: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Numbers of labelled shingles that the texts at `home` have in common with those at `other`; a text with itself: any number."""
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    _, x, n = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    order = np.argsort(x, kind="stable")
    order = order[n[x[order]] > 1]
    x, doc = x[order], doc[order]
    rare = n[x] <= RARE
    at_home, at_other = np.full(len(texts), -1), np.full(len(texts), -1)
    at_home[home], at_other[other] = np.arange(len(home)), np.arange(len(other))
    out = np.zeros(len(home) * len(other), dtype=np.float32)
    for step in range(1, RARE):
        same = x[rare][step:] == x[rare][:-step]
        one, two = doc[rare][:-step][same], doc[rare][step:][same]
        for a, b in ((at_home[one], at_other[two]), (at_home[two], at_other[one])):
            ok = (a >= 0) & (b >= 0)
            out += np.bincount(a[ok] * len(other) + b[ok], minlength=len(out)).astype(np.float32)
    out = out.reshape(len(home), len(other))
    x, doc = np.unique(x[~rare], return_inverse=True)[1], doc[~rare]
    for start in range(0, int(x[-1]) + 1 if len(x) else 0, COLUMNS):
        part = slice(*np.searchsorted(x, [start, start + COLUMNS]))
        m = np.zeros((len(texts), COLUMNS), dtype=np.float32)
        m[doc[part], x[part] - start] = 1
        out += m[home] @ m[other].T
    return out


def tile_links(texts: list[np.ndarray], components: np.ndarray, home: np.ndarray, other: np.ndarray, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join components, as positions; a link inside what is joined already is not looked for."""
    n = np.array([len(x) for x in texts])
    need = least * (n[home][:, None] + n[other][None, :]) / (1 + least)
    hits = common(texts, home, other) >= need - 1e-6
    names, c = np.unique(components, return_inverse=True)
    up = list(range(len(names)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(hits & (c[home][:, None] != c[other][None, :]))):
        a, b = home[i], other[j]
        p, q = root(c[a]), root(c[b])
        if p != q and similarity(texts[a], texts[b], least):
            up[max(p, q)] = min(p, q)
            out.append((int(a), int(b)))
    return out


def _tiled(named: DataFrame, sizes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of what is left in buckets of more than SMALL members."""
    bucket = ["band", "key"]
    tiles = lambda count, most: F.greatest(F.ceil(F.col(count) / most), F.ceil(F.col(f"{count}n") / TILE)).cast("int")
    dealt = named.join(sizes.filter(f"_m > {SMALL}").select(*bucket, tiles("_l", HOMES).alias("_ni"), tiles("_m", OTHERS).alias("_nj")), bucket)
    i, j = F.pmod(F.xxhash64("cid"), F.col("_ni")).cast("int"), F.pmod(F.xxhash64("cid", F.lit(3)), F.col("_nj")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = dealt.filter("comp <> first").select(*bucket, i.alias("i"), every("_nj").alias("j"), "cid", "comp", F.lit(True).alias("home"))
    others = dealt.select(*bucket, every("_ni").alias("i"), j.alias("j"), "cid", "comp", F.lit(False).alias("home"))

    def tile(pdf):
        whole = pdf.groupby("cid", sort=True).agg({"comp": "first", "text": "first"})
        at = {c: i for i, c in enumerate(whole.index)}
        side = lambda home: np.array([at[c] for c in pdf["cid"][pdf["home"] == home]], dtype=np.int64)
        home, other = side(True), side(False)
        found = tile_links([shingles(t) for t in whole["text"]], whole["comp"].to_numpy(), home, other, least) if len(home) and len(other) else []
        ids = whole.index.to_numpy()
        return pd.DataFrame({"a": ids[[a for a, _ in found]], "b": ids[[b for _, b in found]]})

    kind = named.schema["cid"].dataType.simpleString()
    return homes.unionByName(others).join(texts, "cid").groupBy(*bucket, "i", "j").applyInPandas(tile, f"a {kind}, b {kind}")


def keyed(docs: DataFrame, id_col: str, text_col: str, k: str = "k", g: str = "g") -> DataFrame:
    """Two hashes that together stand for a row's id and text."""
    return docs.withColumns({k: F.xxhash64(F.col(id_col), F.col(text_col)), g: F.xxhash64(F.col(text_col), F.lit(7))})


def _flags(docs: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, str]:
    """A written row per row of `docs`: doc_id, k, g (see `keyed`), class_id, kept, alone (a text that links with nothing)."""
    spark = docs.sparkSession
    bound_batches(spark)
    src = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    sk = src.select("doc_id", "k", "g", _sketches("text").alias("s"))
    sk = sk.select(F.monotonically_increasing_id().alias("row"), "doc_id", "k", "g", "s.a", "s.b", "s.n", "s.bands", "s.few")
    sk, p_sk = written(sk, "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "g", "row")).alias("first")
    classes = sk.filter("a is not null").groupBy("a", "b").agg(first, F.min("n").alias("n")).withColumn("cid", F.col("first.row"))
    classes, p_classes = written(classes, "classes")
    heads = sk.select(F.col("row").alias("cid"), "k", "g", "n", "bands", "few").join(classes.filter("n > 0").select("cid"), "cid", "left_semi")
    heads, p_heads = written(heads, "heads")
    entries = F.concat(F.transform("bands", lambda x, i: F.struct(i.alias("band"), x.alias("key"))), F.transform("few", lambda x: F.struct(F.lit(-1).alias("band"), x.alias("key"))))
    rows = heads.select("cid", "n", F.explode(entries).alias("e")).select("cid", "n", "e.band", "e.key")
    stats = rows.groupBy("band", "key").agg(F.min("cid").alias("rep"), F.max("cid").alias("_last")).filter("rep <> _last").drop("_last")
    members, p_members = written(rows.join(stats, ["band", "key"]), "members")
    near = lambda x, y: F.least(x, y) >= least * F.greatest(x, y)  # noqa: E731  no link is possible otherwise
    wanted, p_wanted = written(heads.select("cid", "k", "g").join(members.select("cid").distinct(), "cid", "left_semi"), "wanted")
    texts = bloom.may_have(src, wanted, "k").join(wanted, ["k", "g"]).select("cid", "text").dropDuplicates(["cid"])
    texts, p_texts = written(texts, "texts")

    heads_n = members.select(F.col("cid").alias("_r"), F.col("n").alias("_rn")).distinct()
    star = members.filter("cid <> rep").select("cid", "n", "rep").distinct().join(heads_n, F.col("rep") == F.col("_r")).filter(near(F.col("n"), F.col("_rn")))
    done, p_done = written(star.select(F.col("rep").alias("a"), F.col("cid").alias("b")), "pairs")
    good, p_good = written(_verified(done, texts), "links")
    paths = [p_sk, p_classes, p_heads, p_members, p_wanted, p_texts, p_done, p_good]
    comp = connected_components(good)
    for round_ in range(ROUNDS + 1):
        named = members.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
        first = comp.select(F.col("node").alias("rep"), F.col("component").alias("_fc"))
        named, p = written(named.join(first, "rep", "left").withColumn("first", F.coalesce("_fc", "rep")).drop("_fc"), "named")
        paths.append(p)
        left = named.filter("comp <> first")
        if left.isEmpty():
            break
        x = left.select("band", "key", "cid", "n", "comp")
        if round_ < ROUNDS:  # another representative of the first component, and one of the others
            kind = (F.col("comp") == F.col("first")).alias("_in")
            other = named.groupBy("band", "key", kind).agg(F.min(F.struct(F.xxhash64("cid", F.lit(round_)), "cid", "n", "comp")).alias("_o"))
            other = other.select("band", "key", F.col("_o.cid").alias("_cid"), F.col("_o.n").alias("_n"), F.col("_o.comp").alias("_comp"))
        else:
            gone = lambda c: F.sum(F.when(F.col("comp") != F.col("first"), c).otherwise(0))
            sizes = named.groupBy("band", "key").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_mn"), gone(F.lit(1)).alias("_l"), gone(F.col("n")).alias("_ln")).filter("_l > 0 and _m > 2")
            sizes, p = written(sizes, "sizes")
            tiled, p1 = written(_tiled(named, sizes, texts, least), "links")
            paths += [p, p1]
            good = good.unionByName(tiled)
            small = sizes.filter(F.col("_m") <= SMALL).select("band", "key")
            other = named.join(small, ["band", "key"]).select("band", "key", F.col("cid").alias("_cid"), F.col("n").alias("_n"), F.col("comp").alias("_comp"))
        pairs = x.join(other, ["band", "key"]).filter((F.col("comp") != F.col("_comp")) & near(F.col("n"), F.col("_n")))
        pairs = pairs.select(F.least("cid", "_cid").alias("a"), F.greatest("cid", "_cid").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
        pairs, p1 = written(pairs, "pairs")
        more, p2 = written(_verified(pairs, texts), "links")
        paths += [p1, p2]
        done = done.unionByName(pairs)
        good = good.unionByName(more)
        comp = connected_components(good)
    named = classes.select("a", "b", "first", "cid").join(comp, F.col("cid") == F.col("node"), "left").withColumn("_comp", F.coalesce("component", "cid")).drop("node", "component")
    top = named.groupBy("_comp").agg(F.min("first").alias("_top"))
    named = named.join(top, "_comp").select("a", "b", F.col("_top.doc_id").alias("class_id"), F.col("_top.row").alias("_kept"))
    linked = sk.filter("a is not null").select("row", "doc_id", "k", "g", "a", "b").join(named, ["a", "b"]).select("doc_id", "k", "g", "class_id", (F.col("row") == F.col("_kept")).alias("kept"), F.lit(False).alias("alone"))
    rest = sk.filter("a is null").select("doc_id", "k", "g", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), F.lit(True).alias("alone"))
    out, p_out = written(linked.unionByName(rest), "near")
    delete(spark, *paths)
    return out, p_out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (the smallest id of its class), kept (true for one row of each class).

    Classes are of texts, whatever their ids: rows that repeat an id with other texts may be in several. The row kept has the class's
    smallest id, of rows that share it the text that comes first by hash, and of equal rows any one. Rows with a null id take part and
    come after all others; a class without an id has a null class_id. Null and blank texts link with nothing, and all are kept. Texts
    without a word link if equal but for outer white space. Texts of fewer than five words are one shingle. Other columns, whatever their
    names, are left out; an empty table gives an empty result. The result is a written table, which its caller may delete.
    """
    return _flags(docs, id_col, text_col, least)[0].select("doc_id", "class_id", "kept")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps, with all columns, whatever their names; of rows that repeat id and text in one
    class one is left. Null and blank texts stay. Only rows that may be in a class with others are shuffled."""
    flags, _ = _flags(docs, id_col, text_col, least)
    counts = flags.filter("not alone").groupBy("k", "g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("long")).alias("stay"))
    k, g = fresh_names(docs, "k", "g")
    marks, _ = written(counts.filter("stay < n").select(F.col("k").alias(k), F.col("g").alias(g), (F.col("stay") > 0).alias("_stay")), "marks")
    rows = keyed(docs, id_col, text_col, k, g)
    clear, may = bloom.has_not(rows, marks, k), bloom.may_have(rows, marks, k)
    rest = may.join(marks.drop("_stay"), [k, g], "left_anti")
    first = may.join(marks.filter("_stay").drop("_stay"), [k, g], "left_semi").dropDuplicates([k, g])
    return clear.unionByName(rest.select(clear.columns)).unionByName(first.select(clear.columns)).drop(k, g)
