"""Embedding near-dedup by a PCA-ordered tiled comparison.

Unit vectors are turned to their principal axes. Vectors of cosine t or more are at most sqrt(2 - 2t) apart, also along each axis, so a
grid over the first two axes sends each vector to its own cell as home and to the few cells that it may have a link in. A cell is cut
into tiles of bounded size; the larger they are, the fewer copies are sent, so that a tile is as large as memory allows and is compared
in blocks. More axes would send twice the copies each, for a third of the pairs at most where no axis is much longer than the others.
In a block the products of leading dimensions are summed first; what the others can add is bounded by the
product of the norms of the two rests, and a pair that cannot reach t any more is left. What is left in the end is measured on the
original vectors. Any orthonormal axes give the same links: the axes are fitted on a bounded sample.

Equal vectors are one class with a count. A tile gives the number of vectors linked to each of its home classes and the roots of its
own components, never pairs; components of all tiles are joined after that.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .shared import written

THRESHOLD = 0.98
#: Vectors that the axes are fitted on; home and visiting classes of a tile.
SAMPLE, HOMES, VISITORS = 5000, 8192, 32768
#: Vectors of either side that are compared at once inside a tile.
AT_HOME, AT_VISIT = 1024, 4096
#: Dimensions after which a pair's bound is looked at.
STEPS = (8, 16, 32)


def usable(v):
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ok & F.exists(v, lambda x: x != 0)


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that their largest component is about 1: cosines stay the same to the bit, and no product of components
    is lost at the ends of the range of doubles."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])


def axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal axes, the one of largest variance first."""
    x = sample - sample.mean(0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def links(home: np.ndarray, other: np.ndarray, basis: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs (home, other) of cosine >= t, exact in double precision; rows are original vectors."""
    home, other = scaled(home), scaled(other)
    a, b = home / np.linalg.norm(home, axis=1)[:, None], other / np.linalg.norm(other, axis=1)[:, None]
    p, q, d, slack = a @ basis, b @ basis, home.shape[1], 1e-9
    steps = [s for s in STEPS if s < d] or [d]
    rest = lambda m, s: np.sqrt((m[:, s:] ** 2).sum(1))
    s = steps[0]
    part = p[:, :s] @ q[:, :s].T
    i, j = np.nonzero(part + np.outer(rest(p, s), rest(q, s)) >= t - slack)
    part = part[i, j]
    for s, to in zip(steps, [*steps[1:], d]):
        if to == s:
            break
        keep, sums = [], []
        for at in range(0, len(i), 200_000):
            ii, jj = i[at : at + 200_000], j[at : at + 200_000]
            new = part[at : at + 200_000] + np.einsum("nd,nd->n", p[ii, s:to], q[jj, s:to])
            ok = new + rest(p, to)[ii] * rest(q, to)[jj] >= t - slack
            keep.append(np.flatnonzero(ok) + at)
            sums.append(new[ok])
        k = np.concatenate(keep) if keep else np.array([], dtype=int)
        i, j, part = i[k], j[k], np.concatenate(sums) if sums else part[:0]
    good = np.zeros(len(i), dtype=bool)
    na, nb = np.sqrt((home**2).sum(1)), np.sqrt((other**2).sum(1))
    for at in range(0, len(i), 200_000):
        ii, jj = i[at : at + 200_000], j[at : at + 200_000]
        good[at : at + 200_000] = np.einsum("nd,nd->n", home[ii], other[jj]) / (na[ii] * nb[jj]) >= t
    return i[good], j[good]


def roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest id of each node's component, for edges between positions i and j."""
    label = ids.copy()
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            break
        label = new
    return label


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: vec_id, n_links (other vectors linked directly), component_id (smallest id reachable), kept (vec_id = component_id).

    Only vectors of one label and one length link. A null label, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing; so does a row with a null id (component null, kept true). Equal vectors link. Rows that repeat an id
    are vectors of their own. Other columns, whatever their names, are left out; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"), F.col(label_col).alias("_label"))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("_label").isNotNull() & usable(F.col("v")))
    good = good.withColumns({"_label": F.xxhash64(F.col("_label"), F.size("v")), "_a": F.xxhash64("v"), "_b": F.xxhash64("v", F.lit(1))})
    keyed, _ = written(good.select("vec_id", "_label", "_a", "_b", "v"), "vectors")
    key = ["_label", "_a", "_b"]
    classes, _ = written(keyed.groupBy(*key).agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v")), "classes")
    sample = [r[0] for r in classes.select("v").orderBy(F.xxhash64("_a", "cid")).limit(SAMPLE).collect()]
    by_size: dict[int, list] = {}
    for x in sample:
        by_size.setdefault(len(x), []).append(x)
    bases = {}
    for d, xs in by_size.items():
        m = scaled(np.array(xs))
        bases[d] = axes(m / np.linalg.norm(m, axis=1)[:, None])
    reach = math.sqrt(2 - 2 * threshold) + 1e-9
    side = 2 * reach

    @F.pandas_udf("array<struct<x:int,y:int,home:boolean>>")
    def cells(vs: pd.Series) -> pd.Series:
        out = []
        for x in vs:
            basis = bases.get(len(x))
            u = scaled(np.asarray(x)[None, :])[0]
            u = u / np.linalg.norm(u)
            c = (u @ basis[:, :2] if basis is not None and len(x) > 1 else np.resize(u[:2], 2)) / side
            at, low, high = np.floor(c).astype(int), np.floor(c - 0.5).astype(int), np.floor(c + 0.5).astype(int)
            out.append([{"x": int(a), "y": int(b), "home": bool(a == at[0] and b == at[1])} for a in range(low[0], high[0] + 1) for b in range(low[1], high[1] + 1)])
        return pd.Series(out, dtype=object)

    placed = classes.select("_label", "cid", "size", "v", F.explode(cells("v")).alias("c")).select("_label", "cid", "size", "v", "c.x", "c.y", "c.home")
    placed, _ = written(placed, "placed")
    cell = ["_label", "x", "y"]
    size = placed.groupBy(*cell).agg(F.sum(F.col("home").cast("long")).alias("_h"), F.count(F.lit(1)).alias("_n")).filter("_h > 0 and _n > 1")
    ni, nj = F.ceil(F.col("_h") / HOMES).cast("int"), F.ceil(F.col("_n") / VISITORS).cast("int")
    dealt = placed.join(size, cell).withColumns({"_i": F.pmod(F.xxhash64("cid"), ni).cast("int"), "_j": F.pmod(F.xxhash64("cid", F.lit(3)), nj).cast("int"), "_ni": ni, "_nj": nj})
    visiting = dealt.select(*cell, F.explode(F.sequence(F.lit(0), F.col("_ni") - 1)).alias("i"), F.col("_j").alias("j"), "cid", "size", "v", F.lit(False).alias("home"))
    at_home = dealt.filter("home").select(*cell, F.col("_i").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_nj") - 1)).alias("j"), "cid", "size", "v", F.lit(True).alias("home"))

    def tile(pdf):
        h, o = pdf[pdf["home"]], pdf[~pdf["home"]]
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        if not len(h) or not len(o):
            return empty
        hv, ov = np.stack(h["v"].to_numpy()).astype(float), np.stack(o["v"].to_numpy()).astype(float)
        basis = bases.get(hv.shape[1])
        hid, oid, w = h["cid"].to_numpy(), o["cid"].to_numpy(), o["size"].to_numpy()
        basis = np.eye(hv.shape[1]) if basis is None else basis
        ids, where = np.unique(np.concatenate([hid, oid]), return_inverse=True)
        at_home, at_visit = where[: len(hid)], where[len(hid) :]
        n, low, high = np.zeros(len(hid), dtype=np.int64), [], []
        for x in range(0, len(hid), AT_HOME):
            for y in range(0, len(oid), AT_VISIT):
                i, j = links(hv[x : x + AT_HOME], ov[y : y + AT_VISIT], basis, threshold)
                i, j = i + x, j + y
                other = hid[i] != oid[j]
                i, j = i[other], j[other]
                if len(i):
                    n += np.bincount(i, weights=w[j], minlength=len(hid)).astype("int64")
                    here, at = np.unique(np.concatenate([at_home[i], at_visit[j]]), return_inverse=True)
                    root = roots(here, at[: len(i)], at[len(i) :])  # at most one edge for each vector of the block stays
                    low.append(root[root != here])
                    high.append(here[root != here])
        if not low:
            return empty
        root = ids[roots(np.arange(len(ids)), np.concatenate(low), np.concatenate(high))]
        moved = root != ids
        return pd.DataFrame({"a": np.concatenate([ids[moved], hid[n > 0]]), "b": np.concatenate([root[moved], hid[n > 0]]), "n": np.concatenate([np.zeros(moved.sum(), dtype="int64"), n[n > 0]])})

    id_type = vectors.schema[id_col].dataType.simpleString()
    found, _ = written(visiting.unionByName(at_home).groupBy(*cell, "i", "j").applyInPandas(tile, f"a {id_type}, b {id_type}, n bigint"), "links")
    n_links = found.filter("n > 0").groupBy(F.col("a").alias("_c")).agg(F.sum("n").alias("_links"))
    comp = connected_components(found.filter("a <> b").select("a", "b").distinct())
    known = classes.select(*key, "cid", "size").join(n_links, F.col("cid") == F.col("_c"), "left").join(comp, F.col("cid") == F.col("node"), "left")
    known = known.select(*key, (F.coalesce("_links", F.lit(0)) + F.col("size") - 1).cast("bigint").alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    linked = keyed.select("vec_id", *key).join(known, key).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.coalesce(F.col("vec_id").isNotNull() & F.col("_label").isNotNull() & usable(F.col("v")), F.lit(False)))
    out = linked.unionByName(rest.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
