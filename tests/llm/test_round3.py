"""Merkle manifest, personal data and lexical search against plain versions, on odd tables."""

import hashlib
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import lexical_search, merkle, pii

CLASH = ("_id", "_text", "leaf", "path", "root", "pii", "_email", "rank", "score", "item", "_tree", "_node")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    """Root, and of each node its siblings (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p // 3 * 3
            paths[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 3])))
        nodes, at = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], paths


def test_traversal():
    for n in (*range(1, 60), 80, 81, 82, 242, 244, 728, 729):
        leaves = [h(str(i)) for i in range(n)]
        root, want = plain_tree(leaves)
        height = merkle.height_of(n)
        assert merkle.Treehash(leaves, height, 0, n).all() == [root]
        got = [[(x["left"], x["right"]) for x in p] for p in merkle.traverse(leaves, height)]
        assert got == want, n
    state = merkle.Treehash([h("x")] * 729, 6, 0, 729)
    most = 0
    while state.at < state.stop:
        state.step()
        most = max(most, sum(map(len, state.stack)))
    assert most <= 2 * 6


@pytest.fixture(scope="module")
def forest(spark):
    sizes = {None: 4, "": 1, "a": 1600, "ab": 3, "é": 28, "b": 1, "=": 2}
    rows = [(i, s, None if i % 7 == 0 else "en", i if i % 5 else None, None if i % 11 == 0 else f"line {i}\nnext é\n" * (i % 3)) for s, n in sizes.items() for i in range(n)]
    rows += [(None, "ab", "en", 1, "no\nid"), (1, "ab", "en", 2, "same id"), (1, "ab", "en", 2, "same id")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def test_manifest(forest):
    rows, df = forest
    fields = [F.col(c) for c in df.columns]
    out = merkle.manifest(clashing(df), merkle.leaf(*fields), F.col("source"), [F.col("doc_id")], {"doc_id": F.col("doc_id"), "source": F.col("source")})
    assert out.columns == ["doc_id", "source", "leaf", "path", "subroot", "root"]
    out = out.withColumn("folded", merkle.fold(F.col("path"), F.col("leaf"))).withColumn("proof", merkle.siblings(F.col("path")))
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    trees = {}
    for s, rs in groups.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = (rs, *plain_tree([plain_leaf(r) for r in rs]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, above = plain_tree([trees[s][1] for s in order])
    want = Counter((r[0], s, plain_leaf(r), "".join(a + b for a, b in path + above[i]), trees[s][1], root, root) for i, s in enumerate(order) for r, path in zip(trees[s][0], trees[s][2]))
    got = Counter((r["doc_id"], r["source"], r["leaf"], r["proof"], r["subroot"], r["root"], r["folded"]) for r in out.collect())
    assert got == want
    some = out.filter("doc_id = 3 and source = 'a'").withColumn("folded", merkle.fold(F.col("path"), F.lit(h("other")))).first()
    assert some["folded"] != some["root"]
    assert merkle.manifest(df.filter("false"), merkle.leaf(*fields), F.col("source"), [F.col("doc_id")], {"doc_id": F.col("doc_id")}).count() == 0
    one = merkle.manifest(df.filter("source = 'b'"), merkle.leaf(*fields), F.col("source"), [F.col("doc_id")], {"doc_id": F.col("doc_id")}).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["path"] == []


#: Base kinds by their definition.
PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_pii(text):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end(), m[0]))
    return out


CARD16 = "4111 1111 1111 1111"


def test_pii_base(spark, monkeypatch):
    rng = np.random.default_rng(11)
    parts = ["a", "B7", ".", "@", "x.y", "_", "%", "-", " ", "\n", "+1", "(017) ", "555-7713", "12.3", "0255.1", ".255", "256", "4", CARD16, CARD16.replace(" ", ""), "378282246310005", "é", "日本", "😀", "0000000000000", "m@n.o", "9"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(3000)]
    texts += [None, "", "a@b.c_d@e.f", "a.b@c.d.e-f.@g", "@", "+1 (974) 555-3436.", "1.2.3.4.5.6.7.8", "1.2.3.4@a.b", "+" * 50, CARD16 + " " + CARD16, "x@y." + "z." * 9000 + "end", "1 " * 20000, "ab@cd.ef " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for size in (pii.BLOCK, 3):
        monkeypatch.setattr(pii, "BLOCK", size)
        got = pii.find(clashing(df).drop("pii"))
        assert got.columns == [*clashing(df).drop("pii").columns, "pii"]
        for r in got.filter("size(pii) > 0 or text is null or i >= 0").collect():
            assert [(s["kind"], s["start"], s["stop"], s["value"]) for s in r["pii"] if s["base"]] == plain_pii(texts[r["i"]]), r["i"]
    assert pii.find(df.filter("false")).count() == 0


def test_pii_added(spark):
    iban = "GB82 WEST 1234 5698 7654 32"
    texts = [
        f"pay to {iban} today", f"pay to {iban.replace(' ', '')}.", "GB82 WEST 1234 5698 7654 33", f"X{iban}",  # a checksum that fails, a letter before
        f"my card is 12 {CARD16} thanks", f"id 12 {CARD16} thanks",  # inside a longer run: with and without a word
        "call (017) 555-7713 now", "about (017) 555-7713 now", "call on 2024-01-02 at 10.0.0.255", "call +1 (017) 555-7713",
        "my email me@example.com", "me@example.com",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: [(s["kind"], s["value"], s["score"], s["base"]) for s in r["pii"]] for r in pii.find(df).collect()}
    assert got[0] == [("iban", iban, 0.7, False)] and got[1] == [("iban", iban.replace(" ", ""), 0.7, False)] and got[2] == got[3] == []
    assert got[4] == [("card", CARD16, 1.0, False)] and got[5] == []
    assert got[6] == [("phone", "(017) 555-7713", 0.7, False)] and got[7] == []
    assert got[8] == [("ip", "10.0.0.255", 0.6, True)] and got[9] == [("phone", "+1 (017) 555-7713", 1.0, True)]
    assert got[10] == [("email", "me@example.com", 1.0, True)] and got[11] == [("email", "me@example.com", 0.8, True)]
    for text, spans in zip(texts, (got[i] for i in range(len(texts)))):
        assert all(value in text for _, value, _, _ in spans)


def test_pii_is_linear(spark):
    """A run of a million characters that a pattern could begin at every place of."""
    n = 1_000_000
    df = spark.createDataFrame([("a" * n,), ("7" * n,), ("1." * n,), ("+1" * n,), ("a@" * n,), ("AB12" * (n // 4),), ("me@example.com " * (n // 15),)], "text string")
    began = time.time()
    sizes = [r[0] for r in pii.find(df).select(F.size("pii")).collect()]
    assert sizes[-1] == n // 15 and sizes[0] == 0 and time.time() - began < 60


def plain_search(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        scores = []
        for own, c in counts:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0 and own is not None:
                scores.append((-s, own))
        out[item] = [(r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_lexical_search(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "É", "é", "日本語", "a_b", "x-y", "3.14", "İ", "K"]
    share = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(30)] + [(5, docs[9][1]), (None, docs[11][1]), (500, None), (501, ""), (502, " .,! "), (503, text(5000)), (504, "é" * 50 + "\x7f\x00\x80 w3")]
    items = [(i, text(int(rng.integers(1, 25)))) for i in range(40)] + [(100, docs[7][1]), (101, None), (102, ""), (103, "unheardof"), (None, "w3 w3 w50"), (104, text(300))]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items + [(3, "zzz " + items[3][1])], "item_id bigint, text string")
    want = plain_search(docs, items)
    for entries, chunk in ((lexical_search.ENTRIES, lexical_search.CHUNK), (200, 64)):
        monkeypatch.setattr(lexical_search, "ENTRIES", entries)
        monkeypatch.setattr(lexical_search, "CHUNK", chunk)
        got = defaultdict(list)
        for r in lexical_search.search(clashing(d), clashing(q.filter("item_id is null or item_id <> 3 or text not like 'zzz%'"))).collect():
            got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
        assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    twice = {r["item_id"] for r in lexical_search.search(d, q).filter("item_id = 3").collect()}
    assert twice == {3}
    assert lexical_search.search(d.filter("false"), q).count() == 0 and lexical_search.search(d, q.filter("false")).count() == 0
    long = lexical_search.count_terms(b"ab cd " * 2_000_000, {b"ab": 0})
    assert long[0] == 4_000_000 and long[1] == {0: 2_000_000}
