"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import bpe, chat_format, embedding_dedup, language_id, line_dedup, minhash_dedup, nearest, packing, token_counts, url_filter
from lociflow.llm.components import connected_components
from lociflow.llm.queries import URL_RULES, vocabulary

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "vor", "shi", "pel", "dun", "gat")]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


BASE = prose(1, 120)
EDITED = BASE.replace(BASE.split(" ")[60], "edited", 1)
TEXTS = [(0, BASE), (1, BASE), (2, EDITED), (3, prose(2, 120)), (4, None), (5, ""), (6, "   "), (7, "!!! %%%"), (8, "!!! %%%"), (9, "one two"), (10, "One, two."), (11, "word " * 6000), (12, "a<|endoftext|>b  \n\n c\u00e9 日本 \x1c x"), (13, prose(3, 3000)), (3, prose(2, 120)), (None, BASE)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    return df.withColumns({c: F.lit(1) for c in ("line", "_text", "piece", "length", "n", "class_id", "kept", "lang_pred", "score", "n_dropped")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_line_dedup(spark, none):
    rows = [(1, "Posted by ann smith on 2024-01-02 in news\nown line of one\n\n  boiler  plate here "), (2, "Posted by ann smith on 2025-11-30 in news\nboiler plate here\nother line of two"), (3, None), (4, ""), (5, "boiler plate here\nboiler plate here"), (None, "boiler plate here"),
            (6, "Order of mr brown was sent to the house today"), (7, "Order of mr brown was sent to the castle today")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("line", F.lit(7))
    got = {r["doc_id"]: (r["text"], r["n_dropped"], r["line"]) for r in line_dedup.line_dedup(df).collect()}
    assert got[1] == (rows[0][1], 0, 7)
    assert got[2] == ("other line of two", 2, 7)
    assert got[3][:2] == (None, 0) and got[4][:2] == ("", 0) and got[5][:2] == ("", 2) and got[None][:2] == ("boiler plate here", 0)
    assert got[6][:2] == (rows[6][1], 0) and got[7][:2] == ("", 1), "one variable field of nine tokens"
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_of_common_values(spark, monkeypatch):
    """Values of a variable field that are seen often stay variable, at any size; a leaf with three templates has three."""
    kinds = ["Order of mr brown was sent to the {0} today by the post", "Order of mr brown will come from a {0} soon with some luck", "Order of mr brown had been lost near our {0} twice or so"]
    for n in (9, 60, 600):
        values = [f"value{chr(97 + i % 4)}" if i % 3 else "rare" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(n)]
        rows = [(i, kinds[i % 3].format(v) + f"\nown words {prose(700 + i, 9)}") for i, v in enumerate(values)]
        rows += [(n, "Order of mr brown is a line without its like in any other text")]
        got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert [i for i in range(n + 1) if got[i] != (3 <= i < n)] == [], n
    monkeypatch.setattr(line_dedup, "HOT", 2)
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [i for i in range(n + 1) if got[i] != (3 <= i < n)] == []


def test_line_dedup_keeps_columns(spark):
    names = ("_id", "_drop", "_kept", "line", "leaf", "_bucket", "_bitmap", "first")
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (None, None)], "doc_id bigint, text string").withColumns({c: F.lit(c) for c in names})
    out = line_dedup.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert all(r[c] == c for r in out.collect() for c in names) and sorted(r["n_dropped"] for r in out.collect()) == [0, 0, 1]


def brute_components(ids, pairs):
    p = {i: i for i in ids}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [tuple(map(int, x)) for x in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = brute_components({x for p in pairs for x in p}, pairs)
    assert got == want


def vectors(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        v = rng.standard_normal(16) if i % 4 == 0 or i < 20 else np.array(rows[int(rng.integers(0, i))][1] or rng.standard_normal(16)) + 0.04 * rng.standard_normal(16)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3) if i % 50 else None))
    rows += [(400, rows[8][1], 2), (401, [2 * x for x in rows[8][1]], 2), (402, None, 1), (403, [0.0] * 16, 1), (404, [float("nan")] * 16, 1), (405, [None] * 16, 1), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (408, [float("inf")] + [0.0] * 15, 1), (409, [], 1)]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({"cid": F.lit(0), "x": F.lit(0), "v": F.lit(0)})


def test_embedding_dedup(spark):
    rows, df = vectors(spark)
    good = [(i, np.array(v), l) for i, v, l in rows if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    pairs = [(a[0], b[0]) for n, a in enumerate(good) for b in good[:n] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= 0.98]
    assert len(pairs) > 100
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    comp = brute_components([r[0] for r in rows], pairs)
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df).collect()}
    assert len(got) == len(rows)
    for i in got:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], comp[i], comp[i] == i), i
    assert embedding_dedup.embedding_dedup(df.filter("false")).count() == 0


def test_embedding_dedup_in_blocks(spark, monkeypatch):
    for name, size in (("HOMES", 40), ("VISITORS", 90), ("AT_HOME", 16), ("AT_VISIT", 25)):
        monkeypatch.setattr(embedding_dedup, name, size)
    test_embedding_dedup(spark)


def test_components_of_hubs(spark, monkeypatch):
    from lociflow.llm import components

    monkeypatch.setattr(components, "HUBS", 8)
    rng = np.random.default_rng(6)
    pairs = [(7, 100 + i) for i in range(150)] + [(8, 300 + i) for i in range(90)] + [(260, 310)] * 2 + [tuple(map(int, x)) for x in rng.integers(500, 900, (150, 2))]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*pairs, (None, 1)], "a bigint, b bigint")).collect()}
    assert got == brute_components({x for p in pairs for x in p}, pairs)


def test_nearest(spark):
    rows, df = vectors(spark)
    got = nearest.nearest(df, F.col("vec_id") % 10 == 0).collect()
    by = defaultdict(dict)
    for r in got:
        by[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    good = {i: np.array(v) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    hit = total = 0
    for q in (i for i in good if i % 10 == 0):
        best = sorted((math.sqrt(((v - good[q]) ** 2).sum()), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:10]
        found = [by[q][k] for k in sorted(by[q])]
        assert [x[1] for x in found] == sorted(x[1] for x in found) and sorted(by[q]) == list(range(1, len(best) + 1))
        hit, total = hit + len({i for _, i in best} & {i for i, _ in found}), total + len(best)
    assert hit >= 0.9 * total
    assert nearest.nearest(df.filter("false"), F.lit(True)).count() == 0


def test_nearest_measures_few(spark):
    """Recall and the share of vectors that are measured, over 12,000 vectors without clusters, and all embeddings of sf0.1; exact without slack."""
    from conftest import DATA

    rng = np.random.default_rng(31)
    x = rng.standard_normal((12000, 64)).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[50:80], x[100:110] = x[40], x[40] + 1e-4 * rng.standard_normal((10, 64))
    index, hit, measured, queries = nearest.Index(np.arange(len(x)), x), 0, 0, range(0, 12000, 100)
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = [int(i) for i in np.lexsort((np.arange(len(x)), d))[:10]]
        found, n = index.search(q, x[q], 10)
        assert [i for _, i in found] == sorted((i for _, i in found), key=lambda i: (d[i], i)) and all(s == d[i] for s, i in found)
        hit, measured = hit + len({i for _, i in found} & set(best)), measured + n
        if q % 3000 == 0:
            assert [i for _, i in index.search(q, x[q], 10, math.inf)[0]] == best
    assert hit >= 0.9 * 10 * len(queries) and measured < 0.1 * len(x) * len(queries), (hit, measured)
    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in df.collect()}
    got = defaultdict(set)
    for r in nearest.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    m, ids = np.stack(list(rows.values())), np.array(list(rows))
    index, hit, measured = nearest.Index(ids, m), 0, 0
    for q in got:
        d = np.sqrt(((m - rows[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hit, measured = hit + len(got[q] & set(ids[np.lexsort((ids, d))[:10]].tolist())), measured + index.search(q, rows[q], 10)[1]
    assert len(got) == sum(i % 100 == 0 for i in rows) and hit >= 0.9 * 10 * len(got) and measured < 0.1 * len(m) * len(got), (hit, measured)


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    text = vocabulary("word_bpe_49k.json").decode()
    t = Tokenizer.from_str(text)
    got = defaultdict(list)
    places = defaultdict(list)
    out = packing.best_fit_packing(docs, text, with_ids=True).collect()
    for r in out:
        got[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in TEXTS:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want = {(k, k * 2048, len(ids[k * 2048 : (k + 1) * 2048]), zlib.crc32(np.array(ids[k * 2048 : (k + 1) * 2048], dtype="<u4").tobytes())) for k in range(-(-len(ids) // 2048))}
        assert {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got[i]} == want, i
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.best_fit_packing(none, text).count() == 0


def test_packing_ids_of_odd_words(spark):
    """Letters whose lower case ends in a mark, marks, and punctuation after them: ids equal the library's."""
    import random

    from tokenizers import Tokenizer

    text = vocabulary("word_bpe_49k.json").decode()
    t, e, r = Tokenizer.from_str(text), packing.encoder(text), random.Random(8)
    parts = ["\u0130", "DIL", "\u0131", "e\u0301", "\u0301", "\u0307", "\u00c9", "\u03a3", "\u03c3", "\u1e9e", "\ufb01", "\u01c5", "\u65e5", "\u0915\u093f", "\u0e33", "\u00aa", "\u2126", "\uac00", "\u200d", "a", "Zq", "the", ".", ",", ".,", "..", "!", "'", "-", "7", "_", "\U0001f600"]
    odd = ["\u0130.", "\u0130,", "D\u0130L\u0130, ve", "a\u0130.b", "e\u0301.", "\u03a3,"]
    odd += ["".join(r.choice(parts) for _ in range(r.randrange(1, 6))) + r.choice(["", ".", ",", ".,", " x"]) for _ in range(30000)]
    got = [np.frombuffer(e.encode(x), dtype="<u4").tolist() for x in odd]
    want = [x.ids for x in t.encode_batch(odd, add_special_tokens=False)]
    assert [x for x, a, b in zip(odd, got, want) if a != b] == []


def exact_sequences(lengths, cap):
    """Fewest sequences, by trying every place of every piece."""
    best = [len(lengths)]

    def place(i, load):
        if len(load) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(load)
            return
        for room in {x for x in load if x + lengths[i] <= cap}:
            k = load.index(room)
            place(i + 1, [*load[:k], room + lengths[i], *load[k + 1 :]])
        place(i + 1, [*load, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


def test_plan_against_exact_packing():
    """Small instances: what the reduction fixes is in some best packing, and the whole is at most one sequence off."""
    rng = np.random.default_rng(9)
    worse = 0
    for _ in range(150):
        cap = int(rng.integers(8, 20))
        lengths = [int(x) for x in rng.integers(1, cap + 1, int(rng.integers(1, 10)))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        plan, best = packing.Plan(dict(counts), cap), exact_sequences(lengths, cap)
        left = dict(counts)
        for x, runs in plan.runs.items():
            ends = [r[0] for r in runs[1:]] + [counts[x]]
            left[x] -= sum(max(0, min(first + end - rank, plan.reduced) - first) for (rank, first, _), end in zip(runs, ends))
        rest = [x for x, n in left.items() for _ in range(n)]
        assert plan.reduced + exact_sequences(rest, cap) == best, (lengths, cap)
        assert best <= plan.sequences <= best + 1
        worse += plan.sequences > best
    assert worse <= 5


def test_plan():
    rng = np.random.default_rng(3)
    for top, cap in ((10, 10), (30, 20), (100, 64), (500, 128)):
        counts = {int(x): int(rng.integers(1, top)) for x in rng.integers(1, cap + 1, 25)}
        plan = packing.Plan(counts, cap)
        load = defaultdict(list)
        for length, runs in plan.runs.items():
            ends = [r[0] for r in runs[1:]] + [counts[length]]
            for (rank, first, offset), end in zip(runs, ends):
                for k in range(end - rank):
                    load[first + k].append((offset, length))
        assert sum(map(len, load.values())) == sum(counts.values()) and set(load) == set(range(plan.sequences))
        for p in load.values():
            at = 0
            for offset, length in sorted(p):
                assert offset == at
                at += length
            assert at <= cap
        assert plan.sequences <= 1.23 * sum(k * v for k, v in counts.items()) / cap + 1
    assert packing.Plan({6: 2, 4: 2}, 10).reduced == 2


def test_quotation_linking(spark):
    rows = [("c", 0, "First question here\n\nwith two parts"), ("c", 1, "> first  QUESTION here\nan answer"), ("c", 2, "> > with two parts\n> an answer\nthanks"), ("c", 3, "no quote"), ("c", 4, "> never said\nx"), ("c", 5, None), ("c", 6, ""), ("d", 0, "an answer"), ("d", 1, "> thanks\nother talk"), (None, 1, "> an answer"), ("e", 0, "same"), ("e", 1, "same"), ("e", 2, "> same"), ("e", 2, "> same")]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, text string").withColumns({"key": F.lit(1), "up": F.lit(2), "depth": F.lit(9)})
    got = {(r["conv_id"], r["turn"]): (r["reply"], r["parent_turn"], r["thread_turn"], r["depth"]) for r in chat_format.link_quotes(df).collect()}
    assert got["c", 0][1:] == (None, 0, 0) and got["c", 1] == ("an answer", 0, 0, 1) and got["c", 2] == ("thanks", 1, 0, 2)
    assert got["c", 3][1:] == (None, 3, 0) and got["c", 4] == ("x", None, 4, 0) and got["c", 5] == (None, None, 5, 0) and got["c", 6][0] == ""
    assert got["d", 1][1] is None and got["e", 2][1:] == (1, 1, 1) and got[None, 1] == ("", None, 1, 0)
    assert chat_format.link_quotes(df).count() == len(rows) and chat_format.link_quotes(df.filter("false")).count() == 0


def brute_links(rows):
    """(parent, thread, depth) of each (conv, turn), message by message."""
    own, parent = defaultdict(list), {}
    for c, t, text in rows:
        found = chat_format.passages(text or "")
        said = "\n".join(s for level, s in found if not level) if any(level for level, _ in found) else text or ""
        own[c, t].append({chat_format.normal(x) for x in [said, *(s for level, s in found if not level)]} - {""})
    for c, t, text in rows:
        found = [(level, i, s) for i, (level, s) in enumerate(chat_format.passages(text or "")) if level]
        for level in {x[0] for x in found}:
            together = [s for x, _, s in found if x == level]
            found += [(level, -1, "\n".join(together))] if len(together) > 1 else []
        for level, i, s in sorted(found):
            hits = [u for (d, u), keys in own.items() if d == c and u < t and any(chat_format.normal(s) in k for k in keys)]
            if hits:
                parent[c, t] = min(parent.get((c, t), (level, i, max(hits))), (level, i, max(hits)))
                break
    out = {}
    for c, t, _ in rows:
        depth, top = 0, t
        while (c, top) in parent:
            depth, top = depth + 1, parent[c, top][2]
        out[c, t] = (parent[c, t][2] if (c, t) in parent else None, top, depth)
    return out


@pytest.mark.parametrize("span", [1, 3, 1024])
def test_quotation_linking_brute(spark, monkeypatch, span):
    """Random mail of few different passages, so that most are said many times; turns with gaps, repeats and one negative."""
    monkeypatch.setattr(chat_format, "SPAN", span)
    rng = np.random.default_rng(14)
    say = ["ok", "Ok", "yes  please", "no", "see below", "thanks\na lot"]
    rows = [("c", -4, "ok")]
    for conv in ("c", "d", "e"):
        for turn in np.sort(rng.integers(0, 40, 30)).tolist():
            parts = [("> " * int(rng.integers(0, 3))) + line for _ in range(int(rng.integers(1, 4))) for line in str(rng.choice(say)).split("\n")]
            rows.append((conv, turn, "\n".join(parts) if rng.random() > 0.05 else None))
    got = {}
    for r in chat_format.link_quotes(spark.createDataFrame(rows, "conv_id string, turn bigint, text string")).collect():
        got[r["conv_id"], r["turn"]] = (r["parent_turn"], r["thread_turn"], r["depth"])
    assert got == brute_links(rows)
    assert sum(p is not None for p, _, _ in got.values()) > 30


def test_quotation_linking_of_one_passage(spark):
    """A conversation whose messages all say and quote the same: as many entries as messages, not their pairs."""
    n = 4000
    df = spark.range(n).select(F.lit("c").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "ok").otherwise("ok\n> ok").alias("text"))
    out = chat_format.link_quotes(df)
    assert out.filter("turn > 0 and parent_turn = turn - 1 and depth = turn and thread_turn = 0").count() == n - 1
    entries = spark.range(n).select(F.lit("c").alias("conv_id"), F.col("id").alias("turn"), F.lit(1).alias("key"))
    linked = chat_format._latest_before(entries.withColumns({"level": F.lit(1), "pos": F.lit(0)}), entries)
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert linked.count() == n and "Window" in plan and plan.count("Join") == 1, "the only join is that with the spans, one row each"


def test_as_mail(spark):
    from lociflow.llm.queries import as_mail

    rows = [("c", 0, "a"), ("c", 1, "b"), ("c", 1, "b2"), ("c", 2, None), ("c", 5, "f"), (None, 1, "x"), ("c", None, "y")]
    got = sorted((str(r["conv_id"]), str(r["turn"]), r["text"]) for r in as_mail(spark.createDataFrame(rows, "conv_id string, turn bigint, text string")).collect())
    assert got == sorted([("c", "0", "a"), ("c", "1", "b\n> a"), ("c", "1", "b2\n> a"), ("c", "2", "> b\n> > a"), ("c", "5", "f"), ("None", "1", "x"), ("c", "None", "y")])


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    text = vocabulary("byte_bpe_50k.json").decode()
    t, c = Tokenizer.from_str(text), bpe.Coder(text)
    rng = np.random.default_rng(11)
    odd = ["".join(rng.choice(list("ab  \n\t.,!'sdtrevml0129é日 <|>$$xx"), int(n))) for n in rng.integers(1, 80, 400)] + ["aaaaaaaaaaaa", "it's we'll  <|endoftext|><|endoftext|> \x85 \x1c", "x" * 5000]
    for x in odd + [x for _, x in TEXTS if x]:
        ids = t.encode(x, add_special_tokens=False).ids
        assert c.encode(x) == ids and c.automaton.decode(ids) == t.decode(ids, skip_special_tokens=False)
        assert c.emit(x) == (len(ids), ",".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))
    rows = docs.select("text", bpe.digest_udf(text)("text").alias("d"), bpe.decode_udf(text)(bpe.encode_udf(text)("text")).alias("back")).collect()
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["d"]["n"] == len(ids) and r["d"]["ids"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["back"] == (r["text"] or "")
    assert none.select(bpe.digest_udf(text)("text")).count() == 0


def test_bpe_table(monkeypatch):
    """Odd strings, a table that is emptied often, and long words in linear time."""
    import random
    import time

    from tokenizers import Tokenizer

    text = vocabulary("byte_bpe_50k.json").decode()
    t, r = Tokenizer.from_str(text), random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz ETAOIN0129.,!'\u00e9\u00fc\u00df\u65e5\u672c\u0301\U0001f642  -_\n\t\xa0"
    odd = ["".join(r.choice(letters) for _ in range(r.randrange(1, 50))) for _ in range(20000)]
    want = [x.ids for x in t.encode_batch(odd, add_special_tokens=False)]
    for states in (bpe.STATES, 500):
        monkeypatch.setattr(bpe, "STATES", states)
        c = bpe.Coder(text)
        assert [x for x, ids in zip(odd, want) if c.encode(x) != ids] == []
        assert len(c.automaton.items) <= states and all(len(w) <= bpe.LETTERS for w in c.automaton.words)
    word = "".join(r.choice("abcdefgh") for _ in range(300_000))
    assert c.encode(word) == t.encode(word, add_special_tokens=False).ids
    took = []
    for n in (1_000_000, 10_000_000):
        began = time.process_time()
        assert c.automaton.decode(c.encode("xy" * (n // 2))) == "xy" * (n // 2)
        took.append(time.process_time() - began)
    assert took[1] < 25 * max(took[0], 0.1), took


def test_language_id(spark, docs, none):
    rng = np.random.default_rng(2)
    kinds = {"aa": ["kalo", "miru", "tasen", "volka"], "bb": ["xyqu", "zzorp", "wexim", "jukk"]}
    rows = [(i, " ".join(rng.choice(kinds[k], 40)), k) for i in range(60) for k in (["aa", "bb"][i % 2],)]
    model = language_id.fit(spark.createDataFrame(rows + [(99, None, "aa"), (98, "x", None)], "doc_id bigint, text string, lang string"))
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), model).collect()}
    assert all(got[i]["lang_pred"] == k and not got[i]["rejected"] and 0 <= got[i]["score"] <= 1 for i, _, k in rows)
    odd = {r["text"]: r for r in language_id.identify(docs, model).collect()}
    assert all(odd[x]["lang_pred"] == "und" and odd[x]["score"] == 0 and odd[x]["rejected"] for x in (None, "", "   ", "!!! %%%"))
    assert language_id.identify(none, model).count() == 0
    empty = language_id.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_language_id_held_out(spark):
    """Names of labelled documents that the model has not seen, by the query itself."""
    from conftest import DATA

    from lociflow.llm.queries import QUERIES

    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = QUERIES["op7_language_id"](spark, f"{DATA}/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert len(held) > 100 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in rows) <= 0.02 * len(rows)


def test_language_id_of_short_texts(spark):
    """Blocks of so few bytes are stored raw: all languages had one size, the larger language's name, and a rejection."""
    rng = np.random.default_rng(6)
    kinds = {"aa": ["kalo", "miru", "tasen", "volka"], "bb": ["xyqu", "zzorp", "wexim", "jukk"]}
    rows = [(" ".join(rng.choice(kinds[k], 40)), k) for k in ["aa"] * 60 + ["bb"] * 40]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    short = [(" ".join(kinds[k][i : i + n]), k) for k in kinds for n in (2, 3) for i in range(2)]
    got = language_id.identify(spark.createDataFrame([*short, ("\u65e5\u672c", "aa")], "text string, lang string"), model).collect()
    assert [r["text"] for r in got[:-1] if r["lang_pred"] != r["lang"] or r["score"] == 0] == []
    assert not any(r["rejected"] for r in got) and got[-1]["score"] == 0, "no size tells the last from any language"


def test_language_id_sample_of_many_copies(spark, monkeypatch):
    """Copies of one text, first by hash, do not fill the sample."""
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 3)
    df = spark.createDataFrame([(w,) for w in WORDS[:6]], "text string").orderBy(F.xxhash64("text"))
    texts = [r["text"] for r in df.collect()]
    model = language_id.fit(spark.createDataFrame([(t, "aa") for t in [texts[0]] * 20 + texts], "text string, lang string"))
    assert model.dictionaries == (("aa", "\n".join(texts[:3]).encode()),)


def test_worker_holds_one_memory():
    from lociflow.llm.shared import uses_worker

    text = vocabulary("word_bpe_49k.json").decode()
    uses_worker("minhash")
    minhash_dedup.shingles("some words of a text here")
    packing.encoder(text)
    uses_worker("minhash")
    assert minhash_dedup._HASHES
    uses_worker("packing")
    assert not minhash_dedup._HASHES and packing._ENCODERS
    uses_worker("language")
    assert not packing._ENCODERS


def test_minhash_dedup(spark, docs, none):
    got = defaultdict(set)
    for r in minhash_dedup.near_duplicates(docs).collect():
        got[r["doc_id"]].add((r["class_id"], r["kept"]))
    assert got[0] == {(0, True)} and got[1] == {(0, False)} and got[2] == {(0, False)} and got[3] == {(3, True), (3, False)}, "of a repeated row one stays"
    assert all(got[i] == {(i, True)} for i in (4, 5, 6, 11, 12, 13)) and got[8] == {(7, False)} and got[10] == {(9, False)} and got[None] == {(0, False)}
    assert minhash_dedup.near_duplicates(docs).count() == len(TEXTS) and minhash_dedup.near_duplicates(none).count() == 0


def brute_classes(rows):
    """Class of each row (id, text) by the definition, as the smallest id of the class, nulls last; blank texts alone."""
    x = [minhash_dedup.shingles(t or "") for _, t in rows]
    words = [tuple(minhash_dedup._WORD((t or "").lower())) or (t or "").strip() for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and words[a] and (words[a] == words[b] or minhash_dedup.similarity(x[a], x[b])):
                low, high = sorted((label[a], label[b]))
                label = [low if c == high else c for c in label]
    best = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in label}
    return label, [best[c] for c in label]


def check_classes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(c) for c in ("k", "g", "_k", "_stay", "_bucket", "_bitmap", "kept", "row")})
    label, best = brute_classes(rows)
    got = minhash_dedup.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in got) == sorted((str(i), str(c)) for (i, _), c in zip(rows, best))
    assert sum(r["kept"] for r in got) == len(set(label))
    left = [(r["doc_id"], r["text"], r["k"], r["_stay"], r["_bucket"]) for r in minhash_dedup.one_of_each(df).collect()]
    assert all(x[2:] == ("k", "_stay", "_bucket") for x in left)
    want = []
    for c in dict.fromkeys(label):
        group = [rows[i] for i in range(len(rows)) if label[i] == c]
        ids = [i for i, _ in group if i is not None]
        want.append([r for r in group if not ids or r[0] == min(ids)])
    assert len(left) == len(want)
    for group in want:
        assert any(x[:2] in group for x in left), group
    return left


def test_near_duplicates_of_repeated_ids(spark):
    """One id with two texts in either order, exact repeats, null ids, and a unique text beside a copied one under one id."""
    a, b = prose(51, 100), prose(52, 100)
    a1, b1 = a.replace(a.split(" ")[50], "edited", 1), b.replace(b.split(" ")[50], "edited", 1)
    for rows in ([(1, a), (1, b), (5, a1), (6, b1)], [(1, b), (1, a), (5, a1), (6, b1)], [(6, b1), (5, a1), (1, a), (1, b)]):
        assert sorted(x[0] for x in check_classes(spark, rows)) == [1, 1]
    left = check_classes(spark, [(0, b), (0, b), (1, a), (1, b), (7, None), (7, None), (8, ""), (8, "")])
    assert sorted(x[:2] for x in left if x[1]) == [(0, b), (1, a)]
    check_classes(spark, [(None, a), (None, a), (None, b), (3, b1), (None, prose(53, 60)), (4, "one two"), (None, "One two"), (9, "...")])
    assert check_classes(spark, []) == []


def test_near_duplicates_of_short_texts(spark):
    """Every pair of few shingles at or above the threshold is a candidate."""
    rng = np.random.default_rng(12)
    rows, found = [], 0
    for i in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(8, 26)))]
        cut = words[:-1] if len(words) % 3 else words[:-2] if len(words) > 16 else words[1:]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(cut))]
        x, y = minhash_dedup.shingles(rows[-2][1]), minhash_dedup.shingles(rows[-1][1])
        alike = minhash_dedup.similarity(x, y) > 0
        if alike and min(len(x), len(y)) <= minhash_dedup.SHORT:
            assert set(minhash_dedup.few(x)) & set(minhash_dedup.few(y))
            found += 1
    assert found > 150
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i] for i, _ in rows] == brute_classes(rows)[1]


def test_minhash_dedup_brute(spark):
    rng = np.random.default_rng(4)
    texts = []
    for i in range(150):
        if i % 3 == 0:
            texts.append(prose(100 + i, int(rng.integers(20, 150))))
        else:
            words = texts[int(rng.integers(0, i))].split(" ")
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(0, len(words)))] = "new" + str(rng.integers(0, 99))
            texts.append(" ".join(words))
    x = [minhash_dedup.shingles(t) for t in texts]
    pairs = [(i, j) for i in range(150) for j in range(i) if minhash_dedup.similarity(x[i], x[j]) > 0]
    want = brute_components(range(150), pairs)
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == want


def test_url_filter(spark):
    rows = [(1, "http://a.EXAMPLE.com/en/712?q#x"), (2, "https://example.com/en/8"), (3, "x://other.net/de/"), (4, "x://example.net/de/81"), (5, "x://badexample.com/en/7"), (6, None), (7, ""), (8, "no scheme/en/"), (9, "x://org/es/a"), (10, "x://b.org/ES/a"), (11, "x://com?a"), (11, "x://com?a")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("z")), URL_RULES).collect()}
    assert got[1] == ("a.example.com", "/en/712", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block") and got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block")
    assert got[5][2:] == ("com/en/", "block") and got[6] == got[7] == got[8] == ("", "", None, "allow") and got[9][2:] == ("org/es/", "block") and got[10][2:] == (None, "allow") and got[11] == ("com", "", None, "allow")


def test_url_filter_ties_and_nothing(spark):
    df = spark.createDataFrame([(1, "x://a.com/b"), (2, None)], "page_id bigint, url string")
    out = lambda rules: {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(df, rules).collect()}
    assert out([("com", "/b", "block"), ("com", "/b", "allow")])[1] == ("com/b", "block") and out([])[1] == (None, "allow")
    assert out([("a.com", "/", "allow"), ("com", "/b", "block")]) == {1: ("a.com/", "allow"), 2: (None, "allow")}
    assert url_filter.url_filter(df.filter("false"), URL_RULES).count() == 0


def test_cascade(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.filter("crc32(key) % 7 = 0")
    c = url_filter.build_cascade(keys, listed)
    assert len(c.levels) > 1
    assert keys.filter(c.has(F.col("key")) != (F.expr("crc32(key) % 7") == 0)).count() == 0


def test_token_counts(spark, docs, none, tmp_path):
    import public_tokenizers
    import tiktoken

    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.document_token_counts(docs, ranks, public_tokenizers.PATTERN, 50256).collect())
    assert got == sorted((str(i), len(coder.encode_ordinary(x or ""))) for i, x in TEXTS)
    assert token_counts.document_token_counts(none, ranks, public_tokenizers.PATTERN, 50256).count() == 0
    np.array([9, 5, 5, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 3], dtype="<u2").tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    for block in (1, 2, 3, 7, 100):
        rows = [(r["ordinal"], r["n_tokens"], r["ended"]) for r in token_counts.count_tokens(spark, f"file://{tmp_path}", 0, block_tokens=block).orderBy("ordinal").collect()]
        assert rows == [(0, 3, True), (1, 0, True), (2, 9, True), (3, 1, False)], block


def test_common_shingles_of_a_tile():
    import numpy as np

    from lociflow.llm import minhash_dedup as m

    rng = np.random.default_rng(5)
    texts = [np.unique(rng.integers(0, 60, 25)).astype(np.uint64) for _ in range(20)] + [np.array([1000], dtype=np.uint64), np.array([1000, 1001], dtype=np.uint64)]
    home, other = np.array([0, 3, 20, 5]), np.arange(1, 22)
    got = m.common(texts, home, other)
    for i, a in enumerate(home):
        for j, b in enumerate(other):
            if a != b:
                assert got[i, j] == len(set(texts[a].tolist()) & set(texts[b].tolist()))


def test_near_duplicates_tiles_a_large_bucket(spark, monkeypatch):
    """Near copies of different distances and texts around one passage, in tiles of a few texts, against brute force."""
    import random

    from lociflow.llm import minhash_dedup as m

    monkeypatch.setattr(m, "SMALL", 3)
    monkeypatch.setattr(m, "HOMES", 7)
    monkeypatch.setattr(m, "OTHERS", 11)
    r = random.Random(3)
    word = lambda: "w" + str(r.randrange(10**6))
    base, passage = [word() for _ in range(140)], [word() for _ in range(160)]
    texts = []
    for _ in range(45):
        t = list(base)
        for at in r.sample(range(140), r.choice([3, 4, 5, 6])):
            t[at] = word()
        texts.append(" ".join(t))
    for _ in range(30):
        texts.append(" ".join(passage + [word() for _ in range(r.choice([30, 45, 60]))]))
    x = [m.shingles(t) for t in texts]
    label = list(range(len(x)))
    for a in range(len(x)):
        for b in range(a):
            if m.similarity(x[a], x[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if c == high else c for c in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {row["doc_id"]: row["class_id"] for row in m.near_duplicates(docs).collect()}
    assert got == dict(enumerate(label))
