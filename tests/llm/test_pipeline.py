"""Each stage of the corpus pipeline on what its predecessor kept, against a plain version, and all of them by run()."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
from conftest import DATA
from pyspark.sql import functions as F
from test_operators import brute_classes, prose

import corpus_pipeline as cp
from lociflow.llm.queries import ORACLES, QUERIES, vocabulary


def some_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select(*cp.COLUMNS)
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    texts = {r[0]: r[1] for r in rows}
    one, other = [i for i, t in texts.items() if t and 300 < len(t) < 3000][:2]
    words = texts[one].split(" ")
    words[len(words) // 2] = "edited"
    n = 10**6
    rows += [(n, texts[one], "en", None, 1), (n, texts[one], "en", None, 1), (n, " ".join(words), None, "s", None), (n + 1, texts[other], None, None, None), (None, texts[other], None, None, None), (None, prose(1, 30), None, None, None)]
    rows += [(n + 2, None, "en", "s", 0), (n + 3, "", "en", "s", 0), (n + 4, "12 34 !!", "en", "s", 8), (n + 5, texts[one][:200] * 300, "en", "s", None)]
    return spark.createDataFrame(rows, docs.schema), rows


def as_rows(df):
    return Counter(tuple(r) for r in df.select(*cp.COLUMNS).collect())


def test_stages(spark, tmp_path):
    docs, rows = some_documents(spark)
    clash = docs.withColumns({c: F.lit(c) for c in ("_p", "_id", "_drop", "k", "g", "row", "rejected", "kept")})
    assert cp.COLUMNS == tuple(docs.columns)

    kept = cp.language(spark, clash, "")
    kept.write.parquet(str(tmp_path / "a"))
    kept = spark.read.parquet(str(tmp_path / "a"))
    left = as_rows(kept)
    assert not left - Counter(rows) and kept.columns == list(cp.COLUMNS)
    gone = [r for r in (Counter(rows) - left).elements()]
    assert all(r in gone for r in rows if not any(c.isalpha() for c in r[1] or ""))
    assert sum(any(c.isalpha() for c in r[1] or "") for r in gone) <= 0.02 * len(rows)

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/a/*.parquet' WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, text) = 1")
    con.execute(f"CREATE VIEW ids AS SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) = 1")
    want = {i: (t, d) for i, t, _, d in con.execute(ORACLES["op1_line_dedup"]).fetchall() if (i,) in set(con.execute("SELECT doc_id FROM ids").fetchall())}
    cp.lines(spark, kept, "").write.parquet(str(tmp_path / "b"))
    lined = spark.read.parquet(str(tmp_path / "b"))
    after = defaultdict(list)
    for r in lined.collect():
        after[r["doc_id"]].append(r)
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    for i, (text, dropped) in want.items():
        assert [r["text"] for r in after[i]] == ([] if dropped and not text.strip(" ") else [text]), i
    assert len(after[None]) == sum(n for r, n in left.items() if r[0] is None), "rows without an id stay"

    before = [tuple(r) for r in lined.collect()]
    label, best = brute_classes([r[:2] for r in before])
    cp.near(spark, lined.withColumns({c: F.lit(c) for c in ("k", "g", "_stay", "_bucket")}), "").write.parquet(str(tmp_path / "c"))
    single = spark.read.parquet(str(tmp_path / "c"))
    stay = as_rows(single)
    assert not stay - Counter(before) and sum(stay.values()) == len(set(label))
    for c in set(label):
        group = [before[i] for i in range(len(before)) if label[i] == c]
        ids = [r[0] for r in group if r[0] is not None]
        assert sum(stay[r] for r in set(group) if not ids or r[0] == min(ids)) == 1
    assert len(set(label)) < len(before)

    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabulary("word_bpe_49k.json").decode())
    tokens = Counter()
    for (i, text, *_), n in stay.items():
        tokens[i] += n * (len(t.encode(text or "", add_special_tokens=False).ids) + 1)
    placed, load = Counter(), defaultdict(list)
    for r in cp.pack(spark, single, "").collect():
        placed[r["doc_id"]] += r["length"]
        load[r["sequence_id"]].append((r["offset"], r["length"]))
    assert placed == tokens
    for p in load.values():
        p.sort()
        assert [x for x, _ in p] == np.cumsum([0, *(n for _, n in p[:-1])]).tolist() and sum(p[-1]) <= 2048


def test_run(spark, tmp_path):
    docs, rows = some_documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["pipeline"](spark, str(tmp_path))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and 0 < out.count()
    ids = [r["doc_id"] for r in out.select("doc_id").distinct().collect()]
    assert set(ids) <= {r[0] for r in rows} and 10**6 + 2 not in ids and 10**6 + 4 not in ids


def test_empty(spark, tmp_path):
    docs, _ = some_documents(spark)
    for _, stage in cp.STAGES:
        assert stage(spark, docs.filter("false"), "").count() == 0
    nothing = docs.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields))
    for _, stage in cp.STAGES[1:]:
        assert stage(spark, nothing, "").count() == docs.count()
    assert cp.language(spark, nothing, "").count() == 0
