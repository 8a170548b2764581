"""The registered query of each operator, over whole tables, and oracle SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat_format, embedding_dedup, language_id, lexical_search, line_dedup, merkle, minhash_dedup, nearest, packing, pii, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_dedup(spark, sf_dir):
    """Documents without the lines whose template recurs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs)


def _line_levels(levels: int) -> str:
    """SQL of the template that lines of mixed leaves get at each level of the tree; see `line_dedup`."""
    out = ["r0 AS (SELECT dd.*, [n::varchar, array_to_string(head, ' ')] AS branch FROM dd JOIN mixed USING (n, head) WHERE n > 4)"]
    for i in range(levels):
        out.append(f"""t{i} AS (SELECT branch, toks, n_docs, unnest(toks[5:]) AS tok, generate_subscripts(toks[5:], 1) AS pos FROM r{i}),
s{i} AS (SELECT branch, pos, tok, sum(n_docs) AS support FROM t{i} GROUP BY ALL),
a{i} AS (SELECT branch, sum(n_docs) AS total FROM r{i} GROUP BY ALL),
f{i} AS (SELECT t.branch, t.toks, any_value(t.n_docs) AS n_docs, 4 + count(*) FILTER (WHERE 2 * support > total) >= 0.75 * len(t.toks) AS fits,
    arg_min(struct_pack(pos := pos, tok := tok), struct_pack(x := -support, y := pos)) FILTER (WHERE support > t.n_docs AND support < total) AS best
    FROM t{i} t JOIN s{i} USING (branch, pos, tok) JOIN a{i} USING (branch) GROUP BY 1, 2),
r{i + 1} AS (SELECT toks, n_docs, list_concat(branch, [best.pos::varchar, best.tok]) AS branch FROM f{i} WHERE NOT fits AND best IS NOT NULL)""")
    out.append("g AS (" + " UNION ALL ".join(f"SELECT toks, branch FROM f{i} WHERE fits" for i in range(levels)) + ")")
    return ",\n".join(out)


ORACLES["op1_line_dedup"] = rf"""
WITH l AS (SELECT doc_id, i, raw, trim(regexp_replace(raw, '[ \t\r]+', ' ', 'g'), ' ') AS line
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) x),
k AS (SELECT *, list_transform(string_split(line, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS toks FROM l WHERE line <> ''),
d AS (SELECT DISTINCT doc_id, line, toks, len(toks) AS n, toks[1:4] AS head FROM k),
dd AS (SELECT n, head, toks, count(DISTINCT doc_id) AS n_docs FROM d GROUP BY 1, 2, 3),
mixed AS (SELECT n, head FROM d GROUP BY 1, 2 HAVING count(DISTINCT toks) > 1 AND min(doc_id) <> max(doc_id)),
{_line_levels(line_dedup.LEVELS)},
m AS (SELECT d.doc_id, d.line, coalesce(g.branch, list_concat(['='], d.toks)) AS template FROM d LEFT JOIN g ON d.toks = g.toks),
f AS (SELECT template, min(doc_id) AS first FROM m GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
x AS (SELECT DISTINCT m.doc_id, m.line FROM m JOIN f USING (template) WHERE m.doc_id <> f.first),
o AS (SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.i) FILTER (WHERE x.line IS NULL) AS text, count(*) AS n_lines, count(*) FILTER (WHERE x.line IS NOT NULL) AS n_dropped
    FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.line = x.line GROUP BY 1)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text, CAST(coalesce(n_lines, 0) AS int) AS n_lines, CAST(coalesce(n_dropped, 0) AS int) AS n_dropped
FROM documents d LEFT JOIN o USING (doc_id)"""


def vocabulary(name: str) -> bytes:
    """A file of the installed public tokenizers: a few MB that go to the workers with the code."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query
def op2_embedding_dedup(spark, sf_dir):
    """Links, components and kept vectors of all embeddings at cosine 0.98."""
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


@query
def op3_nearest(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 100, among all others."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op4_best_fit_packing(spark, sf_dir):
    """Where every piece of every document lies in sequences of 2048 tokens."""
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json").decode())


def as_mail(talk: DataFrame) -> DataFrame:
    """The conversations as mail: each message quotes the one of the turn before it, and of the turn before that, one level deeper.

    Nothing is quoted where that turn is missing or its text null. Rows that repeat (conv_id, turn) stay rows of their own; quoted of
    them is the smallest text. Rows with a null conversation or turn quote nothing. A null text under quotes is quotes alone, and empty without.
    """
    key = ["conv_id", "turn"]
    one = talk.select(*key, "text").groupBy(*key).agg(F.min("text").alias("text"))
    before = lambda n: one.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(f"_t{n}"))
    quote = lambda c, marks: F.regexp_replace(c, "(?m)^", marks)
    out = talk.select(*key, "text").join(before(1), key, "left").join(before(2), key, "left")
    return out.select(*key, F.concat_ws("\n", "text", quote(F.col("_t1"), "> "), quote(F.col("_t2"), "> > ")).alias("text"))


@query
def op5_quotation_linking(spark, sf_dir):
    """Conversations rebuilt from mail. The table itself holds no quotes, so that its whole content is turned into mail first: turn by
    turn with two levels of quotes. The operator gets that text alone and finds parents, depth and texts again."""
    mail = as_mail(table(spark, sf_dir, "conversations"))
    return chat_format.conversations(chat_format.link_quotes(mail)).withColumn("reply", F.md5(F.trim(F.regexp_replace("reply", "\\s+", " ")))).drop("n_quotes")


ORACLES["op5_quotation_linking"] = r"""
WITH k AS (SELECT conv_id, turn, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS reply, lag(turn) OVER w AS parent_turn, row_number() OVER w - 1 AS depth, min(turn) OVER (PARTITION BY conv_id) AS thread_turn
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, reply, parent_turn, thread_turn, depth FROM k"""


@query
def op6_bpe(spark, sf_dir):
    """Token counts and digests of the ids and of the decoded text of every document."""
    digest = bpe.digest_udf(vocabulary("byte_bpe_50k.json").decode())
    out = table(spark, sf_dir, "documents").select("doc_id", digest("text").alias("d"))
    return out.select("doc_id", F.col("d.n").alias("n_tokens"), F.col("d.ids").alias("ids_sha256"), F.col("d.decoded").alias("decoded_sha256"))


@query
def op7_language_id(spark, sf_dir):
    """The language of every document, learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    model = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op8_minhash_dedup(spark, sf_dir):
    """The near-duplicate class of every document, and whether it is the one that stays."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_token_counts(spark, sf_dir):
    """Tokens of every document, counted in flat files of 16-bit ids that end documents with the id 50256."""
    import public_tokenizers

    return token_counts.document_token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, 50256)


@query
def op11_merkle_manifest(spark, sf_dir):
    """The manifest of all documents by source, and a check of it against documents whose line breaks are lost where 2 divides crc32(doc_id)."""
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lost = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    tampered = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n")), merkle.leaf(*fields(lost)))
    out = merkle.manifest(docs, merkle.leaf(*fields(F.col("text"))), F.col("source"), [F.col("doc_id")], {"doc_id": F.col("doc_id"), "tampered": tampered})
    out = out.withColumn("folded_root", merkle.fold(F.col("path"), F.coalesce("tampered", "leaf")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_tree(name: str, nodes: str) -> str:
    """CTEs of a forest over `nodes` (tree, pos from 0, node): all runs by level, and the climb of each leaf with its siblings."""
    return f"""{name}_n AS (SELECT tree, pos, node FROM {nodes}),
{name}_up AS (SELECT tree, 0 AS level, list(node ORDER BY pos) AS nodes FROM {name}_n GROUP BY tree
    UNION ALL SELECT tree, level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda r: sha256(array_to_string(nodes[3 * r + 1:3 * r + 3], ''))) FROM {name}_up WHERE len(nodes) > 1),
{name}_top AS (SELECT tree, nodes[1] AS top FROM {name}_up WHERE len(nodes) = 1),
{name}_run AS (SELECT tree, level, r, nodes[3 * r + 1:3 * r + 3] AS run FROM (SELECT tree, level, nodes, unnest(range(0, (len(nodes) + 2) // 3)) AS r FROM {name}_up WHERE len(nodes) > 1) x),
{name}_climb AS (SELECT tree, pos AS leaf, pos, 0 AS level, []::struct(l varchar, r varchar)[] AS path FROM {name}_n
    UNION ALL SELECT c.tree, c.leaf, c.pos // 3, c.level + 1, list_append(c.path, {{'l': array_to_string(run[1:c.pos % 3], ''), 'r': array_to_string(run[c.pos % 3 + 2:], '')}})
    FROM {name}_climb c JOIN {name}_run g ON c.tree = g.tree AND c.level = g.level AND c.pos // 3 = g.r),
{name}_path AS (SELECT tree, leaf, arg_max(path, level) AS path FROM {name}_climb GROUP BY 1, 2)"""


def _sql_leaf(text: str) -> str:
    fields = [f"CAST({c} AS varchar)" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({c}), ':', {c}), '-')" for c in fields) + "))"


#: crc32 of a short text by its definition, as DuckDB has no function for it.
_SQL_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(CAST(doc_id AS varchar), ''), lambda c: ascii(c)::bigint)), lambda s, c: list_reduce(list_prepend(xor(s, c), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, source, lang, n_chars, {_sql_leaf("text")} AS leaf, {_SQL_CRC} % 2 = 0 AS bad, {_sql_leaf("replace(text, chr(10), '')")} AS lost FROM documents),
o AS (SELECT doc_id, leaf, CASE WHEN bad THEN lost ELSE leaf END AS seen, coalesce(concat('=', source), '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS node FROM d),
{_sql_tree("a", "o")},
s AS (SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, top AS node FROM a_top),
{_sql_tree("b", "s")},
f AS (SELECT o.doc_id, o.leaf, o.seen, s.node AS subroot, b_top.top AS root, list_concat(a_path.path, b_path.path) AS path
    FROM o JOIN a_path ON o.tree = a_path.tree AND o.pos = a_path.leaf JOIN s ON s.source = o.tree JOIN b_path ON b_path.leaf = s.pos, b_top),
g AS (SELECT *, list_reduce(list_prepend({{'l': seen, 'r': ''}}, path), lambda x, y: {{'l': sha256(concat(y.l, x.l, y.r)), 'r': ''}}).l AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: concat(p.l, p.r)), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g"""


@query
def op12_pii(spark, sf_dir):
    """Personal data in every document: counts and a digest of the base spans, and all spans."""
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(pii.spans_text(base), 256).alias("base_sha256"), pii.spans_text(F.col("pii")).alias("spans"))


def _sql_matches(name: str, pattern: str) -> str:
    """Matches of a pattern in `t` (r, text): places by running sums, and what lies around them."""
    return f"""{name}_p AS (SELECT r, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM t WHERE regexp_matches(text, '{pattern}')),
{name}_u AS (SELECT r, unnest(m) AS m, unnest(p[1:len(m)]) AS a, unnest(p[2:]) AS b, unnest(range(1, len(m) + 1)) AS i FROM {name}_p),
{name}_m AS (SELECT r, m, right(a, {pii.WINDOW}) AS a, left(b, {pii.WINDOW}) AS b, translate(concat(right(a, {pii.WINDOW}), chr(10), left(b, {pii.WINDOW})), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS near,
    regexp_replace(m, '[^0-9]', '', 'g') AS d, sum(length(a) + length(m)) OVER (PARTITION BY r ORDER BY i)::bigint AS stop FROM {name}_u)"""


def _sql_luhn(digits: str) -> str:
    at = f"CAST(substr(lpad({digits}, 19, '0'), i::int, 1) AS int)"
    return f"list_sum(list_transform(range(1, 20), lambda i: CASE WHEN i % 2 = 1 THEN {at} WHEN {at} > 4 THEN 2 * {at} - 9 ELSE 2 * {at} END)) % 10 = 0"


_near = lambda kind: f"regexp_matches(near, '(^|[^a-z])({pii.WORDS[kind]})([^a-z]|$)')"
_CARD_SQL = f"CASE WHEN length(d) BETWEEN 13 AND 19 THEN {_sql_luhn('d')} ELSE false END"
_INSIDE_SQL = f"regexp_extract(m, '{pii.INSIDE}')"
_ALONE_SQL = "NOT regexp_matches(a, '[A-Za-z0-9]$') AND NOT regexp_matches(b, '^[A-Za-z0-9]')"
_BIG = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
ORACLES["op12_pii"] = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{_sql_matches("e", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")},
{_sql_matches("i", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")},
{_sql_matches("c", r"[0-9]([ -]?[0-9])+")},
{_sql_matches("f", r"\+[0-9][ ().0-9-]+[0-9]")},
{_sql_matches("b", pii.IBAN)},
{_sql_matches("n", pii.NATIONAL)},
s AS (SELECT r, 1 AS k, 'email' AS kind, stop - length(m) AS start, stop, true AS base FROM e_m
    UNION ALL SELECT r, 2, 'ip', stop - length(m), stop, true FROM i_m WHERE len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST(concat('0', left(ltrim(x, '0'), 3)) AS int) > 255)) = 0
    UNION ALL SELECT r, 3, 'card', stop - length(m), stop, true FROM c_m WHERE {_CARD_SQL}
    UNION ALL SELECT r, 3, 'card', stop - length(m) + instr(m, x) - 1, stop - length(m) + instr(m, x) - 1 + length(x), false FROM (SELECT *, {_INSIDE_SQL} AS x FROM c_m WHERE length(d) > 16 AND NOT {_CARD_SQL} AND {_near("card")}) y
      WHERE x <> '' AND {_sql_luhn("regexp_replace(x, '[^0-9]', '', 'g')")}
    UNION ALL SELECT r, 4, 'phone', stop - length(m), stop, true FROM f_m WHERE length(d) BETWEEN 9 AND 15
    UNION ALL SELECT r, 4, 'phone', stop - length(m), stop, false FROM n_m WHERE {_ALONE_SQL} AND NOT regexp_matches(a, '{pii.LONGER}') AND NOT regexp_matches(m, '{pii.NO_NUMBER}') AND length(d) BETWEEN 7 AND 15 AND {_near("phone")}
    UNION ALL SELECT r, 5, 'iban', stop - length(m), stop, false FROM (SELECT *, replace(m, ' ', '') AS x FROM b_m WHERE {_ALONE_SQL}) y
      WHERE list_reduce(list_prepend(0::bigint, list_transform(string_split(concat(x[5:], x[1:4]), ''), lambda c: instr({_BIG}, c)::bigint - 1)), lambda s, v: CASE WHEN v > 9 THEN s * 100 + v ELSE s * 10 + v END % 97) = 1),
g AS (SELECT r, count(*) FILTER (WHERE k = 1) AS n_email, count(*) FILTER (WHERE k = 2) AS n_ip, count(*) FILTER (WHERE k = 3 AND base) AS n_card, count(*) FILTER (WHERE k = 4 AND base) AS n_phone,
    string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY k, start) FILTER (WHERE base) AS b, string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY k, start) AS spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (r)"""


@query
def op13_lexical_search(spark, sf_dir):
    """The ten best documents for every item of the benchmark."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Fixed value: the characters of a term.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLES["op13_lexical_search"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS terms FROM documents),
s AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
g AS (SELECT count(*)::bigint AS docs, sum(n)::bigint AS total FROM s),
i AS (SELECT item_id, t, count(*)::bigint AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS t FROM benchmark) x GROUP BY 1, 2),
p AS (SELECT r, t, count(*)::bigint AS tf FROM (SELECT r, unnest(terms) AS t FROM d) x WHERE t IN (SELECT t FROM i) GROUP BY 1, 2),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM p, g GROUP BY t, docs),
k AS (SELECT item_id, doc_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::bigint AS score
    FROM i JOIN w USING (t) JOIN p USING (t) JOIN s USING (r), g GROUP BY 1, 2, 3)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank, doc_id, score FROM k WHERE score > 0) x WHERE rank <= 10"""


@query
def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: The rules that pages are judged by.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


@query
def op9_url_filter(spark, sf_dir):
    """The verdict on every page's url."""
    return url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op9_url_filter"] = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES {", ".join(map(str, URL_RULES))}),
f AS (SELECT page_id, arg_max(concat(rh, rp), length(rh) + length(rp)) AS rule, arg_max(v, length(rh) + length(rp)) AS v FROM h JOIN r
    ON (host = rh OR ends_with(host, concat('.', rh))) AND starts_with(path, rp) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN f USING (page_id)"""
