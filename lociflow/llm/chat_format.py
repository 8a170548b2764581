"""Chat formatting by quotation linking.

A message is read line by line: the `>` marks at the start of a line are its quote level, and consecutive lines of one level are one
passage. Passages are normalised (case, white space) and hashed. Each message is entered under the hash of its whole own text and of
each of its own passages; quoted passages are put among these, in order of turns within the conversation and the hash, and the latest
earlier message that has the passage is what is quoted: each entry is read once, however many messages say and quote the same. Turns are
cut into spans, so that such a passage of a long conversation is no single task; what a span begins with comes from the spans before it,
one row each. The reply's parent is the original of its shallowest quoted passage (the first of them in the text).
Messages that quote nothing known begin a thread. Depth and thread come from pointer jumping.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .shared import delete, hot_join, written

#: Turns of a span.
SPAN = 1024

_MARKS = re.compile(r"^[ \t]*((?:>[ \t]*)+)")
_SPACE = re.compile(r"\s+")


def passages(text: str) -> list[tuple[int, str]]:
    """Level and text of each passage; blank lines end a passage of level 0."""
    out: list[tuple[int, list[str]]] = []
    new = True
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level, rest = (m[1].count(">"), line[m.end() :]) if m else (0, line)
        if not rest.strip():
            new = new or level == 0
            continue
        if out and not new and out[-1][0] == level:
            out[-1][1].append(rest)
        else:
            out.append((level, [rest]))
        new = False
    return [(level, "\n".join(lines)) for level, lines in out]


def normal(text: str) -> str:
    return _SPACE.sub(" ", text.lower()).strip()


def _parse_series(texts: pd.Series) -> pd.DataFrame:
    import xxhash

    key = lambda s: xxhash.xxh3_64_intdigest(s) - (1 << 63)
    rows = []
    for t in texts:
        if t is None:
            rows.append((None, [], []))
            continue
        found = passages(t)
        quoted = any(level for level, _ in found)
        own = "\n".join(s for level, s in found if not level) if quoted else t
        keys = {key(n) for n in [normal(own), *(normal(s) for level, s in found if not level)] if n}
        quotes: dict[int, list[str]] = {}
        listed = [(level, i, key(normal(s))) for i, (level, s) in enumerate(found) if level]
        for level, s in found:  # all of a level together may be one original, too
            if level:
                quotes.setdefault(level, []).append(s)
        listed += [(level, -1, key(normal("\n".join(s)))) for level, s in quotes.items() if len(s) > 1]
        rows.append((own, sorted(keys), [{"level": a, "pos": b, "key": c} for a, b, c in listed]))
    return pd.DataFrame(rows, columns=["own", "keys", "quotes"])


def _parse(text):
    return F.pandas_udf(_parse_series, "struct<own:string,keys:array<bigint>,quotes:array<struct<level:int,pos:int,key:bigint>>>")(text)


def _latest_before(quoted: DataFrame, originals: DataFrame) -> DataFrame:
    """`quoted` with `_from`: the last turn before the quote's own that has its key in the conversation, or null."""
    key, span = ["conv_id", "key"], F.floor(F.col("turn") / SPAN).alias("_span")
    entry = lambda df, of, quote: df.select(*key, span, "turn", of.alias("_own"), F.lit(quote).alias("_quote"), *(F.col(c) if quote else F.lit(None).cast("int").alias(c) for c in ("level", "pos")))
    entries = entry(originals, F.col("turn"), False).unionByName(entry(quoted, F.lit(None).cast(originals.schema["turn"].dataType), True))
    before = lambda c, w: F.last(c, ignorenulls=True).over(w)
    inside = entries.withColumn("_in", before("_own", Window.partitionBy(*key, "_span").orderBy("turn", F.desc("_quote")).rowsBetween(Window.unboundedPreceding, 0)))
    spans = entries.groupBy(*key, "_span").agg(F.max("_own").alias("_last"))
    carried = spans.withColumn("_carry", before("_last", Window.partitionBy(*key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))).filter("_carry is not null").drop("_last")
    return inside.filter("_quote").join(carried, [*key, "_span"], "left").select("conv_id", "turn", "level", "pos", F.coalesce("_in", "_carry").alias("_from"))


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """One row per message: its columns conv_id and turn, reply (own text without quotes), n_quotes, parent_turn, thread_turn, depth.

    Within a conversation, (thread_turn, depth, turn) is the reply order. Null text has a null reply and no quotes; an empty one none
    either. Messages with a null conversation or turn begin a thread of their own. Of rows that repeat (conv_id, turn) each stays. A
    conversation that holds a third of all rows is no group of one task, nor is a passage that all its messages say and quote, nor are the
    replies to one message.
    Other columns, whatever their names, are left out; an empty table gives an empty result.
    """
    src = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), _parse(text).alias("p"))
    parsed, _ = written(src.select("conv_id", "turn", "p.own", "p.keys", "p.quotes"), "messages")
    whole = parsed.filter("conv_id is not null and turn is not null")
    originals = whole.select("conv_id", "turn", F.explode("keys").alias("key")).distinct()
    quoted = whole.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.pos", "q.key").distinct()
    hits = _latest_before(quoted, originals).filter("_from is not null")
    best = hits.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "pos", "_from")).alias("_b")).select("conv_id", "turn", F.col("_b._from").alias("parent_turn"))
    nodes = parsed.select("conv_id", "turn").filter("conv_id is not null and turn is not null").distinct().join(best, ["conv_id", "turn"], "left")
    root = F.col("parent_turn").isNull()
    at = nodes.select("conv_id", "turn", "parent_turn", F.coalesce("parent_turn", "turn").alias("up"), F.when(root, 0).otherwise(1).cast("bigint").alias("depth"), root.alias("done"))
    new, _ = written(at, "threads")
    ended = new.filter("done")
    while not new.filter("not done").isEmpty():  # paths halve each round; rows that reached the thread's first turn leave
        active = new.filter("not done")
        above = ended.unionByName(active).select("conv_id", F.col("turn").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("done").alias("_done"))
        step, path = hot_join(active.drop("done"), above, ["conv_id", "up"])
        new, _ = written(step.select("conv_id", "turn", "parent_turn", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_done").alias("done")), "threads")
        delete(messages.sparkSession, path)
        ended = ended.unionByName(new.filter("done"))
    state = ended
    out = parsed.select("conv_id", "turn", F.col("own").alias("reply"), F.size("quotes").alias("n_quotes")).join(state.select("conv_id", "turn", "parent_turn", F.col("up").alias("thread_turn"), "depth"), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "reply", "n_quotes", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))


def conversations(linked: DataFrame) -> DataFrame:
    """Messages in reply order: whole table dealt by ranges, so that a long conversation may span tasks."""
    order = ["conv_id", "thread_turn", "depth", "turn"]
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)
