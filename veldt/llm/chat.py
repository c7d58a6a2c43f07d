"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Loggers often write a conversation anew after each turn, so that one is a prefix of the next. Each turn is hashed with
its position, role and text; the running XOR of these 128-bit hashes, in a window over one conversation, identifies
every turn prefix. A conversation whose whole hash is a proper prefix's hash of another one is not maximal and goes
(anti-join against the distinct prefixes, so a first turn that everybody shares is one row). Of exact copies the one
with the smallest id stays. The maximal conversations are rendered.

Defined cases: turns stand by turn number (null first), then role, then text; repeated rows are repeated turns; a null
role renders as "unknown" and a null text as empty, but for comparison null differs from empty; rows with a null conversation
id make one conversation, which comes last among copies. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import materialize

#: The rendering of one turn, and what ends a conversation.
TURN = "<|{role}|>\n{text}<|end|>\n"
END = "<|endofconversation|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n, h1, h2): each turn prefix of each conversation, with the conversation's number of turns."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    whole = Window.partitionBy("conv_id")
    t = turns.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("pos"), F.count(F.lit(1)).over(whole).alias("n"))
    shape = F.when(F.col("role").isNull(), 1).otherwise(0) + F.when(F.col("text").isNull(), 2).otherwise(0)
    h = lambda seed: F.xxhash64(F.lit(seed), F.col("pos"), shape, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return t.select("conv_id", "pos", "n", F.bit_xor(h(1)).over(running).alias("h1"), F.bit_xor(h(2)).over(running).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged): the conversations that stay; n_logged: the conversation and its exact copies."""
    p = materialize(prefixes(turns), "chat")
    proper = p.filter("pos < n").select("pos", "h1", "h2").distinct()
    whole = p.filter("pos = n").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logged"))
    return whole.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_logged")


def _turn(x: Column, template: str) -> Column:
    filled = {"role": F.coalesce(x["role"], F.lit("unknown")), "text": F.coalesce(x["text"], F.lit(""))}
    parts, rest = [], template
    while rest:
        at, name = min(((rest.find("{%s}" % k), k) for k in filled if "{%s}" % k in rest), default=(len(rest), None))
        parts.append(F.lit(rest[:at]))
        if name is None:
            break
        parts.append(filled[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def format_chats(turns: DataFrame, template: str = TURN, end: str = END) -> DataFrame:
    """(conv_id, n_turns, n_logged, rendered) for each maximal conversation."""
    t = turns.select("conv_id", "turn", "role", "text")
    stay = maximal(t)
    whole = t.join(stay.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id"))).groupBy("conv_id", "n_turns", "n_logged")
    turns_of = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("a"), "turn", F.col("role").isNotNull().alias("b"), "role", F.col("text").isNotNull().alias("c"), "text")))
    text = F.concat(F.array_join(F.transform(turns_of, lambda x: _turn(x, template)), ""), F.lit(end))
    return whole.agg(text.alias("rendered"))


def query(turns: DataFrame) -> DataFrame:
    return format_chats(turns)


SQL = """
WITH t AS (SELECT conv_id, turn, role, text,
                  row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
                  string_agg(md5(coalesce('r' || role, '') || '|' || coalesce('t' || text, '')), '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
s AS (SELECT h, n, min(conv_id) AS conv_id, count(*) AS n_logged FROM t WHERE pos = n
      AND h NOT IN (SELECT h FROM t WHERE pos < n) GROUP BY h, n)
SELECT t.conv_id, s.n AS n_turns, s.n_logged,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY pos) || '<|endofconversation|>' AS rendered
FROM s JOIN t USING (conv_id) GROUP BY t.conv_id, s.n, s.n_logged
"""
