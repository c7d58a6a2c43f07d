"""Mixing sources to target weights by systematic sampling.

Targets: water-filling of the budget over the sources by weight, each stopped at `cap` times its source's size.
Copies: within a source, documents stand in one fixed order; each is expected target/size times. The prefix sum of
the expectations plus one offset of the source crosses an integer once for each copy, so a document is taken
floor or ceil of its expectation times and a source's total comes near its target.

The order is by size class, then by a salt of the document's hash, then by size and id, so that neighbours are of
like size. Ranks are added up from groups (source, size class, salt): a source that holds a third of all rows is
ranked in thousands of small groups; only the counts of the groups meet in one window of the source.

Defined cases: a null text has size 0; null sources form one source, last in order; documents of size 0 expect as
many copies as the others and take 0 words; repeated rows are sampled each for itself; null ids are kept. An empty
table gives an empty result. Reruns agree, for nothing depends on partitions or on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import n_words, quoted

WEIGHTS = (5, 2, 1)
SALTS = 256


def _digest(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, budget: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes: (source, source_size), a row for each source -> (source, source_size, target).

    The level x solves sum(min(cap * size, x * weight)) = budget * sum(size). Sources in order of cap * size / weight
    fill up one by one: of the first k full ones, x = (budget - their caps) / (weights of the others).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = t.withColumn("left_words", F.sum("source_size").over(whole) * F.lit(float(budget)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    t = t.withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left_words") / F.col("left_weight"))
    # Taking out a source that fills up raises the level, taking out one that does not lowers it: the highest is the level.
    target = F.least(F.col("most"), F.max("level").over(whole) * F.col("weight"))
    return t.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", budget: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs with the columns `__size`, `__source_size`, `__target`, `__copies` added. Needs `source`, `text` and the id."""
    salted = docs.withColumn("__size", n_words(F.col("text")))
    salted = salted.withColumn("__class", F.when(F.col("__size") > 0, F.floor(F.log2(F.col("__size").cast("double")) * 8)).otherwise(-1).cast("int"))
    salted = salted.withColumn("__salt", F.coalesce(_digest(F.col(id_col).cast("string"), 6), F.lit(0)) % SALTS)
    group = ["__source_key", "__class", "__salt"]
    salted = salted.withColumn("__source_key", F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce(F.col("source"), F.lit(""))))
    groups = salted.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__words"))
    sources = groups.groupBy("__source_key").agg(F.sum("__words").alias("source_size"))
    sources = sources.withColumn("source", F.when(F.col("__source_key") != "1", F.substring("__source_key", 2, 1 << 30)))
    aims = targets(sources.select("source", "source_size"), budget, cap, weights)
    aims = aims.select(F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce(F.col("source"), F.lit(""))).alias("__source_key"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    earlier = Window.partitionBy("__source_key").orderBy("__class", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(*group, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start")).join(aims, "__source_key")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("__size"), F.col(id_col)))
    ranked = salted.withColumn("__rank", rank).join(starts, group)
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    offset = _digest(F.concat(F.lit(f"{seed}:"), F.col("__source_key")), 8) / F.lit(4294967296.0)
    place = F.col("__start") + F.col("__rank")
    copies = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    return ranked.withColumn("__copies", copies.cast("long")).drop("__class", "__salt", "__source_key", "__start", "__rank")


def mixed_corpus(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, each document as often as it is taken."""
    id_col = options.get("id_col", "doc_id")
    # Whole rows travel as one column, so no name of theirs meets those that are added.
    packed = docs.select(F.struct(*quoted(docs.columns)).alias("__doc"), id_col, "text", "source")
    m = mix_sources(packed, **options).filter(F.col("__copies") > 0)
    m = m.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return m.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    m = mix_sources(docs.select("doc_id", "text", "source"))
    return m.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__copies").alias("copies"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) AS BIGINT), 0) % 256 AS salt
  FROM documents),
c AS (SELECT *, CASE WHEN size > 0 THEN CAST(floor(log2(CAST(size AS DOUBLE)) * 8) AS INT) ELSE -1 END AS class FROM d),
s AS (SELECT k, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY k),
w AS (SELECT *, source_size * 2.0::DOUBLE AS most,
             ([5.0, 2.0, 1.0]::DOUBLE[])[CAST((row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS INT)] AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - coalesce(sum(most) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w),
x AS (SELECT k, source_size, least(most, (max(level) OVER ()) * weight) AS target FROM l),
t AS (SELECT *, CAST('0x' || substr(md5('0:' || k), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM x),
r AS (SELECT c.*, row_number() OVER (PARTITION BY k ORDER BY class, salt, size, doc_id) AS place FROM c)
SELECT doc_id, size, source_size, target,
       CAST(floor(place * rate + u) - floor((place - 1) * rate + u) AS BIGINT) * size AS taken,
       CAST(floor(place * rate + u) - floor((place - 1) * rate + u) AS BIGINT) AS copies
FROM r JOIN t USING (k)
"""
