"""Exact top-k search by integer inner products, norm-sorted with SVD-rotated partial sums.

Vectors become integer vectors (floor of scale times each component). Candidates are cut into blocks of falling length;
queries into blocks too. Blocks are worked through in rounds, each four times as many as all before it. A query's k-th best score so
far is its floor; a round sends a query only to blocks whose greatest length times the query's length reaches it
(Cauchy-Schwarz), a block's candidates only to blocks of queries that reach it, and when no query reaches a round's blocks, none
reaches the shorter ones either. Within a pair of blocks both are rotated by the right singular vectors of a bounded sample, so
that the first coordinates carry most of the length; partial products of these plus the product of the residual
lengths bound the score from above, and only candidates whose bound reaches the floor are scored exactly, in integers.
A block's best k raise no wrong floor: ties at the floor pass, and ties in score go to the smaller id at the end.

The sample sets the rotation only, never the result. A set of stated queries against all rows, in blocks: no pair leaves
a task but the k best of a query in a block.

Defined cases: vectors that are null, empty, of another length than most, or hold null or non-finite components take no
part; a repeated id is one vector (the smallest); rows with null ids are left out; fewer candidates than k give all; an
empty table gives an empty result. Scores beyond 64 bits are held at the largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import forget, map_arrow, materialize
from veldt.llm.vectors import common_length, lists, matrix, one_per_id, spread, usable

#: Bounds: rows in the sample for the rotation; rows in a block of candidates or queries; blocks by length before salting.
SAMPLE, BLOCK, QUERIES, LENGTHS = 20_000, 4096, 8192, 256
#: Share of a block's bounds that may survive before the whole block is scored by one product.
DENSE = 0.1


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows: float64 where every sum is below 2 ** 53, else Python integers."""
    if len(q) and len(x) and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] >= 2.0**53:
        ints = lambda m: np.array([[int(y) for y in r] for r in m], dtype=object)
        big = ints(q) @ ints(x).T
        return np.clip(big, -(2**63), 2**63 - 1)
    return q @ x.T


def block_top(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, x: np.ndarray, x_ids: np.ndarray, basis: np.ndarray, k: int, head: int) -> list[tuple[int, int, int]]:
    """(query, vec, score): each query's k best of the candidates x that reach its floor."""
    if len(q) > 1024:  # a bounded matrix of bounds at a time
        return [row for at in range(0, len(q), 1024) for row in block_top(q[at : at + 1024], q_ids[at : at + 1024], floor[at : at + 1024], x, x_ids, basis, k, head)]
    by_length = np.argsort(-(x * x).sum(1), kind="stable")
    x, x_ids = x[by_length], x_ids[by_length]
    rq, rx = q @ basis, x @ basis
    rest = lambda r: np.sqrt((r[:, head:] ** 2).sum(1))
    lq, lx = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    slack = 1e-9 * lq[:, None] * lx[None, :] + 1e-9
    reach = rq[:, :head] @ rx[:, :head].T + rest(rq)[:, None] * rest(rx)[None, :] + slack
    alive = (reach >= floor[:, None]) & (q_ids[:, None] != x_ids[None, :])
    whole = _exact(q, x) if alive.mean() > DENSE else None
    out = []
    for i in np.nonzero(alive.any(1))[0]:
        at = np.nonzero(alive[i])[0]
        s = whole[i, at] if whole is not None else _exact(q[i : i + 1], x[at])[0]
        good = s >= floor[i]
        at, s = at[good], s[good]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            at, s = at[s >= least], s[s >= least]
        order = sorted(zip((-int(v) for v in s), x_ids[at].tolist(), strict=True))[:k]
        out += [(int(q_ids[i]), v, -n) for n, v in order]
    return out


def _products(queries: DataFrame, candidates: DataFrame, basis: np.ndarray, k: int, d: int) -> DataFrame:
    """queries (block, qb, vec_id, v, floor) against candidates (block, vec_id, v) of the same block."""
    head = max(1, d * 3 // 8)
    kind = "block long, qb long, vec_id long, v array<double>, floor double, query boolean"
    both = queries.select("block", "qb", "vec_id", "v", "floor", F.lit(True).alias("query")).unionByName(candidates.select("block", "qb", "vec_id", "v", F.lit(None).cast("double").alias("floor"), F.lit(False).alias("query")))
    assert [x.split()[0] for x in kind.split(", ")] == both.columns

    def score(t: pa.Table) -> pa.Table:
        is_q, ids, v = np.asarray(t.column("query")), np.asarray(t.column("vec_id")), matrix(t.column("v"), d)
        floor = np.asarray(t.column("floor"), dtype=np.float64)[is_q]
        rows = block_top(v[is_q], ids[is_q], floor, v[~is_q], ids[~is_q], basis, k, head) if is_q.any() and not is_q.all() else []
        cols = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    return both.groupBy("block", "qb").applyInArrow(score, "query_id long, vec_id long, score long")


def top_products(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """(vec_id, embedding, ...) -> (query_id, rank, vec_id, score): for ids divisible by `every` the k best other rows."""
    named = one_per_id(vectors)
    named = named.filter(usable(F.col("v")))
    d = common_length(named)
    schema = "query_id long, rank int, vec_id long, score long"
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    named = named.filter(F.size("v") == d)

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.floor(matrix(b.column(1), d) * scale)
            ids = np.asarray(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(0), lists(v, pa.float64()), pa.array(np.sqrt((v * v).sum(1))), pa.array(spread(ids))], names=["vec_id", "v", "length", "salt"])

    x = materialize(map_arrow(named, integers, "vec_id long, v array<double>, length double, salt long"), "integers")
    n = x.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    drawn = np.array(x.orderBy("salt", "vec_id").limit(SAMPLE).select("v").toPandas()["v"].tolist(), dtype=np.float64)
    drawn /= max(1.0, np.abs(drawn).max())
    basis = np.linalg.svd(drawn.T @ drawn)[0]  # the right singular vectors of the sample

    # Blocks of falling length: quantiles of the length, each dealt on to as many blocks as its rows need.
    cuts = min(LENGTHS, -(-n // BLOCK))
    bounds = sorted(set(x.approxQuantile("length", [i / cuts for i in range(1, cuts)], 0.1 / cuts))) if cuts > 1 else []
    length_class = sum((F.when(F.col("length") < b, 1).otherwise(0) for b in bounds), F.lit(0)) if len(bounds) <= 16 else F.lit(len(bounds)) - F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("length")))
    x = x.withColumn("class", length_class.cast("int"))
    sizes = {r["class"]: r for r in x.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("most")).collect()}
    start, blocks = 0, []
    for c in sorted(sizes):
        parts = -(-sizes[c]["n"] // BLOCK)
        blocks.append((c, start, parts, float(sizes[c]["most"])))
        start += parts
    spark = vectors.sparkSession
    classes = spark.createDataFrame(blocks, "class int, start long, parts long, most double")  # LENGTHS rows at most
    filed = x.join(F.broadcast(classes), "class").select("vec_id", "v", "length", "salt", (F.col("start") + F.col("salt") % F.col("parts")).alias("block"))
    asked = filed.filter(F.col("vec_id") % every == 0)
    query_blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("qb", F.shiftright("salt", 20) % query_blocks).drop("block")
    best, low, high = None, 0, 1
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    while low < start:
        sent = asked.withColumn("floor", F.lit(float("-inf")))
        if best is not None:
            floors = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "least")
            sent = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("least", F.lit(float("-inf")))).drop("least")
        sent = materialize(reaching(sent, classes, low, high), "sent")
        if sent.isEmpty():
            forget(sent)
            break
        found = _products(sent, met(sent, filed), basis, k, d)
        found = found if best is None else best.unionByName(found)
        old, best = best, materialize(found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).drop("rank"), "best")
        forget(sent, old)
        low, high = high, high * 4
    if best is None:
        return spark.createDataFrame([], schema)
    return best.withColumn("rank", F.row_number().over(by_score)).select("query_id", "rank", "vec_id", "score")


def reaching(asked: DataFrame, classes: DataFrame, low: int, high: int) -> DataFrame:
    """asked, with floors, once for each block from low up to high that may hold a score of a query's floor or more."""
    reach = asked.join(F.broadcast(classes.filter((F.col("start") < high) & (F.col("start") + F.col("parts") > low))), F.col("length") * F.col("most") * (1 + 1e-9) + 1e-9 >= F.col("floor"))
    return reach.withColumn("block", F.explode(F.sequence(F.greatest("start", F.lit(low).cast("long")), F.least(F.col("start") + F.col("parts"), F.lit(high).cast("long")) - 1))).select("block", "qb", "vec_id", "v", "floor")


def met(sent: DataFrame, filed: DataFrame) -> DataFrame:
    """The candidates, once for each block of queries that reaches their block."""
    return filed.select("block", "vec_id", "v").join(sent.select("block", "qb").distinct(), "block")


def query(vectors: DataFrame) -> DataFrame:
    return top_products(vectors)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
