"""Exact joins of families: members that may link are compared on their full sets, in blocks, each inside a task.

A family is a set of members among which links are still to be looked for. Its members are cut into parts of bounded size, two
parts make a block, and a block returns a spanning forest of its links: a family costs rows for its members in each of
its parts' blocks and for the forest, not for its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import map_arrow, materialize

SALTS = 256


def blocks(place: int, kernel: Callable[[pa.Table], pa.RecordBatch]):
    """For mapInArrow over partitions sorted by their first `place` columns: kernel of each block's table, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for whole in batches:
            if not whole.num_rows:
                continue
            at = np.stack([np.asarray(whole.column(k)) for k in range(place)])
            cuts = [0, *(np.nonzero((at[:, 1:] != at[:, :-1]).any(0))[0] + 1), whole.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if held and tuple(at[:, start]) != key:
                    yield kernel(pa.Table.from_batches(held))
                    held = []
                key = tuple(at[:, start])
                held.append(whole.slice(start, end - start))
        if held:
            yield kernel(pa.Table.from_batches(held))

    return run


def lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that it reaches over the pairs of places (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def spanning(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Rows (a, b) that link every id to one id of those that it reaches over the pairs of positions (a, b)."""
    label = lowest(len(ids), a, b)
    at = np.nonzero(label != np.arange(len(ids)))[0]
    return pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(ids[label[at]], pa.int64())], names=["a", "b"])


def linked_within(rows: pa.Table, percent: int, columns: int = 20_000) -> pa.RecordBatch:
    """A spanning forest of a block's links, by products of its incidence matrix, some columns at a time."""
    ids = np.asarray(rows.column("id"))
    lists = rows.column("shingles").combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    row = np.repeat(np.arange(len(ids)), sizes)
    _, column, times = np.unique(np.asarray(lists.flatten()), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], np.cumsum(times > 1)[column[shared]] - 1
    common = np.zeros((len(ids), len(ids)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int((times > 1).sum()), columns):
        at = slice(*np.searchsorted(column, [start, start + columns]))
        x = np.zeros((len(ids), columns), np.float32)
        x[row[at], column[at] - start] = 1
        common += x @ x.T
    links = common * 100 >= percent * (sizes[:, None] + sizes[None, :] - common)
    a, b = np.nonzero(np.triu(links, 1))
    return spanning(ids, a, b)


def linked(families: DataFrame, reached: DataFrame, sets: DataFrame, percent: int, block: int = 150_000, most: int = 1500) -> DataFrame:
    """(a, b): edges that join all members of a family (id, component: the family) that link on their full sets.

    sets: (doc_id, shingles). Members stand by component, in parts of about `block` shingles and `most` members; two parts make a
    block unless both hold one and the same component, so what is joined already isn't compared again. A member's
    place is the sum of the components before its own, from sums by salt, and a place within it by hash: no window holds a family's
    members.
    """
    f = families.select("id", F.col("component").alias("family")).union(families.select("component", "component")).distinct()
    f = f.join(reached, "id", "left").select("family", "id", F.coalesce("component", "id").alias("component"))
    size = F.greatest(F.size("shingles").cast("long"), F.lit(-(-block // most)))
    f = materialize(f.join(sets.select(F.col("doc_id").alias("id"), size.alias("n")), "id"), "members")
    salt = F.pmod(F.xxhash64("component"), F.lit(SALTS))
    sums = f.groupBy("family", "component").agg(F.sum("n").alias("total")).withColumn("salt", salt)
    earlier = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_salt = sums.groupBy("family", "salt").agg(F.sum("total").alias("total")).withColumn("of_salt", earlier(Window.partitionBy("family").orderBy("salt"))).drop("total")
    starts = sums.withColumn("of_one", earlier(Window.partitionBy("family", "salt").orderBy("component"))).join(by_salt, ["family", "salt"])
    starts = starts.select("family", "component", "total", (F.col("of_salt") + F.col("of_one")).alias("start"))
    placed = f.join(starts, ["family", "component"])
    f = placed.select("family", "id", "component", F.floor((F.col("start") + F.pmod(F.xxhash64("id"), "total")) / block).alias("part"))
    parts = f.groupBy("family", "part").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    x, y = parts.alias("x"), parts.alias("y")
    apart = (F.col("x.low") != F.col("y.high")) | (F.col("x.high") != F.col("y.low"))
    pairs = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.part") <= F.col("y.part")) & apart).select(F.col("x.family").alias("family"), F.col("x.part").alias("i"), F.col("y.part").alias("j"))
    pairs = pairs.withColumn("part", F.explode(F.array_distinct(F.array("i", "j"))))
    rows = f.join(pairs, ["family", "part"]).join(sets.select(F.col("doc_id").alias("id"), "shingles"), "id")
    rows = rows.select("family", "i", "j", "id", "shingles").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return map_arrow(rows, blocks(3, lambda t: linked_within(t, percent)), "a long, b long")
