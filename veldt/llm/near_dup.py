"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, and an exact check on full sets.

A document's set: its distinct `width`-word shingles (64-bit hashes). Documents of equal sets are one class from the
start. Each class's signature has `CHUNKS` chunks of `CHUNK` b-bit MinHash symbols. Two signatures that differ in at most
2 * CHUNKS - 1 symbols differ in at most one symbol of some chunk (pigeonhole), so every chunk gives CHUNK keys, each
leaving one symbol out: such pairs always share a key. With 11 chunks of 6 that is a distance of 21 of 66; a pair at
a Jaccard similarity of 0.8 differs in 13.2 on average, and shares a key at whatever distance with probability 1 - 8e-6.

Links: in each bucket all members are compared with its smallest id first (pairs are as many as members), and the links
are joined to components. In buckets that still hold several components, each member is compared with its neighbours in
a shuffled order, as long as that joins more. What is then left is compared in full, but in blocks inside a task: members
of different components whose sizes allow a link, whose distances to the bucket's first member differ by at most the
linking distance (Jaccard distance is a metric, so other pairs cannot link), and whose parity sketches differ in no more bits
than linked sets can in members, are joined to families; a family's members are compared on their full sets by products of
incidence matrices, but for blocks that one component fills (`blocks.linked`). These filters rule out no linked pair. Blocks
return spanning forests, so a group of near copies costs rows for its members, not for its pairs.

Defined cases: null and empty texts have the empty set (n_shingles 0), link with nothing and are kept; fewer words than
`width` make one shingle of the whole sequence; rows with null ids are left out, as they cannot be named; a repeated id is
judged row by row; other columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.blocks import blocks, linked, spanning
from veldt.llm.common import Hashes, bitmap, forget, map_arrow, materialize, may_hold, mix, words
from veldt.llm.graph import components

CHUNK, CHUNKS, BITS = 6, 11, 16
SYMBOLS = CHUNK * CHUNKS

_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_KEY = _rng.integers(0, 2**63, (CHUNKS, CHUNK), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEFT_OUT = _rng.integers(0, 2**63, (CHUNKS, CHUNK), dtype=np.uint64)
#: Bits of the parity sketch of a set. Two sets' sketches differ in no more bits than the sets differ in members.
SKETCH = 4096
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(ws: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a sequence of word hashes."""
    n = len(ws)
    if not n:
        return ws
    width = min(width, n)
    h = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        h = (h + ws[j : n - width + 1 + j]) * _PLACE[j % 64]
        h ^= h >> np.uint64(29)
    return np.unique(mix(h))


def signatures(sets: list[np.ndarray], odd: np.ndarray = _ODD, flip: np.ndarray = _FLIP) -> np.ndarray:
    """(number of sets, number of hashes) symbols of BITS bits; sets are not empty."""
    out = np.empty((len(sets), len(odd)), np.uint16)
    at = 0
    while at < len(sets):
        upto, total = at, 0
        while upto < len(sets) and (upto == at or total + len(sets[upto]) <= 1 << 16):
            total += len(sets[upto])
            upto += 1
        together = np.concatenate(sets[at:upto])
        starts = np.cumsum([0, *map(len, sets[at : upto - 1])])
        for k in range(len(odd)):
            least = np.minimum.reduceat((together ^ flip[k]) * odd[k], starts)
            out[at:upto, k] = (least >> np.uint64(20)).astype(np.uint16)
        at = upto
    return out


def keys(signature: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * CHUNK) bucket keys: for each chunk and each symbol left out, a hash of the chunk's other symbols."""
    parts = signature.reshape(len(signature), CHUNKS, CHUNK).astype(np.uint64) * _KEY
    return mix(parts.sum(2, dtype=np.uint64)[:, :, None] - parts + _LEFT_OUT).reshape(len(signature), -1).view(np.int64)


def _features(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, set_a, set_b, signature) for each row; set_a and set_b: a 128-bit hash of the set, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = [shingles(hashes.of(words(t.as_py())), width) for t in b.column(1)]
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full)) if full else iter(())
                digest = [divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) if len(s) else None for s in sets]
                half = [pa.array([d and d[k] - (1 << 63) for d in digest], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, sets), pa.int64()), *half, pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n", "set_a", "set_b", "signature"])

    return map_arrow(docs, run, "doc_id long, n long, set_a long, set_b long, signature binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, id, n): the keys of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                b = whole.slice(at, 4000)
                if b.num_rows:
                    raw = b"".join(x.as_py() for x in b.column(2))
                    k = keys(np.frombuffer(raw, np.uint16).reshape(-1, SYMBOLS))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * k.shape[1]), pa.array(k.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "n", "keys"])

    return map_arrow(classes.select("id", "n", "signature"), run, "id long, n long, keys array<long>").select(F.explode("keys").alias("key"), "id", "n")


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(number of sets, SKETCH / 8) bytes: for each bit the parity of the number of members that fall on it."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(40) & np.uint64(SKETCH - 1)
    odd = np.bincount(row * SKETCH + at.astype(np.int64), minlength=len(sets) * SKETCH) & 1
    return np.packbits(odd.reshape(len(sets), SKETCH).astype(np.uint8), axis=1)


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles, bits) of the documents named: their sets anew from their texts, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                sets = [shingles(hashes.of(words(t.as_py())), width) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([x.tobytes() for x in sketches(sets)], pa.binary())], names=["doc_id", "shingles", "bits"])

    wanted = docs.filter(may_hold(bitmap(ids, "doc_id"), F.col("doc_id"))).join(ids, "doc_id", "left_semi")
    return map_arrow(wanted, run, "doc_id long, shingles array<long>, bits binary")


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with `common` and `together`, sizes of the sets' intersection and union."""
    of = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    j = pairs.join(of("b"), "b").join(of("a"), "a")
    j = j.withColumn("common", F.size(F.array_intersect("sa", "sb"))).withColumn("together", F.size("sa") + F.size("sb") - F.col("common"))
    return j.drop("sa", "sb")


def _apart(members: DataFrame, reached: DataFrame) -> DataFrame:
    """members with their `component`, of the buckets that hold several, and the bucket's number of members `in_key`."""
    m = members.join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = m.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("in_key"))
    return m.join(several.filter("low != high").select("key", "in_key"), "key")


def _near(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """A spanning forest of the pairs of a bucket's block, in different components, that may link."""
    column = lambda name: np.asarray(rows.column(name))
    ids, n, away, component = (column(x) for x in ("id", "n", "away", "component"))
    bits = np.frombuffer(b"".join(x.as_py() for x in rows.column("bits")), np.uint64).reshape(len(ids), -1)
    left, right = [], []
    for r in range(len(ids) - 1):
        rest = slice(r + 1, None)
        may = (component[rest] != component[r]) & (100 * np.minimum(n[rest], n[r]) >= percent * np.maximum(n[rest], n[r])) & (np.abs(away[rest] - away[r]) * 100 <= 100 - percent + 1e-6)
        at = np.nonzero(may)[0] + r + 1
        if len(at):
            both = n[at] + n[r]
            spare = both - 2 * -(-both * percent // (100 + percent))  # members that linked sets may differ in
            at = at[np.bitwise_count(bits[at] ^ bits[r]).sum(1) <= spare]
            left.append(np.full(len(at), r))
            right.append(at)
    return spanning(ids, np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*right, np.zeros(0, np.int64)]).astype(np.int64))


def _families(m: DataFrame, sets: DataFrame, percent: int, block: int = 4000) -> DataFrame:
    """(a, b): edges that join the members of buckets, in different components, which by their signatures may link.

    A bucket of more than 2 * block members is cut into parts, and each two parts make a block.
    """
    m = m.join(sets.select(F.col("doc_id").alias("id"), "bits"), "id")
    parts = F.ceil(F.col("in_key") / (2 * block)).cast("long")
    m = m.withColumn("part", F.pmod(F.xxhash64("id"), parts)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    m = m.select("key", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "id", "n", "away", "component", "bits")
    m = m.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return map_arrow(m, blocks(3, lambda t: _near(t, percent)), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, most_turns: int = 6) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id, kept).

    most_turns bounds the rounds of the shuffled order, not what is compared in the end.
    percent: least 100 * intersection / union of linked sets; the keys are laid out for 80 or more.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    features = materialize(_features(docs, width), "features")
    full = features.filter("n > 0")
    classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"))
    named = full.join(classes.select("set_a", "set_b", F.col("id").alias("doc_id")), ["set_a", "set_b", "doc_id"], "left_semi")
    keyed = _buckets(named.select(F.col("doc_id").alias("id"), "n", "signature"))

    firsts = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first != last").drop("last")
    members = materialize(keyed.join(firsts, "key"), "members")
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    starred = members.filter("first != id").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    ids = starred.select(F.col("a").alias("doc_id")).union(starred.select(F.col("b").alias("doc_id"))).distinct()
    sets = materialize(_sets(docs, ids, width), "sets")
    links = F.col("common") * 100 >= F.col("together") * percent
    checked = materialize(_common(starred, sets), "checked")
    reached = components(checked.filter(links).select("a", "b"))

    # Members of a bucket that are still in different components: first against a few others in a shuffled order, for as
    # long as that joins more and many pairs are left, then all that are left.
    away = checked.select(F.col("a").alias("first"), F.col("b").alias("id"), (1 - F.col("common") / F.col("together")).alias("away"))
    told = members
    members = materialize(members.join(away, ["first", "id"], "left").withColumn("away", F.coalesce("away", F.lit(0.0))), "away")
    forget(told, checked)
    size, before = members.count(), None
    for turn in range(most_turns):
        m = _apart(members, reached)
        cross = m.groupBy("key", "component").count().groupBy("key").agg((F.pow(F.sum("count"), 2) - F.sum(F.col("count") * F.col("count"))).alias("cross")).agg(F.sum("cross")).first()[0]
        if (cross or 0) <= size or (before is not None and cross > 0.8 * before):
            break
        before = cross
        mixed = F.xxhash64("id", F.lit(turn))
        order = Window.partitionBy("key", F.pmod(mixed, F.ceil(F.col("in_key") / 500))).orderBy(mixed, "id")
        beside = [F.struct(F.lag("id", k).over(order).alias("id"), F.lag("n", k).over(order).alias("n"), F.lag("component", k).over(order).alias("component")) for k in (1, 2, 3)]
        tried = m.withColumn("beside", F.array(*beside)).withColumn("other", F.explode("beside")).filter((F.col("component") != F.col("other.component")) & fits(F.col("n"), F.col("other.n")))
        tried = tried.select(F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b")).distinct()
        more = materialize(_common(tried, sets).filter(links).select("a", "b"), "more")
        if more.isEmpty():
            break
        reached = components(reached.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))

    families = components(_families(_apart(members, reached).filter("first != id"), sets, percent))
    last = linked(families, reached, sets, percent)
    last_round = components(reached.select(F.col("id").alias("a"), F.col("component").alias("b")).union(last))

    whole = materialize(classes.join(last_round, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component_id")), "whole")
    forget(members, sets)
    out = features.drop("signature").join(whole, ["set_a", "set_b"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, width=2)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                          WHEN len(w) = 1 THEN w ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM e a JOIN e b
      ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * common >= 80 * (na + nb - common)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS id, b AS node FROM both_ways UNION SELECT r.id, g.b FROM reach r JOIN both_ways g ON r.node = g.a),
m AS (SELECT id, min(node) AS low FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
FROM s LEFT JOIN m ON doc_id = id
"""
