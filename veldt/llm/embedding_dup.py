"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into halves; each half has a codebook of its own (k-means on a bounded sample), and every vector is
filed in the cell of the product grid that its two nearest codewords name. A query visits the cells nearest to it, in
the order of the multi-sequence traversal: smallest sum of the two halves' squared distances first. How many cells
it visits is set for a target recall: for sample vectors, neighbours are made at exactly the threshold's cosine in random
directions, and the rank at which a query meets its neighbour's cell, or the neighbour the query's, is measured.

Vectors don't travel along with visits. What does is a sketch of 256 bits, the sides of random hyperplanes on which a vector lies: in a
cell, members and visitors whose sketches, or first halves of these, differ in more bits than a linked pair's do (but for a few in a million, right at the threshold) have nothing
to do with each other. This is done for one share of the visitors after the other, so that the shuffle files of a share are no larger than
the vectors, however many cells a query visits. Only the members and visitors that are left fetch their vectors, again by shares of the
cells, and are verified by double-precision cosines.

A cell's members and its visitors are dealt to blocks, by the number of members; each pair of blocks is one group with a matrix
product, which returns counts and a spanning forest of the links it found, so a group of many copies never becomes a list
of all its pairs. A link counts for both ends, once: for the visitor in its group, and for the member there too unless the
member's own visit finds it.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components link
with nothing and stand for themselves; labels and other columns are ignored; a repeated id is one vector (the
smallest); rows with null ids are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import bitmap, forget, map_arrow, materialize, may_hold
from veldt.llm.graph import components
from veldt.llm.vectors import common_length, lists, matrix, one_per_id, usable

#: Bounds: rows in the sample that fits the codebooks; codewords for a half; rows in a block.
SAMPLE, MOST_CODEWORDS, BLOCK = 20_000, 1024, 2048
#: Bytes that a share's shuffle may take, however few the vectors; bytes of a visit and, but for its vector, of a row to verify.
SHARE, VISIT, HIT = 256 << 20, 52, 40


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k codewords of the rows of x, by Lloyd's rounds from a random choice of rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the codewords c."""
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


class MultiIndex:
    """Two codebooks and the number of cells that a query visits."""

    def __init__(self, sample: np.ndarray, codewords: int, cosine: float, recall: float, seed: int = 11):
        self.half = sample.shape[1] // 2
        self.books = kmeans(sample[:, : self.half], codewords), kmeans(sample[:, self.half :], codewords)
        rng = np.random.default_rng(seed)
        q = sample[rng.choice(len(sample), min(4000, len(sample)), replace=False)]
        side = rng.standard_normal(q.shape)
        side -= (side * q).sum(1)[:, None] * q
        side /= np.maximum(np.linalg.norm(side, axis=1)[:, None], 1e-300)
        other = cosine * q + np.sqrt(1 - cosine * cosine) * side
        # A pair is found when either of the two visits the other's cell.
        ranks = np.minimum(self._ranks(q, self.cells(other)), self._ranks(other, self.cells(q)))
        self.visits = int(np.quantile(ranks, recall, method="higher"))
        self.planes = rng.standard_normal((sample.shape[1], 256))
        differ = np.arccos(np.clip(cosine, -1, 1)) / np.pi
        # In which a linked pair's differ at most: of the first half of the bits, of all.
        self.most_bits = [int(n * differ + 5 * np.sqrt(n * differ * (1 - differ))) for n in (128, 256)]

    def _ranks(self, x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """At which of its visits each row meets its wanted cell."""
        ranks = np.zeros(len(x), np.int64)
        step = max(1, 4_000_000 // (len(self.books[0]) * len(self.books[1])))  # distances to all cells, for a few rows at a time
        for at in range(0, len(x), step):
            s = self.scores(x[at : at + step])
            ranks[at : at + step] = (s < np.take_along_axis(s, wanted[at : at + step, None], 1)).sum(1) + 1
        return ranks

    def sketches(self, x: np.ndarray) -> np.ndarray:
        """(4, rows): the sides of 256 planes as bits."""
        return np.ascontiguousarray(np.packbits(x @ self.planes > 0, axis=1).view(np.int64).T)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row to each cell: the sums of the two halves' distances."""
        a, b = nearest(x[:, : self.half], self.books[0]), nearest(x[:, self.half :], self.books[1])
        return (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        a, b = nearest(x[:, : self.half], self.books[0]), nearest(x[:, self.half :], self.books[1])
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def traverse(self, x: np.ndarray) -> np.ndarray:
        """(rows, visits): each row's cells in multi-sequence order.

        The t nearest cells lie in the staircase (i + 1) * (j + 1) <= t of the two sorted halves, so only the ranks
        in that staircase are summed and ordered.
        """
        a, b = nearest(x[:, : self.half], self.books[0]), nearest(x[:, self.half :], self.books[1])
        ia, ib = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        i, j = (g.ravel() for g in np.indices((a.shape[1], b.shape[1])))
        stairs = (i + 1) * (j + 1) <= self.visits
        i, j = i[stairs], j[stairs]
        sums = np.take_along_axis(a, ia, 1)[:, i] + np.take_along_axis(b, ib, 1)[:, j]
        # Rounded, so that ties stay ties however many rows are worked out at once.
        order = sums.round(9).argsort(1, kind="stable")[:, : self.visits]
        return np.take_along_axis(ia, i[order], 1) * b.shape[1] + np.take_along_axis(ib, j[order], 1)


def _forest(linked: np.ndarray, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a bipartite graph the smallest id that it reaches."""
    top = np.iinfo(np.int64).max
    lq, lm = q.copy(), m.copy()
    while True:
        nq = np.minimum(lq, np.where(linked, lm[None, :], top).min(1, initial=top))
        nm = np.minimum(lm, np.where(linked, nq[:, None], top).min(0, initial=top))
        if (nq == lq).all() and (nm == lm).all():
            return lq, lm
        lq, lm = nq, nm


def _units(column: pa.Array, d: int) -> np.ndarray:
    u = matrix(column, d)
    u = u / np.abs(u).max(1)[:, None]  # so that huge and tiny vectors keep a finite length
    return u / np.linalg.norm(u, axis=1)[:, None]


def _meet(rows: DataFrame, most_bits: list[int]) -> DataFrame:
    """(cell, mb, qb, role, vec_id): of rows dealt by cell, mb, qb and sorted by these and role, those whose sketches have a partner in the other role."""
    names = ["cell", "mb", "qb", "role", "vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, m, hit, out = None, [], None, None, []

        def record(key: tuple, role: int, ids: np.ndarray) -> pa.RecordBatch:
            full = lambda x: pa.array(np.full(len(ids), x, np.int32))
            return pa.RecordBatch.from_arrays([*map(full, key), full(role), pa.array(ids)], names=names)

        def gathered() -> Iterator[pa.RecordBatch]:
            if len(out) >= 500:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out.clear()

        for b in batches:
            cell, mb, qb, role, ids, *bits = (np.asarray(b.column(k)) for k in range(9))
            bits = [x.view(np.uint64) for x in bits]
            new = (cell[1:] != cell[:-1]) | (mb[1:] != mb[:-1]) | (qb[1:] != qb[:-1])
            cuts = [0, *(np.nonzero(new)[0] + 1), len(cell)] if len(cell) else [0]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                key = (cell[start], mb[start], qb[start])
                if key != now:
                    if hit is not None and hit.any():
                        out.append(record(now, 0, m[0][hit]))
                    now, held, m, hit = key, [], None, None
                first = start + int(np.searchsorted(role[start:end], 1))
                if first > start:
                    held.append([x[start:first] for x in (ids, *bits)])
                if first < end and held and m is None:
                    m = [np.concatenate(x) for x in zip(*held, strict=True)]
                    hit = np.zeros(len(m[0]), bool)
                for at in range(first, end if held else first, 250):
                    c = slice(at, min(at + 250, end))
                    differ = np.bitwise_count(bits[0][c, None] ^ m[1]) + np.bitwise_count(bits[1][c, None] ^ m[2])
                    i, j = np.nonzero(differ <= most_bits[0])
                    rest = np.bitwise_count(bits[2][c][i] ^ m[3][j]).astype(np.int64) + np.bitwise_count(bits[3][c][i] ^ m[4][j])
                    near = (rest + differ[i, j] <= most_bits[1]) & (ids[c][i] != m[0][j])
                    if near.any():
                        hit[j[near]] = True
                        out.append(record(key, 1, ids[c][np.unique(i[near])]))
                yield from gathered()
        if hit is not None and hit.any():
            out.append(record(now, 0, m[0][hit]))
        yield from out

    return map_arrow(rows, run, "cell int, mb int, qb int, role int, vec_id long")


def _hits(vectors: DataFrame, index: MultiIndex, d: int, n: int) -> list[DataFrame]:
    """Written down: (cell, mb, qb, role, vec_id), the members (0) and visitors (1) of cells that may be linked; members perhaps several times."""

    names = ["vec_id", "cell", "k0", "k1", "k2", "k3"]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _units(b.column(1), d)
            k = index.sketches(u)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(index.cells(u), pa.int32()), *map(pa.array, k)], names=names)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, 50_000 // index.visits)
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                u = _units(b.column(1), d)
                k, cells = index.sketches(u), index.traverse(u)
                each = lambda x: pa.array(np.repeat(np.asarray(x), cells.shape[1]))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([each(b.column(0)), pa.array(cells.ravel(), pa.int32()), *map(each, k)], names=names)

    schema = "vec_id long, cell int, k0 long, k1 long, k2 long, k3 long"
    filed = materialize(map_arrow(vectors, file, schema), "filed")
    sizes = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = materialize(sizes, "cells")
    copies = sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0]  # rows of a visit, for each block of the cell
    large = F.broadcast(sizes.filter("blocks > 1").select("cell", "blocks"))  # one cell for BLOCK vectors at most
    salt = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def dealt(x: DataFrame, role: int) -> DataFrame:
        x = x.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        other, own = ("qb", "mb") if role == 0 else ("mb", "qb")
        x = x.withColumn(own, salt(role + 1)).withColumn(other, every)
        return x.select("cell", "mb", "qb", F.lit(role).alias("role"), "vec_id", *names[2:])

    shares = max(1, -(-index.visits * copies * VISIT // max(SHARE, n * d * 4)))
    hits = []
    for k in range(shares):
        here = vectors.filter(F.pmod(F.xxhash64(F.lit("share"), "vec_id"), F.lit(shares)) == k)
        met = dealt(filed, 0).unionByName(dealt(map_arrow(here, visit, schema), 1)).repartition("cell", "mb", "qb")
        hits.append(materialize(_meet(met.sortWithinPartitions("cell", "mb", "qb", "role"), index.most_bits), "hits"))
    forget(filed, sizes)
    return hits


def _links(vectors: DataFrame, index: MultiIndex, cosine: float, d: int, n: int) -> list[DataFrame]:
    """Written down: (id, links, reaches), counts of verified links and forest edges, from all pairs of blocks."""
    parts = _hits(vectors, index, d, n)
    hits = vectors.sparkSession.read.schema(parts[0].schema).parquet(*[p.scratch_path for p in parts])
    rows = hits.count()

    def verify(t: pa.Table) -> pa.Table:
        role, ids = np.asarray(t.column("role")), np.asarray(t.column("vec_id"))
        u = _units(t.column("v"), d)
        m, q = ids[role == 0], ids[role == 1]
        linked = (u[role == 1] @ u[role == 0].T >= cosine) & (q[:, None] != m[None, :])
        lq, lm = _forest(linked, q, m)
        n, back = linked.sum(1), np.zeros(len(m), np.int64)
        if linked.any():
            own, of = np.unique(index.cells(u[role == 1]), return_inverse=True)
            finds = np.zeros((len(m), len(own)), bool)
            for at in range(0, len(m), 250):
                visits = index.traverse(u[role == 0][at : at + 250])
                place = np.minimum(np.searchsorted(own, visits), len(own) - 1)
                row, k = np.nonzero(own[place] == visits)
                finds[at + row, place[row, k]] = True
            back = (linked & ~finds[:, of].T).sum(0)
        some = linked.any(0) & ((lm != m) | (back > 0))
        at = n > 0
        return pa.table({"id": np.concatenate([q[at], m[some]]), "links": np.concatenate([n[at], back[some]]), "reaches": np.concatenate([lq[at], lm[some]])})

    # Vectors go once to the rows that name them, and with these to their groups.
    shares, links = max(1, -(-rows * (HIT + d * 4) * 2 // max(SHARE, n * d * 4))), []
    for k in range(shares):
        here = hits.filter(F.pmod(F.xxhash64("cell", F.lit("share")), F.lit(shares)) == k).distinct()
        bits = bitmap(here, "vec_id")
        met = vectors.filter(may_hold(bits, F.col("vec_id"))).join(here, "vec_id")
        links.append(materialize(met.groupBy("cell", "mb", "qb").applyInArrow(verify, "id long, links long, reaches long"), "links"))
        forget(bits)
    forget(*parts)
    return links


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.999) -> DataFrame:
    """(vec_id, embedding, ...) -> (vec_id, n_links, component_id, kept)."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # exact, and half as large on disk
    named = materialize(one_per_id(vectors, kind="array<float>" if single else "array<double>"), "vectors")
    fit = named.filter(usable(F.col("v")) & F.exists("v", lambda x: x != 0))
    d = common_length(fit)
    fit = fit.filter(F.size("v") == d)
    n = fit.count()
    none = named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if n < 2:
        return none
    drawn = fit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    sample = np.array(drawn.tolist(), dtype=np.float64)
    sample /= np.abs(sample).max(1)[:, None]
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    if d == 1:  # no halves to cut: a second, constant component changes no distance
        sample = np.hstack([sample, np.zeros_like(sample)])
    codewords = int(np.clip(round(np.sqrt(n) / 8), 4, MOST_CODEWORDS))
    index = MultiIndex(sample, codewords, cosine, recall)
    if d == 1:
        fit = fit.withColumn("v", F.concat("v", F.array(F.lit(0.0))))
    links = _links(fit, index, cosine, max(d, 2), n)
    found = vectors.sparkSession.read.schema(links[0].schema).parquet(*[p.scratch_path for p in links])
    counts = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    reached = components(found.select(F.col("id").alias("a"), F.col("reaches").alias("b")))
    out = named.select("vec_id").join(counts.withColumnRenamed("id", "vec_id"), "vec_id", "left").join(reached.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def query(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END)) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT a AS id, b AS node FROM l UNION SELECT r.id, l.b FROM reach r JOIN l ON r.node = l.a),
m AS (SELECT id, min(node) AS low FROM reach GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN m ON vec_id = m.id LEFT JOIN n ON vec_id = n.id
"""
