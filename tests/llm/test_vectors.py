import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.llm import embedding_dup, top_products

SHAPE = "vec_id long, embedding array<float>, label int, u string, cell string"
BAD = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + [1.0] * 7, 1), (903, [None] + [1.0] * 7, 1), (904, [1.0, 2.0], 1), (905, [], 1), (906, [float("inf")] * 8, 1), (None, [1.0] * 8, 1)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SHAPE)


def clusters(seed, n=40, d=8, noise=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = (centres[rng.integers(0, 12, n)] + noise * rng.normal(size=(n, d))).astype(np.float32)
    x[5] = x[3]
    return [(i, v.tolist(), 0) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [2048, 16])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dup, "BLOCK", block)
    rows = clusters(1, 160)
    got = {r.vec_id: r for r in embedding_dup.query(table(spark, rows + BAD + rows[:1])).collect()}
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(linked, label[None, :], len(x)).min(1))
    found = sum(got[i].n_links for i in range(len(x)))
    assert found <= linked.sum() and found >= 0.97 * linked.sum()
    if found == linked.sum():
        assert [got[i].component_id for i in range(len(x))] == label.tolist()
    assert all(got[b[0]].n_links == 0 and got[b[0]].component_id == b[0] and got[b[0]].kept for b in BAD if b[0] is not None)
    assert None not in got and len(got) == len(rows) + len(BAD) - 1


def test_links_count_for_both_ends(spark):
    """A link that one end's visit misses counts for it too: at a low recall many are found from one side only."""
    rows = clusters(4, 200, noise=0.35)
    got = embedding_dup.near_duplicates(table(spark, rows), recall=0.8).collect()
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embedding_dup.MultiIndex(x[np.array(spark.range(200).selectExpr("id").orderBy(F.xxhash64("id"), "id").toPandas()["id"])], 4, 0.9, 0.8)
    visits = (index.traverse(x)[:, None, :] == index.cells(x)[None, :, None]).any(2)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    want = (linked & (visits | visits.T)).sum(1)
    assert (linked & visits != linked & visits.T).any()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(want.tolist()))


def test_vectors_do_not_travel_with_visits(spark, monkeypatch):
    """Visitors are dealt by shares, and only members and visitors that may be linked fetch their vectors."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 32))
    x = np.concatenate([x, x[:15] + 0.2 * rng.normal(size=(15, 32))])
    hits, real = [], embedding_dup.materialize

    def watch(df, name):
        out = real(df, name)
        if name == "hits":
            hits.append(out.count())
        return out

    monkeypatch.setattr(embedding_dup, "materialize", watch)
    monkeypatch.setattr(embedding_dup, "SHARE", 50_000)
    got = {r.vec_id: r.n_links for r in embedding_dup.query(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    assert linked.sum() >= 20 and [got[i] for i in range(len(x))] == linked.sum(1).tolist()
    assert len(hits) >= 2 and sum(hits) < len(x) / 2


def test_index_visits_near_cells_first():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 10))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embedding_dup.MultiIndex(x, 6, 0.9, 0.99)
    order = index.scores(x).argsort(1, kind="stable")[:, : index.visits]
    got = index.traverse(x)
    near = np.take_along_axis(index.scores(x), got, 1)
    assert np.allclose(near, np.take_along_axis(index.scores(x), order, 1)) and (got[:, 0] == index.cells(x)).all()


def test_tiny_tables(spark):
    assert embedding_dup.query(table(spark, [])).collect() == []
    one = embedding_dup.query(table(spark, [(1, [1.0, 0.0], 0)])).collect()
    assert [(r.n_links, r.kept) for r in one] == [(0, True)]
    flat = embedding_dup.query(table(spark, [(1, [1.0], 0), (2, [2.0], 0), (3, [-1.0], 0)])).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in flat} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def brute_top(rows, every=20, k=20):
    x = {i: np.floor(64 * np.array(v, dtype=np.float64)).astype(object) for i, v, _ in rows}
    out = []
    for q in sorted(i for i in x if i % every == 0):
        s = sorted((-int((x[q] * v).sum()), i) for i, v in x.items() if i != q)[:k]
        out += [(q, rank, i, -n) for rank, (n, i) in enumerate(s, 1)]
    return out


@pytest.mark.parametrize("block", [4096, 24])
def test_top_products_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(top_products, "BLOCK", block)
    monkeypatch.setattr(top_products, "QUERIES", 4)
    rng = np.random.default_rng(2)
    rows = [(i, (v * s).tolist(), l) for (i, v, l), s in ((r, rng.choice([0.1, 1.0, 5.0])) for r in ((i, np.array(v, dtype=np.float32), l) for i, v, l in clusters(4, 150)))]
    rows = [(i, np.array(v, dtype=np.float32).tolist(), l) for i, v, l in rows]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_products.query(table(spark, rows + [b for b in BAD if b[0] != 901] + rows[:2])).collect())
    assert got == sorted(brute_top(rows))


def test_top_products_small_and_large(spark):
    assert top_products.query(table(spark, [])).collect() == []
    few = [(0, [1.0, 1.0], 0), (1, [0.5, 0.0], 0), (20, [0.0, 0.0], 0)]
    assert sorted(tuple(r) for r in top_products.query(table(spark, few)).select("query_id", "rank", "vec_id", "score").collect()) == sorted(brute_top(few))
    huge = [(0, [1e30, 0.0], 0), (1, [1e30, 0.0], 0), (2, [-1e30, 1.0], 0)]
    assert [(r.vec_id, r.score) for r in top_products.query(table(spark, huge)).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]


def test_top_products_shuffles_only_what_is_reached(spark, monkeypatch):
    """Short candidates stay where they are: fewer rows are dealt than candidates times blocks of queries."""
    monkeypatch.setattr(top_products, "BLOCK", 30)
    monkeypatch.setattr(top_products, "QUERIES", 5)
    rng = np.random.default_rng(6)
    length = np.where(np.arange(600) < 60, 8.0, 0.2)
    rows = [(i, (v * s / np.linalg.norm(v)).astype(np.float32).tolist(), 0) for i, (v, s) in enumerate(zip(rng.normal(size=(600, 8)), length, strict=True))]
    dealt, plain = [], top_products.met

    def counted(sent, filed):
        out = plain(sent, filed)
        dealt.append((out.count(), filed.count() * sent.select("qb").distinct().count()))
        return out

    monkeypatch.setattr(top_products, "met", counted)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_products.query(table(spark, rows)).collect())
    assert got == sorted(brute_top(rows))
    assert sum(x for x, _ in dealt) < 0.35 * dealt[0][1], dealt


def test_recall_where_the_index_prunes():
    """On a grid of 1,024 cells, of which a query visits a small part, the pairs at the threshold or above are met."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 16))
    x = centres[rng.integers(0, 300, 6000)] + 0.33 * rng.normal(size=(6000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embedding_dup.MultiIndex(x, 32, 0.9, 0.999)
    cells = len(index.books[0]) * len(index.books[1])
    assert cells >= 900 and index.visits < 0.5 * cells
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    visits, own = index.traverse(x), index.cells(x)
    met = np.array([own[j] in visits[i] or own[i] in visits[j] for i, j in zip(a[:20_000], b[:20_000], strict=True)])
    assert len(met) > 5000 and met.mean() >= 0.98
