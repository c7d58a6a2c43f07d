import random

import numpy as np

from tests.llm.conftest import edge_rows
from veldt.llm import graph, near_dup


def brute(rows, width, percent=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def family(rng, base, n, first, most):
    """Near copies of one text with up to `most` words changed, about the threshold."""
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append((first + k, " ".join(w)))
    return out


def test_against_brute_force(docs_of):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(80)]
    rows = family(rng, base, 60, 0, 7) + [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(60)]
    rows += [(200 + k, rows[k][1].upper()) for k in range(5)] + [r[:2] for r in edge_rows() if r[0] not in (None, 905)] + [(905, "a b c d e f")]
    for width in (2, 5):
        got = {r.doc_id: r for r in near_dup.near_duplicates(docs_of(rows), width=width).collect()}
        want = brute(rows, width)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_pairs_left_over_are_found_in_blocks(docs_of, monkeypatch):
    """Without the rounds before, the blocks alone must join all that links."""
    rng = random.Random(8)
    rows = family(rng, [f"v{i}" for i in range(100)], 80, 0, 9)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs_of(rows), width=2, most_turns=0).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2).items()}


def test_edges_and_repeats(docs_of):
    got = near_dup.query(docs_of(edge_rows())).collect()
    assert len(got) == len(edge_rows()) - 1  # the row without an id
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[904][0].component_id == 903 and by[900][0].n_shingles == by[902][0].n_shingles == 0 and by[901][0].kept and len(by[905]) == 2
    assert near_dup.query(docs_of([])).collect() == []


def test_pigeonhole():
    """Signatures that differ in 2 * CHUNKS - 1 symbols share a key, wherever they differ."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, (1, near_dup.SYMBOLS)).astype(np.uint16)
        b = a.copy()
        at = rng.choice(near_dup.SYMBOLS, 2 * near_dup.CHUNKS - 1, replace=False)
        b[0, at] ^= rng.integers(1, 1 << 16, len(at)).astype(np.uint16)
        assert (near_dup.keys(a) == near_dup.keys(b)).any()


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 100), (7, 7), (50, 40)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(2, 41), 1), 50: 1, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
