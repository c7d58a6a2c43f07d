"""Encoding, the quality classifier, the language model, and the pipeline over small tables."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import edge_rows
from veldt.llm import lm, pieces, quality
from veldt.llm.common import scratch_paths, words

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec():
    return pieces.codec(P.path("piece_bpe_32k.model"))


def test_encoding_equals_the_library(codec, library):
    rng = random.Random(4)
    parts = ["a", "e", "the", "tion", " ", "  ", "\n", "\t", "é", "ß", "😀", "▁", "   ", "'", "&&&", "20", "Z", "<s>", "</s>", "<0x0A>", "<unk>", "中", "\0", "ing", "un", "==", "aaaa", "\r", "------"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = library.encode(text, add_eos=True)
        assert codec.encode(text) == want and codec.decode(want) == library.decode(want), repr(text)
    for n in [*range(40), 200]:
        for text in (" " * n, "x" + " " * n, " " * n + "the" + " " * n + "\n", "a" * n, "ab" * n):
            assert codec.encode(text) == library.encode(text, add_eos=True)


def test_full_caches_change_nothing(library):
    small = pieces.Codec(P.path("piece_bpe_32k.model"), cached_chunks=4, cached_pairs=4, longest_cached=6)
    text = "the quick brown foxes jumped over the lazy dogs, internationalisation and the rest " * 3
    assert small.encode(text) == library.encode(text, add_eos=True)


def test_encode_table(docs_of, library):
    got = pieces.query(docs_of(edge_rows())).collect()
    want = sorted((str(r[0]), r[1] or "") for r in edge_rows())
    assert len(got) == len(want)
    ids = lambda t: library.encode(t, add_eos=True)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((i, len(ids(t)), sha(" ".join(map(str, ids(t)))), sha(library.decode(ids(t)))) for i, t in want)
    full = pieces.encode_table(docs_of([(1, "the end")]))
    assert {"n_tokens", "ids", "decoded", "key"} <= set(full.columns) and full.columns.count("ids") == 1 and full.first().decoded == "the end"
    assert pieces.query(docs_of([])).collect() == []


def corpus(n=240):
    """Good documents of common words in order, poor ones of noise."""
    rng = random.Random(6)
    common = "the of and to in a is that it was for on are as with his they at be this".split()
    good = lambda: " ".join(rng.choice(common) for _ in range(rng.randint(30, 60)))
    noise = lambda: " ".join("".join(rng.choice("qxzjkvw") for _ in range(6)) for _ in range(40))
    return [(i, good() if i % 6 else noise(), "en" if i % 2 else None) for i in range(n)]


def labels_of(spark, rows):
    return spark.createDataFrame([(i, int(i % 6 > 0), 0) for i, *_ in rows if i % 3 < 2], "doc_id long, quality int, toxic int")


def test_quality_tells_good_from_poor(spark, docs_of):
    rows = corpus()
    out = quality.query(docs_of([*rows, *edge_rows()]), labels_of(spark, rows)).collect()
    assert len(out) == len(rows) + len(edge_rows())
    kept = {r.doc_id: r.kept for r in out}
    assert not any(kept[i] for i, *_ in rows if i % 6 == 0) and sum(kept[i] for i, *_ in rows if i % 6) >= 0.98 * 200
    assert kept[900] and kept[901] and kept[902]
    df = docs_of([*rows, *edge_rows()])
    stay = quality.keep_good(df, labels_of(spark, rows))
    assert stay.columns == df.columns and sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(r.doc_id) for r in out if r.kept)


def test_quality_without_labels_or_documents(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in quality.query(docs_of(corpus(12)), none).collect()) and quality.keep_good(docs_of(corpus(12)), none).count() == 12
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert quality.query(docs_of(corpus(12)), odd).count() == 12 and quality.query(docs_of([]), odd).count() == 0


def kneser_ney(texts):
    """log10 p(w | u, v) of an interpolated modified Kneser-Ney trigram model, from its definition, with dictionaries."""
    three = Counter(t for ws in texts for t in zip(["", "", *ws], ["", *ws], ws))
    two, one = Counter(), Counter()
    for u, v, w in three:
        two[v, w] += three[u, v, w] if v == "" else 1
    for _, w in two:
        one[w] += 1

    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        usual = {1: 0.5, 2: 0.75, 3: 0.9}
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            usual = {k: min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) if n[k - 1] and n[k] else usual[k] for k in usual}
        return {g: usual[min(c, 3)] for g, c in counts.items()}

    d1, d2, d3 = map(discounts, (one, two, three))
    floor = sum(d1.values()) / sum(one.values()) / (len(one) + 2)
    s2, h2, s3, h3 = Counter(), Counter(), Counter(), Counter()
    for g, c in two.items():
        s2[g[0]] += c
        h2[g[0]] += d2[g]
    for g, c in three.items():
        s3[g[:2]] += c
        h3[g[:2]] += d3[g]

    def p(u, v, w):
        low = (one[w] - d1[w]) / sum(one.values()) + floor if w in one else floor
        if s2[v]:
            low = (two[v, w] - d2.get((v, w), 0)) / s2[v] + h2[v] / s2[v] * low
        return (three[u, v, w] - d3.get((u, v, w), 0)) / s3[u, v] + h3[u, v] / s3[u, v] * low if s3[u, v] else low

    return lambda ws: sum(math.log10(p(u, v, w)) for u, v, w in zip(["", "", *ws], ["", *ws], ws))


def small_corpus():
    rng = random.Random(8)
    text = lambda: " ".join(f"w{min(int(rng.expovariate(0.15)), 60)}" for _ in range(rng.choice((0, 1, 2, 9, 30, 2500 if rng.random() < 0.03 else 12))))
    return [(i, text(), ("en", "fr", None, "rare")[i % 4 if i % 40 == 3 else i % 3]) for i in range(400)] + [(400, "w1 W2 unheard of w1", "en"), (401, "unheard", "xx"), (None, "w1 w2 w3", "en")]


@pytest.mark.parametrize("hot", [1 << 20, 50])
def test_quality_equals_brute_force(spark, docs_of, monkeypatch, hot):
    """Scores, thresholds and verdicts by definition: all orders, texts of any length, whatever is looked up in place or joined."""
    monkeypatch.setattr(quality, "HOT", hot)
    rows = small_corpus()
    labels = spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    half = {r.doc_id: r.trains for r in quality._trusted(labels).collect()}
    assert set(half) == {i for i in range(400) if i % 8} and 100 < sum(half.values()) < 250
    split = lambda t: t.lower().split()
    log10p = kneser_ney([split(t) for i, t, _ in rows if half.get(i)])
    got = quality.query(docs_of([*rows, rows[5]]), labels).collect()
    assert len(got) == len(rows) + 1
    held = defaultdict(list)
    for i, t, lang in rows + [rows[5]]:
        if half.get(i) is False and split(t):
            held[lang].append((log10p(split(t)), len(split(t))))
    every = [x for xs in held.values() for x in xs]
    mean = lambda xs: -sum(x for x, _ in xs) / sum(n for _, n in xs)
    means = {lang: mean(held[lang] if len(held[lang]) >= 30 else every) for lang in {r[2] for r in rows}}
    drawn = lambda x, n, lang: (-x + 20 * means[lang]) / (n + 20)
    most = lambda xs: sorted(xs)[math.ceil(0.995 * len(xs)) - 1]
    all_most = most([drawn(*x, lang) for lang, xs in held.items() for x in xs])
    texts = {(i, lang): t for i, t, lang in rows}
    for r in got:
        ws = split(texts[r.doc_id, r.lang])
        limit = most([drawn(*x, r.lang) for x in held[r.lang]]) if len(held[r.lang]) >= 30 else all_most
        assert r.n_words == len(ws) and r.threshold == pytest.approx(limit, abs=1e-9)
        assert r.score == pytest.approx(drawn(log10p(ws), len(ws), r.lang), abs=1e-9)
        assert r.log10_perplexity == (pytest.approx(-log10p(ws) / len(ws), abs=1e-9) if ws else None)
        assert r.kept == (not ws or r.score <= r.threshold)


def test_quality_trains_on_all_trusted_documents(spark, docs_of):
    """More documents than any bound: the words of each of the training half are known, those of the other half are not."""
    rows = [(i, f"w{i}") for i in range(9000)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    half = {r.doc_id: r.trains for r in quality._trusted(labels).collect()}
    got = {r.doc_id: r["__log10p"] for r in quality.score(docs_of([*rows, (9000, "unheard")]), quality.train(docs_of(rows), labels)).collect()}
    assert sum(half.values()) > 4200
    assert {i for i in half if got[i] > got[9000] + 0.01} == {i for i in half if half[i]}


def test_quality_model_takes_few_bytes(spark, docs_of):
    """What training leaves on disk: some bytes for a distinct trigram, not rows of keys and values for each of its n-grams."""
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(500))) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    half = {r.doc_id for r in quality._trusted(labels).collect() if r.trains}
    before = scratch_paths()
    model = quality.train(docs_of(rows), labels)
    left = sum(f.stat().st_size for p in scratch_paths() - before for f in Path(p.removeprefix("file:")).rglob("*.parquet"))
    trigrams = {t for i, text in rows if i in half for t in zip(["", "", *text.split()], ["", *text.split()], text.split())}
    assert len(trigrams) > 90_000 and left < 20 * len(trigrams)
    model.forget()


def test_quality_words_follow_the_word_rule():
    """Cut and hashed for whole batches, words are those of the rule: equal hashes for equal words only, of any length and in any script."""
    rng = random.Random(3)
    parts = ["a", "B", "b", "é", "ß", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "\u3000", "😀", "\0", "xyzxyzxyz", " "]
    texts = [None, "", " ", "a", "q" * 500 + " " + "q" * 501, "x" * 128 + " " + "x" * 129, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(2000)), None]
    for given in (pa.array(texts), pa.array(texts).slice(3, 900), pa.array([None, ""], pa.string()), pa.array([], pa.string())):
        h, n, _ = quality._hashed(given)
        ws = [words(t) for t in given.to_pylist()]
        assert n.tolist() == [len(x) for x in ws]
        pairs = set(zip((w for x in ws for w in x), h.tolist(), strict=True))
        assert len(pairs) == len({w for w, _ in pairs}) == len({x for _, x in pairs})


def test_trigram_probabilities_sum_to_one(spark, docs_of):
    rows = [(i, " ".join(f"w{(i * k * k) % 37}" for k in range(60))) for i in range(80)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    model = quality.train(docs_of(rows), labels)
    contexts = ["w3 w4", "w5 unheard", "unheard w5", "unheard of"]
    met = {w for i, t in rows for w in t.split()}
    known = {r.w for r in quality._trigrams(docs_of(rows), labels, 100).select("w").distinct().collect()}
    asked = [(k * 1000 + j, f"{c} {w}") for k, c in enumerate(contexts) for j, w in enumerate([*sorted(met), "new"])] + [(9000 + k, c) for k, c in enumerate(contexts)]
    got = {r.doc_id: r["__log10p"] for r in quality.score(docs_of(asked), model).collect()}
    assert len(known) == len(met)
    for k in range(len(contexts)):
        # The model keeps one more share of the unknown: for the start, which no text holds.
        p = [10 ** (got[k * 1000 + j] - got[9000 + k]) for j in range(len(met) + 1)]
        assert sum(p) + p[-1] == pytest.approx(1, abs=1e-6)


def test_lm_counts_and_gains(docs_of):
    rows = [(i, t.replace("the", "The")) for i, t, _ in corpus(300)] + [r[:2] for r in edge_rows()]
    got = lm.query(docs_of(rows)).collect()
    assert len(got) == len(rows)
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        want[i, held(i), len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert lm.query(docs_of([])).collect() == []
    alone = lm.query(docs_of([(next(i for i in range(100) if held(i)), "a b")])).collect()
    assert [(r.n_known, r.train_tokens) for r in alone] == [(0, 0)]


def test_lm_learns_order(docs_of):
    """Words follow each other in a cycle: the context says what comes, the unigram score can't."""
    rows = [(i, " ".join(f"w{(i + k) % 12}" for k in range(150))) for i in range(400)]
    got = [r for r in lm.query(docs_of(rows)).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.5 * sum(r.base_score for r in got)


def test_lm_trains_on_every_position(docs_of):
    """Each token of each training document with the two before it, short documents and long ones alike."""
    rows = [(i, " ".join(f"w{(i * k) % 50}" for k in range(i % 23))) for i in range(120)] + [r[:2] for r in edge_rows()]
    head = lm.Lookup(np.zeros(0, np.int64), np.zeros(0, np.int64))
    written = [np.array(r.w) for r in lm._positions(docs_of(rows).select("doc_id", "text"), head).collect()]
    want = Counter()
    for i, t in rows:
        if lm.trains(i):
            c = [lm.START, lm.START] + [lm.HEAD + lm.tail_class(w) for w in [*(t or "").encode().lower().split(), b"\n<end>"]]
            want.update(zip(c, c[1:], c[2:]))
    assert sum(int((w != lm.START).sum()) for w in written) == sum(want.values())
    assert sum((Counter(zip(*lm._contexts(w).tolist())) for w in written), Counter()) == want


def test_lm_score_equals_brute_force(docs_of):
    """The sum over a text's tokens of log10 p(class | the two classes before) and of the token's share of its class, by definition."""
    rng = random.Random(12)
    text = lambda: " ".join(f"{rng.choice('abcd')}{min(int(rng.expovariate(0.004)), 2500)}" for _ in range(rng.choice((0, 1, 2, 30, 200))))
    rows = [(i, text()) for i in range(250)] + [(250, "A1 never met b2 b2"), (251, None), (252, " \n ")]
    fitted = lm.fit(docs_of(rows))
    got = {r.doc_id: r for r in lm.score(docs_of(rows), fitted).collect()}
    m = fitted.model
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n<end>"]
    counts = Counter(w for i, t in rows if lm.trains(i) for w in tokens(t))
    # The head is chosen among equals by hash: what stands in it is asked of the operator, how often it occurs is not.
    number = lambda w: int(fitted.head.of(np.array([lm.xxhash.xxh3_64_intdigest(w)], np.uint64).view(np.int64), -1)[0])
    vocabulary = {w for _, t in rows for w in tokens(t)}
    head = {w: number(w) for w in vocabulary if number(w) >= 0}
    assert len(head) == min(lm.HEAD, len(counts)) and min(counts[w] for w in head) >= max(n for w, n in counts.items() if w not in head)
    of = lambda w: head.get(w, lm.HEAD + lm.tail_class(w))
    n, kinds = Counter(), Counter()
    for w, c in counts.items():
        n[of(w)] += c
        kinds[of(w)] += 1
    for i, t in rows:
        before, total = [lm.START, lm.START], 0.0
        for w in tokens(t):
            c = of(w)
            context = m.r[before[1]].astype(float) @ m.c1 + m.r[before[0]].astype(float) @ m.c2
            s = m.q.astype(float) @ context + m.b
            total += (s[c] - np.log(np.exp(s - s.max()).sum()) - s.max()) / math.log(10)
            total += 0.0 if w in head else math.log10((counts[w] + 1) / (n[c] + kinds[c] + 1))
            before = [before[1], c]
        assert got[i].score == pytest.approx(total, rel=1e-4, abs=1e-3), i


def test_lm_distribution_sums_to_one():
    rng = np.random.default_rng(1)
    m = lm.Model(np.full(lm.CLASSES, 1 / lm.CLASSES))
    m.r, m.q = rng.normal(size=m.r.shape).astype(np.float32), rng.normal(size=m.q.shape).astype(np.float32) * 0.1
    one, two, z = m.tables()
    for w2, w1 in ((0, 1), (5, lm.START)):
        assert np.exp(one[w1] + two[w2] - z[w2, w1]).sum() == pytest.approx(1, abs=1e-3)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(1)
    clean = [(i, " ".join(f"{rng.choice('abcdefg')}{rng.randrange(400)}" for _ in range(60)), "en", f"s{i % 4}") for i in range(60)]
    copies = [(100 + i, clean[i][1].replace(" ", "  ", 1), "en", "s1") for i in range(3)]
    near = [(200, " ".join([*clean[5][1].split()[:58], "new", "words"]).replace(" ", "\n", 1), "en", "s2")]
    rows = clean + copies + near + [(300, None, None, None), (301, "", "en", "s0")]
    full = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for _, stage in c.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs = c.materialize(docs, "test")
        seen.append({r.doc_id for r in docs.collect()})
        if stage is not c.STAGES[-1][1]:
            assert docs.columns == before.columns
    assert {i for i in range(60)} <= seen[0] | set() and len(seen[0] & set(range(60))) >= 58
    assert not seen[1] & {100, 101, 102} and {300, 301} <= seen[1]
    assert seen[2] >= seen[1] & set(range(60)) and seen[4] == seen[3] <= seen[2]
    assert c.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_drops_short_lines(spark, docs_of):
    """Repeats of lines of one to four words go, links of four words with five (4 of 5 shared) too."""
    import corpus_pipeline as c
    from tests.llm.test_text import brute_lines

    rows = [(i, "\n".join(["short", f"own{i} line{i} of{i} its{i}", "read more", "a b c d" + " e" * (i % 2), "", "all rights are reserved here"])) for i in range(12)]
    rows += [(50, "short"), (51, "read  more"), (52, "more"), (53, None), (54, ""), (55, " \n ")]
    gone = brute_lines(rows, least=1)
    want = {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows if i not in (50, 51)}
    assert sum(map(len, gone.values())) == 46
    assert {r.doc_id: r.text for r in c.drop_repeated_lines(spark, docs_of(rows), "").collect()} == want


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_queries_equal_their_sql(spark):
    import duckdb

    from veldt.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    for name, sql in queries.SQL.items():
        theirs = con.execute(sql)
        df = queries.QUERIES[name](spark, SF).select(*[d[0] for d in theirs.description])
        assert sorted(repr(tuple(map(plain, r))) for r in df.collect()) == sorted(repr(tuple(map(plain, r))) for r in theirs.fetchall()), name


def test_pipelines_line_dedup_runs_no_python(spark, docs_of, monkeypatch):
    """Nor do the tables that it writes on the way: Python workers would add to the executors' memory."""
    import corpus_pipeline as c
    from veldt.llm import lines

    plans, plain = [], lines.materialize
    of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lines, "materialize", lambda df, name: (plans.append(of(df)), plain(df, name))[1])
    plans.append(of(c.drop_repeated_lines(spark, docs_of([(1, "a b c\nd"), (2, "a b c\ne f")]), "")))
    assert len(plans) > 3 and not any(word in plan for plan in plans for word in ("Arrow", "Python", "Pandas"))


def test_pipeline_stages_take_any_table(spark, docs_of, monkeypatch):
    """Each stage over nulls, repeated rows, a very long text and columns of clashing names, and over an empty table."""
    import corpus_pipeline as c

    rows = [*corpus(90), *edge_rows(), (700, corpus(90)[1][1], "en"), (701, corpus(90)[1][1], None, None)]
    odd = ["a.b", "__gone", "__lines", "__doc", "__size", "__a", "__key", "__copies", "copy", "__words", "id", "words"]
    for some in (rows, []):
        docs = docs_of(some)
        for name in odd:
            docs = docs.withColumn(name, lm.F.lit(f"<{name}>"))
        labels = labels_of(spark, corpus(90))
        monkeypatch.setattr(c, "table", lambda *_: labels)
        for k, (_, stage) in enumerate(c.STAGES):
            before, out = docs, stage(spark, docs, "")
            if k < len(c.STAGES) - 1:
                assert out.columns == before.columns, k
                docs = c.materialize(out, "test")
                got = docs.collect()
                assert all(r[name] == f"<{name}>" for r in got for name in odd)
                ids = [r.doc_id for r in got]
                # Texts without words stay; a row without an id is for the classifier and the mix only.
                assert not some or k == 3 or (900 in ids and 901 in ids and (k == 0 or ids.count(None) == without))
                without = ids.count(None)
            else:
                assert out.count() == docs.count()
