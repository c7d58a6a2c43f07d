"""Language-model scoring by a log-bilinear model, trained in numpy with noise-contrastive estimation.

Counts: the training documents' tokens (lower-cased words and one end for each document) are counted by their 64-bit hash,
combined in each task and then by shuffle; the counts are written as a table. They give the unigram base score.

Classes: the `HEAD` most frequent tokens are classes of their own; every other token, seen or not, belongs to one of `TAILS`
classes by a hash of its last three characters, so the class of any string is known without a table. The neural model
predicts a token's class from the classes of the two tokens before it: the context vector is the sum of a matrix for each
position times that position's class vector, the score of a class its product with the context vector plus a bias.
The classes of every training document are written down; each task trains a copy on all positions of its part of them against
noise classes drawn from the unigram distribution (noise-contrastive estimation); the copies are averaged with the tokens
they saw as weights, and that is done `ROUNDS` times. With 1024 classes and two context positions all contexts' normalisers fit a
table, which batched matrix products fill, so the log-probabilities are normalised, not estimated.

A token's probability is its class's times its share of the class: 1 for a head token, (c + 1) / (N_k + V_k + 1) for
a token of tail class k with N_k tokens of V_k kinds in training, which leaves one share for unseen ones. `score` is the sum of
log10 of these over a text.

Only tail tokens need their counts from the corpus-wide table: a document's distinct ones are joined to it by hash. Tokens
with at least 1 / HOT of all occurrences, which are at most HOT, are broadcast and looked up in place.

Defined cases: a null or empty text is its end token only; a null id is held in (its remainder is taken as 0); rows
that repeat an id are scored each for itself, and learnt from each for itself; without training documents all counts are 0;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import forget, map_arrow, materialize, words

#: Classes: head tokens, tail classes; the start of a text is the last class. Dimensions, noise samples, training rounds.
HEAD, TAILS, DIM, NOISE, BATCH, ROUNDS = 760, 263, 32, 128, 1024, 2
CLASSES = HEAD + TAILS + 1
START = CLASSES - 1
HOT = 1 << 17


class Tails(dict):
    """Tail classes by the last twelve bytes of words, which hold their last three characters; the class is of these three."""

    def __missing__(self, end: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        last = end[-3:] if end[-3:].isascii() else end.decode("utf-8", "replace")[-3:].encode()
        self[end] = out = zlib.crc32(last) % TAILS
        return out


_tails = Tails()


def tail_class(word: bytes) -> int:
    """The tail class of a word, by its last three characters."""
    return _tails[word[-3:] if word[-3:].isascii() else word[-12:]]


class Lookup:
    """Sorted tokens with a number each."""

    def __init__(self, tokens: np.ndarray, numbers: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.numbers = tokens[order], numbers[order]

    def of(self, tokens: np.ndarray, absent: int) -> np.ndarray:
        if not len(self.tokens):
            return np.full(len(tokens), absent)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.numbers[at], absent)


class Words(dict):
    """Words as small numbers, with what is known of each in arrays by number; number 0 is the end token.

    What is derived of a word is worked out once, when it is first met. Between texts, `trim` drops the later half of the
    numbers when there are more than `limit`, for what is frequent comes early.
    """

    def __init__(self, head: Lookup | None = None, often: Lookup | None = None, limit: int = 400_000):
        super().__init__()
        self.limit, self.head, self.often = limit, head, often
        self.hash = np.zeros(1 << 16, np.int64)
        self.tail, self.cls, self.n = (np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64))
        self[b"\n<end>"] = 0
        self.done = 0
        self._derive([b"\n<end>"])

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        self.fresh.append(word)
        return i

    def _derive(self, fresh: list[bytes]) -> None:
        upto = self.done + len(fresh)
        while upto > len(self.hash):
            for name in ("hash", "tail", "cls", "n"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        new = slice(self.done, upto)
        self.hash[new] = np.array([xxhash.xxh3_64_intdigest(w) for w in fresh], np.uint64).view(np.int64)
        self.tail[new] = list(map(tail_class, fresh))
        if self.head is not None:
            at = self.head.of(self.hash[new], -1)
            self.cls[new] = np.where(at < 0, HEAD + self.tail[new], at)
        if self.often is not None:
            self.n[new] = self.often.of(self.hash[new], 0)
        self.done = upto

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' tokens, one text after the other, ends included; and each text's number of tokens."""
        self.fresh: list[bytes] = []
        found = [words(t) for t in texts]
        sizes = np.array([len(w) + 1 for w in found], np.int64)
        out = np.zeros(int(sizes.sum()), np.int64)
        start = 0
        for w in found:
            out[start : start + len(w)] = np.fromiter(map(self.__getitem__, w), np.int64, len(w))
            start += len(w) + 1
        if self.fresh:
            self._derive(self.fresh)
        return out, sizes

    def trim(self) -> bool:
        if len(self) <= self.limit:
            return False
        for w in list(self)[self.limit // 2 :]:
            del self[w]
        self.done = len(self)
        return True


def trains(doc_id: int | None, folds: int = 7, held: int = 2) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds != held


def _groups(batches: Iterator[pa.RecordBatch], training: bool, chars: int = 400_000) -> Iterator[tuple[list, list]]:
    """Ids and texts, some hundred thousand characters at a time."""
    ids, texts, size = [], [], 0
    for b in batches:
        for doc, text in zip(b.column(0), b.column(1), strict=True):
            doc = doc.as_py()
            if training and not trains(doc):
                continue
            ids.append(doc)
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= chars or len(ids) >= 1000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _count(docs: DataFrame) -> DataFrame:
    """(token, tail, n): how often each token occurs in the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        n = np.zeros(len(known.hash), np.int64)

        def out() -> pa.RecordBatch:
            at = np.nonzero(n)[0]
            return pa.RecordBatch.from_arrays([pa.array(known.hash[at]), pa.array(known.tail[at], pa.int32()), pa.array(n[at])], names=["token", "tail", "n"])

        for _, texts in _groups(batches, True):
            found = np.bincount(known.of(texts)[0])
            if len(n) < len(known.hash):
                n = np.concatenate([n, np.zeros(len(known.hash) - len(n), np.int64)])
            n[: len(found)] += found
            if len(known) > known.limit:
                yield out()
                n[:] = 0
                known.trim()
        if n.any():
            yield out()

    return map_arrow(docs, run, "token long, tail int, n long").groupBy("token").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


class _Classes:
    """The classes that occur in a column of a batch: `own`, where each position's stands among them (`at`), and sums over the positions of each."""

    def __init__(self, w: np.ndarray):
        self.order = np.argsort(w.astype(np.int16), kind="stable")  # of 16 bits, so by radix
        by_class = w.take(self.order)
        new = np.concatenate([[True], by_class[1:] != by_class[:-1]])
        self.starts = np.nonzero(new)[0]
        self.own = by_class[self.starts]
        self.at = np.empty(len(w), np.int64)
        self.at[self.order] = np.cumsum(new) - 1

    def sums(self, rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(rows.take(self.order, 0), self.starts, axis=0)


def _about_exp(x: np.ndarray) -> np.ndarray:
    """exp to within 4 percent, by writing x into a float's exponent and mantissa; x is overwritten."""
    np.clip(x, -80, 80, out=x)
    x *= np.float32(2**23 / np.log(2))
    x += np.float32(127 * 2**23 - 366_393)
    return x.astype(np.int32).view(np.float32)


class Model:
    """Class vectors r, context matrices c1 (the token before) and c2, predicted vectors q, biases b."""

    NAMES = ("r", "c1", "c2", "q", "b")

    def __init__(self, unigram: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.r = rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32)
        self.c1, self.c2 = (np.eye(DIM, dtype=np.float32) for _ in range(2))
        self.unigram = unigram
        self.b = np.log(unigram).astype(np.float32)
        self.lift = np.log(NOISE * unigram).astype(np.float32)
        self.cumulated = np.cumsum(unigram)
        self.cumulated[-1] = 1.0

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            m = getattr(self, n)
            setattr(self, n, flat[at : at + m.size].reshape(m.shape).astype(np.float32))
            at += m.size

    def learn(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray, rng: np.random.Generator, state: dict, rate: float) -> None:
        """One step of noise-contrastive estimation with AdaGrad; a batch shares its noise samples. Rows without a gradient stay as they are."""
        noise = np.searchsorted(self.cumulated, rng.random(NOISE))
        # What depends on a context class alone is worked out once for each class, and gradients are added up by class first.
        k1, k2 = _Classes(w1), _Classes(w2)
        r1, r2 = self.r[k1.own], self.r[k2.own]
        h = (r1 @ self.c1).take(k1.at, 0)
        h += (r2 @ self.c2).take(k2.at, 0)
        q, q_noise = self.q.take(w, 0), self.q[noise]
        n = np.float32(len(w))
        own = np.einsum("ij,ij->i", h, q) + (self.b - self.lift).take(w)
        other = h @ -q_noise.T  # and in place: minus the gradient of each noise sample, the sigmoid over n
        other -= self.b[noise] - self.lift[noise]
        g_own = 1 / (n * (1 + np.exp(np.minimum(own, 80))))  # how far a true class is from being told from noise
        other = _about_exp(other)
        other += 1
        np.divide(np.float32(-1) / n, other, out=other)
        own_part = g_own[:, None]
        dh = own_part * q
        dh += other @ q_noise
        # Gradients of the predicted vectors and biases, side by side: of the true classes and of the noise.
        one = np.empty((len(w) + NOISE, DIM + 1), np.float32)
        np.multiply(own_part, h, out=one[: len(w), :DIM])
        one[: len(w), DIM] = g_own
        one[len(w) :, :DIM] = other.T @ h
        one[len(w) :, DIM] = other.sum(0)
        k = _Classes(np.concatenate([w, noise]))
        d = k.sums(one)
        d1, d2 = k1.sums(dh), k2.sums(dh)
        dr = np.zeros_like(self.r)
        dr[k1.own] = d1 @ self.c1.T
        dr[k2.own] += d2 @ self.c2.T
        self._step("q", k.own, d[:, :DIM], state, rate)
        self._step("b", k.own, d[:, DIM], state, rate)
        self._step("c1", slice(None), r1.T @ d1, state, rate)
        self._step("c2", slice(None), r2.T @ d2, state, rate)
        met = np.zeros(CLASSES, bool)
        met[k1.own] = met[k2.own] = True
        met = np.nonzero(met)[0]
        self._step("r", met, dr[met], state, rate)

    def _step(self, name: str, at, d: np.ndarray, state: dict, rate: float) -> None:
        """AdaGrad on some rows of a matrix."""
        m = getattr(self, name)
        s = state.setdefault(name, np.full(m.shape, 1e-8, np.float32))
        seen = s[at] + d * d
        s[at] = seen
        m[at] += np.float32(rate) * d / np.sqrt(seen)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural-log tables: the score of class w after w1 at one back, after w2 at two back, and the normaliser of (w2, w1)."""
        one = self.r @ self.c1 @ self.q.T + self.b
        two = self.r @ self.c2 @ self.q.T
        z = np.empty((CLASSES, CLASSES), np.float32)
        for w2 in range(CLASSES):
            s = one + two[w2]
            top = s.max(1)
            z[w2] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return one, two, z


def _positions(docs: DataFrame, head: Lookup) -> DataFrame:
    """(w): arrays of the classes of whole training documents, each document after two starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Words(head), [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held)], pa.list_(pa.int16()))], names=["w"])

        for _, texts in _groups(batches, True):
            numbers, sizes = known.of(texts)
            classes = known.cls[numbers].astype(np.int16)
            held.append(np.insert(classes, np.repeat(np.cumsum(sizes) - sizes, 2), START))
            size += len(classes)
            known.trim()
            if size >= 64 * BATCH:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return materialize(map_arrow(docs, run, "w array<short>"), "positions")


def _contexts(w: np.ndarray) -> np.ndarray:
    """(3, n): the two classes before each token, and its own, for all tokens of an array that `_positions` wrote."""
    at = np.nonzero(w != START)[0]
    return np.stack([w[at - 2], w[at - 1], w[at]])


def _summed(copies: DataFrame, *by: str) -> DataFrame:
    """Sums of `seen` and of the arrays x, place by place."""
    keys = [f.name for f in copies.schema.fields if f.name in by]

    def run(t: pa.Table) -> pa.Table:
        x = np.asarray(t.column("x").combine_chunks().flatten()).reshape(t.num_rows, -1).sum(0)
        return pa.table({**{k: t.column(k).slice(0, 1) for k in keys}, "seen": pa.array([sum(t.column("seen").to_pylist())]), "x": pa.array([x], pa.list_(pa.float64()))})

    return copies.select(*keys, "seen", "x").groupBy(*keys).applyInArrow(run, ", ".join(f"{k} int" for k in keys) + ", seen double, x array<double>")


def _train(docs: DataFrame, head: Lookup, unigram: np.ndarray) -> Model:
    model = Model(unigram)
    positions = _positions(docs, head)
    sc = docs.sparkSession.sparkContext
    for turn in range(ROUNDS):
        shared = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            start, state, seen = shared.value, {}, 0
            m = Model(start.unigram)
            m.load(start.flat())
            for b in batches:
                for row in b.column(0):
                    w = np.asarray(row.values)
                    rng = np.random.default_rng([turn, xxhash.xxh3_64_intdigest(w.tobytes())])  # by content, not by where it runs
                    x = _contexts(w.astype(np.int64))
                    x = x[:, rng.permutation(x.shape[1])]
                    for at in range(0, x.shape[1], BATCH):
                        m.learn(*x[:, at : at + BATCH], rng, state, 0.1)
                    seen += x.shape[1]
            if seen:
                flat = m.flat().astype(np.float64) * seen
                rows = np.resize(flat, (-(-len(flat) // 1024), 1024))
                salt = TaskContext.get().partitionId() % 64
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array([float(seen)] * len(rows)), pa.array(list(rows), pa.list_(pa.float64()))], names=["row", "salt", "seen", "x"])

        # Whole arrays are added, in two steps, so that no task holds those of all tasks.
        copies = map_arrow(positions, run, "row int, salt int, seen double, x array<double>")
        averaged = _summed(_summed(copies, "row", "salt"), "row").orderBy("row").collect()  # the model's weights
        if not averaged:
            break
        model.load(np.concatenate([np.array(r["x"]) / r["seen"] for r in averaged])[: len(model.flat())])
    forget(positions)
    return model


class Fitted:
    """What scoring needs of the training documents: the table of counts, sums of it, and the neural model."""

    def __init__(self, counts: DataFrame, total: int, kinds: int, head: Lookup, hot: Lookup, tail_n: np.ndarray, tail_kinds: np.ndarray, model: Model):
        self.counts, self.total, self.kinds, self.head, self.hot, self.tail_n, self.tail_kinds, self.model = counts, total, kinds, head, hot, tail_n, tail_kinds, model


def fit(docs: DataFrame) -> Fitted:
    """docs (doc_id, text): those that train are counted and learnt from."""
    docs = docs.select("doc_id", "text")
    counts = materialize(_count(docs), "counts")
    total, kinds = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, kinds = total or 0, kinds or 0
    top = counts.orderBy(F.desc("n"), "token").limit(HEAD).select("token", "tail", "n").toPandas()
    head_tokens, head_n = top["token"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    head = Lookup(head_tokens, np.arange(len(head_tokens)))
    hot = counts.filter(F.col("n") >= max(1, -(-total // HOT))).select("token", "n").toPandas()  # at most HOT rows
    known, at = np.unique(np.concatenate([head_tokens, hot["token"].to_numpy(np.int64)]), return_index=True)
    hot = Lookup(known, np.concatenate([head_n, hot["n"].to_numpy(np.int64)])[at])
    tails = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).toPandas()  # TAILS rows
    tail_n, tail_kinds = np.zeros(TAILS), np.zeros(TAILS)
    tail_n[tails["tail"].to_numpy(int)], tail_kinds[tails["tail"].to_numpy(int)] = tails["n"], tails["kinds"]
    np.subtract.at(tail_n, top["tail"].to_numpy(int), head_n)
    np.subtract.at(tail_kinds, top["tail"].to_numpy(int), 1)
    mass = np.concatenate([head_n, np.zeros(HEAD - len(head_n)), tail_n, [0]]) + 0.5
    mass[len(head_n) : HEAD] = 1e-3  # head places that a small vocabulary leaves empty
    mass[START] = 1e-3
    return Fitted(counts, total, kinds, head, hot, tail_n, tail_kinds, _train(docs, head, mass / mass.sum()))


def score(docs: DataFrame, fitted: Fitted | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), by the model of docs' own training documents unless another is given."""
    docs = docs.select("doc_id", "text")
    fitted = fit(docs) if fitted is None else fitted
    counts, total = fitted.counts, fitted.total
    one, two, z = fitted.model.tables()
    share = -np.log10(fitted.tail_n + fitted.tail_kinds + 1)
    least = np.log10(total + fitted.kinds + 1)
    shared = docs.sparkSession.sparkContext.broadcast((fitted.head, fitted.hot, one, two, z, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first, often, one, two, z, share), rows = shared.value, 0
        known, part = Words(first, often), TaskContext.get().partitionId() << 40
        for ids, texts in _groups(batches, False):
            numbers, sizes = known.of(texts)
            starts = np.cumsum(sizes) - sizes
            c, tail, n = known.cls[numbers], known.tail[numbers], known.n[numbers]
            w1, w2 = np.roll(c, 1), np.roll(c, 2)
            w1[starts] = w2[starts] = START
            w2[(starts + 1)[sizes > 1]] = START
            seen, is_tail = n > 0, c >= HEAD
            base = np.where(seen, np.log10(n + 1.0), 0.0)
            own = (one[w1, c] + two[w2, c] - z[w2, w1]) / np.log(10) + np.where(is_tail, share[tail] + base, 0.0)
            of = np.repeat(np.arange(len(ids)), sizes)[~seen]
            rare = known.hash[numbers[~seen]]
            order = np.lexsort((rare, of))
            of, rare = of[order], rare[order]
            new = np.ones(len(rare), bool)
            new[1:] = (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])
            at = np.nonzero(new)[0]
            times = np.diff(np.append(at, len(rare)))
            cuts = pa.array(np.searchsorted(of[at], np.arange(len(ids) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part + rows + np.arange(len(ids))), pa.array(ids, pa.int64()), pa.array([not trains(i) for i in ids]), pa.array(sizes), pa.array(np.add.reduceat(seen.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(own, starts)), pa.ListArray.from_arrays(cuts, pa.array(rare[at])), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "own", "rare", "times"],
            )
            rows += len(ids)
            known.trim()

    placed = materialize(map_arrow(docs, run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, own double, rare array<long>, times array<long>"), "placed")
    rare = placed.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    # All head tokens were looked up in place, so each of these counts for both scores alike.
    met = rare.join(counts.select("token", "n"), "token").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain"))
    j = placed.drop("rare", "times").join(met, "row", "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    return j.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("gain") - F.col("n_tokens") * F.lit(float(least))).alias("base_score"), (F.col("own") + F.col("gain")).alias("score"),
    )


def query(docs: DataFrame) -> DataFrame:
    return score(docs)
