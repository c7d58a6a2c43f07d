"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text, by sharded count joins.

Trusted are documents whose label says so. One half of them, by a hash of the id, trains the model: all of them, with
their whole texts. The counts are sharded by n-gram and travel as packed blocks, a few bytes a trigram: distinct trigrams go to the bucket of
their context (u, v), where each context's counts are complete, and on to the bucket of their pair (v, w), where each pair's are. Words' counts
are summed by word and answered to the buckets that hold the word. Only the counts of counts, which give the discounts, and sums come to the driver.

A document's log10 probability is a sum over its n-grams: log p(w | u v) = unknown + gain(w) + left(v) + gain(v w) + left(u v) + gain(u v w),
where an n-gram that training lacks adds 0. A document's distinct n-grams are sent to the bucket of the n-gram, where the values are worked out
from the counts; they are never stored. This is done for SLICES shares of the buckets, one after the other, so that the shuffle files of one share
at a time are on disk, for which documents are read as often. Two things of fixed size spare most n-grams that way: a bitmap of the model's keys, and the HOT
n-grams that are most frequent in training, which are looked up in place (so a frequent n-gram is no hot key). Where the
bitmap fills up, beyond about 50 million n-grams, more n-grams travel; results stay the same.

A document's score is its mean negative log10 probability for a word, drawn towards its language's mean as `prior`
words of it would draw it, so that short texts aren't judged by a few words. The other half of the trusted documents,
all of them, gives each language's mean and the quantile above which documents are rejected; a language with fewer than
`least_docs` of them takes those of all languages together.

Defined cases: documents without words score their language's mean and are kept; a null language is one of its own;
null ids are scored like others; rows that repeat an id are scored each for itself; labels that contradict each other
count as not trusted; without trusted documents in either half nothing is rejected; other columns pass through.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import bitmap, forget, give_back, map_arrow, materialize, may_hold, mix, quoted, tidy, unused

#: Shares of the buckets that are scored one after the other.
SLICES = 4
#: N-grams that are looked up in place, the most frequent of training; longs of the bitmap of all of them.
HOT, BITS = 1 << 20, 1 << 22
#: Words of texts that are dealt to buckets at once.
_AT_ONCE = 250_000
#: What a packed row of a bucket holds.
_GRAMS, _CONTEXTS, _ANSWER, _WORDS, _ASKED, _HEADER = range(6)
_ROWS = "bucket int, kind int, at long, block binary"
_SUMS = ", n array<long>, e array<long>"
#: Languages up to which the bounds, a row for each, are broadcast.
FEW = 10_000
_START = np.uint64(0)  # the word before a text
_STEP = np.random.default_rng(20240307).integers(0, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: What a key of the table stands for: an n-gram of one, two or three words; a word or bigram as the end of a text, where it is no context.
WORD, PAIR, TRIPLE, LAST_WORD, LAST_PAIR = range(1, 6)


def _key(kind: int, *hashes: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams, given as one array of word hashes for each place."""
    h = np.full(len(hashes[0]), kind, np.uint64)
    for place, x in enumerate(hashes):
        h = (h + x) * _STEP[place]
        h ^= h >> np.uint64(31)
    return mix(h)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[memoryview]]:
    """64-bit hashes of the words of all texts, each text's number of words, and its bytes. The words are those of `words`, cut and hashed for all texts
    at once; hashes go by a word's bytes, eight at a time, and its length."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    data = memoryview(b"" if data is None else data)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    low = data.tobytes().lower() + bytes(8)  # touches ASCII only
    held = np.frombuffer(low, np.uint8, len(low) - 8)
    inside = (held != 32) & (held - np.uint8(9) > 4)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(held))]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    starts = np.nonzero(first)[0]
    size = np.nonzero(last)[0] + 1 - starts
    eight = np.ndarray(max(len(low) - 7, 0), np.dtype("<u8"), low, strides=(1,))
    h = size.astype(np.uint64) * _STEP[0]
    rest = np.arange(len(starts)) if len(starts) else np.zeros(0, np.int64)
    done = 0
    while len(rest):
        left = np.minimum(size[rest] - done, 8).astype(np.uint64)
        h[rest] = mix((h[rest] + (eight[starts[rest] + done] & (np.uint64(2**64 - 1) >> np.uint64(8) * (np.uint64(8) - left)))) * _STEP[1])
        done += 8
        rest = rest[size[rest] > done]
        if done == 128 and len(rest):
            for k in rest:  # very long words: one call each for what is left
                h[k] = mix(h[k : k + 1] + np.uint64(xxhash.xxh3_64_intdigest(low[starts[k] + done : starts[k] + size[k]])))[0]
            break
    return h, np.diff(np.searchsorted(starts, offsets)), [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _padded(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, each text's after two starts; and the places of the words."""
    at = np.arange(len(h)) + 2 * (1 + np.repeat(np.arange(len(sizes)), sizes))
    whole = np.full(len(h) + 2 * len(sizes), _START)
    whole[at] = h
    return whole, at


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from n[k - 1] n-grams of count k, held to (0, count) where these are too few."""
    usual = [0.0, 0.5, 0.75, 0.9]
    if not n[0] or not n[1]:
        return usual
    y = n[0] / (n[0] + 2 * n[1])
    made = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else usual[k] for k in (1, 2, 3)]
    return [0.0] + [min(max(d, 0.05), k - 0.05) for k, d in enumerate(made, 1)]


def _trusted(labels: DataFrame) -> DataFrame:
    """(doc_id, trains) of trusted documents; trains: of the half that may train."""
    t = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).filter("least = 1 and most = 1")
    return t.select("doc_id", _half("doc_id").alias("trains"))


def _half(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("half")), F.lit(2)) == 0


def _training(docs: DataFrame, labels: DataFrame, train_docs: int | None = None) -> DataFrame:
    """Written down: (text) of the documents that train, all of them or where given the `train_docs` of the smallest hashes."""
    drawn = _trusted(labels).filter("trains")
    if train_docs is not None:
        drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    drawn = materialize(drawn.select("doc_id"), "drawn")
    bits = bitmap(drawn, "doc_id")
    # Only texts that the half and the bitmap let through meet the list, should the join be a shuffled one.
    id_ = F.col("doc_id").cast(drawn.schema["doc_id"].dataType)
    may = docs.select(id_.alias("doc_id"), "text").filter(_half("doc_id") & may_hold(bits, F.col("doc_id")))
    chosen = materialize(may.join(drawn, "doc_id", "left_semi").select("text"), "training")
    forget(drawn, bits)
    return chosen


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of counts or places, doubles or 64-bit hashes (few bytes where sorted), exactly, in one compressed block."""
    parts = []
    for x in arrays:
        code = b"x"
        if x.dtype == np.uint64:
            x, code = np.diff(x, prepend=np.uint64(0)), b"h"
        elif x.dtype != np.float64:
            x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
        code = code if code == b"h" else x.dtype.char.encode()
        # Byte by byte of all values: high ones are alike.
        parts += [struct.pack("<cq", code, len(x)), np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()]
    raw = b"".join(parts)
    return struct.pack("<q", len(raw)) + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(block: bytes) -> list[np.ndarray]:
    """What `_pack` was given; counts and places as int64."""
    raw = pa.Codec("zstd").decompress(memoryview(block)[8:], struct.unpack_from("<q", block)[0], asbytes=True)
    at, out = 0, []
    while at < len(raw):
        code, n = struct.unpack_from("<cq", raw, at)
        kind = np.dtype(np.uint64 if code == b"h" else code.decode())
        at += 9
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).reshape(-1).view(kind)
        at += n * kind.itemsize
        out.append(np.cumsum(x, dtype=np.uint64) if code == b"h" else x if kind == np.float64 else x.astype(np.int64))
    return out


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), schema, strict=True)], schema=schema) if rows else schema.empty_table()


_BLOCKS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("at", pa.int64()), ("block", pa.binary())])
_COUNTED = _BLOCKS.append(pa.field("n", pa.list_(pa.int64()))).append(pa.field("e", pa.list_(pa.int64())))


def _of_kinds(t: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    """(at, block) of a bucket's rows, by kind; blocks aren't copied."""
    out: dict[int, list[tuple[int, bytes]]] = {}
    for kind, at, block in zip(t.column("kind").to_pylist(), t.column("at").to_pylist(), t.column("block"), strict=True):
        out.setdefault(kind, []).append((at, block.as_buffer()))
    return out


def _by(df: DataFrame, column: str, run, schema: str) -> DataFrame:
    """df's groups through run, after which a worker gives the memory of large ones back."""

    def spare(t: pa.Table) -> pa.Table:
        large = t.nbytes > 1 << 20
        try:
            return run(t)
        finally:
            del t
            if large:
                give_back()

    return df.groupBy(column).applyInArrow(spare, schema)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a key of a pair, or of a word's hash."""
    return ((mix(keys) >> np.uint64(44)) % np.uint64(buckets)).astype(np.int64)


def _paired(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of hashes x, y, z: the distinct hashes; places there of distinct pairs (x, y); and for each distinct triple, by pair, its pair and the
    place of its z, a row that holds it; and the triple of each row."""
    ids, at = np.unique(np.concatenate([x, y, z]), return_inverse=True)
    ix, iy, iz = at.reshape(3, -1)
    pairs, of = np.unique(ix * len(ids) + iy, return_inverse=True)
    triples, row, triple = np.unique(of * len(ids) + iz, return_index=True, return_inverse=True)
    return ids, pairs // len(ids), pairs % len(ids), triples // len(ids), triples % len(ids), row, triple


def _split(where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its rows in order) for each bucket that occurs."""
    order = np.argsort(where, kind="stable")
    starts = np.nonzero(np.diff(where[order], prepend=-1))[0]
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        yield int(where[order[a]]), order[a:b]


def _local(ids: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
    """The ids that places use, and the places among these."""
    used, at = np.unique(np.concatenate(places), return_inverse=True)
    return [ids[used], *at.reshape(len(places), -1)]


def _by_count(of: np.ndarray, count: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of n: how many of its counts are 1, 2, and 3 or more."""
    return [np.bincount(of[ok], minlength=n) for ok in (count == 1, count == 2, count > 2)]


def _first_four(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def _near(chosen: DataFrame, buckets: int, share: int) -> DataFrame:
    """Written down: the distinct trigrams (u, v, w) of the contexts (u, v) in one share of the buckets, with the counts of both, for the buckets of (v, w)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            u, v, w = map(np.concatenate, zip(*held, strict=True))
            ids, px, py, pair, iw, _, triple = _paired(u, v, w)
            c = np.bincount(triple, minlength=len(pair))
            where = _bucket(_key(PAIR, ids[px], ids[py]), buckets)[pair]
            rows = [(k, _GRAMS, 0, _pack(*_local(ids, px[pair[at]], py[pair[at]], iw[at]), c[at])) for k, at in _split(where)]
            yield from _rows(rows, _BLOCKS).to_batches()

        held, size = [], 0
        for b in batches:
            whole, places = _padded(*_hashed(b.column(0))[:2])
            for a in range(0, len(places), _AT_ONCE):  # some of the words of a batch of long texts
                at = places[a : a + _AT_ONCE]
                at = at[_bucket(_key(PAIR, whole[at - 2], whole[at - 1]), buckets) % SLICES == share]
                held.append((whole[at - 2], whole[at - 1], whole[at]))
                size += len(at)
                if size >= _AT_ONCE:
                    yield from dealt(held)
                    held, size = [], 0
        if size:
            yield from dealt(held)

    def by_context(t: pa.Table) -> pa.Table:
        """All trigrams (u, v, w) of the bucket's contexts (u, v), to the buckets of (v, w); and the contexts, to the same bucket as pairs."""
        parts = []
        for _, block in _of_kinds(t)[_GRAMS]:
            ids, *places, c = _unpack(block)
            parts.append([*(ids[p] for p in places), c])
        u, v, w, c = map(np.concatenate, zip(*parts, strict=True))
        ids, px, py, pair, iw, _, triple = _paired(u, v, w)
        c = np.bincount(triple, c, len(pair)).astype(np.int64)
        n = _by_count(pair, c, len(px))
        s = np.bincount(pair, c, len(px)).astype(np.int64)
        own = int(t.column("bucket")[0].as_py())
        keys = _key(PAIR, ids[px], ids[py])
        order = np.argsort(keys)
        rows = [(own, _CONTEXTS, 0, _pack(keys[order], *(x[order] for x in (*n, s))))]
        where = _bucket(_key(PAIR, ids[py[pair]], ids[iw]), buckets)
        rows += [(k, _GRAMS, 0, _pack(*_local(ids, px[pair[at]], py[pair[at]], iw[at]), c[at], *(x[pair[at]] for x in n))) for k, at in _split(where)]
        return _rows(rows, _BLOCKS)

    return materialize(_by(map_arrow(chosen, count, _ROWS), "bucket", by_context, _ROWS), "near")


def _grams(chosen: DataFrame, buckets: int) -> list[DataFrame]:
    """Written down for each share of the buckets of pairs (v, w), a row for each bucket: distinct trigrams with all counts but the words', and the counts of counts."""

    def by_pair(t: pa.Table) -> pa.Table:
        held, key = _of_kinds(t), int(t.column("bucket")[0].as_py())
        parts = [[np.zeros(0, np.uint64)] * 3 + [np.zeros(0, np.int64)] * 4]
        for _, block in held.get(_GRAMS, ()):
            ids, *places, c, n1, n2, n3 = _unpack(block)
            parts.append([*(ids[p] for p in places), c, n1, n2, n3])
        u, v, w, *counts = map(np.concatenate, zip(*parts, strict=True))
        ids, px, py, pair, iu, row, _ = _paired(v, w, u)
        counts = [x[row] for x in counts]
        # The pairs as contexts: none at texts' ends, and one context that is no pair, that of texts' starts.
        contexts, first = [np.zeros(len(px), np.int64) for _ in range(4)], [0] * 4
        pairs = _key(PAIR, ids[px], ids[py])
        order = np.argsort(pairs)
        for _, block in held.get(_CONTEXTS, ()):
            own, *n = _unpack(block)
            start = own == _key(PAIR, *[np.array([_START])] * 2)
            first = [a + int(b[start].sum()) for a, b in zip(first, n, strict=True)]
            at = order[np.searchsorted(pairs[order], own[~start])] if len(own) > start.sum() else np.zeros(0, np.int64)
            for into, b in zip(contexts, n, strict=True):
                into[at] = b[~start]
        size = np.bincount(pair, minlength=len(px))
        before = _before(ids, px, pair, size, counts[0])
        n = _first_four(counts[0]) + _first_four(before)
        return _rows([(key, _GRAMS, 0, _pack(ids, px, py, size, iu, *counts, *contexts), n, first)], _COUNTED)

    near = [_near(chosen, buckets, k) for k in range(SLICES)]
    forget(chosen)
    every = _all(near)
    grams = [materialize(_by(every.filter(F.col("bucket") % SLICES == k), "bucket", by_pair, _ROWS + _SUMS), "grams") for k in range(SLICES)]
    forget(*near)
    return grams


def _all(parts: list[DataFrame]) -> DataFrame:
    """Tables of one schema that `materialize` returned, as one."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[p.scratch_path for p in parts])


def _before(ids: np.ndarray, px: np.ndarray, pair: np.ndarray, size: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Pairs' continuation counts, but for those at a text's start, which nothing can precede, their plain counts."""
    return np.where(ids[px] == _START, np.bincount(pair, c, len(px)).astype(np.int64), size)


def _trigrams(docs: DataFrame, labels: DataFrame, train_docs: int | None = None) -> DataFrame:
    """(u, v, w, c): the training documents' trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0).to_pylist():
                ids, px, py, size, iu, c, *_ = _unpack(block)
                pair = np.repeat(np.arange(len(px)), size)
                u, v, w = (ids[p].view(np.int64) for p in (iu, px[pair], py[pair]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, w, c)], names=["u", "v", "w", "c"])

    return map_arrow(_all(_grams(_training(docs, labels, train_docs), _buckets(docs))).select("block"), run, "u long, v long, w long, c long")


def _buckets(df: DataFrame) -> int:
    """Buckets of the model: as many as a shuffle has partitions, which are of a size to suit the executors."""
    return max(16, min(4096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _vocabulary(grams: DataFrame, buckets: int) -> DataFrame:
    """Written down: for each bucket the counts of the words that it holds, an answer from each bucket of words; and the words of each bucket of words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, px, py, size, _, c, *_ = _unpack(block)
                pair = np.repeat(np.arange(len(px)), size)
                before = _before(ids, px, pair, size, c)
                n = len(ids)
                counts = [np.bincount(py, minlength=n), np.bincount(py[pair], c, n).astype(np.int64), np.bincount(px, before, n).astype(np.int64), *_by_count(px, before, n)]
                rows = [(k, _WORDS, key, _pack(ids[at], *(x[at] for x in counts))) for k, at in _split(_bucket(ids, buckets))]
                yield from _rows(rows, _BLOCKS).to_batches()

    def answer(t: pa.Table) -> pa.Table:
        """Of words: number of pairs they end, count, sum of the pairs they begin, and how many of these count 1, 2, 3 or more."""
        key, asked = int(t.column("bucket")[0].as_py()), [(k, _unpack(block)) for k, block in _of_kinds(t)[_WORDS]]
        ids, at = np.unique(np.concatenate([x[0] for _, x in asked]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([x[place] for _, x in asked]), len(ids)).astype(np.int64) for place in range(1, 7)]
        ends, _, s, *n = sums
        begins = np.nonzero(ids == _START)[0]
        known = [*_first_four(ends), int(ends.sum()), int((ends > 0).sum())]
        rows = [(key, _WORDS, key, _pack(ids, *sums), known, [int(x[begins].sum()) for x in (*n, s)])]
        for k, (own, *_) in asked:
            place = np.searchsorted(ids, own)
            rows.append((k, _ANSWER, key, _pack(*(x[place] for x in (ends, s, *n))), [0] * 6, [0] * 4))
        return _rows(rows, _COUNTED)

    return materialize(_by(map_arrow(grams.select("bucket", "block"), ask, _ROWS), "bucket", answer, _ROWS + _SUMS), "words")


class Figures:
    """What all probabilities need: discounts of the three orders by count, the sum of the words' continuation counts, the share of an unknown word."""

    def __init__(self, d1: list[float], d2: list[float], d3: list[float], total: int, rest: float):
        self.d1, self.d2, self.d3, self.total, self.rest = np.array(d1), np.array(d2), np.array(d3), float(total), rest
        self.unknown = float(np.log10(rest))

    def word(self, ends: np.ndarray) -> np.ndarray:
        return (ends - self.d1[np.minimum(ends, 3)]) / self.total + self.rest


def _left(d: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What contexts keep for what they have not met: as a sum, and as a share (1 where there is no such context)."""
    h = d[1] * n1 + d[2] * n2 + d[3] * n3
    return h, np.where(s > 0, h / np.maximum(s, 1), 1.0)


class Model:
    """The counts in `buckets` buckets, the figures, the log10 probability of an unknown word, and what each text with words adds for its start."""

    def __init__(self, grams: list[DataFrame], words_: DataFrame, buckets: int, figures: Figures, start: float):
        self.grams, self.words, self.buckets, self.figures, self.unknown, self.start = grams, words_, buckets, figures, figures.unknown, start

    def rows(self, k: int | None = None) -> DataFrame:
        """The packed rows, of all buckets or of those of share k."""
        names = ["bucket", "kind", "at", "block"]
        grams = _all(self.grams) if k is None else self.grams[k]
        words_ = self.words if k is None else self.words.filter(F.col("bucket") % SLICES == k)
        return grams.select(*names).unionByName(words_.select(*names))

    def forget(self) -> None:
        forget(*self.grams, self.words)


def train(docs: DataFrame, labels: DataFrame, train_docs: int | None = None) -> Model | None:
    """The model of the documents that train; None if they have no words."""
    chosen, buckets = _training(docs, labels, train_docs), _buckets(docs)
    parts = _grams(chosen, buckets)
    grams = _all(parts)
    words_ = _vocabulary(grams, buckets)

    def sums(df: DataFrame, name: str, n: int) -> list[int]:
        return [x or 0 for x in df.agg(*[F.sum(F.col(name)[k]) for k in range(n)]).first()]

    n32, (*n1, total, kinds) = sums(grams, "n", 8), sums(words_, "n", 6)
    if not kinds:
        forget(*parts, words_)
        return None
    d1, d2, d3 = _discounts(n1), _discounts(n32[4:]), _discounts(n32[:4])
    held = d1[1] * n1[0] + d1[2] * n1[1] + d1[3] * (kinds - n1[0] - n1[1])
    figures = Figures(d1, d2, d3, total, held / total / (kinds + 2))  # the words, the start, and all that training lacks
    first = 0.0
    for d, table in ((figures.d2, words_), (figures.d3, grams)):
        first += float(np.log10(_left(d, *map(np.array, sums(table, "e", 4)))[1]))
    return Model(parts, words_, buckets, figures, first)


def _worked_out(held: dict[int, list[tuple[int, bytes]]], buckets: int, f: Figures) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, values, ranks and kinds of a bucket's n-grams, from its rows. What is met more often has a higher rank: it goes by training's count, then shorter
    n-grams come first; at the end of a text there is only one n-gram of a kind, so those that stand for it come late."""
    out = [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), 0)]
    for _, block in held.get(_WORDS, ()):
        ids, ends, c, s, *n = _unpack(block)
        left = np.log10(_left(f.d2, *n, s)[1])
        ok = ends > 0
        out.append((_key(WORD, ids[ok]), (np.log10(f.word(ends)) - f.unknown + left)[ok], 4 * c[ok] + 2, WORD))
        ok = (s > 0) & (ids != _START)
        out.append((_key(LAST_WORD, ids[ok]), left[ok], s[ok] // 16, LAST_WORD))
    for _, block in held.get(_GRAMS, ()):
        ids, px, py, size, iu, c, u1, u2, u3, *contexts = _unpack(block)
        figures = np.zeros((5, len(ids)), np.int64)
        of = dict(_split(_bucket(ids, buckets)))
        for k, answer in held.get(_ANSWER, ()):
            for row, x in zip(figures, _unpack(answer), strict=True):
                row[of[k]] = x
        ends, s, *n = figures
        p1, (_, left) = f.word(ends)[py], _left(f.d2, *n, s)
        left, pair = left[px], np.repeat(np.arange(len(px)), size)
        before = _before(ids, px, pair, size, c)
        p2 = (before - f.d2[np.minimum(before, 3)]) / s[px] + left * p1
        after = np.log10(_left(f.d3, *contexts)[1])
        v, w = ids[px], ids[py]
        out.append((_key(PAIR, v, w), np.log10(p2) - np.log10(left * p1) + after, 4 * np.bincount(pair, c, len(px)).astype(np.int64) + 1, PAIR))
        ok = contexts[3] > 0
        out.append((_key(LAST_PAIR, v[ok], w[ok]), after[ok], contexts[3][ok] // 16, LAST_PAIR))
        more = (c - f.d3[np.minimum(c, 3)]) / (_left(f.d3, u1, u2, u3, c)[0] * p2[pair])
        out.append((_key(TRIPLE, ids[iu], v[pair], w[pair]), np.log10(1 + more), 4 * c, TRIPLE))
    key, x, rank = (np.concatenate([o[place] for o in out]) for place in range(3))
    return key, x, rank, np.repeat([o[3] for o in out], [len(o[0]) for o in out])


def _places(key: np.ndarray, bucket: np.ndarray | int, longs: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap's long of each key, of those of its bucket, and its three bits there."""
    bit = lambda shift: np.uint64(1) << (key >> np.uint64(shift) & np.uint64(63))
    return bucket * longs + (key >> np.uint64(20) & np.uint64((1 << 24) - 1)).astype(np.int64) % longs, bit(0) | bit(6) | bit(12)


class Filed:
    """For a task: the bitmap of all keys, `longs` a bucket, and the hot ones with their values."""

    def __init__(self, bits: np.ndarray, longs: int, keys: np.ndarray, x: np.ndarray):
        order = np.argsort(keys)
        self.bits, self.longs, self.keys, self.x = bits, longs, keys[order], x[order]

    def known(self, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        at, mask = _places(key, bucket, self.longs)
        return self.bits[at] & mask == mask

    def find(self, key: np.ndarray) -> np.ndarray:
        """Places of the keys among the hot ones, -1 where absent."""
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


def _filed(model: Model) -> Broadcast:
    """The bitmap (BITS longs) and the hot n-grams (HOT at most), broadcast."""
    buckets, figures, longs, room = model.buckets, model.figures, BITS // model.buckets, max(1, HOT // model.buckets)
    schema = pa.schema([("bucket", pa.int32()), ("bits", pa.binary()), ("keys", pa.binary()), ("x", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        key, x, rank, kind = _worked_out(_of_kinds(t), buckets, figures)
        at, mask = _places(key[kind <= TRIPLE], 0, longs)
        bits = np.zeros(longs, np.uint64)
        np.bitwise_or.at(bits, at, mask)
        # Buckets are dealt by hash, so the most frequent of each are about the most frequent of all.
        hot = np.argpartition(-rank, room)[:room] if len(rank) > room else np.arange(len(rank))
        return _rows([(t.column("bucket")[0].as_py(), bits.tobytes(), key[hot].tobytes(), x[hot].tobytes())], schema)

    bits, keys, xs = np.zeros(buckets * longs, np.uint64), [np.zeros(0, np.uint64)], [np.zeros(0)]
    with tidy(model.words.sparkSession):
        found = _by(model.rows(), "bucket", run, "bucket int, bits binary, keys binary, x binary").toArrow()  # a row for each bucket
    for k, own, key, x in zip(*(found.column(place).to_pylist() for place in range(4)), strict=True):
        bits[k * longs : (k + 1) * longs] = np.frombuffer(own, np.uint64)
        keys.append(np.frombuffer(key, np.uint64))
        xs.append(np.frombuffer(x))
    shared = model.words.sparkSession.sparkContext.broadcast(Filed(bits, longs, np.concatenate(keys), np.concatenate(xs)))
    del found, bits, keys, xs, own, key, x
    give_back()
    return shared


def _asked(h: np.ndarray, sizes: np.ndarray, filed: Filed, buckets: int, share: int) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """Of documents given as word hashes, for the n-grams of one share of the buckets: each one's sum over those that are hot; and packed for each bucket
    the distinct others that may be in the model, with the number of documents that hold it, these, and the times, 2 * n and for -n 2 * n - 1."""
    whole, at = _padded(h, sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    u, v, w = whole[at - 2], whole[at - 1], h
    last = np.zeros(len(at), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    found = []

    def look(base: np.ndarray, bucket: np.ndarray, who: np.ndarray, key: np.ndarray, times: int) -> np.ndarray:
        """File the n-grams under `key` whose key `base` is known; which these are."""
        ok = np.nonzero(filed.known(base, bucket))[0]
        found.append((key[ok], bucket[ok], who[ok], np.full(len(ok), times)))
        return ok

    def at_end(kind: int, ok: np.ndarray, bucket: np.ndarray, who: np.ndarray, *grams: np.ndarray) -> None:
        key = _key(kind, *(g[ok] for g in grams))
        found.append((key, bucket[ok], who[ok], np.full(len(ok), -1)))

    bucket = _bucket(w, buckets)
    mine = np.nonzero(bucket % SLICES == share)[0]
    x, b, who, end = w[mine], bucket[mine], of[mine], last[mine]
    ok = look(key := _key(WORD, x), b, who, key, 1)
    at_end(LAST_WORD, ok[end[ok]], b, who, x)
    pairs = _key(PAIR, v, w)
    bucket = _bucket(pairs, buckets)
    mine = np.nonzero(bucket % SLICES == share)[0]
    key, b, who, end = pairs[mine], bucket[mine], of[mine], last[mine]
    ok = look(key, b, who, key, 1)
    at_end(LAST_PAIR, ok[end[ok]], b, who, v[mine], w[mine])
    mine, b, who = mine[ok], b[ok], who[ok]  # no trigram without its pair
    look(key := _key(TRIPLE, u[mine], v[mine], w[mine]), b, who, key, 1)

    key, b, who, n = (np.concatenate(x) for x in zip(*found, strict=True))
    place = filed.find(key)
    hot = place >= 0
    own = np.bincount(who[hot], filed.x[place[hot]] * n[hot], len(sizes))
    key, b, who, n = key[~hot], b[~hot], who[~hot], n[~hot]
    rows = []
    order = np.lexsort((who, key, b))
    key, b, who, n = key[order], b[order], who[order], n[order]
    if len(key):
        other = np.diff(key, prepend=key[0]) != 0
        other[0] = True
        starts = np.nonzero(other | (np.diff(who, prepend=-1) != 0))[0]
        n, key, b, who, other = np.add.reduceat(n, starts), key[starts], b[starts], who[starts], other[starts]
        for k, at in _split(b):
            first = np.nonzero(other[at])[0]
            rows.append((k, _pack(key[at][first], np.diff(first, append=len(at)), who[at], np.where(n[at] < 0, -2 * n[at] - 1, 2 * n[at]))))
    return own, rows


def _share_of(docs: DataFrame, model: Model, shared: Broadcast, share: int, passed: tuple[str, ...]) -> DataFrame:
    """Written down, for each row of docs: the columns `passed`, `__ta` and `__tb` that name its text, `__words`, and `__part`, the sum over the n-grams
    of one share of the buckets."""
    buckets, figures, start = model.buckets, model.figures, model.start
    kinds = dict(docs.select(*passed, "text").dtypes)
    schema = ", ".join([*(f"{p} {kinds[p]}" for p in passed), "__ta long, __tb long, __words long, __part double"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed, blocks, part = shared.value, 0, TaskContext.get().partitionId() << 32
        for whole in batches:
            h, sizes, texts = _hashed(whole.column(len(passed)))
            ends, at = np.cumsum(sizes), 0
            while at < whole.num_rows:
                before = int(ends[at] - sizes[at])
                upto = max(at + 1, int(np.searchsorted(ends, before + _AT_ONCE, "right")))
                n = sizes[at:upto]
                own, asked = _asked(h[before : int(ends[upto - 1])], n, filed, buckets, share)
                # Texts without words need no name that others share.
                names = [xxhash.xxh3_128_intdigest(texts[k]) if sizes[k] else (part + blocks << 64) + k for k in range(at, upto)]
                if not share:
                    own = own + figures.unknown * n + np.where(n > 0, start, 0.0)
                ta, tb = (np.array([name >> shift & (1 << 64) - 1 for name in names], np.uint64).view(np.int64) for shift in (64, 0))
                columns = [whole.column(p).slice(at, upto - at) for p in range(len(passed))] + [pa.array(x) for x in (ta, tb, n, own)]
                head, sink = pa.RecordBatch.from_arrays(columns, names=[*passed, "__ta", "__tb", "__words", "__part"]), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, head.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                    file.write_batch(head)
                some = share + SLICES * (hash(part + blocks) % ((buckets - share + SLICES - 1) // SLICES))
                rows = [(some, _HEADER, part + blocks, sink.getvalue().to_pybytes())] + [(k, _ASKED, part + blocks, block) for k, block in asked]
                yield from _rows(rows, _BLOCKS).to_batches()
                blocks += 1
                at = upto

    def answer(t: pa.Table) -> pa.Table:
        """To each block of documents their sums over the bucket's n-grams; its header goes through."""
        held = _of_kinds(t)
        rows = [(0, _HEADER, at, block.to_pybytes()) for at, block in held.get(_HEADER, ())]
        if held.get(_ASKED):
            key, x, *_ = _worked_out(held, buckets, figures)
            order = np.argsort(key)
            key, x = np.append(key[order], np.uint64(2**64 - 1)), np.append(x[order], 0.0)
            for at, block in held[_ASKED]:
                asked, n, who, times = _unpack(block)
                place = np.searchsorted(key, asked)
                value = np.repeat(np.where(key[place] == asked, x[place], 0.0), n)
                sums = np.bincount(who, value * np.where(times % 2, -(times + 1) // 2, times // 2))
                docs_ = np.nonzero(sums)[0]
                rows.append((0, _ASKED, at, _pack(docs_, sums[docs_])))
        return _rows(rows, _BLOCKS)

    def add(t: pa.Table) -> pa.Table:
        held = _of_kinds(t)
        head = pa.ipc.open_stream(held[_HEADER][0][1]).read_all()
        part = head.column("__part").to_numpy().copy()
        for _, block in held.get(_ASKED, ()):
            docs_, sums = _unpack(block)
            part[docs_] += sums
        return head.set_column(head.num_columns - 1, "__part", pa.array(part))

    asked = map_arrow(docs.select(*passed, "text"), ask, _ROWS)
    return materialize(_by(_by(asked.unionByName(model.rows(share)), "bucket", answer, _ROWS), "at", add, schema), "sums")


def score(docs: DataFrame, model: Model, passed: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Written down: the columns `passed` (longs or strings, none changed) for each row of docs, with `__words` and `__log10p`, the sum of the words' log10 probabilities."""
    shared = _filed(model)
    first, *others = [_share_of(docs, model, shared, k, () if k else passed) for k in range(SLICES)]
    # Rows of one text have one sum in each share.
    every = None
    for k, other in enumerate(others):
        one = other.filter("__words > 0").groupBy("__ta", "__tb").agg(F.max("__part").alias("more")).withColumn("share", F.lit(k))
        every = one if every is None else every.unionByName(one)
    out = first.withColumn("__log10p", F.col("__part"))
    if every is not None:
        every = every.groupBy("__ta", "__tb").agg(F.sum("more").alias("__more"))
        out = first.join(every, ["__ta", "__tb"], "left").withColumn("__log10p", F.col("__part") + F.coalesce("__more", F.lit(0.0)))
    scored = materialize(out.select(*passed, "__words", "__log10p"), "scored")
    shared.destroy()  # the driver's copy too
    forget(first, *others)
    return scored


def limits(scored: DataFrame, labels: DataFrame, quantile: float = 0.995, prior: float = 20.0, least_docs: int = 30) -> DataFrame:
    """(of, mean, most): for each language of `scored`, and from the trusted half that does not train, the two figures."""
    held = scored.filter("__words > 0").join(_trusted(labels).filter("not trains").select("doc_id"), "doc_id", "left_semi")
    held = held.select("lang", "__words", "__log10p")
    mean = -F.sum("__log10p") / F.sum("__words")
    means = held.groupBy("lang").agg(mean.alias("own_mean"), F.count(F.lit(1)).alias("n"))
    every = held.agg(mean.alias("all_mean"))
    # A row for each language; no list of them comes to the driver.
    means = scored.select(F.col("lang").alias("of")).distinct().join(means, F.col("of").eqNullSafe(F.col("lang")), "left").crossJoin(F.broadcast(every))
    means = means.withColumn("own", F.coalesce(F.col("n") >= least_docs, F.lit(False)))
    means = materialize(means.select("of", "own", F.when(F.col("own"), F.col("own_mean")).otherwise(F.col("all_mean")).alias("mean")), "means")
    drawn = held.join(_few(means), F.col("lang").eqNullSafe(F.col("of"))).withColumn("s", (-F.col("__log10p") + prior * F.col("mean")) / (F.col("__words") + prior))
    by_lang = drawn.groupBy("lang").agg(F.percentile_approx("s", quantile, 10_000).alias("own_most"))
    all_most = drawn.agg(F.percentile_approx("s", quantile, 10_000).alias("all_most"))
    out = means.join(by_lang, F.col("of").eqNullSafe(F.col("lang")), "left").crossJoin(F.broadcast(all_most))
    bounds = materialize(out.select(F.col("of"), "mean", F.when(F.col("own"), F.col("own_most")).otherwise(F.col("all_most")).alias("most")), "bounds")
    forget(means)
    return bounds


def _few(by_language: DataFrame) -> DataFrame:
    """A table of a row for each language, broadcast where these are few, so that no language is a hot key."""
    return F.broadcast(by_language) if by_language.count() <= FEW else by_language


def judge(scored: DataFrame, bounds: DataFrame, prior: float = 20.0) -> DataFrame:
    """scored with `__score`, `__most` and `__kept`."""
    bounds = _few(bounds).select(*[F.col(c).alias(f"__{c}") for c in ("of", "mean", "most")])
    j = scored.join(bounds, F.col("lang").eqNullSafe(F.col("__of")), "left")
    s = (-F.col("__log10p") + prior * F.col("__mean")) / (F.col("__words") + prior)
    j = j.withColumn("__score", s)
    return j.withColumn("__kept", F.coalesce(F.col("__score") <= F.col("__most"), F.lit(True)) | (F.col("__words") == 0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns."""
    model = train(docs, labels)
    if model is None:
        return docs
    # Rows of equal id, language and text have one score and one fate, so a hash of these names what goes.
    shape = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in ("doc_id", "lang", "text")])
    named = lambda seed: F.xxhash64(F.lit(seed), shape, "doc_id", "lang", "text")
    slim = docs.select("doc_id", "lang", "text", named(1).alias("__a"), named(2).alias("__b"))
    scored = score(slim, model, ("doc_id", "lang", "__a", "__b"))
    bounds = limits(scored, labels)
    gone = materialize(judge(scored, bounds).filter("not __kept").select("__a", "__b").distinct(), "gone")
    model.forget()
    forget(scored, bounds)
    a, b = unused("__a", docs.columns), unused("__b", docs.columns)
    goes = may_hold(bitmap(gone, "__a"), named(1))
    # Texts that the bitmap clears stay where they are; only the others meet the list.
    doubtful = docs.filter(goes).withColumn(a, named(1)).withColumn(b, named(2)).join(gone.select(F.col("__a").alias(a), F.col("__b").alias(b)), [a, b], "left_anti")
    return docs.filter(~goes).unionByName(doubtful.select(*quoted(docs.columns)))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "lang", "text")
    model = train(docs, labels)
    if model is None:
        return docs.select("doc_id", "lang", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("double").alias("log10_perplexity"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    scored = score(docs, model)
    model.forget()
    j = judge(scored, limits(scored, labels))
    plain = F.when(F.col("__words") > 0, -F.col("__log10p") / F.col("__words"))
    return j.select("doc_id", "lang", F.col("__words").alias("n_words"), plain.alias("log10_perplexity"), F.col("__score").alias("score"), F.col("__most").alias("threshold"), F.col("__kept").alias("kept"))
