"""SentencePiece encoding and decoding (byte-pair models), exact by backtracking.

A text becomes `▁`-marked characters. No piece holds `▁` after another character and none holds a line break, so texts
are cut there and each chunk is encoded by itself: an Aho-Corasick pass over the chunk lists the pieces that start at
each place; the longest one whose junction with the piece before is stable is taken. A junction is stable if merging the
two pieces' characters anew gives the same two pieces; what that says is kept for each pair. If no piece fits, the
place is marked in a bitfield of failed positions and the last piece is taken back for its next shorter one.
Characters outside the vocabulary become byte pieces; they can merge with nothing, so chunks are cut at them too.
Results of short chunks are kept in a bounded cache.

Defined cases: a null text is an empty one and gives the end id only; rows keep their other columns, whatever their
names, and repeated rows are encoded each for itself; empty tables give empty results. U+2581 in a text is read as a
space, as the library does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm.common import held, map_arrow

SPACE = "▁"


class Cache(dict):
    """Results by key; those of long keys aren't kept. When full, the latest eighth goes, for what is frequent comes early."""

    def __init__(self, make, limit: int, longest: int | None = None):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.limit:
            kept = dict(islice(self.items(), self.limit * 7 // 8))
            self.clear()
            self.update(kept)
        self[key] = out = self.make(key)
        return out


class Codec:
    """Encoder and decoder of one byte-pair model with an identity normaliser, a dummy prefix and byte fallback."""

    def __init__(self, path: str, cached_chunks: int = 700_000, cached_pairs: int = 200_000, longest_cached: int = 40):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.end = sp.eos_id()
        self.bytes_ = {i: bytes([int(p[3:5], 16)]) for i, p in enumerate(self.names) if sp.is_byte(i)}
        self.byte_ids = {b[0]: i for i, b in self.bytes_.items()}
        self.silent = {i for i in range(len(self.names)) if sp.is_control(i)}
        normal = [i for i in range(len(self.names)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in normal}
        self.rank = {self.names[i]: -sp.get_score(i) for i in normal}
        runs = [p for p in self.ids if len(p) > 1 and not p.strip(SPACE)]
        others = [r for p, r in self.rank.items() if len(p) > 1 and p.strip(SPACE)]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids) or (runs and min(self.rank[p] for p in runs) <= max(others)) or any(len(p.lstrip(SPACE)) and p.startswith(SPACE * 2) for p in self.ids):
            raise ValueError("only models whose pieces hold spaces in front, once, and whose space runs merge last are supported")
        self.longest_run = max(map(len, runs), default=1)
        if self._merge(SPACE * self.longest_run * 2) != [SPACE * self.longest_run] * 2:
            raise ValueError("only models whose space runs merge to the longest from the left are supported")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if p not in runs:
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        chars = "".join(re.escape(p) for p in self.ids if len(p) == 1)
        self.known = re.compile(f"[{chars}]+|[^{chars}]+")
        self.cut = re.compile("\n+| *[^ \n]+| +").findall
        self.stable = Cache(self._stable, cached_pairs)
        self.alone = Cache(lambda p: self._merge(p) == [p], cached_pairs)
        self.chunks = Cache(self._chunk, cached_chunks, longest_cached)
        #: Chunks that decode to something else; of valid text there are none.
        self.odd: dict[str, str] = {}

    def _merge(self, text: str) -> list[str]:
        """Plain merging: the best-ranked neighbouring pair first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = min((rank.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1))
            if best == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stable(self, pair: tuple[str, str]) -> bool:
        return self._merge(pair[0] + pair[1]) == [*pair]

    def _backtrack(self, text: str) -> list[str]:
        """The pieces of a run of known characters without space runs."""
        n = len(text)
        starts: list[list[int]] = [[] for _ in range(n)]
        for last, size in self.automaton.iter(text):
            starts[last - size + 1].append(size)  # shorter ones come first
        failed = bytearray(n // 8 + 1)
        taken: list[str] = []
        tried: list[int] = []  # for each piece taken and the one to come, how many of its start's sizes are left
        stable, alone = self.stable, self.alone
        at, left = 0, len(starts[0])
        while at < n:
            while left:
                left -= 1
                end = at + starts[at][left]
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                piece = text[at:end]
                if stable[taken[-1], piece] if taken else alone[piece]:
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(taken.pop())
                left = tried.pop()
                continue
            taken.append(piece)
            tried.append(left)
            at = end
            left = len(starts[at]) if at < n else 0
        return taken

    def _run(self, n: int) -> list[int]:
        """n spaces that nothing follows or joins: whole runs from the left, as equal ranks merge leftmost first."""
        whole, rest = divmod(n, self.longest_run)
        return [self.ids[SPACE * self.longest_run]] * whole + [self.ids[p] for p in self._merge(SPACE * rest)]

    def _ids(self, chunk: str) -> list[int]:
        spaces = len(chunk) - len(chunk.lstrip(SPACE))
        if spaces == len(chunk):
            return self._run(spaces)
        body = chunk[max(0, spaces - 1) :]
        out: list[int] = []
        for part in self.known.findall(body):
            if part[0] in self.ids:
                out += [self.ids[p] for p in self._backtrack(part)]
            else:
                out += [self.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]
        if spaces > 1:  # a lone space piece in front joins the run before it
            alone = out[0] == self.ids[SPACE]
            out = self._run(spaces - 1 + alone) + out[alone:]
        return out

    def _surface(self, ids: list[int]) -> str:
        raw = b"".join(self.bytes_[i] if i in self.bytes_ else b"" if i in self.silent else self.names[i].replace(SPACE, " ").encode() for i in ids)
        return raw.decode("utf-8", "replace")

    def _chunk(self, chunk: str) -> str:
        ids = self._ids(chunk.replace(" ", SPACE))
        surface = self._surface(ids)
        if surface != chunk:
            self.odd[chunk] = surface
        return " ".join(map(str, ids))

    def written(self, text: str | None) -> tuple[int, str, str]:
        """The number of ids without the end, the ids in decimal, joined by one space, and what they decode to."""
        if not text:
            return 0, "", ""
        if len(self.odd) > 10_000:
            self.odd.clear()
            self.chunks.clear()
        text = text.replace(SPACE, " ")
        chunks = self.cut(" " + text)
        ids = " ".join(map(self.chunks.__getitem__, chunks))
        if self.odd and not self.odd.keys().isdisjoint(chunks):
            text = "".join(self.odd.get(c, c) for c in chunks)[1:]  # every text that is not empty begins with the dummy prefix
        return ids.count(" ") + 1, ids, text

    def encode(self, text: str | None) -> list[int]:
        return [*map(int, self.written(text)[1].split()), self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces are silent, the space of the dummy prefix goes."""
        text = self._surface(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.names[first].startswith(SPACE) else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec, with its caches, for each Python worker, as long as no other operator runs there."""
    held[__name__] = _codecs.clear
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_table(docs: DataFrame, model: str | None = None, text_col: str = "text", rows: int = 200) -> DataFrame:
    """docs with `n_tokens` (long), `ids` (decimal, joined by one space) and `decoded` in place of columns of these names.

    model: path of the model file on every executor; by default the public 32k byte-pair model.
    """
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    made = {"n_tokens": T.LongType(), "ids": T.StringType(), "decoded": T.StringType()}
    kept = [f for f in docs.schema.fields if f.name.lower() not in made]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        end = str(c.end)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                n, ids, decoded = [], [], []
                for text in b.column(text_col):
                    count, written, surface = c.written(text.as_py())
                    n.append(count + 1)
                    ids.append(f"{written} {end}" if written else end)
                    decoded.append(surface)
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[*names, *made])

    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in made.items())])
    return map_arrow(docs, run, schema)


def query(docs: DataFrame) -> DataFrame:
    t = encode_table(docs.select("doc_id", "text"))
    return t.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
