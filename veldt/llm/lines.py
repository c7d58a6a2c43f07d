"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct words, as 64-bit hashes. They stand by rarity: their number of occurrences in the whole table, counted for
each of BUCKETS hash buckets and rounded to a quarter of a power of two (a table of fixed size), then their hash. Any fixed order makes the
filters exact; rarity makes them sharp. Lines of n tokens that reach a Jaccard similarity of p percent share one of their
n - ceil(p * n / 100) + 1 rarest tokens (prefix filter), differ in size by no more than p percent (length filter), and have
room for the tokens they must share before and after the places of the shared one (positional filter). A parity sketch of the tokens,
64 bits or for longer lines 128, rules out pairs whose sketches differ in more bits than a linked pair's tokens can. Similarity is
verified on the full sets. Of each component of links the first line, by document and line number, stays; later ones are removed.

The texts are read four times: for the classes of lines (lines of equal sets, named by a 128-bit hash, are one class from the start), for the
counts, for the prefix rows, and, of the lines that a pair names, for their sets. The prefix rows are shuffled by token, once, and never
written down; the pairs of a token that pass the filters are not either. What is kept of them is a row for each member: the smallest and the
largest of its partners. These edges are verified and joined to components. Only members that had several partners are then compared once
more, and of these only pairs of different components are verified: in a group of near copies the edges have left none.

Skew: a line that is repeated sends its prefix rows from its first place; what a filter of fixed size lets through besides is dropped once it
is shuffled. A token that may have more than MOST rows is cut into parts, PARTS at most, of which each and each two are compared apart.

Defined cases: lines without words, or of fewer than `least_words`, are never removed and take no part; null texts have no
lines and stay null; rows with null ids stay as they are; rows that share an id are versions of one document, of which lines of one number
don't remove each other; other columns pass through whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import bitmap, forget, materialize, may_hold, quoted, unused
from veldt.llm.graph import components

BUCKETS, LEAST_WORDS, PERCENT = 1 << 20, 1, 80
#: Tokens from which a line's sketch has 128 bits; rows of a token from which it is cut into parts, and the most parts.
LONG, MOST, PARTS = 48, 20_000, 32
_BLANK, _OTHERS = " ", "\t\x0b\x0c\r"


def _once(value: Column) -> Column:
    """A generator of the value alone: what is above it can't make the value be worked out more than once."""
    return F.explode(F.array(value))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").filter("doc_id is not null and text is not null")


def _blanked() -> Column:
    """The text with blanks for all white space but line ends. Most texts have no other, and finding that out is cheap."""
    other = F.contains("text", F.lit(_OTHERS[0]))
    for c in _OTHERS[1:]:
        other = other | F.contains("text", F.lit(c))
    return F.when(other, F.translate("text", _OTHERS, _BLANK * len(_OTHERS))).otherwise(F.col("text"))


def _lines(docs: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, number, tokens, a, b): the lines with words; their tokens, sorted by hash, and the two halves of their class's name."""
    d = docs.select("doc_id", F.posexplode(F.split(_blanked(), "\n")).alias("number", "line"))
    tokens = F.array_remove(F.transform(F.split("line", _BLANK), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))
    if least_words > 1:
        d = d.select("doc_id", "number", _once(tokens).alias("tokens")).filter(F.size("tokens") >= least_words)
        tokens = F.col("tokens")
    d = d.select("doc_id", "number", _once(F.sort_array(F.array_distinct(tokens))).alias("tokens")).filter(F.size("tokens") > 0)
    return d.withColumns({"a": F.xxhash64(F.lit(17), "tokens"), "b": F.xxhash64(F.lit(29), "tokens")})


def _levels(docs: DataFrame) -> DataFrame:
    """Written down, one row: array `levels` of BUCKETS bytes, larger for buckets whose words occur more often: four levels to each doubling."""
    words = docs.select(F.explode(F.split(_blanked(), "[ \n]")).alias("word")).filter("word != ''")
    counted = words.groupBy(_bucket(F.xxhash64("word")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select("at", F.least(F.floor(F.log2("n") * 4), F.lit(127)).cast("byte").alias("level"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("at")).join(counted, "at", "left")
    in_order = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    some = every.select("at", F.coalesce("level", F.lit(0).cast("byte")).alias("level")).groupBy(F.shiftright("at", 10).alias("some")).agg(in_order("at", "level").alias("levels"))
    return materialize(some.agg(F.flatten(in_order("some", "levels")).alias("levels")), "levels")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(BUCKETS - 1).cast("int")


def _level_of(n: int) -> int:
    return int(math.log2(n) * 4)


def _sketch(high: Column | None) -> Column:
    """64 parities of the tokens, or of those whose bit 30 is as told."""
    bit = lambda h: F.lit(1).cast("long") if high is None else F.shiftrightunsigned(h, 30).bitwiseAND(1).bitwiseXOR(high)
    return F.aggregate("tokens", F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(F.call_function("shiftleft", bit(h), F.shiftrightunsigned(h, 24).bitwiseAND(63).cast("int"))))


def _prefixes(docs: DataFrame, classes: DataFrame, levels: DataFrame, least_words: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(key, a, place, s, t), the prefix rows, and the tables they need. key: token and block, the number of the token's parts less 1 and
    whether the block is of one part; a: the line's class; place: n and the token's position; s, t: its sketch."""
    again = bitmap(classes.filter("n > 1"), "a")
    # Of every class that the bitmap takes for a repeated one, though it may not be: no line may go unsent.
    firsts = bitmap(classes.filter(may_hold(again, F.col("a"))).select(F.xxhash64("first.doc_id", "first.number").alias("place")), "place")
    n = F.size("tokens")
    # No prefix where only equal sets link.
    size = n - F.expr(f"cast((size(tokens) * {percent}L + 99) div 100 as int)") + 1
    lines = _lines(docs, least_words).filter(100 * n >= percent * (n + 1))
    lines = lines.filter(~may_hold(again, F.col("a")) | may_hold(firsts, F.xxhash64("doc_id", "number")))
    long = lambda kind: F.lit(kind).cast("long")
    # The optimizer puts the scalar into the lambda, where a query may not have it.
    lines = lines.select("a", "tokens", levels.scalar().alias("levels"))
    order = F.sort_array(F.transform("tokens", lambda h: F.call_function("shiftleft", F.coalesce(F.get("levels", _bucket(h)).cast("long"), long(0)), F.lit(56)).bitwiseOR(F.shiftrightunsigned(h, 8))))
    s = F.when(n < LONG, _sketch(None)).otherwise(_sketch(long(1)))
    t = F.when(n < LONG, long(0)).otherwise(_sketch(long(0)))
    lines = lines.select("a", n.cast("long").alias("n"), s.alias("s"), t.alias("t"), F.slice(order, F.lit(1), size).alias("prefix"))
    rows = lines.select("a", "n", "s", "t", F.posexplode("prefix").alias("pos", "token"))
    level = F.shiftrightunsigned("token", 56)
    parts = F.when(level < _level_of(MOST), 1).otherwise(F.least(F.lit(PARTS), F.ceil(F.pow(F.lit(2.0), (level + 1) / 4) * 2 / MOST)).cast("int"))
    rows = rows.withColumn("parts", parts).withColumn("part", _part("a", "parts"))
    rows = rows.withColumn("with", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    block = F.xxhash64("token", F.least("part", "with"), F.greatest("part", "with")).bitwiseAND(-2 * PARTS)
    key = block.bitwiseOR(2 * (F.col("parts") - 1).cast("long")).bitwiseOR((F.col("part") == F.col("with")).cast("long"))
    rows = rows.select(key.alias("key"), "a", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("place"), "s", "t")
    return rows, [again, firsts]


def _part(of: str, parts: Column | str) -> Column:
    return F.pmod(F.shiftrightunsigned(of, 8), F.col(parts) if isinstance(parts, str) else parts).cast("int")


def _may(percent: int) -> Column:
    """Whether rows x and y of one key may be of lines that link."""
    n, m, p, q = "(x.place >> 32)", "(y.place >> 32)", "(x.place & 4294967295)", "(y.place & 4294967295)"
    least = f"((({n} + {m}) * {percent} + {99 + percent}) div {100 + percent})"  # tokens that a linked pair shares
    spare = f"({n} + {m} - 2 * {least})"
    parts = f"((x.key >> 1 & {PARTS - 1}) + 1)"
    tests = [
        "x.a != y.a",
        f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})",
        f"bit_count(x.s ^ x.t ^ y.s ^ y.t) <= {spare}",
        f"(least({n}, {m}) < {LONG} or bit_count(x.s ^ y.s) + bit_count(x.t ^ y.t) <= {spare})",
        f"least({p}, {q}) + least({n} - {p}, {m} - {q}) >= {least}",
        # Pairs of one part are compared in its own block.
        f"(x.key & 1 = 1 or pmod(shiftrightunsigned(x.a, 8), {parts}) != pmod(shiftrightunsigned(y.a, 8), {parts}))",
    ]
    return F.expr(" and ".join(tests))


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """(key, a, place, s, t, low, high): the rows that may link with others of their key; the smallest and the largest class of those."""
    rows = rows.repartition("key").distinct()  # a class sends some rows more than once
    x, y = rows.alias("x"), rows.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & _may(percent))
    return pairs.groupBy("x.key", "x.a", "x.place", "x.s", "x.t").agg(F.min("y.a").alias("low"), F.max("y.a").alias("high"))


def _sets(docs: DataFrame, classes: DataFrame, named: DataFrame, least_words: int) -> DataFrame:
    """Written down: (id, a, tokens) of the classes whose `a` is named: their smallest id and their tokens, anew from the texts."""
    names = bitmap(named, "a")
    wanted = classes.filter(may_hold(names, F.col("a"))).join(named, "a", "left_semi").select("a", "b", "id", F.col("first.doc_id").alias("doc_id"))
    wanted = materialize(wanted, "wanted")
    of_docs = bitmap(wanted, "doc_id")
    made = _lines(docs.filter(may_hold(of_docs, F.col("doc_id"))), least_words).filter(may_hold(names, F.col("a"))).select("a", "b", "tokens")
    sets = made.join(wanted.select("a", "b", "id"), ["a", "b"]).groupBy("id").agg(F.first("a").alias("a"), F.first("tokens").alias("tokens"))
    sets = materialize(sets, "sets")
    forget(wanted, of_docs, names)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): ids of the classes that link, of pairs of classes' `a`."""
    of = lambda x: sets.select(F.col("a").alias(x), F.col("id").alias(f"id_{x}"), F.col("tokens").alias(f"set_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").filter("id_a != id_b")
    both = both.select("id_a", "id_b", (F.size("set_a") + F.size("set_b")).alias("n"), _once(F.size(F.array_intersect("set_a", "set_b"))).alias("common"))
    return both.filter(F.col("common") * 100 >= percent * (F.col("n") - F.col("common"))).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _links(docs: DataFrame, classes: DataFrame, levels: DataFrame, percent: int, least_words: int) -> DataFrame:
    """(id, component): the classes, by their smallest lines' ids, that link, directly or not, to one with a smaller id."""
    rows, needed = _prefixes(docs, classes, levels, least_words, percent)
    found = materialize(_compare(rows, percent), "found")
    forget(*needed)
    edges = found.select("a", F.explode(F.array("low", "high")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialize(edges.distinct(), "edges")
    sets = _sets(docs, classes, edges.select("a").union(edges.select("b")).distinct(), least_words)
    reached = components(_verified(edges, sets, percent))

    # Of members with more partners than these edges, those whose key holds several components still.
    groups = found.filter("low != high").select("key", "a", "place", "s", "t").join(sets.select("a", "id"), "a")
    groups = materialize(groups.join(reached, "id", "left").withColumn("component", F.coalesce("component", "id")), "groups")
    still = groups.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
    families = materialize(groups.join(still, "key", "left_semi"), "families")
    forget(found, groups)
    if not families.isEmpty():
        x, y = families.alias("x"), families.alias("y")
        rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & _may(percent))
        rest = materialize(rest.select(F.col("x.a").alias("a"), F.col("y.a").alias("b")).distinct(), "rest")
        links = reached.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(_verified(rest, sets, percent))
        before, reached = reached, components(links)
        forget(before, rest)
    forget(edges, sets, families)
    return reached


def removed_lines(docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, gone): for each document that loses lines their numbers, from 0."""
    docs = _named(docs)
    least_words = max(1, least_words)
    lines = materialize(_lines(docs, least_words).select("doc_id", F.monotonically_increasing_id().alias("id"), "number", "a", "b"), "lines")
    levels = _levels(docs)
    classes = lines.groupBy("a", "b").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "classes")
    reached = _links(docs, classes, levels, percent, least_words)

    # Few classes link; the others need no join to learn that they are their own component.
    linked = materialize(reached.union(reached.select("component", "component")).distinct(), "linked")
    bits = bitmap(linked, "id")
    may = may_hold(bits, F.col("id"))
    near = classes.filter(may).join(linked, "id")
    first = near.groupBy("component").agg(F.min("first").alias("stays"))
    near = near.join(first, "component").filter((F.col("n") > 1) | (F.col("first") != F.col("stays"))).select("a", "b", "stays")
    alone = classes.filter("n > 1")
    alone = alone.filter(~may).unionByName(alone.filter(may).join(linked, "id", "left_anti").select(*alone.columns))
    loses = materialize(near.unionByName(alone.select("a", "b", F.col("first").alias("stays"))), "loses")
    names = bitmap(loses, "a")
    gone = lines.filter(may_hold(names, F.col("a"))).join(loses, ["a", "b"]).filter((F.col("stays.doc_id") != F.col("doc_id")) | (F.col("stays.number") != F.col("number")))
    gone = materialize(gone.groupBy("doc_id").agg(F.collect_set("number").alias("gone")), "gone")
    forget(lines, levels, classes, reached, linked, bits, loses, names)
    return gone


def dedup_lines(docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, count: str = "__gone") -> DataFrame:
    """docs with later matches of lines removed from `text`, and a column `count` (a name that docs lacks), the number of lines removed."""
    gone = removed_lines(docs.select("doc_id", "text"), percent, least_words)
    numbers, id_ = unused("__lines", docs.columns), unused("__id", docs.columns)
    hit = F.coalesce(may_hold(bitmap(gone, "doc_id"), F.col("doc_id")), F.lit(False))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(numbers, i)), "\n")
    changed = docs.filter(hit).join(gone.select(F.col("doc_id").alias(id_), F.col("gone").alias(numbers)), F.col("doc_id") == F.col(id_), "left")
    text = F.when(F.col(numbers).isNull(), F.col("text")).otherwise(kept)
    columns = [text.alias(c) if c == "text" else q for c, q in zip(docs.columns, quoted(docs.columns), strict=True)]
    changed = changed.select(*columns, F.when(F.col(numbers).isNull(), 0).otherwise(F.size(numbers)).cast("long").alias(count))
    return docs.filter(~hit).select(*quoted(docs.columns), F.lit(0).cast("long").alias(count)).unionByName(changed)


def query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", F.col("__gone").alias("n_removed"), "text")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
t AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS id, doc_id, line_no, list_distinct(w) AS w
      FROM (SELECT *, regexp_extract_all(line, '[^ \t\x0B\x0C\r]+') AS w FROM d) WHERE len(w) >= 1),
x AS (SELECT id, len(w) AS n, unnest(w) AS token FROM t),
f AS (SELECT token, count(*) AS df FROM x GROUP BY token),
p AS (SELECT id, n, token FROM (SELECT id, n, token, row_number() OVER (PARTITION BY id ORDER BY df, token) AS place FROM x JOIN f USING (token)) WHERE place <= n - ceil(n * 0.8 - 1e-9) + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.token = b.token AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM (SELECT a, b, len(list_intersect(y.w, z.w)) AS common, len(y.w) + len(z.w) AS both_n FROM c JOIN t y ON y.id = a JOIN t z ON z.id = b) WHERE 100 * common >= 80 * (both_n - common)),
low AS (SELECT b AS id, min(a) AS low FROM l GROUP BY b),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS id, b AS node FROM g UNION SELECT r.id, g.b FROM reach r JOIN g ON r.node = g.a),
m AS (SELECT id, min(node) AS low FROM reach GROUP BY id),
gone AS (SELECT t.doc_id, t.line_no FROM m JOIN t USING (id) JOIN t y ON y.id = m.low WHERE m.low < m.id AND (y.doc_id, y.line_no) <> (t.doc_id, t.line_no)),
k AS (SELECT d.doc_id, count(gone.line_no) AS n_removed, string_agg(line, chr(10) ORDER BY d.line_no) FILTER (gone.line_no IS NULL) AS text FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.line_no = d.line_no GROUP BY d.doc_id)
SELECT documents.doc_id, coalesce(n_removed, 0) AS n_removed, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text FROM documents LEFT JOIN k ON documents.doc_id = k.doc_id
"""
