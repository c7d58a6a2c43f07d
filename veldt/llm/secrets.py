"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base patterns (`assign`, `access`, `hex`) and one broad pattern (`token`: 20 or more of `[A-Za-z0-9+/_-]` with a digit,
a lower-case and an upper-case letter) give candidates, leftmost and non-overlapping for each kind. Every candidate's
value is hashed; for each hash the corpus-wide numbers of distinct repositories and distinct owners are counted.
A value found with one owner only looks live, a value of several owners is a copied example. Base spans always stay,
with the verdict beside them; a broad candidate adds its span only where it is owner-specific.

Positions: `split` and `regexp_extract_all` by the same pattern give the pieces and the matches in turn, and the running
sum of their code-point lengths, in a window over the matches of one row and kind, gives the offsets.

Counting is by (hash, owner, repository), then (hash, owner), then hash, each with map-side combination, so an example
that stands in a third of all documents is combined before it is shuffled.

Defined cases: null and empty texts have no spans; a null owner counts as one owner of its own; rows with repeated or
null ids are scanned each for itself; an empty table gives an empty result. Spans of different kinds may overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import materialize


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: kind -> pattern; the order is the order of kinds. Greedy runs of at least n are what runs that fail below n leave.
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "token": "[A-Za-z0-9+/_-]{20,}"}
BASE = ("assign", "access", "hex")
LEAST_ASSIGNED = 6


def _cut(text: Column, kind: str) -> Column:
    """array<struct<kind, pos, gap, hit>>: the text between matches and each match, where there are any."""
    pattern = F.lit(PATTERNS[kind])
    gaps = F.split(text, PATTERNS[kind], -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.transform(hits, lambda h, i: F.struct(F.lit([*PATTERNS].index(kind)).alias("kind"), i.alias("pos"), F.char_length(F.get(gaps, i)).cast("long").alias("gap"), h.alias("hit")))
    none = F.array().cast("array<struct<kind:int,pos:int,gap:bigint,hit:string>>")
    return F.when(F.regexp_like(text, pattern), pieces).otherwise(none)


def candidates(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """A row for each candidate (row_id, repo, owner, kind, start, end, value), and one with null kind for each row without any."""
    d = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(repo_col).alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cut = F.concat(*[_cut(F.col("text"), k) for k in PATTERNS])
    d = d.select("row_id", "repo", "owner", F.explode_outer(cut).alias("c")).select("row_id", "repo", "owner", "c.*")
    size = F.char_length("hit").cast("long")
    end = F.sum(F.col("gap") + size).over(Window.partitionBy("row_id", "kind").orderBy("pos"))
    assigned = F.regexp_extract("hit", f"^{ASSIGN}", 2)
    value = F.when(F.col("kind") == 0, assigned).otherwise(F.col("hit"))
    mixed = F.col("hit").rlike("[0-9]") & F.col("hit").rlike("[a-z]") & F.col("hit").rlike("[A-Z]")
    good = F.when(F.col("kind") == 0, F.char_length(assigned) >= LEAST_ASSIGNED).when(F.col("kind") == 3, mixed).otherwise(F.lit(True))
    d = d.select("row_id", "repo", "owner", "kind", (end - size).alias("start"), end.alias("end"), value.alias("value"), good.alias("good"))
    # A row whose candidates all fail keeps one row with null kind.
    return d.select("row_id", "repo", "owner", *[F.when(F.col("good"), F.col(c)).alias(c) for c in ("kind", "start", "end")], F.when(F.col("good"), F.sha2("value", 256)).alias("digest"))


def ownership(found: DataFrame) -> DataFrame:
    """(digest, n_repos, n_owners) over the whole corpus."""
    own = F.coalesce(F.concat(F.lit("="), F.col("owner")), F.lit(""))
    by_repo = found.filter(F.col("digest").isNotNull()).groupBy("digest", own.alias("own"), "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("digest", "own").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("digest").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def scan(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", most_owners: int = 1) -> DataFrame:
    """(repo, spans): for each row of docs its spans, structs of start, kind number, end, n_repos, n_owners, live, in order."""
    found = materialize(candidates(docs, repo_col, owner_col), "secrets")
    # Rows without a candidate, which are most, take no part in the join: null keys would all meet in one task.
    judged = found.filter("digest is not null").join(ownership(found), "digest").unionByName(found.filter("digest is null"), allowMissingColumns=True)
    live = F.col("n_owners") <= most_owners
    keep = F.col("kind").isNotNull() & ((F.col("kind") < len(BASE)) | live)
    span = F.when(keep, F.struct("start", "kind", "end", "n_repos", "n_owners", live.alias("live")))
    return judged.groupBy("row_id", "repo").agg(F.array_sort(F.collect_list(span)).alias("spans")).select(F.col("repo").alias(repo_col), "spans")


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in PATTERNS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def query(docs: DataFrame) -> DataFrame:
    s = scan(docs)
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return s.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"))


def _sql_kind(number: int, kind: str) -> str:
    pattern = PATTERNS[kind].replace("'", "''")
    return f"""SELECT rid, {number} AS kind, unnest(range(1, len(h) + 1)) AS pos, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap
      FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS g FROM d) WHERE len(h) > 0"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
c AS ({" UNION ALL ".join(_sql_kind(i, k) for i, k in enumerate(PATTERNS))}),
p AS (SELECT rid, kind, hit, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY pos) AS BIGINT) AS stop,
             CASE WHEN kind = 0 THEN regexp_extract(hit, '{ASSIGN.replace("'", "''")}', 2) ELSE hit END AS value FROM c),
f AS (SELECT p.rid, doc_id, source, kind, stop - length(hit) AS start, stop, value FROM p JOIN d USING (rid)
      WHERE CASE kind WHEN 0 THEN length(value) >= {LEAST_ASSIGNED}
                      WHEN 3 THEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') ELSE TRUE END),
o AS (SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners FROM f GROUP BY value),
s AS (SELECT rid, kind, start, owners <= 1 AS live,
             ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || start || ':' || stop AS span
      FROM f JOIN o USING (value) WHERE kind < 3 OR owners <= 1)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans, count(*) FILTER (live) AS n_live
FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id
"""
