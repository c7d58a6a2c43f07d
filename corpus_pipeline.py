"""A training-corpus pipeline over the documents table, in five stages of the operators in veldt.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's docs.
All but the last return the columns of documents, with any extra columns that these have, whatever their names.

Defined cases: a null or empty text has no words, so the classifier keeps it, no line of it is removed, it links with nothing, and the mix
takes it as often as others of its source, for 0 words; a text whose every word is removed goes, one that had none stays. A null
language or source is one of its own. Rows with a null id are judged by the classifier and mixed, but lines and near copies are told apart by id, so
they lose no lines and stay in near-dedup. Rows that repeat an id are judged each for itself; lines of one number of theirs don't remove each other;
of exact copies under different ids that with the smallest id stays. Texts of any length are read whole. An empty table gives an empty
result with each stage's columns.

A stage's scratch tables are deleted when a later stage begins, whose docs are that stage's result, written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm import lines, mixing, near_dup, pieces, quality
from veldt.llm.common import WORD, bitmap, forget, materialize, may_hold, quoted, scratch_paths, table, unused

#: Scratch tables by the number of the stage that made them.
_made: dict[int, set[str]] = {}


def _stage(number: int):
    def wrap(function):
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            old = {path for k, paths in _made.items() if k < number for path in paths}
            # Only when docs stand on written files, not on an earlier stage's scratch.
            if old and not any(path.rsplit("/", 1)[-1] in file for file in docs.inputFiles() for path in old):
                forget(*old)
                for k in [k for k in _made if k < number]:
                    del _made[k]
            before = scratch_paths()
            out = function(spark, docs, sf_dir)
            _made.setdefault(number, set()).update(scratch_paths() - before)
            return out

        run_stage.__name__, run_stage.__doc__ = function.__name__, function.__doc__
        return run_stage

    return wrap


@_stage(1)
def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage(2)
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matches of lines of any length go, and documents that lose all their words; n_chars follows the text."""
    gone = unused("__gone", docs.columns)
    out = lines.dedup_lines(docs, count=gone).filter((F.col(gone) == 0) | F.regexp_like("text", F.lit(WORD)))
    counted = F.when(F.col(gone) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[counted.alias(c) if c == "n_chars" else q for c, q in zip(docs.columns, quoted(docs.columns), strict=True)])


@_stage(3)
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on five-word shingles, stays: the one with the smallest id."""
    copy = unused("copy", docs.columns)
    copies = near_dup.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80).filter(~F.col("kept")).select(F.col("doc_id").alias(copy))
    copies = materialize(copies.distinct(), "copies")
    # Texts that the bitmap clears stay where they are; only the others meet the list.
    doubtful = F.coalesce(may_hold(bitmap(copies, copy), F.col("doc_id")), F.lit(False))
    stay = docs.filter(doubtful).join(copies, F.col("doc_id") == F.col(copy), "left_anti")
    return docs.filter(~doubtful).unionByName(stay.select(*quoted(docs.columns)))


@_stage(4)
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight takes it."""
    return mixing.mixed_corpus(docs)


@_stage(5)
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and round trip of each document, as digests."""
    return pieces.query(docs)


STAGES = [
    ("quality classifier", reject_poor),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", tokenize),
]

#: SQL can't express the model of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage")
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
