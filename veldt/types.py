"""The nine scalar types, their Spark types, and the classification of string literals."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from veldt.errors import unsupported

SMALLINT, INT, BIGINT, TEXT, BOOL, REAL = "SMALLINT", "INT", "BIGINT", "TEXT", "BOOL", "REAL"
DATE, TIME, TIMESTAMP = "DATE", "TIME", "TIMESTAMP"
#: An integer literal that takes the width of what stands beside it, and the type of NULL.
UNTYPED, NULL = "UNTYPED", "NULL"

NAMES = (SMALLINT, INT, BIGINT, TEXT, BOOL, REAL, DATE, TIME, TIMESTAMP)
INTEGERS = {SMALLINT: 16, INT: 32, BIGINT: 64}
TEMPORAL = (DATE, TIME, TIMESTAMP)

#: TIME is held as seconds since midnight: casts to Spark's own TIME and its Parquet form aren't to be had.
SPARK = {
    SMALLINT: T.ShortType(), INT: T.IntegerType(), BIGINT: T.LongType(), TEXT: T.StringType(), BOOL: T.BooleanType(), REAL: T.DoubleType(),
    DATE: T.DateType(), TIME: T.IntegerType(), TIMESTAMP: T.TimestampType(), UNTYPED: T.LongType(), NULL: T.StringType(),
}
INT32 = range(-(2**31), 2**31)


def fits(value: int, kind: str) -> bool:
    bits = INTEGERS[kind]
    return -(1 << bits - 1) <= value < 1 << bits - 1


def of_spark(kind: T.DataType) -> str | None:
    """The engine's type of a Spark type; None where there is none."""
    if isinstance(kind, T.TimestampNTZType):
        return TIMESTAMP
    return next((name for name in NAMES if name != TIME and type(SPARK[name]) is type(kind)), None)


@dataclass(frozen=True)
class Int16:
    value: int


@dataclass(frozen=True)
class Int32:
    value: int


@dataclass(frozen=True)
class Int64:
    value: int


_DATE, _CLOCK = r"\d{4}-\d\d-\d\d", r"\d\d:\d\d:\d\d"
_LOOSE_DATE, _LOOSE_CLOCK = r"\d+[-/]\d+[-/]\d+", r"\d+:\d+:\d+"
_NEAR = re.compile(rf"{_LOOSE_DATE}|{_LOOSE_CLOCK}|{_LOOSE_DATE}[ Tt]{_LOOSE_CLOCK}|{_LOOSE_DATE}\s.*(?:[AaPp][Mm]).*", re.ASCII)


def classify(text: str) -> tuple[str, Any]:
    """(type, value) of a string literal: canonical temporal forms are temporal, near misses are errors, the rest is TEXT."""
    bare = text.strip()
    canonical = re.fullmatch(rf"({_DATE})?( (?={_CLOCK}))?({_CLOCK})?", bare, re.ASCII)
    if not bare or not canonical or bool(canonical[2]) != bool(canonical[1] and canonical[3]):
        if bare and _NEAR.fullmatch(bare):
            raise unsupported()
        return TEXT, text
    if bare != text:
        raise unsupported()
    try:
        date = dt.date.fromisoformat(canonical[1]) if canonical[1] else None
        clock = dt.time.fromisoformat(canonical[3]) if canonical[3] else None
    except ValueError:
        raise unsupported() from None
    if date and clock:
        return TIMESTAMP, dt.datetime.combine(date, clock)
    if date:
        return DATE, date
    return TIME, clock.hour * 3600 + clock.minute * 60 + clock.second
