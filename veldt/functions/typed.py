"""Typed values, and what the operators and functions make of them.

Predicates are two-valued: equality is null-safe, and what cannot be compared is an error. In strict mode a null operand of an
ordering, of arithmetic or of a scalar function raises; in lenient mode it gives null or false. Guards are left out where
operands cannot be null.
"""

from __future__ import annotations

import zoneinfo
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldt import types as ty
from veldt.errors import ExecError, mismatch, unsupported


@dataclass
class Typed:
    col: Column
    kind: str
    nullable: bool = False
    constant: bool = False
    value: Any = None
    local: bool = False  # of a TIMESTAMP: kept without zone
    guarded: bool = False  # may raise


@dataclass(frozen=True)
class Mode:
    strict: bool = True
    zone: str | None = None


def _simple_fold(c: str) -> str:
    """A character's simple case folding: one character for one."""
    return next(x for x in (c.casefold(), c.lower(), c) if len(x) == 1)


#: Characters that lower-casing alone doesn't fold, or folds by what stands beside them (the capital sigma), with their folding.
_FOLDED = {c: f for c in map(chr, range(0x80, 0x1E944)) if not 0xD800 <= ord(c) < 0xE000 and ((f := _simple_fold(c)) != c.lower() or c == "\u03a3") and f != c}


def folded(t: Typed, other: Typed) -> Column:
    """A TEXT operand of = or !=, folded; other: what it is compared with, which may settle that lower-casing is enough."""
    if t.constant:
        return F.lit(t.value.translate(str.maketrans(_FOLDED)).lower())
    if other.constant and other.value.isascii():
        # Beyond ASCII only the long s and the kelvin sign fold to ASCII letters, and lower-casing folds the latter.
        return F.lower(F.translate(t.col, "\u017f", "s")) if "s" in other.value.lower() else F.lower(t.col)
    return F.lower(F.translate(t.col, "".join(_FOLDED), "".join(_FOLDED.values())))


def raising(kind: str) -> Column:
    return F.raise_error(F.lit("execution: type mismatch")).cast(kind)


def constant(kind: str, value: Any) -> Typed:
    if kind == ty.NULL:
        return Typed(F.lit(None), kind, True, True)
    if kind in (ty.UNTYPED, *ty.INTEGERS, ty.TIME):
        col = F.lit(value).cast(ty.SPARK[kind])
    else:
        col = F.lit(value)
    return Typed(col, kind, False, True, value)


def instant(t: Typed, local: bool, mode: Mode) -> Column:
    """The column of a TIMESTAMP; a literal becomes local or an instant, as what it stands beside."""
    if not t.constant:
        return t.col
    if local:
        return F.lit(t.value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    if mode.zone is None:
        raise ExecError("unresolved TIMESTAMP requires configured database timezone")
    return F.timestamp_millis(F.lit(int(t.value.replace(tzinfo=zoneinfo.ZoneInfo(mode.zone)).timestamp() * 1000)))


def _guard(result: Column, kind: str, mode: Mode, *of: Typed) -> tuple[Column, bool]:
    """result, or an error where one of the operands is null."""
    nulls = [t.col.isNull() for t in of if t.nullable]
    if not nulls or not mode.strict:
        return result, any(t.guarded for t in of)
    null = nulls[0] if len(nulls) == 1 else nulls[0] | nulls[1]
    return F.when(null, raising(kind)).otherwise(result), True


def compare(op: str, a: Typed, b: Typed, mode: Mode) -> Typed:
    """A predicate that is never null."""
    order = op not in ("=", "!=")
    if ty.NULL in (a.kind, b.kind):
        if order:
            if mode.strict:
                raise mismatch()
            return Typed(F.lit(False), ty.BOOL)
        ac, bc = (x.col if x.kind != ty.NULL else F.lit(None).cast(ty.SPARK[y.kind]) for x, y in ((a, b), (b, a)))
    elif ty.UNTYPED in (a.kind, b.kind) or (a.kind in ty.INTEGERS and b.kind in ty.INTEGERS):
        ac, bc = _integers(a, b)
    elif a.kind != b.kind or (a.kind == ty.BOOL and order):
        raise mismatch()
    elif a.kind == ty.TEXT:
        if order:
            ac, bc = (F.lit(x.value.lower()) if x.constant else F.lower(x.col) for x in (a, b))
        else:
            ac, bc = folded(a, b), folded(b, a)
    elif a.kind == ty.TIMESTAMP:
        local = (not a.constant and a.local) or (not b.constant and b.local)
        ac, bc = instant(a, local, mode), instant(b, local, mode)
    else:
        ac, bc = a.col, b.col
    guarded = a.guarded or b.guarded
    if not order:
        safe = a.nullable or b.nullable
        same = ac.eqNullSafe(bc) if safe else ac == bc
        return Typed(same if op == "=" else ~same, ty.BOOL, guarded=guarded)
    made = {"<": ac < bc, "<=": ac <= bc, ">": ac > bc, ">=": ac >= bc}[op]
    if not mode.strict:
        return Typed(F.coalesce(made, F.lit(False)) if a.nullable or b.nullable else made, ty.BOOL, guarded=guarded)
    made, raises = _guard(made, "boolean", mode, a, b)
    return Typed(made, ty.BOOL, guarded=raises)


def _integers(a: Typed, b: Typed) -> tuple[Column, Column]:
    for x, y in ((a, b), (b, a)):
        if x.kind != ty.UNTYPED and x.kind not in ty.INTEGERS:
            raise mismatch()
        if x.kind == ty.UNTYPED and x.constant and y.kind in ty.INTEGERS and not ty.fits(x.value, y.kind):
            raise mismatch()
    cast = lambda x, y: x.col.cast(ty.SPARK[y.kind]) if x.kind == ty.UNTYPED and x.constant and y.kind in ty.INTEGERS else x.col
    return cast(a, b), cast(b, a)


def arithmetic(op: str, a: Typed, b: Typed, mode: Mode) -> Typed:
    whole = {ty.UNTYPED, *ty.INTEGERS}
    if a.kind in whole and b.kind in whole:
        if a.constant and b.constant:
            value = a.value + b.value if op == "+" else a.value - b.value
            kind = b.kind if a.kind == ty.UNTYPED else a.kind
            if value not in ty.INT32 if kind == ty.UNTYPED else not ty.fits(value, kind):
                raise ExecError("integer out of range")
            return constant(kind, value)
        if a.kind != b.kind and ty.UNTYPED not in (a.kind, b.kind):
            raise mismatch()
        kind = b.kind if a.kind == ty.UNTYPED else a.kind
        ac, bc = _integers(a, b)
    elif a.kind == b.kind == ty.REAL:
        kind, ac, bc = ty.REAL, a.col, b.col
    else:
        raise mismatch()
    made, raises = _guard(ac + bc if op == "+" else ac - bc, ty.SPARK[kind].simpleString(), mode, a, b)
    return Typed(made, kind, (a.nullable or b.nullable) and not mode.strict, guarded=raises)


def call(name: str, a: Typed, mode: Mode) -> Typed:
    if name in ("LOWER", "UPPER", "LENGTH"):
        if a.kind != ty.TEXT:
            raise mismatch()
        kind = ty.UNTYPED if name == "LENGTH" else ty.TEXT
        made = {"LOWER": F.lower, "UPPER": F.upper, "LENGTH": lambda c: F.octet_length(c).cast("long")}[name](a.col)
    elif name == "ABS":
        if a.kind not in (ty.UNTYPED, ty.REAL, *ty.INTEGERS):
            raise mismatch()
        kind, made = a.kind, F.abs(a.col)
    else:
        raise unsupported(ExecError)
    made, raises = _guard(made, ty.SPARK[kind].simpleString(), mode, a)
    return Typed(made, kind, a.nullable and not mode.strict, guarded=raises)


def aggregate(name: str, a: Typed | None, place: Column | None) -> Typed:
    """place: the row's position, which settles which of equal texts comes first."""
    if a is None:
        return Typed(F.count(F.lit(1)), ty.UNTYPED)
    if name == "COUNT":
        return Typed(F.count(a.col), ty.UNTYPED)
    whole = (ty.UNTYPED, *ty.INTEGERS)
    if name in ("SUM", "AVG"):
        if a.kind not in (*whole, ty.REAL, ty.NULL):
            raise mismatch()
        value = a.col.cast("double")
        return Typed(F.sum(value) if name == "SUM" else F.avg(value), ty.REAL, True)
    if a.kind == ty.TEXT:
        lowered = F.lower(a.col)
        if name == "MIN":
            key = F.struct(lowered.alias("t"), (a.col if place is None else place).alias("p"))
            return Typed(F.min_by(a.col, F.when(a.col.isNotNull(), key)), ty.TEXT, True)
        key = F.struct(lowered.alias("t"), (a.col if place is None else -place).alias("p"))
        return Typed(F.max_by(a.col, F.when(a.col.isNotNull(), key)), ty.TEXT, True)
    if a.kind not in (*whole, ty.REAL, ty.NULL):
        raise mismatch()
    return Typed(F.min(a.col) if name == "MIN" else F.max(a.col), a.kind, True)


def sort_key(a: Typed, descending: bool, mode: Mode) -> Column:
    if a.kind in (ty.BOOL, ty.NULL):
        raise mismatch()
    key = F.lower(a.col) if a.kind == ty.TEXT else a.col
    key = _guard(key, ty.SPARK[a.kind].simpleString() if not a.local else "timestamp_ntz", mode, a)[0]
    return key.desc() if descending else key.asc()
