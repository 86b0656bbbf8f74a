"""One comparison, (op, column, literal), checked strictly against the schema before Spark sees it."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError, invalid
from .inference import instant
from .types import Schema

# The operators.
OPERATORS = ("gt", "gte", "lt", "lte", "eq")


def compare(where, schema: Schema, timestamps: bool = False) -> Column:
    """The condition as a Column that Spark pushes down to the scan.

    Integers compare with 64-bit whole numbers, floats with finite floats (NaN
    never matches), text with text, booleans by ``eq`` alone; nulls never match.
    ``timestamps``: timestamp columns compare with datetimes and with whole
    numbers of their unit. Other column types are unsupported.
    """
    if not isinstance(where, (tuple, list)) or len(where) != 3 or where[0] not in OPERATORS:
        raise invalid("where", "a predicate is (gt, gte, lt, lte or eq; column; literal)")
    op, name, literal = where
    if str(name) not in schema.names:
        raise invalid("where", "the predicate's column does not exist")
    kind = schema[str(name)].type
    column = F.col(f"`{name}`")
    mismatch = invalid("where", "predicate literal does not match the column type")
    whole = isinstance(literal, int) and not isinstance(literal, bool)
    if whole and not -(1 << 63) <= literal < 1 << 63:
        raise invalid("where", "an integer literal must fit 64 bits")
    if isinstance(literal, float) and not math.isfinite(literal):
        raise invalid("where", "a float literal must be finite")
    head = kind[0] if isinstance(kind, tuple) else kind
    if head == "integer":
        if not whole:
            raise mismatch
        return _applied(op, column, F.lit(literal))
    if head == "float":
        if not isinstance(literal, float):
            raise mismatch
        value = F.lit(literal) if kind[1] == 64 else F.lit(literal).cast("double")
        found = _applied(op, column if kind[1] == 64 else column.cast("double"), value)
        return found & ~F.isnan(column) if op in ("gt", "gte") else found  # Spark holds NaN to be the greatest
    if head == "utf8":
        if not isinstance(literal, str):
            raise mismatch
        return _applied(op, column, F.lit(literal))
    if head == "boolean":
        if not isinstance(literal, bool):
            raise mismatch
        if op != "eq":
            raise EngineError("unsupported", "where", "booleans compare by eq alone")
        return column == F.lit(literal)
    if head == "timestamp" and timestamps:
        if not whole and not isinstance(literal, dt.datetime):
            raise mismatch
        return _applied(op, column, timestamp_literal(instant(literal, kind[1]), kind))
    raise EngineError("unsupported", "where", "columns of this type cannot be compared")


def timestamp_literal(value: int, kind) -> Column:
    """A whole number of a timestamp type's unit as a literal that Spark compares with such a column."""
    if kind == ("integer", 64, True) or kind[1] == "nanosecond":
        return F.lit(value)
    micros = value * {"second": 10**6, "millisecond": 10**3, "microsecond": 1}[kind[1]]
    moment = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)
    text = moment.isoformat(sep=" ", timespec="microseconds")
    return F.lit(f"{text}+00:00").cast("timestamp") if kind[2] else F.lit(text).cast("timestamp_ntz")


def _applied(op: str, a: Column, b: Column) -> Column:
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b, "eq": a == b}[op]
