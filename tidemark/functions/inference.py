"""Finite input: rows or columns as Python values, their schema, and Arrow tables made of them."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Mapping

import pyarrow as pa

from ..errors import EngineError, invalid
from .types import Field, Schema

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
_PER_SECOND = {"second": 1, "millisecond": 10**3, "microsecond": 10**6, "nanosecond": 10**9}


def to_columns(data, operation: str = "write") -> dict[str, list]:
    """Rows (mappings with one and the same non-empty set of keys), one row, or a map of columns (all values lists) to columns."""
    if isinstance(data, Mapping):
        names = list(map(str, data))
        if len(set(names)) != len(names):
            raise invalid(operation, "column names must be unique")
        if data and all(isinstance(v, list) for v in data.values()):
            if len({len(v) for v in data.values()}) > 1:
                raise invalid(operation, "columns must have equal lengths")
            return {str(k): v for k, v in data.items()}
        data = [data]
    rows = list(data)
    if not all(isinstance(r, Mapping) for r in rows):
        raise invalid(operation, "rows must be mappings")
    if not rows:
        return {}
    names = sorted(map(str, rows[0]))
    if not names:
        raise invalid(operation, "rows must have fields")
    out: dict[str, list] = {n: [] for n in names}
    for r in rows:
        own = {str(k): v for k, v in r.items()}
        if len(own) != len(r) or sorted(own) != names:
            raise invalid(operation, "rows must have the same fields")
        for n in names:
            out[n].append(own[n])
    return out


def _kind(value) -> str:
    if isinstance(value, bool):  # before int: bool is one
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "utf8"
    if isinstance(value, (bytes, bytearray)):
        return "binary"
    if isinstance(value, dt.datetime):
        return "timestamp"
    raise invalid("infer", "a value's type cannot be inferred; give a schema")


def infer(columns: Mapping[str, list]) -> Schema:
    """Fields by sorted name; integers with floats among them are float64; a field is nullable if it holds a null."""
    if not columns or not any(columns.values()):
        raise invalid("infer", "no rows to infer a schema from; give a schema")
    fields = []
    for name in sorted(columns):
        kinds = {_kind(v) for v in columns[name] if v is not None}
        if not kinds:
            raise invalid("infer", "a column of nulls alone has no type; give a schema")
        if kinds == {"integer", "float"}:
            kinds = {"float"}
        if len(kinds) > 1:
            raise invalid("infer", "a column mixes types; give a schema")
        kind = {"boolean": "boolean", "integer": "int64", "float": "float64", "utf8": "utf8", "binary": "binary", "timestamp": ("timestamp", "microsecond", "UTC")}[kinds.pop()]
        fields.append(Field(name, kind, any(v is None for v in columns[name])))
    return Schema(tuple(fields))


def instant(value, unit: str, operation: str = "encode") -> int:
    """Whole units since the epoch: numbers pass, datetimes without a zone are UTC."""
    if isinstance(value, bool) or not isinstance(value, (int, dt.datetime)):
        raise invalid(operation, "a timestamp must be a whole number or a datetime")
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise invalid(operation, "timestamp is out of range")
        return value
    aware = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
    span = aware - _EPOCH
    micros = (span.days * 86_400 + span.seconds) * 10**6 + span.microseconds
    scaled = micros * _PER_SECOND[unit] // 10**6
    if not -(1 << 63) <= scaled < 1 << 63:
        raise invalid(operation, "timestamp is out of range")
    return scaled


def _encoded(value, field: Field):
    """A value as Arrow takes it for the field's type; an error where it does not fit."""
    kind = field.type
    wrong = invalid("write", "a value does not match its field's type")
    if value is None:
        if not field.nullable:
            raise invalid("write", "a required field holds a null")
        return None
    if kind == "null":
        raise wrong
    if kind == "boolean":
        if not isinstance(value, bool):
            raise wrong
        return value
    if kind == "utf8":
        if not isinstance(value, str):
            raise wrong
        return value
    if kind == "binary":
        if not isinstance(value, (bytes, bytearray, str)):
            raise wrong
        return value.encode() if isinstance(value, str) else bytes(value)
    if kind in ("date32", "date64"):
        if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
            return value
        if isinstance(value, bool) or not isinstance(value, int):
            raise wrong
        return dt.date(1970, 1, 1) + dt.timedelta(days=value if kind == "date32" else value // 86_400_000)
    head, *rest = kind
    if head == "integer":
        low, high = (-(1 << rest[0] - 1), 1 << rest[0] - 1) if rest[1] else (0, 1 << rest[0])
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value < high:
            raise wrong
        return value
    if head == "float":
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise wrong
        return float(value)
    if head == "fixed_binary":
        if not isinstance(value, (bytes, bytearray)) or len(value) != rest[0]:
            raise wrong
        return bytes(value)
    if head == "timestamp":
        return instant(value, rest[0], "write")
    if head in ("time", "duration"):
        if isinstance(value, bool) or not isinstance(value, int):
            raise wrong
        return value
    if head == "decimal":  # the unscaled number as text or int, or a Decimal
        try:
            exact = value if isinstance(value, decimal.Decimal) else decimal.Decimal(int(value)).scaleb(-rest[2], decimal.Context(prec=100))
        except (ValueError, TypeError, decimal.InvalidOperation):
            raise wrong from None
        if abs(exact.scaleb(rest[2], decimal.Context(prec=100))) >= 10 ** rest[1]:
            raise wrong
        return exact
    if head in ("list", "large_list", "fixed_list"):
        if not isinstance(value, (list, tuple)) or head == "fixed_list" and len(value) != rest[1]:
            raise wrong
        return [_encoded(v, rest[0]) for v in value]
    if not isinstance(value, Mapping) or {str(k) for k in value} != {f.name for f in rest[0]}:
        raise wrong
    own = {str(k): v for k, v in value.items()}
    return {f.name: _encoded(own[f.name], f) for f in rest[0]}


def to_arrow(columns: Mapping[str, list], schema: Schema) -> pa.Table:
    """An Arrow table of exactly the schema's fields, every value checked."""
    if columns and set(columns) != set(schema.names):
        raise invalid("write", "the input's fields must be exactly those of the schema")
    arrays = []
    for field, target in zip(schema.fields, schema.to_arrow(), strict=True):
        values = [_encoded(v, field) for v in columns.get(field.name, [])]
        try:
            arrays.append(pa.array(values, target.type))
        except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):
            raise EngineError("invalid_argument", "write", "a value does not match its field's type") from None
    return pa.Table.from_arrays(arrays, schema=schema.to_arrow())


def decoded(values: list, kind) -> list:
    """Python values of a column as rows show them: decimals as text of the unscaled number, dates, times and durations as whole numbers, UTC timestamps as datetimes, others and nanoseconds as whole numbers of their unit."""
    return [_decoded(v, kind) for v in values]


def _decoded(v, kind):
    if v is None:
        return None
    if kind in ("date32", "date64"):
        days = (v - dt.date(1970, 1, 1)).days
        return days if kind == "date32" else days * 86_400_000
    if not isinstance(kind, tuple):
        return v
    head, *rest = kind
    if head == "decimal":
        return str(int(v.scaleb(rest[2], decimal.Context(prec=100))))
    if head == "timestamp" and rest[0] == "nanosecond" and hasattr(v, "value"):
        return v.value  # a datetime would lose what is below a microsecond
    if head == "timestamp" and isinstance(v, dt.datetime) and rest[1] != "UTC":
        return instant(v, rest[0])
    if head == "time" and isinstance(v, dt.time):
        return ((v.hour * 60 + v.minute) * 60 + v.second) * _PER_SECOND[rest[0]] + v.microsecond * _PER_SECOND[rest[0]] // 10**6
    if head == "duration" and isinstance(v, dt.timedelta):
        return (v.days * 86_400 + v.seconds) * _PER_SECOND[rest[0]] + v.microseconds * _PER_SECOND[rest[0]] // 10**6
    if head in ("list", "large_list", "fixed_list"):
        return [_decoded(x, rest[0].type) for x in v]
    if head == "struct":
        return {f.name: _decoded(v[f.name], f.type) for f in rest[0]}
    return v
