"""Schema descriptors, and what they are in Arrow and in Spark.

A type is a name or a tuple: boolean, utf8, binary, date32, date64, null,
("integer", bits, signed), ("float", bits), ("fixed_binary", n),
("time", unit, bits), ("timestamp", unit, zone or None), ("duration", unit),
("decimal", bits, precision, scale), ("list", Field), ("large_list", Field),
("fixed_list", Field, n) and ("struct", (Field, ...)).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import types as T

from ..errors import EngineError, invalid

# Short names of types.
ALIASES = {
    "string": "utf8",
    "int8": ("integer", 8, True),
    "int16": ("integer", 16, True),
    "int32": ("integer", 32, True),
    "int64": ("integer", 64, True),
    "uint8": ("integer", 8, False),
    "uint16": ("integer", 16, False),
    "uint32": ("integer", 32, False),
    "uint64": ("integer", 64, False),
    "float32": ("float", 32),
    "float64": ("float", 64),
    "date": "date32",
}
UNITS = {"second": "s", "millisecond": "ms", "microsecond": "us", "nanosecond": "ns"}
_UNIT_NAMES = {v: k for k, v in UNITS.items()}
_PLAIN = {"boolean", "utf8", "binary", "date32", "date64", "null"}


@dataclass(frozen=True)
class Field:
    name: str
    type: object
    nullable: bool = True

    def __post_init__(self):
        if not isinstance(self.name, str) or not self.name:
            raise invalid("schema", "a field needs a non-empty name")
        object.__setattr__(self, "type", normal(self.type))


@dataclass(frozen=True)
class Schema:
    """Fields in order, with unique names."""

    fields: tuple[Field, ...]

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise invalid("schema", "field names must be unique")

    @classmethod
    def of(cls, fields: Iterable) -> Schema:
        """From Fields or tuples (name, type[, nullable])."""
        return cls(tuple(f if isinstance(f, Field) else Field(*f) for f in fields))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __getitem__(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def select(self, names: Iterable[str]) -> Schema:
        wanted = set(names)
        return Schema(tuple(f for f in self.fields if f.name in wanted))

    def to_arrow(self) -> pa.Schema:
        return pa.schema([_arrow_field(f) for f in self.fields])

    def to_spark(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, spark_type(f.type), f.nullable) for f in self.fields])

    @classmethod
    def from_arrow(cls, schema: pa.Schema, strict: bool = True) -> Schema:
        """``strict``: types that have no descriptor (map, float16, dictionary, ...) are an error."""
        return cls(tuple(Field(f.name, from_arrow(f.type, strict), f.nullable) for f in schema))

    @classmethod
    def from_spark(cls, struct: T.StructType) -> Schema:
        return cls(tuple(Field(f.name, from_spark(f.dataType), f.nullable) for f in struct.fields))


def normal(kind):
    """The full form of a type; an error where there is none."""
    if isinstance(kind, str) and kind in ALIASES:
        return ALIASES[kind]
    if isinstance(kind, str) and kind in _PLAIN:
        return kind
    if isinstance(kind, list):
        kind = tuple(kind)
    if isinstance(kind, tuple) and kind and isinstance(kind[0], str):
        head, rest = kind[0], kind[1:]
        positive = lambda n: isinstance(n, int) and not isinstance(n, bool) and n > 0
        if head == "integer" and len(rest) == 2 and rest[0] in (8, 16, 32, 64) and isinstance(rest[1], bool):
            return kind
        if head == "float" and rest in ((32,), (64,)):
            return kind
        if head == "fixed_binary" and len(rest) == 1 and positive(rest[0]):
            return kind
        if head == "time" and rest in (("second", 32), ("millisecond", 32), ("microsecond", 64), ("nanosecond", 64)):
            return kind
        if head == "timestamp" and rest and rest[0] in UNITS:
            if len(rest) == 1:
                return ("timestamp", rest[0], "UTC")
            if len(rest) == 2 and (rest[1] is None or isinstance(rest[1], str)):
                return kind
        if head == "duration" and len(rest) == 1 and rest[0] in UNITS:
            return kind
        if head == "decimal" and len(rest) == 3 and rest[0] in (32, 64, 128, 256) and positive(rest[1]) and isinstance(rest[2], int):
            if rest[1] <= {32: 9, 64: 18, 128: 38, 256: 76}[rest[0]] and rest[2] <= rest[1]:
                return kind
        if head in ("list", "large_list") and len(rest) == 1:
            return (head, rest[0] if isinstance(rest[0], Field) else Field(*rest[0]))
        if head == "fixed_list" and len(rest) == 2 and positive(rest[1]):
            return (head, rest[0] if isinstance(rest[0], Field) else Field(*rest[0]), rest[1])
        if head == "struct" and len(rest) == 1:
            return (head, Schema.of(rest[0]).fields)
    raise invalid("schema", "unknown or malformed type")


def _arrow_field(f: Field) -> pa.Field:
    return pa.field(f.name, arrow_type(f.type), f.nullable)


def arrow_type(kind) -> pa.DataType:
    if isinstance(kind, str):
        return {"boolean": pa.bool_(), "utf8": pa.string(), "binary": pa.binary(), "date32": pa.date32(), "date64": pa.date64(), "null": pa.null()}[kind]
    head, *rest = kind
    if head == "integer":
        return getattr(pa, f"{'' if rest[1] else 'u'}int{rest[0]}")()
    if head == "float":
        return pa.float32() if rest[0] == 32 else pa.float64()
    if head == "fixed_binary":
        return pa.binary(rest[0])
    if head == "time":
        return pa.time32(UNITS[rest[0]]) if rest[1] == 32 else pa.time64(UNITS[rest[0]])
    if head == "timestamp":
        return pa.timestamp(UNITS[rest[0]], rest[1])
    if head == "duration":
        return pa.duration(UNITS[rest[0]])
    if head == "decimal":
        return pa.decimal256(rest[1], rest[2]) if rest[0] == 256 else pa.decimal128(rest[1], rest[2])
    if head == "list":
        return pa.list_(_arrow_field(rest[0]))
    if head == "large_list":
        return pa.large_list(_arrow_field(rest[0]))
    if head == "fixed_list":
        return pa.list_(_arrow_field(rest[0]), rest[1])
    return pa.struct([_arrow_field(f) for f in rest[0]])


def from_arrow(t: pa.DataType, strict: bool = True):
    p = pa.types
    field = lambda f: Field(f.name, from_arrow(f.type, strict), f.nullable)
    if p.is_boolean(t):
        return "boolean"
    if p.is_integer(t):
        return ("integer", t.bit_width, p.is_signed_integer(t))
    if p.is_float32(t) or p.is_float64(t):
        return ("float", t.bit_width)
    if p.is_string(t) or p.is_large_string(t):
        return "utf8"
    if p.is_fixed_size_binary(t):
        return ("fixed_binary", t.byte_width)
    if p.is_binary(t) or p.is_large_binary(t):
        return "binary"
    if p.is_date32(t):
        return "date32"
    if p.is_date64(t):
        return "date64"
    if p.is_time(t):
        return ("time", _UNIT_NAMES[t.unit], t.bit_width)
    if p.is_timestamp(t):
        return ("timestamp", _UNIT_NAMES[t.unit], t.tz)
    if p.is_duration(t):
        return ("duration", _UNIT_NAMES[t.unit])
    if p.is_decimal(t):
        return ("decimal", t.bit_width, t.precision, t.scale)
    if p.is_fixed_size_list(t):
        return ("fixed_list", field(t.value_field), t.list_size)
    if p.is_large_list(t):
        return ("large_list", field(t.value_field))
    if p.is_list(t):
        return ("list", field(t.value_field))
    if p.is_struct(t):
        return ("struct", tuple(field(t.field(i)) for i in range(t.num_fields)))
    if p.is_null(t):
        return "null"
    if not strict and p.is_map(t):
        entry = Field("entries", ("struct", (field(t.key_field), field(t.item_field))), False)
        return ("list", entry)
    raise EngineError("unsupported", "schema", "the file has a column type that is not supported")


def spark_type(kind) -> T.DataType:
    """What Spark reads and holds such a column as; unsigned integers are widened, nanoseconds, times and durations are whole numbers of their unit."""
    if isinstance(kind, str):
        return {"boolean": T.BooleanType(), "utf8": T.StringType(), "binary": T.BinaryType(), "date32": T.DateType(), "date64": T.DateType(), "null": T.NullType()}[kind]
    head, *rest = kind
    if head == "integer":
        if rest[1]:
            return {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}[rest[0]]
        return {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}[rest[0]]
    if head == "float":
        return T.FloatType() if rest[0] == 32 else T.DoubleType()
    if head == "fixed_binary":
        return T.BinaryType()
    if head == "time":
        return T.IntegerType() if rest[1] == 32 else T.LongType()
    if head == "timestamp":
        return T.LongType() if rest[0] == "nanosecond" else T.TimestampType() if rest[1] else T.TimestampNTZType()
    if head == "duration":
        return T.LongType()
    if head == "decimal":
        return T.BinaryType() if rest[1] > 38 else T.DecimalType(rest[1], max(0, rest[2]))
    if head in ("list", "large_list", "fixed_list"):
        return T.ArrayType(spark_type(rest[0].type), rest[0].nullable)
    return T.StructType([T.StructField(f.name, spark_type(f.type), f.nullable) for f in rest[0]])


def from_spark(t: T.DataType):
    plain = {T.BooleanType: "boolean", T.StringType: "utf8", T.BinaryType: "binary", T.DateType: "date32", T.NullType: "null", T.ByteType: ("integer", 8, True), T.ShortType: ("integer", 16, True), T.IntegerType: ("integer", 32, True), T.LongType: ("integer", 64, True), T.FloatType: ("float", 32), T.DoubleType: ("float", 64), T.TimestampType: ("timestamp", "microsecond", "UTC"), T.TimestampNTZType: ("timestamp", "microsecond", None)}
    if type(t) in plain:
        return plain[type(t)]
    if isinstance(t, T.DecimalType):
        return ("decimal", 128, t.precision, t.scale)
    if isinstance(t, T.ArrayType):
        return ("list", Field("element", from_spark(t.elementType), t.containsNull))
    if isinstance(t, T.StructType):
        return ("struct", Schema.from_spark(t).fields)
    raise EngineError("unsupported", "schema", "the column type is not supported")
