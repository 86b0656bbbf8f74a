import datetime as dt
import random

import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.errors import CATEGORIES, EngineError, translated
from tidemark.functions import inference, zstd
from tidemark.functions.predicate import compare
from tidemark.functions.timepart import GRANULARITIES, SEGMENTS, TimePartition
from tidemark.functions.types import ALIASES, Field, Schema, arrow_type, from_arrow, normal, spark_type

UTC = dt.timezone.utc


def fails(category, f, *args, **kw):
    with pytest.raises(EngineError) as e:
        f(*args, **kw)
    assert e.value.category == category
    return e.value


# --- types

KINDS = [
    "boolean", "utf8", "binary", "date32", "date64", "null", *[("integer", b, s) for b in (8, 16, 32, 64) for s in (True, False)], ("float", 32), ("float", 64), ("fixed_binary", 3),
    ("time", "second", 32), ("time", "millisecond", 32), ("time", "microsecond", 64), ("time", "nanosecond", 64), *[("timestamp", u, z) for u in ("second", "millisecond", "microsecond", "nanosecond") for z in ("UTC", None)],
    *[("duration", u) for u in ("second", "nanosecond")], ("decimal", 128, 10, 2), ("decimal", 256, 50, 5), ("list", Field("item", "int32")), ("large_list", Field("item", "utf8", False)), ("fixed_list", Field("item", "float32"), 2), ("struct", (Field("a", "utf8"), Field("b", "int32", False))),
]


@pytest.mark.parametrize("kind", KINDS, ids=str)
def test_arrow_round_trip(kind):
    assert from_arrow(arrow_type(normal(kind))) == normal(kind)
    spark_type(normal(kind))


def test_schema_rules():
    assert Schema.of([("a", "string"), ("b", "int64", False)]).names == ["a", "b"]
    assert all(normal(a) == b for a, b in ALIASES.items())
    assert normal(("timestamp", "microsecond")) == ("timestamp", "microsecond", "UTC")
    for bad in ([("a", "string"), ("a", "int8")], [("", "string")], [("a", "varchar")], [("a", ("integer", 7, True))], [("a", ("decimal", 32, 10, 2))], [("a", ("fixed_binary", 0))], [("a", ("time", "second", 64))]):
        fails("invalid_argument", Schema.of, bad)
    fails("unsupported", from_arrow, pa.map_(pa.string(), pa.int32()))
    fails("unsupported", from_arrow, pa.float16())
    fails("unsupported", from_arrow, pa.dictionary(pa.int8(), pa.string()))


# --- inference


def test_inference():
    rows = [{"z": 1, "a": True, "f": 1, "s": "x", "b": b"\x00", "t": dt.datetime(2026, 8, 3, tzinfo=UTC)}, {"z": None, "a": False, "f": 2.5, "s": "y", "b": b"\xff", "t": dt.datetime(2026, 8, 4)}]
    s = inference.infer(inference.to_columns(rows))
    assert s.names == ["a", "b", "f", "s", "t", "z"]
    assert [f.type for f in s.fields] == ["boolean", "binary", ("float", 64), "utf8", ("timestamp", "microsecond", "UTC"), ("integer", 64, True)]
    assert [f.nullable for f in s.fields] == [False] * 5 + [True]
    assert inference.to_columns({"a": [1, 2], "b": ["x", "y"]}) == {"a": [1, 2], "b": ["x", "y"]}
    assert inference.to_columns({"a": 1}) == {"a": [1]}
    for bad in ([], [{"id": None}], [{"id": 1}, {"id": "one"}], [{"a": 1}, {"b": 1}], [{}], [{"a": b"x"}, {"a": "x"}], [{"a": True}, {"a": 1}], [{"a": object()}], {"a": [1], "b": []}):
        fails("invalid_argument", lambda b=bad: inference.infer(inference.to_columns(b)))


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("int8", [127, -128, None], [128, True, 1.0, "1"]),
        ("uint8", [0, 255], [-1, 256]),
        ("uint64", [2**64 - 1], [2**64]),
        ("float64", [1, 2.5], [True, "x"]),
        ("utf8", ["é"], [b"x", 1]),
        ("binary", [b"\xff", "x"], [1]),
        (("fixed_binary", 2), [b"ab"], [b"abc"]),
        ("boolean", [True], [1]),
        ("date32", [5, dt.date(1970, 1, 6)], [1.5]),
        (("timestamp", "millisecond"), [5, dt.datetime(1969, 12, 31, 23, 59, 59, 999_999)], ["x", True]),
        (("decimal", 128, 4, 2), ["1234", -5], ["12345", "x"]),
        (("list", Field("item", "int32", False)), [[1, 2], []], [[None], 1]),
        (("fixed_list", Field("item", "int32"), 2), [[1, None]], [[1]]),
        (("struct", (Field("a", "utf8"),)), [{"a": None}], [{}, {"a": 1}]),
    ],
    ids=str,
)
def test_values_are_checked(kind, good, bad):
    schema = Schema.of([("x", kind)])
    assert inference.to_arrow({"x": good}, schema).num_rows == len(good)
    for b in bad:
        fails("invalid_argument", inference.to_arrow, {"x": [b]}, schema)
    fails("invalid_argument", inference.to_arrow, {"x": [None]}, Schema.of([("x", kind, False)]))
    fails("invalid_argument", inference.to_arrow, {"y": good}, schema)


def test_instants():
    before = dt.datetime(1969, 12, 31, 23, 59, 59, 999_999)
    assert [inference.instant(before, u) for u in ("second", "millisecond", "microsecond", "nanosecond")] == [-1, -1, -1, -1000]
    assert inference.instant(dt.datetime(2026, 1, 1, 2, tzinfo=dt.timezone(dt.timedelta(hours=2))), "second") == inference.instant(dt.datetime(2026, 1, 1), "second")
    fails("invalid_argument", inference.instant, 2**63, "second")
    fails("invalid_argument", inference.instant, True, "second")


# --- predicates


def test_predicates(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, "a", True), (2, nan, "é", False), (None, None, None, None), (3, -2.5, "B", True)], "i long, f double, s string, b boolean")
    schema = Schema.from_spark(df.schema)
    count = lambda w: df.where(compare(w, schema)).count()
    assert [count((op, "i", 2)) for op in ("gt", "gte", "lt", "lte", "eq")] == [1, 2, 1, 2, 1]
    assert [count((op, "f", 0.5)) for op in ("gt", "gte", "lt", "lte", "eq")] == [1, 1, 1, 1, 0]
    assert [count((op, "s", "a")) for op in ("gt", "gte", "lt", "lte", "eq")] == [1, 2, 1, 2, 1]  # by bytes: B < a < é
    assert count(("eq", "b", True)) == 2
    for w in (("gt", "i", 1.0), ("gt", "i", True), ("gt", "f", 1), ("eq", "s", 1), ("eq", "b", 1), ("eq", "f", nan), ("eq", "f", float("inf")), ("eq", "i", 2**63), ("ne", "i", 1), ("eq", "nope", 1), ("eq", "i"), "i > 1"):
        fails("invalid_argument", compare, w, schema)
    fails("unsupported", compare, ("gt", "b", True), schema)
    fails("unsupported", compare, ("eq", "t", 1), Schema.of([("t", ("timestamp", "second"))]))
    fails("invalid_argument", compare, ("eq", "t", 1.5), Schema.of([("t", ("timestamp", "second"))]), True)


# --- time partitions

# (granularity, instant, path, start, until): what each one tests
VECTORS = [
    # no zeros before numbers, at any level
    ("minute", dt.datetime(2031, 2, 7, 4, 9, 5, 1), "year=2031/month=2/day=7/hour=4/minute=9", dt.datetime(2031, 2, 7, 4, 9), dt.datetime(2031, 2, 7, 4, 10)),
    ("hour", dt.datetime(2031, 2, 7, 0, 9), "year=2031/month=2/day=7/hour=0", dt.datetime(2031, 2, 7), dt.datetime(2031, 2, 7, 1)),
    # a start is inside, and the last microsecond before the next one too
    ("day", dt.datetime(2017, 6, 1), "year=2017/month=6/day=1", dt.datetime(2017, 6, 1), dt.datetime(2017, 6, 2)),
    ("day", dt.datetime(2017, 5, 31, 23, 59, 59, 999_999), "year=2017/month=5/day=31", dt.datetime(2017, 5, 31), dt.datetime(2017, 6, 1)),
    # leap days: of a century that has one, and February of one that has none
    ("day", dt.datetime(2000, 2, 29, 7), "year=2000/month=2/day=29", dt.datetime(2000, 2, 29), dt.datetime(2000, 3, 1)),
    ("month", dt.datetime(2100, 2, 28, 23), "year=2100/month=2", dt.datetime(2100, 2, 1), dt.datetime(2100, 3, 1)),
    # ISO weeks: a 53rd that ends in the next year, a first that begins in the last, a Sunday
    ("week", dt.datetime(2010, 1, 3, 18), "iso_year=2009/week=53", dt.datetime(2009, 12, 28), dt.datetime(2010, 1, 4)),
    ("week", dt.datetime(2013, 12, 30), "iso_year=2014/week=1", dt.datetime(2013, 12, 30), dt.datetime(2014, 1, 6)),
    # before the epoch
    ("hour", dt.datetime(1966, 7, 30, 15, 59, 59, 999_999), "year=1966/month=7/day=30/hour=15", dt.datetime(1966, 7, 30, 15), dt.datetime(1966, 7, 30, 16)),
    ("week", dt.datetime(1960, 1, 1), "iso_year=1959/week=53", dt.datetime(1959, 12, 28), dt.datetime(1960, 1, 4)),
    # times of day that some zone's clock skips or repeats
    ("hour", dt.datetime(2024, 3, 10, 2, 30), "year=2024/month=3/day=10/hour=2", dt.datetime(2024, 3, 10, 2), dt.datetime(2024, 3, 10, 3)),
    ("minute", dt.datetime(2024, 11, 3, 1, 15), "year=2024/month=11/day=3/hour=1/minute=15", dt.datetime(2024, 11, 3, 1, 15), dt.datetime(2024, 11, 3, 1, 16)),
]


@pytest.mark.parametrize(("granularity", "at", "path", "start", "until"), VECTORS)
def test_partition_vectors(granularity, at, path, start, until):
    spec = TimePartition("at", granularity)
    p = spec.for_timestamp(at)
    assert p.path == path == spec.path(at)
    assert spec.parse(path) == p
    assert (p.start, p.until) == (spec.encode(start), spec.encode(until))


BAD_PATHS = [
    ("month", "month=4/year=1999"),  # another order
    ("month", "year=1999/month=4/day=1"),  # a level too many
    ("hour", "year=1999/month=4/day=1"),  # a level too few
    ("day", "year=1999/month=4/month=4"),  # a level twice
    ("day", "iso_year=1999/week=4"),  # another granularity's levels
    ("month", "year=1999/month=04"),  # a zero before a number
    ("month", "year=1999/month=+4"),
    ("month", "year=1999/month= 4"),
    ("month", "year=1999/month=4/"),
    ("month", "/year=1999/month=4"),
    ("month", "year=1999/month="),
    ("month", "year=1999/month=13"),
    ("month", "year=1999/month=0"),
    ("day", "year=2023/month=2/day=29"),  # no such day
    ("hour", "year=2023/month=2/day=1/hour=24"),
    ("minute", "year=2023/month=2/day=1/hour=1/minute=60"),
    ("week", "iso_year=2019/week=53"),  # a year of 52 weeks
    ("week", "iso_year=2019/week=0"),
    ("month", "year=0/month=4"),
    ("day", ""),
    ("day", None),
]


@pytest.mark.parametrize(("granularity", "path"), BAD_PATHS)
def test_parse_rejects(granularity, path):
    fails("invalid_argument", TimePartition("at", granularity).parse, path)


@settings(max_examples=150, deadline=None)
@given(st.datetimes(dt.datetime(1902, 1, 1), dt.datetime(2200, 1, 1)), st.sampled_from(GRANULARITIES), st.sampled_from(["second", "millisecond", "microsecond"]))
def test_partition_properties(at, granularity, unit):
    spec = TimePartition("at", granularity, unit)
    p = spec.for_timestamp(at)
    assert p.start <= spec.encode(at) < p.until
    assert spec.parse(p.path) == p
    assert spec.for_timestamp(p.until).start == p.until
    assert spec.for_timestamp(p.until - 1) == p
    if granularity == "week":
        iso = at.isocalendar()
        assert p.path == f"iso_year={iso[0]}/week={iso[1]}"


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kolkata"])
def zone(request, spark):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_columns_equal_values(spark, zone):
    """Columns give what single values give, from whole numbers, zoned and unzoned timestamps alike, in any session zone."""
    rng = random.Random(8)
    moments = [dt.datetime(1950, 1, 1) + dt.timedelta(seconds=rng.randint(0, 4 * 10**9), microseconds=rng.randint(0, 999_999)) for _ in range(100)] + [v[1] for v in VECTORS] + [dt.datetime(y, 12, 31, 23) for y in range(2000, 2030)]
    moments += [dt.datetime(2024, m, d, h, 30) for m, d in ((3, 10), (11, 3)) for h in range(24)]
    number = TimePartition("at", "day").encode
    df = spark.createDataFrame([(m, number(m)) for m in moments], "ts timestamp_ntz, number long")
    df = df.withColumns({"zoned": F.timestamp_micros("number"), "again": TimePartition("number", "day").timestamp(integer=True)})
    assert df.where("ts <> again").count() == 0
    for g in GRANULARITIES:
        spec = TimePartition("ts", g)
        ts = spec.timestamp(F.col("zoned"))
        path = spec.path_column(ts)
        for r in df.select("number", path.alias("p"), *(spec.encoded(x).alias(n) for n, x in (("a", spec.truncated(spec.timestamp())), ("b", spec.until(ts)), ("c", spec.parsed_column(path)), ("own", ts)))).collect():
            want = spec.for_timestamp(r["number"])
            assert (r["p"], r["a"], r["b"], r["c"], r["own"]) == (want.path, want.start, want.until, want.start, r["number"])
    for g in GRANULARITIES:
        bad = spark.createDataFrame([(p,) for k, p in BAD_PATHS if k == g] + [("x",), (None,), ("year=99999999999/month=1",)], "p string")
        assert {r[0] for r in bad.select(TimePartition("ts", g).parsed_column(F.col("p"))).collect()} == {None}


def test_encoded_units(spark):
    values = [-1001, -1000, -1, 0, 1, 999, 1000, 10**15 + 999_999]
    df = spark.createDataFrame([(v,) for v in values], "m long")
    ts = TimePartition("m", "day").timestamp(integer=True)
    for unit, per in (("second", 10**6), ("millisecond", 1000), ("microsecond", 1)):
        assert [r[0] for r in df.select(TimePartition("m", "day", unit).encoded(ts)).collect()] == [v // per for v in values]
    nanos = TimePartition("m", "day", "nanosecond")
    assert [r[0] for r in df.select(nanos.encoded(nanos.timestamp(integer=True))).collect()] == [v // 1000 * 1000 for v in values]


def test_plan():
    spec = TimePartition("at", "hour")
    at = lambda h, m=0, s=0: dt.datetime(2026, 8, 3, h, m, s)
    assert [p.path[-2:] for p in spec.plan(at(12, 59, 59), at(14))] == ["12", "13"]
    assert spec.plan(at(12), at(12)) == []
    fails("invalid_argument", spec.plan, at(13), at(12))
    fails("invalid_argument", spec.plan, at(12), at(15), max_partitions=2)
    assert len(spec.plan(at(12), at(14), max_partitions=2)) == 2
    fails("invalid_argument", TimePartition("at", "day").for_timestamp, 2**63 - 1)
    fails("invalid_argument", TimePartition, "at", "year")
    fails("invalid_argument", TimePartition, "at", "day", "minute")
    fails("invalid_argument", TimePartition, "", "day")


def test_plan_condition(spark):
    """The condition on the numbers picks exactly the planned partitions."""
    rng = random.Random(9)
    for g in GRANULARITIES:
        spec = TimePartition("at", g)
        step = {"minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 31 * 86400}[g]
        base = dt.datetime(2020, 12, 20)
        every = spec.plan(base - dt.timedelta(seconds=5 * step), base + dt.timedelta(seconds=40 * step))
        rows = [(p.path, *(int(x.partition("=")[2]) for x in p.path.split("/"))) for p in every]
        df = spark.createDataFrame(rows, "path string, " + ", ".join(f"{s} int" for s in SEGMENTS[g]))
        for _ in range(3):
            a = base + dt.timedelta(seconds=rng.randint(0, 20 * step))
            b = a + dt.timedelta(seconds=rng.randint(1, 15 * step))
            assert {r["path"] for r in df.where(spec.condition(a, b)).collect()} == {p.path for p in spec.plan(a, b)}
        assert spec.condition(base, base) is None


# --- zstd


def test_zstd():
    data = b"compressible-payload-" * 8192
    assert zstd.decompress(zstd.compress(data), len(data)) == data
    assert zstd.decompress(zstd.compress([], -3), 0) == b""
    assert zstd.decompress(zstd.compress(b"first") + zstd.compress(b"second"), 11) == b"firstsecond"
    assert zstd.compress([b"a", ["b", 99]]) == zstd.compress(b"abc")
    fails("invalid_argument", zstd.decompress, zstd.compress(b"x" * 100), 99)
    fails("invalid_argument", zstd.decompress, zstd.compress(bytes(1 << 20)), 1000)
    fails("invalid_argument", zstd.compress, b"", 23)
    fails("invalid_argument", zstd.compress, 1.5)
    fails("invalid_argument", zstd.decompress, b"x", -1)
    fails("invalid_argument", zstd.decompress, b"x", 2**32)
    for bad in (b"", b"not a frame", zstd.compress(data)[:-4], zstd.compress(b"x") + b"rest"):
        fails("malformed_data", zstd.decompress, bad, 1 << 20)
    no_size = zstandard.ZstdCompressor(write_content_size=False).compress(data)
    assert zstd.decompress(no_size, len(data)) == data


def test_zstd_columns(spark):
    df = spark.createDataFrame([(b"x" * 50,), (None,), (b"",)], "v binary")
    out = df.select("v", zstd.decompress_column(zstd.compress_column(F.col("v"), 5), 50).alias("w")).collect()
    assert all(r["v"] == r["w"] for r in out)


# --- errors


def test_errors_hide_their_cause():
    assert len(CATEGORIES) == 10
    e = translated("read", RuntimeError("[PATH_NOT_FOUND] Path does not exist: s3a://secret-bucket/key"))
    assert e.category == "not_found" and "secret" not in e.message and "secret" not in repr(e)
    assert translated("read", RuntimeError("java.net.SocketTimeoutException")).retryable
    assert EngineError("odd", "x", "y").category == "unknown"
