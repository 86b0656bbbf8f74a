import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.errors import EngineError
from tidemark.functions.types import Field, Schema
from tidemark.operators import stress, telemetry
from tidemark.operators.batch import Batch
from tidemark.operators.dataset import Dataset
from tidemark.operators.writer import open_writer, write
from tidemark.sources import files
from tidemark.sources.store import Store, error_probe, resource_snapshot, s3_settings, status
from tidemark.streaming.writer import write_stream

from .test_functions import fails

UTC = dt.timezone.utc


# --- store


def test_objects(store):
    m = store.put("x/y/z.dat", [b"ab", [], ["cd", [b"efg"]], b""])
    assert (m.key, m.size) == ("x/y/z.dat", 7) and store.head("x/y/z.dat") == m
    assert store.read("x/y/z.dat") == b"abcdefg"
    assert [store.read_range("x/y/z.dat", *r) for r in ((0, 0), (0, 3), (3, 4), (6, 50), (7, 5))] == [b"", b"abc", b"defg", b"g", b""]
    for bad in ((8, 0), (-1, 1), (0, -1), (0, 1.0), (True, 1)):
        fails("invalid_argument", store.read_range, "x/y/z.dat", *bad)
    store.put("x/y/z.dat", b"")
    assert store.read("x/y/z.dat") == b"" and store.head("x/y/z.dat").size == 0
    assert store.head("x/y/z.dat").modified_unix_ns > 10**18
    store.delete("x/y/z.dat")
    for f in (store.head, store.read, store.delete):
        fails("not_found", f, "x/y/z.dat")
    fails("not_found", store.head, "x")  # a folder


def test_range_bound(spark, tmp_path):
    s = Store.open(spark, "local", str(tmp_path), max_range_bytes=3)
    s.put("long", bytes(range(11)))  # read whole by four ranges
    assert s.read("long") == bytes(range(11)) and s.read_range("long", 9, 3) == b"\x09\x0a"
    fails("invalid_argument", s.read_range, "long", 0, 4)
    for bad in (0, True, 2**33, "3"):
        fails("invalid_argument", lambda b=bad: Store.open(spark, "local", str(tmp_path), max_range_bytes=b))


@pytest.mark.parametrize("key", ["/etc/x", "..", "x/..", "../../x", "x/./y", "x//y", "x/", "\\\\host\\x", "x\\y", "d:x", "Z:/x", "nul\0l", "", None, 7, b"x"])
def test_bad_keys(store, key):
    for f in (store.head, store.read, store.delete, store.open_writer):
        fails("invalid_argument", f, key)


def test_writers(store):
    before = resource_snapshot()
    a, b = store.open_writer("k"), store.open_writer("k")
    a.write(b"a")
    b.write(b"b")
    assert resource_snapshot()["writers"] == before["writers"] + 2
    b.publish()
    a.publish()  # the one that ends last counts
    assert store.read("k") == b"a"
    c = store.open_writer("k")
    c.write(b"c")
    c.cancel()
    fails("invalid_argument", c.write, b"c")
    fails("invalid_argument", c.publish)
    assert store.read("k") == b"a" and resource_snapshot() == before
    assert [m.key for m in store.list()] == ["k"]


def test_listing(store, tmp_path):
    for k in ("hour=1/x", "hour=10/x", "hour=1/deep/y", "z"):
        store.put(k, b"1")
    assert [m.key for m in store.list("hour=1")] == ["hour=1/deep/y", "hour=1/x"]
    assert store.list("hour=") == [] and store.list("none") == []
    assert len(store.list()) == 4
    assert sorted(r["key"] for r in store.listing("hour=1").collect()) == ["hour=1/deep/y", "hour=1/x"]


def test_links_do_not_leave_the_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "secret").write_bytes(b"s")
    os.symlink(tmp_path / "secret", tmp_path / "in" / "link")
    s = Store.open(spark, "local", str(tmp_path / "in"))
    fails("permission_denied", s.read, "link")
    assert s.list() == []


def test_open(spark, tmp_path):
    fails("not_found", Store.open, spark, "local", str(tmp_path / "none"))
    (tmp_path / "f").write_bytes(b"")
    fails("invalid_argument", Store.open, spark, "local", str(tmp_path / "f"))
    fails("invalid_argument", Store.open, spark, "ftp", "x")
    fails("invalid_argument", Store.open, spark, "local", str(tmp_path), nope=1)
    a, b = (Store.open(spark, "local", str(tmp_path)) for _ in range(2))
    assert a.identity != b.identity and str(tmp_path) not in repr(a)
    assert status(spark)["ok"] and status(spark)["api_version"] == 2
    fails("native_failure", error_probe)


def test_s3_settings():
    uri, conf = s3_settings(bucket="My-Bucket", prefix="a/b", endpoint="https://s3.example.org:9000", region="eu-1", path_style=True, access_key_id="id", secret_access_key="k", max_retries=2)
    assert uri == "s3a://my-bucket/a/b"
    own = {k.removeprefix("fs.s3a.bucket.my-bucket."): v for k, v in conf.items()}
    assert own["endpoint"] == "https://s3.example.org:9000" and own["path.style.access"] == "true" and own["access.key"] == "id" and own["attempts.maximum"] == "3"
    other = s3_settings(bucket="abc")[1]
    assert not any("key" in k for k in other) and not set(other) & set(conf)  # two buckets share no setting
    for bad in (
        {}, {"bucket": "x"}, {"bucket": "abc", "endpoint": "https://h/path"}, {"bucket": "abc", "endpoint": "http://h"}, {"bucket": "abc", "endpoint": "https://u@h"}, {"bucket": "abc", "multipart_part_size": 1}, {"bucket": "abc", "max_concurrency": 0},
        {"bucket": "abc", "credential_provider": "explicit"}, {"bucket": "abc", "credential_provider": "standard", "access_key_id": "x"}, {"bucket": "abc", "odd": 1}, {"bucket": "abc", "prefix": "../x"},
    ):
        fails("invalid_argument", lambda b=bad: s3_settings(**b))


# --- files

BASE = dt.datetime(2026, 8, 3, 10, 0, 0, 123_456, tzinfo=UTC)
EVENTS = [{"accepted": i % 2 == 0, "event_type": "t", "occurred_at": BASE + dt.timedelta(seconds=i), "payload": "{}", "score": i / 2, "sequence": i, "space_id": "s"} for i in range(3)]


@pytest.mark.parametrize("codec", ["uncompressed", "snappy", "zstd", "gzip", "lz4_raw"])
def test_file_round_trip(store, codec):
    m = write(store, "e/part.parquet", EVENTS, compression=codec)
    assert m.size == store.head("e/part.parquet").size
    assert files.read(store, "e/part.parquet") == EVENTS
    s = files.schema(store, "e/part.parquet")
    assert s.names == sorted(EVENTS[0]) and not s["score"].nullable
    found = files.file_stats(store, "e/part.parquet")
    assert found["codecs"] == [{"lz4_raw": "lz4"}.get(codec, codec)] and found["writer"]["writer.compression"] == codec


def test_projection_and_predicate(store):
    write(store, "k", {"id": list(range(10)), "name": [f"n{i}" for i in range(10)], "score": [float(i) for i in range(10)]})
    assert files.scan(store, "k", columns=["score", "id"]).columns == ["id", "score"]  # the file's order
    assert files.read(store, "k", columns=["name"], where=("gte", "id", 8)) == [{"name": "n8"}, {"name": "n9"}]
    df = files.scan(store, "k", columns=["name"], where=("gte", "id", 8))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,8)" in plan and "ReadSchema: struct<id:bigint,name:string>" in plan
    for bad in ({"columns": []}, {"columns": ["id", "id"]}, {"columns": ["x"]}, {"columns": "id"}, {"batch_size": 0}, {"prefetch_depth": 17}, {"odd": 1}, {"where": ("gt", "id", "x")}):
        fails("invalid_argument", lambda b=bad: files.read(store, "k", **b))
    fails("not_found", files.read, store, "none")


def test_writer_options(store):
    for bad in ({"compression": "brotli"}, {"flush": True}, {"schema": 1}, {"batch_rows": 0}, {"max_row_group_rows": 2**32}, {"statistics": "page"}):
        fails("invalid_argument", lambda b=bad: write(store, "k", EVENTS, **b))
    assert store.list() == []
    write(store, "k", {"id": list(range(100))}, max_row_group_rows=30, statistics="none")
    found = pq.ParquetFile(store.path("k")).metadata
    assert [found.row_group(i).num_rows for i in range(found.num_row_groups)] == [30, 30, 30, 10]
    assert found.row_group(0).column(0).statistics is None
    write(store, "k", {"id": list(range(100))}, max_row_group_rows=25)
    assert files.file_stats(store, "k", ("gte", "id", 60))["row_groups_skipped"] == 2


def test_incremental_writer(store):
    schema = Schema.of([("id", "int64", False), ("payload", "binary")])
    w = open_writer(store, "k", schema, max_batch_rows=3)
    batch = Batch.new(schema, {"id": [1, 2], "payload": [b"\x01", None]})
    w.write_batch(batch)
    w.write_batch(batch)
    fails("invalid_argument", w.write_batch, Batch.new(schema, {"id": [1] * 4, "payload": [None] * 4}))
    fails("invalid_argument", w.write_batch, Batch.new(Schema.of([("id", "int64")]), {"id": [1]}))
    assert store.list() == [] and w.stats()["rows"] == 4
    w.close()
    fails("invalid_argument", w.close)
    assert files.read(store, "k") == 2 * [{"id": 1, "payload": b"\x01"}, {"id": 2, "payload": None}]
    w = open_writer(store, "k2", schema)
    w.write_batch(batch)
    w.cancel()
    assert [m.key for m in store.list()] == ["k"]
    assert batch.row_count == 2 and batch.column("id") == [1, 2] and batch.to_rows()[1] == {"id": 2, "payload": None}
    for bad in ({"id": [1]}, {"id": [1], "payload": []}, {"id": [None], "payload": [b""]}):
        fails("invalid_argument", Batch.new, schema, bad)


def test_empty_with_schema(store):
    schema = Schema.of([("id", "int64", False), ("note", "string")])
    write(store, "k", [], schema)
    assert files.read(store, "k") == [] and files.schema(store, "k") == schema


ALL_TYPES = Schema.of(
    [
        ("flag", "boolean"), ("signed", "int64", False), ("unsigned", "uint32"), ("big", "uint64"), ("ratio", "float64", False), ("name", "string"), ("payload", "binary"), ("fixed", ("fixed_binary", 2)), ("day", "date32", False),
        ("clock", ("time", "microsecond", 64), False), ("watch", ("time", "millisecond", 32)), ("observed_at", ("timestamp", "microsecond", "UTC")), ("local", ("timestamp", "millisecond", None)), ("nanos", ("timestamp", "nanosecond", "UTC")), ("amount", ("decimal", 128, 10, 2)), ("wide", ("decimal", 256, 50, 3)),
        ("numbers", ("list", Field("element", "int32")), False), ("pair", ("fixed_list", Field("element", "float32"), 2)), ("details", ("struct", (Field("label", "string"), Field("count", "int32", False))), False), ("nothing", "null"),
    ]
)


def test_all_types(store):
    rows = [
        {"flag": True, "signed": -1, "unsigned": 2**32 - 1, "big": 2**64 - 1, "ratio": 0.5, "name": "a", "payload": b"a\x00", "fixed": b"xy", "day": 19_000, "clock": 5, "watch": 7, "observed_at": BASE, "local": -1, "nanos": 10**18 + 1, "amount": "12345", "wide": "-1" + "0" * 40, "numbers": [1, None, 3], "pair": [0.5, None], "details": {"label": None, "count": 1}, "nothing": None},
        {"flag": None, "signed": 2, "unsigned": None, "big": None, "ratio": 1.0, "name": None, "payload": None, "fixed": None, "day": 0, "clock": 0, "watch": None, "observed_at": None, "local": None, "nanos": None, "amount": None, "wide": None, "numbers": [], "pair": None, "details": {"label": "x", "count": 2}, "nothing": None},
    ] * 3
    write(store, "k", rows, ALL_TYPES, max_row_group_rows=3)
    assert [b.row_count for b in files.stream(store, "k", batch_size=2)] == [2, 2, 2]
    assert files.schema(store, "k") == ALL_TYPES
    got = files.read(store, "k")
    for a, b in zip(got, rows, strict=True):
        assert a == b


def test_unsupported_and_malformed(store, tmp_path):
    pq.write_table(pa.table({"m": pa.array([[("a", 1)]], pa.map_(pa.string(), pa.int32()))}), tmp_path / "map.parquet")
    fails("unsupported", files.schema, store, "map.parquet")
    fails("unsupported", files.read, store, "map.parquet")
    assert files.scan(store, "map.parquet", strict=False) is not None
    store.put("secret-name.parquet", b"not parquet at all")
    e = fails("malformed_data", files.read, store, "secret-name.parquet")
    assert "secret" not in str(e) and "secret" not in repr(e)


def test_stream_is_lazy_and_closes(store):
    write(store, "k", {"id": list(range(100))})
    before = resource_snapshot()
    s = files.stream(store, "k", batch_size=10)
    assert s.schema.names == ["id"]
    for b in s:
        assert b.row_count == 10
        break
    s.close()
    s.close()
    fails("invalid_argument", list, s)
    assert s.stats()["row_groups"] == 1
    import gc

    gc.collect()
    assert resource_snapshot() == before


# --- datasets

HOUR = Schema.of([("at", "int64", False), ("id", "int64", False), ("offset", "int64", False), ("payload", "string", False)])
START = dt.datetime(2026, 8, 3, 12)


def micros(h, m=0, s=0):
    return int((dt.datetime(2026, 8, 3, h, m, s) - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6


def at(h, m=0, s=0):
    return dt.datetime(2026, 8, 3, h, m, s)


@pytest.fixture()
def hours(store):
    ds = Dataset.new(store, "log", HOUR, ("time", "at", "hour"))
    times = [(12, 0, 0), (12, 30, 0), (12, 59, 59), (13, 0, 0), (13, 29, 59), (13, 30, 0)]
    ds.write([{"at": micros(*t), "id": i + 1, "offset": 10 * (i + 1), "payload": "p"} for i, t in enumerate(times)], max_rows_per_file=2)
    return ds


def test_range_read(hours):
    assert hours.read(at(12, 30), at(13, 30), columns=["id"], where=("gte", "offset", 30)) == [{"id": 3}, {"id": 4}, {"id": 5}]
    assert [r["id"] for r in hours.read(at(12), at(14))] == [1, 2, 3, 4, 5, 6]
    assert hours.read(at(12), at(12)) == [] and hours.read(at(1), at(2)) == []
    assert [r["id"] for r in hours.read(micros(13, 29, 59), micros(13, 30))] == [5]
    fails("invalid_argument", hours.read, at(13), at(12))
    fails("invalid_argument", hours.read, at(12))
    fails("invalid_argument", hours.stream, at(12), at(20), max_partitions=3)
    fails("invalid_argument", hours.read, at(12), at(13), columns=["none"])
    fails("invalid_argument", hours.read, at(12), at(13), where=("gt", "offset", 1.0))


def test_scan_is_pruned(hours):
    plan = hours.scan(at(12, 30), at(13, 30), columns=["id"], where=("gte", "offset", 30))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(offset,30)" in plan and "PartitionFilters: [isnotnull" in plan
    assert "payload" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_misplaced_rows_and_stray_objects(hours):
    write(hours.store, "log/year=2026/month=8/day=3/hour=12/part-x.parquet", [{"at": micros(11, 59, 59), "id": 99, "offset": 0, "payload": "x"}], HOUR)
    hours.store.put("log/year=2026/month=8/day=3/hour=12/README.txt", b"hello")
    hours.store.put("log/year=2026/month=8/day=3/hour=20/broken.parquet", b"broken")  # not in the plan
    assert [r["id"] for r in hours.read(at(12), at(14))] == [1, 2, 3, 4, 5, 6]
    s = hours.stream(at(12), at(14), batch_size=2)
    assert sum(b.row_count for b in s) == 6
    found = s.stats()
    assert found["planned_partitions"] == 2 and found["skipped_objects"] == 1 and found["discovered_files"] == 5


def test_sibling_prefixes(store):
    ds = Dataset.new(store, "log", HOUR, ("time", "at", "hour"))
    ds.write([{"at": micros(10), "id": 1, "offset": 0, "payload": ""}])
    assert len(ds.read(at(1), at(12))) == 1


@pytest.mark.parametrize("granularity", ["minute", "hour", "day", "week", "month"])
@pytest.mark.parametrize("codec", ["zstd", "snappy", "uncompressed"])
def test_matrix(store, granularity, codec):
    schema = Schema.of([("accepted", "boolean", False), ("occurred_at", ("timestamp", "microsecond"), False), ("payload", "string", False), ("sequence", "int64", False)])
    ds = Dataset.new(store, "x", schema, ("time", "occurred_at", granularity), compression=codec)
    rows = [{"accepted": True, "occurred_at": BASE + dt.timedelta(hours=9 * i), "payload": "{}", "sequence": i} for i in range(4)]
    report = ds.write(rows)
    assert report.rows == 4 and report.bytes == sum(m.size for m in store.list("x"))
    assert {p.partition for p in report.parts} == {ds.time.path(r["occurred_at"]) for r in rows}
    assert ds.read(BASE, BASE + dt.timedelta(days=2)) == rows
    assert files.file_stats(store, report.parts[0].key)["codecs"] == [codec]


def test_report_rotation_and_late_rows(store):
    schema = Schema.of([("at", "int64", False), ("id", "int64", False)])
    ds = Dataset.new(store, "w", schema, ("time", "at", "hour"))
    r = ds.write([{"at": micros(12, 0, i), "id": i} for i in range(7)], max_rows_per_file=2)
    assert sorted(p.rows for p in r.parts) == [1, 2, 2, 2]
    assert min(p.min_timestamp for p in r.parts) == micros(12) and max(p.max_timestamp for p in r.parts) == micros(12, 0, 6)
    late = ds.write([{"at": micros(12, 1), "id": 8}, {"at": micros(14), "id": 9}])
    assert len(late.parts) == 2 and len(ds.read(at(12), at(15))) == 9
    assert ds.write([]).parts == ()
    assert not [m for m in store.list("w") if "staging" in m.key]


def test_rows_that_do_not_fit(store):
    schema = Schema.of([("at", ("timestamp", "microsecond")), ("id", "int64")])
    ds = Dataset.new(store, "w", schema, ("time", "at", "day"))
    e = fails("invalid_argument", ds.write, [{"at": None, "id": 1}, {"at": START, "id": 2}])
    assert e.details["published"] == [] and store.list() == []
    fails("invalid_argument", ds.write, [{"id": 1}])
    fails("invalid_argument", ds.write, [{"at": START, "id": 1}], odd=1)
    for bad in ({"partition_by": ("time", "none", "day")}, {"partition_by": ("id", "day")}, {"partition_by": ("time", "id", "year")}, {"compression": "gzip"}, {"timestamp_unit": "second"}):
        fails("invalid_argument", lambda b=bad: Dataset.new(store, "w", schema, **({"partition_by": ("time", "at", "day")} | b)))


def test_continuous_writer(store):
    schema = Schema.of([("at", "int64", False), ("id", "int64", False)])
    ds = Dataset.new(store, "w", schema, ("time", "at", "hour"))
    w = ds.open_writer(max_open_partitions=2)
    w.write({"at": micros(12), "id": 1})
    w.write([{"at": micros(13), "id": 2}])
    w.write({"at": [micros(14)], "id": [3]})
    w.write(Batch.new(schema, {"at": [micros(12, 5)], "id": [4]}))
    w.write(store.spark.createDataFrame([(micros(15), 5)], "at long, id long"))
    assert store.list() == [] and w.published == []
    assert w.close().rows == 5
    fails("invalid_argument", w.write, {"at": 1, "id": 1})
    w = ds.open_writer()
    w.write({"at": micros(15), "id": 6})
    w.cancel()
    assert [r["id"] for r in ds.read(at(12), at(16))] == [1, 4, 2, 3, 5]


def test_continuous_writer_is_bounded(store):
    schema = Schema.of([("at", "int64", False), ("id", "int64", False)])
    ds = Dataset.new(store, "w", schema, ("time", "at", "hour"))
    w = ds.open_writer(max_open_partitions=2, max_rows_per_file=3)
    for i in range(14):
        w.write({"at": micros(12 + i % 2, i), "id": i})
        assert w._rows < 6 and len(w.published) == len(store.list("w"))
    assert sum(p.rows for p in w._parts) == 12
    e = fails("invalid_argument", w.write, [{"at": micros(1), "id": "x"}])
    assert "published" not in e.details  # nothing was begun
    w.cancel()  # what is published stays
    assert sorted(r["id"] for r in ds.read(at(12), at(14))) == list(range(12))
    w = ds.open_writer(max_open_partitions=1, max_rows_per_file=2)
    w.write([{"at": micros(15), "id": 20}, {"at": micros(15), "id": 21}])
    w.write(store.spark.createDataFrame([(None, 22)], "at long, id long"))
    e = fails("invalid_argument", w.close)
    assert e.details["published"] == w.published and len(w.published) == 1
    assert [r["id"] for r in ds.read(at(15), at(16))] == [20, 21]


def staged(store):
    return [x for x in os.listdir(store.path("w")) if x.startswith("_staging")]


def test_continuous_writer_stages(store, monkeypatch):
    """Rows over many partitions leave the driver in time, but go to whole files by few jobs."""
    jobs, plain = [], Dataset._write
    monkeypatch.setattr(Dataset, "_write", lambda self, *a: jobs.append(1) or plain(self, *a))
    schema = Schema.of([("at", "int64", False), ("id", "int64", False)])
    ds = Dataset.new(store, "w", schema, ("time", "at", "hour"))
    w = ds.open_writer(max_open_partitions=2, max_rows_per_file=10)
    for i in range(0, 300, 5):
        w.write([{"at": micros(8 + j % 12, j % 60, j // 60), "id": j} for j in range(i, i + 5)])
        assert w._rows < 20 and len(w.published) == len(store.list("w")) and len(jobs) == (i >= 115) + (i >= 235)
    assert len(staged(store)) == 1
    report = w.close()
    assert report.rows == 300 and len(report.parts) == 36 and max(p.rows for p in report.parts) == 10 and len(jobs) == 3 and not staged(store)
    assert sorted(r["id"] for r in ds.read(at(8), at(20))) == list(range(300))
    w = ds.open_writer(max_open_partitions=1, max_rows_per_file=2)
    w.write([{"at": micros(8 + i), "id": 300 + i} for i in range(2)])
    assert len(staged(store)) == 1 and w._rows == 0
    w.cancel()
    assert not staged(store) and len(ds.read(at(8), at(20))) == 300
    w = ds.open_writer(max_open_partitions=1, max_rows_per_file=2)
    w.write([{"at": micros(8 + i), "id": 300 + i} for i in range(2)])
    w.write(store.spark.createDataFrame([(None, 302)], "at long, id long"))
    assert fails("invalid_argument", w.close).details["published"] == [] and not staged(store)


def test_continuous_writer_stages_all_types(store):
    """What went through the staged file is what one write gives."""
    names = [n for n in ALL_TYPES.names if n not in ("nothing", "wide")]  # not for datasets
    schema = ALL_TYPES.select(names)
    rows = [
        {"flag": True, "signed": 1, "unsigned": 2**32 - 1, "big": 2**64 - 1, "ratio": 0.5, "name": "a", "payload": b"a\x00", "fixed": b"xy", "day": 19_000, "clock": 5, "watch": 7, "observed_at": BASE, "local": -1, "nanos": 10**18 + 1, "amount": "12345", "numbers": [1, None, 3], "pair": [0.5, None], "details": {"label": None, "count": 1}},
        {"flag": None, "signed": 2**42, "unsigned": None, "big": None, "ratio": 1.0, "name": None, "payload": None, "fixed": None, "day": 0, "clock": 0, "watch": None, "observed_at": None, "local": None, "nanos": None, "amount": None, "numbers": [], "pair": None, "details": {"label": "x", "count": 2}},
    ]
    got = []
    for prefix in ("w", "v"):
        ds = Dataset.new(store, prefix, schema, ("time", "signed", "week"))
        if prefix == "v":
            ds.write(rows)
        else:
            w = ds.open_writer(max_open_partitions=1, max_rows_per_file=2)
            w.write(rows)
            assert len(staged(store)) == 1
            w.close()
        got.append(ds.read(0, 2**43))
    assert got[0] == got[1] and len(got[0]) == 2


def test_rotation_by_bytes(store):
    schema = Schema.of([("at", "int64", False), ("text", "string")])
    ds = Dataset.new(store, "w", schema, ("time", "at", "hour"), compression="uncompressed")
    sizes = [100, 900, 50, 50, 5000, 10, None, 980, 10, 10]  # the beginning tells nothing about the rest
    rows = [{"at": micros(12 + i % 2, i), "text": None if n is None else "x" * n} for i, n in enumerate(sizes * 4)]
    r = ds.write(rows, max_bytes_per_file=1024)
    assert r.rows == 40 and len(ds.read(at(12), at(14))) == 40
    for p in r.parts:
        texts = [x["text"] or "" for x in files.read(store, p.key)]
        assert sum(len(x) + 20 for x in texts) <= 1200 or len(texts) == 1
    assert max(p.rows for p in r.parts) > 2


def test_stream_lists_and_opens_on_demand(hours, monkeypatch):
    listed = []
    plain = Dataset._files
    monkeypatch.setattr(Dataset, "_files", lambda self, p: listed.append(p) or plain(self, p))
    s = hours.stream(at(0), at(23), batch_size=1)
    assert listed == []
    taken = [b.to_rows()[0]["id"] for _, b in zip(range(3), s)]
    found = s.stats()
    assert taken == [1, 2, 3] and len(listed) == 13 and (found["opened_files"], found["peak_active_files"], found["listed_partitions"], found["planned_partitions"]) == (2, 1, 13, 23)
    s.close()
    assert len(listed) == 13
    for depth in (2, 16):
        s = hours.stream(at(0), at(23), batch_size=1, prefetch_depth=depth)
        assert [b.to_rows()[0]["id"] for b in s] == [1, 2, 3, 4, 5, 6]
    s = hours.stream(at(0), at(23), batch_size=1, prefetch_depth=2)
    next(iter(s))
    import time

    time.sleep(3)
    s.close()
    assert s.stats()["opened_files"] <= 2  # one batch taken, two ahead and one in the hand


def test_ahead():
    made = []

    def items():
        for i in range(10):
            made.append(i)
            yield i
        raise ValueError("end")

    import time

    it = files.ahead(items(), 3)
    assert next(it) == 0
    time.sleep(0.5)
    assert len(made) == 5  # one taken, three ready, one waiting to be
    with pytest.raises(ValueError, match="end"):
        list(it)
    it = files.ahead(items(), 2)
    next(it)
    it.close()


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
@pytest.mark.parametrize("kind", ["int64", ("timestamp", "microsecond", "UTC"), ("timestamp", "microsecond", None)], ids=str)
def test_datasets_do_not_depend_on_the_session_zone(spark, store, zone, kind):
    schema = Schema.of([("at", kind, False), ("id", "int64", False)])
    ds = Dataset.new(store, "z", schema, ("time", "at", "hour"))
    start = dt.datetime(2024, 3, 9, 20)  # over a night in which New York's clock skips an hour
    number = ds.time.encode
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(number(start) + i * 1_800_000_000, i) for i in range(40)], "m long, id long")
        moment = F.col("m") if kind == "int64" else F.timestamp_micros("m") if kind[2] else ds.time.timestamp(F.col("m"), integer=True)
        r = ds.write(df.select(moment.alias("at"), "id"))
        assert r.rows == 40 and {p.partition for p in r.parts} == {ds.time.path(start + dt.timedelta(minutes=30 * i)) for i in range(40)}
        assert min(number(p.min_timestamp) for p in r.parts) == number(start)
        assert [x["id"] for x in ds.read(start, start + dt.timedelta(hours=20), columns=["id"])] == list(range(40))
        assert [x["id"] for x in ds.read(start + dt.timedelta(hours=3), start + dt.timedelta(hours=8), columns=["id"])] == list(range(6, 16))
        assert ds.scan(start + dt.timedelta(hours=3), start + dt.timedelta(hours=8)).count() == 10
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_order_when_names_clash(store):
    schema = Schema.of([("at", "int64", False), ("hour", "int64", False)])
    ds = Dataset.new(store, "c", schema, ("time", "at", "hour"))
    ds.write([{"at": micros(h), "hour": 100 + h} for h in (10, 2, 9, 23)])
    want = [102, 109, 110, 123]  # by number, not by text
    assert [r["hour"] for r in ds.read(at(0), at(23, 30))] == want
    assert [r["hour"] for b in ds.stream(at(0), at(23, 30)) for r in b.to_rows()] == want


def test_streaming_writer(spark, store, tmp_path):
    schema = Schema.of([("at", ("timestamp", "microsecond"), False), ("id", "int64", False)])
    ds = Dataset.new(store, "s", schema, ("time", "at", "hour"))
    rows = spark.createDataFrame([(START, 1), (at(13), 2)], "at timestamp, id long")
    rows.write.parquet(f"{tmp_path}/in")
    seen = []
    for _ in range(2):  # the second time there is nothing new
        write_stream(ds, spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/ckpt", on_report=lambda n, r: seen.append(r.rows)).awaitTermination()
    assert seen == [2] and sorted(r["id"] for r in ds.read(at(12), at(14))) == [1, 2]
    fails("invalid_argument", write_stream, ds, rows, "x")


# --- telemetry and stress


def test_telemetry(store):
    seen = []
    for i, event in enumerate(telemetry.EVENTS):
        telemetry.attach(f"h{i}", event, lambda e, m, d: seen.append((e, m, d)))
    try:
        write(store, "private/key", {"secret_column": [1, 2]})
        list(files.stream(store, "private/key"))
        with pytest.raises(EngineError):
            files.read(store, "private/none")
        s = files.stream(store, "private/key", batch_size=1)
        for _ in s:
            break
        s.close()
        assert {e for e, _, _ in seen} >= {("operation", "start"), ("operation", "stop"), ("storage",), ("read", "batch"), ("write", "batch"), ("read", "stats"), ("write", "stats")}
        assert "private" not in repr(seen) and "secret" not in repr(seen)
        assert any(d.get("error_category") == "not_found" for _, _, d in seen)
        fails("conflict", telemetry.attach, "h0", ("storage",), print)
        fails("invalid_argument", telemetry.attach, "x", ("odd",), print)
    finally:
        for i in range(len(telemetry.EVENTS)):
            telemetry.detach(f"h{i}")
    fails("not_found", telemetry.detach, "h0")


def test_stress(spark, hours, tmp_path):
    r = stress.measure(spark, str(tmp_path / "log"), iterations=3, warmup=1, batch_size=2)
    assert (r.rows, r.iterations, r.files, r.path_kind) == (18, 3, 4, "folder") and r.min_ms <= r.avg_ms <= r.max_ms
    assert stress.run(spark, str(tmp_path / "log"), iterations=1, warmup=0) == "ok"
    fails("not_found", stress.measure, spark, str(tmp_path / "none"))
    fails("invalid_argument", stress.measure, spark, str(tmp_path / "log"), iterations=0)
    fails("invalid_argument", stress.measure, spark, str(tmp_path / "log"), odd=0)
