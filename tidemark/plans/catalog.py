"""Queries over the test tables, one or more for each operator, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import zstd
from ..functions.predicate import compare
from ..functions.timepart import GRANULARITIES, SEGMENTS, TimePartition
from ..functions.types import UNITS, Field, Schema
from ..operators import stress, telemetry
from ..operators.dataset import Dataset
from ..operators.writer import open_writer, write
from ..sources import files
from ..sources.store import Store, error_probe, resource_snapshot, s3_settings, status
from ..streaming.writer import write_stream

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
RANGE = (dt.datetime(2024, 1, 3, 5), dt.datetime(2024, 1, 5))

Query = Callable[[SparkSession, str], DataFrame]


def scratch(spark: SparkSession) -> str:
    """A new folder for what a query writes: in the shared checkpoint folder, or a folder of this machine where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    path = f"{named or tempfile.gettempdir()}/tidemark-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jpath)
    return path


def scratch_store(spark: SparkSession) -> Store:
    return Store.open(spark, "local", scratch(spark))


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a scan: of the one file by its key, or of a folder of files by Spark."""
    store = Store.open(spark, "local", sf_dir)
    key = f"{name}.parquet"
    jpath = store._jpath(key)
    if store._fs().getFileStatus(jpath).isDirectory():
        return spark.read.parquet(store.path(key))
    return files.scan(store, key, strict=False)


def selected(spark: SparkSession, sf_dir: str, name: str, columns=None, where=None) -> DataFrame:
    """A projection and predicate of a table, by the rules of a scan."""
    store = Store.open(spark, "local", sf_dir)
    key = f"{name}.parquet"
    if not store._fs().getFileStatus(store._jpath(key)).isDirectory():
        return files.scan(store, key, columns=columns, where=where)
    df = spark.read.parquet(store.path(key))
    own = Schema.from_spark(df.schema)
    if where is not None:
        df = df.where(compare(where, own))
    return df.select(*files.projected(own, columns))


EVENTS = Schema.of([("event_id", "int64"), ("ts", ("timestamp", "microsecond", None)), ("user_id", "int64"), ("event_type", "string"), ("value", "float64"), ("props", "string")])


def events_dataset(spark: SparkSession, granularity: str = "day", compression: str = "zstd", schema: Schema = EVENTS) -> Dataset:
    return Dataset.new(scratch_store(spark), "event_log", schema, ("time", "ts", granularity), "microsecond", compression)


_written: dict[tuple, Dataset] = {}


def written(spark: SparkSession, sf_dir: str, granularity: str = "day", compression: str = "zstd", **options) -> Dataset:
    """All events as a dataset; without options it is written once a session, and read by every query that asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, granularity, compression)
    if not options and key in _written:
        return _written[key]
    ds = events_dataset(spark, granularity, compression)
    ds.write(source(spark, sf_dir, "events").select(*EVENTS.names), **options)
    return ds if options else _written.setdefault(key, ds)


@contextmanager
def zone(spark: SparkSession, name: str):
    """Another session time zone, for what is planned or run inside."""
    own = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", name)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", own)


def outcome(call: Callable) -> str:
    """What a call comes to: ok, or its error's category."""
    try:
        call()
    except EngineError as e:
        return e.category
    return "ok"


def outcomes(spark: SparkSession, cases: dict[str, Callable]) -> DataFrame:
    return spark.createDataFrame([(name, outcome(call)) for name, call in cases.items()], "test_case string, outcome string")


ALL = (dt.datetime(2023, 12, 1), dt.datetime(2024, 3, 1))

_FILTERS = {
    "int": ("lineitem", "l_partkey", 100, "100"),
    "float": ("lineitem", "l_discount", 0.05, "0.05::DOUBLE"),
    "utf8": ("part", "p_brand", "Brand#12", "'Brand#12'"),
}
_SQL_OPS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "="}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for t in TABLES:
        out[f"q_scan_{t}"] = lambda s, d, t=t: source(s, d, t)
    out["q_schema"] = lambda s, d: s.createDataFrame([(t, i, f.name, f.dataType.simpleString()) for t in TABLES for i, f in enumerate(source(s, d, t).schema.fields)], "table_name string, position long, column_name string, column_type string")
    out["q_project_file_order"] = lambda s, d: selected(s, d, "events", ["value", "user_id", "event_id"])
    for kind, (t, c, v, _) in _FILTERS.items():
        for op in _SQL_OPS:
            out[f"q_filter_{op}_{kind}"] = lambda s, d, t=t, c=c, v=v, op=op: selected(s, d, t, where=(op, c, v))
    out["q_filter_hidden_col"] = lambda s, d: selected(s, d, "events", ["event_id", "value"], ("gte", "user_id", 50))
    out["q_filter_eq_bool"] = _eq_bool
    out["q_filter_null"] = _filter_null
    out["q_filter_nan"] = _filter_nan
    out["q_early_halt"] = _early_halt

    out["q_range_proj_pred"] = lambda s, d: written(s, d).scan(*RANGE, columns=["user_id", "event_id"], where=("gte", "user_id", 50))
    for g in GRANULARITIES:
        out[f"q_range_{g}"] = (lambda s, d, g=g: written(s, d, g).scan(*RANGE)) if g != "minute" else _minutes
    out["q_range_boundary"] = _boundary
    out["q_range_empty"] = lambda s, d: written(s, d).scan(RANGE[0], RANGE[0])
    out["q_range_missing"] = lambda s, d: written(s, d).scan(dt.datetime(2030, 1, 1), dt.datetime(2030, 1, 3))
    out["q_range_where_ts"] = lambda s, d: written(s, d).scan(*RANGE, where=("lt", "ts", dt.datetime(2024, 1, 4)))
    out["q_range_parts"] = lambda s, d: written(s, d).parts(*RANGE).groupBy().agg(F.sum("rows").alias("rows"), F.min("min_timestamp").alias("min_timestamp"), F.max("max_timestamp").alias("max_timestamp"))
    out["q_range_name_clash"] = _clash
    out["q_range_prefix_siblings"] = _siblings
    out["q_stray_objects"] = _stray

    for g in GRANULARITIES:
        spec = TimePartition("ts", g)
        out[f"q_part_path_{g}"] = lambda s, d, p=spec: source(s, d, "events").select("event_id", p.path_column(F.col("ts")).alias("path"))
        out[f"q_part_bounds_{g}"] = lambda s, d, p=spec: source(s, d, "events").select("event_id", p.truncated(F.col("ts")).alias("start"), p.until(F.col("ts")).alias("until"))
        out[f"q_parse_path_{g}"] = lambda s, d, p=spec: source(s, d, "events").select("event_id", p.parsed_column(p.path_column(F.col("ts"))).alias("start"))
        out[f"q_plan_{g}"] = lambda s, d, p=spec: s.createDataFrame([(x.path, x.start, x.until) for x in p.plan(*RANGE)], "path string, start long, until long")
    out["q_part_path_week_dates"] = lambda s, d: source(s, d, "lineitem").select("l_orderkey", "l_linenumber", TimePartition("l_shipdate", "week").path_column(F.col("l_shipdate")).alias("path"))
    for unit in UNITS:
        out[f"q_encode_{unit}"] = lambda s, d, p=TimePartition("ts", "day", unit): source(s, d, "events").select("event_id", p.encoded(F.col("ts")).alias("encoded"))
    out["q_decode_nanosecond"] = lambda s, d, p=TimePartition("ts", "hour", "nanosecond"): source(s, d, "events").select("event_id", p.timestamp(p.encoded(F.col("ts")) - 1, integer=True).alias("moment"))

    for c in ("uncompressed", "snappy", "zstd", "gzip", "lz4_raw"):
        out[f"q_file_{c}"] = lambda s, d, c=c: _file(s, d, "customer", compression=c)
    out["q_file_no_statistics"] = lambda s, d: _file(s, d, "customer", statistics="none")
    out["q_file_row_groups"] = _row_groups
    out["q_file_replace"] = _replace
    out["q_file_inferred"] = _inferred
    out["q_file_empty"] = _empty
    for c in ("zstd", "snappy", "uncompressed"):
        out[f"q_dataset_{c}"] = lambda s, d, c=c: written(s, d, compression=c).scan(*ALL)
    out["q_rotation"] = lambda s, d: written(s, d, "month", max_rows_per_file=1000).parts(*ALL).agg(F.max("rows").alias("most_rows"), F.sum("rows").alias("rows"))
    out["q_write_report"] = _report
    out["q_late_data"] = _late
    out["q_stream_append"] = _streamed
    out["q_zstd_roundtrip"] = lambda s, d: source(s, d, "documents").select("doc_id", zstd.decompress_column(zstd.compress_column(F.col("text"), 3), 1 << 28).cast("string").alias("text"))
    out["q_store_list"] = _listed
    out["q_store_listing"] = _listing
    out["q_stream_stats"] = _stream_stats
    out["q_file_stats"] = _file_stats
    out["q_batches"] = _batches
    out["q_stress"] = _stress
    out |= {name[1:]: f for name, f in globals().items() if name.startswith("_q_")}
    return out


def _eq_bool(spark, sf_dir):
    store = scratch_store(spark)
    write(store, "flags.parquet", source(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("flag")))
    return files.scan(store, "flags.parquet", where=("eq", "flag", True))


def _filter_null(spark, sf_dir):
    store = scratch_store(spark)
    write(store, "nulls.parquet", source(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("k")))
    return files.scan(store, "nulls.parquet", where=("lte", "k", 500))


def _filter_nan(spark, sf_dir):
    store = scratch_store(spark)
    write(store, "nan.parquet", source(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).otherwise(F.lit(float("nan"))).alias("price")))
    return files.scan(store, "nan.parquet", where=("gt", "price", 100000.0))


def _minutes(spark, sf_dir):
    """Every event at a time within one hour, half of it in the range: the events' own times would make a file for each of them."""
    ds = events_dataset(spark, "minute", schema=Schema.of([("event_id", "int64"), ("ts", ("timestamp", "microsecond", None))]))
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") * 37 % 3600).cast("decimal(18,6)"))
    ds.write(source(spark, sf_dir, "events").select("event_id", (F.lit("2024-01-04 23:30:00").cast("timestamp_ntz") + seconds).alias("ts")))
    return ds.scan(*RANGE)


def at_shares(values: DataFrame, shares: list[tuple[int, int]]) -> list[int] | None:
    """For each share (a, b) the ceil(a * n / b)-th least of ``values``, one column of n whole numbers of 64 bits; None if there are none.

    Exact: each pass counts values by 16 bits more, among those that share the bits found before, so at most 65,536
    counts a share come to the driver, whatever n is.
    """
    v = F.col(f"`{values.columns[0]}`")
    found: list[tuple[int, int]] = []  # of each share the bits so far, and the place among the values that have them
    for shift in (48, 32, 16, 0):
        inside = values.where(F.shiftright(v, shift + 16).isin([bits for bits, _ in found])) if found else values.where(v.isNotNull())
        counts = sorted(tuple(r) for r in inside.groupBy(F.shiftright(v, shift)).count().collect())
        if not counts:
            return None
        if not found:
            n = sum(c for _, c in counts)
            found = [(0, -(-a * n // b)) for a, b in shares]
        for i, (before, place) in enumerate(found):
            for bits, count in counts:
                if shift == 48 or bits >> 16 == before:
                    if place <= count:
                        found[i] = (bits, place)
                        break
                    place -= count
    return [value for value, _ in found]


def _boundary(spark, sf_dir):
    """From one event's instant up to another's: the first is in, the second is not."""
    p = TimePartition("ts", "day")
    ends = at_shares(source(spark, sf_dir, "events").select(p.encoded(p.timestamp())), [(1, 4), (1, 2)])
    return written(spark, sf_dir).scan(*(ends or (0, 0)), columns=["event_id", "ts"])


def _clash(spark, sf_dir):
    """A data column named as a path segment keeps its values."""
    schema = Schema.of([("event_id", "int64"), ("ts", ("timestamp", "microsecond", None)), ("year", "int64"), ("month", "string")])
    ds = events_dataset(spark, "day", schema=schema)
    ds.write(source(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("year"), F.col("event_type").alias("month")))
    return ds.scan(*RANGE)


def _siblings(spark, sf_dir):
    """Only hours 10 to 19 hold rows; a range over hour 1 too gives each row once."""
    ds = events_dataset(spark, "hour")
    rows = source(spark, sf_dir, "events").where((F.to_date("ts") == F.lit("2024-01-03").cast("date")) & (F.hour("ts") >= 10) & (F.hour("ts") < 20))
    ds.write(rows.select(*EVENTS.names))
    return ds.scan(dt.datetime(2024, 1, 3, 1), dt.datetime(2024, 1, 3, 20))


def _stray(spark, sf_dir):
    ds = events_dataset(spark)
    ds.write(source(spark, sf_dir, "events").select(*EVENTS.names))
    ds.store.put("event_log/year=2024/month=1/day=4/README.txt", b"not a Parquet file")
    return ds.scan(*RANGE, columns=["event_id"])


def _file(spark, sf_dir, name, **options):
    store = scratch_store(spark)
    write(store, f"copy/{name}.parquet", source(spark, sf_dir, name), **options)
    return files.scan(store, f"copy/{name}.parquet")


def _row_groups(spark, sf_dir):
    store = scratch_store(spark)
    write(store, "orders.parquet", source(spark, sf_dir, "orders"), max_row_group_rows=1000)
    found = files.file_stats(store, "orders.parquet")
    return spark.createDataFrame([(max(found["row_group_rows"]) <= 1000, found["total_rows"])], "bounded boolean, n long")


def _replace(spark, sf_dir):
    store = scratch_store(spark)
    write(store, "k.parquet", source(spark, sf_dir, "nation"))
    write(store, "k.parquet", source(spark, sf_dir, "region"))
    return files.scan(store, "k.parquet")


def _inferred(spark, sf_dir):
    store = scratch_store(spark)
    rows = [r.asDict() for r in source(spark, sf_dir, "nation").collect()]  # 25 rows: finite input is on the driver
    write(store, "nation.parquet", rows)
    return files.scan(store, "nation.parquet")


def _empty(spark, sf_dir):
    store = scratch_store(spark)
    write(store, "empty.parquet", [], Schema.of([("id", "int64", False), ("note", "string")]))
    return files.scan(store, "empty.parquet")


def _report(spark, sf_dir):
    ds = events_dataset(spark, "week")
    report = ds.write(source(spark, sf_dir, "events").select(*EVENTS.names))
    rows = [(p.partition, p.rows, p.min_timestamp, p.max_timestamp) for p in report.parts]
    df = spark.createDataFrame(rows, "partition string, rows long, low timestamp_ntz, high timestamp_ntz")
    return df.groupBy("partition").agg(F.sum("rows").alias("rows"), F.min("low").alias("min_timestamp"), F.max("high").alias("max_timestamp"))


def _late(spark, sf_dir):
    """Two writes, the second of rows that belong to partitions of the first."""
    ds = events_dataset(spark)
    rows = source(spark, sf_dir, "events").select(*EVENTS.names)
    ds.write(rows.where("event_id % 2 = 0"))
    ds.write(rows.where("event_id % 2 = 1"))
    return ds.scan(*ALL)


def _streamed(spark, sf_dir):
    ds = events_dataset(spark)
    rows = source(spark, sf_dir, "events").select(*EVENTS.names)
    folder = scratch(spark)
    rows.write.mode("overwrite").parquet(f"{folder}/in")
    query = write_stream(ds, spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/checkpoint")
    query.awaitTermination()
    return ds.scan(*ALL)


def _listed(spark, sf_dir):
    store = scratch_store(spark)
    for i in range(3):
        store.put(f"a/b{i}/x.bin", b"0123456789"[: i + 1])
    store.delete("a/b1/x.bin")
    return spark.createDataFrame([(m.key, m.size) for m in store.list("a")], "key string, size long")


def _listing(spark, sf_dir):
    store = scratch_store(spark)
    for i in range(3):
        store.put(f"a/b{i}/x.bin", b"0123456789"[: i + 1])
    return store.listing("a").select("key", "size")


def _stream_stats(spark, sf_dir):
    stream = written(spark, sf_dir).stream(*RANGE)
    rows = sum(b.row_count for b in stream)
    found = stream.stats()
    return spark.createDataFrame([(found["planned_partitions"], found["partitions_with_files"], found["skipped_objects"], found["discovered_files"] == found["opened_files"], found["peak_active_files"], rows)], "planned long, with_files long, skipped long, all_opened boolean, peak_active_files long, n long")


def _file_stats(spark, sf_dir):
    """Of sorted row groups of 1,000 rows: those that a bound rules out in part, and wholly."""
    store = scratch_store(spark)
    write(store, "orders.parquet", source(spark, sf_dir, "orders").orderBy("o_orderkey"), max_row_group_rows=1000)
    keys = [r["o_orderkey"] for r in files.scan(store, "orders.parquet", columns=["o_orderkey"]).orderBy("o_orderkey").limit(500).collect()]
    some, every = (files.file_stats(store, "orders.parquet", ("lte", "o_orderkey", k)) for k in (keys[-1], keys[0] - 1))
    return spark.createDataFrame([(some["row_groups"], some["row_groups_skipped"], every["row_groups_skipped"], some["total_rows"])], "row_groups long, skipped_in_part long, skipped_wholly long, n long")


def _early_halt(spark, sf_dir):
    """The first batch of a stream, which is then closed."""
    store = scratch_store(spark)
    write(store, "orders.parquet", source(spark, sf_dir, "orders").orderBy("o_orderkey"))
    stream = files.stream(store, "orders.parquet", batch_size=100)
    for batch in stream:
        stream.close()
        return spark.createDataFrame(batch.to_arrow())
    return files.scan(store, "orders.parquet")


def _batches(spark, sf_dir):
    """Rows and batches of a stream, with every batch full but the last."""
    store = scratch_store(spark)
    write(store, "supplier.parquet", source(spark, sf_dir, "supplier"))
    sizes = [b.row_count for b in files.stream(store, "supplier.parquet", batch_size=64)]
    return spark.createDataFrame([(len(sizes), sum(sizes), max(sizes, default=0) <= 64)], "batches long, n long, bounded boolean")


def _stress(spark, sf_dir):
    r = stress.measure(spark, f"{sf_dir}/orders.parquet", iterations=3, warmup=1)
    return spark.createDataFrame([(r.rows, r.min_ms <= r.avg_ms <= r.max_ms)], "rows long, ordered boolean")


# --- operators with outcomes rather than rows; each function _q_name is the query q_name


def _q_read(spark, sf_dir):
    """Materialised rows of one file."""
    store = scratch_store(spark)
    write(store, "supplier.parquet", source(spark, sf_dir, "supplier"))
    rows = files.read(store, "supplier.parquet", columns=["s_suppkey", "s_name"], where=("gt", "s_suppkey", 3))
    return spark.createDataFrame(rows, "s_name string, s_suppkey long")


def _q_dataset_read(spark, sf_dir):
    rows = written(spark, sf_dir).read(*RANGE, columns=["event_id", "value"])
    return spark.createDataFrame([(r["event_id"], r["value"]) for r in rows], "event_id long, value double")


def _q_range_int64(spark, sf_dir):
    """Whole numbers as timestamps, written and planned in a zone whose clock is not UTC's."""
    ds = events_dataset(spark, "hour", schema=Schema.of([("event_id", "int64"), ("ts", "int64", False)]))
    with zone(spark, "America/New_York"):
        ds.write(source(spark, sf_dir, "events").select("event_id", ds.time.encoded(F.col("ts")).alias("ts")))
        return ds.scan(*RANGE)


def _q_range_utc_ts(spark, sf_dir):
    ds = events_dataset(spark, "hour", schema=Schema.of([("event_id", "int64"), ("ts", ("timestamp", "microsecond", "UTC"), False)]))
    with zone(spark, "Asia/Kolkata"):
        ds.write(source(spark, sf_dir, "events").select("event_id", F.timestamp_micros(ds.time.encoded(F.col("ts"))).alias("ts")))
        return ds.scan(*RANGE).select("event_id", F.unix_micros("ts").alias("micros"))


def _q_part_bounds_dst(spark, sf_dir):
    """Bounds and paths around nights in which New York's clock skips and repeats an hour, in its zone."""
    spec = TimePartition("ts", "hour")
    with zone(spark, "America/New_York"):
        nights = F.when(F.col("event_id") % 2 == 0, F.lit("2024-03-10")).otherwise(F.lit("2024-11-03")).cast("timestamp_ntz")
        df = source(spark, sf_dir, "events").select("event_id", (nights + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 600).cast("int"))).alias("ts"))
        df = df.withColumn("zoned", F.timestamp_micros(spec.encoded(F.col("ts"))))
        ts = spec.timestamp(F.col("zoned"))
        return df.select("event_id", spec.path_column(F.col("ts")).alias("path"), *(spec.encoded(x).alias(n) for n, x in (("start", spec.truncated(ts)), ("until", spec.until(ts)), ("parsed", spec.parsed_column(spec.path_column(ts))))))


def _q_stream_lazy(spark, sf_dir):
    """What a stream over two months has planned, listed and opened once its first batch is taken."""
    stream = written(spark, sf_dir).stream(*ALL, batch_size=1)
    for _ in stream:
        break
    stream.close()
    found = stream.stats()
    return spark.createDataFrame([(found["planned_partitions"], found["listed_partitions"], found["opened_files"], found["rows"])], "planned long, listed long, opened long, n long")


def _q_order(spark, sf_dir):
    """The places of each partition's rows in what a range read gives."""
    ds = written(spark, sf_dir)
    paths = [ds.time.path(r["ts"]) for r in ds.read(dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 13), columns=["ts"])]
    rows = [(p, paths.index(p), len(paths) - 1 - paths[::-1].index(p)) for p in dict.fromkeys(paths)]
    return spark.createDataFrame(rows, "path string, first_place long, last_place long")


def _q_writer_rotation_bytes(spark, sf_dir):
    """Files of at most so many bytes, whatever the rows before them were like."""
    ds = events_dataset(spark, "month")
    ds.write(source(spark, sf_dir, "events").select(*EVENTS.names), max_bytes_per_file=20_000)
    width = F.length("event_type") + F.length("props") + 32
    sizes = ds.scan_with_files(*ALL).groupBy("path").agg(F.sum(width).alias("size"), F.count("*").alias("n"))
    return sizes.agg((F.max("size") <= 20_000).alias("bounded"), (F.count("*") >= F.sum("size") / 20_000).alias("enough_files"), F.sum("n").alias("n"))


def _q_continuous_writer(spark, sf_dir):
    """Batches written one after another; more than two files' rows are never held."""
    ds = events_dataset(spark)
    writer = ds.open_writer(max_open_partitions=2, max_rows_per_file=1000)
    store = scratch_store(spark)
    write(store, "events.parquet", source(spark, sf_dir, "events").select(*EVENTS.names))
    held = 0
    for batch in files.stream(store, "events.parquet", batch_size=700):
        writer.write(batch)
        held = max(held, writer._rows)
    report = writer.close()
    return ds.scan(*ALL).groupBy().agg(F.count("*").alias("n"), F.sum("event_id").cast("bigint").alias("ids")).select("n", "ids", F.lit(report.rows).cast("bigint").alias("reported"), F.lit(held < 2000).alias("bounded"))


def _q_open_writer(spark, sf_dir):
    store = scratch_store(spark)
    write(store, "in.parquet", source(spark, sf_dir, "supplier"))
    stream = files.stream(store, "in.parquet", batch_size=30)
    writer = open_writer(store, "out.parquet", stream.schema, max_row_group_rows=40)
    for batch in stream:
        writer.write_batch(batch)
    writer.close()
    return files.scan(store, "out.parquet")


def _q_write_explicit(spark, sf_dir):
    store = scratch_store(spark)
    rows = [r.asDict() for r in source(spark, sf_dir, "region").collect()]  # 5 rows: finite input is on the driver
    write(store, "region.parquet", rows, Schema.of([("r_name", "string"), ("r_regionkey", "int32", False), ("r_comment", "string")]) if "r_comment" in rows[0] else Schema.of([("r_name", "string"), ("r_regionkey", "int32", False)]))
    return files.scan(store, "region.parquet").select("r_name", "r_regionkey")


def _q_file_codecs(spark, sf_dir):
    """The codec that each file's column chunks have, and whether they have statistics."""
    store = scratch_store(spark)
    rows = []
    for codec in ("uncompressed", "snappy", "zstd", "gzip", "lz4_raw"):
        for statistics in ("chunk", "none"):
            write(store, "k.parquet", source(spark, sf_dir, "nation"), compression=codec, statistics=statistics)
            meta = files.footer(store, "k.parquet").metadata.row_group(0)
            rows.append((codec, statistics, meta.column(0).compression.lower(), bool(meta.column(0).is_stats_set and meta.column(0).statistics.has_min_max)))
    return spark.createDataFrame(rows, "asked string, statistics string, found string, has_bounds boolean")


def _q_page_limit(spark, sf_dir):
    """Whether a lower limit makes more pages of the first column chunk."""
    store = scratch_store(spark)
    jvm, pages = spark._jvm, []
    for limit in (1 << 20, 1024):
        write(store, "k.parquet", source(spark, sf_dir, "orders"), data_page_size_limit=limit, compression="uncompressed")
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(store._jpath("k.parquet"), spark.sparkContext._jsc.hadoopConfiguration()))
        pages.append(reader.readOffsetIndex(reader.getFooter().getBlocks().get(0).getColumns().get(0)).getPageCount())
        reader.close()
    return spark.createDataFrame([(pages[1] > pages[0],)], "more_pages boolean")


def _q_provenance(spark, sf_dir):
    store = scratch_store(spark)
    write(store, "k.parquet", {"id": [1, 2]}, compression="zstd", max_row_group_rows=1)
    return spark.createDataFrame(sorted(files.file_stats(store, "k.parquet")["writer"].items()), "setting string, value string")


def _q_write_options(spark, sf_dir):
    """Options that are rejected before anything is written."""
    store = scratch_store(spark)
    bad = {"codec": {"compression": "brotli"}, "flush": {"flush": True}, "sync": {"sync": 1}, "schema": {"schema": None, "odd": 1}, "zero": {"batch_rows": 0}, "large": {"max_row_group_rows": 1 << 32}, "page statistics": {"statistics": "page"}}
    cases = {name: lambda o=o: write(store, "k", {"id": [1]}, **o) for name, o in bad.items()}
    cases["good"] = lambda: write(store, "k", {"id": [1]}, batch_rows=1)
    df = outcomes(spark, cases)
    return df.withColumn("objects", F.lit(len(store.list())).cast("bigint"))


def _q_value_checks(spark, sf_dir):
    store = scratch_store(spark)
    kinds = {"int8": ("int8", 128), "uint8": ("uint8", -1), "boolean": ("boolean", 1), "text": ("utf8", 1), "fixed": (("fixed_binary", 2), b"abc"), "decimal": (("decimal", 128, 4, 2), "12345"), "list": (("fixed_list", Field("item", "int32"), 2), [1]), "struct": (("struct", (Field("a", "utf8"),)), {}), "good": ("int8", 127)}
    cases = {name: lambda k=kind, v=value: write(store, "k", {"x": [v]}, Schema.of([("x", k)])) for name, (kind, value) in kinds.items()}
    cases["null"] = lambda: write(store, "k", {"x": [None]}, Schema.of([("x", "int8", False)]))
    cases["field"] = lambda: write(store, "k", {"y": [1]}, Schema.of([("x", "int8")]))
    return outcomes(spark, cases)


def _q_value_codec(spark, sf_dir):
    """Values as they are read back: instants, days, decimals, times."""
    store = scratch_store(spark)
    moment = dt.datetime(1969, 12, 31, 23, 59, 59, 999_500, tzinfo=dt.timezone.utc)
    schema = Schema.of([("day", "date32"), ("half", "float64"), ("local_ms", ("timestamp", "millisecond", None)), ("money", ("decimal", 128, 10, 2)), ("nanos", ("timestamp", "nanosecond", "UTC")), ("utc", ("timestamp", "microsecond", "UTC")), ("watch", ("time", "millisecond", 32))])
    write(store, "k", [{"day": dt.date(1970, 1, 11), "half": 1, "local_ms": moment.replace(tzinfo=None), "money": "12345", "nanos": -1, "utc": moment, "watch": 7}], schema)
    row = files.read(store, "k")[0]
    return spark.createDataFrame([(k, v.isoformat() if isinstance(v, dt.datetime) else str(v)) for k, v in row.items()], "field string, value string")


def _q_open_partitions(spark, sf_dir):
    """A bound on open partitions changes no rows; one that is none is rejected."""
    ds = events_dataset(spark)
    rows = source(spark, sf_dir, "events").select(*EVENTS.names)
    report = ds.write(rows, max_open_partitions=1)
    bad = outcome(lambda: ds.write(rows, max_open_partitions=0))
    return spark.createDataFrame([(report.rows, len({p.partition for p in report.parts}), bad)], "n long, partitions long, outcome string")


def _q_partial_failure(spark, sf_dir):
    """A row that does not fit: the parts published before it are told, and stay."""
    ds = events_dataset(spark, schema=Schema.of([("event_id", "int64"), ("ts", "int64")]))
    writer = ds.open_writer(max_open_partitions=1, max_rows_per_file=2)
    writer.write({"event_id": [1, 2], "ts": [0, 1]})
    writer.write({"event_id": [3], "ts": [None]})
    try:
        writer.close()
    except EngineError as e:
        return spark.createDataFrame([(e.category, len(e.details["published"]), len(ds.store.list("event_log")))], "outcome string, published long, objects long")


def _q_predicate_strict(spark, sf_dir):
    schema = Schema.of([("i", "int64"), ("f", "float64"), ("s", "utf8"), ("b", "boolean"), ("t", ("timestamp", "microsecond", None)), ("d", "date32")])
    tests = {"int by float": ("gt", "i", 1.0), "int by bool": ("eq", "i", True), "float by int": ("gt", "f", 1), "float by nan": ("eq", "f", float("nan")), "text by int": ("lt", "s", 1), "order of booleans": ("lt", "b", True), "timestamp": ("gt", "t", 1), "date": ("eq", "d", 1), "no such column": ("eq", "x", 1), "no such operator": ("ne", "i", 1), "65 bits": ("eq", "i", 1 << 63), "int": ("eq", "i", 1), "boolean": ("eq", "b", False)}
    return outcomes(spark, {name: lambda w=w: compare(w, schema) for name, w in tests.items()})


def _q_partition_spec(spark, sf_dir):
    """Specifications of time partitions, and what is beyond their range."""
    cases = {g: lambda g=g: TimePartition("ts", g) for g in (*GRANULARITIES, "year")}
    cases |= {u: lambda u=u: TimePartition("ts", "day", u) for u in (*UNITS, "minutes")}
    cases["no column"] = lambda: TimePartition("", "day")
    day = TimePartition("ts", "day", "second")
    cases |= {"last second": lambda: day.for_timestamp(253_402_300_799 - 86_400), "beyond": lambda: day.for_timestamp(1 << 62), "65 bits": lambda: day.for_timestamp(1 << 64), "text": lambda: day.for_timestamp("2024-01-01")}
    cases |= {"backwards": lambda: day.plan(1, 0), "too many": lambda: day.plan(0, 86_400 * 3, 2), "as many as may be": lambda: day.plan(0, 86_400 * 2, 2)}
    return outcomes(spark, cases)


def _q_s3_settings(spark, sf_dir):
    """Settings of two buckets side by side."""
    rows = []
    for bucket, own in (("First-Bucket", {"access_key_id": "a", "secret_access_key": "b", "endpoint": "http://127.0.0.1:9000", "tls": False, "path_style": True}), ("second-bucket", {"max_retries": 7})):
        uri, conf = s3_settings(bucket=bucket, **own)
        rows += [(uri, k, v) for k, v in conf.items() if k.rpartition(".")[2] in ("endpoint", "key", "maximum", "access", "region")]
    return spark.createDataFrame(rows, "uri string, setting string, value string")


def _q_store_objects(spark, sf_dir):
    """Head, ranges, whole reads, replacement, cancelled writers and what fails."""
    store = scratch_store(spark)
    store.put("a/x", [b"0123", b"456789"])
    rows = [("size", str(store.head("a/x").size)), ("range", store.read_range("a/x", 7, 9).decode()), ("whole", store.read("a/x").decode()), ("at the end", store.read_range("a/x", 10, 1).decode())]
    writer = store.open_writer("a/x")
    writer.write(b"new")
    rows.append(("open writers", str(resource_snapshot()["writers"])))
    writer.cancel()
    rows.append(("cancelled", store.read("a/x").decode()))
    store.put("a/x", b"new")
    rows += [("replaced", store.read("a/x").decode()), ("open at the end", str(resource_snapshot()["writers"])), ("another store", str(Store.open(spark, "local", store.uri).identity != store.identity)), ("status", str(status(spark)["ok"]))]
    store.delete("a/x")
    cases = {"no head": lambda: store.head("a/x"), "no read": lambda: store.read("a/x"), "no delete": lambda: store.delete("a/x"), "above": lambda: store.read("../x"), "absolute": lambda: store.read("/x"), "empty": lambda: store.read(""), "drive": lambda: store.read("c:/x"), "backslash": lambda: store.read("a\\x"), "probe": error_probe, "no root": lambda: Store.open(spark, "local", store.path("none"))}
    return spark.createDataFrame(rows + [(n, outcome(f)) for n, f in cases.items()], "test_case string, outcome string")


def _q_telemetry(spark, sf_dir):
    """Which events a write, a stream that is left early and a read of nothing emit."""
    store, seen = scratch_store(spark), set()
    for e in telemetry.EVENTS:
        telemetry.attach(f"q{e}", e, lambda event, numbers, about: seen.add(("/".join(event), about.get("status") or about.get("kind") or about.get("direction") or about.get("operation"))))
    try:
        write(store, "k", {"id": [1, 2, 3]})
        stream = files.stream(store, "k", batch_size=1)
        for _ in stream:
            break
        stream.close()
        outcome(lambda: files.read(store, "none"))
    finally:
        for e in telemetry.EVENTS:
            telemetry.detach(f"q{e}")
    return spark.createDataFrame(sorted(seen), "event string, about string")


# --- the same rows in SQL


def oracle_sql() -> dict[str, str]:
    out = {f"q_scan_{t}": f"SELECT * FROM {t}" for t in TABLES}
    names = ", ".join(f"'{t}'" for t in TABLES)
    types = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>"}
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in types.items())
    out["q_schema"] = f"SELECT DISTINCT table_name, CAST(column_index - 1 AS BIGINT) AS position, column_name, CASE data_type {cases} END AS column_type FROM duckdb_columns() WHERE table_name IN ({names})"
    out["q_project_file_order"] = "SELECT event_id, user_id, value FROM events"
    for kind, (t, c, _, v) in _FILTERS.items():
        for op, sign in _SQL_OPS.items():
            out[f"q_filter_{op}_{kind}"] = f"SELECT * FROM {t} WHERE {c} {sign} {v}"
    out["q_filter_hidden_col"] = "SELECT event_id, value FROM events WHERE user_id >= 50"
    out["q_filter_eq_bool"] = "SELECT c_custkey, TRUE AS flag FROM customer WHERE c_acctbal > 0"
    out["q_filter_null"] = "SELECT o_orderkey, o_custkey AS k FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey <= 500"
    out["q_filter_nan"] = "SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0 AND o_totalprice > 100000"
    out["q_early_halt"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100"

    low, high = (f"TIMESTAMP '{x}'" for x in RANGE)
    between = f"ts >= {low} AND ts < {high}"
    out["q_range_proj_pred"] = f"SELECT event_id, user_id FROM events WHERE {between} AND user_id >= 50"
    for g in GRANULARITIES:
        out[f"q_range_{g}"] = f"SELECT * FROM events WHERE {between}"
    out["q_range_minute"] = f"SELECT * FROM (SELECT event_id, TIMESTAMP '2024-01-04 23:30:00' + to_seconds(event_id * 37 % 3600) AS ts FROM events) WHERE {between}"
    micros = "(SELECT list_sort(list(epoch_us(ts))) AS l FROM events)"
    nth = lambda p: f"(SELECT l[CAST(ceil({p} * len(l)) AS BIGINT)] FROM {micros})"
    out["q_range_boundary"] = f"SELECT event_id, ts FROM events WHERE epoch_us(ts) >= {nth(0.25)} AND epoch_us(ts) < {nth(0.5)}"
    out["q_range_empty"] = out["q_range_missing"] = "SELECT * FROM events WHERE FALSE"
    out["q_range_where_ts"] = f"SELECT * FROM events WHERE {between} AND ts < TIMESTAMP '2024-01-04'"
    out["q_range_parts"] = f"SELECT CAST(count(*) AS BIGINT) AS rows, min(ts) AS min_timestamp, max(ts) AS max_timestamp FROM events WHERE {between}"
    out["q_range_name_clash"] = f"SELECT event_id, ts, user_id AS year, event_type AS month FROM events WHERE {between}"
    out["q_range_prefix_siblings"] = "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-03 10:00:00' AND ts < TIMESTAMP '2024-01-03 20:00:00'"
    out["q_stray_objects"] = f"SELECT event_id FROM events WHERE {between}"

    part = {"year": "year", "month": "month", "day": "day", "hour": "hour", "minute": "minute", "iso_year": "isoyear", "week": "week"}

    def path(g: str, c: str) -> str:
        return f"printf('{'/'.join(f'{s}=%d' for s in SEGMENTS[g])}', {', '.join(f'{part[s]}({c})' for s in SEGMENTS[g])})"

    for g in GRANULARITIES:
        start = f"CAST(date_trunc('{g}', ts) AS TIMESTAMP)"
        out[f"q_part_path_{g}"] = f"SELECT event_id, {path(g, 'ts')} AS path FROM events"
        out[f"q_part_bounds_{g}"] = f"SELECT event_id, {start} AS start, CAST({start} + INTERVAL 1 {g} AS TIMESTAMP) AS until FROM events"
        out[f"q_parse_path_{g}"] = f"SELECT event_id, {start} AS start FROM events"
        steps = f"(SELECT unnest(generate_series(CAST(date_trunc('{g}', {low}) AS TIMESTAMP), {high}, INTERVAL 1 {g})) AS p)"
        out[f"q_plan_{g}"] = f"SELECT {path(g, 'p')} AS path, epoch_us(p) AS start, epoch_us(p + INTERVAL 1 {g}) AS until FROM {steps} WHERE p < {high}"
    out["q_part_path_week_dates"] = f"SELECT l_orderkey, l_linenumber, {path('week', 'l_shipdate')} AS path FROM lineitem"
    out["q_encode_second"] = "SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS encoded FROM events"
    out["q_encode_millisecond"] = "SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS encoded FROM events"
    out["q_encode_microsecond"] = "SELECT event_id, epoch_us(ts) AS encoded FROM events"
    out["q_encode_nanosecond"] = "SELECT event_id, epoch_us(ts) * 1000 AS encoded FROM events"
    out["q_decode_nanosecond"] = "SELECT event_id, ts - INTERVAL 1 MICROSECOND AS moment FROM events"

    for c in ("uncompressed", "snappy", "zstd", "gzip", "lz4_raw", "no_statistics"):
        out[f"q_file_{c}"] = "SELECT * FROM customer"
    out["q_file_row_groups"] = "SELECT TRUE AS bounded, count(*) AS n FROM orders"
    out["q_file_replace"] = "SELECT * FROM region"
    out["q_file_inferred"] = "SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
    out["q_file_empty"] = "SELECT CAST(0 AS BIGINT) AS id, '' AS note WHERE FALSE"
    for c in ("zstd", "snappy", "uncompressed"):
        out[f"q_dataset_{c}"] = "SELECT * FROM events"
    out["q_rotation"] = "SELECT least(1000, max(n)) AS most_rows, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM events GROUP BY date_trunc('month', ts))"
    out["q_write_report"] = f"SELECT {path('week', 'ts')} AS partition, count(*) AS rows, min(ts) AS min_timestamp, max(ts) AS max_timestamp FROM events GROUP BY 1"
    out["q_late_data"] = out["q_stream_append"] = "SELECT * FROM events"
    out["q_zstd_roundtrip"] = "SELECT doc_id, text FROM documents"
    out["q_store_list"] = "SELECT * FROM (VALUES ('a/b0/x.bin', 1::BIGINT), ('a/b2/x.bin', 3::BIGINT)) AS t(key, size)"
    out["q_store_listing"] = "SELECT * FROM (VALUES ('a/b0/x.bin', 1::BIGINT), ('a/b1/x.bin', 2::BIGINT), ('a/b2/x.bin', 3::BIGINT)) AS t(key, size)"
    out["q_stream_stats"] = f"SELECT 2::BIGINT AS planned, count(DISTINCT date_trunc('day', ts)) AS with_files, 0::BIGINT AS skipped, TRUE AS all_opened, 1::BIGINT AS peak_active_files, count(*) FILTER ({between}) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < {high}"
    groups = "CAST(ceil(count(*) / 1000) AS BIGINT)"
    out["q_file_stats"] = f"SELECT {groups} AS row_groups, {groups} - 1 AS skipped_in_part, {groups} AS skipped_wholly, count(*) AS n FROM orders"
    out["q_batches"] = "SELECT CAST(ceil(count(*) / 64) AS BIGINT) AS batches, count(*) AS n, TRUE AS bounded FROM supplier"
    out["q_stress"] = "SELECT 3 * count(*) AS rows, TRUE AS ordered FROM orders"

    out["q_read"] = "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey > 3"
    out["q_dataset_read"] = f"SELECT event_id, value FROM events WHERE {between}"
    out["q_range_int64"] = f"SELECT event_id, epoch_us(ts) AS ts FROM events WHERE {between}"
    out["q_range_utc_ts"] = f"SELECT event_id, epoch_us(ts) AS micros FROM events WHERE {between}"
    nights = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-03-10' ELSE TIMESTAMP '2024-11-03' END + to_minutes(event_id % 600) AS ts FROM events"
    out["q_part_bounds_dst"] = f"SELECT event_id, {path('hour', 'ts')} AS path, epoch_us(date_trunc('hour', ts)) AS start, epoch_us(date_trunc('hour', ts) + INTERVAL 1 HOUR) AS until, epoch_us(date_trunc('hour', ts)) AS parsed FROM ({nights})"
    first, last = (f"DATE '{x.date()}'" for x in ALL)
    out["q_stream_lazy"] = f"SELECT CAST({last} - {first} AS BIGINT) AS planned, CAST(min(ts)::DATE - {first} + 1 AS BIGINT) AS listed, 1::BIGINT AS opened, 1::BIGINT AS n FROM events"
    days = "SELECT date_trunc('day', ts) AS p, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-13' GROUP BY 1"
    out["q_order"] = f"SELECT {path('day', 'p')} AS path, CAST(sum(n) OVER w - n AS BIGINT) AS first_place, CAST(sum(n) OVER w - 1 AS BIGINT) AS last_place FROM ({days}) WINDOW w AS (ORDER BY p)"
    out["q_writer_rotation_bytes"] = "SELECT TRUE AS bounded, TRUE AS enough_files, count(*) AS n FROM events"
    out["q_continuous_writer"] = "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, count(*) AS reported, TRUE AS bounded FROM events"
    out["q_open_writer"] = "SELECT * FROM supplier"
    out["q_write_explicit"] = "SELECT r_name, r_regionkey FROM region"
    out["q_file_codecs"] = "SELECT asked, statistics, CASE asked WHEN 'lz4_raw' THEN 'lz4' ELSE asked END AS found, statistics = 'chunk' AS has_bounds FROM (VALUES ('uncompressed'), ('snappy'), ('zstd'), ('gzip'), ('lz4_raw')) a(asked), (VALUES ('chunk'), ('none')) s(statistics)"
    out["q_page_limit"] = "SELECT TRUE AS more_pages"
    out["q_provenance"] = "SELECT * FROM (VALUES ('writer.compression', 'zstd'), ('writer.max_row_group_rows', '1'), ('writer.data_page_size_limit', '1048576')) t(setting, value)"
    out["q_open_partitions"] = "SELECT count(*) AS n, count(DISTINCT date_trunc('day', ts)) AS partitions, 'invalid_argument' AS outcome FROM events"
    out["q_partial_failure"] = "SELECT 'invalid_argument' AS outcome, 1::BIGINT AS published, 1::BIGINT AS objects"
    out["q_value_codec"] = "SELECT * FROM (VALUES ('day', '10'), ('half', '1.0'), ('local_ms', '-1'), ('money', '12345'), ('nanos', '-1'), ('utc', '1969-12-31T23:59:59.999500+00:00'), ('watch', '7')) t(field, value)"

    def told(good: str, invalid: str, **others: str) -> str:
        """Cases by their outcome; the names of each are parted by semicolons."""
        named = {"ok": good, "invalid_argument": invalid, **others}
        rows = ", ".join(f"('{n}', '{k}')" for k, names in named.items() for n in names.split("; ") if n)
        return f"SELECT * FROM (VALUES {rows}) t(test_case, outcome)"

    out["q_write_options"] = f"SELECT *, 1::BIGINT AS objects FROM ({told('good', 'codec; flush; sync; schema; zero; large; page statistics')})"
    out["q_value_checks"] = told("good", "int8; uint8; boolean; text; fixed; decimal; list; struct; null; field")
    out["q_predicate_strict"] = told("int; boolean", "int by float; int by bool; float by int; float by nan; text by int; no such column; no such operator; 65 bits", unsupported="order of booleans; timestamp; date")
    out["q_partition_spec"] = told("; ".join((*GRANULARITIES, *UNITS, "last second", "as many as may be")), "year; minutes; no column; beyond; 65 bits; text; backwards; too many")
    own = {"s3a://first-bucket": {"endpoint.region": "us-east-1", "path.style.access": "true", "attempts.maximum": "4", "connection.maximum": "4", "endpoint": "http://127.0.0.1:9000", "access.key": "a", "secret.key": "b"}, "s3a://second-bucket": {"endpoint.region": "us-east-1", "path.style.access": "false", "attempts.maximum": "8", "connection.maximum": "4"}}
    rows = ", ".join(f"('{uri}', 'fs.s3a.bucket.{uri[6:]}.{k}', '{v}')" for uri, conf in own.items() for k, v in conf.items())
    out["q_s3_settings"] = f"SELECT * FROM (VALUES {rows}) t(uri, setting, value)"
    objects = {"size": "10", "range": "789", "whole": "0123456789", "at the end": "", "open writers": "1", "cancelled": "0123456789", "replaced": "new", "open at the end": "0", "another store": "True", "status": "True"}
    rows = ", ".join(f"('{k}', '{v}')" for k, v in objects.items())
    out["q_store_objects"] = f"SELECT * FROM (VALUES {rows}) t(test_case, outcome) UNION ALL {told('', 'above; absolute; empty; drive; backslash', not_found='no head; no read; no delete; no root', native_failure='probe')}"
    events = [("cancellation", "stream"), ("operation/start", "read"), ("operation/start", "write"), ("operation/stop", "error"), ("operation/stop", "ok"), ("read/batch", "read"), ("read/stats", "read"), ("storage", "put"), ("storage", "read_range"), ("write/batch", "write"), ("write/stats", "write")]
    rows = ", ".join(f"('{a}', '{b}')" for a, b in events)
    out["q_telemetry"] = f"SELECT * FROM (VALUES {rows}) t(event, about)"
    return out
