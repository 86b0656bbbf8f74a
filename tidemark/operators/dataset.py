"""Time-partitioned datasets: writes routed into UTC time folders, and half-open range reads.

A write derives the partition numbers as columns, lets AQE rebalance rows by
partition (a partition that holds most rows is split over tasks), and writes
hidden staged files with one Spark job; these are then published, a folder by
one rename where its partition is new, and reported. A range scan passes Spark
only folders that can overlap the range and prunes partitions and row groups by
pushed-down conditions; a stream lists and opens one partition and one file at a
time, as far as it is read.
"""

from __future__ import annotations

import datetime as dt
import io
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait
from contextlib import contextmanager, suppress
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import EngineError, guarded, invalid
from ..functions.inference import instant, to_arrow, to_columns
from ..functions.predicate import compare, timestamp_literal
from ..functions.timepart import MAX_PARTITIONS, TimePartition
from ..functions.types import Schema
from ..sources.files import Stream, arrow_tables, checked_options, projected
from ..sources.files import OPTIONS as READ_OPTIONS
from ..sources.store import Store, checked_key
from . import telemetry
from .batch import Batch
from .writer import Sink, spark_options

# Options of a dataset writer and their defaults. Spark sorts a task's rows by
# partition and so has one file open at a time, which is within any max_open_partitions; it and
# max_rows_per_file bound what a continuous writer holds. Batches of rows are Spark's, so
# batch_rows is checked and has no further effect.
WRITE_DEFAULTS = {"max_open_partitions": 4, "max_rows_per_file": 100_000, "max_bytes_per_file": 64 * 1024 * 1024, "batch_rows": 1024}
CODECS = ("zstd", "snappy", "uncompressed")
#: Folders that a read names to Spark one by one, at most; a longer plan names the folders above them.
MAX_FOLDERS = 256
#: Renames that run at once, by threads that last: one that ends closes its connection to the JVM, which takes it a while.
MOVES = 16
_pool = ThreadPoolExecutor(MOVES)
#: What a continuous writer has staged at most before it publishes.
MOST_STAGED = {"rows": 1_000_000, "bytes": 1 << 30}
#: The staged folder level that numbers a partition's files.
FILE = "__file"


@dataclass(frozen=True)
class Part:
    key: str
    partition: str
    rows: int
    size: int
    min_timestamp: object
    max_timestamp: object


@dataclass(frozen=True)
class WriteReport:
    parts: tuple[Part, ...] = ()

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts)

    @property
    def bytes(self) -> int:
        return sum(p.size for p in self.parts)


@dataclass(frozen=True)
class Dataset:
    store: Store
    prefix: str
    schema: Schema
    time: TimePartition
    compression: str = "zstd"
    _stats: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def new(cls, store: Store, prefix: str, schema: Schema, partition_by: tuple, timestamp_unit: str = "microsecond", compression: str = "zstd") -> Dataset:
        """``partition_by``: ("time", column, granularity)."""
        if not isinstance(schema, Schema):
            raise invalid("dataset", "a dataset needs a schema")
        if not isinstance(partition_by, (tuple, list)) or len(partition_by) != 3 or partition_by[0] != "time":
            raise invalid("dataset", "partition_by is (time, column, granularity)")
        if compression not in CODECS:
            raise invalid("dataset", "unknown compression")
        time = TimePartition(str(partition_by[1]), partition_by[2], timestamp_unit)
        if time.column not in schema.names:
            raise invalid("dataset", "the timestamp column does not exist")
        kind = schema[time.column].type
        if kind != ("integer", 64, True) and not (isinstance(kind, tuple) and kind[0] == "timestamp"):
            raise invalid("dataset", "the timestamp column must be a timestamp or int64")
        if isinstance(kind, tuple) and kind[0] == "timestamp" and kind[1] != timestamp_unit:
            raise invalid("dataset", "the timestamp column has another unit")
        return cls(store, checked_key(prefix, "dataset"), schema, time, compression)

    # --- helpers

    @property
    def _kind(self):
        return self.schema[self.time.column].type

    @property
    def _numbers(self) -> bool:
        """Whether Spark holds the timestamp as a whole number."""
        return self._kind == ("integer", 64, True) or self._kind[1] == "nanosecond"

    def _moment(self) -> Column:
        return self.time.timestamp(integer=self._numbers)

    @property
    def _clash(self) -> bool:
        """Whether a data column has the name of a path segment; then the segments are kept out of Spark's sight."""
        return bool({n.lower() for n in self.schema.names} & set(self.time.segments))

    def frame(self, data) -> DataFrame:
        """Any accepted input as a DataFrame of the dataset's schema."""
        frames = [self._framed(x) for x in self._gathered(self._pieces(data))]
        while len(frames) > 1:  # in pairs: the plan grows as log(n) deep
            frames = [a[0].unionByName(a[1]) if len(a) == 2 else a[0] for a in (frames[i : i + 2] for i in range(0, len(frames), 2))]
        return frames[0] if frames else self._framed(to_arrow({}, self.schema))

    def _pieces(self, data) -> list:
        """Any accepted input as DataFrames and checked Arrow tables."""
        if isinstance(data, _Pieces):
            return data
        if isinstance(data, DataFrame):
            if set(data.columns) != set(self.schema.names):
                raise invalid("write", "the input's fields must be exactly those of the schema")
            return [data.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.to_spark().fields))]
        if isinstance(data, Batch):
            if data.schema != self.schema:
                raise invalid("write", "the batch's schema must equal the dataset's")
            return [data.to_arrow()]
        if isinstance(data, Iterable) and not hasattr(data, "keys"):
            items = list(data)
            if any(isinstance(x, (Batch, DataFrame)) or isinstance(x, list) for x in items):
                return [p for x in items for p in self._pieces(x)]
            data = items
        return [to_arrow(to_columns(data), self.schema)]

    def _gathered(self, pieces: list) -> list:
        """``pieces`` with their tables as one, after the DataFrames."""
        tables = [p for p in pieces if not isinstance(p, DataFrame)]
        return [p for p in pieces if isinstance(p, DataFrame)] + ([pa.concat_tables(tables)] if tables else [])

    def _framed(self, piece) -> DataFrame:
        return piece if isinstance(piece, DataFrame) else self.store.spark.createDataFrame(_spark_table(piece, self.schema), self.schema.to_spark())

    # --- writing

    def write(self, data, **options) -> WriteReport:
        o = _write_options(options)
        with telemetry.operation("dataset_write", self.store.backend):
            return self._write(self.frame(data), o)

    def open_writer(self, **options) -> DatasetWriter:
        return DatasetWriter(self, _write_options(options))

    def _checked(self, df: DataFrame) -> DataFrame:
        """Rows with a null timestamp, a null in a required field or a wrong fixed length fail the job."""
        c = F.col(f"`{self.time.column}`")
        faults = [c.isNull()]
        for f in self.schema.fields:
            own = F.col(f"`{f.name}`")
            if not f.nullable and f.name != self.time.column:
                faults.append(own.isNull())
            if isinstance(f.type, tuple) and f.type[0] == "fixed_binary":
                faults.append(F.octet_length(own) != f.type[1])
            if isinstance(f.type, tuple) and f.type[0] == "fixed_list":
                faults.append(F.size(own) != f.type[2])
        bad = F.coalesce(faults[0], F.lit(False))
        for x in faults[1:]:
            bad = bad | F.coalesce(x, F.lit(False))
        return df.withColumn(self.time.column, F.when(bad, F.raise_error(F.lit("a row does not fit the dataset"))).otherwise(c))

    def _write(self, df: DataFrame, o: dict) -> WriteReport:
        staged = f"{self.prefix}/_staging-{uuid.uuid4().hex}"
        hidden = {s: f"__{s}" for s in self.time.segments}
        published: list[str] = []
        parts: list[Part] = []
        with guarded("dataset_write"):
            try:
                routed = self._checked(df).withColumn("__moment", self._moment())
                routed = routed.withColumns({hidden[s]: c for s, c in self.time.value_columns(F.col("__moment")).items()}).drop("__moment")
                # rebalancing splits a partition that holds most rows over several tasks and files
                routed = routed.hint("rebalance", *hidden.values())
                folders = list(hidden.values())
                if o["max_bytes_per_file"] < WRITE_DEFAULTS["max_bytes_per_file"]:  # the default is what AQE gives a task at most
                    routed, folders = _numbered(routed, folders, o), [*folders, FILE]
                out = routed.write.options(**spark_options({"compression": self.compression})).option("maxRecordsPerFile", o["max_rows_per_file"])
                out.partitionBy(*folders).mode("append").parquet(self.store.path(staged))
                found = self._report(staged)
                self._publish(found, published)
                parts = [part for _, _, part in found]
            except EngineError as e:
                e.details["published"] = published
                raise
            except Exception as e:
                error = EngineError("invalid_argument", "dataset_write", "a row does not fit the dataset") if "a row does not fit the dataset" in str(e) else None
                if error is None:
                    raise
                error.details["published"] = published
                raise error from None
            finally:
                self.store.remove_tree(staged)
        report = WriteReport(tuple(sorted(parts, key=lambda p: p.key)))
        telemetry.emit(("write", "stats"), {"rows": report.rows, "bytes": report.bytes, "parts": len(parts)}, {"direction": "write"})
        return report

    def _report(self, staged: str) -> list[tuple[str, str, Part]]:
        """(staged key, key, part) of each staged file: its counts come from one aggregation by file, which reads the timestamps alone."""
        spark, numbers = self.store.spark, self._numbers
        moment = F.col(f"`{self.time.column}`") if numbers else self.time.timestamp()
        # each folder level is a partition column of a name that no data column has
        df = spark.read.schema(self.schema.to_spark()).option("pathGlobFilter", "*.parquet").parquet(self.store.path(staged))
        rows = df.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("rows"), F.min(moment).alias("low"), F.max(moment).alias("high")).collect()
        zone = dt.timezone.utc if not numbers and self._kind[2] else None
        shown = lambda v: v.replace(tzinfo=zone) if zone and v is not None else v
        out = []
        for r in rows:
            inner = r["path"].rpartition(staged.rpartition("/")[2] + "/")[2]
            folder, _, name = inner.rpartition("/")
            folder, _, number = folder.partition(f"/{FILE}=")
            folder = "/".join(x.removeprefix("__") for x in folder.split("/"))
            key = f"{self.prefix}/{folder}/" + (f"{number}-" if number else "") + name
            out.append((f"{staged}/{inner}", key, Part(key, folder, r["rows"], r["size"], shown(r["low"]), shown(r["high"]))))
        return out

    def _publish(self, found: list[tuple[str, str, Part]], published: list[str]) -> None:
        """Moves staged files to their keys, several folders at once; a partition that is new takes its folder whole."""
        folders: dict[str, list[tuple[str, str]]] = {}
        for key, target, _ in found:
            folders.setdefault(target.rpartition("/")[0], []).append((key, target))
        place = self.store.mover()

        def move(folder: str, keys: list[tuple[str, str]]) -> None:
            source = {key.rpartition("/")[0] for key, _ in keys}
            if len(source) == 1 and keys[0][0].rpartition("/")[2] == keys[0][1].rpartition("/")[2]:
                try:
                    place(source.pop(), folder, over=False)
                    published.extend(target for _, target in keys)
                    return
                except EngineError as e:
                    if e.category not in ("conflict", "native_failure"):
                        raise
            for key, target in keys:  # the partition is there already
                place(key, target)
                published.append(target)

        moves = [_pool.submit(move, *x) for x in folders.items()]
        wait(moves)
        for done in moves:
            done.result()

    def _spans(self, table: pa.Table) -> list[int]:
        """The spans of time, each about as long as a partition, in which the table has rows."""
        units = pc.fill_null(table.column(self.time.column).cast(pa.int64()), 0).to_numpy()
        return np.unique(units // self.time.length).tolist()

    # --- reading

    def plan(self, start, until, max_partitions: int = MAX_PARTITIONS):
        return self.time.plan(start, until, max_partitions)

    def _folders(self, planned: list) -> list[str]:
        """Folders that exist and hold the planned partitions: these themselves, or for a long plan the folders above."""
        paths = [p.path for p in planned]
        while len(paths) > MAX_FOLDERS and "/" in paths[0]:
            paths = list(dict.fromkeys(p.rpartition("/")[0] for p in paths))
        fs = self.store._fs()
        return [p for p in paths if fs.exists(self.store._jpath(f"{self.prefix}/{p}"))]

    def scan(self, start, until, columns=None, where=None, max_partitions: int = MAX_PARTITIONS, ordered: bool = False) -> DataFrame:
        """Rows with start <= timestamp < until. ``ordered``: by partition, file and row."""
        low, high = (instant(x, self.time.unit, "dataset_read") for x in (start, until))
        planned = self.plan(low, high, max_partitions)
        names = projected(self.schema, columns, "dataset_read")
        condition = compare(where, self.schema, timestamps=True) if where is not None else None
        with guarded("dataset_read"):
            spark = self.store.spark
            folders = self._folders(planned) if planned else []
            full = self.schema.to_spark()
            if not folders:
                return spark.createDataFrame([], full).select(*(F.col(f"`{n}`") for n in names))
            reader = spark.read.option("pathGlobFilter", "*.parquet")
            paths = [self.store.path(f"{self.prefix}/{p}") for p in folders]
            if self._clash:
                # folders without a base path: their names are no columns, and the data's own are kept
                if len(planned) > MAX_FOLDERS:
                    paths = [self.store.path(f"{self.prefix}/{p.path}") for p in planned if self.store._fs().exists(self.store._jpath(f"{self.prefix}/{p.path}"))]
                if not paths:
                    return spark.createDataFrame([], full).select(*(F.col(f"`{n}`") for n in names))
                df = reader.schema(full).parquet(*paths)
            else:
                for s in self.time.segments:
                    full = full.add(T.StructField(s, T.IntegerType()))
                df = reader.schema(full).option("basePath", self.store.path(self.prefix)).parquet(*paths)
                df = df.where(self.time.condition(low, high))
            df = df.where(self._within(low, high))
            if condition is not None:
                df = df.where(condition)
            if ordered:
                numbers = [F.regexp_extract("_metadata.file_path", f"/{s}=([0-9]+)/", 1).try_cast("int") for s in self.time.segments]
                df = df.orderBy(*numbers, "_metadata.file_path", "_metadata.file_block_start", "_metadata.row_index")
            return df.select(*(F.col(f"`{n}`") for n in names))

    def stream(self, start=None, until=None, max_partitions: int = MAX_PARTITIONS, **options) -> DatasetStream:
        """Batches in order of partition, file and row. A partition is listed, and a file opened, only once it is its turn."""
        if start is None or until is None:
            raise invalid("dataset_read", "a range needs its start and its end")
        o = checked_options("dataset_read", options, READ_OPTIONS)
        names = projected(self.schema, o["columns"], "dataset_read")
        condition = compare(o["where"], self.schema, timestamps=True) if o["where"] is not None else None
        low, high = (instant(x, self.time.unit, "dataset_read") for x in (start, until))
        keep = self._within(low, high) if condition is None else self._within(low, high) & condition
        return DatasetStream(self, self.plan(low, high, max_partitions), keep, self.schema.select(names), o)

    def read(self, start=None, until=None, max_partitions: int = MAX_PARTITIONS, **options) -> list[dict]:
        """All selected rows, in the order of ``stream``, by one job."""
        with telemetry.operation("dataset_read", self.store.backend):
            stream = self.stream(start, until, max_partitions, **options)  # checks what is asked for
            o = checked_options("dataset_read", options, READ_OPTIONS)
            df = self.scan(start, until, o["columns"], o["where"], max_partitions, ordered=True)
            return [row for batch in Stream(df, stream.schema, o["batch_size"], o["prefetch_depth"], self.store.backend) for row in batch.to_rows()]

    def _within(self, low: int, high: int) -> Column:
        kind = self._kind if not self._numbers else ("integer", 64, True)
        ts = F.col(f"`{self.time.column}`")
        return (ts >= timestamp_literal(low, kind)) & (ts < timestamp_literal(high, kind))

    def _files(self, partition: str) -> tuple[list[str], int] | None:
        """Keys of the Parquet files of one partition in order, and how many objects are none; None where there is no folder."""
        fs, path = self.store._fs(), self.store._jpath(f"{self.prefix}/{partition}")
        if not fs.exists(path):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path) if not s.isDirectory()]
        names = [n for n in names if not n.startswith((".", "_"))]
        keys = sorted((f"{self.prefix}/{partition}/{n}" for n in names if n.endswith(".parquet")), key=str.encode)
        return keys, len(names) - len(keys)

    def listing(self, planned: list) -> dict:
        """What a plan finds: partitions planned, listed, with files and skipped; files found, and objects that are none."""
        found = Counter(planned_partitions=len(planned))
        for files in _pool.map(lambda p: self._files(p.path), planned):
            _counted(found, files)
        return {k: found[k] for k in LISTED}

    def parts(self, start, until) -> DataFrame:
        """A DataFrame of the files that a range reads: path, size, rows, and least and greatest timestamp in the range."""
        ts = self.time.column
        df = self.scan_with_files(start, until)
        return df.groupBy("path", "size").agg(F.count("*").alias("rows"), F.min(f"`{ts}`").alias("min_timestamp"), F.max(f"`{ts}`").alias("max_timestamp"))

    def scan_with_files(self, start, until) -> DataFrame:
        planned = self.plan(start, until)
        folders = self._folders(planned)
        full = self.schema.to_spark()
        if not folders:
            return self.store.spark.createDataFrame([], full).withColumns({"path": F.lit(""), "size": F.lit(0).cast("bigint")})
        df = self.store.spark.read.option("pathGlobFilter", "*.parquet").schema(full).parquet(*(self.store.path(f"{self.prefix}/{p}") for p in folders))
        low, high = (instant(x, self.time.unit, "dataset_read") for x in (start, until))
        return df.where(self._within(low, high)).withColumns({"path": F.col("_metadata.file_path"), "size": F.col("_metadata.file_size")})


#: What a listing counts.
LISTED = ("planned_partitions", "listed_partitions", "partitions_with_files", "skipped_partitions", "discovered_files", "skipped_objects")


def _counted(found: Counter, files: tuple[list[str], int] | None) -> None:
    keys, others = files or ([], 0)
    found.update(listed_partitions=1, partitions_with_files=bool(keys), skipped_partitions=not keys, discovered_files=len(keys), skipped_objects=others)


class DatasetStream(Stream):
    """One file after the other, by a scan each; closing it leaves the rest unlisted."""

    def __init__(self, dataset: Dataset, planned: list, keep: Column, own: Schema, o: dict):
        super().__init__(None, own, o["batch_size"], o["prefetch_depth"], dataset.store.backend)
        self._dataset, self._planned, self._keep = dataset, planned, keep
        self._found: Counter = Counter(planned_partitions=len(planned))

    def _tables(self):
        store, full = self._dataset.store, self._dataset.schema.to_spark()
        for p in self._planned:
            files = self._dataset._files(p.path)
            _counted(self._found, files)
            for key in files[0] if files else ():
                self._found.update(opened_files=1)
                self._found["peak_active_files"] = 1
                df = store.spark.read.schema(full).parquet(store.path(key)).where(self._keep)
                yield from arrow_tables(df.select(*(F.col(f"`{n}`") for n in self._schema.names)), self._schema)

    def stats(self) -> dict:
        """Batches and rows so far; partitions listed, files found and opened on the way."""
        return {"batches": self._batches, "rows": self._rows} | {k: self._found[k] for k in (*LISTED, "opened_files", "peak_active_files")}


class DatasetWriter:
    """Takes input until ``close``. Rows that are handed over are held here until they are as many as
    ``max_open_partitions`` files hold (by rows or bytes). They are then published if, with the rows staged before, they
    fill files of the partitions they belong to and are as many as are published, and else staged: in a hidden file of the store, from which one job
    writes whole files. What is staged is published at ``MOST_STAGED`` rows or bytes at the latest, DataFrames, which
    hold none here, at ``close``. ``cancel`` drops what is not published; ``published`` has the keys of what is."""

    def __init__(self, dataset: Dataset, options: dict):
        self.dataset, self.options = dataset, options
        self._pieces: list = []
        self._rows = self._bytes = 0  # held here
        self._parts: list[Part] = []
        self.open = True
        self._anew()

    def _anew(self) -> None:
        self._staged = f"{self.dataset.prefix}/_staging-{uuid.uuid4().hex}"
        self._staging = self._buffer = self._out = None  # Parquet, its bytes on their way, the object
        self._waiting = self._waiting_bytes = 0  # not published: staged or held
        self._spans: set[int] = set()  # of time, about a partition each, that these are in

    @property
    def published(self) -> list[str]:
        return [p.key for p in self._parts]

    def write(self, data) -> None:
        if not self.open:
            raise invalid("dataset_write", "the writer is closed")
        o = self.options
        for piece in self.dataset._pieces(data):
            self._pieces.append(piece)
            if not isinstance(piece, DataFrame):
                self._rows += piece.num_rows
                self._bytes += piece.nbytes
        if self._rows >= o["max_open_partitions"] * o["max_rows_per_file"] or self._bytes >= o["max_open_partitions"] * o["max_bytes_per_file"]:
            tables = [p for p in self._pieces if not isinstance(p, DataFrame)]
            self._pieces = [p for p in self._pieces if isinstance(p, DataFrame)]
            self._waiting, self._waiting_bytes = self._waiting + self._rows, self._waiting_bytes + self._bytes
            for t in tables:
                self._spans.update(self.dataset._spans(t))
            self._rows = self._bytes = 0
            if self._due():
                self._flush(tables)
            else:
                self._stage(tables)

    def _due(self) -> bool:
        """Whether to publish: files would be full, and there are as many rows as are published, so that jobs are few."""
        n, o = len(self._spans), self.options
        if self._waiting >= MOST_STAGED["rows"] or self._waiting_bytes >= MOST_STAGED["bytes"]:
            return True
        full = self._waiting >= n * o["max_rows_per_file"] or self._waiting_bytes >= n * o["max_bytes_per_file"]
        return full and self._waiting >= sum(p.rows for p in self._parts)

    def _stage(self, tables: list) -> None:
        """Adds the rows held to the staged file, a row group each time, as the types that Spark reads."""
        with self._closing():
            table, kinds = _spark_table(pa.concat_tables(tables), self.dataset.schema), to_arrow_schema(self.dataset.schema.to_spark())
            if self._staging is None:
                store = self.dataset.store
                self._out = store._fs().create(store._jpath(f"{self._staged}/rows.parquet"), False)
                self._buffer = io.BufferedWriter(Sink(self._out), 1 << 20)
                self._staging = pq.ParquetWriter(pa.PythonFile(self._buffer, mode="w"), pa.schema(list(zip(kinds.names, kinds.types, strict=True))))
            self._staging.write_table(pa.table([c.cast(k) for c, k in zip(table.columns, kinds.types, strict=True)], names=kinds.names))

    def _flush(self, pieces: list) -> None:
        with self._closing():
            store, staged = self.dataset.store, []
            if self._staging is not None:
                self._staging.close()
                self._buffer.flush()
                self._out.close()
                staged = [store.spark.read.schema(self.dataset.schema.to_spark()).parquet(store.path(self._staged))]
            self._parts += self.dataset._write(self.dataset.frame(_Pieces([*staged, *pieces])), self.options).parts
        self._drop()

    @contextmanager
    def _closing(self):
        """A fault in here closes the writer."""
        try:
            with guarded("dataset_write"):
                yield
        except BaseException as e:
            self.open, self._pieces = False, []
            self._drop()
            if isinstance(e, EngineError):
                e.details["published"] = self.published + list(e.details.get("published", ()))
            raise

    def _drop(self) -> None:
        """Removes what is staged."""
        if self._out is not None:
            with suppress(Exception):  # closed already, or at fault
                self._staging.close()
                self._buffer.close()
            with suppress(Exception):
                self._out.close()
            self.dataset.store.remove_tree(self._staged)
        self._anew()

    def close(self) -> WriteReport:
        if not self.open:
            raise invalid("dataset_write", "the writer is closed")
        self.open = False
        if self._pieces or self._staging is not None:
            self._flush(self._pieces)
        return WriteReport(tuple(sorted(self._parts, key=lambda p: p.key)))

    def cancel(self) -> None:
        if self.open:
            self.open, self._pieces = False, []
            self._drop()
            telemetry.emit(("cancellation",), {"cancellations": 1}, {"kind": "dataset_writer", "backend": self.dataset.store.backend, "source_count": 1})


class _Pieces(list):
    """What ``Dataset._pieces`` made."""


def _numbered(df: DataFrame, keys: list[str], o: dict) -> DataFrame:
    """``df`` with ``FILE``: the number of the file of its partition that a row goes to, so that none holds more bytes (as Arrow holds them) or rows than it may, but for a row that is larger by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, tuple[int, int, int]] = {}  # of each partition: the file's number, its bytes and rows
        for batch in batches:
            n = batch.num_rows
            width = sum((_widths(c) for c in batch.columns), np.zeros(n, dtype=np.int64))
            numbers = np.empty(n, dtype=np.int32)
            for i, (key, size) in enumerate(zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), width.tolist(), strict=True)):
                number, held, rows = state.get(key, (0, 0, 0))
                if rows and (held + size > o["max_bytes_per_file"] or rows >= o["max_rows_per_file"]):
                    number, held, rows = number + 1, 0, 0
                state[key] = (number, held + size, rows + 1)
                numbers[i] = number
            yield batch.append_column(FILE, pa.array(numbers))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(FILE, T.IntegerType())]))


def _widths(column: pa.Array) -> np.ndarray:
    """Bytes of each value: its own for text and bytes, else the column's mean."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 4
    return np.full(len(column), -(-column.nbytes // max(1, len(column))), dtype=np.int64)


def _write_options(options: dict) -> dict:
    if set(options) - set(WRITE_DEFAULTS):
        raise invalid("dataset_write", "unknown options")
    o = WRITE_DEFAULTS | options
    if any(isinstance(v, bool) or not isinstance(v, int) or not 1 <= v <= 2**32 - 1 for v in o.values()):
        raise invalid("dataset_write", "an option is out of range")
    return o


def _spark_table(table, schema: Schema):
    """An Arrow table as Spark takes it: types that Spark lacks become the numbers or bytes it holds them as."""
    arrays = []
    for f, c in zip(schema.fields, table.columns, strict=True):
        head = f.type[0] if isinstance(f.type, tuple) else f.type
        if head == "timestamp" and f.type[1] == "nanosecond" or head in ("duration",):
            c = c.cast(pa.int64())
        elif head == "time":
            c = c.cast(pa.int32() if f.type[2] == 32 else pa.int64())
        elif head == "timestamp":
            c = c.cast(pa.timestamp("us", f.type[2]))
        elif head == "integer" and not f.type[2]:
            c = c.cast({8: pa.int16(), 16: pa.int32(), 32: pa.int64()}.get(f.type[1]) or pa.decimal128(20, 0))
        elif head == "fixed_binary":
            c = c.cast(pa.binary())
        elif head == "date64":
            c = c.cast(pa.date32())
        elif head in ("large_list", "fixed_list"):
            c = pc.cast(c, pa.list_(c.type.value_type))
        arrays.append(c)
    return pa.table(arrays, names=schema.names)
