"""Scans of one Parquet file: its schema, rows, and bounded batches.

A scan is a DataFrame: projection, predicate and row-group pruning are left to
Catalyst. Schemas come from the footer, which knows what Spark's reading loses
(nullability, unsigned and fixed-size types).
"""

from __future__ import annotations

import decimal
import queue
import threading
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, guarded, invalid
from ..functions.predicate import compare
from ..functions.types import Schema
from ..operators import telemetry
from ..operators.batch import Batch
from .store import Store, StoreFile, _active, checked_key

# Options of a scan, their defaults and bounds.
BATCH_SIZE, PREFETCH, MAX_PREFETCH = 1024, 1, 16
OPTIONS = {"batch_size", "prefetch_depth", "columns", "where"}


def checked_options(operation: str, options: dict, allowed: set[str] = OPTIONS) -> dict:
    if set(options) - allowed:
        raise invalid(operation, "unknown options")
    out = {"batch_size": BATCH_SIZE, "prefetch_depth": PREFETCH, "columns": None, "where": None} | options
    for name, most in (("batch_size", 2**32 - 1), ("prefetch_depth", MAX_PREFETCH)):
        if isinstance(out[name], bool) or not isinstance(out[name], int) or not 1 <= out[name] <= most:
            raise invalid(operation, f"{name} is out of range")
    return out


def projected(schema: Schema, columns: Iterable | None, operation: str = "read") -> list[str]:
    """The wanted names in the order of the schema; all of them for None."""
    if columns is None:
        return schema.names
    if isinstance(columns, (str, bytes)) or not isinstance(columns, Iterable):
        raise invalid(operation, "columns must be a list of names")
    wanted = [str(c) for c in columns]
    if not wanted or len(set(wanted)) != len(wanted):
        raise invalid(operation, "columns must be unique and at least one")
    if set(wanted) - set(schema.names):
        raise invalid(operation, "a column does not exist")
    return [n for n in schema.names if n in set(wanted)]


def footer(store: Store, key: str, operation: str = "schema") -> pq.ParquetFile:
    """The file's footer, read by ranges; the data is not."""
    try:
        return pq.ParquetFile(pa.PythonFile(StoreFile(store, checked_key(key, operation)), mode="r"))
    except (pa.ArrowInvalid, OSError):
        raise EngineError("malformed_data", operation, "the data is not a readable Parquet file") from None


def schema(store: Store, key: str, columns: Iterable | None = None, strict: bool = True) -> Schema:
    full = Schema.from_arrow(footer(store, key).schema_arrow, strict)
    return full.select(projected(full, columns, "schema"))


def scan(store: Store, key: str, strict: bool = True, **options) -> DataFrame:
    """The selected rows and columns, lazily; columns in the order of the file."""
    o = checked_options("read", options)
    full = schema(store, key, strict=strict)
    names = projected(full, o["columns"])
    condition = compare(o["where"], full) if o["where"] is not None else None
    with guarded("read"):
        df = store.spark.read.schema(full.to_spark()).parquet(store.path(key))
        if condition is not None:
            df = df.where(condition)
        return df.select(*(F.col(f"`{n}`") for n in names))


def read(store: Store, key: str, **options) -> list[dict]:
    """All selected rows, as Python values; for results that fit the driver."""
    with telemetry.operation("read", store.backend):
        return [row for batch in stream(store, key, **options) for row in batch.to_rows()]


class Stream:
    """Batches on demand, once through. Closing, or leaving a loop early, cancels what has not run."""

    def __init__(self, df: DataFrame, own: Schema, batch_size: int, prefetch: int, backend: str = "local", source: tuple[Store, str] | None = None):
        self._df, self._schema, self._size, self._prefetch = df, own, batch_size, prefetch
        self._backend, self._source = backend, source
        self._taken = self._closed = self._done = False
        self._batches = self._rows = 0

    @property
    def schema(self) -> Schema:
        return self._schema

    def __iter__(self) -> Iterator[Batch]:
        if self._taken:
            raise invalid("read", "a stream is read once")
        self._taken = True
        return self._pull()

    def _tables(self) -> Iterator[pa.Table]:
        return arrow_tables(self._df, self._schema, self._prefetch > 1)

    def _chunks(self) -> Iterator[pa.Table]:
        """The rows in tables of batch_size, the last one of what is left."""
        held, waiting = [], 0
        for table in self._tables():
            held.append(table)
            waiting += table.num_rows
            while waiting >= self._size:
                whole = pa.concat_tables(held)
                held, waiting = [whole.slice(self._size)], waiting - self._size
                yield whole.slice(0, self._size)
        if waiting:
            yield pa.concat_tables(held)

    def _pull(self) -> Iterator[Batch]:
        if self._closed:
            return
        _active["readers"] += 1
        chunks = self._chunks()
        chunks = chunks if self._prefetch == 1 else ahead(chunks, self._prefetch)
        try:
            with guarded("read"):
                for table in chunks:
                    yield self._made(table)
                    if self._closed:
                        return
            self._done = True
        finally:
            chunks.close()
            _active["readers"] -= 1
            telemetry.emit(("read", "stats"), {"batches": self._batches, "rows": self._rows}, {"direction": "read"})
            if not self._done:
                self.close()

    def _made(self, table: pa.Table) -> Batch:
        self._batches += 1
        self._rows += table.num_rows
        telemetry.emit(("read", "batch"), {"batches": 1, "rows": table.num_rows}, {"direction": "read"})
        return Batch(self._schema, table)

    def close(self) -> None:
        if not self._closed and self._taken and not self._done:
            telemetry.emit(("cancellation",), {"cancellations": 1}, {"kind": "stream", "backend": self._backend, "source_count": 1})
        self._closed = True

    def stats(self) -> dict:
        """Batches and rows so far, and what the footer says about the file."""
        out = {"batches": self._batches, "rows": self._rows}
        return out | file_stats(*self._source) if self._source else out


def ahead(items: Iterator, depth: int) -> Iterator:
    """``items``, up to ``depth`` of them made by a thread before they are asked for."""
    ready: queue.Queue = queue.Queue(depth)
    stop = threading.Event()

    def put(x) -> bool:
        while not stop.is_set():
            try:
                ready.put(x, timeout=0.1)
                return True
            except queue.Full:
                pass
        return False

    def fill() -> None:
        try:
            for x in items:
                if not put((x, None)):
                    return
            put((None, StopIteration()))
        except BaseException as e:  # noqa: BLE001  raised again where it is asked for
            put((None, e))
        finally:
            items.close()

    thread = threading.Thread(target=fill, daemon=True)
    thread.start()
    try:
        while True:
            x, error = ready.get()
            if isinstance(error, StopIteration):
                return
            if error is not None:
                raise error
            yield x
    finally:
        stop.set()
        thread.join(timeout=60)


def arrow_tables(df: DataFrame, own: Schema, prefetch: bool = False) -> Iterator[pa.Table]:
    """A DataFrame's rows as Arrow tables of the schema's types, one partition after the other, the next one while this one is read.

    Tasks send Arrow batches as they are, so no value becomes a Python object on the way.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_pydict({"batch": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    target = own.to_arrow()
    plain = pa.schema([pa.field(f.name, f.type) for f in target])
    for row in df.mapInArrow(packed, "batch binary").toLocalIterator(prefetchPartitions=prefetch):
        table = pa.ipc.open_stream(row["batch"]).read_all()
        yield pa.Table.from_arrays([_converted(c, f.type) for c, f in zip(table.columns, plain, strict=True)], schema=plain)


def _converted(column: pa.ChunkedArray, kind: pa.DataType) -> pa.ChunkedArray:
    """A column as Spark holds it in the type that its field has."""
    if column.type == kind:
        return column
    p = pa.types
    if p.is_decimal256(kind) and p.is_binary(column.type):  # big-endian unscaled numbers
        context = decimal.Context(prec=100)
        values = [None if v is None else decimal.Decimal(int.from_bytes(v, "big", signed=True)).scaleb(-kind.scale, context) for v in column.to_pylist()]
        return pa.chunked_array([pa.array(values, kind)])
    try:
        return column.cast(kind)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        values = column.to_pylist()
        return pa.chunked_array([pa.array([None if v is None else int(v) for v in values] if p.is_integer(kind) else values, kind)])


def stream(store: Store, key: str, **options) -> Stream:
    o = checked_options("stream", options)
    own = schema(store, key)
    df = scan(store, key, **options)
    return Stream(df, own.select(df.columns), o["batch_size"], o["prefetch_depth"], store.backend, (store, key))


def file_stats(store: Store, key: str, where=None) -> dict:
    """Row groups, codecs, bytes and the writer's key-values of a footer; with ``where``, how many row groups its bounds rule out (planned, not measured)."""
    f = footer(store, key, "stats")
    meta = f.metadata
    groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
    codecs = sorted({g.column(c).compression.lower() for g in groups for c in range(g.num_columns)})
    values = {k.decode(): v.decode() for k, v in (meta.metadata or {}).items() if k.startswith(b"writer.")}
    out = {"row_groups": len(groups), "row_group_rows": [g.num_rows for g in groups], "codecs": codecs, "total_rows": meta.num_rows, "writer": values}
    if where is not None:
        compare(where, Schema.from_arrow(f.schema_arrow))
        out["row_groups_skipped"] = sum(_ruled_out(g, where) for g in groups)
    return out


def _ruled_out(group, where) -> bool:
    op, name, literal = where
    column = next((group.column(c) for c in range(group.num_columns) if group.column(c).path_in_schema == str(name)), None)
    s = column.statistics if column is not None else None
    if s is None:
        return False
    if s.has_null_count and s.null_count == group.num_rows:
        return True
    if not s.has_min_max:
        return False
    return {"gt": s.max <= literal, "gte": s.max < literal, "lt": s.min >= literal, "lte": s.min > literal, "eq": literal < s.min or literal > s.max}[op]
