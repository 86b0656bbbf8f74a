"""Writes of one Parquet file.

Finite input (rows, columns, batches) is on the driver already and is encoded
there by Arrow, row group by row group, into a staged object that replaces the
key at the end. A DataFrame is written by Spark: one task makes the one file,
which is then moved to the key; for more than a task can hold, use a dataset.
"""

from __future__ import annotations

import base64
import io
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from ..errors import EngineError, guarded, invalid
from ..functions.inference import infer, to_arrow, to_columns
from ..functions.types import Schema
from ..sources.store import Metadata, Store, checked_key
from . import telemetry
from .batch import Batch

# Options of a writer and their defaults.
DEFAULTS = {"compression": "snappy", "batch_rows": 65_536, "max_batch_rows": 65_536, "max_row_group_rows": 1_048_576, "data_page_size_limit": 1024 * 1024, "statistics": "chunk"}
CODECS = {"uncompressed": "none", "snappy": "snappy", "zstd": "zstd", "gzip": "gzip", "lz4_raw": "lz4"}


def checked_options(options: dict, codecs=tuple(CODECS), defaults: dict = DEFAULTS) -> dict:
    if set(options) - set(defaults):
        raise invalid("write", "unknown options")
    o = defaults | options
    if o["compression"] not in codecs:
        raise invalid("write", "unknown compression")
    if o.get("statistics", "chunk") not in ("chunk", "none"):
        raise invalid("write", "statistics must be chunk or none")
    for name, v in o.items():
        if name not in ("compression", "statistics") and (isinstance(v, bool) or not isinstance(v, int) or not 1 <= v <= 2**32 - 1):
            raise invalid("write", f"{name} is out of range")
    return o


class Sink(io.RawIOBase):
    """Passes Arrow's bytes on to an object writer."""

    def __init__(self, out):
        self.out, self.size = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        data = bytes(data)
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def tell(self) -> int:
        return self.size


class FileWriter:
    """Batches of one fixed schema into one file, which shows at ``close``."""

    def __init__(self, store: Store, key: str, schema: Schema, **options):
        if not isinstance(schema, Schema):
            raise invalid("open_writer", "a writer needs a schema")
        self.options = checked_options(options)
        self.store, self.schema = store, schema
        self._out = store.open_writer(checked_key(key, "write"))
        o = self.options
        self._encoded = [_plain_lists(f.type) for f in schema.to_arrow()]
        about = {f"writer.{k}": str(o[k]) for k in ("compression", "max_row_group_rows", "data_page_size_limit")}
        about["ARROW:schema"] = base64.b64encode(schema.to_arrow().serialize().to_pybytes()).decode()
        try:
            self._parquet = pq.ParquetWriter(
                pa.PythonFile(Sink(self._out), mode="w"), pa.schema([pa.field(f.name, k, f.nullable) for f, k in zip(schema.to_arrow(), self._encoded, strict=True)]), compression=CODECS[o["compression"]], data_page_size=o["data_page_size_limit"], write_statistics=o["statistics"] == "chunk", version="2.6", store_schema=False
            )
            self._parquet.add_key_value_metadata(about)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            self._out.cancel()
            raise EngineError("unsupported", "write", "a column type cannot be written") from None
        self._held: list[pa.Table] = []
        self._waiting = self._rows = self._batches = 0

    def write_batch(self, batch: Batch) -> None:
        if not self._out.open:
            raise invalid("write", "the writer is closed")
        if batch.schema != self.schema:
            raise invalid("write", "the batch's schema must equal the writer's")
        if batch.row_count > self.options["max_batch_rows"]:
            raise invalid("write", "the batch has more rows than max_batch_rows")
        self._add(batch.to_arrow())

    def _add(self, table: pa.Table) -> None:
        self._held.append(table)
        self._waiting += table.num_rows
        self._rows += table.num_rows
        self._batches += 1
        telemetry.emit(("write", "batch"), {"batches": 1, "rows": table.num_rows}, {"direction": "write"})
        while self._waiting >= self.options["max_row_group_rows"]:
            self._flush(self.options["max_row_group_rows"])

    def _flush(self, n: int) -> None:
        table = pa.concat_tables(self._held)
        columns = [pa.array(c.to_pylist(), k) if pa.types.is_fixed_size_list(c.type) else c for c, k in zip(table.columns, self._encoded, strict=True)]
        table = pa.Table.from_arrays(columns, schema=self._parquet.schema)
        with guarded("write"):
            self._parquet.write_table(table.slice(0, n), row_group_size=n)
        self._held = [pa.concat_tables(self._held).slice(n)]
        self._waiting -= min(n, self._waiting)

    def close(self) -> Metadata:
        if not self._out.open:
            raise invalid("write", "the writer is closed")
        if self._waiting:
            self._flush(self._waiting)
        with guarded("write"):
            self._parquet.close()
        m = self._out.publish()
        telemetry.emit(("write", "stats"), {"rows": self._rows, "batches": self._batches, "bytes": m.size}, {"direction": "write"})
        return m

    def cancel(self) -> None:
        if self._out.open:
            self._parquet = None
            self._out.cancel()

    def stats(self) -> dict:
        return {"rows": self._rows, "batches": self._batches, "waiting_rows": self._waiting}


def _plain_lists(kind: pa.DataType) -> pa.DataType:
    """The type that is encoded: Arrow cannot write fixed-size lists that hold nulls, so these become lists; the footer names the schema that is meant."""
    return pa.list_(kind.value_field) if pa.types.is_fixed_size_list(kind) else kind


def open_writer(store: Store, key: str, schema: Schema, **options) -> FileWriter:
    return FileWriter(store, key, schema, **options)


def write(store: Store, key: str, data, schema: Schema | None = None, **options) -> Metadata:
    """Rows, columns or a DataFrame as the one file of ``key``, replacing an older one.

    Without a schema it is inferred, and empty input is an error; with one,
    the input's fields must be the schema's, and empty input gives no rows.
    """
    o = checked_options(options)
    checked_key(key, "write")
    if schema is not None and not isinstance(schema, Schema):
        raise invalid("write", "schema must be a Schema")
    with telemetry.operation("write", store.backend):
        if isinstance(data, DataFrame):
            return _write_frame(store, key, data, schema, o)
        columns = to_columns(data)
        own = schema or infer(columns)
        table = to_arrow(columns, own)
        writer = FileWriter(store, key, own, **options)
        try:
            for at in range(0, table.num_rows, o["batch_rows"]):
                writer._add(table.slice(at, o["batch_rows"]))
            return writer.close()
        except BaseException:
            writer.cancel()
            raise


def spark_options(o: dict) -> dict[str, str]:
    return {
        "compression": o["compression"],
        "parquet.block.row.count.limit": str(o.get("max_row_group_rows", DEFAULTS["max_row_group_rows"])),
        "parquet.page.size": str(o.get("data_page_size_limit", DEFAULTS["data_page_size_limit"])),
        "parquet.column.statistics.enabled": str(o.get("statistics", "chunk") == "chunk").lower(),
    }


def _write_frame(store: Store, key: str, df: DataFrame, schema: Schema | None, o: dict) -> Metadata:
    if schema is not None:
        if set(df.columns) != set(schema.names):
            raise invalid("write", "the input's fields must be exactly those of the schema")
        df = df.select(*(df[f"`{f.name}`"].cast(t.dataType).alias(f.name) for f, t in zip(schema.fields, schema.to_spark().fields, strict=True)))
    folder = key.rpartition("/")[0]
    staged = f"{folder}/" * bool(folder) + f"_staging-{uuid.uuid4().hex}"
    with guarded("write"):
        try:
            # one task encodes the file; what comes before runs as wide as it is, unless rows have an order to keep
            plain = df._jdf.queryExecution().optimizedPlan().outputOrdering().isEmpty()
            (df.repartition(1) if plain else df.coalesce(1)).write.options(**spark_options(o)).mode("overwrite").parquet(store.path(staged))
            fs, path = store._fs(), store._jpath(staged)
            parts = [s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet")]
            if not parts:  # no partition at all
                raise EngineError("native_failure", "write", "no file was written")
            store.move(f"{staged}/{parts[0]}", key)
        finally:
            store.remove_tree(staged)
    return store.head(key)
