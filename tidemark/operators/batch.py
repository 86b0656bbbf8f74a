"""A bounded columnar batch: one schema, columns of equal length."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa

from ..errors import invalid
from ..functions.inference import decoded, to_arrow
from ..functions.types import Schema


class Batch:
    def __init__(self, schema: Schema, table: pa.Table):
        self.schema, self._table = schema, table

    @classmethod
    def new(cls, schema: Schema, columns: Mapping[str, list]) -> Batch:
        """Columns by name: exactly the schema's, all of one length, every value checked."""
        named = {str(k): list(v) for k, v in columns.items()}
        if set(named) != set(schema.names):
            raise invalid("batch", "a batch's columns must be exactly those of its schema")
        if len({len(v) for v in named.values()}) > 1:
            raise invalid("batch", "columns must have equal lengths")
        return cls(schema, to_arrow(named, schema))

    @property
    def row_count(self) -> int:
        return self._table.num_rows

    @property
    def column_names(self) -> list[str]:
        return self.schema.names

    def column(self, name: str) -> list:
        if str(name) not in self.schema.names:
            raise invalid("batch", "the column does not exist")
        return decoded(self._table.column(str(name)).to_pylist(), self.schema[str(name)].type)

    def to_rows(self) -> list[dict]:
        columns = [self.column(n) for n in self.schema.names]
        return [dict(zip(self.schema.names, row, strict=True)) for row in zip(*columns, strict=True)]

    def to_arrow(self) -> pa.Table:
        return self._table
