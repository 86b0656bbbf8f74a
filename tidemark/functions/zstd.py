"""Zstandard frames: single payloads on the driver, columns by Arrow batches."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError, invalid

MAX_OUTPUT = 2**32 - 1
MAX_WINDOW = 1 << 27
_PIECE = 1 << 16


def compress(data, level: int = 0) -> bytes:
    """One standard frame; ``data`` is bytes or nested lists of them."""
    if isinstance(level, bool) or not isinstance(level, int) or not -131_072 <= level <= zstandard.MAX_COMPRESSION_LEVEL:
        raise invalid("zstd_compress", "the compression level is out of range")
    return zstandard.ZstdCompressor(level=level).compress(_joined(data))


def _joined(data) -> bytes:
    if isinstance(data, (list, tuple)):
        return b"".join(_joined(x) for x in data)
    if isinstance(data, (bytes, bytearray, memoryview)):
        return bytes(data)
    if isinstance(data, str):
        return data.encode()
    if isinstance(data, int) and not isinstance(data, bool) and 0 <= data < 256:
        return bytes([data])
    raise invalid("zstd_compress", "the payload must be bytes")


def decompress(data: bytes, max_output_size: int) -> bytes:
    """All frames of ``data``, one after another; output beyond ``max_output_size`` is an error as soon as it shows."""
    if isinstance(max_output_size, bool) or not isinstance(max_output_size, int) or not 0 <= max_output_size <= MAX_OUTPUT:
        raise invalid("zstd_decompress", "max_output_size must be a whole number from 0 to 2^32-1")
    if not isinstance(data, (bytes, bytearray, memoryview)):
        raise invalid("zstd_decompress", "the payload must be bytes")
    malformed = EngineError("malformed_data", "zstd_decompress", "the payload is not a valid Zstandard frame")
    rest, out, size = bytes(data), [], 0
    if not rest:
        raise malformed
    try:
        while rest:
            frame = zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW).decompressobj(write_size=_PIECE)
            at = 0
            while not frame.eof:
                if at >= len(rest):
                    raise malformed
                piece = frame.decompress(rest[at : at + _PIECE])
                at += _PIECE
                size += len(piece)
                if size > max_output_size:
                    raise invalid("zstd_decompress", "the output is larger than max_output_size")
                out.append(piece)
            rest = frame.unused_data + rest[at:] if at < len(rest) else frame.unused_data
    except zstandard.ZstdError:
        raise malformed from None
    return b"".join(out)


def compress_column(column: Column, level: int = 0) -> Column:
    """Each binary value as one frame; nulls stay null."""
    compress(b"", level)

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else compress(v, level))

    return run(column.cast("binary"))


def decompress_column(column: Column, max_output_size: int) -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else decompress(v, max_output_size))

    return run(column)
