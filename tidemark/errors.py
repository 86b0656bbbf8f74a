"""One exception for every failure, with a stable category and nothing secret in it."""

from __future__ import annotations

from contextlib import contextmanager

# The categories of errors.
CATEGORIES = (
    "cancelled",
    "conflict",
    "invalid_argument",
    "malformed_data",
    "native_failure",
    "not_found",
    "permission_denied",
    "timeout",
    "unsupported",
    "unknown",
)


class EngineError(Exception):
    """``details`` holds safe context only: no credentials, row values or locations."""

    def __init__(self, category: str, operation: str, message: str, retryable: bool = False, details: dict | None = None):
        super().__init__(message)
        self.category = category if category in CATEGORIES else "unknown"
        self.operation, self.message, self.retryable = operation, message, retryable
        self.details = dict(details or {})

    def __repr__(self) -> str:
        return f"EngineError(category={self.category!r}, operation={self.operation!r}, message={self.message!r}, retryable={self.retryable})"


def invalid(operation: str, message: str) -> EngineError:
    return EngineError("invalid_argument", operation, message)


#: What the text of a Spark or Hadoop failure tells, in the order tried: (marks, category, message, retryable).
_MARKS = (
    (("PATH_NOT_FOUND", "FileNotFoundException", "FILE_NOT_EXIST", "NoSuchFileException", "does not exist"), "not_found", "object not found", False),
    (("AccessControlException", "AccessDenied", "Permission denied", "403 Forbidden"), "permission_denied", "object access was denied", False),
    (("FileAlreadyExistsException", "PATH_ALREADY_EXISTS"), "conflict", "destination already exists", False),
    (("is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "Could not read footer", "CANNOT_READ_FILE", "ParquetDecodingException", "CorruptFileException", "Parquet magic bytes", "Couldn't deserialize"), "malformed_data", "the data is not a readable Parquet file", False),
    (("PARQUET_TYPE_ILLEGAL", "PARQUET_TYPE_NOT_SUPPORTED", "PARQUET_TYPE_NOT_RECOGNIZED", "UNSUPPORTED"), "unsupported", "the data holds something that is not supported", False),
    (("SocketTimeoutException", "TimeoutException", "timed out"), "timeout", "object operation timed out", True),
    (("cancelled", "JOB_CANCELLED"), "cancelled", "operation was cancelled", False),
    (("CAST_OVERFLOW", "ARITHMETIC_OVERFLOW", "CAST_INVALID_INPUT", "USER_RAISED_EXCEPTION", "UNRESOLVED_COLUMN", "NOT_NULL_ASSERT_VIOLATION"), "invalid_argument", "the request does not fit the data", False),
)


def translated(operation: str, error: BaseException) -> EngineError:
    """The failure by its category; its own text, which may name places or values, is left out."""
    if isinstance(error, EngineError):
        return error
    text = f"{type(error).__name__}: {error}"
    for marks, category, message, retryable in _MARKS:
        if any(m in text for m in marks):
            return EngineError(category, operation, message, retryable)
    return EngineError("native_failure", operation, "the operation failed")


@contextmanager
def guarded(operation: str):
    try:
        yield
    except EngineError:
        raise
    except Exception as e:
        raise translated(operation, e) from None
