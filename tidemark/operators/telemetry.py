"""Events in this process: numbers as measurements, numbers and known words as metadata."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from ..errors import EngineError, translated

# The events.
EVENTS = (
    ("operation", "start"),
    ("operation", "stop"),
    ("operation", "exception"),
    ("storage",),
    ("read", "batch"),
    ("write", "batch"),
    ("read", "stats"),
    ("write", "stats"),
    ("cancellation",),
)
#: Metadata that may go out; anything else is left out, so that no place, name or value can.
SAFE_KEYS = {"operation", "backend", "source_count", "status", "error_category", "exception_kind", "direction", "kind"}

_handlers: dict[str, tuple[tuple[str, ...], Callable]] = {}


def attach(handler_id: str, event: tuple[str, ...], handler: Callable[[tuple, dict, dict], None]) -> None:
    if tuple(event) not in EVENTS:
        raise EngineError("invalid_argument", "telemetry", "no such event")
    if handler_id in _handlers:
        raise EngineError("conflict", "telemetry", "a handler of this id is attached")
    _handlers[handler_id] = (tuple(event), handler)


def detach(handler_id: str) -> None:
    if _handlers.pop(handler_id, None) is None:
        raise EngineError("not_found", "telemetry", "no handler of this id is attached")


def emit(event: tuple[str, ...], measurements: dict, metadata: dict | None = None) -> None:
    numbers = {k: v for k, v in measurements.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    safe = {k: v for k, v in (metadata or {}).items() if k in SAFE_KEYS and isinstance(v, (int, str))}
    for wanted, handler in list(_handlers.values()):
        if wanted == event:
            try:
                handler(event, numbers, safe)
            except Exception:  # noqa: BLE001, S110  a handler's fault is not the operation's
                pass


@contextmanager
def operation(name: str, backend: str = "local", sources: int = 1):
    """Start, and stop or exception, around an operation; failures leave as EngineError."""
    about = {"operation": name, "backend": backend, "source_count": sources}
    began = time.monotonic_ns()
    emit(("operation", "start"), {"system_time": time.time_ns()}, about)
    try:
        yield
    except EngineError as e:
        emit(("operation", "stop"), {"duration": time.monotonic_ns() - began, "retryable_failures": int(e.retryable)}, about | {"status": "error", "error_category": e.category})
        raise
    except Exception as e:
        emit(("operation", "exception"), {"duration": time.monotonic_ns() - began}, about | {"status": "exception", "exception_kind": "error"})
        raise translated(name, e) from None
    else:
        emit(("operation", "stop"), {"duration": time.monotonic_ns() - began, "retryable_failures": 0}, about | {"status": "ok"})
