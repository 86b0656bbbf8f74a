"""UTC time partitions: minute, hour, day, ISO week and month.

Every function exists twice: on single values, for planning on the driver, and
as Column expressions, for routing rows.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import invalid
from .inference import instant
from .types import UNITS

# Granularities, and the segments of their paths.
GRANULARITIES = ("minute", "hour", "day", "week", "month")
SEGMENTS = {
    "minute": ("year", "month", "day", "hour", "minute"),
    "hour": ("year", "month", "day", "hour"),
    "day": ("year", "month", "day"),
    "week": ("iso_year", "week"),
    "month": ("year", "month"),
}
MAX_PARTITIONS = 10_000

_PER_SECOND = {"second": 1, "millisecond": 10**3, "microsecond": 10**6, "nanosecond": 10**9}
_SECONDS = {"minute": 60, "hour": 3600, "day": 86_400, "week": 604_800, "month": 2_629_746}
_EPOCH = dt.datetime(1970, 1, 1)
_NUMBER = re.compile(r"0|[1-9][0-9]{0,4}")


def _floor_div(c: Column, n: int) -> Column:
    """Whole numbers divided by ``n``, rounded down (SQL's div rounds towards zero)."""
    return F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n).cast("bigint"))


def _moment_of(micros: Column) -> Column:
    """Microseconds since the epoch as timestamp_ntz in UTC."""
    day = 86_400 * 10**6
    seconds = (F.pmod(micros, F.lit(day)).cast("decimal(18,0)") / 10**6).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(_floor_div(micros, day).cast("int"), F.lit(0), F.lit(0), seconds)


@dataclass(frozen=True)
class Partition:
    """``start`` is inside, ``until`` is not (whole units since the epoch)."""

    path: str
    start: int
    until: int


@dataclass(frozen=True)
class TimePartition:
    column: str
    granularity: str
    unit: str = "microsecond"

    def __post_init__(self):
        if not isinstance(self.column, str) or not self.column:
            raise invalid("time_partition", "a time partition needs a column name")
        if self.granularity not in GRANULARITIES:
            raise invalid("time_partition", "granularity must be minute, hour, day, week or month")
        if self.unit not in UNITS:
            raise invalid("time_partition", "timestamp unit must be second, millisecond, microsecond or nanosecond")

    @property
    def segments(self) -> tuple[str, ...]:
        return SEGMENTS[self.granularity]

    @property
    def length(self) -> int:
        """Units in a partition; of months, the mean."""
        return _SECONDS[self.granularity] * _PER_SECOND[self.unit]

    # --- single values

    def moment(self, value) -> dt.datetime:
        """The instant as a naive UTC datetime; units below a microsecond are floored."""
        units = instant(value, self.unit, "time_partition")
        try:
            return _EPOCH + dt.timedelta(microseconds=units * 10**6 // _PER_SECOND[self.unit])
        except OverflowError:
            raise invalid("time_partition", "timestamp is out of range") from None

    def encode(self, moment: dt.datetime) -> int:
        return instant(moment, self.unit, "time_partition")

    def _start(self, moment: dt.datetime) -> dt.datetime:
        day = moment.replace(hour=0, minute=0, second=0, microsecond=0)
        return {
            "minute": lambda: moment.replace(second=0, microsecond=0),
            "hour": lambda: moment.replace(minute=0, second=0, microsecond=0),
            "day": lambda: day,
            "week": lambda: day - dt.timedelta(days=day.weekday()),
            "month": lambda: day.replace(day=1),
        }[self.granularity]()

    def _next(self, start: dt.datetime) -> dt.datetime:
        if self.granularity == "month":
            return (start + dt.timedelta(days=31)).replace(day=1)
        return start + {"minute": dt.timedelta(minutes=1), "hour": dt.timedelta(hours=1), "day": dt.timedelta(days=1), "week": dt.timedelta(days=7)}[self.granularity]

    def values(self, moment: dt.datetime) -> tuple[int, ...]:
        if self.granularity == "week":
            iso = moment.isocalendar()
            return (iso.year, iso.week)
        return (moment.year, moment.month, moment.day, moment.hour, moment.minute)[: len(self.segments)]

    def for_timestamp(self, value) -> Partition:
        try:
            start = self._start(self.moment(value))
            return Partition(self._path(start), self.encode(start), self.encode(self._next(start)))
        except OverflowError:
            raise invalid("time_partition", "timestamp is out of range") from None

    def _path(self, start: dt.datetime) -> str:
        return "/".join(f"{s}={v}" for s, v in zip(self.segments, self.values(start), strict=True))

    def path(self, value) -> str:
        return self.for_timestamp(value).path

    def parse(self, path: str) -> Partition:
        """The exact inverse of ``path``: its segments in its order, whole numbers without zeros before them, a real date."""
        wrong = invalid("time_partition", "not a partition path of this granularity")
        parts = [p.partition("=") for p in path.split("/")] if isinstance(path, str) else []
        if [p[0] for p in parts] != list(self.segments) or not all(_NUMBER.fullmatch(p[2]) for p in parts):
            raise wrong
        numbers = [int(p[2]) for p in parts]
        try:
            start = dt.datetime.fromisocalendar(*numbers, 1) if self.granularity == "week" else dt.datetime(*(numbers + [1] if self.granularity == "month" else numbers))
            found = self.for_timestamp(self.encode(start))
        except (ValueError, OverflowError):
            raise wrong from None
        if found.path != path:
            raise wrong
        return found

    def plan(self, start, until, max_partitions: int = MAX_PARTITIONS) -> list[Partition]:
        """Partitions that overlap [start, until), in order; none for an empty range."""
        if isinstance(max_partitions, bool) or not isinstance(max_partitions, int) or max_partitions < 1:
            raise invalid("time_partition", "max_partitions must be a positive whole number")
        low, high = (instant(x, self.unit, "time_partition") for x in (start, until))
        if low > high:
            raise invalid("time_partition", "the range ends before it begins")
        out: list[Partition] = []
        at = low
        while at < high:
            if len(out) == max_partitions:
                raise invalid("time_partition", "the range covers more partitions than max_partitions")
            out.append(self.for_timestamp(at))
            at = out[-1].until
        return out

    # --- Column expressions, none of which depends on the session's time zone

    def timestamp(self, column: Column | None = None, integer: bool = False) -> Column:
        """The column's instant as timestamp_ntz in UTC; whole numbers (``integer``) are units since the epoch, floored to microseconds."""
        c = F.col(f"`{self.column}`") if column is None else column
        if integer:
            return _moment_of({"second": lambda: c * 10**6, "millisecond": lambda: c * 1000, "microsecond": lambda: c, "nanosecond": lambda: _floor_div(c, 1000)}[self.unit]())
        # a cast of a zoned timestamp would go through the session's zone; typeof() is known when the plan is made
        return F.when(F.typeof(c) == "timestamp", _moment_of(F.unix_micros(c.cast("timestamp")))).otherwise(c.cast("timestamp_ntz"))

    def encoded(self, ts: Column) -> Column:
        """Whole units since the epoch, floored, of a timestamp_ntz column in UTC."""
        seconds = F.unix_date(ts.cast("date")).cast("bigint") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
        micros = seconds * 10**6 + (F.extract(F.lit("SECOND"), ts) * 10**6).cast("bigint")
        return micros * 1000 if self.unit == "nanosecond" else _floor_div(micros, 10**6 // _PER_SECOND[self.unit])

    def truncated(self, ts: Column) -> Column:
        """The partition's start, of a timestamp_ntz column."""
        day = ts.cast("date")
        if self.granularity in ("week", "month"):
            return F.trunc(day, self.granularity).cast("timestamp_ntz")
        start, zero = day.cast("timestamp_ntz"), F.lit(0)
        if self.granularity == "day":
            return start
        return start + F.make_dt_interval(zero, F.hour(ts), F.minute(ts) if self.granularity == "minute" else zero)

    def until(self, ts: Column) -> Column:
        step = {"minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month"}[self.granularity]
        return (self.truncated(ts) + F.expr(f"interval {step}")).cast("timestamp_ntz")

    def value_columns(self, ts: Column) -> dict[str, Column]:
        """The number of each path segment of a timestamp_ntz column."""
        part = {
            "year": lambda: F.year(ts),
            "month": lambda: F.month(ts),
            "day": lambda: F.dayofmonth(ts),
            "hour": lambda: F.hour(ts),
            "minute": lambda: F.minute(ts),
            "iso_year": lambda: F.extract(F.lit("YEAROFWEEK"), ts.cast("date")),
            "week": lambda: F.weekofyear(ts.cast("date")),
        }
        return {s: part[s]().cast("int") for s in self.segments}

    def path_column(self, ts: Column) -> Column:
        return F.format_string("/".join(f"{s}=%d" for s in self.segments), *self.value_columns(ts).values())

    def parsed_column(self, path: Column) -> Column:
        """The partition's start from its path, as timestamp_ntz; null for what is no such path."""
        pattern = "^" + "/".join(f"{s}=(0|[1-9][0-9]*)" for s in self.segments) + "$"
        number = lambda i: F.regexp_extract(path, pattern, i).try_cast("int")
        made = lambda *n: F.try_make_timestamp_ntz(F.when(n[0].between(1, 9999), n[0]), *n[1:], *[F.lit(1)] * (3 - len(n)), *[F.lit(0)] * (6 - max(3, len(n))))
        if self.granularity == "week":  # the Monday of the week with January 4th is the first
            monday = F.trunc(made(number(1), F.lit(1), F.lit(4)).cast("date"), "week").cast("timestamp_ntz")
            start = monday + F.make_dt_interval(F.when(number(2) <= 53, (number(2) - 1) * 7))
        else:
            start = made(*(number(i + 1) for i in range(len(self.segments))))
        return F.when(path.rlike(pattern) & (self.path_column(start) == path), start)

    def condition(self, start, until) -> Column | None:
        """Which partitions overlap [start, until), on their value columns; None for an empty range.

        Segment numbers are compared as one number of two digits a segment, in
        order of time, so that the scan prunes partitions by two comparisons.
        """
        low, high = (instant(x, self.unit, "time_partition") for x in (start, until))
        if low >= high:
            return None
        first, last = self.moment(low), self.moment(high - 1)
        ordinal = lambda values: sum(v * 100 ** (len(self.segments) - 1 - i) for i, v in enumerate(values))
        own = F.lit(0).cast("bigint")
        for i, s in enumerate(self.segments):
            own = own + F.col(s).cast("bigint") * 100 ** (len(self.segments) - 1 - i)
        year = F.col(self.segments[0])
        return (year >= first.year - 1) & (year <= last.year + 1) & (own >= ordinal(self.values(first))) & (own <= ordinal(self.values(last)))
