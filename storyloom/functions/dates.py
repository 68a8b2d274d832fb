"""Time scalars."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.binding import let

# Zone names accepted in feed dates.
_ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}

_FORMATS = (
    "d MMM yyyy HH:mm:ss xx",
    "d MMM yyyy HH:mm xx",
    "d MMM yy HH:mm:ss xx",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy HH:mm",
    "d MMM yyyy",
)
_ISO = r"^[0-9]{4}-[0-9]{2}(-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?)?$"


def parse_date(text: Column) -> Column:
    """Lenient date: ISO 8601 or RFC 822 (weekday optional); anything else is null."""
    clean = F.regexp_replace(F.trim(text), r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s*", "")
    return let(clean, lambda c: F.coalesce(_iso(c), let(_with_offset(c), _rfc822)))


def _iso(text: Column) -> Column:
    return F.when(text.rlike(_ISO), text.try_cast("timestamp"))


def _with_offset(text: Column) -> Column:
    """Zone names become numeric offsets, month names get their usual case."""
    zones = F.create_map(*(F.lit(part) for zone in _ZONES.items() for part in zone))
    name = F.upper(F.regexp_extract(text, r"([A-Za-z]+)$", 1))
    numeric = F.coalesce(
        F.concat(F.regexp_replace(text, r"[A-Za-z]+$", ""), zones[name]),
        F.regexp_replace(text, r"([+-][0-9]{2}):([0-9]{2})$", "$1$2"),
    )
    return F.initcap(F.regexp_replace(numeric, r"\s+", " "))


def _rfc822(text: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in _FORMATS))


def effective_time(published: str = "published_at", fetched: str = "fetched_at") -> Column:
    return F.coalesce(F.col(published), F.col(fetched))


def moment(as_of: datetime | str, kind: T.DataType) -> Column:
    """A literal point in time of the same type as the column it is compared with."""
    return F.lit(as_of if isinstance(as_of, str) else as_of.isoformat(sep=" ")).cast(kind)


def hours_before(as_of: datetime | str, hours: float, kind: T.DataType) -> Column:
    return moment(as_of, kind) - F.make_dt_interval(hours=F.lit(0), secs=F.lit(hours * 3600.0))
