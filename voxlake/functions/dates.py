"""Time parsing and formatting; the session's time zone plays no part, and nothing is an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ISO = r"^\s*\d{4}-\d{2}-\d{2}([T ].*)?\s*$"
_DAY_ONLY = r"^\d{4}-\d{2}-\d{2}[T ]?$"
_NO_ZONE = r"^\d{4}-\d{2}-\d{2}[T ][\d:.]+$"
_MIN_EPOCH, _MAX_EPOCH = -62135596800, 253402300799


def epoch_timestamp(c: Column) -> Column:
    """Epoch seconds (number or numeric text) to timestamp."""
    seconds = c.try_cast("double")
    return F.when(seconds.between(_MIN_EPOCH, _MAX_EPOCH), F.timestamp_seconds(seconds))


def iso_timestamp(c: Column) -> Column:
    """ISO text; a text without offset is UTC, an unreadable one NULL."""
    text = F.trim(c)
    in_utc = F.when(text.rlike(_DAY_ONLY), F.concat(F.substring(text, 1, 10), F.lit("T00:00:00Z"))).when(
        text.rlike(_NO_ZONE), F.concat(text, F.lit("Z"))).otherwise(text)
    return F.when(c.rlike(_ISO), F.try_to_timestamp(in_utc))


def utc_wall(c: Column) -> Column:
    """Timestamp to date and time in UTC, without a zone."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.unix_micros(c) / F.lit(1000000).cast("decimal(18,0)")).cast("decimal(18,6)"))


def utc_text(c: Column) -> Column:
    """Timestamp to `yyyy-MM-dd HH:mm:ss` in UTC, with microseconds where there are any."""
    return utc_wall(c).cast("string")


def flexible_timestamp(c: Column) -> Column:
    """ISO text or epoch seconds."""
    return F.coalesce(iso_timestamp(c), epoch_timestamp(c))


def feed_timestamp(c: Column) -> Column:
    """Mail-style dates of RSS first, then ISO."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")),
        iso_timestamp(c),
    )


def iso_text(c: Column) -> Column:
    """Timestamp to ISO-8601 UTC text, microseconds only where there are any."""
    whole = F.replace(utc_text(c).substr(1, 19), F.lit(" "), F.lit("T"))
    micros = F.lpad(F.pmod(F.unix_micros(c), F.lit(1000000)).cast("string"), 6, "0")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def event_time() -> Column:
    """Publication time, or the time of storage where none is known."""
    return F.coalesce(F.col("published_at"), F.col("created_at"))


def event_day() -> Column:
    return utc_wall(event_time()).cast("date")
