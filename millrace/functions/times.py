"""Times and digests that arrive in several spellings, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_time(col: Column | str) -> Column:
    """TIMESTAMP of a time in text; null for null and for text that is no time.

    Read are ISO 8601 in its extended and basic form, with ``T`` or a blank,
    with or without fraction and offset, and Unix time in seconds or
    milliseconds. Without an offset a time is UTC, whatever the session's
    time zone is.
    """
    text = F.trim(F.col(col) if isinstance(col, str) else col)
    iso = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})[T ](\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    iso = F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(iso.rlike(r"(?i)(z|[+-]\d{2}:\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    stamp = F.when(zoned.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}"), F.try_to_timestamp(zoned))
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z"))))
    number = F.when(text.rlike(r"^\d{9,14}$"), text.cast("bigint"))
    unix = F.when(F.length(text) >= 12, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    return F.coalesce(stamp, day, unix)


def utc_text(col: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of a timestamp, independent of the session's time zone."""
    return F.date_format(F.to_utc_timestamp(col, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clean_hash(col: Column | str) -> Column:
    """The 64 lower-case hexadecimal digits of a SHA-256, however spelled; null if there are none."""
    text = F.lower(F.trim(F.col(col) if isinstance(col, str) else col))
    # nearly all are spelled plainly, perhaps behind a prefix; only the rest is taken apart
    last = F.right(text, F.lit(64))
    digits = F.regexp_replace(F.regexp_replace(text, r"^(sha-?256|0x)\s*[:=]?", ""), "[^0-9a-f]", "")
    plain = (F.length(text) == 64) | F.startswith(text, F.lit("sha256:"))
    return F.when(plain & last.rlike("^[0-9a-f]{64}$"), last).otherwise(F.when(F.length(digits) == 64, digits))
