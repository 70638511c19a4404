"""Column expressions over metadata text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: seconds from 1900-01-01 to 1970-01-01, the epoch capture times count from.
EPOCH_1900 = 2208988800


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(" \t\r"))


def usable(value: Column) -> Column:
    """A trimmed value, or null when it is empty, a dash, "none", or mentions "unknown"."""
    return F.when((F.length(value) > 0) & (value != "-") & ~value.rlike("(?i)^none$|unknown"), value)


def star_rating(*values: Column) -> Column:
    """The first usable value that starts with an integer in 1..5; zero means unrated."""
    def one(v: Column) -> Column:
        lead = F.regexp_extract(v, r"^\s*([+-]?\d+)", 1).try_cast("int")
        return F.when(lead.between(1, 5), lead).cast("long")
    return F.coalesce(*[one(v) for v in values])


def digits(value: Column) -> Column:
    """The digits of a date text, or null when fewer than the fourteen a full instant needs."""
    kept = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.length(kept) >= 14, kept)


def timestamp_token(d: Column) -> Column:
    """`yyyymmdd-hhmmss` from the digits of a date."""
    return F.concat(F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 6))


def capture_seconds(d: Column) -> Column:
    """Seconds since 1900 from the digits of a date, read as local time.

    Field ranges are checked one by one; a day past the month's end runs into the next month, and a
    month or hour out of range makes the value unparseable.
    """
    year, month, day, hour, minute, second = (
        F.substring(d, at, n).cast("int") for at, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2)))
    fits = ((year >= 1900) & month.between(1, 12) & day.between(1, 31)
            & (hour < 24) & (minute < 60) & (second < 60))
    # the month's first day is clamped into range, so it never fails whatever the evaluation order
    first = F.unix_date(F.make_date(year, F.least(F.greatest(month, F.lit(1)), F.lit(12)), F.lit(1))).cast("long")
    return F.when(fits, (first + day - 1) * 86400 + hour * 3600 + minute * 60 + second + EPOCH_1900)


def capture_summary(model: Column, iso: Column, f_number: Column, shutter: Column) -> Column:
    text = F.concat_ws(" | ", model, F.concat(F.lit("ISO "), iso), F.concat(F.lit("f/"), f_number), shutter)
    return F.nullif(text, F.lit(""))


def stem(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -1), r".\.([^.]*)$", 1)
