"""Time slots of a week, time classes and date functions. All in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK, SLOT, SHIFT = 604_800, 300, 21_600
#: 1970-01-05 was a Monday.
MONDAY = 345_600


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def slot(ts: Column) -> Column:
    return F.floor(F.pmod(epoch(ts) - MONDAY, F.lit(WEEK)) / SLOT).cast("long")


def shift_slot(ts: Column) -> Column:
    return F.floor(F.pmod(epoch(ts) - MONDAY, F.lit(WEEK)) / SHIFT).cast("long")


def slot_start(ts: Column) -> Column:
    return epoch(ts) - F.pmod(epoch(ts), F.lit(SLOT))


def time_key(ts: Column, long_day: bool = False) -> Column:
    """Day, hour and the five minutes, as ``Mon:Hr00:Min00_05``."""
    low = (F.floor(F.minute(ts) / 5) * 5).cast("int")
    return F.format_string("%s:Hr%02d:Min%02d_%02d", F.date_format(ts, "EEEE" if long_day else "EEE"), F.hour(ts), low, (low + 5) % 60)


def time_classes(ts: Column) -> Column:
    low = (F.floor(F.minute(ts) / 5) * 5).cast("int")
    quarter = (F.floor(F.minute(ts) / 15) + 1).cast("int")
    part = F.element_at(F.array(*map(F.lit, ("Night", "Morning", "Afternoon", "Evening"))), (F.floor(F.hour(ts) / 6) + 1).cast("int"))
    return F.array(
        F.format_string("Lcycle_%d", F.year(ts) % 3),
        F.format_string("Yr%04d", F.year(ts)),
        F.date_format(ts, "MMMM"),
        F.date_format(ts, "EEEE"),
        F.format_string("Day%d", F.dayofmonth(ts)),
        part,
        F.format_string("Hr%02d", F.hour(ts)),
        F.format_string("Hr%d", F.hour(ts)),
        F.format_string("Q%d", quarter),
        F.format_string("Hr%02d_Q%d", F.hour(ts), quarter),
        F.format_string("Min%02d", F.minute(ts)),
        F.format_string("Min%02d_%02d", low, (low + 5) % 60),
    )


def accumulated(years, months, days, hours, minutes, seconds) -> Column:
    """Seconds; a month has 30 days and a year 365."""
    return (seconds + 60 * minutes + 3600 * hours + 86400 * days + 30 * 86400 * months + 365 * 86400 * years).cast("long")


#: strftime letters in Java's patterns.
LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE"}


def strftime(pattern: str, ts: Column) -> Column:
    out, letters = "", iter(pattern)
    for c in letters:
        if c == "%":
            k = next(letters, "%")
            out += LETTERS[k] if k in LETTERS else "'" + k.replace("'", "''") + "'"
        else:
            out += "''" if c == "'" else f"'{c}'" if c.isalpha() else c
    return F.date_format(ts, out)


def ago(now: Column, years=0, months=0, days=0, hours=0, minutes=0, seconds=0) -> Column:
    """Epoch seconds of a time that lies so far back; never below 0."""
    whole = lambda x: F.lit(x).cast("int")
    back = F.make_interval(whole(years), whole(months), F.lit(0), whole(days), whole(hours), whole(minutes), F.lit(seconds))
    return F.greatest(epoch(now - back), F.lit(0).cast("long"))


def now() -> Column:
    return F.unix_timestamp()
