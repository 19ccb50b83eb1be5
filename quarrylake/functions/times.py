"""Terms of the year, clock times and meeting intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Season of each term digit pair. Sources disagree about 31, so the map is a parameter.
SEASONS = {"Spring": "11", "Summer": "21", "Fall": "41"}


def term_to_code(term: Column, seasons: dict[str, str] | None = None) -> Column:
    """``Fall 2025`` becomes ``202541``; null unless it is a known season, in any case, and a year."""
    parts = F.split(F.trim(term), r"\s+")
    out = F.lit(None).cast("string")
    for name, code in (seasons or SEASONS).items():
        out = F.when(F.lower(parts[0]) == name.lower(), F.lit(code)).otherwise(out)
    return F.when((F.size(parts) == 2) & F.get(parts, F.lit(1)).rlike(r"^\d{4}$"), F.concat(F.get(parts, F.lit(1)), out))


def code_to_term(code: Column, seasons: dict[str, str] | None = None) -> Column:
    """``202541`` becomes ``Fall 2025``, an unknown pair ``?xx 2025``; what isn't six digits stays."""
    pair = F.substring(code, 5, 2)
    out = F.concat(F.lit("?"), pair)
    for name, c in (seasons or SEASONS).items():
        out = F.when(pair == c, F.lit(name)).otherwise(out)
    return F.when(code.rlike(r"^\d{6}$"), F.concat_ws(" ", out, F.substring(code, 1, 4))).otherwise(code)


def stem_term(stem: Column, seasons: dict[str, str]) -> Column:
    """Season and year of a stem's first part; ``Termxx`` for an unknown pair, empty if it is too short."""
    code = F.split(stem, "_")[0]
    pair = F.substring(code, F.lit(5), F.greatest(F.length(code) - 4, F.lit(0)))
    out = F.concat(F.lit("Term"), pair)
    for c, name in seasons.items():
        out = F.when(pair == c, F.lit(name)).otherwise(out)
    return F.when(F.length(code) >= 5, F.concat_ws(" ", out, F.substring(code, 1, 4))).otherwise("")


_CLOCK = r"(\d{1,2}):(\d{2})\s*([AaPp])[Mm]"


def to_minutes(clock: Column) -> Column:
    """Minutes since midnight of a 12-hour time such as ``4:10PM``; null if it isn't one."""
    h, m = (F.regexp_extract(clock, _CLOCK, i).try_cast("int") for i in (1, 2))
    pm = F.lower(F.regexp_extract(clock, _CLOCK, 3)) == "p"
    return (h % 12 + F.when(pm, 12).otherwise(0)) * 60 + m


def days(c: Column) -> Column:
    """Sorted distinct weekday letters."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.upper(c), ""), lambda x: x.isin("M", "T", "W", "R", "F", "S", "U"))))


def meeting(c: Column) -> Column:
    """days, start, stop of the first ``MW 4:10PM - 5:25PM``; null where there is none or it ends before it begins."""
    pattern = r"(?i)([MTWRFSU]+)\s+(\d{1,2}:\d{2}\s*(?:AM|PM))\s*[-–]\s*(\d{1,2}:\d{2}\s*(?:AM|PM))"
    start, stop = (to_minutes(F.regexp_extract(c, pattern, i)) for i in (2, 3))
    return F.when(c.rlike(pattern) & (start < stop), F.struct(days(F.regexp_extract(c, pattern, 1)).alias("days"), start.alias("start"), stop.alias("stop")))


def conflicts(a: Column, b: Column) -> Column:
    """Whether two half-open meetings share a day and a minute; unread ones don't."""
    return F.coalesce(F.arrays_overlap(a["days"], b["days"]) & (a["start"] < b["stop"]) & (b["start"] < a["stop"]), F.lit(False))
