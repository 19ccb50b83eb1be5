"""Meeting days of converted documents, filled in from lines around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines looked at on either side.
AROUND = 20
#: A label that stands where days should, days before a time, days that are taken, start times that are none.
LABEL_AS_VALUE = r"^Meeting Days:\s*(Start Time|End Time|Meeting Location|Meeting Type|Start Date|End Date):"
DAYS_TIME = r"\b((?:M|T|W|R|F|Sa|Su|TR|MWF|MW|TTh|TR)+)\b\s+\d{1,2}:\d{2}"
DAYS = ("M", "T", "W", "R", "F", "MWF", "MW", "TR", "TTh")
NO_TIME = ("", "n/a", "na", "none")
EMPTY = "Meeting Days:"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fill_days(lines: DataFrame, around: int = AROUND) -> DataFrame:
    """(doc_id, idx, line, filled) of lines (doc_id, idx, line): what was done to a line, or null.

    A line whose value is another label is emptied (collision). An empty one says ``Asynchronous`` if among the lines around it one has an
    online location and one a start time that is none; else it takes the days of the first line around it that has valid ones before a time
    (parsed). ``filled`` names the last of these. Lines before it count as they are by then, so an emptied one gives no days any more; lines after it as they
    were. Each line meets a bounded frame of its document; null lines are empty.
    """
    text = _stripped(F.coalesce("line", F.lit("")))
    low = F.lower(text)
    tail = _stripped(F.regexp_replace(low, r"^[^:]*:", ""))
    online = (low.startswith("meeting location:") & F.contains(tail, F.lit("online"))) | (low.rlike(r"^online(\s+online)*$") & (F.length(text) < 40))
    untimed = low.startswith("start time:") & tail.isin(*NO_TIME)
    days = F.regexp_extract(text, DAYS_TIME, 1)
    rows = lines.select("doc_id", "idx", "line", text.alias("text"), online.alias("online"), untimed.alias("untimed"), F.when(days.isin(*DAYS), days).alias("days"), text.rlike(LABEL_AS_VALUE).alias("label"))
    frame = lambda a, b: Window.partitionBy("doc_id").orderBy("idx").rowsBetween(a, b)
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct(F.col("idx").alias("at"), c.alias("days"))))
    whole = frame(-around, around)
    before = first(F.when(~F.col("label"), F.col("days"))).over(frame(-around, 0))
    later = first(F.col("days")).over(frame(1, around))
    seen = rows.select("doc_id", "idx", "line", "text", "label", F.max("online").over(whole).alias("online"), F.max("untimed").over(whole).alias("untimed"), F.coalesce(before["days"], later["days"]).alias("days"))
    empty = F.col("label") | (F.col("text") == EMPTY)
    filled = F.when(empty & F.col("online") & F.col("untimed"), "asynchronous").when(empty & F.col("days").isNotNull(), "parsed").when(F.col("label"), "collision")
    value = F.when(filled == "asynchronous", F.lit(f"{EMPTY} Asynchronous")).when(filled == "parsed", F.concat(F.lit(f"{EMPTY} "), "days")).when(F.col("label"), EMPTY).otherwise(F.col("line"))
    return seen.select("doc_id", "idx", value.alias("line"), filled.alias("filled"))
