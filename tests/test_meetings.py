"""Meeting days from lines around, against a plain loop."""

from __future__ import annotations

import random
import re

from quarrylake.operators import meetings

LINES = ["Meeting Days:", "  Meeting Days: ", "Meeting Days: Start Time: MWF 3:00PM", "Meeting Days: End Time:", "Start Time: N/A", "start time:", "Start Time: 9:35", "Meeting Location: Online only", "ONLINE ONLINE", "online " * 8, "Times TR 9:35AM", "MTW 10:20 and MW 9:00", "F 8:00", "Meeting Days: MWF", "text", "", None]


def plain(lines, around):
    out, told = list(lines), [None] * len(lines)
    for i in range(len(out)):
        if re.match(meetings.LABEL_AS_VALUE, (out[i] or "").strip()):
            out[i], told[i] = "Meeting Days:", "collision"
        if (out[i] or "").strip() != "Meeting Days:":
            continue
        near = [(x or "").strip() for x in out[max(0, i - around) : i + around + 1]]
        online = any((x.lower().startswith("meeting location:") and "online" in x.split(":", 1)[1].lower()) or (len(x) < 40 and re.fullmatch(r"(?i)online(\s+online)*", x)) for x in near)
        if online and any(x.lower().startswith("start time:") and x.split(":", 1)[1].strip().lower() in meetings.NO_TIME for x in near):
            out[i], told[i] = "Meeting Days: Asynchronous", "asynchronous"
            continue
        found = next((m[1] for x in near if (m := re.search(meetings.DAYS_TIME, x)) and m[1] in meetings.DAYS), None)
        if found:
            out[i], told[i] = f"Meeting Days: {found}", "parsed"
    return list(zip(out, told, strict=True))


def test_days_equal_a_plain_loop(spark):
    rng = random.Random(3)
    docs = {d: rng.choices(LINES, [3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 25, 5, 2], k=rng.randint(1, 90)) for d in range(80)}
    rows = [(d, i, x) for d, lines in docs.items() for i, x in enumerate(lines)]
    frame = spark.createDataFrame(rows, "doc_id long, idx int, line string")
    for around in (3, 20):
        got = {(r["doc_id"], r["idx"]): (r["line"], r["filled"]) for r in meetings.fill_days(frame, around).collect()}
        want = {(d, i): x for d, lines in docs.items() for i, x in enumerate(plain(lines, around))}
        assert got == want
    assert {f for _, f in want.values()} == {None, "collision", "asynchronous", "parsed"}
    assert meetings.fill_days(frame.limit(0)).collect() == []
