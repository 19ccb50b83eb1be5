"""Clean-up of converted documents, line by line, and predicates over questions; registries and patterns are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylake.functions import text as T

#: Dates and deadlines that pass.
TRANSIENT = (
    r"(?i)\b(on|by)\s+(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)?,?\s*(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}",
    r"(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+(20\d{2})",
    r"(?i)\b(next|this|last|coming)\s+(week|month|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    r"\b\d{1,2}/\d{1,2}/(?:\d{2}|\d{4})\b",
    r"\b\d{4}-\d{1,2}-\d{1,2}\b",
    r"\b[MTWRFSU]\s+\d{1,2}/\d{1,2}\b",
    r"(?i)\bLec(?:ture|\.)?\s+\d+\b",
    r"(?i)\bHomework\s+#?\d+\s+(?:is\s+)?due\b",
    r"(?i)\bExam\s+\d+\s+(?:is\s+)?scheduled\b",
)
#: Words that take several courses for one.
ONE_COURSE = (r"discrepancy\b", r"inconsistency\b", r"(one|another|the\s+other|a\s+different)\s+section\b", r"mentioned\s+elsewhere\b", r"listed\s+in\s+one\b", r"is\s+the\s+correct\b", r"conflicting\s+\w+")
#: A course's code, and what a question says instead of it.
CODE = r"\b[A-Z]{2,5}\s*\d{3,4}[A-Z]?(?:/\d{3,4})?\b"
UNNAMED = r"(?i)\b(this|the)\s+(course|class|syllabus|assignments?|final\s+exam|midterm|readings?|grading(?:\s+policy)?|policy|exam)\b"
#: Headers that are none: exact ones, beginnings, and patterns with their reasons.
FALSE_HEADERS = ("notes", "url for resource", "texas a&m college station", "texas a&m university")
FALSE_BEGINNINGS = ("this material is",)
FALSE_PATTERNS = ((r"^\d+\.\s", "numbered_list_item"), (r"^\d{1,2}:\d{2}\s*[-–]", "time_string"), (r"^room\s+\d", "room_location"), (r"^all\s+(quizzes|exams|tests|homework)", "policy_statement"), (r"^(a|an)\s+absence\s+for\s+", "policy_statement"))


def is_transient(c: Column) -> Column:
    """Whether a text names a date or a deadline that passes."""
    out = F.lit(False)
    for pattern in TRANSIENT:
        out = out | F.coalesce(c.rlike(pattern), F.lit(False))
    return out


def is_one_course(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)\b(?:" + "|".join(ONE_COURSE) + ")"), F.lit(False))


def named_question(question: Column, courses: Column) -> Column:
    """A question on just one course that doesn't name it, but says ``the course`` or the like, begins with it."""
    lower = F.substring(question, 1, 1).rlike("[A-Z]") & (F.substring(question, 1, 4) != F.upper(F.substring(question, 1, 4)))
    body = F.when(lower, F.concat(F.lower(F.substring(question, 1, 1)), F.substring(question, F.lit(2), F.length(question)))).otherwise(question)
    course = F.get(courses, F.lit(0))
    wanted = (F.size(courses) == 1) & ~question.rlike(CODE) & question.rlike(UNNAMED) & (F.coalesce(course, F.lit("")) != "")
    return F.when(wanted, F.concat(F.lit("In "), course, F.lit(", "), body)).otherwise(question)


def without_themes(themes: Column, blocked: tuple[str, ...]) -> Column:
    """Themes that hold none of the blocked words, in any case."""
    return F.filter(themes, lambda t: ~F.exists(F.array(*map(F.lit, blocked)), lambda b: F.contains(F.lower(t), b)))


def false_header(header: Column) -> Column:
    """Why a header is none: exact_match, prefix_match or its pattern's reason; null for a true one."""
    norm = F.lower(F.regexp_replace(F.trim(header), ":+$", ""))
    out = F.when(norm.isin(*FALSE_HEADERS), "exact_match")
    for p in FALSE_BEGINNINGS:
        out = out.when((norm == p) | norm.startswith(p + ":") | norm.startswith(p + " "), "prefix_match")
    for pattern, reason in FALSE_PATTERNS:
        out = out.when(norm.rlike(pattern), reason)
    return out


def header_class(header: Column, registry: dict[str, str]) -> Column:
    """The class of a header, without closing colons, and then without its number; null for none."""
    norm = F.regexp_replace(T.collapse(F.lower(header)), ":+$", "")
    named = F.create_map(*[F.lit(x) for kv in registry.items() for x in kv])
    return F.coalesce(F.try_element_at(named, norm), F.try_element_at(named, F.regexp_replace(norm, r"^[\d.]+\s+", "")))


def strip_sections(markdown: Column, registry: dict[str, str]) -> Column:
    """(text, n): a markdown text without the sections whose header has a class, and how many went. A section ends at the next header."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("off"), F.lit(0).alias("n"))

    def step(s: Column, line: Column) -> Column:
        head = line.rlike(r"^#{1,6}\s")
        known = head & header_class(F.regexp_replace(line, r"^#{1,6}\s+", ""), registry).isNotNull()
        off = F.when(head, known).otherwise(s["off"])
        return F.struct(F.when(off, s["out"]).otherwise(F.concat(s["out"], F.array(line))).alias("out"), off.alias("off"), (s["n"] + known.cast("int")).alias("n"))

    return F.aggregate(T.lines(F.coalesce(markdown, F.lit(""))), start, step, lambda s: F.struct(F.array_join(s["out"], "\n").alias("text"), s["n"].alias("n")))


def strip_sentences(c: Column, patterns: tuple[str, ...]) -> Column:
    """(text, n): without what the patterns match, in any case; runs of blank lines and spaces that are left are closed up."""
    n, out = F.lit(0), c
    for p in patterns:
        n = n + F.regexp_count(out, F.lit("(?i)" + p))
        out = F.regexp_replace(out, "(?i)" + p, "")
    return F.struct(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"  +", " ").alias("text"), n.cast("int").alias("n"))


def tidy_lines(c: Column, once: str = r"^Credit Hours:?\s+\d", page_header: str = r"(?i)^\s*#{1,6}\s+Course\s+Syllabus:?\s*$", drop: tuple[str, ...] = (r"^\s*<!--\s*image\s*-->\s*$", r"^\|\s*\|$|^\|-+\|$")) -> Column:
    """(text, n): a header that only repeats the one before goes, so do later lines of the kinds that stand once, marks and broken table rows, and blank lines after two; n lines went."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("head"), F.lit(False).alias("once"), F.lit(False).alias("page"), F.lit(0).alias("blank"), F.lit(0).alias("n"))

    def step(s: Column, line: Column) -> Column:
        trimmed = F.trim(line)
        head = F.when(line.rlike(r"^#{1,6}\s+.+$"), F.trim(F.regexp_replace(line, r"^#{1,6}\s+", "")))
        is_once, is_page, blank = trimmed.rlike(once), line.rlike(page_header), trimmed == ""
        gone = F.coalesce(head == s["head"], F.lit(False)) | is_once & s["once"] | is_page & s["page"] | (blank & (s["blank"] >= 2))
        for p in drop:
            gone = gone | trimmed.rlike(p)
        return F.struct(
            F.when(gone, s["out"]).otherwise(F.concat(s["out"], F.array(line))).alias("out"),
            F.when(head.isNotNull(), head).when(blank, s["head"]).otherwise(F.lit(None).cast("string")).alias("head"),
            (s["once"] | is_once).alias("once"), (s["page"] | is_page).alias("page"),
            F.when(blank, s["blank"] + 1).when(gone, s["blank"]).otherwise(F.lit(0)).alias("blank"), (s["n"] + gone.cast("int")).alias("n"),
        )

    return F.aggregate(T.lines(F.coalesce(c, F.lit(""))), start, step, lambda s: F.struct(F.array_join(s["out"], "\n").alias("text"), s["n"].alias("n")))
