"""Course ids, file stems, summaries and routing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.functions import times
from quarrylake.functions.arrays import let

#: Course numbers with a meaning of their own.
COURSE_TYPES = {"681": "seminar", "684": "internship", "689": "special_topics", "691": "research"}
#: Topics that say nothing.
GENERIC_TOPICS = ("course overview", "course introduction", "introduction", "final review", "basic ideas of statistical learning")
#: Kinds of lines that summaries no longer have.
LEGACY_LINES = ("Skills", "Methods", "Tools/Platforms", "Niche", "Schedule")
#: Rows fetched and kept for each course, and their caps.
PER_COURSE = {"hybrid_course": (40, 15), "semantic_general": (50, 20), "recursive": (30, 10)}
CAPS = (100, 35)


def normalize_id(c: Column) -> Column:
    """``csce638`` and ``csce-638`` become ``CSCE 638``; what isn't letters then digits is only upper-cased."""
    return F.regexp_replace(F.replace(F.upper(F.trim(c)), F.lit("-"), F.lit(" ")), r"^([A-Z]+)\s*(\d+.*)$", "$1 $2")


def department(course: Column) -> Column:
    """First word, in upper case; null for a blank id."""
    head = F.split(F.trim(course), r"\s+")[0]
    return F.when(head != "", F.upper(head))


def course_type(course: Column) -> Column:
    number = F.get(F.split(F.trim(course), r"\s+"), F.lit(1))
    out = F.lit("course")
    for n, kind in COURSE_TYPES.items():
        out = F.when(number == n, kind).otherwise(out)
    return out


def meeting_format(location: Column, times_: Column) -> Column:
    return F.when(F.upper(F.concat_ws(" ", location, times_)).rlike("ONLINE|REMOTE|N/A"), "online").otherwise("in-person")


def stem(file: Column, *suffixes: str) -> Column:
    """File name without its suffix, the first of ``suffixes`` (else ``.json``) that fits; null for none or an empty one."""
    out = file
    for suffix in reversed(suffixes or (".json",)):
        out = F.when(file.endswith(suffix), F.substring(file, F.lit(1), F.length(file) - len(suffix))).otherwise(out)
    return F.when(F.coalesce(out, F.lit("")) != "", out)


def stem_course(c: Column) -> Column:
    """``DEPT-NUM`` of a stem; null with fewer than three parts."""
    p = F.split(c, "_")
    return F.when(F.size(p) >= 3, F.concat_ws("-", F.upper(F.get(p, F.lit(1))), F.get(p, F.lit(2))))


def stem_fields(c: Column) -> Column:
    """course_id, section, term, crn, term_code of a stem of five parts or more; else null."""
    p = F.split(c, "_")
    at = lambda i: F.get(p, F.lit(i))
    return F.when(F.size(p) >= 5, F.struct(F.concat_ws(" ", at(1), at(2)).alias("course_id"), at(3).alias("section"), times.code_to_term(at(0)).alias("term"), at(4).alias("crn"), at(0).alias("term_code")))


def fix_code(code: Column, stem_: Column) -> Column:
    """A bare number gets the stem's department, a missing space comes in; null and empty stay."""
    trimmed = F.trim(code)
    bare = ~trimmed.rlike(r"(?U)\p{L}")
    fixed = F.when(bare, F.concat_ws(" ", F.upper(F.get(F.split(stem_, "_"), F.lit(1))), trimmed)).otherwise(F.regexp_replace(trimmed, r"^([A-Z]{2,5})(\d+[A-Z]?)$", "$1 $2"))
    return F.when(F.coalesce(code, F.lit("")) == "", code).otherwise(fixed)


def source_of(stem_: Column, known: Column) -> Column:
    """howdy_portal for a ``_HP`` stem, else where it is known from, else unknown."""
    return F.when(stem_.endswith("_HP"), "howdy_portal").otherwise(F.coalesce(known, F.lit("unknown")))


def location(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)^ONLINE\s+ONLINE$"), "Online").otherwise(c)


def anchor(course: Column, section: Column, term: Column, path: Column) -> Column:
    """``course Section s, term - leaf:`` with the last header of the path, General without one."""
    leaf = F.when(F.coalesce(path, F.lit("")) == "", "General").otherwise(F.substring_index(path, " > ", -1))
    return F.concat(course, F.lit(" Section "), section, F.lit(", "), term, F.lit(" — "), leaf, F.lit(":"))


def _terms(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda t: t != "")


def distinct_terms(terms: Column, but: Column | None = None) -> Column:
    """Terms once each in either case, the first form of each, without those of ``but``."""
    start = F.coalesce(but, F.array().cast("array<string>")) if but is not None else F.array().cast("array<string>")

    def step(s: Column, t: Column) -> Column:
        new = ~F.array_contains(s["seen"], F.lower(t))
        return F.struct(F.when(new, F.concat(s["seen"], F.array(F.lower(t)))).otherwise(s["seen"]).alias("seen"), F.when(new, F.concat(s["out"], F.array(t))).otherwise(s["out"]).alias("out"))

    zero = F.struct(start.alias("seen"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(terms, zero, step, lambda s: s["out"])


def topics(summary: Column) -> Column:
    """Terms of a summary's first ``Topics:`` line, once each; empty without one."""
    line = F.get(F.filter(F.split(F.coalesce(summary, F.lit("")), "\n"), lambda x: F.trim(x).startswith("Topics:")), F.lit(0))
    return F.coalesce(distinct_terms(_terms(F.regexp_replace(line, "^[^:]*:", ""))), F.array().cast("array<string>"))


def n_topics(summary: Column) -> Column:
    """Terms of the first ``Topics:`` line, repeated ones too."""
    line = F.get(F.filter(F.split(F.coalesce(summary, F.lit("")), "\n"), lambda x: F.trim(x).startswith("Topics:")), F.lit(0))
    return F.coalesce(F.size(_terms(F.regexp_replace(line, "^[^:]*:", ""))), F.lit(0))


def _labelled(line: Column, label: str) -> Column:
    return F.regexp_extract(line, rf"^(\s*){label}:\s*(.*)", 2)


def tidy_summary(summary: Column) -> Column:
    """Topics once each, tools that are no topics, no line kinds that summaries no longer have."""
    is_ = lambda line, label: line.rlike(rf"^\s*{label}:")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("seen"), none.alias("out"))

    def step(s: Column, line: Column) -> Column:
        indent = F.regexp_extract(line, r"^(\s*)", 1)
        fresh = distinct_terms(_terms(_labelled(line, "Topics")), s["seen"])
        tools = F.filter(_terms(_labelled(line, "Tools")), lambda t: ~F.array_contains(s["seen"], F.lower(t)))
        put = lambda text: F.concat(s["out"], F.array(text))
        out = (
            F.when(is_(line, "Topics"), put(F.concat(indent, F.lit("Topics: "), F.array_join(fresh, ", "))))
            .when(is_(line, "Tools"), F.when(F.size(tools) > 0, put(F.concat(indent, F.lit("Tools: "), F.array_join(tools, ", ")))).otherwise(s["out"]))
            .when(is_(line, "(?:" + "|".join(LEGACY_LINES) + ")"), s["out"])
            .otherwise(put(line))
        )
        return F.struct(F.when(is_(line, "Topics"), F.concat(s["seen"], F.transform(fresh, F.lower))).otherwise(s["seen"]).alias("seen"), out.alias("out"))

    return F.array_join(F.aggregate(F.split(summary, "\n"), start, step, lambda s: s["out"]), "\n")


def drop_generic_topics(summary: Column) -> Column:
    """``Topics:`` lines without terms that say nothing."""
    kept = lambda line: F.array_join(F.filter(_terms(F.regexp_extract(line, r"^\s*Topics:\s*(.*)", 1)), lambda t: ~F.lower(t).isin(*GENERIC_TOPICS)), ", ")
    one = lambda line: F.when(line.rlike(r"^\s*Topics:"), F.concat(F.regexp_extract(line, r"^(\s*Topics:\s*)", 1), kept(line))).otherwise(line)
    return F.array_join(F.transform(F.split(summary, "\n"), one), "\n")


def head_with_id(summary: Column, course: Column) -> Column:
    """The summary's first line begins with the course where it doesn't name it; empty ones stay."""
    first = F.substring_index(summary, "\n", 1)
    put = F.concat(course, F.lit(" "), F.regexp_replace(first, r"^[| ]+", ""), F.substring(summary, F.length(first) + 1, F.length(summary)))
    blank = (F.coalesce(summary, F.lit("")) == "") | (F.coalesce(course, F.lit("")) == "")
    return F.when(blank | F.contains(first, course), summary).otherwise(put)


def summary_head(line: Column) -> Column:
    """(ids, title) of ``A 1 / B 2 | Title | Term``: no ids without a bar, no title where it is blank."""
    parts = F.transform(F.split(line, r"\|"), lambda x: F.trim(x))
    ids = F.filter(F.transform(F.split(F.replace(parts[0], F.lit(","), F.lit("/")), "/"), normalize_id), lambda x: x != "")
    title = F.get(parts, F.lit(1))
    enough = F.size(parts) >= 2
    return F.struct(F.when(enough, ids).otherwise(F.array().cast("array<string>")).alias("ids"), F.when(enough & (title != ""), title).alias("title"))


def cache_key(prefix: Column, ids: Column, query: Column) -> Column:
    """prefix, sorted ids (left out where null) and normalised query, joined by bars."""
    told = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(ids), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    return F.concat_ws("|", prefix, told, T.normalize_query(query))


def function_of(n_courses: Column, recursive: Column, intent: Column) -> Column:
    """Which retrieval a routed question takes."""
    return F.when((n_courses == 0) & intent.isNull(), "out_of_scope").when(n_courses == 0, "semantic_general").when(recursive, "recursive").otherwise("hybrid_course")


def mode_of(n_courses: Column, recursive: Column) -> Column:
    return F.when(n_courses == 0, "semantic").when(recursive, "hybrid").otherwise("hybrid_course")


def dynamic_k(function: Column, n_courses: Column, anchor_pass: Column) -> Column:
    """(retrieve_k, rerank_k): each course's share times the courses, capped; the whole corpus isn't scaled."""
    share = lambda name, i: F.lit(PER_COURSE[name][i])
    of = lambda i: F.when(function == "recursive", share("recursive", i)).otherwise(share("hybrid_course", i))
    n = F.greatest(n_courses, F.lit(1))
    base = (F.when(anchor_pass, share("hybrid_course", 0)).otherwise(of(0)), F.when(anchor_pass, share("recursive", 1)).otherwise(of(1)))
    return F.struct(*[F.when(function == "semantic_general", share("semantic_general", i)).otherwise(F.least(base[i] * n, F.lit(CAPS[i]))).alias(name) for i, name in enumerate(("retrieve_k", "rerank_k"))])


def repaired(ids: Column, known: Column, rewritten: Column, subqueries: Column, query: Column, recursive: Column, most: int = 4) -> Column:
    """A routed question made sound: course ids that are known, once each; different sub-queries, the rewrite first, at most ``most``; never none."""
    kept = F.array_distinct(F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), normalize_id), lambda x: F.array_contains(known, x)))
    asked = F.concat(F.array(F.coalesce(rewritten, F.lit(""))), F.coalesce(subqueries, F.array().cast("array<string>")))
    asked = F.filter(F.transform(F.filter(asked, lambda s: s.isNotNull()), lambda x: F.trim(x)), lambda s: T.normalize_query(s) != "")

    def step(s: Column, x: Column) -> Column:
        key = T.normalize_query(x)
        new = ~F.array_contains(s["seen"], key)
        return F.struct(F.when(new, F.concat(s["seen"], F.array(key))).otherwise(s["seen"]).alias("seen"), F.when(new, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    none = F.array().cast("array<string>")
    once = F.slice(F.aggregate(asked, F.struct(none.alias("seen"), none.alias("out")), step, lambda s: s["out"]), 1, most)
    filled = let(once, lambda q: F.when(F.size(q) > 0, q).otherwise(F.array(F.coalesce(F.nullif(rewritten, F.lit("")), query))))
    return F.struct(kept.alias("course_ids"), filled.alias("subqueries"), (recursive & (F.size(kept) > 0)).alias("recursive"))


def rewrite_citations(answer: Column, stems: Column, prefix: str = "/app/static/syllabi") -> Column:
    """``[Source n, p.x]`` becomes a link to the n-th source's page; numbers out of range stay, a source without a file gives its label alone."""
    pattern = r"\[Source\s+(\d+)(?:,\s*p\.(\d+))?\]"
    marks = F.array_distinct(F.regexp_extract_all(answer, F.lit(pattern), F.lit(0)))

    def one(text: Column, mark: Column) -> Column:
        n, page = F.regexp_extract(mark, pattern, 1).try_cast("int"), F.regexp_extract(mark, pattern, 2)
        paged = F.when(page != "", F.concat(F.lit(", p."), page)).otherwise("")
        label = F.concat(F.lit("\\[S"), n.cast("string"), paged, F.lit("\\]"))
        file = stem(F.get(stems, n - 1), ".pdf", ".json")
        url = F.concat(F.lit(prefix + "/"), file, F.lit(".pdf"), F.when(page != "", F.concat(F.lit("#page="), page)).otherwise(""))
        new = F.when(file.isNull(), label).otherwise(F.concat(F.lit("["), label, F.lit("]("), url, F.lit(")")))
        return F.when((n >= 1) & (n <= F.size(stems)), F.replace(text, mark, new)).otherwise(text)

    return F.aggregate(marks, answer, one)


def template_noise(c: Column) -> Column:
    """A section without the labels and empty fields of its template."""
    out = F.regexp_replace(c, r"^Prerequisite/Corequisite\(s\):\s*", "")
    out = F.regexp_replace(out, r"(?m)^This material Is: \w+\n?", "")
    out = F.regexp_replace(out, r"(?i)^Upon completion of this course, the (?:student|learner) will be able to:\n?", "")
    out = F.array_join(F.filter(T.lines(out), lambda x: F.trim(x) != "None"), "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_policy(c: Column) -> Column:
    """A policy without quotes and braces that leaked in from its encoding; null if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(c, r"['‘’]\s*\n\s*['‘’]", "\n\n"), r"[}\"'‘’]+\s*$", "")
    return F.nullif(F.regexp_replace(out, r"^\s+|\s+$", ""), F.lit(""))


def fix_failing_cutoff(cutoffs: Column) -> Column:
    """(grade, min_percent) entries with F at 0 where a better grade has an entry too."""
    grade = lambda c: F.upper(F.trim(F.coalesce(c["grade"], F.lit(""))))
    ladder = F.exists(cutoffs, lambda c: grade(c).isin("A", "B", "C", "D"))
    return F.transform(cutoffs, lambda c: F.struct(c["grade"].alias("grade"), F.when(ladder & (grade(c) == "F") & c["min_percent"].isNotNull(), F.lit(0.0)).otherwise(c["min_percent"]).alias("min_percent")))


def file_flags(tokens: Column, sections: Column, flagged: Column, enriched: Column) -> Column:
    """What is odd about a file, comma-joined: size, no headers, flagged chunks, nothing known of it."""
    return F.concat_ws(", ", F.when(tokens > 10_000, "MASSIVE_FILE"), F.when(tokens < 300, "TINY"), F.when(sections == 0, "ZERO_HEADERS"), F.when(flagged > 0, F.concat(F.lit("OVERSIZED("), flagged.cast("string"), F.lit(")"))), F.when(~enriched, "NO_ENRICHMENT"))


def drop_reason(is_boilerplate: Column, is_duplicate: Column) -> Column:
    """boilerplate before duplicate; null for a chunk that is kept."""
    return F.when(F.coalesce(is_boilerplate, F.lit(False)), "boilerplate").when(F.coalesce(is_duplicate, F.lit(False)), "duplicate")


def slug(term: Column, subject: Column, course: Column, section: Column, crn: Column) -> Column:
    """``Spring-2026-College-Station-CSCE-605-600-(1)``."""
    prefix = F.replace(F.replace(term, F.lit(" - "), F.lit("-")), F.lit(" "), F.lit("-"))
    return F.concat_ws("-", prefix, subject, course, section, F.concat(F.lit("("), crn, F.lit(")")))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
