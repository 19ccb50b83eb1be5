"""Text functions as column expressions: normalisation, tokens, headers, signals, clean-up.

Each takes and gives columns, stays in the JVM and leaves null null unless its text says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, in code order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Phrases that mark an answer as holding no information.
NO_INFORMATION = ("(out of scope)", "does not contain any information", "no information about", "not available in the syllabus")
#: Words that ask for more when a text ends with them.
OPEN_ENDS = ("in", "of", "the", "a", "an", "and", "or", "for", "to", "with", "from")
#: A percentage; a date that something is due.
PERCENT = r"\b\d{1,3}(?:\.\d+)?\s*%"
DUE_DATE = r"(?i)\b(?:due|deadline|submitted by)\b[^.\n]{0,40}?(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2}|\d{1,2}/\d{1,2}(?:/\d{2,4})?)"
#: Words that lost a doubled letter.
LETTER_DROPS = ("Colege", "Sylabus", "Meting", "Aditional", "Textbok", "wil", "fal", "instaling")
#: Common words as they look where a text layer lost its f-ligatures.
LIGATURE_DAMAGE = (
    "ofce ofcial ofcer ofcers confdential confdentiality confdentially signifcant signifcantly difcult difculty difculties beneft benefts fnal fnally specifc specifcally specifed "
    "certifcate certifcation notifcation notifed notifes fexible fexibility fnancial afliated afliation sufcient sufciently efcient efciency profcient profciency "
    "classifcation classifed modifcation modifed qualifcation qualifed"
).split()
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def collapse(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case, no ASCII punctuation, single spaces."""
    return collapse(F.translate(F.lower(c), PUNCTUATION, ""))


def fold_ligatures(c: Column) -> Column:
    """f-ligatures, as characters or letter groups, become a single f: for shingles, never for ids."""
    return F.regexp_replace(c, "ffi|ffl|ff|fi|fl|[ﬀ-ﬄ]", "f")


def normalize_query(c: Column) -> Column:
    """Lower case, only word characters and single spaces."""
    return collapse(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""))


def token_estimate(c: Column) -> Column:
    """Quarter of the length, halves to even."""
    return F.bround(F.length(c) / 4.0).cast("long")


def token_floor(c: Column) -> Column:
    """At least 1, else the whole quarters of the length."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4.0)).cast("long")


def words(c: Column) -> Column:
    """Array of the words of a normalised text; empty for an empty text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def ngrams(tokens: Column, n: int = 5) -> Column:
    """All runs of ``n`` tokens, space-joined; none for fewer tokens."""
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the common part over that of the union; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def content_tokens(c: Column) -> Column:
    """Distinct lower-cased tokens of four or more characters (addresses and numbers whole), edge dots, slashes, colons, dashes stripped."""
    raw = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9][A-Za-z0-9./:@_+#-]{2,}[A-Za-z0-9@_+#]"), F.lit(0))  # begins and ends with what isn't stripped
    return F.array_distinct(F.transform(raw, F.lower))


def stable_cluster_id(normalized: Column) -> Column:
    """bp_ and the first 16 digits of the normalised text's SHA-256."""
    return F.concat(F.lit("bp_"), F.substring(F.sha2(normalized, 256), 1, 16))


def stable_item_id(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 16)


def content_hash(c: Column) -> Column:
    """SHA-256 of the trimmed, lower-cased text."""
    return F.sha2(F.lower(F.trim(c)), 256)


def lines(c: Column) -> Column:
    """Lines as any line break ends them; a closing break opens no further line."""
    return F.split(F.regexp_replace(c, "(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])$", ""), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def normalize_header(c: Column) -> Column:
    """First line without heading marks and closing colons, normalised."""
    first = F.substring_index(F.regexp_replace(c, r"^\s+", ""), "\n", 1)
    return normalize_text(F.regexp_replace(F.trim(F.regexp_replace(first, "^#+", "")), ":+$", ""))


def strip_heading_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^#{1,6}\s+", "")


def has_table(c: Column) -> Column:
    """Whether a line holds two bars."""
    return F.coalesce(c.rlike(r"\|.*\|"), F.lit(False))


def course_signal(c: Column) -> Column:
    """What ties a text to one course: its first percentage, else its first due date, with a label; else null."""
    percent, due = F.trim(F.regexp_extract(c, PERCENT, 0)), F.trim(F.regexp_extract(c, DUE_DATE, 0))
    return F.when(percent != "", F.concat(F.lit("percent:"), percent)).when(due != "", F.concat(F.lit("due_date:"), due))


def protected_signal(c: Column) -> Column:
    """What keeps a text from being hidden as a duplicate: its first URL, else ``course_signal``."""
    url = F.substring(F.regexp_replace(F.regexp_extract(c, r"(?i)https?://\S+|\bwww\.\S+", 0), r"[.,);]+$", ""), 1, 60)
    return F.when(url != "", F.concat(F.lit("url:"), url)).otherwise(course_signal(c))


def _any_word(words: tuple[str, ...] | list[str]) -> str:
    """A pattern of whole words, by their first letter, which is looked at before all else."""
    first = {w[0]: [] for w in words}
    for w in words:
        first[w[0]].append(w[1:])
    return rf"(?=[{''.join(first)}])\b(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in first.items()) + r")\b"


def letter_drops(c: Column) -> Column:
    """How many words lost a doubled letter."""
    return F.regexp_count(c, F.lit(_any_word(LETTER_DROPS)))


def ligature_damage(c: Column) -> Column:
    """How many words lost an f-ligature, in either case."""
    return F.regexp_count(c, F.lit("(?i)" + _any_word(LIGATURE_DAMAGE)))


def replacement_chars(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))


def citations(c: Column) -> Column:
    """Number of [Source n] marks."""
    return F.regexp_count(c, F.lit(r"\[Source \d+"))


def has_citation(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\[Source \d+"), F.lit(False))


def strip_thinking(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<thinking>.*?</thinking>\s*", "")


def sanitize_json(c: Column) -> Column:
    """No control characters that JSON forbids, no backslash that escapes nothing."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\0"), F.lit("")), r'\\([^"\\/bfnrtu0-9])', r"\\\\$1"), _CONTROL, "")


def json_body(c: Column) -> Column:
    """The outermost braces of an answer that may be fenced or have prose around it; null if there are none."""
    body = F.regexp_extract(sanitize_json(c), r"(?s)\{.*\}", 0)
    return F.when(body != "", body)


def squeeze_spaces(c: Column) -> Column:
    """Three or more white-space characters become one space."""
    return F.regexp_replace(c, r"\s{3,}", " ")


def fix_broken_urls(c: Column) -> Column:
    """A URL's space goes where what follows goes on like an address: a slash, a dotted name or a query in it."""
    return F.regexp_replace(c, r"(https?://\S+)\s+([A-Za-z0-9][\w./?=&%-]*(?:/|\.[\w]+|[?=&])\S*)", "$1$2")


def collapse_spaced_caps(c: Column) -> Column:
    """``T I T L E`` becomes ``TITLE``: spaces go from runs of four or more capitals that each stand alone."""
    around = (("", r"[A-Z]\s[A-Z]\s"), (r"[A-Z]\s", r"[A-Z]\s"), (r"[A-Z]\s[A-Z]\s", ""))
    return F.regexp_replace(c, "|".join(rf"(?<=\b{before}[A-Z]) (?={after}[A-Z]\b)" for before, after in around), "")


def is_truncated(c: Column) -> Column:
    """Ends with a comma or a word that asks for more."""
    end = F.regexp_replace(c, r"\s+$", "")
    return F.coalesce(end.endswith(",") | F.lower(F.regexp_extract(end, r"(\S+)$", 1)).isin(*OPEN_ENDS), F.lit(False))


def is_empty_answer(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True)) | F.coalesce(F.exists(F.array(*map(F.lit, NO_INFORMATION)), lambda p: F.contains(F.lower(c), p)), F.lit(False))


def coerce_bool(c: Column) -> Column:
    """false, 0, no and blank are false; all else is true."""
    return ~F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin("false", "0", "no", "")


def classify_error(c: Column) -> Column:
    """Class of an error message; the first that fits."""
    low = F.lower(F.coalesce(c, F.lit("")))
    holds = lambda *parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p))
    return (
        F.when(holds("json parse error"), "JSON_PARSE_ERROR")
        .when(holds("ssl", "certificate"), "SSL_ERROR")
        .when(holds("getaddrinfo", "name or service not known", "nodename nor servname"), "DNS_ERROR")
        .when(holds("429", "quota", "rate"), "RATE_LIMIT")
        .when(holds("exhausted retries"), "EXHAUSTED_RETRIES")
        .otherwise("UNKNOWN_ERROR")
    )


def generic_reference(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"\b(the|this) (course|class|instructor|syllabus)\b"), F.lit(False))


def html_text(c: Column) -> Column:
    """Visible main text of a page: scripts, styles, comments, navigation, headers, footers and tags go."""
    out = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "footer", "header", "aside"):
        out = F.regexp_replace(out, rf"(?s)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def links(html: Column) -> Column:
    """Targets of a page's anchors, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def url_slug(url: Column) -> Column:
    """A file name for a URL: no scheme, other than letters and digits become dashes."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(url, r"^[a-z]+://", "")), r"[^a-z0-9]+", "-"), F.lit("-"))


def escape_xml(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def truncate(c: Column, tokens: int, marker: str = "\n\n*[Response truncated — output limit reached]*") -> Column:
    """(text, truncated): at most 4 * ``tokens`` characters, cut back to the last paragraph, line or sentence end (the first of these that is there) in the second half."""
    head = F.substring(c, 1, 4 * tokens)
    at = F.lit(4 * tokens)
    for end in (". ", "\n", "\n\n"):
        back = F.locate(end[::-1], F.reverse(head))
        begins = F.length(head) - back + 1 - len(end)
        at = F.when((back > 0) & (begins >= 2 * tokens), begins + len(end)).otherwise(at)
    over = F.floor(F.length(c) / 4) > tokens
    cut = F.concat(F.regexp_replace(F.substring(head, F.lit(1), at.cast("int")), r"\s+$", ""), F.lit(marker))
    return F.struct(F.when(over, cut).otherwise(c).alias("text"), over.alias("truncated"))
