"""Search terms: words without stop words, cut to stems by rules that Spark and SQL share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylake.functions import text as T

#: English function words, which a text search leaves out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

#: Rules in lists; of each list the first pattern that a word matches cuts letters from its end and adds some.
RULES = (
    ((r"sses$", 2, ""), (r"ies$", 2, ""), (r"ss$", 0, ""), (r"[^s]s$", 1, "")),
    (
        (r"[aeiouy][^aeiouy].*eed$", 1, ""),
        (r"eed$", 0, ""),
        (r"(at|iz|[aeiouy].*bl)ed$", 2, "e"),
        (r"(at|iz|[aeiouy].*bl)ing$", 3, "e"),
        (r"[aeiouy](bb|dd|ff|gg|mm|nn|pp|rr|tt)ed$", 3, ""),
        (r"[aeiouy](bb|dd|ff|gg|mm|nn|pp|rr|tt)ing$", 4, ""),
        (r"[aeiouy].*ed$", 2, ""),
        (r"[aeiouy].*ing$", 3, ""),
    ),
    ((r"[aeiouy].*y$", 1, "i"),),
)


def stem(word: Column) -> Column:
    """A lower-case word without plural, past and -ing endings, final y as i (Porter's first step)."""
    for rules in RULES:
        out = None
        for pattern, cut, add in rules:
            new = F.concat(F.substring(word, F.lit(1), F.length(word) - cut), F.lit(add)) if cut or add else word
            out = F.when(word.rlike(pattern), new) if out is None else out.when(word.rlike(pattern), new)
        word = out.otherwise(word)
    return word


def search_terms(text: Column, stems: bool = True) -> Column:
    """Array of a text's terms, in order and with repeats; with ``stems`` no stop words, and stems for words."""
    found = T.words(T.normalize_text(F.coalesce(text, F.lit(""))))
    if not stems:
        return found
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def search_terms_sql(text: str, words: str) -> str:
    """DuckDB text of the same list, before stems; ``words`` is a template of a text's words."""
    listed = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter({words.format(text)}, lambda w: w NOT IN ({listed}))"


def stem_sql(word: str) -> str:
    """DuckDB text of a word's stem."""
    for rules in RULES:
        cases = " ".join(f"WHEN regexp_matches({word}, '{pattern}') THEN left({word}, length({word}) - {cut}) || '{add}'" for pattern, cut, add in rules)
        word = f"(CASE {cases} ELSE {word} END)"
    return word
