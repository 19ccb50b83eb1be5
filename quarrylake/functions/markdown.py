"""Markdown as column expressions: headings, links, image marks, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylake.functions import text as T

#: A link to a mail address or a web page, the mark of an image nothing is known of,
#: a label that is itself an address, a heading that is a filled-in field.
LINK = r"\[([^\]]+)\]\(((?:mailto:|https?://)[^)\s]+)\)"
BARE_IMAGE = "<!-- image -->"
AUTOLINK = r"(?i)^(?:(?:https?://|www\.|mailto:)\S+|[^\s@]+@[^\s@]+\.[^\s@]+|[\w-]+(?:\.[\w-]+)+\.?(?:/\S*)?)$"
FIELD = r"^[A-Z][A-Za-z0-9 /&'\"-]{2,40}:\s.+$"


def headings(c: Column) -> Column:
    """(level, text) of a text's heading lines, in order."""
    marked = F.filter(T.lines(F.coalesce(c, F.lit(""))), lambda x: x.rlike(r"^#{1,6}\s"))
    return F.transform(marked, lambda x: F.struct(F.length(F.regexp_extract(x, "^#+", 0)).alias("level"), F.trim(F.regexp_replace(x, r"^#{1,6}\s+", "")).alias("text")))


def is_suspicious(heading: Column) -> Column:
    """A heading that reads like body text: a filled-in field, over twelve words, or a sentence."""
    t = F.trim(F.coalesce(heading, F.lit("")))
    return (t != "") & (t.rlike(FIELD) | (F.size(F.split(t, r"\s+")) > 12) | t.rlike(r"[.!?]$"))


def header_only(c: Column) -> Column:
    """Whether all lines that aren't blank, at least one, are headings."""
    held = F.filter(F.transform(T.lines(F.coalesce(c, F.lit(""))), lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(held) > 0) & F.forall(held, lambda x: x.startswith("#"))


def links(c: Column) -> Column:
    """(label, target) of the links of a text, in order."""
    c = F.coalesce(c, F.lit(""))
    labels, targets = (F.regexp_extract_all(c, F.lit(LINK), F.lit(i)) for i in (1, 2))
    found = F.zip_with(labels, targets, lambda a, b: F.struct(a.alias("label"), b.alias("target")))
    return F.when(F.contains(c, F.lit("](")), found).otherwise(F.array().cast("array<struct<label:string,target:string>>"))


def without_links(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.when(F.contains(c, F.lit("](")), F.regexp_replace(c, LINK, " ")).otherwise(c)


def link_value(target: Column) -> Column:
    """What a target points at: no scheme, no closing slash."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(target), r"(?i)^(?:mailto:|https?://)", ""), r"/+$", ""))


def is_garbled(label: Column) -> Column:
    """A link label that is a piece of prose: a sentence ends inside it, it runs on in lower case, or a bracket is open."""
    label = F.trim(label)
    count = lambda mark: F.length(label) - F.length(F.replace(label, F.lit(mark), F.lit("")))
    prose = F.substring(label, 1, 1).rlike(r"(?U)\p{Ll}") & (F.size(F.split(label, r"\s+")) >= 4)
    return ~label.rlike(AUTOLINK) & (label.rlike(r"[.!?]\s+[a-z]") | prose | (count("(") != count(")")))


def bare_images(c: Column) -> Column:
    """How often an image left nothing but its mark."""
    c = F.coalesce(c, F.lit(""))
    return ((F.length(c) - F.length(F.replace(c, F.lit(BARE_IMAGE), F.lit("")))) / len(BARE_IMAGE)).cast("int")
