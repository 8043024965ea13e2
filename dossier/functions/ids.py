"""Document numbers, tool numbers, versions and model series as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import WS, clean_title, collapse, is_reserved, norm_number, norm_text, s, sanitize, sub, trim

# The shapes of document and tool numbers, and of document numbers as recognition may misread them.
NUMBER = r"[A-Z]{2}\d{2}\.\d{2}-[A-Z]-\d{5,7}"
NUMBER_WORD = rf"(?<![A-Za-z0-9_])({NUMBER})(?![A-Za-z0-9_])"
MISREAD = r"([A-Za-z0-9]{2})\s?([0-9OoIlSsBbGgZ]{2})[.,]([0-9OoIlSsBbGgZ]{2})\s?[-\u2013\u2014~]\s?([A-Za-z0-9])\s?[-\u2013\u2014~]\s?([0-9OoIlSsBbGgZ]{5,7})"
TOOL = rf"^(\d{{3}})[{WS}]*(\d{{3}})[{WS}]*(\d{{2}})[{WS}]*(\d{{2}})[{WS}]*(\d{{2}})\z"


def canon_number(c: Column) -> Column:
    """Folded, single-spaced and, if it holds a document number, in upper case."""
    v = collapse(norm_number(c))
    return F.when(F.upper(v).rlike(NUMBER_WORD), F.upper(v)).otherwise(v)


def document_key(c: Column) -> Column:
    return F.concat(F.lit("li:"), F.upper(canon_number(c)))


def detect_number(c: Column) -> Column:
    return F.regexp_extract(norm_number(c), NUMBER_WORD, 1)


def all_numbers(c: Column) -> Column:
    """Every document number in the text, in order, repeats kept."""
    return F.regexp_extract_all(norm_number(c), F.lit(NUMBER_WORD), F.lit(1))


def has_number(c: Column) -> Column:
    return F.upper(norm_number(c)).rlike(NUMBER_WORD)


def is_number(c: Column) -> Column:
    return trim(norm_number(c)).rlike(rf"(?i)^{NUMBER}\z")


def to_digits(c: Column) -> Column:
    return F.translate(c, "OoQIlSsBbZGg", "000115588266")


def to_letters(c: Column) -> Column:
    return F.upper(F.translate(c, "015862", "OISBGZ"))


def detect_misread(c: Column) -> Column:
    """A document number from recognised text, with look-alikes put right; empty unless the result is one."""
    text = norm_number(c)
    g = [F.regexp_extract(text, MISREAD, k) for k in range(1, 6)]
    put = F.concat(to_letters(g[0]), to_digits(g[1]), F.lit("."), to_digits(g[2]), F.lit("-"), to_letters(g[3]), F.lit("-"), to_digits(g[4]))
    return F.when(g[0].rlike("[A-Za-z]") & put.rlike(NUMBER_WORD), put).otherwise(F.lit(""))


def detect_version(c: Column, number: Column) -> Column:
    """The version after the document's own number, else after a word such as Version or Stand; not part of a date."""
    text = norm_text(c)
    end = r"(?![A-Za-z0-9_])(?![.\-/]?\d)"
    own = F.concat(F.lit(r"(?i)\Q"), s(number), F.lit(rf"\E[{WS}]*[_/ ][{WS}]*(?:V|Ver\.?|Version|Rev\.?|Revision)?[{WS}]*(\d{{1,3}}){end}"))
    after = F.when(s(number) != "", F.call_function("regexp_extract", text, own, F.lit(1))).otherwise(F.lit(""))
    named = F.regexp_extract(text, rf"(?i)(?<![A-Za-z0-9_])(?:Version|Revision|Rev\.?|Stand|Ausgabe)[{WS}]*[:.]?[{WS}]*(\d{{1,3}}){end}", 1)
    return F.when(after != "", after).otherwise(named)


def version_number(c: Column) -> Column:
    """The number that a version begins with ("3a": 3.0); 0 if none."""
    head = F.regexp_extract(s(c), rf"^[{WS}]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(F.when(head != "", head.try_cast("double")), F.lit(0.0))


def norm_tool(c: Column) -> Column:
    return collapse(s(c))


def canon_tool(c: Column) -> Column:
    """Groups of 3 3 2 2 2 digits with single spaces; empty if it is no tool number."""
    t = trim(s(c))
    return F.when(t.rlike(TOOL), F.regexp_replace(t, TOOL, "$1 $2 $3 $4 $5")).otherwise(F.lit(""))


def models_of_validity(c: Column) -> Column:
    """Model series that a validity text names: after the word model first, then bare items of a comma list."""
    named = F.regexp_extract_all(s(c), F.lit(rf"(?i)model(?:[{WS}]+series)?[{WS}]+(\d{{3}})(?![A-Za-z0-9_])"), F.lit(1))
    listed = F.regexp_extract_all(s(c), F.lit(rf"(?:^|,)[{WS}]*(\d{{3}})[{WS}]*(?=,|\z)"), F.lit(1))
    return F.array_distinct(F.concat(named, listed))


def fits_model(validities: Column, series: Column) -> Column:
    """Whether the three-digit series stands as a word in one of the validities."""
    word = F.concat(F.lit("(?<![A-Za-z0-9_])"), series, F.lit("(?![A-Za-z0-9_])"))
    return F.coalesce(series.rlike(r"^\d{3}\z") & F.exists(validities, lambda v: F.regexp_like(v, word)), F.lit(False))


def series_words(validities: Column) -> Column:
    """All three-digit words of the validities: the keys of an equi join with model series."""
    return F.array_distinct(F.flatten(F.transform(validities, lambda v: F.regexp_extract_all(s(v), F.lit(r"(?<![A-Za-z0-9_])(\d{3})(?![A-Za-z0-9_])"), F.lit(1)))))


def group_members(c: Column) -> Column:
    return F.filter(F.split(s(c), rf"[,/{WS}]+"), lambda g: g != "")


def first_group(c: Column) -> Column:
    """The first two-digit function group other than 00; null if none."""
    found = F.filter(F.regexp_extract_all(s(c), F.lit(r"(?<![0-9])(\d{2})(?![0-9])"), F.lit(1)), lambda g: g != "00")
    return F.get(found, F.lit(0))


def file_name(number: Column, version: Column, title: Column) -> Column:
    """"<number or document>[_version][ title].pdf", safe and of at most 239 characters."""
    n, v, t = sanitize(number), sub(s(version), "[^0-9]"), clean_title(title)
    base = F.concat(F.when(n == "", F.lit("document")).otherwise(n), F.when(v == "", F.lit("")).otherwise(F.concat(F.lit("_"), v)), F.when(t == "", F.lit("")).otherwise(F.concat(F.lit(" "), t)))
    tail = rf"[.{WS}]+\z"
    cut = sub(F.substring(sub(sanitize(base), tail), 1, 235), tail)
    safe = F.when(is_reserved(cut), F.concat(F.lit("_"), cut)).otherwise(cut)
    return F.concat(F.when(safe == "", F.lit("document")).otherwise(safe), F.lit(".pdf"))


def link_id(from_type: Column, from_id: Column, to_type: Column, to_id: Column, kind: Column) -> Column:
    return F.concat(from_type, F.lit(":"), from_id, F.lit(">"), to_type, F.lit(":"), to_id, F.lit("#"), kind)


def canon_order(c: Column) -> Column:
    """A work-order number without white space, in upper case."""
    return F.upper(sub(s(c), rf"[{WS}]+"))
