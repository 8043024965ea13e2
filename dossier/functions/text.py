"""Text functions on columns: folding, safe names, statistics, case, line operations. No Python UDFs.

Java's \\s and \\b know less (or more) than the intended classes, so both are spelled out. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that fold to a space, to a hyphen (also dashes, for detection), and that are dropped.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\u2012\u2212\ufe58\ufe63\uff0d"
DASHES = "\u2013\u2014\u2015"
DROPPED = "\u00ad\u200b\u200c\u200d\ufeff"
#: White space as a regular expression class body.
WS = r"\x09-\x0D\x20\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: One such character, and any other one; what ASCII prints is told first, as most characters are that.
SPACE, OTHER = rf"[[^!-~]&&[{WS}]]", rf"[!-~[^{WS}]]"
WORD_START, WORD_END = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
#: Device names that Windows keeps for itself (fixed values).
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])\z"


def s(c) -> Column:
    """A string column; null becomes empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def sub(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def trim(c: Column) -> Column:
    return sub(c, rf"^{SPACE}+|{SPACE}+\z")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(sub(c, rf"{SPACE}+", " "))


def norm_chars(c: Column) -> Column:
    """One to one: no-break and typographic spaces and hyphens become ASCII."""
    return F.translate(s(c), SPACES + HYPHENS, " " * len(SPACES) + "-" * len(HYPHENS))


def norm_text(c: Column) -> Column:
    return F.translate(s(c), SPACES + HYPHENS + DROPPED, " " * len(SPACES) + "-" * len(HYPHENS))


def norm_number(c: Column) -> Column:
    """For the detection of document numbers: dashes are hyphens too."""
    marks = HYPHENS + DASHES
    return F.translate(s(c), SPACES + marks + DROPPED, " " * len(SPACES) + "-" * len(marks))


def sanitize(c: Column) -> Column:
    """A name that Windows accepts: no control or bidirectional marks, no path characters, single spaces."""
    bare = sub(s(c), r"[\x00-\x1f\x7f\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff]")
    return collapse(sub(bare, r'[\\/:*?"<>|]', " "))


def clean_title(c: Column) -> Column:
    plain = F.translate(s(c), "\u2018\u2019\u02bc\u2032\u201c\u201d\u2033", "''''\"\"\"")
    return sub(sanitize(plain), rf"[.{WS}]+\z")


def is_reserved(c: Column) -> Column:
    return s(c).rlike(RESERVED)


def squash(c: Column) -> Column:
    return trim(sub(s(c), r"[ \t]+", " "))


def digits_only(c: Column) -> Column:
    return sub(s(c), r"[^0-9]")


def compact(c: Column) -> Column:
    return sub(F.lower(s(c)), r"[^a-z0-9]")


def caps_ratio(c: Column) -> Column:
    letters, capitals = F.length(sub(s(c), "[^A-Za-z]")), F.length(sub(s(c), "[^A-Z]"))
    return F.when(letters == 0, F.lit(0.0)).otherwise(capitals / letters)


def title_case(c: Column) -> Column:
    """Lower case with each ASCII letter that follows no word character in upper case."""
    parts = F.regexp_extract_all(F.lower(s(c)), F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    up = F.transform(parts, lambda p: F.when(p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(p))
    return F.array_join(up, "")


def words(c: Column) -> Column:
    """Words of an identifier or a sentence: parted at _ - . and white space and at camel humps, lower-cased."""
    humps = sub(sub(s(c), r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\-" + WS + "]+", " ")
    return F.filter(F.split(F.lower(F.trim(humps)), " "), lambda w: w != "")


def to_case(c: Column, kind: str) -> Column:
    """kind: upper, lower, title, sentence, camel, snake, kebab, constant, invert."""
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    if kind == "upper":
        return F.upper(s(c))
    if kind == "lower":
        return F.lower(s(c))
    if kind == "title":
        return title_case(c)
    if kind == "sentence":
        parts = F.regexp_extract_all(F.lower(s(c)), F.lit(rf"([^.!?]*[.!?]*[{WS}]*)"), F.lit(1))
        return F.array_join(F.transform(parts, lambda p: F.concat(F.regexp_extract(p, rf"^([^a-z]*)", 1), cap(sub(p, r"^[^a-z]*")))), "")
    if kind == "camel":
        return F.array_join(F.transform(words(c), lambda w, i: F.when(i == 0, w).otherwise(cap(w))), "")
    if kind in ("snake", "kebab", "constant"):
        joined = F.array_join(words(c), "-" if kind == "kebab" else "_")
        return F.upper(joined) if kind == "constant" else joined
    if kind == "invert":
        low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return F.translate(s(c), low + up, up + low)
    raise ValueError(f"unknown case {kind}")


def stats(c: Column) -> dict[str, Column]:
    """words, chars, chars_no_space, lines, sentences, paragraphs, reading_minutes (at 200 words a minute), a column each."""
    text = s(c)
    n_words = F.regexp_count(text, F.lit(f"{OTHER}+"))
    blank = ~text.rlike(OTHER)
    return {
        "words": n_words,
        "chars": F.length(text),
        "chars_no_space": F.length(sub(text, f"{SPACE}+")),
        "lines": F.when(text == "", 0).otherwise(F.size(lines(text))),
        "sentences": F.when(blank, 0).otherwise(F.greatest(F.lit(1), F.regexp_count(text, F.lit(rf"[.!?]+(?={SPACE}|\z)")))),
        "paragraphs": F.size(F.filter(F.split(text, r"\n[\x20\t]*\n"), lambda p: p.rlike(OTHER))),
        "reading_minutes": F.ceil(n_words / 200).cast("int"),
    }


def lines(c: Column) -> Column:
    return F.split(s(c), r"\r\n|\r|\n", -1)


def line_op(c: Column, kind: str) -> Column:
    """kind: unique (first kept), trim, dropblank, collapse, sort, rsort, reverse."""
    parts = lines(c)
    done = {
        "unique": lambda: F.array_distinct(parts),
        "trim": lambda: F.transform(parts, trim),
        "dropblank": lambda: F.filter(parts, lambda p: trim(p) != ""),
        "collapse": lambda: F.transform(parts, lambda p: sub(p, r"[ \t]+", " ")),
        "sort": lambda: F.array_sort(parts),
        "rsort": lambda: F.reverse(F.array_sort(parts)),
        "reverse": lambda: F.reverse(parts),
    }
    return F.array_join(done[kind](), "\n")


def replace_all(c: Column, find: str, by: str, regex: bool = False, ignore_case: bool = False) -> Column:
    """struct(text, n): the text after all replacements and how many there were."""
    import re

    pattern = ("(?i)" if ignore_case else "") + (find if regex else re.escape(find))
    by = by if regex else by.replace("\\", "\\\\").replace("$", "\\$")
    return F.struct(sub(s(c), pattern, by).alias("text"), F.regexp_count(s(c), F.lit(pattern)).alias("n"))


def line_signature(c: Column) -> Column:
    """What repeated page furniture has in common: lower case, digit runs as #; empty under four letters."""
    low = F.lower(s(c))
    return F.when(low.rlike("[a-z](?:[^a-z]*[a-z]){3}"), collapse(sub(low, r"\d+", "#"))).otherwise(F.lit(""))


def norm_token(c: Column) -> Column:
    """A word without hyphens inside and punctuation at its ends; as it was if nothing is left."""
    bare = sub(sub(s(c), r"[\-\u2010\u2011]"), r"^[\p{Punct}]+|[\p{Punct}]+\z")
    return F.when(bare == "", s(c)).otherwise(bare)


def is_stamp_line(c: Column) -> Column:
    """A line of dates and times alone."""
    bare = sub(sub(s(c), r"\d{1,4}[./\-]\d{1,2}[./\-]\d{1,4}"), r"(?i)\d{1,2}:\d{2}(:\d{2})?[ ]*([ap]\.?m\.?)?")
    return (bare != s(c)) & (sub(bare, rf"[{WS},;|\-]") == "")


def join_hyphen(parts: Column) -> Column:
    """Lines in one: a word hyphenated at a line's end is joined again, a hyphen in a code stays."""
    soft = lambda out, t: out.rlike(r"[A-Za-z][\-\u2010\u2011]\z") & t.rlike("^[A-Za-z]")
    step = lambda out, t: F.when(out.isNull(), t).when(soft(out, t), F.concat(sub(out, r"[\-\u2010\u2011]\z"), t)).otherwise(F.concat(out, F.lit(" "), t))
    return F.coalesce(F.aggregate(parts, F.lit(None).cast("string"), step), F.lit(""))


def clip_name(c: Column, most: int = 140) -> Column:
    """A safe name of at most `most` characters that keeps its extension; empty becomes "file"."""
    name = sub(sanitize(c), r"[. ]+\z")
    ext = F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,8})\z", 1)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    short = F.when(F.length(name) > most, F.concat(F.substring(base, F.lit(1), F.lit(most) - F.length(ext)), ext)).otherwise(name)
    safe = F.when(is_reserved(sub(short, r"\.[^.]*\z")), F.concat(F.lit("_"), short)).otherwise(short)
    return F.when(safe == "", F.lit("file")).otherwise(safe)


def format_bytes(c: Column, decimals: int | None = None, units: int = 4) -> Column:
    """1023 B, 1.5 KB, 12 MB: one decimal under ten units, or always `decimals`; up to so many units of B, KB, MB, GB, TB."""
    n = F.coalesce(c.cast("double"), F.lit(0.0))

    def shown(v: Column, unit: str) -> Column:
        whole = F.round(v).cast("long").cast("string")
        number = F.format_string(f"%.{decimals}f", v) if decimals is not None else F.when(v < 10, F.format_string("%.1f", v)).otherwise(whole)
        return F.concat(number, F.lit(f" {unit}"))

    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    names = ("B", "KB", "MB", "GB", "TB")[:units]
    for k, unit in enumerate(names[1:-1], 1):
        out = out.when(n < 1024 ** (k + 1), shown(n / 1024**k, unit))
    return out.otherwise(shown(n / 1024 ** (units - 1), names[-1]))


def natural_key(c: Column) -> Column:
    """A sort key that takes digit runs as numbers and no notice of case: each run of digits gets its length before it."""
    runs = F.regexp_extract_all(F.lower(s(c)), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda d: F.when(sub(d, "^0+") == "", F.lit("0")).otherwise(sub(d, "^0+"))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(r)).cast("string"), 3, "0"), bare(r))).otherwise(r)), "")
