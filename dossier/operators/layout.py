"""Lines, rows and fields from placed text items: group and fold expressions, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.ids import NUMBER_WORD
from dossier.functions.text import WS, clean_title, collapse, join_hyphen, norm_number, norm_text, s, squash, sub

# Beginnings of letterheads, of the number field, and of labelled fields; what dates look like.
HEADER = rf"(?i)^(xentry(?:[{WS}]+(?:tips|diagnosis))?[{WS}]*\z|wis(?![A-Za-z0-9_])|asra(?![A-Za-z0-9_])|star[{WS}]*diagnosis|page[{WS}]*\d|seite[{WS}]*\d|©|copyright(?![A-Za-z0-9_])|printed(?![A-Za-z0-9_])|https?:|www\.)"
NUMBER_FIELD = rf"(?i)^[{WS}]*(topic[{WS}]*number|dokument(nummer|[{WS}]*nr)|document[{WS}]*number|dok\.?[{WS}]*-?[{WS}]*nr|order[{WS}]*number|auftrag)"
LABEL = rf"(?i)^(topic[{WS}]*number|version(?![A-Za-z0-9_])|(?:function|design)[{WS}]*group|date(?![A-Za-z0-9_])|validity(?![A-Za-z0-9_])|reason[{WS}]*for[{WS}]*change|complaint|cause(?![A-Za-z0-9_])|remedy|symptoms?|attachments?|control[{WS}]*unit|fault[{WS}]*text|operation[{WS}]*(numbers?|text)|damage[{WS}]*code|parts(?![A-Za-z0-9_])|note(?![A-Za-z0-9_])|work[{WS}]*instruction|document[{WS}]*number|dokument)"
#: Lines that are no title, however large (fixed values).
SMALL = r"(?i)^(version|revision|seite|page|datum|date|validity|function group|design group)"
DATE = r"\d{1,4}[./\-]\d{1,2}([./\-]\d{1,4})?"


def lines(items: DataFrame) -> DataFrame:
    """(doc, page, y, h, text) of items (doc, page, str, x, y, w, h): items within three units of height are one line.

    A space goes between two items if the gap is over a quarter of the line's height, and one unit.
    """
    rows = items.select("doc", "page", norm_text(F.col("str")).alias("t"), "x", F.round("y").alias("y"), F.abs("h").alias("h"), F.coalesce("w", F.lit(0.0)).alias("w")).where("trim(t) <> ''")
    parts = F.array_sort(F.collect_list(F.struct("x", "t", "w")))
    grouped = rows.groupBy("doc", "page", F.floor(F.col("y") / 3 + 0.5).alias("band")).agg(parts.alias("parts"), F.max("h").alias("h"), F.max("y").alias("y"))
    zero = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"))

    def step(acc, p):
        gap = p["x"] - acc["end"] > F.greatest(F.lit(1.0), F.col("h") * 0.25)
        return F.struct(F.concat(acc["text"], F.when(F.coalesce(gap, F.lit(False)), F.lit(" ")).otherwise(F.lit("")), p["t"]).alias("text"), (p["x"] + p["w"]).cast("double").alias("end"))

    return grouped.select("doc", "page", "y", "h", collapse(F.aggregate("parts", zero, step)["text"]).alias("text"))


def ordered_lines(found: DataFrame) -> DataFrame:
    """(doc, lines): texts and heights from the top of the first page down."""
    item = F.struct("page", (-F.col("y")).alias("o"), "text", "h")
    return found.groupBy("doc").agg(F.array_sort(F.collect_list(item)).alias("lines"))


def field(lines: Column, label: str, valid: str | None = None) -> Column:
    """The value after a label on the first line that has one (and fits `valid`); empty if none."""
    hits = F.filter(lines, lambda x: x["text"].rlike(label))
    values = F.transform(hits, lambda x: F.trim(sub(x["text"], label)))
    values = F.filter(values, lambda v: v.rlike(valid)) if valid else values
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def long_field(lines: Column, label: str) -> Column:
    """As `field`, with up to eight following lines until a label or header, and hyphenated words joined."""
    at = F.coalesce(F.array_position(F.transform(lines, lambda x: x["text"].rlike(label)), True), F.lit(0)).cast("int")
    rest = F.transform(F.slice(lines, at + 1, 8), lambda x: F.trim(x["text"]))
    stops = F.transform(rest, lambda t: (t == "") | t.rlike(LABEL) | t.rlike(NUMBER_FIELD) | t.rlike(HEADER))
    n = F.coalesce(F.nullif(F.array_position(stops, True), F.lit(0)).cast("int") - 1, F.size(rest))
    head = F.trim(sub(F.get(lines, at - 1)["text"], label))
    return F.when(at > 0, join_hyphen(F.concat(F.array(head), F.slice(rest, F.lit(1), n)))).otherwise(F.lit(""))


def norm_date(c: Column) -> Column:
    return F.when(c.rlike(DATE), sub(c, r"(\d)[\-.](?=\d)", "$1/")).otherwise(c)


def title(lines: Column, number: Column, text: Column | None = None) -> Column:
    """What stands above the line with the number; else the lines in the largest type; else what follows the number in text."""
    texts = F.transform(lines, lambda x: F.trim(x["text"]))
    named = F.transform(texts, lambda t: ((s(number) != "") & F.contains(t, s(number))) | t.rlike(NUMBER_FIELD))
    at = F.coalesce(F.array_position(named, True), F.lit(0)).cast("int")
    above = F.filter(F.slice(texts, F.lit(1), F.greatest(at - 1, F.lit(0))), lambda t: (t != "") & ~t.rlike(HEADER))
    top = F.array_max(F.transform(lines, lambda x: x["h"]))
    plain = lambda t: (F.length(t) > 2) & ~norm_number(t).rlike(NUMBER_WORD) & ~t.rlike(HEADER) & ~t.rlike(SMALL)
    big = F.filter(lines, lambda x: (x["h"] >= top - 0.4) & plain(F.trim(x["text"])))
    first, second = clean_title(join_hyphen(above)), clean_title(F.array_join(F.transform(big, lambda x: F.trim(x["text"])), " "))
    after = F.concat(F.lit(r"\Q"), s(number), F.lit(rf"\E(?:[{WS}]*[_/ ][{WS}]*\d{{1,3}})?[{WS}]+([^\r\n]{{4,120}}?)(?:\r|\n|\z)"))
    third = F.lit("") if text is None else F.when(s(number) != "", clean_title(F.call_function("regexp_extract", s(text), after, F.lit(1)))).otherwise(F.lit(""))
    return F.when(F.length(first) >= 4, first).when(F.length(second) >= 4, second).otherwise(third)


def records(found: DataFrame, most: int = 60_000) -> DataFrame:
    """One document record per doc from its lines: number, version, title, labelled fields and the text, cut at a line."""
    from dossier.functions.ids import detect_number, detect_version

    docs = ordered_lines(found)
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    flat = F.array_join(F.transform("lines", lambda x: x["text"]), " ")
    first = F.filter("lines", lambda x: x["page"] == F.col("lines")[0]["page"])
    docs = docs.withColumns({"text": text, "flat": flat, "p1": first}).withColumn("li", detect_number(F.col("flat")))
    cut = F.substring("text", 1, most)
    whole = F.when(F.length("text") > most, F.coalesce(F.nullif(F.regexp_extract(cut, r"(?s)^(.*)\n", 1), F.lit("")), cut)).otherwise(F.col("text"))
    group = rf"(?i)^(?:function|design)[{WS}]*group[{WS}]*"
    return docs.select(
        "doc",
        "li",
        detect_version(F.col("flat"), F.col("li")).alias("ver"),
        title(F.col("p1"), F.col("li"), F.col("text")).alias("title"),
        long_field(F.col("p1"), rf"(?i)^reason[{WS}]*for[{WS}]*change[{WS}]*").alias("reason"),
        field(F.col("p1"), group).alias("fgroup"),
        norm_date(field(F.col("p1"), rf"(?i)^date[{WS}]*", DATE)).alias("date"),
        long_field(F.col("p1"), rf"(?i)^validity[{WS}]*").alias("validity"),
        whole.alias("text"),
        F.size(F.array_distinct(F.transform("lines", lambda x: x["page"]))).alias("pages"),
    )


def dispatch_lines(text: Column) -> Column:
    """Descriptions of a dispatch screen: numbered rows with a letter, a skill and a status before, numbers behind."""
    rows = F.filter(F.transform(F.split(s(text), r"\r?\n"), squash), lambda t: t.rlike(r"^\d{1,2}\)\s*[A-H]\s+\S+\s+\S+\s+.+"))
    bare = F.transform(rows, lambda t: sub(sub(sub(sub(t, r"^\d{1,2}\)\s*[A-H]\s+\S+\s+\S+\s+"), r"\s+\d{3,5}\s+-?\d+\.\d.*\z"), r"\s+-?\d+\.\d.*\z"), r"\s+\d{3,5}\z"))
    return F.filter(F.transform(bare, squash), lambda t: F.length(t) >= 3)


def phone(text: Column) -> Column:
    return F.concat_ws("-", *[F.nullif(F.regexp_extract(s(text), r"(?<![0-9])(\d{3})[-.](\d{3})[-.](\d{4})(?![0-9])", k), F.lit("")) for k in (1, 2, 3)])


def best_orientation(scores: DataFrame) -> DataFrame:
    """(page, angle) from words (page, angle, text, conf): the angle with the most sure words; 0 unless it has ten at 60."""
    sure = (F.col("conf") >= 60) & (F.length(sub(F.col("text"), "[^A-Za-z0-9]")) >= 3)
    by = scores.groupBy("page", "angle").agg(F.count_if(sure).alias("n"), F.coalesce(F.avg(F.when(sure, F.col("conf"))), F.lit(0.0)).alias("mean"))
    w = Window.partitionBy("page").orderBy(F.col("n").desc(), F.col("mean").desc(), "angle")
    top = by.withColumn("k", F.row_number().over(w)).where("k = 1")
    return top.select("page", F.when((F.col("n") >= 10) & (F.col("mean") >= 60), F.col("angle")).otherwise(0).alias("angle"))


WORDS = "array<struct<text: string, x0: double, x1: double, conf: double>>"


def word_rows(items: DataFrame) -> DataFrame:
    """(doc, page, text, x0, x1, y0, y1, words) of items (doc, page, str, x, y, w, h) whose y counts from the foot of the page.

    Items within three units of height are a row, read from left to right with a space between any two. y0 counts down the
    page. Each word keeps its place.
    """
    # Dealt by page once: rows of a page, and whatever is made of a page's rows, need no further shuffle.
    rows = items.where(F.col("str").rlike(f"[^{WS}]")).repartition("doc", "page").select("doc", "page", squash(F.col("str")).alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce(F.abs("h"), F.lit(10.0)).cast("double").alias("h"), F.coalesce("w", F.lit(0.0)).cast("double").alias("w"))
    word = F.struct("x", F.col("t").alias("text"), (F.col("x") + F.col("w")).alias("x1"))
    grouped = rows.groupBy("doc", "page", F.floor(F.col("y") / 3 + 0.5).alias("band")).agg(F.array_sort(F.collect_list(word)).alias("p"), F.max("h").alias("h"), F.max("y").alias("y"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"))
    words = F.transform("p", lambda p: F.struct(p["text"].alias("text"), p["x"].alias("x0"), p["x1"].alias("x1"), F.lit(100.0).alias("conf")))
    return grouped.select("doc", "page", F.array_join("p.text", " ").alias("text"), "x0", "x1", (-F.col("y")).alias("y0"), (-F.col("y") + F.col("h")).alias("y1"), words.cast(WORDS).alias("words"))


def recognized_rows(pages: DataFrame) -> DataFrame:
    """The same of pages (doc, page, data), data being the JSON of a recognised page: lines with boxes and words. A word
    without a confidence has 100; a page that is no such JSON has no rows."""
    box = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
    shape = f"lines ARRAY<STRUCT<text: STRING, bbox: {box}, words: ARRAY<STRUCT<text: STRING, confidence: DOUBLE, bbox: {box}>>>>"
    rows = pages.select("doc", "page", F.posexplode(F.from_json("data", shape)["lines"]).alias("at", "l"))
    side = lambda b, c: F.coalesce(b[c], F.lit(0.0))
    words = F.transform(F.coalesce(F.col("l.words"), F.array()), lambda w: F.struct(squash(w["text"]).alias("text"), side(w["bbox"], "x0").alias("x0"), side(w["bbox"], "x1").alias("x1"), F.coalesce(w["confidence"], F.lit(100.0)).alias("conf")))
    sides = [side(F.col("l.bbox"), c).alias(c) for c in ("x0", "x1", "y0", "y1")]
    return rows.select("doc", "page", squash(F.col("l.text")).alias("text"), *sides, F.filter(words, lambda w: w["text"] != "").cast(WORDS).alias("words")).where("text <> ''")


def table_lines(rows: DataFrame, heading: str, first: str, footer: str | None = None) -> DataFrame:
    """(doc, page, pos, text, left) of a form's line table, from rows as `word_rows` gives them.

    heading: what the text of the table's heading row has; first: the word of it that stands over the text column. That
    column begins where the heading before that word ends, for the word itself stands centred over it; without one, and in
    rows without words, a row counts as a whole. Rows below the heading are cut there; left has the words of the cells
    before, as far as the headings to the left stand close together. Pieces that share half of their height are one row,
    from left to right. A gap of over three quarters of the page's middle row height begins a new line of the table, as
    does a row that has `footer`, which is left out. Words parted by a hyphen at the end of a row are joined.
    """
    head = F.min(F.when(F.col("text").rlike(heading), F.struct("y0", "x0", "y1", "words"))).alias("head")
    pages = rows.groupBy("doc", "page").agg(head, F.max("x1").alias("right"), F.collect_list(F.struct("text", "x0", "y0", "y1", "words")).alias("rows")).where("head is not null")
    at = F.array_position(F.transform("head.words", lambda w: w["text"].rlike(first)), True)
    before = F.filter(F.when(at > 0, F.slice("head.words", F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))), lambda w: w["text"].rlike("[A-Za-z]"))
    pad, gap = F.greatest(F.lit(12.0), F.col("right") * 0.02), F.greatest(F.lit(40.0), F.col("right") * 0.06)
    pages = pages.withColumn("before", F.when(F.size(before) > 0, before)).withColumn("pad", pad).withColumn("gap", gap)
    reach = F.aggregate(F.reverse("before"), F.struct(F.lit(None).cast("double").alias("x0"), F.lit(True).alias("on")), lambda acc, w: F.when(acc["x0"].isNull() | (acc["on"] & (acc["x0"] - w["x1"] <= F.col("gap"))), F.struct(w["x0"].alias("x0"), F.lit(True).alias("on"))).otherwise(F.struct(acc["x0"].alias("x0"), F.lit(False).alias("on"))))
    foot = F.col("head.y0") + F.greatest(F.lit(1.0), F.col("head.y1") - F.col("head.y0")) * 0.6
    # Worked out once for each page: in one plan with the rows they would be worked out anew for each word.
    pages = pages.select("doc", "page", "rows", foot.alias("foot"), (F.array_max("before.x1") + 4).alias("from"), (reach["x0"] - F.col("pad")).alias("cells"))
    below = pages.select("doc", "page", "foot", "from", "cells", F.inline("rows")).where("y0 > foot")
    inside = F.array_join(F.transform(F.filter("words", lambda w: w["x0"] >= F.col("from")), lambda w: w["text"]), " ")
    said = F.when(F.col("from").isNull(), F.col("text")).when(F.size("words") > 0, inside).when(F.col("x0") >= F.col("from"), F.col("text")).otherwise(F.lit(""))
    left = F.when(F.col("from").isNotNull(), F.filter("words", lambda w: (w["x0"] < F.col("from")) & (w["x0"] >= F.col("cells")))).otherwise(F.array().cast(WORDS))
    body = below.select("doc", "page", F.struct("y0", "x0", "y1", F.array(squash(said)).alias("texts"), F.coalesce(left, F.array().cast(WORDS)).alias("left")).alias("r")).where("char_length(r.texts[0]) >= 3")
    body = body.groupBy("doc", "page").agg(F.array_sort(F.collect_list("r")).alias("r"))

    shape = f"struct<y0: double, x0: double, y1: double, texts: array<string>, left: {WORDS}>"
    last = lambda a: F.element_at(a, -1)
    instead = lambda a, x: F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(x))

    def merged(acc, r):
        p = F.when(F.size(acc) > 0, last(acc))
        share = (F.least(p["y1"], r["y1"]) - F.greatest(p["y0"], r["y0"])) / F.greatest(F.lit(1.0), F.least(p["y1"] - p["y0"], r["y1"] - r["y0"]))
        texts = F.when(r["x0"] < p["x0"], F.concat(r["texts"], p["texts"])).otherwise(F.concat(p["texts"], r["texts"]))
        both = F.struct(F.least(p["y0"], r["y0"]).alias("y0"), F.least(p["x0"], r["x0"]).alias("x0"), F.greatest(p["y1"], r["y1"]).alias("y1"), texts.alias("texts"), F.concat(p["left"], r["left"]).alias("left"))
        return F.when(p.isNotNull() & (share >= 0.5), instead(acc, both.cast(shape))).otherwise(F.concat(acc, F.array(r.cast(shape))))

    body = body.withColumn("r", F.aggregate(F.col("r").cast(f"array<{shape}>"), F.array().cast(f"array<{shape}>"), merged))
    heights = F.array_sort(F.transform("r", lambda x: F.greatest(F.lit(1.0), x["y1"] - x["y0"])))
    body = body.withColumn("h", F.get(heights, F.floor(F.size("r") / 2).cast("int")))
    state = f"struct<lines: array<{shape}>, open: boolean, h: double>"

    def parted(acc, r):
        p = F.when(F.size(acc["lines"]) > 0, last(acc["lines"]))
        ends = F.array_join(r["texts"], " ").rlike(footer) if footer else F.lit(False)
        more = F.struct(p["y0"].alias("y0"), p["x0"].alias("x0"), F.greatest(p["y1"], r["y1"]).alias("y1"), F.concat(p["texts"], r["texts"]).alias("texts"), p["left"].alias("left"))
        new = ~acc["open"] | p.isNull() | (r["y0"] - p["y1"] > acc["h"] * 0.75)
        told = lambda lines, open_: F.struct(lines.alias("lines"), F.lit(open_).alias("open"), acc["h"].alias("h")).cast(state)
        return F.when(ends, told(acc["lines"], False)).when(new, told(F.concat(acc["lines"], F.array(r)), True)).otherwise(told(instead(acc["lines"], more.cast(shape)), True))

    found = F.aggregate("r", F.struct(F.array().cast(f"array<{shape}>").alias("lines"), F.lit(False).alias("open"), F.col("h").alias("h")).cast(state), parted)["lines"]
    lines = body.select("doc", "page", F.posexplode(found).alias("pos", "l"))
    return lines.select("doc", "page", "pos", join_hyphen(F.col("l.texts")).alias("text"), F.transform("l.left", lambda w: w["text"]).alias("left"))
