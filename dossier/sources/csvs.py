"""CSV and JSON in and out: delimiter by the first line, ragged rows padded, quotes only where needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELIMITERS = (",", "\t", ";", "|")


def delimiter(first_line: Column) -> Column:
    """The delimiter that makes the most fields; ties go to the earlier of comma, tab, semicolon, bar. Quoted ones don't count."""
    bare = F.regexp_replace(first_line, r'"(?:[^"]|"")*"', "q")
    fields = [F.size(F.split(bare, f"[{d}]")) for d in DELIMITERS]
    most = F.greatest(*fields)
    out = F.when(fields[0] == most, DELIMITERS[0])
    for d, n in zip(DELIMITERS[1:], fields[1:]):
        out = out.when(n == most, d)
    return out


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter of the first line that is not blank; a few rows are looked at, not the file."""
    line = spark.read.text(path).where("trim(value) <> ''").limit(1).select(delimiter(F.col("value")).alias("d")).first()
    return line.d if line else ","


def cells(record: Column, sep: str) -> Column:
    """The fields of a record as an array. A quote anywhere opens or closes a quoted run, in which separators, line ends and
    doubled quotes stand for themselves; carriage returns outside are dropped."""
    mark = "\\" + sep if sep in "|" else sep
    field = rf'{mark}((?:[^{mark}"]++|"[^"]*+(?:""[^"]*+)*+(?:"|\z))*+)'
    run = r'"([^"]*+(?:""[^"]*+)*+)(?:"|\z)'
    found = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(field), F.lit(1))
    return F.transform(found, lambda c: F.replace(F.regexp_replace(c, rf"{run}|\r", "$1"), F.lit('""'), F.lit('"')))


def records(spark: SparkSession, path: str, sep: str = ",", any_line_end: bool = False) -> DataFrame:
    """(path, pos, cells) of each record, pos from 0 in each file; a file of any size is cut by many tasks.

    Spark reads lines by byte ranges. Whether a line begins within quotes follows from the quotes before it: their parity in
    each range, summed over the ranges before. Only lines of records that run over several lines are gathered. A last
    record of one empty field is none. any_line_end: CR and CR LF are line ends too, also within quotes (where they
    become LF); else CR is dropped outside quotes. A quote that is never closed runs to the file's end, but for a last line end.
    """
    reader = spark.read if any_line_end else spark.read.option("lineSep", "\n")
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = lines.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))
    order = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("before", F.sum("quotes").over(order) - F.col("quotes"))
    even = F.col("before") % 2 == 0
    blocks = lines.groupBy("path", "block").agg(F.sum("quotes").alias("quotes"), F.count_if(even).alias("even"), F.count_if(~even).alias("odd"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("parity", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    blocks = blocks.withColumn("begun", F.when(F.col("parity") == 0, F.col("even")).otherwise(F.col("odd")))
    blocks = blocks.select("path", "block", "parity", F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("first"), F.sum("begun").over(Window.partitionBy("path")).alias("all"))
    # A line within quotes belongs to the record begun last, which may be in a range before.
    lines = lines.join(blocks, ["path", "block"]).withColumn("inside", (F.col("before") + F.col("parity")) % 2)
    lines = lines.withColumn("pos", F.col("first") + F.sum(1 - F.col("inside")).over(order) - 1)
    alone = (F.col("inside") == 0) & (F.col("quotes") % 2 == 0)
    whole = lines.where(alone).select("path", "pos", "all", F.col("line").alias("record"))
    parts = lines.where(~alone).groupBy("path", "pos").agg(F.first("all").alias("all"), F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("x"))
    found = whole.union(parts.select("path", "pos", "all", F.array_join("x.line", "\n")))
    found = found.select("path", "pos", "all", cells(F.col("record"), sep).alias("cells"))
    return found.where((F.col("pos") < F.col("all") - 1) | (F.size("cells") > 1) | (F.col("cells")[0] != "")).select("path", "pos", "cells")


def read(spark: SparkSession, path: str, header: bool = True, sep: str | None = None) -> DataFrame:
    """All columns as text, rows padded with empty values to the widest; blank headings become "Column n".

    The first record of each file is its heading, by place: a later record that reads alike is data. The first file's
    heading counts. A first row need not be the widest, so fields are counted first.
    """
    sep = sep or sniff(spark, path)
    rows = records(spark, path, sep)
    widest = rows.agg(F.max(F.size("cells"))).first()[0] or 1
    names = [f"Column {k + 1}" for k in range(widest)]
    if header:
        first = rows.where("pos = 0").orderBy("path").limit(1).first()
        names = [(first.cells[k] if first and k < len(first.cells) else "") or n for k, n in enumerate(names)]
        rows = rows.where("pos > 0")
    seen: dict[str, int] = {}
    for k, n in enumerate(names):
        seen[n] = seen.get(n, 0) + 1
        names[k] = n if seen[n] == 1 else f"{n} ({seen[n]})"
    return rows.select(*[F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)])


#: Headings of the tool table by column (fixed values).
HEADINGS = {
    "id": ("id",),
    "no": ("no.", "no"),
    "qty": ("qty",),
    "toolNo": ("tool number",),
    "svcGrp": ("svc grp", "service group"),
    "ct": ("ct",),
    "desc": ("description",),
    "location": ("location", "bin"),
    "year": ("year",),
    "price": ("dlr net($)", "dlr net", "price"),
    "note": ("note",),
    "comment": ("comment",),
}


def tool_rows(rows: DataFrame) -> DataFrame:
    """(pos and the columns of HEADINGS) from rows (pos, cells): the heading is the first of the first five rows that names
    the tool number, else the first; of a column's headings the first that is there counts. No tool number: no rows."""
    head = rows.where("pos < 5").select("pos", "cells", (~F.contains(F.lower(F.array_join("cells", " ")), F.lit("tool number"))).alias("other"))
    head = head.orderBy("other", "pos").limit(1).select(F.col("pos").alias("at"), F.transform("cells", lambda c: F.lower(F.trim(c))).alias("head"))
    found = rows.crossJoin(F.broadcast(head)).where("pos > at and array_contains(head, 'tool number')")
    place = lambda names: F.coalesce(*[F.nullif(F.array_position("head", name), F.lit(0)) for name in names]).cast("int")
    return found.select("pos", *[F.coalesce(F.get("cells", place(names) - 1), F.lit("")).alias(c) for c, names in HEADINGS.items()])


def without_blank_rows(df: DataFrame) -> DataFrame:
    filled = F.lit(False)
    for c in df.columns:
        filled = filled | (F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) != "")
    return df.where(filled)


def any_column_has(df: DataFrame, query: str) -> DataFrame:
    low = query.lower()
    return df.where(F.exists(F.array(*[F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns]), lambda v: F.contains(v, F.lit(low))))


def line(*columns: Column, sep: str = ",") -> Column:
    """One CSV line: a value is quoted if it holds the separator, a quote or a line end."""
    cell = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    quoted = lambda c: F.when(cell(c).rlike(f'[{sep}"\\r\\n]'), F.concat(F.lit('"'), F.replace(cell(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell(c))
    return F.concat_ws(sep, *map(quoted, columns))


def write(df: DataFrame, path: str, sep: str = ",") -> None:
    flat = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    flat.write.option("header", "true").option("sep", sep).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
