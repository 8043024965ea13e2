"""Token search over typed stores, federated. Queries are folded once in Python; rows only meet built-in expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.ids import document_key, is_number, version_number
from dossier.functions.text import compact, s
from dossier.functions.vin import is_shape


def tokens(query: str) -> list[str]:
    """Words of a query: lower case, compatibility forms, hyphens and spaces folded. The rows searched are not folded."""
    folded = unicodedata.normalize("NFKC", (query or "").lower())
    return "".join("-" if "‐" <= c <= "―" else c for c in folded.replace(" ", " ")).split()


def has_all(text: Column, words: list[str]) -> Column:
    low = F.lower(s(text))
    return reduce(lambda a, b: a & b, (F.contains(low, F.lit(w)) for w in words), F.lit(True))


def by_number(number: Column, query: str) -> Column:
    """Whether the number holds the query's letters and digits, from four of them on."""
    bare = "".join(c for c in query.lower() if c.isascii() and c.isalnum())
    return F.contains(compact(number), F.lit(bare)) if len(bare) >= 4 else F.lit(False)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k by a total order."""
    return df.orderBy(*order).limit(k)


def files(df: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Live, visible files that hold every word, newest first."""
    return top(df.where((F.col("inFiles") == 1) & F.col("deletedAt").isNull() & has_all(F.col("searchText"), tokens(query))), k, F.col("updatedAt").desc(), F.col("id"))


def documents(df: DataFrame, query: str, k: int = 5) -> DataFrame:
    """The newest fitting version of each document, in order of first appearance."""
    text = F.concat_ws(" ", *[s(c) for c in ("li", "title", "reason", "fgroup")])
    fits = df.where(has_all(text, tokens(query)) | by_number(F.col("li"), query))
    return top(newest(fits).withColumnRenamed("first_id", "__first"), k, F.col("__first")).drop("__first")


def newest(df: DataFrame) -> DataFrame:
    """One row for each document number: the highest version, the lowest id among equals; rows without one stand alone."""
    key = F.when(s("li") == "", F.concat(F.lit("id:"), F.col("id"))).otherwise(document_key(F.col("li")))
    by = Window.partitionBy("__key")
    ranked = df.withColumn("__key", key).withColumn("__rank", F.row_number().over(by.orderBy(version_number(F.col("ver")).desc(), "id"))).withColumn("first_id", F.min("id").over(by))
    return ranked.where("__rank = 1").drop("__key", "__rank")


def tools(df: DataFrame, query: str, k: int = 5) -> DataFrame:
    text = F.concat_ws(" ", *[s(c) for c in ("no", "toolNo", "svcGrp", "ct", "desc", "note", "comment")])
    return top(df.where(has_all(text, tokens(query)) | by_number(F.col("toolNo"), query)), k, F.col("id"))


def orders(df: DataFrame, query: str, k: int = 5) -> DataFrame:
    lines = F.transform("lines", lambda x: F.concat_ws(" ", x["op"], x["text"]))
    text = F.concat_ws(" ", *[s(c) for c in ("ro", "tag", "vehicle", "vin", "customer", "advisor", "phone", "email")], F.array_join(lines, " "), s("scanText"))
    return top(df.where(F.col("deletedAt").isNull() & has_all(text, tokens(query))), k, F.col("updatedAt").desc(), F.col("id"))


def vehicles(df: DataFrame, query: str, k: int = 3) -> DataFrame:
    return top(df.where(by_number(F.col("vin"), query) | by_number(F.col("fin"), query)), k, F.col("vin"))


def federated(found: dict[str, DataFrame], title: dict[str, Column]) -> DataFrame:
    """store, id, title of each store's hits; stores without hits don't appear."""
    parts = [df.select(F.lit(store).alias("store"), F.col("id").cast("string").alias("id"), title[store].alias("title")) for store, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


def route(query: Column) -> Column:
    """What a query is by its shape: tool number before vehicle number before document number; else text."""
    from dossier.functions.ids import canon_tool

    return F.when(canon_tool(query) != "", "tool").when(is_shape(F.trim(query)), "vehicle").when(is_number(query), "document").otherwise("text")


def classify_kind(mime: Column, name: Column) -> Column:
    """The kind of a file, by ordered rules over its type and its extension."""
    # Extensions of each kind.
    kinds = {
        "archive": "zip rar 7z gz tar bz2 xz",
        "document": "doc docx odt rtf pages",
        "spreadsheet": "xls xlsx ods csv numbers",
        "presentation": "ppt pptx odp key",
        "text": "txt md markdown json xml yml yaml js ts jsx tsx py rb go rs c cpp h java cs php sh css html htm sql log ini conf toml env",
    }
    parts_of_type = {"archive": ("zip", "compressed"), "document": ("word", "opendocument.text"), "spreadsheet": ("sheet", "excel"), "presentation": ("presentation", "powerpoint")}
    t, low = F.lower(s(mime)), F.lower(s(name))
    ext = F.when(F.contains(low, F.lit(".")), F.element_at(F.split(low, r"\."), -1)).otherwise(F.lit(""))
    out = F.when(t.startswith("image/"), "image").when(t.startswith("video/"), "video").when(t.startswith("audio/"), "audio").when((t == "application/pdf") | (ext == "pdf"), "pdf")
    for kind, exts in kinds.items():
        of_type = reduce(lambda a, b: a | b, (F.contains(t, F.lit(p)) for p in parts_of_type.get(kind, ())), t.startswith("text/") if kind == "text" else F.lit(False))
        out = out.when(ext.isin(exts.split()) | of_type, kind)
    return out.otherwise("other")
