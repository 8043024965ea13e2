"""Reads of one store: by key, by an index, and the filters of the views. Plain predicates, so that scans prune and push down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import ids
from dossier.functions.text import s
from dossier.operators import facets
from dossier.operators.relations import by_trash


def point(df: DataFrame, value: str, key: str = "id") -> DataFrame:
    """The row of one key, or none."""
    return df.where(F.col(key) == value)


def keys(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(key).orderBy(key)


def list_by(df: DataFrame, index: str, value=None, key: str = "id") -> DataFrame:
    """Rows with this value in the index, or with any value if none is given, in order of (value, key)."""
    hit = F.col(index).isNotNull() if value is None else F.col(index) == F.lit(value)
    return df.where(hit).orderBy(index, key)


def count_by(df: DataFrame, index: str, value=None) -> DataFrame:
    hit = F.lit(True) if value is None else F.col(index) == F.lit(value)
    return df.where(hit).agg(F.count("*").alias("n"))


def member(df: DataFrame, index: str, value: str) -> DataFrame:
    """Rows whose list holds the value, which is compared in upper case."""
    return df.where(F.array_contains(index, value.upper()))


def each(df: DataFrame, function) -> None:
    """Calls function(rows) for each partition, where the rows are."""
    df.foreachPartition(function)


def _holds(text: Column, query: str) -> Column:
    return F.contains(F.lower(text), F.lit(query.lower()))


def _listed(c: str) -> Column:
    return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")


def files_view(df: DataFrame, trash: str = "omit", starred: bool = False, kind: str | None = None, collection: str | None = None, tag: str | None = None, vin: str | None = None, any_vin: bool = False, query: str = "", only: DataFrame | None = None, recent: int | None = None) -> DataFrame:
    """Rows of the file view; a null collection is the empty one. The query is looked for in names, notes, tags and numbers.

    only: rows (id), such as the attachments of an order, outside of which nothing is shown; recent: so many of the rows
    that are left, the newest.
    """
    rows = by_trash(df, trash)
    tests = [F.col("starred")] if starred else []
    tests += [F.col("kind") == kind] if kind is not None else []
    tests += [s("collection") == collection] if collection is not None else []
    tests += [F.array_contains("tags", tag)] if tag is not None else []
    tests += [F.array_contains("vins", vin)] if vin is not None else []
    tests += [F.size("vins") > 0] if any_vin else []
    tests += [_holds(F.concat_ws(" ", s("name"), s("collection"), s("note"), _listed("tags"), _listed("vins"), _listed("fins")), query)] if query else []
    rows = reduce(DataFrame.where, tests, rows if only is None else rows.join(only.select("id").distinct(), "id", "left_semi"))
    return rows if recent is None else facets.recent(rows, recent)


def documents_view(documents: DataFrame, starred: bool = False, review: bool = False, fgroup: str | None = None, model: str | None = None, query: str = "") -> DataFrame:
    """Version groups (facets.version_groups) of which any version fits each of what is asked; review looks at the newest alone.

    Versions are judged as rows, so no group holds its texts.
    """
    groups = facets.version_groups(documents)
    groups = groups.where("starred") if starred else groups
    groups = groups.where("needsReview") if review else groups
    said = F.concat_ws(" ", *[s(c) for c in ("li", "title", "fgroup", "reason", "text")])
    tests = [F.col("fgroup") == fgroup] if fgroup is not None else []
    tests += [F.array_contains(ids.models_of_validity(F.col("validity")), model)] if model is not None else []
    tests += [_holds(said, query)] if query else []
    for test in tests:
        groups = groups.join(documents.where(test).select(facets.version_key().alias("key")).distinct(), "key", "left_semi")
    return groups


def tools_view(df: DataFrame, starred: bool = False, offered: bool = False, exact: dict[str, str] | None = None, model: str | None = None, group: str | None = None, query: str = "") -> DataFrame:
    """Rows of the catalogue view. exact: column and value; group: a member of svcGrp; model: a series in the validities."""
    tests = [F.col("star")] if starred else []
    tests += [F.col("offered")] if offered else []
    tests += [s(c) == v for c, v in (exact or {}).items()]
    tests += [ids.fits_model(F.col("validities"), F.lit(model))] if model is not None else []
    tests += [F.array_contains(ids.group_members(F.col("svcGrp")), group)] if group is not None else []
    tests += [_holds(F.concat_ws(" ", *[s(c) for c in ("no", "toolNo", "svcGrp", "ct", "desc", "location", "note", "comment")]), query)] if query else []
    return reduce(DataFrame.where, tests, df)


def settings_of(df: DataFrame, prefix: str) -> DataFrame:
    return df.where(F.startswith("key", F.lit(prefix))).orderBy("key")


def to_scan(files: DataFrame, force: bool = False) -> DataFrame:
    """Files that a search for vehicle numbers has to read: no videos, and those never read unless forced."""
    rows = files.where(F.coalesce(F.col("kind") != "video", F.lit(True)))
    return rows if force else rows.where(F.coalesce("vinScan", F.lit(0)) == 0)


def not_queued(candidates: DataFrame, jobs: DataFrame, type_: str) -> DataFrame:
    """Candidates (id) that no waiting or running job of the type names."""
    busy = jobs.where((F.col("type") == type_) & F.col("state").isin("queued", "running")).select(F.explode("inputIds").alias("id"))
    return candidates.join(busy, "id", "left_anti")


def inventory_totals(tools: DataFrame) -> DataFrame:
    held = lambda c: F.count_if(c)
    return tools.agg(F.count("*").alias("n"), held(F.col("offered")).alias("offered"), held(s("photo") != "").alias("with_photo"))


def documents_totals(documents: DataFrame) -> DataFrame:
    key = F.when(s("li") == "", F.concat(F.lit("id:"), F.col("id"))).otherwise(ids.document_key(F.col("li")))
    return documents.agg(F.countDistinct(key).alias("groups"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def extract_totals(entries: DataFrame) -> DataFrame:
    """Of (path, content): entries, their bytes, and how many are empty."""
    n = F.coalesce(F.octet_length("content"), F.lit(0))
    return entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(n), F.lit(0)).alias("bytes"), F.count_if(n == 0).alias("empty"))


def same_bytes(a: Column, b: Column) -> Column:
    """Whether two values are equal: length first, so most unequal ones are not compared."""
    return (F.octet_length(a) == F.octet_length(b)) & (a == b)
