"""Trash, purge, shared bytes and the decisions of an intake, as plans over one snapshot of the stores.

Each function returns the rows to write or the decisions; dossier.sources.store writes them as one new generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.ids import canon_order
from dossier.functions.text import s, squash
from dossier.functions.vin import check_ok, is_shape, series
from dossier.operators.facets import ranked
from dossier.operators.relations import blob_key, live
from dossier.operators.search import classify_kind


def search_text() -> Column:
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    return F.lower(F.array_join(F.array(s("name"), s("collection"), s("note"), joined(F.col("tags")), joined(F.col("vins")), joined(F.col("fins"))), " "))


def prepare_files(df: DataFrame, as_of: int) -> DataFrame:
    """Defaults and derived columns of a file record."""
    empty = F.array().cast("array<string>")
    out = df.withColumns(
        {
            "name": F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("Untitled")),
            "type": F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("application/octet-stream")),
            "size": F.coalesce("size", F.lit(0)),
            "tags": F.coalesce("tags", empty),
            "vins": F.coalesce("vins", empty),
            "fins": F.coalesce("fins", empty),
            "collection": s("collection"),
            "note": s("note"),
            "starred": F.coalesce("starred", F.lit(False)),
            "vinScan": F.coalesce("vinScan", F.lit(0)),
            "inFiles": F.when(F.col("inFiles") == 0, 0).otherwise(1),
            "deletedAt": F.nullif(F.col("deletedAt"), F.lit(0)),
            "blobId": F.when(F.col("blobId") != F.col("id"), F.col("blobId")),
            "createdAt": F.coalesce("createdAt", F.lit(as_of)),
            "updatedAt": F.coalesce("updatedAt", F.lit(as_of)),
        }
    )
    out = out.withColumn("kind", F.coalesce(F.nullif(F.col("kind"), F.lit("")), classify_kind(F.col("type"), F.col("name"))))
    return out.withColumn("trashedWith", F.when(F.col("deletedAt").isNotNull(), F.nullif(F.col("trashedWith"), F.lit("")))).withColumn("searchText", search_text())


def prepare_orders(df: DataFrame) -> DataFrame:
    return df.withColumn("roKey", F.nullif(canon_order(F.col("ro")), F.lit("")))


def prepare_tools(df: DataFrame) -> DataFrame:
    """Defaults of a tool record; texts that are compared are trimmed, an unreadable price is none."""
    empty = F.array().cast("array<string>")
    trimmed = {c: F.trim(s(c)) for c in ("toolNo", "svcGrp", "note", "note2")}
    plain = {c: s(c) for c in ("no", "qty", "desc", "location", "year", "comment", "photo", "wis", "version", "catalogName", "catalogDesc")}
    rest = {"ct": F.upper(F.trim(s("ct"))), "price": F.col("price").cast("string").try_cast("double"), "validities": F.coalesce("validities", empty), "edited": F.coalesce("edited", F.create_map().cast("map<string,int>"))}
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("star", "offered")}
    return df.withColumns({c: v for c, v in {**trimmed, **plain, **rest, **flags}.items() if c in df.columns})


def is_plain(c: Column, deepest: int = 32) -> Column:
    """Whether a setting is JSON that a backup can hold: it parses, and is nested at most so deep."""
    marks = F.filter(F.split(F.regexp_replace(s(c), r'"(?:[^"\\]|\\.)*"|[^\[\]{}"]', ""), ""), lambda x: x != "")
    step = lambda acc, x: F.when(x.isin("{", "["), F.struct((acc["now"] + 1).alias("now"), F.greatest(acc["top"], acc["now"] + 1).alias("top"))).otherwise(F.struct((acc["now"] - 1).alias("now"), acc["top"].alias("top")))
    depth = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step)["top"]
    return F.coalesce(F.try_parse_json(c).isNotNull() & (depth <= deepest), F.lit(False))


def backup_settings(settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settings that go into a backup, keys of those that cannot)."""
    return settings.where(is_plain(F.col("value"))), settings.where(~is_plain(F.col("value"))).select("key")


def vehicle_status() -> Column:
    return F.when(F.col("confirmedAt").isNotNull(), "confirmed").when(check_ok(F.col("vin")), "check-digit-ok").otherwise("extracted")


def note_vehicles(stored: DataFrame, seen: DataFrame, as_of: int) -> DataFrame:
    """Upsert of sightings (vin, fin, model, source): what is known stays, gaps are filled, sources add up. Bad shapes drop out."""
    new = seen.withColumn("vin", F.upper(F.trim("vin"))).where(is_shape(F.col("vin"))).groupBy("vin").agg(F.min("fin").alias("nfin"), F.min("model").alias("nmodel"), F.sort_array(F.collect_set("source")).alias("nsources"))
    both = stored.join(new, "vin", "full_outer")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    empty = F.array().cast("array<string>")
    out = both.withColumns(
        {
            "fin": F.coalesce(blank("fin"), "nfin"),
            "model": F.coalesce(blank("model"), "nmodel"),
            "series": F.coalesce(blank("series"), series(F.col("vin"))),
            "sources": F.array_union(F.coalesce("sources", empty), F.coalesce("nsources", empty)),
            "createdAt": F.coalesce("createdAt", F.lit(as_of)),
            "updatedAt": F.when(F.col("nsources").isNotNull(), F.lit(as_of)).otherwise(F.col("updatedAt")),
            "checkDigit": check_ok(F.col("vin")),
        }
    )
    return out.withColumn("status", vehicle_status()).drop("nfin", "nmodel", "nsources")


def written(stored: DataFrame, writes: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to write, conflicts). A write with expectedRev (may be null) conflicts unless that is the stored row's rev, 0 if
    there is none. Rows to write get the old rev plus one; conflicts are (key, expectedRev, currentRev)."""
    have = stored.select(F.col(key).alias("__k"), F.coalesce("rev", F.lit(0)).alias("__rev"))
    w = writes.join(have, F.col(key) == F.col("__k"), "left").withColumn("__rev", F.coalesce("__rev", F.lit(0)))
    bad = F.col("expectedRev").isNotNull() & (F.col("expectedRev") != F.col("__rev"))
    good = w.where(~bad).withColumn("rev", F.col("__rev") + 1).drop("__k", "__rev", "expectedRev")
    return good, w.where(bad).select(F.col(key), "expectedRev", F.col("__rev").alias("currentRev"))


def put(stored: DataFrame, writes: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(store after the writes, conflicts), by the rule of `written`; conflicting writes leave the store as it was."""
    good, bad = written(stored, writes, key)
    rest = stored.join(good.select(key), key, "left_anti")
    return rest.unionByName(good, allowMissingColumns=True), bad


def remove(stored: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(gone.select(key), key, "left_anti")


def trash(files: DataFrame, chosen: DataFrame, as_of: int) -> DataFrame:
    """All rows; the chosen live ones are in the trash, on their own."""
    hit = F.col("__c").isNotNull() & F.col("deletedAt").isNull()
    rows = files.join(chosen.select("id", F.lit(1).alias("__c")), "id", "left")
    return rows.withColumns({"deletedAt": F.when(hit, F.lit(as_of)).otherwise(F.col("deletedAt")), "trashedWith": F.when(~hit, F.col("trashedWith")), "rev": F.coalesce("rev", F.lit(0)) + hit.cast("int")}).drop("__c")


def restore(files: DataFrame, chosen: DataFrame) -> DataFrame:
    hit = F.col("__c").isNotNull() & F.col("deletedAt").isNotNull()
    rows = files.join(chosen.select("id", F.lit(1).alias("__c")), "id", "left")
    return rows.withColumns({"deletedAt": F.when(~hit, F.col("deletedAt")), "trashedWith": F.when(~hit, F.col("trashedWith")), "rev": F.coalesce("rev", F.lit(0)) + hit.cast("int")}).drop("__c")


def blockers(files: DataFrame, links: DataFrame) -> DataFrame:
    """(id, type, refId, kind) of what still names a file: links either way, and the document that owns it."""
    to = links.where("toType = 'file'").select(F.col("toId").alias("id"), F.col("fromType").alias("type"), F.col("fromId").alias("refId"), "kind")
    out = links.where("fromType = 'file'").select(F.col("fromId").alias("id"), F.col("toType").alias("type"), F.col("toId").alias("refId"), "kind")
    owned = files.where("docId is not null").select("id", F.lit("document").alias("type"), F.col("docId").alias("refId"), F.lit(None).cast("string").alias("kind"))
    return to.union(out).union(owned)


def purge_plan(files: DataFrame, links: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, purged, refs) for each chosen file: only what nothing names may go."""
    refs = blockers(files, links).groupBy("id").agg(F.count("*").alias("refs"))
    return chosen.select("id").distinct().join(refs, "id", "left").select("id", F.col("refs").isNull().alias("purged"), F.coalesce("refs", F.lit(0)).alias("refs"))


def unused_blobs(files: DataFrame, blobs: DataFrame, gone: DataFrame) -> DataFrame:
    """Blob rows of the gone files that no remaining record holds or shares."""
    of_gone = files.join(gone.select("id"), "id", "left_semi").select(blob_key().alias("k")).distinct()
    left = files.join(gone.select("id"), "id", "left_anti")
    used = left.select(blob_key().alias("k")).union(left.select(F.col("id").alias("k")))
    return blobs.join(of_gone, F.col("id") == F.col("k"), "left_semi").join(used, F.col("id") == F.col("k"), "left_anti")


def cascade_links(links: DataFrame, gone: DataFrame, type_: str) -> DataFrame:
    """Links that are left once the gone rows of a type are."""
    g = gone.select(F.col("id").alias("__g"))
    return links.join(g, (F.col("fromType") == type_) & (F.col("fromId") == F.col("__g")), "left_anti").join(g, (F.col("toType") == type_) & (F.col("toId") == F.col("__g")), "left_anti")


def order_trash_plan(links: DataFrame, ros: DataFrame, order_id: str, mode: str) -> DataFrame:
    """(fileId, action) for the attachments of an order that goes to the trash.

    keep: nothing happens; unlink: all are unlinked; trash: those on no other live order go with it, the others stay.
    """
    mine = links.where((F.col("fromType") == "ro") & (F.col("toType") == "file") & (F.col("fromId") == order_id)).select(F.col("toId").alias("fileId")).distinct()
    if mode != "trash":
        return mine.withColumn("action", F.lit(mode))
    other = links.where((F.col("fromType") == "ro") & (F.col("toType") == "file") & (F.col("fromId") != order_id))
    other = other.join(live(ros).select(F.col("id").alias("__r")), F.col("fromId") == F.col("__r"), "left_semi").select(F.col("toId").alias("fileId")).distinct().withColumn("__o", F.lit(1))
    return mine.join(other, "fileId", "left").select("fileId", F.when(F.col("__o").isNull(), "trash").otherwise("keep").alias("action"))


def trashed_with(files: DataFrame, order_id: str) -> DataFrame:
    return files.where(F.col("trashedWith") == order_id)


def intake_decisions(incoming: DataFrame, files: DataFrame, blobs: DataFrame, decision: str = "keep") -> DataFrame:
    """(incoming id, holder, action) by content: new bytes are kept; known ones are reused, kept again or skipped.

    A holder in the trash is revived when its bytes are reused or the newcomer is skipped.
    """
    held = blobs.select(F.col("id").alias("__b"), "sha256").join(files.select(F.col("id").alias("holder"), blob_key().alias("__k"), "deletedAt"), F.col("__b") == F.col("__k"))
    first = held.groupBy("sha256").agg(F.min(F.struct(F.col("deletedAt").isNotNull().alias("gone"), "holder")).alias("h"))
    rows = incoming.select("id", "sha256").join(first, "sha256", "left")
    known = F.col("h").isNotNull()
    return rows.select("id", F.col("h.holder").alias("holder"), F.when(~known, "new").otherwise(F.lit(decision)).alias("action"), (known & F.col("h.gone") & F.lit(decision != "keep")).alias("revive"))


def merge_scan(order: DataFrame, scan: DataFrame) -> DataFrame:
    """Orders with the blanks filled from their scans (key id) and lines appended whose squashed text is new."""
    fields = [c for c in ("ro", "tag", "vehicle", "vin", "color", "mileage", "opened", "advisor", "customer", "phone", "email") if c in scan.columns and c in order.columns]
    sc = scan.select("id", *[F.col(c).alias(f"__{c}") for c in fields], F.col("lines").alias("__lines"))
    rows = order.join(sc, "id", "left")
    name = lambda x: F.upper(squash(x["text"]))
    kept = F.filter("lines", lambda x: squash(x["text"]) != "")
    had = F.transform(kept, name)
    new = F.filter(F.coalesce("__lines", F.array().cast(order.schema["lines"].dataType)), lambda x: (squash(x["text"]) != "") & ~F.array_contains(had, name(x)))
    out = rows.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), f"__{c}") for c in fields} | {"lines": F.concat(kept, new)})
    return out.drop(*[f"__{c}" for c in fields], "__lines")


def keep_edited(stored: DataFrame, imported: DataFrame, key: str = "id") -> DataFrame:
    """Imported rows, but fields edited by hand keep the stored value."""
    old = stored.select(F.col(key).alias("__k"), F.struct(*stored.columns).alias("__old"))
    rows = imported.join(old, F.col(key) == F.col("__k"), "left")
    edited = lambda c: F.coalesce(F.try_element_at("__old.edited", F.lit(c)) == 1, F.lit(False))
    return rows.select(*[F.when(edited(c), F.col(f"__old.{c}")).otherwise(F.col(c)).alias(c) if c in stored.columns and c not in (key, "edited") else F.col(c) for c in imported.columns if c != "edited"], F.coalesce("__old.edited", F.col("edited") if "edited" in imported.columns else F.lit(None)).alias("edited"))


def upsert_tools(stored: DataFrame, incoming: DataFrame, fields: list[str]) -> DataFrame:
    """Merge of imported tools: by id, else by the tool number's first holder; values overwrite, blanks keep.

    New rows get ids t1, t2, ... after the highest in use, in the order of column `pos`.
    """
    by_no = stored.where(s("toolNo") != "").groupBy(F.col("toolNo").alias("__no")).agg(F.min("id").alias("__by_no"))
    known = stored.select(F.col("id").alias("__by_id"))
    rows = incoming.join(known, F.col("id") == F.col("__by_id"), "left").join(by_no, F.col("toolNo") == F.col("__no"), "left")
    rows = rows.withColumn("__target", F.coalesce("__by_id", "__by_no"))
    last = Window.partitionBy("__target").orderBy(F.col("pos").desc())
    value = lambda c: F.first(F.nullif(F.trim(F.col(c)), F.lit("")), ignorenulls=True).over(last.rowsBetween(0, Window.unboundedFollowing))
    hits = rows.where("__target is not null").withColumns({c: value(c) for c in fields}).withColumn("__r", F.row_number().over(last)).where("__r = 1")
    hits = hits.select("__target", *[F.col(c).alias(f"__{c}") for c in fields])
    changed = stored.join(hits, F.col("id") == F.col("__target"), "left").withColumns({c: F.coalesce(f"__{c}", c) for c in fields}).select(stored.columns)
    top = stored.agg(F.coalesce(F.max(F.regexp_extract("id", r"^t(\d+)$", 1).try_cast("int")), F.lit(0)).alias("__top"))
    new = ranked(rows.where("__target is null"), F.lit(0), "pos", "__at").crossJoin(F.broadcast(top)).withColumn("id", F.concat(F.lit("t"), (F.col("__top") + F.col("__at")).cast("string")))
    return changed.unionByName(new.select("id", *[c for c in stored.columns if c != "id" and c in new.columns]), allowMissingColumns=True)


def rekey_documents(documents: DataFrame, files: DataFrame, links: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, files, links) after documents (id) got other ids (newId): their files and the edges to and from them follow."""
    new = keys.select(F.col("id").alias("__old"), F.col("newId").alias("__new"))
    moved = lambda df, c, where=F.lit(True): df.join(new, (F.col(c) == F.col("__old")) & where, "left").withColumn(c, F.coalesce("__new", c)).drop("__old", "__new")
    after = moved(documents, "id")
    owned = after.where("fileId is not null").groupBy(F.col("fileId").alias("__file")).agg(F.min("id").alias("__owner"))
    changed = documents.join(new, F.col("id") == F.col("__old")).where("fileId is not null").select(F.col("fileId").alias("__changed")).distinct()
    rows = files.join(owned, F.col("id") == F.col("__file"), "left").join(changed, F.col("id") == F.col("__changed"), "left")
    rows = rows.withColumn("docId", F.when(F.col("__changed").isNotNull(), F.col("__owner")).otherwise(F.col("docId"))).drop("__file", "__owner", "__changed")
    edges = moved(moved(links, "fromId", F.col("fromType") == "document"), "toId", F.col("toType") == "document")
    return after, rows, edges


def remove_documents(documents: DataFrame, files: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, files) without the gone documents; their files go too, but for those shown as files or named by others."""
    left = documents.join(gone.select("id"), "id", "left_anti")
    theirs = gone.where("fileId is not null").select(F.col("fileId").alias("id")).join(left.where("fileId is not null").select(F.col("fileId").alias("id")), "id", "left_anti")
    hidden = files.where("inFiles = 0").join(theirs.distinct(), "id", "left_semi").select("id")
    return left, files.join(hidden, "id", "left_anti")


def rename_collection(files: DataFrame, old: str, new: str) -> DataFrame:
    hit = F.col("collection") == old
    return files.withColumns({"rev": F.coalesce("rev", F.lit(0)) + hit.cast("int"), "collection": F.when(hit, F.lit(new)).otherwise(F.col("collection"))}).withColumn("searchText", search_text())


def toggle_stars(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen rows lose their star if all have one; else all get one."""
    rows = files.join(chosen.select("id", F.lit(True).alias("__c")), "id", "left")
    every = rows.where("__c").agg(F.coalesce(F.min("starred"), F.lit(False)).alias("__all"))
    return rows.crossJoin(F.broadcast(every)).withColumn("starred", F.when(F.col("__c"), ~F.col("__all")).otherwise(F.col("starred"))).drop("__c", "__all")


def store_counts(stores: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n") for name, df in stores.items()))
