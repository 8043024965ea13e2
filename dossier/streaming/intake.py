"""Intake of files into a store, and the search for vehicle numbers in them, as batches that can be run again.

A batch is one generation: files, bytes, links and follow-up jobs appear together or not at all. Either function works on
what a stream hands over (`ingest.run`) or on any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.ids import has_number, link_id
from dossier.functions.text import s
from dossier.functions.vin import find_vins
from dossier.operators import scans
from dossier.operators.facets import merge_values, ranked
from dossier.operators.lifecycle import intake_decisions, prepare_files, search_text
from dossier.operators.relations import live
from dossier.sources.store import Store

# Kinds that get previews, kinds that have no text to search, the collection of documents, endings of files that
# are opened elsewhere, and the job that follows each other target.
PREVIEWED, NOT_READ, DOCUMENTS = ("image", "video", "pdf"), ("video",), "LI Documents"
OPENED = {"tidb": "inventory-import", "fvault": "vault-restore", "lidb": "li-restore", "fdb": "platform-restore"}
FOLLOWS = {"li": "li-import", "toolbox": "toolbox-intake"}
#: Files that one follow-up job names.
NAMED = 1000


def target_of(name: Column, mime: Column) -> Column:
    """Where a file goes: a store's own files to what opens them, a PDF named by a document number to the documents."""
    low = F.lower(s(name))
    out = F.when(F.lit(False), "")
    for ending, target in OPENED.items():
        out = out.when(low.endswith("." + ending), target)
    pdf = (F.lower(s(mime)) == "application/pdf") | low.endswith(".pdf")
    return out.when(pdf & has_number(name), "li").otherwise("vault")


def _results(rows: DataFrame, ok: Column, error: Column, duplicate: Column, revived: Column) -> DataFrame:
    return rows.select("id", "name", ok.alias("ok"), error.alias("error"), duplicate.alias("duplicateOf"), revived.alias("restored"))


def take_in(store: Store, incoming: DataFrame, target: str, as_of: int, decision: str = "keep", collection: str | None = None, vin: str | None = None, order: str | None = None, tab: str | None = None, detect: bool = True) -> DataFrame:
    """Stores files (id, name, type, size, content; ids are new) and returns what became of each: (id, name, ok, error,
    duplicateOf, restored).

    A file that has a size but no bytes is reported and not stored. In the vault, files whose bytes are known are kept,
    reused (a record over the bytes that are there) or skipped, by `decision`; a holder in the trash comes back if its bytes
    are reused or stand for a skipped file. An order gets what was stored and what stands for the skipped ones. Follow-up
    jobs name up to NAMED files each.
    """
    none = F.lit(None).cast("string")
    n = F.coalesce(F.octet_length("content"), F.lit(0))
    rows = incoming.withColumn("__bad", F.col("content").isNull() | ((F.coalesce("size", F.lit(0)) > 0) & (n == 0)))
    good = rows.where("not __bad").withColumn("sha256", F.sha2("content", 256))
    files, blobs = store.read("files"), store.read("blobs")
    judged = intake_decisions(good, files, blobs, decision if target == "vault" else "keep")
    told = good.join(judged.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id")).drop("__id")
    kept = told.where("action <> 'skip'")
    reused = F.when(F.col("action") == "reuse", F.col("holder"))
    keys = files.select(F.col("id").alias("__h"), F.coalesce("blobId", "id").alias("__key"))
    meta = kept.join(keys, reused == F.col("__h"), "left").withColumns(
        {
            "size": n.cast("long"),
            "blobId": F.col("__key"),
            "inFiles": F.lit(int(target == "vault")),
            "collection": F.lit({"vault": collection, "li": DOCUMENTS}.get(target, "")),
            "kind": F.lit("pdf" if target == "li" else None).cast("string"),
            "vins": F.array(F.lit(vin.upper())) if vin and target == "vault" else F.array().cast("array<string>"),
            "rev": F.lit(1),
        }
    )
    new = prepare_files(store._shaped("files", meta), as_of)
    back = told.where("revive").select(F.col("holder").alias("id")).distinct()
    revived = files.join(back, "id", "left_semi").withColumns({"deletedAt": F.lit(None).cast("long"), "trashedWith": none, "rev": F.coalesce("rev", F.lit(0)) + 1})
    puts = {"files": new.unionByName(revived), "blobs": told.where("action not in ('skip', 'reuse')").select("id", F.col("content").alias("blob"), n.cast("long").alias("size"), "sha256")}
    if order and target == "vault":
        attached = kept.select("id").union(told.where("action = 'skip'").select("holder")).distinct()
        edge = [F.lit("ro").alias("fromType"), F.lit(order).alias("fromId"), F.lit("file").alias("toType"), F.col("id").alias("toId"), F.lit("attachment").alias("kind")]
        links = attached.select(*edge, F.lit("user").alias("source"), F.lit(as_of).alias("createdAt"), F.lit(1).alias("rev"))
        puts["links"] = links.withColumn("id", link_id(*[F.col(c) for c in ("fromType", "fromId", "toType", "toId", "kind")]))
    if target == "vault":
        wanted = new.where(F.col("kind").isin(*PREVIEWED)).select("id", F.lit("thumb").alias("type"))
        wanted = wanted.union(new.where(~F.col("kind").isin(*NOT_READ)).select("id", F.lit("vin-detect"))) if detect else wanted
    else:
        wanted = new.select("id", F.lit(FOLLOWS[target]).alias("type"))
    dealt = ranked(wanted, F.col("type"), "id", "__n").withColumn("__part", F.floor((F.col("__n") - 1) / NAMED))
    jobs = dealt.groupBy("type", "__part").agg(F.array_sort(F.collect_list("id")).alias("inputIds"))
    told_job = F.to_json(F.struct(F.lit(tab).alias("tab"))) if target == "toolbox" else F.lit("{}")
    puts["jobs"] = jobs.select(F.concat_ws("-", "type", F.lit(as_of), "__part").alias("id"), "type", F.lit("queued").alias("state"), "inputIds", told_job.alias("meta"), F.lit(0.0).alias("progress"), F.lit(0).alias("attempts"), F.lit(as_of).alias("createdAt"), F.lit(as_of).alias("updatedAt"))
    store.apply(puts)
    skipped = F.col("action") == "skip"
    done = _results(told, ~skipped, F.when(skipped, "already stored"), F.when(skipped, F.col("holder")), F.col("revive"))
    return done.union(_results(rows.where("__bad"), F.lit(False), F.lit("read: empty read"), none, F.lit(False)))


def scan_numbers(store: Store, texts: DataFrame, as_of: int, force: bool = False, parts: int = 1, most: int | None = None) -> int:
    """Writes the vehicle numbers found in the texts (id, text) of files that were never searched (all, if forced) to their
    records; returns the number of generations written.

    Numbers that are there stay unless forced. A file without a text, or without one that can be read, stays unsearched.
    Files are searched in `parts`, each one a generation: a run that ends early (after `most` parts, or by a failure) has lost
    nothing, and the next one goes on with what is left. Time and revision of the record's last edit: only the revision moves.
    """
    done = 0
    for part in range(parts if most is None else min(parts, most)):
        todo = scans.to_scan(live(store.read("files")), force).where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        found = todo.join(texts.where("text is not null").select(F.col("id").alias("__t"), find_vins(F.col("text")).alias("__f")), F.col("id") == F.col("__t"))
        merged = lambda new, old: F.col(new) if force else merge_values(F.col(new), F.col(old))
        rows = found.withColumns({"vins": merged("__f.vins", "vins"), "fins": merged("__f.fins", "fins"), "vinScan": F.lit(as_of).cast("long")}).drop("__t", "__f")
        rows = rows.withColumns({"searchText": search_text(), "rev": F.coalesce("rev", F.lit(0)) + 1})
        if not rows.isEmpty():
            store.apply({"files": rows}, verify=False)  # no bytes change
            done += 1
    return done
