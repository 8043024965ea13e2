"""Queries over the writes: puts, trash, upserts, merges, jobs, searches and document records, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F


from dossier.operators import facets, layout, lifecycle, migrate, relations, search
from dossier.plans import views
from dossier.plans.catalogue import NOW, _as_jobs, _JOBS, query, t
from dossier.plans.views import BLOBS, CATALOGUE, FILES, LINKS, PAPERS, ROS, VEHICLES, VIN_SQL, _id, code, number


@query(f"""WITH {FILES}, w AS (SELECT 'f' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 5 END AS expected FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'new', NULL)
SELECT coalesce(f.id, w.id) AS id, CASE WHEN w.id IS NULL OR w.expected = 5 THEN f.name ELSE 'written' END AS name, CASE WHEN w.id IS NULL OR w.expected = 5 THEN 1 WHEN f.id IS NULL THEN 1 ELSE 2 END::BIGINT AS rev, coalesce(w.expected = 5, false) AS conflict
FROM files f FULL JOIN w ON w.id = f.id""")
def put_rows(spark, sf_dir):
    """Writes that name the revision they were made from; those that come too late change nothing."""
    f = views.files(spark, sf_dir).select("id", "name", "rev")
    k = F.col("doc_id")
    writes = t(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(_id("f", k).alias("id"), F.lit("written").alias("name"), F.when(k % 2 == 0, 1).otherwise(5).cast("long").alias("expectedRev"))
    writes = writes.union(spark.createDataFrame([("new", "written", None)], "id string, name string, expectedRev long"))
    after, conflicts = lifecycle.put(f, writes)
    return after.select("id", "name", "rev").join(conflicts.select("id", F.lit(True).alias("conflict")), "id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


@query(f"WITH {FILES} SELECT id FROM files WHERE deletedAt IS NULL")
def removed_rows(spark, sf_dir):
    f = views.files(spark, sf_dir)
    return lifecycle.remove(f, f.where("deletedAt is not null")).select("id")


@query("""SELECT 'f' || doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'Untitled' ELSE source END AS name, 'application/octet-stream' AS type, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END::BIGINT AS size, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END::INT AS "inFiles",
  CASE WHEN doc_id % 4 = 0 THEN 'untitled ' ELSE lower(source) || ' ' END || coalesce(lower(lang), '') || ' a b   ' AS text FROM documents""".replace(" || ' a b   '", " || '  a b  '"))
def prepared_files(spark, sf_dir):
    """Defaults of new records and the text that searches read."""
    k = F.col("doc_id")
    none = F.lit(None).cast("string")
    raw = t(spark, sf_dir, "documents").select(_id("f", k).alias("id"), F.when(k % 4 != 0, F.col("source")).alias("name"), F.lit("").alias("type"), none.alias("kind"), F.col("lang").alias("collection"), none.alias("note"), F.when(k % 3 != 0, F.col("n_chars")).alias("size"), F.array(F.lit("a"), F.lit("B")).alias("tags"), F.lit(None).cast("array<string>").alias("vins"), F.lit(None).cast("array<string>").alias("fins"), F.lit(None).cast("boolean").alias("starred"), F.lit(None).cast("long").alias("vinScan"), F.when(k % 5 == 0, 0).otherwise(7).alias("inFiles"), F.lit(0).cast("long").alias("deletedAt"), none.alias("blobId"), none.alias("trashedWith"), F.lit(None).cast("long").alias("createdAt"), F.lit(None).cast("long").alias("updatedAt"))
    return lifecycle.prepare_files(raw, NOW).select("id", "name", "type", F.col("size").cast("long").alias("size"), "inFiles", F.col("searchText").alias("text"))


@query(f"WITH {ROS} SELECT id, replace(ro, ' ', '') AS \"roKey\" FROM ros")
def prepared_orders(spark, sf_dir):
    return lifecycle.prepare_orders(views.ros(spark, sf_dir)).select("id", "roKey")


@query(f"""WITH {FILES}, c AS (SELECT * FROM files WHERE k % 4 = 0)
SELECT id, CASE WHEN k % 4 = 0 AND deletedAt IS NULL THEN 77 ELSE deletedAt END::BIGINT AS trashed, CASE WHEN k % 4 = 0 THEN NULL ELSE deletedAt END::BIGINT AS restored, (1 + (k % 4 = 0 AND deletedAt IS NULL)::INT)::BIGINT AS rev FROM files""")
def trash_and_restore(spark, sf_dir):
    f = views.files(spark, sf_dir)
    chosen = f.where("k % 4 = 0")
    back = lifecycle.restore(f, chosen).select("id", F.col("deletedAt").alias("restored"))
    return lifecycle.trash(f, chosen, 77).select("id", F.col("deletedAt").alias("trashed"), "rev").join(back, "id")


@query(f"WITH {LINKS} SELECT fromId, toId, count(*) AS n FROM links WHERE NOT (toType = 'file' AND p % 5 = 0) GROUP BY 1, 2")
def links_left(spark, sf_dir):
    gone = t(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(_id("f", F.col("p_partkey")).alias("id"))
    return lifecycle.cascade_links(views.links(spark, sf_dir), gone, "file").groupBy("fromId", "toId").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT c_custkey AS k, {VIN_SQL.format('c_custkey')} AS vin FROM customer)
SELECT vin, CASE WHEN k % 2 = 0 THEN 'old' ELSE 'new' END AS fin, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'A,B' WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS sources FROM s WHERE k % 2 = 0 OR k % 3 = 0""")
def noted_vehicles(spark, sf_dir):
    """Sightings fill gaps and never overwrite; what has not the shape of a number drops out."""
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer")
    empty = F.lit(None).cast("string")
    stored = c.where("c_custkey % 2 = 0").select(code(k).alias("vin"), F.lit("old").alias("fin"), empty.alias("model"), empty.alias("series"), F.array(F.lit("A")).alias("sources"), F.lit(None).cast("long").alias("confirmedAt"), F.lit(1).cast("long").alias("createdAt"), F.lit(1).cast("long").alias("updatedAt"))
    seen = c.where("c_custkey % 3 = 0").select(F.concat(F.lit(" "), F.lower(code(k))).alias("vin"), F.lit("new").alias("fin"), empty.alias("model"), F.lit("B").alias("source"))
    seen = seen.union(spark.createDataFrame([("too short", "x", None, "B")], "vin string, fin string, model string, source string"))
    return lifecycle.note_vehicles(stored, seen, NOW).select("vin", "fin", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {ROS} SELECT id, CASE WHEN k % 2 = 0 THEN 'phone' ELSE '' END AS phone, advisor, 'job ' || k % 17 || CASE WHEN k % 17 = 3 THEN '' ELSE ';job 3' END || ';extra ' || k AS lines FROM ros""")
def merged_scans(spark, sf_dir):
    """A scan fills blanks only, and brings the lines that are new whatever their spaces and case."""
    r = views.ros(spark, sf_dir)
    line = lambda text: F.struct(text.alias("text"), F.lit("00").alias("op"))
    scan = r.select("id", F.when(F.col("k") % 2 == 0, "phone").alias("phone"), F.lit("other").alias("advisor"), F.array(line(F.lit(" JOB   3 ")), line(F.concat(F.lit("extra "), F.col("k").cast("string"))), line(F.lit(" "))).alias("lines"))
    out = lifecycle.merge_scan(r, scan)
    told = F.transform("lines", lambda x: F.when(F.trim(x["text"]).startswith("JOB"), "job 3").otherwise(x["text"]))
    return out.select("id", F.coalesce("phone", F.lit("")).alias("phone"), "advisor", F.array_join(told, ";").alias("lines"))


@query("""SELECT 't' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'imported' END AS "desc", 'other' AS ct FROM part""")
def edited_kept(spark, sf_dir):
    """An import leaves fields that were edited by hand."""
    x = views.tools(spark, sf_dir).select("id", "desc", "ct", F.when(F.col("k") % 2 == 0, F.create_map(F.lit("desc"), F.lit(1))).alias("edited"))
    new = x.select("id", F.lit("imported").alias("desc"), F.lit("other").alias("ct"))
    return lifecycle.keep_edited(x, new).select("id", "desc", "ct")


@query(f"WITH {FILES} SELECT id, CASE WHEN collection = 'en' THEN 'english' ELSE collection END AS collection, collection = 'en' AS hit FROM files")
def renamed_collection(spark, sf_dir):
    out = lifecycle.rename_collection(views.files(spark, sf_dir), "en", "english")
    return out.select("id", "collection", (F.contains("searchText", F.lit(" english ")) & (F.col("rev") == 2)).alias("hit"))


@query(f"""WITH {FILES} SELECT id, CASE WHEN k % 3 = 0 THEN false ELSE starred END AS stars, CASE WHEN k % 2 = 0 THEN true ELSE starred END AS mixed FROM files""")
def toggled_stars(spark, sf_dir):
    """All chosen rows are starred: they lose it. Some are: all get it."""
    f = views.files(spark, sf_dir)
    one, two = lifecycle.toggle_stars(f, f.where("k % 3 = 0")), lifecycle.toggle_stars(f, f.where("k % 2 = 0"))
    return one.select("id", F.col("starred").alias("stars")).join(two.select("id", F.col("starred").alias("mixed")), "id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'confirmed' WHEN c_custkey % 3 = 1 THEN 'check-digit-ok' ELSE 'extracted' END AS status FROM customer""")
def vehicle_states(spark, sf_dir):
    k = F.col("c_custkey")
    v = t(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 2, "W1NKMAGB9SF382775").otherwise("W1NKM4GB9SF382775").alias("vin"), F.when(k % 3 == 0, k).alias("confirmedAt"))
    return v.select("c_custkey", lifecycle.vehicle_status().alias("status"))


# --- migration


@query("""WITH o AS (SELECT 'a' || o_orderkey AS id, 'S' || o_orderkey % 100 AS collection, o_orderkey AS k FROM orders), f AS (SELECT 'f' || doc_id AS id, 'S' || doc_id % 150 AS collection FROM documents)
SELECT o.id AS "fromId", f.id AS "toId" FROM o JOIN f USING (collection)""")
def migrated_attachments(spark, sf_dir):
    """Files of an old collection become attachments of the orders that name it."""
    o = t(spark, sf_dir, "orders").select(_id("a", F.col("o_orderkey")).alias("id"), F.concat(F.lit(" s"), (F.col("o_orderkey") % 100).cast("string"), F.lit(" ")).alias("collection"))
    f = t(spark, sf_dir, "documents").select(_id("f", F.col("doc_id")).alias("id"), _id("S", F.col("doc_id") % 150).alias("collection"))
    return migrate.attachments(o, f, NOW).select("fromId", "toId")


@query("""WITH old AS (SELECT 'r' || o_orderkey AS id, 'n' || o_orderkey % 1000 AS key, o_orderdate AS d, o_orderkey AS k FROM orders)
SELECT id, CASE WHEN first <> id THEN first END AS conflict, CASE WHEN first <> id THEN NULL ELSE upper(key) END AS "roKey", k % 4 = 0 AS had FROM (SELECT *, first_value(id) OVER (PARTITION BY key ORDER BY k % 4 <> 0, d, id) AS first FROM old)""")
def migrated_orders(spark, sf_dir):
    """Legacy orders beside those that were there: an id or a number that exists wins, later holders are flagged."""
    o = t(spark, sf_dir, "orders").select(_id("r", F.col("o_orderkey")).alias("id"), _id("n", F.col("o_orderkey") % 1000).alias("ro"), F.col("o_orderdate").alias("createdAt"), F.col("o_orderkey").alias("k"))
    here = o.where("k % 4 = 0")
    return migrate.orders(here.withColumn("had", F.lit(True)), o.withColumn("had", F.lit(False))).select("id", F.col("roConflict").alias("conflict"), "roKey", "had")


@query("""SELECT 'none' AS name, 'none' AS status UNION ALL SELECT 'needed', 'needed' UNION ALL SELECT 'cleanup', 'cleanup'""")
def migration_status(spark, sf_dir):
    old = t(spark, sf_dir, "supplier").select(_id("s", F.col("s_suppkey")).alias("id"))
    cases = {"none": (old.limit(0), old), "needed": (old, old.where("id <> 's1'")), "cleanup": (old, old)}
    out = None
    for name, (legacy, present) in cases.items():
        row = migrate.status({"files": legacy}, {"files": present}).select(F.lit(name).alias("name"), "status")
        out = row if out is None else out.union(row)
    return out


@query(f"""WITH {PAPERS}, {FILES}
SELECT p.id, CASE WHEN p.k % 2 = 0 THEN 'd1' || p.k ELSE p.id END AS "newId", CASE WHEN f.id IS NOT NULL AND p.k % 2 = 0 THEN 'd1' || p.k ELSE f.docId END AS "docId" FROM papers p LEFT JOIN files f ON f.id = p.fileId""")
def rekeyed_documents(spark, sf_dir):
    """Documents that get another id take their files along."""
    d, f = views.papers(spark, sf_dir), views.files(spark, sf_dir)
    keys = d.where("k % 2 = 0").select("id", F.concat(F.lit("d1"), F.col("k").cast("string")).alias("newId"))
    documents, owned, _ = lifecycle.rekey_documents(d, f, views.links(spark, sf_dir), keys)
    out = documents.select(F.concat(F.lit("d"), F.col("k").cast("string")).alias("id"), F.col("id").alias("newId"), F.col("fileId").alias("__file"))
    return out.join(owned.select(F.col("id").alias("__file"), "docId"), "__file", "left").drop("__file")


@query(f"""WITH {PAPERS}, {FILES}, gone AS (SELECT fileId FROM papers WHERE k % 3 = 0 AND fileId IS NOT NULL)
SELECT id, CASE WHEN id IN (SELECT fileId FROM gone) THEN CASE WHEN inFiles = 1 THEN 'kept' ELSE 'removed' END ELSE 'other' END AS outcome FROM files""")
def documents_with_files_removed(spark, sf_dir):
    """Files of removed documents go too, unless they are shown as files of their own."""
    d, f = views.papers(spark, sf_dir), views.files(spark, sf_dir)
    left_documents, left_files = lifecycle.remove_documents(d, f, d.where("k % 3 = 0"))
    mine = d.where("k % 3 = 0 and fileId is not null").select(F.col("fileId").alias("id"), F.lit(1).alias("m"))
    had = f.select("id").join(left_files.select("id", F.lit(1).alias("l")), "id", "left").join(mine, "id", "left")
    return had.select("id", F.when(F.col("m").isNull(), "other").when(F.col("l").isNull(), "removed").otherwise("kept").alias("outcome"))


# --- imports, backups and extracts


@query("""SELECT p_partkey AS pos, 't' || p_partkey AS id, p_name AS "toolNo", p_type AS location, '' AS comment FROM part""")
def imported_tool_rows(spark, sf_dir):
    """Rows of a table whose heading stands third, with other names for some columns."""
    p = t(spark, sf_dir, "part").select((F.col("p_partkey") + 10).alias("pos"), F.array(F.concat(F.lit("t"), F.col("p_partkey").cast("string")), "p_name", "p_type").alias("cells"))
    head = spark.createDataFrame([(0, ["Catalogue"]), (1, []), (2, [" ID ", "Tool Number", "Bin", "X"])], "pos long, cells array<string>")
    from dossier.sources import csvs

    return csvs.tool_rows(head.union(p)).select((F.col("pos") - 10).alias("pos"), "id", "toolNo", "location", "comment")


@query("""SELECT p_partkey, trim(p_name) AS "toolNo", upper(p_type) AS ct, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS price, p_partkey % 3 = 0 AS star FROM part""")
def prepared_tools(spark, sf_dir):
    k = F.col("p_partkey")
    raw = t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("toolNo"), F.lower("p_type").alias("ct"), F.when(k % 2 == 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("price"), F.when(k % 3 == 0, True).alias("star"))
    return lifecycle.prepare_tools(raw).select("p_partkey", "toolNo", "ct", "price", "star")


@query("""SELECT 'k' || o_orderkey AS key, o_orderkey % 4 <> 3 AND o_orderkey % 40 <= 32 AS kept FROM orders""")
def backed_up_settings(spark, sf_dir):
    """Settings that are JSON and not nested too deep go into a backup; the others are listed."""
    k = F.col("o_orderkey")
    deep = (k % 40).cast("int")
    value = F.concat(F.repeat(F.lit("["), deep), F.lit('"[[{\\" x"'), F.repeat(F.lit("]"), deep))
    rows = t(spark, sf_dir, "orders").select(_id("k", k).alias("key"), F.when(k % 4 == 3, F.lit("{not json")).otherwise(value).alias("value"))
    kept, skipped = lifecycle.backup_settings(rows)
    return kept.select("key", F.lit(True).alias("kept")).union(skipped.select("key", F.lit(False)))


@query(f"""WITH {FILES}, {BLOBS}, {PAPERS}, o AS (SELECT fileId, max(id) AS id FROM papers WHERE fileId IS NOT NULL GROUP BY 1)
SELECT f.id, CASE WHEN p.id IS NOT NULL THEN 'LI Documents/' || p.li || '_' || (p.k % 7) || '.pdf' ELSE CASE WHEN f.deletedAt IS NULL THEN 'Files/' ELSE 'Trash/' END || CASE WHEN f.collection = '' THEN '' ELSE f.collection || '/' END || f.name END AS path, octet_length(encode(b.text))::BIGINT AS n
FROM files f JOIN blobs b ON b.id = coalesce(f.blobId, f.id) LEFT JOIN o ON o.fileId = f.id LEFT JOIN papers p ON p.id = o.id""")
def extracted_paths(spark, sf_dir):
    d = views.papers(spark, sf_dir).withColumn("title", F.lit(""))
    out = relations.extract_paths(views.files(spark, sf_dir), d, views.blobs(spark, sf_dir).select("id", F.col("blob").alias("content")))
    return out.select("id", "path", F.octet_length("content").cast("long").alias("n"))


@query("""SELECT page_id, 'f' || page_id AS id, url AS text FROM pages WHERE page_id % 3 <> 0""")
def legacy_vaults(spark, sf_dir):
    """JSON vaults with base64 bytes, one for each page; every third has none."""
    from dossier.sources import containers

    k = F.col("page_id")
    record = F.struct(_id("f", k).alias("id"), F.lit("x").alias("name"), F.when(k % 3 != 0, F.base64(F.encode("url", "utf-8"))).alias("blob"))
    text = F.to_json(F.struct(F.lit("any").alias("format"), F.array(record).alias("files")))
    found = t(spark, sf_dir, "pages").select(k.cast("string").alias("path"), F.encode(text, "utf-8").alias("content"))
    return containers.legacy_vault(found).select(F.col("path").cast("long").alias("page_id"), "id", F.decode("content", "utf-8").alias("text"))


@query("""SELECT page_id, pos::INT AS pos, CASE WHEN pos = 0 THEN url ELSE 'second' END AS text FROM pages, (SELECT unnest([0, 1]) AS pos)""")
def loose_vaults(spark, sf_dir):
    """Binary vaults read by their lengths alone, with a thumbnail after the first file."""
    from dossier.sources import containers

    meta = F.to_json(F.struct(F.array(F.struct(F.lit("a").alias("id"), F.lit("n").alias("name"), F.octet_length("url").cast("long").alias("blobLen"), F.lit(5).cast("long").alias("thumbLen")), F.struct(F.lit("b").alias("id"), F.lit("n").alias("name"), F.lit(6).cast("long").alias("blobLen"), F.lit(None).cast("long").alias("thumbLen"))).alias("files")))
    size = F.lpad(F.hex(F.octet_length("meta")), 8, "0")
    content = F.concat(F.lit(b"FVLT\x02\x00\x00\x00"), F.reverse(F.unhex(size)), F.encode("meta", "utf-8"), F.encode("url", "utf-8"), F.lit(b"thumb"), F.lit(b"second"))
    found = t(spark, sf_dir, "pages").select("page_id", "url", meta.alias("meta")).select(F.col("page_id").cast("string").alias("path"), content.alias("content"))
    return containers.loose(found).select(F.col("path").cast("long").alias("page_id"), "pos", F.decode("content", "utf-8").alias("text"))


# --- jobs


@query(f"""WITH j AS ({_JOBS})
SELECT id, CASE WHEN event <> 0 THEN state WHEN state = 'queued' THEN 'cancelled' WHEN state = 'running' THEN 'cancelling' ELSE state END AS state FROM (SELECT *, id::BIGINT % 5 AS event FROM j)
UNION ALL SELECT 'n' || r_regionkey, 'queued' FROM region""")
def cancelled_jobs(spark, sf_dir):
    """Some jobs are cancelled, and new ones are queued behind them."""
    from dossier.streaming import jobs

    j = _as_jobs(t(spark, sf_dir, "events"))
    new = t(spark, sf_dir, "region").select(_id("n", F.col("r_regionkey")).alias("id"), F.lit("scan").alias("type"), F.array(F.lit("x")).alias("inputIds"), F.lit("{}").alias("meta"))
    return jobs.enqueue(jobs.cancel(j, j.where("cast(id as long) % 5 = 0")), new, NOW).select("id", "state")


@query(f"""WITH j AS ({_JOBS}), o AS (SELECT *, id::BIGINT % 7 AS r FROM j WHERE state = 'running')
SELECT j.id, CASE WHEN o.r IS NULL OR o.r > 3 THEN j.state WHEN o.r = 0 THEN 'done' WHEN o.r = 1 AND j.attempts < 5 THEN 'queued' ELSE 'failed' END AS state FROM j LEFT JOIN o USING (id)""")
def finished_jobs(spark, sf_dir):
    from dossier.streaming import jobs

    j = _as_jobs(t(spark, sf_dir, "events")).withColumns({"result": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "progress": F.lit(0.0)})
    r = F.col("id").cast("long") % 7
    outcomes = j.where("state = 'running'").where(r <= 3).select("id", (r == 0).alias("ok"), F.lit("r").alias("result"), F.lit("e").alias("error"), F.when(r == 1, F.lit(None)).otherwise(F.lit(False)).cast("boolean").alias("retry"))
    return jobs.finish(j, outcomes, NOW).select("id", "state")


@query(f"""WITH j AS ({_JOBS}) SELECT id, state = 'running' AND id::BIGINT % 3 = 0 AS beaten FROM j""")
def job_heartbeats(spark, sf_dir):
    from dossier.streaming import jobs

    j = _as_jobs(t(spark, sf_dir, "events"))
    j = j.withColumn("owner", F.when(F.col("id").cast("long") % 3 == 0, "me").otherwise("you"))
    return jobs.beat(j, "me", NOW).select("id", (F.col("heartbeat") == NOW).alias("beaten"))


# --- searches


@query(f"""WITH {FILES} SELECT id FROM files WHERE inFiles = 1 AND deletedAt IS NULL AND contains(name, 'src') AND contains(name, '-1') ORDER BY updatedAt DESC, id LIMIT 5""")
def search_files(spark, sf_dir):
    f = views.files(spark, sf_dir)
    return search.files(f.withColumn("searchText", lifecycle.search_text()).withColumn("searchText", F.lower("name")), "SRC  ‐1").select("id")


@query(f"""WITH {PAPERS}, fit AS (SELECT *, min(id) OVER (PARTITION BY li) AS first_id, row_number() OVER (PARTITION BY li ORDER BY k % 7 DESC, id) AS r FROM papers WHERE contains(lower(reason || ' ' || fgroup), 'why 3') OR contains(lower(replace(replace(li, '.', ''), '-', '')), '10p00003'))
SELECT id FROM fit WHERE r = 1 ORDER BY first_id LIMIT 5""".replace("contains(lower(reason || ' ' || fgroup), 'why 3') OR ", ""))
def search_papers(spark, sf_dir):
    return search.documents(views.papers(spark, sf_dir), "10-P-00003").select("id")


@query(f"""WITH {CATALOGUE} SELECT id FROM tools WHERE contains(replace(toolNo, ' ', ''), '5890763') ORDER BY id LIMIT 5""")
def search_tools(spark, sf_dir):
    return search.tools(views.tools(spark, sf_dir), "589-07 63").select("id")


@query(f"""WITH {ROS} SELECT id FROM ros WHERE deletedAt IS NULL AND contains(lower(tag || ' ' || vin || ' ' || advisor || ' 54 job ' || k % 17), '77') ORDER BY updatedAt DESC, id LIMIT 5""")
def search_orders(spark, sf_dir):
    return search.orders(views.ros(spark, sf_dir).withColumn("ro", F.lit("")), "Ticket 77").select("id")


@query(f"""WITH {VEHICLES} SELECT vin FROM vehicles WHERE contains(vin, '71A00000') OR contains(fin, '71A00000') ORDER BY vin LIMIT 3""")
def search_vehicles(spark, sf_dir):
    return search.vehicles(views.vehicles(spark, sf_dir), "71a-00000").select("vin")


# --- document records from placed text


@query(f"""SELECT page_id, 'LI' || lpad((page_id % 90 + 10)::VARCHAR, 2, '0') || '.10-P-' || lpad((page_id % 100000)::VARCHAR, 6, '0') AS li, (page_id % 9 + 1)::VARCHAR AS ver, 'Noise in gear ' || page_id % 6 AS title,
  '54' AS fgroup, '3/4/2024' AS date, 'Model series ' || (page_id % 100 + 200) || ', 213' AS validity FROM pages""")
def document_records(spark, sf_dir):
    """Placed text items of a page each: lines, then number, version, title and labelled fields."""
    k = F.col("page_id")
    item = lambda y, x, text, h=10.0: F.struct(F.lit(1).alias("page"), text.alias("str"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(6 * 4)).alias("w"), F.lit(h).alias("h"))
    items = F.array(
        item(800, 10, F.lit("XENTRY TIPS")), item(780, 10, F.concat(F.lit("Noise in gear "), (k % 6).cast("string")), 14.0),
        item(760, 10, F.lit("Topic number")), item(760.4, 100, number(k)), item(740, 10, F.lit("Version")), item(740, 100, (k % 9 + 1).cast("string")),
        item(720, 10, F.lit("Function group")), item(720, 200, F.lit("54")), item(700, 10, F.lit("Date")), item(700, 100, F.lit("3.4.2024")),
        item(680, 10, F.lit("Validity")), item(680, 100, F.concat(F.lit("Model series "), (k % 100 + 200).cast("string"), F.lit(","))), item(660, 10, F.lit("213")), item(640, 10, F.lit("Complaint")), item(620, 10, F.lit("It is loud.")),
    )
    rows = t(spark, sf_dir, "pages").select(k.alias("doc"), F.explode(items).alias("i")).select("doc", "i.*")
    return layout.records(layout.lines(rows)).select(F.col("doc").alias("page_id"), "li", "ver", "title", "fgroup", "date", "validity")


@query("""SELECT o_orderkey, 'Check brake x' || o_orderkey || ';Replace' AS lines FROM orders""")
def dispatch_screens(spark, sf_dir):
    screen = F.concat(F.lit("Header\n1) A 54 OPEN Check brake x"), F.col("o_orderkey").cast("string"), F.lit("  1234  2.5 x\nnoise\r\n 2)B 42 DONE  Replace  4711\n3) A 1 2 ab"))
    return t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(layout.dispatch_lines(screen), ";").alias("lines"))


@query("""SELECT o_orderkey AS page, CASE WHEN o_orderkey % 2 = 0 THEN 90 ELSE 0 END::INT AS angle FROM orders""")
def page_orientation(spark, sf_dir):
    """The angle at which the most words are read with confidence; upright unless one is sure enough."""
    k = F.col("o_orderkey")
    word = lambda angle, conf, n: F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit(angle).alias("angle"), F.concat(F.lit("word"), i.cast("string")).alias("text"), F.lit(conf).alias("conf")))
    words = F.concat(word(0, 70.0, F.lit(5)), word(90, 80.0, F.when(k % 2 == 0, 12).otherwise(8)), word(180, 20.0, F.lit(30)))
    rows = t(spark, sf_dir, "orders").select(k.alias("page"), F.explode(words).alias("w")).select("page", "w.*")
    return layout.best_orientation(rows).select("page", F.col("angle").cast("int").alias("angle"))


@query("""
WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS n, 300 + l_suppkey % 200 AS x, 'PART ' || l_partkey AS t FROM lineitem),
i AS (SELECT doc, n, n - row_number() OVER (PARTITION BY doc ORDER BY n) AS g FROM (SELECT DISTINCT doc, n FROM r)),
f AS (SELECT doc, g, min(n) AS first FROM i GROUP BY doc, g)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY first) - 1)::INT AS pos, string_agg(t, ' ' ORDER BY n, x, t) AS text, string_agg(CASE WHEN n = first THEN 'B' || n END, ' ') AS left
FROM r JOIN i USING (doc, n) JOIN f USING (doc, g) GROUP BY doc, g, first
""")
def form_table_lines(spark, sf_dir):
    """Each order's lines as a form: legal text to the left, a cell, and the text that is wanted; lines that follow one another
    stand close together and are one."""
    lines = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    item = lambda str_, x, w: F.struct(str_.alias("str"), x.cast("double").alias("x"), F.lit(float(w)).alias("w"))
    told = F.array(item(F.lit("legal small print"), F.lit(10), 90), item(F.concat(F.lit("B"), "n"), F.lit(160), 20), item(F.concat(F.lit("PART "), "p"), 300 + F.col("s") % 200, 50))
    body = lines.select("doc", "page", F.explode(told).alias("i"), (F.lit(1000.0) - F.col("n") * 15).alias("y"))
    heads = F.array(*[item(F.lit(w), F.lit(x), n) for w, x, n in (("Notice", 10, 60), ("LINE", 150, 30), ("OP", 200, 15), ("CODE", 220, 30), ("INSTRUCTIONS AND DESCRIPTIONS", 400, 150))])
    top = lines.select("doc", "page").distinct().select("doc", "page", F.explode(heads).alias("i"), F.lit(1000.0).alias("y"))
    rows = layout.word_rows(body.union(top).select("doc", "page", "i.str", "i.x", "y", "i.w", F.lit(10.0).alias("h")))
    found = layout.table_lines(rows, "(?i)INSTRUCTIONS? *AND *DESCRIPTIONS?", "(?i)INSTRUCTION", "(?i)^total")
    return found.select("doc", "pos", "text", F.array_join("left", " ").alias("left"))
