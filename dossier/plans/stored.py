"""Queries over stores, containers, CSV, JSON and streams that Spark derives from the given tables, with their DuckDB twins.

Each writes what it needs below the shared folder and reads it back through the library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.operators import lifecycle
from dossier.plans import views
from dossier.plans.catalogue import query, t
from dossier.plans.views import FILES, ROS, _id
from dossier.sources import bytes as byte_ranges
from dossier.sources import containers, csvs
from dossier.sources.store import Store
from dossier.steps import new_path, save, written
from dossier.streaming import ingest, intake, live


def _le32(n: Column) -> Column:
    digits = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]))


def _container(kind: str, meta: Column, *payloads: Column) -> Column:
    magic, version = containers.MAGIC[kind]
    head = F.encode(meta, "utf-8")
    return F.concat(F.lit(magic), _le32(F.lit(version)), _le32(F.octet_length(head)), head, *payloads)


# --- containers


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'fvault' WHEN 1 THEN 'tidb' WHEN 2 THEN 'fdb' WHEN 3 THEN 'zip' WHEN 4 THEN 'json' WHEN 5 THEN 'json' WHEN 6 THEN CASE substr(html, 1, 2) WHEN 'PK' THEN 'zip' ELSE NULL END END AS kind FROM pages""")
def container_kinds(spark, sf_dir):
    """The kind of a page's bytes by the first ones: each magic before its markup, the markup itself, and nothing."""
    k, html = F.col("page_id") % 8, F.encode("html", "utf-8")
    heads = [b"FVLT", b"TIDB", b"FDBK", b"PK\x03\x04", b"{", b"\xef\xbb\xbf"]
    content = F.when(k == 6, html).when(k == 7, F.lit(b""))
    for n, head in enumerate(heads):
        content = content.when(k == n, F.concat(F.lit(head), html))
    return t(spark, sf_dir, "pages").select("page_id", containers.sniff(content).alias("kind"))


_SIZES = "octet_length(encode(coalesce(html, '')))::BIGINT AS nh, octet_length(encode(url))::BIGINT AS nu"


@query(f"""WITH p AS (SELECT page_id AS k, {_SIZES} FROM pages),
good AS (SELECT * FROM p WHERE k % 5 > 1), bad AS (SELECT * FROM p WHERE k % 5 <= 1)
SELECT k AS page_id, CASE WHEN k % 5 = 1 THEN 'TRAILING_BYTES' WHEN k % 3 = 0 THEN 'TRUNCATED_THUMB' ELSE 'TRUNCATED_PAYLOAD' END AS error, NULL AS part, NULL::INT AS pos, NULL AS id, NULL::BIGINT AS n FROM bad
UNION ALL SELECT k, NULL, 'blob', 0, 'f' || k, nh FROM good WHERE k % 3 = 0 UNION ALL SELECT k, NULL, 'thumb', 1, 'f' || k, nu FROM good WHERE k % 3 = 0
UNION ALL SELECT k, NULL, 'tool', 0, 't' || k, NULL FROM good WHERE k % 3 = 1 UNION ALL SELECT k, NULL, 'photo', 0, 'p' || k, nh FROM good WHERE k % 3 = 1
UNION ALL SELECT k, NULL, 'record:files', 0, 'f' || k, NULL FROM good WHERE k % 3 = 2 UNION ALL SELECT k, NULL, 'payload:blobs', 0, 'f' || k, nu + nh FROM good WHERE k % 3 = 2""")
def container_rows(spark, sf_dir):
    """Vaults, catalogues and backups of a page each; some lack their last byte, some have one too many."""
    k, html, url = F.col("page_id"), F.encode(F.coalesce("html", F.lit("")), "utf-8"), F.encode("url", "utf-8")
    size = lambda c: F.octet_length(c).cast("long")
    named = lambda letter, *more: F.struct(_id(letter, k).alias("id"), *more)
    kind = F.lit("any").alias("format")
    vault = F.to_json(F.struct(kind, F.array(named("f", size(html).alias("blobLen"), size(html).alias("size"), size(url).alias("thumbLen"))).alias("files")))
    catalogue = F.to_json(F.struct(kind, F.array(named("t")).alias("tools"), F.array(named("p", size(html).alias("len"))).alias("photos")))
    payload = named("f", F.lit("blobs").alias("store"), (size(url) + size(html)).alias("len"))
    backup = F.to_json(F.struct(kind, F.struct(F.array(named("f")).alias("files")).alias("records"), F.array(payload).alias("payloads")))
    whole = F.when(k % 3 == 0, _container("fvault", vault, html, url)).when(k % 3 == 1, _container("tidb", catalogue, html)).otherwise(_container("fdb", backup, url, html))
    content = F.when(k % 5 == 0, F.substr(whole, F.lit(1), F.octet_length(whole) - 1)).when(k % 5 == 1, F.concat(whole, F.lit(b"!"))).otherwise(whole)
    rows = containers.read(t(spark, sf_dir, "pages").select(k.cast("string").alias("path"), content.alias("content")))
    return rows.select(F.col("path").cast("long").alias("page_id"), "error", "part", "pos", "id", F.octet_length("content").cast("long").alias("n"))


@query("""WITH x AS (SELECT 't' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 50 END AS photo FROM part)
SELECT 'tool' AS part, id, (row_number() OVER (ORDER BY id) - 1)::INT AS pos, NULL::BIGINT AS n FROM x
UNION ALL SELECT 'photo', 'p' || n_nationkey, (row_number() OVER (ORDER BY 'p' || n_nationkey) - 1)::INT, octet_length(encode(n_name))::BIGINT FROM nation WHERE n_nationkey IN (SELECT photo FROM x)""")
def exported_catalogue(spark, sf_dir):
    """The tool catalogue as one container file, written by many tasks and read back by byte ranges."""
    x = views.tools(spark, sf_dir).withColumn("photo", F.when(F.col("k") % 3 == 0, _id("p", F.col("k") % 50)))
    photos = t(spark, sf_dir, "nation").select(_id("p", F.col("n_nationkey")).alias("id"), F.encode("n_name", "utf-8").alias("blob"))
    path = new_path(spark, "catalogue")
    byte_ranges.write(byte_ranges.catalogue_rows(x, photos), path, "tidb")
    spark.dataSource.register(byte_ranges.Containers)
    rows = spark.read.format("containers").option("path", path).load()
    return rows.select("part", "id", "pos", F.octet_length("content").cast("long").alias("n"))


@query(f"""WITH {FILES}, p AS (SELECT id, k, CASE WHEN collection = '' THEN '' ELSE collection || '/' END || name AS path FROM files),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY k) AS n FROM p)
SELECT id, CASE WHEN n = 1 THEN path ELSE substr(path, 1, length(path) - 4) || ' (' || n || ').txt' END AS path FROM r""")
def export_paths(spark, sf_dir):
    return containers.export_paths(views.files(spark, sf_dir), "name", "collection", "k").select("id", "path")


# --- CSV and JSON


@query("""SELECT doc_id::VARCHAR AS doc_id, source, sha256(coalesce(text, '')) AS text_sha256 FROM documents""")
def csv_round_trip(spark, sf_dir):
    """Whole texts, line ends and quotes in them, as CSV and back; the records are cut by byte ranges."""
    path = new_path(spark, "csv")
    t(spark, sf_dir, "documents").select(csvs.line(F.col("doc_id"), F.col("source"), F.col("text"))).write.text(path)
    cells = csvs.records(spark, path).select("cells")
    return cells.select(F.col("cells")[0].alias("doc_id"), F.col("cells")[1].alias("source"), F.sha2(F.coalesce(F.get("cells", F.lit(2)), F.lit("")), 256).alias("text_sha256"))


@query("""SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_size::VARCHAR AS p_size FROM part""")
def csv_table(spark, sf_dir):
    """A table with headings in several files; the separator is found by its first line."""
    path = new_path(spark, "csv")
    csvs.write(t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), path, sep=";")
    return csvs.read(spark, path)


@query("""SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def json_objects(spark, sf_dir):
    path = new_path(spark, "json")
    rows = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    csvs.write_json(rows.select("s_suppkey", "s_name", "n_name"), path)
    return spark.read.schema("s_suppkey long, s_name string, n_name string").json(path)


# --- stores


@query("""SELECT 't' || p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'new ' || p_name ELSE p_name END AS "desc", CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END::BIGINT AS rev, CASE WHEN p_partkey % 500 = 3 THEN true ELSE false END AS found
FROM part WHERE p_partkey % 7 <> 0""")
def store_changes(spark, sf_dir):
    """A store after a whole write, changes to a tenth of its rows and the removal of a seventh; some rows are got by key."""
    store = Store(spark, new_path(spark, "store"))
    x = views.tools(spark, sf_dir)
    store.commit({"tools": x})
    store.put("tools", x.where("k % 10 = 0").withColumn("desc", F.concat(F.lit("new "), "desc")))
    store.remove("tools", x.where("k % 7 = 0").select("id"))
    found = store.get("tools", x.where("k % 500 = 3").select("id")).select("id", F.lit(True).alias("found"))
    rows = store.read("tools").select("id", "desc", F.coalesce("rev", F.lit(0)).alias("rev"))
    return rows.join(found, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query("""SELECT 'f' || doc_id AS id, octet_length(encode(x))::BIGINT AS size, sha256(x) AS sha256, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS rev, doc_id % 2 = 0 AS previewed
FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'again ' ELSE '' END || coalesce(text, '') AS x FROM documents)""")
def full_puts(spark, sf_dir):
    """Files with their bytes and previews, hashed where they are written; a quarter comes a second time with other bytes."""
    k = F.col("doc_id")
    body = lambda head: F.encode(F.concat(F.lit(head), F.coalesce("text", F.lit(""))), "utf-8")
    made = lambda df, head: df.select(_id("f", k).alias("id"), F.concat("source", F.lit(".txt")).alias("name"), body(head).alias("blob"), F.when(k % 2 == 0, F.encode("source", "utf-8")).alias("thumb"))
    docs = t(spark, sf_dir, "documents")
    store = Store(spark, new_path(spark, "store"))
    store.put_full(made(docs, ""), 1)
    store.put_full(made(docs.where("doc_id % 4 = 0"), "again "), 2)
    rows = store.read("files").select("id", "rev").join(store.read("blobs").select("id", "size", "sha256"), "id")
    return rows.join(store.read("thumbs").select("id", F.lit(True).alias("previewed")), "id", "left").withColumn("previewed", F.coalesce("previewed", F.lit(False)))


@query(f"""WITH {FILES}, {ROS} SELECT 'tools' AS store, count(*) AS n FROM part UNION ALL SELECT 'ros', count(*) FROM ros UNION ALL SELECT 'vehicles', count(*) FROM customer
UNION ALL SELECT 'settings', 1 UNION ALL SELECT unnest(['files', 'blobs', 'thumbs', 'documents', 'photos', 'links', 'jobs', 'log']), 0""")
def restored_stores(spark, sf_dir):
    """Rows of each store after a restore that is verified by their numbers; what was there before is gone."""
    store = Store(spark, new_path(spark, "store"))
    store.commit({"settings": t(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.lit("old").alias("value"))})
    backup = {"tools": views.tools(spark, sf_dir), "ros": views.ros(spark, sf_dir).drop("lines"), "vehicles": views.vehicles(spark, sf_dir).withColumn("vin", F.concat("vin", F.lit("-"), F.monotonically_increasing_id()))}
    store.restore(backup, {name: df.count() for name, df in backup.items()}, 1)
    return store.counts()


@query(f"""WITH {ROS} SELECT id, CASE WHEN k % 5 = 0 THEN 'remove' ELSE 'put' END AS op FROM ros WHERE k % 5 = 0 OR k % 3 = 0 UNION ALL SELECT 'new' || r_regionkey, 'put' FROM region""")
def change_log(spark, sf_dir):
    """What changed between two states of a store, by revisions."""
    before = views.ros(spark, sf_dir).withColumn("rev", F.lit(1))
    after = before.where("k % 5 <> 0").select("id", F.when(F.col("k") % 3 == 0, 2).otherwise(1).alias("rev"))
    return ingest.change_log(before, after.union(t(spark, sf_dir, "region").select(_id("new", F.col("r_regionkey")), F.lit(1))))


@query("""SELECT 't' || ((SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY s_suppkey)) AS id, s_name AS "toolNo" FROM supplier""")
def numbered_tools(spark, sf_dir):
    """Imported tools that are in no catalogue get the ids after the highest one in use."""
    stored = views.tools(spark, sf_dir)
    new = t(spark, sf_dir, "supplier").select(F.lit(None).cast("string").alias("id"), F.col("s_name").alias("toolNo"), F.lit("new").alias("desc"), F.col("s_suppkey").alias("pos"))
    return lifecycle.upsert_tools(stored, new, ["toolNo", "desc"]).where("desc = 'new'").select("id", "toolNo")


@query("""WITH h AS (SELECT sha256(coalesce(text, '')) AS s, min('f' || doc_id) AS holder FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT 'n' || doc_id AS id, holder IS NULL AS ok, holder AS "duplicateOf", CASE WHEN holder IS NULL THEN 'note' END AS collection FROM documents LEFT JOIN h ON s = sha256(coalesce(text, '')) WHERE doc_id % 3 <> 0""")
def vault_intake(spark, sf_dir):
    """Two thirds of the texts come as files into a vault that has the other third; those whose bytes are there are skipped."""
    docs, body = t(spark, sf_dir, "documents"), F.encode(F.coalesce("text", F.lit("")), "utf-8")
    store = Store(spark, new_path(spark, "store"))
    named = lambda letter: docs.select(_id(letter, F.col("doc_id")).alias("id"), F.concat("source", F.lit(".txt")).alias("name"), F.lit("text/plain").alias("type"), F.octet_length(body).cast("long").alias("size"), body.alias("content"), "doc_id")
    store.put_full(named("f").where("doc_id % 3 = 0").select("id", "name", F.col("content").alias("blob"), F.lit(None).cast("binary").alias("thumb")), 1)
    told = intake.take_in(store, written(named("n").where("doc_id % 3 <> 0").drop("doc_id"), "incoming"), "vault", 2, decision="skip", collection="note")
    told = written(told.select("id", "ok", "duplicateOf"), "told")
    return told.join(store.read("files").select("id", "collection"), "id", "left")


@query("""SELECT 'f' || doc_id AS id, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 100 END::BIGINT AS scanned, CASE WHEN doc_id % 2 = 0 THEN 'W1NKM4GB9SF' || lpad((doc_id % 1000000)::VARCHAR, 6, '0') ELSE '' END AS vins FROM documents""")
def scan_job(spark, sf_dir):
    """The search for vehicle numbers over a store, in two parts; films are not read."""
    k = F.col("doc_id")
    store = Store(spark, new_path(spark, "store"))
    docs = t(spark, sf_dir, "documents")
    store.commit({"files": docs.select(_id("f", k).alias("id"), F.when(k % 4 == 3, "video").otherwise("text").alias("kind"), F.lit(0).alias("vinScan"), F.lit(1).alias("inFiles"))}, verify=False)
    told = F.when(k % 2 == 0, F.concat(F.lit("Order of today, VIN: W1NKM4GB9SF"), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit(", checked"))).otherwise("no number")
    intake.scan_numbers(store, docs.select(_id("f", k).alias("id"), told.alias("text")), 100, parts=2)
    return store.read("files").select("id", F.col("vinScan").alias("scanned"), F.array_join(F.coalesce("vins", F.array().cast("array<string>")), ",").alias("vins"))


# --- hashes and sets


@query("""WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)
SELECT p_partkey, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::BIGINT)), lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS crc FROM part, t""")
def name_checksums(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.crc32("p_name").alias("crc"))


@query(f"""WITH {FILES} SELECT unnest(vins) AS vin FROM files INTERSECT SELECT unnest(fins) FROM files""")
def numbers_in_both(spark, sf_dir):
    """Vehicle numbers that stand among the first and the second kind of some files."""
    f = views.files(spark, sf_dir)
    return f.select(F.explode("vins").alias("vin")).intersect(f.select(F.explode("fins").alias("vin")))


# --- streams


@query("""SELECT octet_length(encode(n_name))::BIGINT + 1 AS size, sha256(n_name || chr(10)) AS sha256 FROM nation""")
def folder_files(spark, sf_dir):
    """A folder of text files, one for each nation in a folder of its own, taken in by a stream that ends when all are in."""
    folder, out, state = (new_path(spark, n) for n in ("folder", "taken", "state"))
    names = t(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), "n_nationkey")
    names.repartition("n_nationkey").write.partitionBy("n_nationkey").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").text(folder)
    ingest.run(ingest.folder(spark, folder, 10), lambda rows, n: save(rows.select("size", "sha256"), f"{out}/batch={n}"), state).awaitTermination()
    return spark.read.schema("size long, sha256 string").option("recursiveFileLookup", "true").parquet(out)


@query("""WITH j AS (SELECT event_type AS type, event_id::VARCHAR AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id::VARCHAR) AS k FROM events),
c AS (SELECT event_type AS type, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT type, id, 'queued' AS state FROM j UNION ALL SELECT type, id, 'running' FROM j JOIN c USING (type) WHERE k <= n""")
def live_claims(spark, sf_dir):
    """The job queue as a stream with state: every event queues a job, and afterwards a third of them are workers' claims, each
    of which takes the oldest one of its type."""
    folder, out, state = (new_path(spark, n) for n in ("events", "changes", "state"))
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("event_id").alias("k"), F.col("ts").cast("timestamp").alias("at"))
    none = F.lit(None).cast("string").alias("note"), F.lit(None).cast("boolean").alias("no_retry")
    queued = e.select("type", F.col("k").cast("string").alias("id"), "at", F.lit("enqueue").alias("event"), F.lit(None).cast("string").alias("owner"), *none)
    claims = e.where("k % 3 = 0").select("type", F.lit(None).cast("string").alias("id"), F.lit("2100-01-01").cast("timestamp").alias("at"), F.lit("claim").alias("event"), F.concat(F.lit("w"), "k").alias("owner"), *none)
    save(queued.union(claims), folder)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        changes = live.live_jobs(spark.readStream.schema(live.EVENT).parquet(folder))
        ingest.run(changes, lambda rows, n: save(rows.select("type", "id", "state"), f"{out}/batch={n}"), state).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema("type string, id string, state string").option("recursiveFileLookup", "true").parquet(out)

