"""Queries over store-shaped tables, one or more for each operator of the inventory, with their DuckDB twins.

documents stand in for files, pages for versioned technical documents, orders for work orders, customer for vehicles, part
for the tool catalogue and lineitem for the edge table. The shapes are made twice: here as columns, in SQL as common
table expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import ids, text, vin
from dossier.operators import facets, layout, lifecycle, relations, scans, search
from dossier.plans.catalogue import query, t

NUMBER_SQL = "'LI' || lpad(({0} % 90 + 10)::VARCHAR, 2, '0') || '.10-P-' || lpad(({0} % 100000)::VARCHAR, 6, '0')"
VIN_SQL = "'W1K' || ({0} % 900 + 100) || '471A' || lpad(({0} % 10000000)::VARCHAR, 7, '0')"

FILES = f"""files AS (
  SELECT doc_id AS k, 'f' || doc_id AS id, source || '-' || doc_id % 13 || '.txt' AS name, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS collection,
    ['text', 'pdf', 'image', 'video'][doc_id % 4 + 1] AS kind, n_chars::BIGINT AS size, doc_id % 3 = 0 AS starred, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS inFiles,
    CASE WHEN doc_id % 10 = 0 THEN doc_id END AS deletedAt, doc_id * 7 % 1000 AS updatedAt, CASE WHEN doc_id % 9 = 1 THEN 'f' || (doc_id - 1) END AS blobId,
    CASE WHEN doc_id % 6 = 0 THEN 'r' || doc_id % 50 END AS trashedWith, doc_id % 2 AS vinScan, CASE WHEN doc_id % 7 = 0 THEN 'd' || doc_id END AS docId,
    list_filter([source, CASE WHEN doc_id % 5 = 0 THEN {NUMBER_SQL.format('(doc_id % 40)')} END], lambda x: x IS NOT NULL) AS tags,
    CASE WHEN doc_id % 3 = 0 THEN [] ELSE [{VIN_SQL.format('(doc_id % 50)')}] END AS vins, CASE WHEN doc_id % 8 = 1 THEN [{VIN_SQL.format('(doc_id % 11)')}] ELSE [] END AS fins FROM documents)"""
PAPERS = f"""papers AS (
  SELECT page_id AS k, 'd' || page_id AS id, {NUMBER_SQL.format('(page_id % 40)')} AS li, (page_id % 7) || 'a' AS ver, CASE WHEN page_id % 11 = 0 THEN '' ELSE url END AS title, 'why ' || page_id % 5 AS reason,
    lpad((page_id % 60)::VARCHAR, 2, '0') || '.10' AS fgroup, (page_id % 12 + 1) || '/' || (page_id % 28 + 1) || '/2024' AS date, [page_id % 300 + 100, page_id % 77 + 200] AS models,
    CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'f' || page_id END AS fileId, page_id % 1000 AS size, page_id % 6 = 0 AS star, page_id * 3 % 60 AS cites FROM pages)"""
CATALOGUE = """tools AS (
  SELECT p_partkey AS k, 't' || p_partkey AS id, '000 589 ' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || ' 63 00' AS toolNo, p_name AS "desc", p_brand AS svcGrp0, p_size % 60 AS g1, p_size % 7 AS g2, p_type AS ct,
    p_retailprice AS price, p_partkey % 5 = 0 AS star, p_partkey % 4 = 0 AS offered, p_partkey % 3 = 0 AS pictured, p_size % 50 + 200 AS series FROM part)"""
ROS = f"""ros AS (
  SELECT o_orderkey AS k, 'r' || o_orderkey AS id, 'RO ' || o_orderkey % 900 AS ro, {VIN_SQL.format('(o_custkey % 50)')} AS vin, o_orderstatus AS advisor, 'ticket ' || o_orderkey AS tag,
    CASE WHEN o_orderkey % 9 = 0 THEN 1 END AS deletedAt, o_orderkey * 11 % 5000 AS updatedAt FROM orders)"""
LINKS = """links AS (
  SELECT 'r' || l_orderkey AS fromId, CASE WHEN l_linenumber % 3 = 0 THEN 'document' ELSE 'file' END AS toType, CASE WHEN l_linenumber % 3 = 0 THEN 'd' || l_partkey ELSE 'f' || l_partkey END AS toId,
    CASE WHEN l_linenumber % 3 = 0 THEN 'reference' ELSE 'attachment' END AS kind, l_partkey AS p, l_linenumber AS n FROM lineitem)"""


def number(k: Column) -> Column:
    return F.concat(F.lit("LI"), F.lpad((k % 90 + 10).cast("string"), 2, "0"), F.lit(".10-P-"), F.lpad((k % 100000).cast("string"), 6, "0"))


def code(k: Column) -> Column:
    return F.concat(F.lit("W1K"), (k % 900 + 100).cast("string"), F.lit("471A"), F.lpad((k % 10000000).cast("string"), 7, "0"))


def _id(letter: str, k: Column) -> Column:
    return F.concat(F.lit(letter), k.cast("string"))


def files(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id")
    none = F.array().cast("array<string>")
    pick = lambda n, value: F.when(n, value)
    return t(spark, sf_dir, "documents").select(
        k.alias("k"), _id("f", k).alias("id"), F.concat("source", F.lit("-"), (k % 13).cast("string"), F.lit(".txt")).alias("name"), F.when(k % 4 == 0, "").otherwise(F.col("lang")).alias("collection"),
        F.get(F.array(*map(F.lit, ("text", "pdf", "image", "video"))), (k % 4).cast("int")).alias("kind"), F.lit("").alias("type"), F.lit("").alias("note"), F.col("n_chars").cast("long").alias("size"), (k % 3 == 0).alias("starred"),
        F.when(k % 5 == 0, 0).otherwise(1).alias("inFiles"), pick(k % 10 == 0, k).alias("deletedAt"), (k * 7 % 1000).alias("updatedAt"), F.lit(0).cast("long").alias("createdAt"), pick(k % 9 == 1, _id("f", k - 1)).alias("blobId"),
        pick(k % 6 == 0, _id("r", k % 50)).alias("trashedWith"), (k % 2).alias("vinScan"), pick(k % 7 == 0, _id("d", k)).alias("docId"), F.lit(1).cast("long").alias("rev"),
        F.filter(F.array("source", pick(k % 5 == 0, number(k % 40))), lambda x: x.isNotNull()).alias("tags"), F.when(k % 3 == 0, none).otherwise(F.array(code(k % 50))).alias("vins"), F.when(k % 8 == 1, F.array(code(k % 11))).otherwise(none).alias("fins"),
    )


def papers(spark, sf_dir) -> DataFrame:
    k = F.col("page_id")
    validity = F.concat(F.lit("Model series "), (k % 300 + 100).cast("string"), F.lit(", "), (k % 77 + 200).cast("string"))
    return t(spark, sf_dir, "pages").select(
        k.alias("k"), _id("d", k).alias("id"), number(k % 40).alias("li"), F.concat((k % 7).cast("string"), F.lit("a")).alias("ver"), F.when(k % 11 == 0, "").otherwise(F.col("url")).alias("title"), F.concat(F.lit("why "), (k % 5).cast("string")).alias("reason"),
        F.concat(F.lpad((k % 60).cast("string"), 2, "0"), F.lit(".10")).alias("fgroup"), F.concat_ws("/", (k % 12 + 1).cast("string"), (k % 28 + 1).cast("string"), F.lit("2024")).alias("date"), validity.alias("validity"),
        F.when(k % 4 != 0, _id("f", k)).alias("fileId"), (k % 1000).alias("size"), (k % 6 == 0).alias("star"), F.concat(F.lit("see "), number(k * 3 % 60), F.lit(" and "), number(k % 40), F.lit(", again "), number(k * 3 % 60)).alias("text"), F.lit(1).cast("long").alias("rev"),
    )


def tools(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return t(spark, sf_dir, "part").select(
        _id("t", k).alias("id"), F.lit("").alias("no"), F.concat(F.lit("000 589 "), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" 63 00")).alias("toolNo"), F.col("p_name").alias("desc"), F.concat_ws("/", F.col("p_brand"), (F.col("p_size") % 60).cast("string"), (F.col("p_size") % 7).cast("string")).alias("svcGrp"), F.col("p_type").alias("ct"),
        F.lit("").alias("note"), F.lit("").alias("comment"), F.lit("").alias("location"), F.col("p_retailprice").alias("price"), (k % 5 == 0).alias("star"), (k % 4 == 0).alias("offered"), F.when(k % 3 == 0, "p").alias("photo"), F.array(F.concat(F.lit("for "), (F.col("p_size") % 50 + 200).cast("string"), F.lit(" only"))).alias("validities"), k.alias("k"),
    )


def ros(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    lines = F.array(F.struct(F.concat(F.lit("job "), (k % 17).cast("string")).alias("text"), F.lit("54").alias("op")))
    return t(spark, sf_dir, "orders").select(k.alias("k"), _id("r", k).alias("id"), F.concat(F.lit("RO "), (k % 900).cast("string")).alias("ro"), code(F.col("o_custkey") % 50).alias("vin"), F.col("o_orderstatus").alias("advisor"), F.concat(F.lit("ticket "), k.cast("string")).alias("tag"), F.when(k % 9 == 0, 1).alias("deletedAt"), (k * 11 % 5000).alias("updatedAt"), lines.alias("lines"), *[F.lit("").alias(c) for c in ("vehicle", "customer", "phone", "email", "scanText")])


def links(spark, sf_dir) -> DataFrame:
    n, p = F.col("l_linenumber") % 3 == 0, F.col("l_partkey")
    return t(spark, sf_dir, "lineitem").select(F.lit("ro").alias("fromType"), _id("r", F.col("l_orderkey")).alias("fromId"), F.when(n, "document").otherwise("file").alias("toType"), F.when(n, _id("d", p)).otherwise(_id("f", p)).alias("toId"), F.when(n, "reference").otherwise("attachment").alias("kind"), F.lit(None).cast("string").alias("li"), F.lit(None).cast("string").alias("ver"))


def blobs(spark, sf_dir) -> DataFrame:
    """Bytes of the files that hold their own; every eleventh is lost."""
    k = F.col("doc_id")
    return t(spark, sf_dir, "documents").where("doc_id % 9 <> 1 and doc_id % 11 <> 0").select(_id("f", k).alias("id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("blob"), F.sha2("text", 256).alias("sha256"))


def thumbs(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(_id("f", F.col("doc_id")).alias("id"), F.col("source").alias("blob"))


def vehicles(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return t(spark, sf_dir, "customer").select(code(k).alias("vin"), code(k + 7).alias("fin"), (k % 900 + 100).cast("string").alias("series"))


VEHICLES = f"vehicles AS (SELECT {VIN_SQL.format('c_custkey')} AS vin, {VIN_SQL.format('(c_custkey + 7)')} AS fin, c_custkey % 900 + 100 AS series FROM customer)"
BLOBS = "blobs AS (SELECT 'f' || doc_id AS id, sha256(text) AS sha256, text FROM documents WHERE doc_id % 9 <> 1 AND doc_id % 11 <> 0)"


# --- scans and views


@query(f"WITH {FILES} SELECT id, name, size FROM files WHERE id = 'f7'")
def point_get(spark, sf_dir):
    return scans.point(files(spark, sf_dir), "f7").select("id", "name", "size")


@query(f"WITH {FILES} SELECT w.pos, w.wanted, f.size FROM (VALUES (0, 'f9'), (1, 'none'), (2, 'f3'), (3, 'f9')) w(pos, wanted) LEFT JOIN files f ON f.id = w.wanted")
def multi_get(spark, sf_dir):
    return relations.multi_get(files(spark, sf_dir), ["f9", "none", "f3", "f9"]).select("pos", "wanted", "size")


@query(f"WITH {ROS} SELECT id FROM ros ORDER BY id")
def key_list(spark, sf_dir):
    return scans.keys(ros(spark, sf_dir))


@query(f"WITH {FILES} SELECT id, deletedAt, 'any' AS asked FROM files WHERE deletedAt IS NOT NULL UNION ALL SELECT id, deletedAt, 'one' FROM files WHERE deletedAt = 20")
def index_scan(spark, sf_dir):
    """An index read with a value, and without one: then every row that has the field."""
    f = files(spark, sf_dir)
    return scans.list_by(f, "deletedAt").select("id", "deletedAt", F.lit("any").alias("asked")).union(scans.list_by(f, "deletedAt", 20).select("id", "deletedAt", F.lit("one")))


@query(f"WITH {FILES} SELECT (SELECT count(*) FROM files WHERE kind = 'pdf') AS pdfs, (SELECT count(*) FROM files) AS n")
def index_count(spark, sf_dir):
    f = files(spark, sf_dir)
    return scans.count_by(f, "kind", "pdf").withColumnRenamed("n", "pdfs").crossJoin(scans.count_by(f, "kind"))


@query(f"WITH {FILES} SELECT id FROM files WHERE list_contains(vins, {VIN_SQL.format('7')})")
def member_scan(spark, sf_dir):
    return scans.member(files(spark, sf_dir), "vins", "w1k107471a0000007").select("id")


@query(f"WITH {LINKS} SELECT fromId, toId, count(*) AS n FROM links WHERE toType = 'document' AND kind = 'reference' GROUP BY 1, 2")
def edge_scan(spark, sf_dir):
    return relations.edges(links(spark, sf_dir), "ro", "document", "reference").groupBy("fromId", "toId").agg(F.count("*").alias("n"))


@query(f"WITH {FILES} SELECT f.id, d.source AS thumb FROM files f LEFT JOIN documents d ON d.doc_id = f.k AND d.doc_id % 2 = 0 WHERE f.deletedAt IS NULL AND f.inFiles = 1")
def files_with_preview(spark, sf_dir):
    return relations.with_preview(files(spark, sf_dir), thumbs(spark, sf_dir), in_files=1).select("id", "thumb")


@query(f"""WITH {FILES}, {LINKS},
v AS (
  SELECT 'starred' AS v, id FROM files WHERE deletedAt IS NULL AND starred
  UNION ALL SELECT 'kind', id FROM files WHERE deletedAt IS NULL AND kind = 'pdf'
  UNION ALL SELECT 'collection', id FROM files WHERE deletedAt IS NULL AND collection = ''
  UNION ALL SELECT 'trash', id FROM files WHERE deletedAt IS NOT NULL
  UNION ALL SELECT 'vin', id FROM files WHERE deletedAt IS NULL AND list_contains(vins, {VIN_SQL.format('7')})
  UNION ALL SELECT 'vins', id FROM files WHERE deletedAt IS NULL AND len(vins) > 0
  UNION ALL SELECT 'tag', id FROM files WHERE deletedAt IS NULL AND list_contains(tags, {NUMBER_SQL.format('5')})
  UNION ALL SELECT 'query', id FROM files WHERE deletedAt IS NULL AND contains(lower(concat_ws(' ', name, collection, '', array_to_string(tags, ' '), array_to_string(vins, ' '), array_to_string(fins, ' '))), '-12.txt')
  UNION ALL SELECT 'ro', id FROM files WHERE deletedAt IS NULL AND id IN (SELECT toId FROM links WHERE fromId = 'r1' AND toType = 'file')
  UNION ALL SELECT 'recent', id FROM (SELECT id FROM files WHERE deletedAt IS NULL ORDER BY updatedAt DESC, id LIMIT 40))
SELECT v, id FROM v""")
def files_view(spark, sf_dir):
    f = files(spark, sf_dir)
    seen = {"starred": {"starred": True}, "kind": {"kind": "pdf"}, "collection": {"collection": ""}, "trash": {"trash": "only"}, "vin": {"vin": "W1K107471A0000007"}, "vins": {"any_vin": True}, "tag": {"tag": "LI15.10-P-000005"}, "query": {"query": "-12.TXT"}}
    seen |= {"ro": {"only": relations.attachments(links(spark, sf_dir), f).where("roId = 'r1'").select("id")}, "recent": {"recent": 40}}
    out = None
    for name, options in seen.items():
        rows = scans.files_view(f, **options).select(F.lit(name).alias("v"), "id")
        out = rows if out is None else out.union(rows)
    return out


_GROUPED = f"""WITH {PAPERS},
r AS (SELECT *, row_number() OVER (PARTITION BY li ORDER BY (k % 7) DESC, id) AS rank FROM papers),
g AS (SELECT li, min(id) AS first_id, count(*) AS n, bool_or(star) AS starred, max(CASE WHEN rank = 1 THEN id END) AS head, bool_or(rank = 1 AND title = '') AS review, bool_or(fgroup = '07.10') AS in07, bool_or(list_contains(models, 213)) AS m213, bool_or(contains(reason, 'why 3')) AS why3 FROM r GROUP BY li)"""


@query(_GROUPED + " SELECT 'li:' || li AS key, first_id, n, starred, review AS \"needsReview\", head FROM g")
def version_groups(spark, sf_dir):
    g = facets.version_groups(papers(spark, sf_dir))
    return g.select("key", "first_id", F.size("versions").cast("long").alias("n"), "starred", "needsReview", F.col("versions")[0]["id"].alias("head"))


@query(_GROUPED + """ SELECT 'starred' AS v, 'li:' || li AS key FROM g WHERE starred UNION ALL SELECT 'review', 'li:' || li FROM g WHERE review UNION ALL SELECT 'fgroup', 'li:' || li FROM g WHERE in07
UNION ALL SELECT 'model', 'li:' || li FROM g WHERE m213 UNION ALL SELECT 'query', 'li:' || li FROM g WHERE why3""")
def documents_view(spark, sf_dir):
    g = papers(spark, sf_dir)
    seen = {"starred": {"starred": True}, "review": {"review": True}, "fgroup": {"fgroup": "07.10"}, "model": {"model": "213"}, "query": {"query": "WHY 3"}}
    out = None
    for name, options in seen.items():
        rows = scans.documents_view(g, **options).select(F.lit(name).alias("v"), "key")
        out = rows if out is None else out.union(rows)
    return out


@query(f"""WITH {CATALOGUE}
SELECT 'offered' AS v, id FROM tools WHERE offered AND star UNION ALL SELECT 'model', id FROM tools WHERE series = 213
UNION ALL SELECT 'group', id FROM tools WHERE g1 = 5 OR g2 = 5 UNION ALL SELECT 'query', id FROM tools WHERE contains(lower(toolNo || ' ' || "desc"), '589 07')
UNION ALL SELECT 'exact', id FROM tools WHERE ct = (SELECT min(p_type) FROM part)""")
def tools_view(spark, sf_dir):
    x = tools(spark, sf_dir)
    first = x.agg(F.min("ct")).scalar()
    seen = {"offered": {"offered": True, "starred": True}, "model": {"model": "213"}, "group": {"group": "5"}, "query": {"query": "589 07"}, "exact": {"exact": {"ct": first}}}
    out = None
    for name, options in seen.items():
        rows = scans.tools_view(x, **options).select(F.lit(name).alias("v"), "id")
        out = rows if out is None else out.union(rows)
    return out


@query(f"WITH {FILES} SELECT CASE WHEN deletedAt IS NULL THEN 'live' ELSE 'trash' END AS part, count(*) AS n FROM files GROUP BY 1")
def live_and_trash(spark, sf_dir):
    f = files(spark, sf_dir)
    return lifecycle.store_counts({"live": relations.live(f), "trash": relations.trashed(f)}).withColumnRenamed("store", "part")


@query("SELECT s_name AS key FROM supplier WHERE starts_with(s_name, 'Supplier#00000000') ORDER BY 1")
def settings_prefix(spark, sf_dir):
    return scans.settings_of(t(spark, sf_dir, "supplier").select(F.col("s_name").alias("key")), "Supplier#00000000")


@query(f"WITH {FILES} SELECT 'open' AS v, id FROM files WHERE kind <> 'video' AND vinScan = 0 UNION ALL SELECT 'forced', id FROM files WHERE kind <> 'video'")
def scan_eligible(spark, sf_dir):
    f = files(spark, sf_dir)
    return scans.to_scan(f).select(F.lit("open").alias("v"), "id").union(scans.to_scan(f, force=True).select(F.lit("forced"), "id"))


@query("SELECT n_nationkey FROM nation WHERE contains(lower(n_name), '_1') OR contains(n_nationkey::VARCHAR, '_1') OR contains(n_regionkey::VARCHAR, '_1')")
def any_column_search(spark, sf_dir):
    from dossier.sources import csvs

    return csvs.any_column_has(t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "_1").select("n_nationkey")


# --- joins


@query(f"WITH {FILES}, {BLOBS} SELECT f.id, b.sha256, octet_length(encode(b.text))::BIGINT AS n, d.source AS thumb FROM files f LEFT JOIN blobs b ON b.id = coalesce(f.blobId, f.id) LEFT JOIN documents d ON d.doc_id = f.k AND d.doc_id % 2 = 0")
def files_with_bytes(spark, sf_dir):
    out = relations.with_bytes(files(spark, sf_dir), blobs(spark, sf_dir), thumbs(spark, sf_dir))
    return out.select("id", "sha256", F.octet_length("blob").cast("long").alias("n"), "thumb")


@query(f"WITH {FILES}, {LINKS} SELECT fromId AS roId, f.id, count(*) AS n FROM links JOIN files f ON f.id = toId WHERE links.kind = 'attachment' AND f.deletedAt IS NULL GROUP BY 1, 2")
def order_attachments(spark, sf_dir):
    return relations.attachments(links(spark, sf_dir), files(spark, sf_dir)).groupBy("roId", "id").agg(F.count("*").alias("n"))


@query(f"WITH {ROS}, {LINKS} SELECT toId AS fileId, r.id, count(*) AS n FROM links JOIN ros r ON r.id = fromId WHERE toType = 'file' AND r.deletedAt IS NULL GROUP BY 1, 2")
def file_orders(spark, sf_dir):
    return relations.orders_of_files(links(spark, sf_dir), ros(spark, sf_dir)).groupBy("fileId", "id").agg(F.count("*").alias("n"))


@query(f"""WITH {PAPERS}, {LINKS},
latest AS (SELECT li, id, k % 7 AS v FROM papers QUALIFY row_number() OVER (PARTITION BY li ORDER BY k % 7 DESC, id) = 1)
SELECT fromId AS roId, toId, p.ver, l.id AS latestId, coalesce(l.v > p.k % 7, false) AS newer, count(*) AS n
FROM links LEFT JOIN papers p ON p.id = toId LEFT JOIN latest l ON l.li = p.li WHERE kind = 'reference' GROUP BY ALL""")
def order_references(spark, sf_dir):
    """Pinned documents of orders and the newest version of each; pins to documents that are gone stay, without either."""
    return relations.references(links(spark, sf_dir), papers(spark, sf_dir)).groupBy("roId", "toId", "ver", "latestId", "newer").agg(F.count("*").alias("n"))


@query(f"WITH {FILES}, {BLOBS} SELECT f.id FROM files f JOIN blobs b ON b.id = coalesce(f.blobId, f.id) WHERE b.sha256 = (SELECT sha256(text) FROM documents WHERE doc_id = 3)")
def content_holders(spark, sf_dir):
    wanted = t(spark, sf_dir, "documents").where("doc_id = 3").select(F.sha2("text", 256)).scalar()
    return relations.holders_of(blobs(spark, sf_dir), files(spark, sf_dir), wanted).select("id")


@query(f"WITH {CATALOGUE}, {VEHICLES} SELECT DISTINCT vin, id FROM vehicles v JOIN tools USING (series)")
def vehicle_tools(spark, sf_dir):
    return relations.vehicle_tools(vehicles(spark, sf_dir), tools(spark, sf_dir))


@query(f"WITH {PAPERS}, {VEHICLES} SELECT DISTINCT vin, id FROM vehicles JOIN papers ON list_contains(models, series)")
def vehicle_documents(spark, sf_dir):
    return relations.vehicle_documents(vehicles(spark, sf_dir), papers(spark, sf_dir))


@query(f"""WITH {FILES}, {ROS}, {VEHICLES},
f AS (SELECT vin, id, row_number() OVER (PARTITION BY vin ORDER BY updatedAt DESC, id) AS k FROM (SELECT unnest(vins) AS vin, id, updatedAt FROM files WHERE deletedAt IS NULL AND inFiles = 1)),
r AS (SELECT vin, id, row_number() OVER (PARTITION BY vin ORDER BY updatedAt DESC, id) AS k FROM ros WHERE deletedAt IS NULL),
nf AS (SELECT vin, count(*) AS n, string_agg(id, ',' ORDER BY k) FILTER (WHERE k <= 8) AS ids FROM f GROUP BY 1), nr AS (SELECT vin, count(*) AS n, string_agg(id, ',' ORDER BY k) FILTER (WHERE k <= 8) AS ids FROM r GROUP BY 1),
{PAPERS}, {CATALOGUE},
nd AS (SELECT vin, count(DISTINCT id) AS n FROM vehicles JOIN papers ON list_contains(models, series) GROUP BY 1), nt AS (SELECT vin, count(DISTINCT id) AS n FROM vehicles JOIN tools USING (series) GROUP BY 1)
SELECT v.vin, coalesce(nf.n, 0) AS n_files, coalesce(nf.ids, '') AS files, coalesce(nr.n, 0) AS n_ros, coalesce(nr.ids, '') AS ros, coalesce(nd.n, 0) AS n_documents, coalesce(nt.n, 0) AS n_tools
FROM vehicles v LEFT JOIN nf USING (vin) LEFT JOIN nr USING (vin) LEFT JOIN nd USING (vin) LEFT JOIN nt USING (vin)""")
def vehicle_summary(spark, sf_dir):
    """Everything about each vehicle: four counts and the first eight files and orders."""
    out = relations.vehicle_summary(vehicles(spark, sf_dir), files(spark, sf_dir), ros(spark, sf_dir), papers(spark, sf_dir), tools(spark, sf_dir))
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return out.select("vin", "n_files", listed("files"), "n_ros", listed("ros"), "n_documents", "n_tools")


@query(f"""WITH {PAPERS}, known AS (SELECT DISTINCT li FROM papers), c AS (SELECT id, li, {NUMBER_SQL.format('cites')} AS number FROM papers)
SELECT c.id, CASE WHEN c.number = c.li THEN 9 ELSE 0 END AS pos, c.number, k.li IS NOT NULL AS have FROM c LEFT JOIN known k ON k.li = c.number WHERE c.number <> c.li""")
def cited_documents(spark, sf_dir):
    return relations.cited(papers(spark, sf_dir))


_GROUP_SQL = "CASE WHEN p.k % 60 = 0 THEN '10' ELSE lpad((p.k % 60)::VARCHAR, 2, '0') END"


@query(f"WITH {PAPERS}, {CATALOGUE} SELECT DISTINCT p.id AS docId, x.id AS toolId FROM papers p JOIN tools x ON {_GROUP_SQL} IN (x.g1::VARCHAR, x.g2::VARCHAR)")
def document_tools(spark, sf_dir):
    return relations.document_tools(papers(spark, sf_dir), tools(spark, sf_dir))


@query(f"WITH {PAPERS}, {CATALOGUE} SELECT x.id AS toolId, p.id AS docId FROM tools x JOIN papers p ON {_GROUP_SQL} = regexp_extract(x.svcGrp0 || '/' || x.g1 || '/' || x.g2, '[0-9][0-9]')")
def tool_documents(spark, sf_dir):
    return relations.tool_documents(tools(spark, sf_dir), papers(spark, sf_dir))


@query(f"WITH {FILES}, {PAPERS} SELECT f.id AS fileId, p.id AS docId FROM files f JOIN papers p ON p.li = {NUMBER_SQL.format('(f.k % 40)')} WHERE f.k % 5 = 0")
def tagged_documents(spark, sf_dir):
    return relations.tag_documents(files(spark, sf_dir), papers(spark, sf_dir))


@query(f"WITH {FILES}, {PAPERS} SELECT id FROM files WHERE id NOT IN (SELECT fileId FROM papers WHERE fileId IS NOT NULL)")
def orphan_files(spark, sf_dir):
    return relations.orphans(files(spark, sf_dir), papers(spark, sf_dir)).select("id")


@query(f"WITH {FILES}, {BLOBS} SELECT id FROM files WHERE coalesce(blobId, id) NOT IN (SELECT id FROM blobs)")
def files_without_bytes(spark, sf_dir):
    return relations.without_bytes(files(spark, sf_dir), blobs(spark, sf_dir)).select("id")


@query(f"""WITH {ROS}, {LINKS}, mine AS (SELECT DISTINCT toId FROM links WHERE toType = 'file' AND fromId = 'r1')
SELECT toId AS fileId, CASE WHEN toId IN (SELECT toId FROM links JOIN ros r ON r.id = fromId WHERE toType = 'file' AND fromId <> 'r1' AND r.deletedAt IS NULL) THEN 'keep' ELSE 'trash' END AS action FROM mine""")
def order_trash(spark, sf_dir):
    return lifecycle.order_trash_plan(links(spark, sf_dir), ros(spark, sf_dir), "r1", "trash")


@query(f"WITH {FILES} SELECT id FROM files WHERE trashedWith = 'r12'")
def trashed_with(spark, sf_dir):
    return lifecycle.trashed_with(files(spark, sf_dir), "r12").select("id")


@query(f"""WITH {FILES}, {ROS}, {LINKS} SELECT r.id AS roId, f.id AS fileId, CASE WHEN len(f.vins) = 0 THEN 'noVin' WHEN list_contains(f.vins, r.vin) THEN 'match' ELSE 'mismatch' END AS verdict, count(*) AS n
FROM links JOIN ros r ON r.id = fromId JOIN files f ON f.id = toId WHERE links.kind = 'attachment' GROUP BY ALL""")
def vin_verdicts(spark, sf_dir):
    f = relations.attachments(links(spark, sf_dir), files(spark, sf_dir), "with").select("roId", F.col("id").alias("fileId"), "vins")
    r = ros(spark, sf_dir).select(F.col("id").alias("roId"), "vin")
    return f.join(r, "roId").groupBy("roId", "fileId", relations.vin_verdict(F.col("vin"), F.col("vins")).alias("verdict")).agg(F.count("*").alias("n"))


# --- aggregates, implicit windows, orders, sets


@query(f"WITH {FILES} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM files) GROUP BY 1 ORDER BY n DESC, tag LIMIT 40")
def top_tags(spark, sf_dir):
    counts = facets.facet_counts(files(spark, sf_dir), tag=F.col("tags"))
    return facets.top_values(counts, "tag").select(F.col("value").alias("tag"), "n")


@query(f"WITH {CATALOGUE} SELECT count(*) AS n, count(*) FILTER (WHERE offered) AS offered, count(*) FILTER (WHERE pictured) AS with_photo FROM tools")
def inventory_totals(spark, sf_dir):
    return scans.inventory_totals(tools(spark, sf_dir))


@query(f"WITH {PAPERS} SELECT count(DISTINCT li) AS groups, count(*) AS files, sum(size)::BIGINT AS size FROM papers")
def documents_totals(spark, sf_dir):
    return scans.documents_totals(papers(spark, sf_dir))


@query(f"WITH {PAPERS} SELECT id, ver FROM papers QUALIFY row_number() OVER (PARTITION BY li ORDER BY k % 7 DESC, id) = 1")
def newest_versions(spark, sf_dir):
    return search.newest(papers(spark, sf_dir)).select("id", "ver")


@query(f"WITH {FILES} SELECT vin, count(*) AS n, substr(vin, 4, 3) AS series FROM (SELECT unnest(vins) AS vin FROM files) GROUP BY 1")
def files_by_vin(spark, sf_dir):
    return facets.by_vin(files(spark, sf_dir))


@query("""WITH r AS (SELECT o_custkey AS key, o_orderkey AS pos, 'W1K' || (o_orderkey % 3 + 200) || '471A000' || lpad((o_custkey % 7)::VARCHAR, 4, '0') AS vin FROM orders),
c AS (SELECT *, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2] AS w, list_transform(range(1, 18), lambda i: CASE WHEN regexp_matches(substr(vin, i, 1), '[0-9]') THEN substr(vin, i, 1)::INT ELSE CASE substr(vin, i, 1) WHEN 'W' THEN 6 WHEN 'K' THEN 2 WHEN 'A' THEN 1 END END) AS v FROM r),
s AS (SELECT key, pos, vin, list_sum(list_transform(range(1, 18), lambda i: v[i] * w[i])) % 11 AS m FROM c),
g AS (SELECT key, vin, count(*) AS n, min(pos) AS early, bool_or(substr(vin, 9, 1) = CASE WHEN m = 10 THEN 'X' ELSE m::INT::VARCHAR END) AS ok FROM s GROUP BY 1, 2)
SELECT key, vin FROM g QUALIFY row_number() OVER (PARTITION BY key ORDER BY ok DESC, CASE WHEN ok THEN early END NULLS LAST, n DESC, early) = 1""")
def vin_votes(spark, sf_dir):
    """Of several readings of each number the first valid one, else the one read most often."""
    k = F.col("o_orderkey")
    read = F.concat(F.lit("W1K"), (k % 3 + 200).cast("string"), F.lit("471A000"), F.lpad((F.col("o_custkey") % 7).cast("string"), 4, "0"))
    return relations.pick_vin(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), k.alias("pos"), read.alias("vin")))


@query("SELECT p_brand AS g, quantile_disc(p_size, 0.5) AS m, (list_sort(list(p_size)))[(count(*) // 2 + 1)::INT] AS median FROM part GROUP BY 1".replace("quantile_disc(p_size, 0.5) AS m, ", ""))
def upper_medians(spark, sf_dir):
    return facets.upper_median(t(spark, sf_dir, "part").withColumnRenamed("p_brand", "g"), "g", "p_size")


@query("""WITH m AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM (
  SELECT l_orderkey, l_linenumber, l_linenumber * 10 + l_partkey % 9 AS s, l_linenumber * 10 + l_partkey % 9 + l_suppkey % 8 + 1 AS e FROM lineitem))
SELECT l_orderkey, s, e, (sum(CASE WHEN s - reached > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM m""")
def row_islands(spark, sf_dir):
    """Rows of a page that stand together: a gap beyond everything above begins a new one."""
    s = F.col("l_linenumber") * 10 + F.col("l_partkey") % 9
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", s.alias("s"), (s + F.col("l_suppkey") % 8 + 1).alias("e"))
    return facets.islands(rows, "l_orderkey", "s", "e", F.lit(3))


@query("""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT source, doc_id, trim(regexp_replace(regexp_replace(lower(line), '\\d+', '#', 'g'), '\\s+', ' ', 'g')) AS signature FROM l)
SELECT source, signature, count(DISTINCT doc_id) AS pages FROM s WHERE length(regexp_replace(signature, '[^a-z]', '', 'g')) >= 4 GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2""")
def page_furniture(spark, sf_dir):
    """Lines that stand on two documents of a source or more, whatever their digits."""
    l = t(spark, sf_dir, "documents").select("source", "doc_id", F.explode(text.lines(F.col("text"))).alias("line"))
    return facets.furniture(l, "source", "doc_id", "line")


@query("""WITH r AS (SELECT o_custkey AS doc, o_orderkey AS page, 'status ' || o_orderstatus || ' at # ' AS sig, (o_orderkey % 5) * 0.03 AS ry FROM orders),
b AS (SELECT *, floor(ry * 40 + 0.5)::INT AS band FROM r)
SELECT DISTINCT a.doc, lower(trim(a.sig)) AS signature FROM b a JOIN b c ON a.doc = c.doc AND a.sig = c.sig AND a.page <> c.page AND abs(a.band - c.band) <= 1""")
def banded_furniture(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("page"), ((k % 5) * 0.03).alias("ry"), F.concat(F.lit("Status "), "o_orderstatus", F.lit(" at "), k.cast("string")).alias("text"))
    return facets.banded_furniture(rows)


@query("SELECT source, doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars)::BIGINT AS \"offset\" FROM documents")
def payload_offsets(spark, sf_dir):
    return facets.running_offsets(t(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars").select("source", "doc_id", F.col("offset").cast("long").alias("offset"))


@query(f"WITH {FILES} SELECT id, updatedAt FROM files ORDER BY updatedAt DESC, id LIMIT 40")
def recent_files(spark, sf_dir):
    return facets.recent(files(spark, sf_dir)).select("id", "updatedAt")


@query("SELECT count(*) AS n, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, count(*) FILTER (WHERE coalesce(text, '') = '') AS empty FROM documents")
def extract_totals(spark, sf_dir):
    return scans.extract_totals(t(spark, sf_dir, "documents").select(F.encode("text", "utf-8").alias("content")))


@query(f"""WITH {FILES}, s AS (
  SELECT 'size' AS by, id, row_number() OVER (ORDER BY size DESC, id) AS pos FROM files UNION ALL SELECT 'updated', id, row_number() OVER (ORDER BY updatedAt DESC, id) FROM files
  UNION ALL SELECT 'name', id, row_number() OVER (ORDER BY regexp_extract(name, '[0-9]+')::INT, k % 13, name, id) FROM files UNION ALL SELECT 'star', id, row_number() OVER (ORDER BY starred DESC, id) FROM files)
SELECT "by", id, pos FROM s WHERE pos <= 50""")
def file_orders_by_view(spark, sf_dir):
    """The first fifty rows of the view in each of its orders."""
    f = files(spark, sf_dir).withColumn("star", F.col("starred"))
    out = None
    for by in ("size", "updated", "name", "star"):
        rows = f.orderBy(*facets.sort_key(f, by)).limit(50).select(F.lit(by).alias("by"), "id", F.row_number().over(_all_rows(facets.sort_key(f, by))).cast("long").alias("pos"))
        out = rows if out is None else out.union(rows)
    return out


def _places(rows: DataFrame, by: str, key: str) -> DataFrame:
    """(by, key, pos): the place of every row in the order of its column __o."""
    return facets.ranked(rows, F.lit(by), "__o", "pos").select(F.lit(by).alias("by"), key, F.col("pos").cast("long").alias("pos"))


@query(_GROUPED + """, h AS (SELECT 'li:' || g.li AS key, starred, k % 7 AS ver, p.size, (2024 * 10000 + (k % 12 + 1) * 100 + k % 28 + 1) AS day, reason, fgroup FROM g JOIN papers p ON p.id = head)
SELECT 'star' AS by, key, row_number() OVER (ORDER BY starred DESC, key) AS pos FROM h UNION ALL SELECT 'ver', key, row_number() OVER (ORDER BY ver DESC, key) FROM h
UNION ALL SELECT 'size', key, row_number() OVER (ORDER BY size, key) FROM h UNION ALL SELECT 'date', key, row_number() OVER (ORDER BY day, key) FROM h
UNION ALL SELECT 'reason', key, row_number() OVER (ORDER BY reason, key) FROM h UNION ALL SELECT 'fgroup', key, row_number() OVER (ORDER BY fgroup, key) FROM h""")
def document_orders_by_view(spark, sf_dir):
    """The place of each version group in each order of the documents view."""
    g = facets.version_groups(papers(spark, sf_dir))
    orders = {by: facets.group_sort_key(by, by == "ver") for by in ("star", "ver", "size", "date", "reason", "fgroup")}
    return reduce(DataFrame.union, (_places(g.withColumn("__o", o), by, "key") for by, o in orders.items()))


@query(f"""WITH {CATALOGUE}
SELECT 'price' AS by, id, row_number() OVER (ORDER BY coalesce(price, -1), id) AS pos FROM tools
UNION ALL SELECT 'mixed', id, row_number() OVER (ORDER BY k % 3 = 0, CASE WHEN k % 3 = 0 THEN 0 ELSE k * 37 % 1000 END, CASE WHEN k % 3 = 0 THEN lower(ct) END, id) FROM tools""")
def tool_orders_by_view(spark, sf_dir):
    """The place of each tool by price, and by a column in which numbers and texts are mixed."""
    x = tools(spark, sf_dir)
    mixed = F.when(F.col("k") % 3 == 0, F.lower("ct")).otherwise((F.col("k") * 37 % 1000).cast("string"))
    by_price = _places(x.withColumn("__o", F.struct(F.coalesce("price", F.lit(-1.0)).alias("o"), F.col("id"))), "price", "id")
    return by_price.union(_places(x.withColumn("__o", F.struct(facets.mixed_sort_key(mixed).alias("o"), F.col("id"))), "mixed", "id"))



def _all_rows(order):
    """A window over all rows, which are fifty at most where it is used."""
    from pyspark.sql import Window

    return Window.orderBy(*order)


@query("SELECT p_partkey, [p_brand, p_type, 'x'] AS a FROM part".replace("[p_brand, p_type, 'x'] AS a", "p_brand || ',' || p_type || ',x' AS merged"))
def merged_values(spark, sf_dir):
    """New values before old ones, each once."""
    merged = facets.merge_values(F.array("p_brand", "p_type"), F.array(F.lit("x"), F.col("p_type"), F.col("p_brand")))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(merged, ",").alias("merged"))


@query("SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'target' ELSE 'source' END AS owner FROM supplier")
def carried_over(spark, sf_dir):
    """A union in which an id that is there already wins."""
    rows = t(spark, sf_dir, "supplier").select(_id("s", F.col("s_suppkey")).alias("id"))
    here = rows.where("cast(substring(id, 2) as long) % 2 = 0").withColumn("owner", F.lit("target"))
    return facets.carry_over(here, rows.withColumn("owner", F.lit("source")))


@query(f"WITH {FILES}, {LINKS} SELECT id, type, count(*) AS n FROM (SELECT toId AS id, 'ro' AS type FROM links WHERE toType = 'file' UNION ALL SELECT id, 'document' FROM files WHERE docId IS NOT NULL) GROUP BY 1, 2")
def link_blockers(spark, sf_dir):
    return lifecycle.blockers(files(spark, sf_dir), links(spark, sf_dir)).groupBy("id", "type").agg(F.count("*").alias("n"))


@query("SELECT 'e' || event_id AS id FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 1")
def not_queued(spark, sf_dir):
    """Candidates that no waiting job names."""
    e = t(spark, sf_dir, "events").select(_id("e", F.col("event_id")).alias("id"), "event_id")
    jobs = e.where("event_id % 3 = 0").select(F.lit("scan").alias("type"), F.when(F.col("event_id") % 2 == 0, "queued").otherwise("done").alias("state"), F.array("id").alias("inputIds"))
    return scans.not_queued(e.select("id"), jobs, "scan")
