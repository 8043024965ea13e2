"""Registry of the queries over the driver's tables and their DuckDB twins.

The tables stand in for the stores: orders for work orders, part for the tool catalogue, customer for vehicles, documents
and pages for files, lineitem for the edge table, events for jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions import calc, ids, text, vin
from dossier.operators import diff, facets, layout, lifecycle, relations, search
from dossier.sources import csvs
from dossier.steps import written
from dossier.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}
TOP = 8


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH lines AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1),
per AS (
  SELECT o_custkey, count(*) AS n_orders, sum(coalesce(n, 0))::BIGINT AS n_lines, sum(coalesce(qty, 0))::BIGINT AS quantity,
    array_to_string(list_slice(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC), 1, 8), ',') AS latest_orders
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_custkey, c_name, n_name AS nation, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines,
  coalesce(quantity, 0) AS quantity, coalesce(latest_orders, '') AS latest_orders
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN per ON c_custkey = o_custkey
""")
def customer_360(spark, sf_dir):
    """Everything about one customer: orders, lines, quantity and the eight latest orders."""
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
    orders = t(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = orders.groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"),
        F.sum(F.coalesce("n", F.lit(0))).alias("n_lines"),
        F.sum(F.coalesce("qty", F.lit(0.0))).cast("long").alias("quantity"),
    )
    # Map tasks keep TOP orders of a customer before anything is collected.
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    top = t(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey").withColumn("k", F.row_number().over(w)).where(F.col("k") <= TOP)
    latest = top.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")), asc=False).alias("latest"))
    per = per.join(latest.withColumnRenamed("o_custkey", "latest_of"), F.col("o_custkey").eqNullSafe(F.col("latest_of")))
    who = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return who.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey",
        "c_name",
        F.col("n_name").alias("nation"),
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("quantity", F.lit(0)).alias("quantity"),
        F.coalesce(F.array_join(F.transform("latest", lambda x: x["o_orderkey"].cast("string")), ","), F.lit("")).alias("latest_orders"),
    )


@query("""
SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE lang <> '' GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source <> '' GROUP BY 2
UNION ALL SELECT 'size', CASE WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 10000 THEN 'medium' ELSE 'large' END, count(*) FROM documents GROUP BY 2
""")
def facet_counts(spark, sf_dir):
    size = F.when(F.col("n_chars") < 1000, "small").when(F.col("n_chars") < 10000, "medium").otherwise("large")
    return facets.facet_counts(t(spark, sf_dir, "documents"), lang=F.col("lang"), source=F.col("source"), size=size)


@query("""
SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'on') ORDER BY n_chars DESC, doc_id LIMIT 5
""")
def search_documents_tokens(spark, sf_dir):
    df = t(spark, sf_dir, "documents").where(search.has_all(F.col("text"), search.tokens("The on")))
    return search.top(df.select("doc_id", "n_chars"), 5, F.col("n_chars").desc(), F.col("doc_id"))


@query("""
(SELECT 'customer' AS store, c_custkey::VARCHAR AS id, c_name AS title FROM customer WHERE contains(lower(c_name), '00') ORDER BY c_custkey LIMIT 5)
UNION ALL (SELECT 'part', p_partkey::VARCHAR, p_name FROM part WHERE contains(lower(p_name), '00') ORDER BY p_partkey LIMIT 5)
UNION ALL (SELECT 'supplier', s_suppkey::VARCHAR, s_name FROM supplier WHERE contains(lower(s_name), '00') ORDER BY s_suppkey LIMIT 5)
""")
def federated_search(spark, sf_dir):
    names = {"customer": ("c_custkey", "c_name"), "part": ("p_partkey", "p_name"), "supplier": ("s_suppkey", "s_name")}
    words = search.tokens("00")
    found = {s: search.top(t(spark, sf_dir, s).where(search.has_all(F.col(n), words)).select(F.col(k).alias("id"), n), 5, F.col("id")) for s, (k, n) in names.items()}
    return search.federated(found, {s: F.col(n) for s, (_, n) in names.items()})


@query("""
SELECT o_custkey, o_orderkey, n FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE k = 1
""")
def latest_version(spark, sf_dir):
    """The newest of each group: an arg-max with a total order, computed with map-side aggregation."""
    first = F.min(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("o"), "o_orderkey")).alias("top")
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(first, F.count("*").alias("n")).select("o_custkey", "top.o_orderkey", "n")


@query("""
SELECT sha256(text) AS sha256, min(doc_id) AS holder, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def exact_duplicates(spark, sf_dir):
    hashed = t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.min("doc_id").alias("holder"), F.count("*").alias("copies")).where("copies > 1")


def _as_files(docs: DataFrame) -> DataFrame:
    """Documents as file records: a tenth is trashed, a seventh belongs to a document."""
    id_ = lambda c: F.concat(F.lit("f"), c.cast("string"))
    return docs.select(id_(F.col("doc_id")).alias("id"), F.lit(None).cast("string").alias("blobId"), F.when(F.col("doc_id") % 10 == 0, F.col("doc_id")).alias("deletedAt"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("docId"))


@query("""
WITH held AS (SELECT sha256(text) AS sha, min((CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END, 'f' || doc_id)) AS h FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT 'n' || doc_id AS id, h[2] AS holder, CASE WHEN h IS NULL THEN 'new' ELSE 'reuse' END AS action, coalesce(h[1] = 1, false) AS revive
FROM documents LEFT JOIN held ON sha256(text) = sha WHERE doc_id % 3 <> 0
""".replace("h[2]", "struct_extract_at(h, 2)").replace("h[1]", "struct_extract_at(h, 1)"))
def intake_decisions(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").withColumn("sha256", F.sha2("text", 256))
    stored = docs.where("doc_id % 3 = 0")
    blobs = stored.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("id"), "sha256")
    incoming = docs.where("doc_id % 3 <> 0").select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("id"), "sha256")
    return lifecycle.intake_decisions(incoming, _as_files(stored), blobs, "reuse")


@query("""
SELECT 'order without lines' AS problem, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'line without part', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE l_partkey = p_partkey)
""")
def orphans_and_dangling(spark, sf_dir):
    o, l, p = (t(spark, sf_dir, n) for n in ("orders", "lineitem", "part"))
    lost = {
        "order without lines": o.join(l, o["o_orderkey"] == l["l_orderkey"], "left_anti"),
        "line without order": l.join(o, o["o_orderkey"] == l["l_orderkey"], "left_anti"),
        "line without part": l.join(p, l["l_partkey"] == p["p_partkey"], "left_anti"),
    }
    return lifecycle.store_counts(lost).withColumnRenamed("store", "problem")


@query("""
WITH refs AS (
  SELECT l_partkey AS k FROM lineitem UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 7 = 0)
SELECT 'p' || p_partkey AS id, count(k) = 0 AS purged, count(k) AS refs FROM part LEFT JOIN refs ON k = p_partkey GROUP BY 1
""")
def purge_guard(spark, sf_dir):
    """Catalogue rows in the trash: only those that no order line and no document names may go for good."""
    part = t(spark, sf_dir, "part")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    files = part.select(name("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, F.lit("d")).alias("docId"))
    links = t(spark, sf_dir, "lineitem").select(F.lit("ro").alias("fromType"), F.col("l_orderkey").cast("string").alias("fromId"), F.lit("file").alias("toType"), name("l_partkey").alias("toId"), F.lit("attachment").alias("kind"))
    return lifecycle.purge_plan(files, links, part.select(name("p_partkey").alias("id")))


@query("""
WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS k, doc_id % 4 = 0 AS gone FROM documents)
SELECT DISTINCT k AS id FROM f WHERE gone AND k NOT IN (SELECT k FROM f WHERE NOT gone) AND k NOT IN (SELECT doc_id FROM f WHERE NOT gone)
""")
def shared_blob_gc(spark, sf_dir):
    """Bytes that no remaining record holds or shares once every fourth document is gone."""
    docs = t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("k"))
    files = docs.join(first, "h").select(F.col("doc_id").alias("id"), F.when(F.col("k") != F.col("doc_id"), F.col("k")).alias("blobId"))
    return lifecycle.unused_blobs(files, first.select(F.col("k").alias("id")), files.where("id % 4 = 0").select("id"))


@query("""
WITH latest AS (SELECT o_custkey, max((o_orderdate, o_orderkey)) AS m FROM orders GROUP BY 1)
SELECT o.o_orderkey AS pinned, struct_extract_at(m, 2) AS latest, struct_extract_at(m, 1) > o.o_orderdate AS newer
FROM orders o JOIN latest USING (o_custkey)
""")
def pinned_vs_newest(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    latest = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return o.join(latest, "o_custkey").select(F.col("o_orderkey").alias("pinned"), F.col("m.o_orderkey").alias("latest"), (F.col("m.o_orderdate") > F.col("o_orderdate")).alias("newer"))


@query("""
SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY k ORDER BY o_orderdate, o_orderkey) AS holder FROM (SELECT *, upper(regexp_replace(o_orderstatus || ' ' || o_custkey, '\\s', '', 'g')) AS k FROM orders)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderdate, o_orderkey) > 1
""")
def unique_number_conflicts(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("number", F.concat_ws(" ", F.col("o_orderstatus"), F.col("o_custkey").cast("string")))
    return facets.number_conflicts(o, "number", "o_orderdate", "o_orderkey").select("o_orderkey", "holder")


@query("""
SELECT s.doc_id FROM documents s WHERE NOT EXISTS (
  SELECT 1 FROM documents k WHERE k.doc_id % 2 = 0 AND k.source || '-' || k.doc_id % 50 = s.source || '-' || s.doc_id % 50 AND k.n_chars = s.n_chars AND (k.doc_id % 3 = 0 OR k.doc_id = s.doc_id))
""")
def folder_sync_delta(spark, sf_dir):
    """Scanned files that are new or changed; a stored record without a time fits any time."""
    d = t(spark, sf_dir, "documents")
    row = d.select("doc_id", F.concat_ws("-", F.col("source"), (F.col("doc_id") % 50).cast("string")).alias("name"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    known = row.where("doc_id % 2 = 0").withColumn("mtime", F.when(F.col("doc_id") % 3 != 0, F.col("mtime")))
    return relations.new_or_changed(row, known).select("doc_id")


@query(r"""
SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[^\s]+'))::INT AS words, length(regexp_replace(text, '\s', '', 'g')) AS chars_no_space,
  CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10)))::INT END AS lines, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\s|$)')))::INT END AS sentences,
  len(list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda p: regexp_matches(p, '[^\s]')))::INT AS paragraphs, ceil(len(regexp_extract_all(text, '[^\s]+')) / 200)::INT AS reading_minutes FROM documents
""")
def text_stats(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", *[c.alias(name) for name, c in text.stats(F.col("text")).items()])


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(line), '\d+', '#', 'g'), '\s+', ' ', 'g')) AS signature FROM l)
SELECT signature, count(DISTINCT doc_id) AS docs FROM s WHERE length(regexp_replace(signature, '[^a-z]', '', 'g')) >= 4 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2
""")
def line_furniture(spark, sf_dir):
    """Lines on two documents or more: the table is one document here and its rows are the pages."""
    l = t(spark, sf_dir, "documents").select(F.lit(0).alias("doc"), "doc_id", F.explode(text.lines(F.col("text"))).alias("line"))
    return facets.furniture(l, "doc", "doc_id", "line").select("signature", F.col("pages").alias("docs"))


@query(r"""
SELECT doc_id, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS email,
  replace(regexp_extract(' ' || text || ' ', '[^0-9](\d{3}[-.]\d{3}[-.]\d{4})[^0-9]', 1), '.', '-') AS phone FROM documents
""")
def extract_contacts(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0).alias("email"), layout.phone(F.col("text")).alias("phone"))


@query(r"""
SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, regexp_replace(lower(p_name), '[ _-]+', '_', 'g') AS snake, upper(regexp_replace(lower(p_name), '[ _-]+', '_', 'g')) AS constant,
  translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') AS inverted FROM part
""")
def case_transforms(spark, sf_dir):
    c = F.col("p_name")
    return t(spark, sf_dir, "part").select("p_partkey", text.to_case(c, "upper").alias("up"), text.to_case(F.col("p_type"), "lower").alias("low"), text.to_case(c, "snake").alias("snake"), text.to_case(c, "constant").alias("constant"), text.to_case(c, "invert").alias("inverted"))


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(url, '[\\/:*?"<>|]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM pages
""")
def filename_sanitize(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", text.sanitize(F.col("url")).alias("name"))


#: Endings and types of files and the kind of each, as the rules have them (fixed values).
_ENDINGS = {"archive": "zip rar 7z gz tar bz2 xz", "document": "doc docx odt rtf pages", "spreadsheet": "xls xlsx ods csv numbers", "presentation": "ppt pptx odp key", "text": "txt md json xml yml py rs sql log ini html", "pdf": "pdf", "other": "bin exe step"}
_TYPES = {"image": "image/png image/webp", "video": "video/mp4", "audio": "audio/ogg", "pdf": "application/pdf", "text": "text/x-odd", "other": "application/octet-stream"}
_NAMED = [(f".{x}" if k % 2 else f".{x.upper()}", "", kind) for kind, xs in _ENDINGS.items() for k, x in enumerate(xs.split())] + [("", x, kind) for kind, xs in _TYPES.items() for x in xs.split()]


@query(f"""
WITH k(pos, ending, type, kind) AS (VALUES {", ".join(f"({pos}, '{e}', '{m}', '{k}')" for pos, (e, m, k) in enumerate(_NAMED))})
SELECT doc_id, kind FROM documents JOIN k ON pos = (doc_id * 31 + n_chars) % {len(_NAMED)}
""")
def kind_classify(spark, sf_dir):
    """The kind of each document under a name made from its source, with one of all endings, or a type."""
    at = ((F.col("doc_id") * 31 + F.col("n_chars")) % len(_NAMED)).cast("int")
    ending, mime = (F.get(F.array(*[F.lit(x[k]) for x in _NAMED]), at) for k in (0, 1))
    return t(spark, sf_dir, "documents").select("doc_id", search.classify_kind(mime, F.concat("source", ending)).alias("kind"))


@query("""
WITH v AS (SELECT c_custkey, 'W1K' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE '4' END || 'B' || (c_custkey % 10)::VARCHAR || substr('ABCDEFGHJK1234567890', 1 + (c_custkey % 20)::INT, 1) || 'A' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') AS vin FROM customer),
s AS (SELECT *, list_sum([
    ('12345678_12345_7_923456789'[ascii(substr(vin, i, 1)) - 64])::INT * [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2][i] for i in range(1, 18) if regexp_matches(substr(vin, i, 1), '[A-Z]')])
  + list_sum([substr(vin, i, 1)::INT * [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2][i] for i in range(1, 18) if regexp_matches(substr(vin, i, 1), '[0-9]')]) AS total FROM v)
SELECT c_custkey, vin, substr(vin, 9, 1) = CASE WHEN total % 11 = 10 THEN 'X' ELSE (total % 11)::INT::VARCHAR END AS check_ok, substr(vin, 4, 3) AS series,
  CASE WHEN regexp_matches(substr(vin, 10, 1), '[1-9]') THEN (2000 + substr(vin, 10, 1)::INT)::VARCHAR WHEN substr(vin, 10, 1) = '0' THEN ''
    ELSE ((CASE WHEN regexp_matches(substr(vin, 7, 1), '[A-Z]') THEN 2010 ELSE 1980 END) + strpos('ABCDEFGHJKLMNPRSTVWXY', substr(vin, 10, 1)) - 1)::VARCHAR END AS model_year FROM s
""")
def vin_checks(spark, sf_dir):
    k = F.col("c_custkey")
    code = F.concat(F.lit("W1K"), F.lpad((k % 1000).cast("string"), 3, "0"), F.when(k % 2 == 0, "A").otherwise("4"), F.lit("B"), (k % 10).cast("string"), F.substring(F.lit("ABCDEFGHJK1234567890"), (1 + k % 20).cast("int"), F.lit(1)), F.lit("A"), F.lpad((k % 1000000).cast("string"), 6, "0"))
    v = t(spark, sf_dir, "customer").select("c_custkey", code.alias("vin"))
    return v.select("c_custkey", "vin", vin.check_ok(F.col("vin")).alias("check_ok"), vin.series(F.col("vin")).alias("series"), vin.model_year(F.col("vin")).alias("model_year"))


_PLANTED = "coalesce(text, '') || ' ' || CASE doc_id % 3 WHEN 0 THEN 'VIN: ' WHEN 1 THEN 'Datenkarte ' ELSE '' END || 'W1N KM4GB9SF' || lpad((doc_id % 1000000)::VARCHAR, 6, '0') || ' end'"


@query(rf"""
WITH u AS (SELECT doc_id, regexp_replace(upper({_PLANTED}), '([^A-Z0-9])', '\1' || chr(1), 'g') AS u FROM documents),
m AS (SELECT doc_id, regexp_extract_all(u, '(?:^|[^A-Z0-9])([A-HJ-NPR-Z0-9](?:(?:[ \t\x{{A0}}]\x01){{0,2}}[A-HJ-NPR-Z0-9]){{16}})(?:$|[^A-Z0-9])', 1) AS hits,
  regexp_split_to_array(u, '(?:^|[^A-Z0-9])[A-HJ-NPR-Z0-9](?:(?:[ \t\x{{A0}}]\x01){{0,2}}[A-HJ-NPR-Z0-9]){{16}}(?:$|[^A-Z0-9])') AS between FROM u),
h AS (SELECT doc_id, unnest(range(1, len(hits) + 1)) AS k, hits, between FROM m),
v AS (SELECT doc_id, k, regexp_replace(hits[k], '[^A-Z0-9]', '', 'g') AS v, regexp_replace(right(replace(between[k], chr(1), ''), 16), '[^A-Z]', '', 'g') AS before FROM h),
p AS (SELECT *, CASE WHEN ends_with(before, 'VIN') THEN 3 WHEN regexp_matches(before, '(DATACARD|DATENKARTE|FGSTNR|FAHRGESTELLNR)$') THEN 2 ELSE 1 END AS tag FROM v
  WHERE substr(v, 1, 3) IN ('WDB', 'WDD', 'WDC', 'W1K', 'W1N', 'WDF', 'W1V', 'W1W', 'W1X', 'W1Y', 'WD3', 'WD4', 'WMX', 'WME', '4JG', '55S', '8AC', '9BM', 'MB1')
    AND length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 4 AND 15 AND NOT regexp_matches(v, '[A-Z]{{7}}') AND len(list_distinct(string_split(v, ''))) >= 6),
n AS (SELECT doc_id, v, min(k) AS k, max(tag) AS tag FROM p GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(k)) <= 25),
f AS (SELECT *, tag = 2 OR (tag = 1 AND bool_or(tag = 3) OVER (PARTITION BY doc_id) AND regexp_matches(substr(v, 4, 1), '[0-9]')) AS fin FROM n)
SELECT d.doc_id, coalesce(string_agg(v, ',' ORDER BY k) FILTER (WHERE NOT fin), '') AS vins, coalesce(string_agg(v, ',' ORDER BY k) FILTER (WHERE fin), '') AS fins FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY 1
""")
def vin_scan(spark, sf_dir):
    """Vehicle numbers of whole texts, with one put behind each, with labels and gaps."""
    k = F.col("doc_id")
    label = F.when(k % 3 == 0, "VIN: ").when(k % 3 == 1, "Datenkarte ").otherwise("")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), label, F.lit("W1N KM4GB9SF"), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit(" end"))
    return t(spark, sf_dir, "documents").select("doc_id", vin.find_vins(said).alias("f")).select("doc_id", F.array_join("f.vins", ",").alias("vins"), F.array_join("f.fins", ",").alias("fins"))


@query("""
SELECT o_orderkey, 'LI' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '.10-P-' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS number, (o_orderkey % 90 + 1)::VARCHAR AS version FROM orders
""")
def document_numbers(spark, sf_dir):
    """Numbers spelt with typographic hyphens and no-break spaces are found again, with their versions."""
    k = F.col("o_orderkey")
    spelt = F.concat(F.lit("Nr. LI"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(".10‑P‑"), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit("\u00a0V"), (k % 90 + 1).cast("string"), F.lit(" title"))
    rows = t(spark, sf_dir, "orders").select("o_orderkey", spelt.alias("x")).withColumn("number", ids.detect_number(F.col("x")))
    return rows.select("o_orderkey", "number", ids.detect_version(F.col("x"), F.col("number")).alias("version"))


@query("""
WITH s AS (SELECT DISTINCT unnest([lpad((p_size % 50 + 200)::VARCHAR, 3, '0'), (p_size % 7 + 300)::VARCHAR]) AS series, p_partkey FROM part)
SELECT c_custkey, count(*) AS n_parts FROM customer JOIN s ON series = (c_custkey % 400)::VARCHAR GROUP BY 1
""")
def validity_models_join(spark, sf_dir):
    """Vehicles and what is valid for their series: membership in a text list as an equi join."""
    validity = F.concat(F.lit("Model series "), (F.col("p_size") % 50 + 200).cast("string"), F.lit(", "), (F.col("p_size") % 7 + 300).cast("string"))
    docs = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), validity.alias("validity"))
    cars = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vin"), (F.col("c_custkey") % 400).cast("string").alias("series"))
    return relations.vehicle_document_counts(cars, docs).select(F.col("vin").alias("c_custkey"), F.col("n").alias("n_parts"))


@query("""
SELECT p_partkey, round(p_size::DOUBLE * 0.0254::DOUBLE / 0.01::DOUBLE, 6) AS cm, round(p_size::DOUBLE * 1.8::DOUBLE + 32, 6) AS fahrenheit, round(p_size::DOUBLE * 0.45359237::DOUBLE, 6) AS kg FROM part
""")
def unit_convert(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("value"))
    for name, category, a, b in (("cm", "length", "in", "cm"), ("fahrenheit", "temp", "°C", "°F"), ("kg", "mass", "lb", "kg")):
        p = calc.convert(p.withColumns({"category": F.lit(category), "from_unit": F.lit(a), "to_unit": F.lit(b)})).withColumn(name, F.round("converted", 6)).drop("category", "from_unit", "to_unit", "converted")
    return p.drop("value")


@query("""
SELECT p_partkey, p_retailprice * (p_size % 30) / 100 AS save, (p_retailprice - p_retailprice * (p_size % 30) / 100) * (1 + 7::DOUBLE / 100) AS with_tax,
  (p_retailprice - p_size::DOUBLE) / nullif(p_size, 0)::DOUBLE * 100 AS change FROM part
""")
def price_arithmetic(spark, sf_dir):
    d = calc.discount(F.col("p_retailprice"), F.col("p_size") % 30, F.lit(7))
    change = calc.percent_change(F.col("p_size").cast("double"), F.col("p_retailprice"))
    return t(spark, sf_dir, "part").select("p_partkey", d["save"].alias("save"), d["with_tax"].alias("with_tax"), change.alias("change"))


@query("""
SELECT p_brand, round(sum(p_size), 6)::DOUBLE AS series, round(1 / sum(1.0::DOUBLE / p_size), 6) AS parallel FROM part WHERE p_size > 0 GROUP BY 1
""")
def resistor_network(spark, sf_dir):
    r = F.col("p_size").cast("double")
    return t(spark, sf_dir, "part").where("p_size > 0").groupBy("p_brand").agg(F.round(calc.series_resistance(r), 6).alias("series"), F.round(calc.parallel_resistance(r), 6).alias("parallel"))


@query("""
SELECT o_custkey, o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4)::BIGINT AS part FROM orders
""")
def zip_partition_count(spark, sf_dir):
    return facets.parts_by_count(t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 4).select("o_custkey", "o_orderkey", "part")


@query("""
WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
p AS (
  SELECT source, doc_id, k, n_chars AS held, 0 AS part FROM o WHERE k = 1
  UNION ALL SELECT o.source, o.doc_id, o.k, CASE WHEN held > 0 AND held + n_chars > 20000 THEN n_chars ELSE held + n_chars END, CASE WHEN held > 0 AND held + n_chars > 20000 THEN part + 1 ELSE part END
  FROM p JOIN o ON o.source = p.source AND o.k = p.k + 1)
SELECT source, doc_id, part FROM p
""")
def zip_partition_size(spark, sf_dir):
    packed = facets.parts_by_size(t(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 20_000)
    return packed.select("source", F.col("order").alias("doc_id"), "part")


@query("""
SELECT CASE WHEN i.p_partkey IS NULL OR i.p_partkey % 2 = 0 THEN 't' || s.p_partkey ELSE 't' || s.p_partkey END AS id, s.p_name AS toolNo,
  CASE WHEN s.p_partkey % 3 = 0 AND s.p_partkey % 2 = 0 THEN 'new ' || s.p_brand ELSE s.p_brand END AS svcGrp FROM part s LEFT JOIN part i ON i.p_partkey = s.p_partkey
""")
def csv_upsert(spark, sf_dir):
    """Import over the catalogue: matched by id, values overwrite and blanks keep."""
    p = t(spark, sf_dir, "part")
    stored = p.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("toolNo"), F.col("p_brand").alias("svcGrp"))
    incoming = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("id"), F.lit("").alias("toolNo"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("new "), F.col("p_brand"))).otherwise(" ").alias("svcGrp"), F.col("p_partkey").alias("pos"))
    return lifecycle.upsert_tools(stored, incoming, ["toolNo", "svcGrp"])


@query("""
SELECT p_partkey, p_name || ',"' || p_type || ', ' || p_brand || '",' || p_size AS line FROM part
""")
def csv_lines(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return p.select("p_partkey", csvs.line(F.col("p_name"), F.concat_ws(", ", F.col("p_type"), F.col("p_brand")), F.col("p_size")).alias("line"))


def _as_jobs(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    state = F.when(k % 4 == 0, "running").when(k % 4 == 1, "done").otherwise("queued")
    return events.select(k.cast("string").alias("id"), F.col("event_type").alias("type"), state.alias("state"), (k % 6).cast("int").alias("attempts"), at.alias("createdAt"), at.alias("updatedAt"), at.alias("heartbeat"), F.when(k % 4 == 1, at).alias("finishedAt"), at.alias("startedAt"), F.lit("w0").alias("owner"))


NOW = 1_705_500_000_000
_JOBS = "SELECT event_id::VARCHAR AS id, event_type AS type, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'queued' END AS state, (event_id % 6)::INT AS attempts, epoch_ms(ts) AS at_ms FROM events"


@query(f"""
WITH j AS ({_JOBS}), r AS (SELECT *, row_number() OVER (PARTITION BY type, state = 'queued' ORDER BY at_ms, id) AS k FROM j)
SELECT id, attempts + 1 AS attempts FROM r WHERE state = 'queued' AND k = 1
""")
def job_claim(spark, sf_dir):
    claimed = jobs.claim(_as_jobs(t(spark, sf_dir, "events")), "me", NOW)
    return claimed.where("owner = 'me'").select("id", "attempts")


@query(f"""
WITH j AS ({_JOBS})
SELECT state, count(*) AS n FROM (SELECT CASE WHEN state = 'running' AND at_ms < {NOW} - 90000 THEN CASE WHEN attempts >= 5 THEN 'failed' ELSE 'queued' END ELSE state END AS state FROM j) GROUP BY 1
""")
def job_requeue_stale(spark, sf_dir):
    return jobs.requeue_stale(_as_jobs(t(spark, sf_dir, "events")), NOW).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""
WITH j AS ({_JOBS}) SELECT state, count(*) AS n FROM j WHERE NOT (state = 'done' AND at_ms < {NOW} - 86400000) GROUP BY 1
""")
def job_sweep(spark, sf_dir):
    return jobs.sweep(_as_jobs(t(spark, sf_dir, "events")), NOW).groupBy("state").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::INT AS value FROM orders
""")
def date_parse_val(spark, sf_dir):
    d = F.col("o_orderdate")
    written = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return t(spark, sf_dir, "orders").select("o_orderkey", calc.date_value(written).alias("value"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INT AS days, round(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) / 7, 6) AS weeks
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def date_diff(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = calc.date_difference(F.to_date("o_orderdate"), F.to_date("l_shipdate"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", d["total_days"].alias("days"), F.round(d["weeks"], 6).alias("weeks"))


def _near_copies(spark, sf_dir):
    """(doc_id, x, y): each text y and the first one, x, that has four fifths of their distinct lines in common."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = relations.alike(docs.select("doc_id", text.lines(F.col("text")).alias("lines")), "doc_id", "lines", 80)
    pairs = pairs.groupBy("b").agg(F.min("a").alias("a"))
    first, later = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), docs.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(first, "a").join(later, "b").select(F.col("b").alias("doc_id"), "x", "y")


@query()
def document_diff(spark, sf_dir):
    """Each text against its first near copy, line by line."""
    return diff.totals(diff.diff(_near_copies(spark, sf_dir), "x", "y")).select("doc_id", "removed", "added", "moved", "same")


@query()
def document_revisions(spark, sf_dir):
    """Each text against its first near copy, word by word between aligned lines."""
    told = diff.totals(diff.revisions(written(_near_copies(spark, sf_dir), "copies"), "doc_id", "x", "y"))
    return told.select("doc_id", F.size("runs").alias("n_runs"), "removed", "added", "moved", "same")


@query(r"""
SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_name, p_partkey
""")
def sorted_view(spark, sf_dir):
    """The whole catalogue in the order of its name column, where digit runs count as numbers."""
    p = t(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    return p.orderBy(*facets.sort_key(p, "name")).select("p_partkey", "p_name")


@query("""
SELECT doc_id, source, CASE WHEN k = 1 THEN lower(source) ELSE lower(source) || ' (' || k || ')' END AS unique_name FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(source) ORDER BY doc_id) AS k FROM documents)
""")
def unique_names(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "source", F.lower("source").alias("name"))
    return facets.unique_names(d, "name", "doc_id").select("doc_id", "source", "unique_name")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 GROUP BY 1, 2, 3
""")
def edge_traversal(spark, sf_dir):
    """Typed edges with a predicate on both ends; repeated edges are counted."""
    l = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45")
    return l.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("""
SELECT 'customer' AS store, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages
""")
def store_counts(spark, sf_dir):
    return lifecycle.store_counts({n: t(spark, sf_dir, n) for n in ("customer", "orders", "documents", "pages")})


@query("""
SELECT CASE WHEN l_returnflag IS NULL THEN 'all' ELSE l_returnflag END AS flag, CASE WHEN l_linestatus IS NULL THEN 'all' ELSE l_linestatus END AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def rollup_quantity(spark, sf_dir):
    """Extension: the reference has no rollup."""
    r = t(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return r.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity")


@query("""
SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2
""")
def tumbling_counts(spark, sf_dir):
    """Extension: events per type and day."""
    e = t(spark, sf_dir, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count("*").alias("n"))
    return e.select("event_type", F.to_date("w.start").alias("day"), "n")


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n FROM s GROUP BY 1, 2
""")
def sessionize_events(spark, sf_dir):
    """Extension: sessions of a user with gaps of thirty minutes or less."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(w)
    e = t(spark, sf_dir, "events").withColumn("new", F.when(gap <= 30 * 60 * 1_000_000, 0).otherwise(1))
    return e.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"))
