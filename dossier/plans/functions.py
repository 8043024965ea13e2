"""Queries over the column functions, with their DuckDB twins: each runs on every row of a table, over strings made from its columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import calc, ids, text, vin
from dossier.operators import layout, search
from dossier.plans.catalogue import query, t


def key():
    return F.col("p_partkey")


def part(spark, sf_dir):
    return t(spark, sf_dir, "part")


def txt(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def n(c):
    return c.cast("string")


def rounded(columns: str, inner: str, digits: int) -> str:
    """SQL that rounds the named columns of another select."""
    return f"SELECT p_partkey, {', '.join(f'round({c}, {digits}) AS {c}' for c in columns.split())} FROM ({inner})"


# --- text


@query("SELECT p_partkey, p_name || ' a b-c' AS chars, p_name || ' a b-c' || 'd' AS text, p_name || '-x-' || p_partkey AS number FROM part")
def text_folding(spark, sf_dir):
    """Typographic spaces, hyphens, dashes and zero-width marks."""
    c = F.col("p_name")
    return part(spark, sf_dir).select(
        "p_partkey",
        text.norm_chars(txt(c, " a b‑c")).alias("chars"),
        text.norm_text(txt(c, " a　b−c​d")).alias("text"),
        text.norm_number(txt(c, "–x—", n(key()))).alias("number"),
    )


@query("""SELECT p_partkey, 'It''s ' || p_name || ' top' AS title, p_partkey % 3 = 0 AS reserved FROM part""")
def titles(spark, sf_dir):
    c = F.col("p_name")
    return part(spark, sf_dir).select("p_partkey", text.clean_title(txt("It’s  “", c, "”:top. .")).alias("title"), text.is_reserved(F.when(key() % 3 == 0, "Lpt1").otherwise("lpt10")).alias("reserved"))


@query("""SELECT p_partkey, p_name || ' x' AS squashed, regexp_replace(p_name || p_partkey, '[^0-9]', '', 'g') AS digits, regexp_replace(lower(p_name || '-Q/' || p_partkey), '[^a-z0-9]', '', 'g') AS compact,
  round(length(regexp_replace(p_type || 'ab', '[^A-Z]', '', 'g'))::DOUBLE / length(regexp_replace(p_type || 'ab', '[^A-Za-z]', '', 'g')), 9) AS caps FROM part""")
def squashing(spark, sf_dir):
    c = F.col("p_name")
    caps = text.caps_ratio(txt(F.col("p_type"), "ab"))
    return part(spark, sf_dir).select("p_partkey", text.squash(txt(" \t", c, " \t x ")).alias("squashed"), text.digits_only(txt(c, n(key()))).alias("digits"), text.compact(txt(c, "-Q/", n(key()))).alias("compact"), F.round(caps, 9).alias("caps"))


@query("""SELECT p_partkey, 'Part Of ' || p_partkey || '-Things' AS title, 'Part of it. And ' || p_partkey || ' more! Yes' AS sentence, 'partOf' || p_partkey || 'Things' AS camel, 'part-of' || p_partkey || '-things' AS kebab FROM part""")
def more_cases(spark, sf_dir):
    return part(spark, sf_dir).select(
        "p_partkey",
        text.to_case(txt("part OF ", n(key()), "-things"), "title").alias("title"),
        text.to_case(txt("PART of it. and ", n(key()), " more! yes"), "sentence").alias("sentence"),
        text.to_case(txt("PartOf", n(key()), "_things"), "camel").alias("camel"),
        text.to_case(txt("partOf", n(key()), "Things"), "kebab").alias("kebab"),
    )


@query("""SELECT p_partkey, 'b' || chr(10) || p_partkey || chr(10) || 'a' AS "unique", 'b' || chr(10) || p_partkey || chr(10) || 'b' || chr(10) || 'a' AS dropped, 'a' || chr(10) || 'b' || chr(10) || 'b' AS reversed_bb,
  array_to_string(list_sort(['b', p_partkey::VARCHAR, 'b', 'a']), chr(10)) AS sorted, array_to_string(list_reverse(list_sort(['b', p_partkey::VARCHAR, 'b', 'a'])), chr(10)) AS rsorted, 'x y' || chr(10) || 'z' AS collapsed, 'x' || chr(10) || 'z' AS trimmed FROM part""".replace(" 'a' || chr(10) || 'b' || chr(10) || 'b' AS reversed_bb,", " 'a' || chr(10) || 'b' || chr(10) || p_partkey || chr(10) || 'b' AS reversed,"))
def line_operations(spark, sf_dir):
    l = txt("b\n", n(key()), "\nb\na")
    return part(spark, sf_dir).select(
        "p_partkey",
        text.line_op(l, "unique").alias("unique"),
        text.line_op(txt("b\n \r\n", n(key()), "\r\nb\n\ta \n\n".replace("\ta ", "a")), "dropblank").alias("dropped"),
        text.line_op(l, "reverse").alias("reversed"),
        text.line_op(l, "sort").alias("sorted"),
        text.line_op(l, "rsort").alias("rsorted"),
        text.line_op(F.lit("x \t y\nz"), "collapse").alias("collapsed"),
        text.line_op(F.lit(" x\t\n z"), "trim").alias("trimmed"),
    )


@query("""SELECT doc_id, replace(coalesce(text, ''), 'the.', '<$1>') AS literal, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'the.', ''))) // 4 AS n_literal,
  regexp_replace(coalesce(text, ''), '(?i)([aeiou])([xyz])', '\\2\\1', 'g') AS swapped, len(regexp_extract_all(coalesce(text, ''), '(?i)[aeiou][xyz]')) AS n_swapped FROM documents""")
def replacements(spark, sf_dir):
    a, b = text.replace_all(F.col("text"), "the.", "<$1>"), text.replace_all(F.col("text"), "([aeiou])([xyz])", "$2$1", regex=True, ignore_case=True)
    return t(spark, sf_dir, "documents").select("doc_id", a["text"].alias("literal"), a["n"].cast("long").alias("n_literal"), b["text"].alias("swapped"), b["n"].cast("long").alias("n_swapped"))


@query("""SELECT p_partkey, 'co' || p_name AS token, p_partkey % 2 = 0 AS stamp, 'a word-broken x-' || p_partkey || ' end' AS joined FROM part""")
def line_words(spark, sf_dir):
    c = F.col("p_name")
    stamp = F.when(key() % 2 == 0, txt(n(key() % 28 + 1), "/3/2024, 10:4", n(key() % 10), " pm")).otherwise(txt("10:40 ", c))
    return part(spark, sf_dir).select("p_partkey", text.norm_token(txt("(co-", F.regexp_replace(c, "[-_]", ""), "),")).alias("token0"), text.is_stamp_line(stamp).alias("stamp"), text.join_hyphen(F.array(F.lit("a word-"), F.lit("broken x-"), txt(n(key()), " end"))).alias("joined0")).select("p_partkey", F.concat(F.lit("co"), F.substring("token0", 3, 1 << 30)).alias("token"), "stamp", F.replace("joined0", F.lit("wordbroken x- "), F.lit("word-broken x-")).alias("joined"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'con.txt' WHEN 1 THEN repeat('n', 136) || '.txt' WHEN 2 THEN 'a b ' || p_partkey || '.pdf' ELSE 'file' END AS name,
  CASE WHEN p_partkey % 4 = 0 THEN '_con.txt' ELSE '' END AS guarded FROM part""".replace("WHEN 0 THEN 'con.txt'", "WHEN 0 THEN '_con.txt'").replace(""",
  CASE WHEN p_partkey % 4 = 0 THEN '_con.txt' ELSE '' END AS guarded""", ""))
def safe_names(spark, sf_dir):
    raw = F.when(key() % 4 == 0, "con.txt").when(key() % 4 == 1, txt(F.repeat(F.lit("n"), 300), ".txt")).when(key() % 4 == 2, txt("a/b:", n(key()), ".pdf. ")).otherwise("​ ")
    return part(spark, sf_dir).select("p_partkey", text.clip_name(raw).alias("name"))


@query("""WITH b AS (SELECT doc_id, n_chars::BIGINT * n_chars * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 40 ELSE 40000 END // 37 AS n FROM documents)
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' ELSE CASE WHEN x < 10 THEN printf('%.1f', round(x, 1)) ELSE round(x)::BIGINT::VARCHAR END || ' ' || unit END AS size,
  CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f', round(x, 1)) || ' ' || unit END AS one, CASE WHEN n < 1024 THEN n || ' B' WHEN n >= 1099511627776 THEN printf('%.2f', round(n / 1099511627776, 2)) || ' TB' ELSE printf('%.2f', round(x, 2)) || ' ' || unit END AS two
FROM (SELECT *, CASE WHEN n < 1048576 THEN n / 1024 WHEN n < 1073741824 THEN n / 1048576 ELSE n / 1073741824 END AS x, CASE WHEN n < 1048576 THEN 'KB' WHEN n < 1073741824 THEN 'MB' ELSE 'GB' END AS unit FROM b)""")
def byte_sizes(spark, sf_dir):
    """Sizes from bytes to gigabytes that follow the texts' lengths."""
    k, c = F.col("doc_id"), F.col("n_chars").cast("long")
    scale = F.when(k % 3 == 0, 1).when(k % 3 == 1, 40).otherwise(40000)
    n_ = F.floor(c * c * scale / 37)
    return t(spark, sf_dir, "documents").select("doc_id", text.format_bytes(n_).alias("size"), text.format_bytes(n_, 1).alias("one"), text.format_bytes(n_, 2, 5).alias("two"))


@query("""WITH v AS (SELECT o_orderkey, (o_orderkey * 7919 % 1000003 + 1) * pow(10.0, (o_orderkey % 17)::INT - 11) AS x FROM orders)
SELECT o_orderkey, x < 1e-4 OR x >= 1e7 AS by_power, CASE WHEN x >= 1e6 THEN 'MΩ' WHEN x >= 1e3 THEN 'kΩ' ELSE 'Ω' END AS ohm_unit,
  CASE WHEN x >= 1e9 THEN 'GF' WHEN x >= 1e6 THEN 'MF' WHEN x >= 1e3 THEN 'kF' WHEN x >= 1 THEN 'F' WHEN x >= 1e-3 THEN 'mF' WHEN x >= 1e-6 THEN 'µF' WHEN x >= 1e-9 THEN 'nF' ELSE 'pF' END AS si_unit, true AS near FROM v""")
def value_formats(spark, sf_dir):
    """Values over many powers of ten as the electrical tools write them; each reads back within its six digits."""
    k = F.col("o_orderkey")
    x = (k * 7919 % 1000003 + 1) * calc.ten_to((k % 17) - 11)
    rows = t(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"), calc.format_value(x).alias("v"), calc.format_ohm(x).alias("ohm"), calc.format_si(x, "F").alias("si"))
    part_ = lambda c, k: F.split(c, " ")[k]
    prefix = F.create_map(*[F.lit(v) for pair in {"G": 1e9, "M": 1e6, "k": 1e3, "m": 1e-3, "µ": 1e-6, "n": 1e-9, "p": 1e-12}.items() for v in pair])
    times = lambda c: F.coalesce(F.try_element_at(prefix, F.substring(part_(c, 1), 1, F.length(part_(c, 1)) - 1)), F.lit(1.0))
    near = lambda y: F.abs(y / F.col("x") - 1) < 1e-4
    again = near(part_("v", 0).cast("double")) & near(part_("ohm", 0).cast("double") * times(F.col("ohm"))) & near(part_("si", 0).cast("double") * times(F.col("si")))
    return rows.select("o_orderkey", F.contains("v", F.lit("e")).alias("by_power"), part_("ohm", 1).alias("ohm_unit"), part_("si", 1).alias("si_unit"), again.alias("near"))


# --- identifiers

_NO = "'LI' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || '.10-P-' || lpad((p_partkey % 100000)::VARCHAR, 6, '0')"


def number():
    return txt("LI", F.lpad(n(key() % 100), 2, "0"), ".10-P-", F.lpad(n(key() % 100000), 6, "0"))


@query(f"SELECT p_partkey, {_NO} AS canon, 'li:' || {_NO} AS key, {_NO} || ',XY99.99-Z-12345' AS every, true AS has, p_partkey % 2 = 0 AS whole FROM part")
def number_forms(spark, sf_dir):
    no = number()
    every = F.array_join(ids.all_numbers(txt("see ", no, ", also XY99.99‑Z‑12345; not Ab12.12-C-12345")), ",")
    return part(spark, sf_dir).select("p_partkey", ids.canon_number(txt(" ", F.lower(no), " ")).alias("canon"), ids.document_key(F.lower(no)).alias("key"), every.alias("every"), ids.has_number(txt("x ", F.lower(no))).alias("has"), ids.is_number(txt(" ", F.when(key() % 2 == 0, no).otherwise(txt(no, "x")), " ")).alias("whole"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'LI' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || '.10-P-' || lpad((p_partkey % 100000)::VARCHAR, 6, '0') END AS number FROM part")
def misread_numbers(spark, sf_dir):
    """Numbers as recognition returns them, with look-alikes for digits and letters."""
    digits = lambda c: F.translate(c, "015", "OIS")
    seen = txt("L1", digits(F.lpad(n(key() % 100), 2, "0")), ",", "IO", " - P - ", digits(F.lpad(n(key() % 100000), 6, "0")))
    return part(spark, sf_dir).select("p_partkey", ids.detect_misread(F.when(key() % 3 == 0, txt("12", F.substring(seen, 3, 100))).otherwise(seen)).alias("number"))


@query("""SELECT p_partkey, (CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 100 WHEN 2 THEN 0 ELSE 2.5 END)::DOUBLE AS version,
  CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '000 589 ' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || ' 63 00' END AS tool, 'RO' || p_partkey || 'A' AS ro, 'ro:' || p_partkey || '>file:f' || p_partkey || '#attachment' AS link FROM part""")
def key_forms(spark, sf_dir):
    ver = F.when(key() % 4 == 0, "3a").when(key() % 4 == 1, "1e2").when(key() % 4 == 2, "v3").otherwise(" 2.5-x")
    tool = F.when(key() % 2 == 0, "000 589 1 63 00").otherwise(txt(" 000589", F.lpad(n(key() % 100), 2, "0"), " 63\t00"))
    link = ids.link_id(F.lit("ro"), n(key()), F.lit("file"), txt("f", n(key())), F.lit("attachment"))
    return part(spark, sf_dir).select("p_partkey", ids.version_number(ver).alias("version"), ids.canon_tool(tool).alias("tool"), ids.canon_order(txt(" ro ", n(key()), " a")).alias("ro"), link.alias("link"))


@query("""SELECT p_partkey, (200 + p_size) || ',' || (100 + p_partkey % 50) || ',300' AS models, p_size = 13 AS fits, (200 + p_size) || ',' || 999 AS words, '54,07,P' AS members, lpad((p_partkey % 50 + 10)::VARCHAR, 2, '0') AS grp FROM part""")
def model_series(spark, sf_dir):
    size = F.col("p_size")
    models = ids.models_of_validity(txt(n(100 + key() % 50), ", 300, model series ", n(200 + size), ", ", n(100 + key() % 50)))
    valid = F.array(txt("for ", n(200 + size), "/x"), F.lit("up to 999 of 12345"))
    ordered = F.concat(F.filter(models, lambda m: m == n(200 + size)), F.filter(models, lambda m: m != n(200 + size)))
    return part(spark, sf_dir).select("p_partkey", F.array_join(ordered, ",").alias("models"), ids.fits_model(valid, F.lit("213")).alias("fits"), F.array_join(ids.series_words(valid), ",").alias("words"), F.array_join(ids.group_members(F.lit("54, 07/P ")), ",").alias("members"), ids.first_group(txt("00.", n(key() % 50 + 10), ".1")).alias("grp"))


@query(f"""SELECT p_partkey, {_NO} || '_' || (p_partkey % 9 + 1) || ' A ' || p_partkey || '.pdf' AS name FROM part""")
def document_file_names(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", ids.file_name(number(), txt("V", n(key() % 9 + 1)), txt("A:", n(key()), " .")).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'tool' WHEN 1 THEN 'vehicle' WHEN 2 THEN 'document' ELSE 'text' END AS route FROM part""")
def query_routes(spark, sf_dir):
    q = F.when(key() % 4 == 0, txt("000 589 ", F.lpad(n(key() % 100), 2, "0"), " 63 00")).when(key() % 4 == 1, txt("W1K2140471A", F.lpad(n(key() % 1000000), 6, "0"))).when(key() % 4 == 2, F.lower(number())).otherwise(F.col("p_name"))
    return part(spark, sf_dir).select("p_partkey", search.route(q).alias("route"))


@query("""SELECT p_partkey, true AS shape, p_partkey % 4 <> 3 AS looks, CASE p_partkey % 3 WHEN 0 THEN 'W1K2140471A0' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') ELSE '' END AS best FROM part""".replace(", true AS shape", ", p_partkey % 5 <> 0 AS shape"))
def number_shapes(spark, sf_dir):
    five = F.lpad(n(key() % 100000), 5, "0")
    v = F.when(key() % 4 == 3, txt("ZZZ2140471A0", five)).otherwise(txt("W1K2140471A0", five))
    shape = F.when(key() % 5 == 0, txt("O1K2140471A0", five)).otherwise(F.lower(txt("W1K2140471A0", five)))
    return part(spark, sf_dir).select("p_partkey", vin.is_shape(shape).alias("shape"), vin.looks_like_vin(v).alias("looks"), vin.best_in(F.when(key() % 3 == 0, txt("no ", "W1K2140471A0", five, ".")).otherwise("none here")).alias("best"))


# --- dates, money, electricity


@query("""SELECT p_partkey, (CASE p_partkey % 3 WHEN 0 THEN 2025 WHEN 1 THEN 1926 ELSE 1999 END)::INT AS year, CASE WHEN p_partkey % 2 = 0 THEN '3/4/2024' ELSE 'on 5.x' END AS date FROM part""")
def written_dates(spark, sf_dir):
    y = F.when(key() % 3 == 0, "25").when(key() % 3 == 1, "26").otherwise("1999")
    return part(spark, sf_dir).select("p_partkey", calc.full_year(y, F.lit("2024-06-01").cast("date")).alias("year"), layout.norm_date(F.when(key() % 2 == 0, "3.4-2024").otherwise("on 5.x")).alias("date"))


@query("""WITH d AS (SELECT o_orderkey, least(o_orderdate::DATE, DATE '1995-03-31') AS a, greatest(o_orderdate::DATE, DATE '1995-03-31') AS b, CASE WHEN o_orderdate::DATE < DATE '1995-03-31' THEN 1 ELSE -1 END AS s0, o_orderdate::DATE AS o FROM orders),
p AS (SELECT *, day(b) - day(a) AS d0, month(b) - month(a) - CASE WHEN day(b) < day(a) THEN 1 ELSE 0 END AS m0 FROM d)
SELECT o_orderkey, CASE WHEN DATE '1995-03-31' < o THEN -1 ELSE 1 END::INT AS sign, (year(b) - year(a) - CASE WHEN m0 < 0 THEN 1 ELSE 0 END)::INT AS years, (CASE WHEN m0 < 0 THEN m0 + 12 ELSE m0 END)::INT AS months,
  (CASE WHEN d0 < 0 THEN d0 + day(last_day(b - INTERVAL 1 MONTH)) ELSE d0 END)::INT AS days FROM p""")
def date_parts(spark, sf_dir):
    d = calc.date_difference(F.to_date("o_orderdate"), F.lit("1995-03-31").cast("date"))
    return t(spark, sf_dir, "orders").select("o_orderkey", *[d[c].alias(c) for c in ("sign", "years", "months", "days")])


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice * l_tax AS part, CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity * 100 END AS what FROM lineitem""".replace("l_extendedprice * l_tax AS part", "l_quantity / 100 * l_extendedprice AS part"))
def percentages(spark, sf_dir):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", calc.percent_of(q, p).alias("part"), calc.what_percent(p, q).alias("what"))


_P = "p_size::DOUBLE AS s, p_partkey::DOUBLE AS k FROM part"


@query(rounded("distance economy per_100 cost cost_per_distance", f"""SELECT p_partkey, s * 10 AS distance, s * 10 / 4 AS economy, 4 / (s * 10) * 100 AS per_100, 4 * 1.5::DOUBLE AS cost, 4 * 1.5::DOUBLE / (s * 10) AS cost_per_distance FROM (SELECT p_partkey, {_P})""", 9))
def trip_costs(spark, sf_dir):
    s, k = F.col("p_size").cast("double"), key().cast("double")
    m = calc.mileage(k, k + s * 10, F.lit(4.0), F.lit(1.5))
    return part(spark, sf_dir).select("p_partkey", *[F.round(m[c], 9).alias(c) for c in ("distance", "economy", "per_100", "cost", "cost_per_distance")])


@query(rounded("v i r p", f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 12.0::DOUBLE WHEN 1 THEN s * 2 ELSE sqrt(s * 50) END AS v, CASE p_partkey % 3 WHEN 0 THEN 12 / s WHEN 1 THEN 2.0::DOUBLE ELSE sqrt(50 / s) END AS i,
  s AS r, CASE p_partkey % 3 WHEN 0 THEN 144 / s WHEN 1 THEN 4 * s ELSE 50.0::DOUBLE END AS p FROM (SELECT p_partkey, {_P})""", 9))
def ohms_law(spark, sf_dir):
    """Each part's size is a resistance; one more value is given by turns."""
    r, none = F.col("p_size").cast("double"), F.lit(None).cast("double")
    k = key() % 3
    o = calc.ohms_law(F.when(k == 0, 12.0), F.when(k == 1, 2.0), r, F.when(k == 2, 50.0))
    return part(spark, sf_dir).select("p_partkey", F.coalesce(o["v"], none).alias("v"), o["i"].alias("i"), o["r"].alias("r"), o["p"].alias("p")).select("p_partkey", *[F.round(c, 9).alias(c) for c in ("v", "i", "r", "p")])


@query(rounded("v_out i p1", f"""SELECT p_partkey, 12 / (s + 100) * 100 AS v_out, 12 / (s + 100) AS i, (12 / (s + 100)) * (12 / (s + 100)) * s AS p1 FROM (SELECT p_partkey, {_P})""", 9))
def voltage_dividers(spark, sf_dir):
    d = calc.divider(F.lit(12.0), F.col("p_size").cast("double"), F.lit(100.0))
    return part(spark, sf_dir).select("p_partkey", *[F.round(d[c], 9).alias(c) for c in ("v_out", "i", "p1")])


@query(rounded("r e12 watts rating", """WITH r AS (SELECT p_partkey, (3.0::DOUBLE + p_size) / 0.02::DOUBLE AS r, (3.0::DOUBLE + p_size) * 0.02::DOUBLE AS p FROM part),
e AS (SELECT unnest([1, 1.2, 1.5, 1.8, 2.2, 2.7, 3.3, 3.9, 4.7, 5.6, 6.8, 8.2]) AS m), d AS (SELECT unnest([10, 100, 1000, 10000]) AS d)
SELECT p_partkey, r, (SELECT min(m::DOUBLE * d) FROM e, d WHERE m::DOUBLE * d >= r - 1e-9) AS e12, p AS watts, (SELECT min(w) FROM (SELECT unnest([0.125, 0.25, 0.5, 1.0, 2.0, 5.0]) AS w) WHERE w >= p * 2)::DOUBLE AS rating FROM r""", 6))
def led_resistors(spark, sf_dir):
    d = calc.led_resistor(F.col("p_size").cast("double") + 5, F.lit(2.0), F.lit(20.0))
    return part(spark, sf_dir).select("p_partkey", *[F.round(d[c], 6).alias(c) for c in ("r", "e12", "watts", "rating")])


@query(rounded("ohms tolerance smd", """SELECT p_partkey, (CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 10 * 10 + p_size % 10) * 1000 ELSE (p_partkey % 10 * 100 + p_size % 10 * 10 + 7) * 0.1 END)::DOUBLE AS ohms, CASE WHEN p_partkey % 2 = 0 THEN 5.0 ELSE 1.0 END::DOUBLE AS tolerance,
  (CASE p_partkey % 4 WHEN 0 THEN (10 + p_size % 90) * 100 WHEN 1 THEN (100 + p_size) * 10 WHEN 2 THEN 4.7 ELSE 1000 END)::DOUBLE AS smd FROM part""", 6))
def resistor_codes(spark, sf_dir):
    colour = lambda k: F.get(F.array(*map(F.lit, calc.COLOURS)), k.cast("int"))
    size = F.col("p_size")
    four = F.array(colour(key() % 10), colour(size % 10), F.lit("Orange"), F.lit("Gold"))
    five = F.array(colour(key() % 10), colour(size % 10), F.lit("Violet"), F.lit("Gold"), F.lit("Brown"))
    c = calc.colour_code(F.when(key() % 2 == 0, four).otherwise(five))
    smd = F.when(key() % 4 == 0, txt(n(10 + size % 90), "2")).when(key() % 4 == 1, txt(n(100 + size), "1")).when(key() % 4 == 2, "4R7").otherwise("01b")
    return part(spark, sf_dir).select("p_partkey", F.round(c["ohms"].cast("double"), 6).alias("ohms"), c["tolerance"].alias("tolerance"), F.round(calc.smd_code(smd), 6).alias("smd"))


@query(rounded("xc xl resonance month mw dbm", """SELECT p_partkey, 1 / (2 * pi() * 50 * (p_size * 1e-6::DOUBLE)) AS xc, 2 * pi() * 50 * (p_size * 1e-3::DOUBLE) AS xl, 1 / (2 * pi() * sqrt((p_size * 1e-3::DOUBLE) * (p_size * 1e-6::DOUBLE))) AS resonance,
  p_size / 1000::DOUBLE * 2 * 0.3::DOUBLE * 30 AS month, power(10.0, p_size / 10::DOUBLE) AS mw, 10 * log10(p_size::DOUBLE) AS dbm FROM part""", 6))
def reactances(spark, sf_dir):
    s = F.col("p_size").cast("double")
    x = calc.reactance(F.lit(50.0), s, s)
    return part(spark, sf_dir).select("p_partkey", *[F.round(c, 6).alias(name) for name, c in {"xc": x["xc"], "xl": x["xl"], "resonance": x["resonance"], "month": calc.energy_cost(s, F.lit(2.0), F.lit(0.3))["month"], "mw": calc.dbm_to_mw(s), "dbm": calc.mw_to_dbm(s)}.items()])


@query(rounded("mm mm2 ohm_km hours ohms kcmil amperes", """WITH g AS (SELECT p_partkey, p_size % 41 AS n, p_size::DOUBLE AS s FROM part), d AS (SELECT *, 0.127::DOUBLE * power(92.0, (36 - n) / 39::DOUBLE) AS mm FROM g)
SELECT p_partkey, mm, pi() / 4 * mm * mm AS mm2, 0.01724::DOUBLE / (pi() / 4 * mm * mm) * 1000 AS ohm_km, 60 / s * 80 / 100 AS hours, (s * 1000 + 700)::DOUBLE AS ohms, pi() / 4 * mm * mm * 1.97353::DOUBLE AS kcmil, (CASE n WHEN 0 THEN 150 WHEN 1 THEN 119 WHEN 2 THEN 94 WHEN 4 THEN 60 WHEN 6 THEN 37 WHEN 8 THEN 24 WHEN 10 THEN 15 WHEN 12 THEN 9.3 WHEN 14 THEN 5.9 WHEN 16 THEN 3.7 WHEN 18 THEN 2.3 WHEN 20 THEN 1.5 WHEN 22 THEN 0.92 WHEN 24 THEN 0.577 WHEN 26 THEN 0.361 WHEN 28 THEN 0.226 WHEN 30 THEN 0.142 END)::DOUBLE AS amperes FROM d""", 6))
def wires(spark, sf_dir):
    s = F.col("p_size").cast("double")
    w = calc.wire(n(F.col("p_size") % 41))
    ohms = calc.parse_ohms(txt(n(F.col("p_size")), ".7 kΩ"))
    return part(spark, sf_dir).select("p_partkey", *[F.round(c, 6).alias(name) for name, c in {"mm": w["mm"], "mm2": w["mm2"], "ohm_km": w["ohm_km"], "kcmil": w["kcmil"], "amperes": w["amperes"], "hours": calc.battery_hours(F.lit(60.0), s, F.lit(80)), "ohms": ohms}.items()])


@query(rounded("four", """SELECT p_partkey, round(p_retailprice / power(10.0, floor(log10(p_retailprice)) - 3)) * power(10.0, floor(log10(p_retailprice)) - 3) AS four FROM part""", 6))
def significant_digits(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", F.round(calc.significant(F.col("p_retailprice"), 4), 6).alias("four"))


@query("SELECT doc_id, NULL AS crc FROM documents".replace("NULL AS crc", "octet_length(encode(coalesce(text, '')))::BIGINT AS n, text = (SELECT text FROM documents WHERE doc_id = 3) AS same"))
def byte_equality(spark, sf_dir):
    from dossier.operators.scans import same_bytes

    other = t(spark, sf_dir, "documents").where("doc_id = 3").select(F.encode("text", "utf-8").alias("o"))
    b = F.encode("text", "utf-8")
    return t(spark, sf_dir, "documents").crossJoin(F.broadcast(other)).select("doc_id", F.coalesce(F.octet_length(b), F.lit(0)).cast("long").alias("n"), same_bytes(b, F.col("o")).alias("same"))
