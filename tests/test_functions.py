"""Scalar functions on small rows: texts, identifiers, vehicle numbers, dates, arithmetic."""

import datetime
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.functions import calc, ids, text, vin


def one(spark, column, **values):
    """The value of a column over one row; columns are strings unless given as (value, type)."""
    typed = {k: v if isinstance(v, tuple) else (v, "string") for k, v in values.items()}
    schema = ", ".join(f"{k} {t}" for k, (_, t) in typed.items()) or "dummy int"
    df = spark.createDataFrame([tuple(v for v, _ in typed.values()) or (1,)], schema)
    return df.select(column.alias("out")).first().out




@pytest.mark.parametrize(
    "function, value, want",
    [
        (text.norm_chars, "LI83.70‑P‑080411 x­", "LI83.70-P-080411 x­"),
        (text.norm_text, "a­​b c", "ab c"),
        (text.norm_number, "a–b—c", "a-b-c"),
        (text.sanitize, " a/b:c*?‮\x07  d ", "a b c d"),
        (text.clean_title, "“Say” it’s. ", "Say it's"),
        (text.squash, " a \t b ", "a b"),
        (text.compact, "LI 83.70-P", "li8370p"),
        (text.title_case, "jill o'blue-SMITH", "Jill O'Blue-Smith"),
        (text.line_signature, "Page 12 of 99 pages", "page # of # pages"),
        (text.line_signature, "12 ab", ""),
        (text.norm_token, "(con-trol),", "control"),
        (text.norm_token, "--", "--"),
        (text.clip_name, "con.txt", "_con.txt"),
        (text.clip_name, "", "file"),
        (text.format_bytes, None, "0 B"),
        (ids.canon_number, " li83.70‑p‑080411 ", "LI83.70-P-080411"),
        (ids.document_key, "li83.70-p-080411", "li:LI83.70-P-080411"),
        (ids.detect_number, "see LI54.10‑P‑071234, too", "LI54.10-P-071234"),
        (ids.detect_number, "xLI54.10-P-071234", ""),
        (ids.detect_misread, "1I54.lO-P-O71234", "II54.10-P-071234"),
        (ids.canon_tool, "000589012300", "000 589 01 23 00"),
        (ids.canon_tool, "00058901230", ""),
        (ids.models_of_validity, "Model 214 and model series 213", ["214", "213"]),
        (ids.models_of_validity, "213, 214", ["213", "214"]),
        (ids.first_group, "00, 54, 82", "54"),
        (ids.canon_order, " a 12 b", "A12B"),
        (ids.version_number, "3a", 3.0),
        (ids.version_number, "1e2", 100.0),
        (ids.version_number, None, 0.0),
        (vin.series, "W1K2140471A068698", "214"),
        (vin.series, "W1NKM4GB9SF382775", ""),
        (vin.check_ok, "W1NKM4GB9SF382775", True),
        (vin.check_ok, "W1NKMAGB9SF382775", False),
        (vin.check_ok, "w1nkm4gb9sf382775", False),
        (vin.check_ok, "W1NKM4GB9SF38277", False),
        (vin.looks_like_vin, "4JGFB4GB9SB387878", True),
        (vin.looks_like_vin, "W1KLF4HB1RA068698", True),
        (vin.looks_like_vin, "FREEMAPUPDATES50A", False),
        (vin.looks_like_vin, "112600009311006RE", False),
        (vin.model_year, "W1NKM4GB9SF382775", "2025"),
        (calc.date_value, "2024-03-17", 20240317),
        (calc.date_value, "17.03.2015", 20150317),
        (calc.date_value, "03/17/15", 20150317),
        (calc.date_value, "soon", 0),
        (calc.parse_ohms, "4.7k", 4700.0),
        (calc.parse_ohms, "1,000 Ω", 1000.0),
        (calc.parse_ohms, "x", None),
        (calc.smd_code, "473", 47000.0),
        (calc.smd_code, "1002", 10000.0),
        (calc.smd_code, "4R7", 4.7),
        (calc.smd_code, "01C", 10000.0),
        (calc.smd_code, "zz", None),
    ],
)
def test_text_in_value_out(spark, function, value, want):
    assert one(spark, function(F.col("x")), x=value) == want


def test_line_and_case_operations(spark):
    assert one(spark, text.line_op(F.col("x"), "unique"), x="b\na\nb") == "b\na"
    assert one(spark, text.line_op(F.col("x"), "rsort"), x="b\na\r\nc") == "c\nb\na"
    assert one(spark, text.line_op(F.col("x"), "dropblank"), x="b\n \na") == "b\na"
    assert [one(spark, text.to_case(F.col("x"), k), x="someValue here") for k in ("camel", "snake", "kebab", "constant")] == ["someValueHere", "some_value_here", "some-value-here", "SOME_VALUE_HERE"]
    assert one(spark, text.to_case(F.col("x"), "invert"), x="aBc") == "AbC"
    assert one(spark, text.to_case(F.col("x"), "sentence"), x="HELLO THERE. how are") == "Hello there. How are"
    got = one(spark, text.replace_all(F.col("x"), "a.b", "$1\\"), x="a.b axb")
    assert (got.text, got.n) == ("$1\\ axb", 1)
    s = one(spark, F.struct(*[c.alias(k) for k, c in text.stats(F.col("x")).items()]), x="One two. Three!\n\nfour")
    assert (s.words, s.chars, s.lines, s.sentences, s.paragraphs, s.reading_minutes) == (4, 21, 3, 2, 2, 1)
    assert one(spark, text.join_hyphen(F.array(F.lit("ACTI-"), F.lit("VE code N10-"), F.lit("1"))), x="") == "ACTIVE code N10- 1"


def test_version_after_the_number(spark):
    f = ids.detect_version(F.col("x"), F.col("y"))
    n = "LI54.10-P-071234"
    assert one(spark, f, x=f"{n} V12 title", y=n) == "12"
    assert one(spark, f, x=f"{n} / 3", y=n) == "3"
    assert one(spark, f, x="Stand: 4 x", y="") == "4"
    assert one(spark, f, x="Version 03-17-2015", y=n) == ""


def test_file_names(spark):
    f = ids.file_name(F.col("n"), F.col("v"), F.col("t"))
    assert one(spark, f, n="LI54.10-P-071234", v="3", t="A: title.") == "LI54.10-P-071234_3 A title.pdf"
    assert one(spark, f, n=None, v=None, t=None) == "document.pdf"


def test_natural_order(spark):
    df = spark.createDataFrame([("b2",), ("b10",), ("A1",), ("b02x",)], "x string")
    assert [r.x for r in df.orderBy(text.natural_key(F.col("x")), F.col("x")).collect()] == ["A1", "b2", "b02x", "b10"]


def test_vins_are_told_apart_by_label(spark):
    def find(t, fuzzy=False):
        r = spark.createDataFrame([(t,)], "t string").select(vin.find_vins(F.col("t"), fuzzy).alias("f"), vin.best_in(F.col("t")).alias("b")).first()
        return list(r.f.vins), list(r.f.fins), r.b

    t = "VIN: W1NKM4GB9SF382775 and Datenkarte W1K2140471A068698, W1KLF4HB1 RA068698"
    assert find(t)[:2] == (["W1NKM4GB9SF382775", "W1KLF4HB1RA068698"], ["W1K2140471A068698"])
    assert find("W1NKM4GB9SF38277S")[:2] == (["W1NKM4GB9SF38277S"], [])
    assert find("WITHOUT LIMITATION OF") == ([], [], "") == find(None)
    assert find("WINKM4GB9SF38277O", True)[0] == ["W1NKM4GB9SF382770"]
    assert find("W1NKMAGB9SF382775 VIN W1NKM4GB9SF382775")[2] == "W1NKM4GB9SF382775"
    # The strongest label counts, wherever it stands, and beside a labelled one a digit in the fourth place tells.
    assert find("W1K2140471A068698 VIN W1K2140471A068698 W1K2140471A068699")[:2] == (["W1K2140471A068698"], ["W1K2140471A068699"])
    many = " ".join(f"W1KLF4HB1RA0{k:05d}" for k in range(40))
    assert len(find(many)[0]) == vin.MOST


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ABCDEFGHJKLMNPRSTUVWXYZ0123456789", min_size=17, max_size=17))
def test_check_digit_is_one_of_eleven(spark, v):
    rows = spark.createDataFrame([(v[:8] + c + v[9:],) for c in "0123456789X"], "v string")
    assert rows.where(vin.check_ok(F.col("v"))).count() <= 1


def test_dates(spark):
    a, b = datetime.date(2024, 1, 31), datetime.date(2024, 3, 1)
    got = one(spark, calc.date_difference(F.col("x"), F.col("y")), x=(a, "date"), y=(b, "date"))
    # One borrow only: the month before the later date has 29 days, so 31 January to 1 March is 1 month and -1 day.
    assert (got.sign, got.years, got.months, got.days, got.total_days) == (1, 0, 1, -1, 30)
    back = one(spark, calc.date_difference(F.col("x"), F.col("y")), x=(b, "date"), y=(a, "date"))
    assert back.sign == -1 and back.total_days == -30
    assert one(spark, calc.full_year(F.col("x"), F.lit(datetime.date(2026, 5, 1))), x="27") == 2027
    assert one(spark, calc.full_year(F.col("x"), F.lit(datetime.date(2026, 5, 1))), x="28") == 1928


def test_electrical(spark):
    n = lambda column, **k: one(spark, column, **{a: (v, "double") for a, v in k.items()})
    law = calc.ohms_law(F.col("v"), F.col("i"), F.col("r"), F.col("p"))
    for given_ in ({"v": 10.0, "i": 2.0}, {"v": 10.0, "r": 5.0}, {"v": 10.0, "p": 20.0}, {"i": 2.0, "r": 5.0}, {"i": 2.0, "p": 20.0}, {"r": 5.0, "p": 20.0}):
        got = n(law, **{"v": None, "i": None, "r": None, "p": None, **given_})
        assert all(math.isclose(a, b) for a, b in zip(got, (10, 2, 5, 20)))
    assert n(law, v=1.0, i=1.0, r=1.0, p=None) is None
    led = n(calc.led_resistor(F.col("s"), F.col("f"), F.col("m")), s=12.0, f=2.0, m=20.0)
    assert math.isclose(led.r, 500) and math.isclose(led.e12, 560) and led.rating == 0.5
    assert one(spark, calc.colour_code(F.array(*map(F.lit, ("Red", "Red", "Red", "Gold"))))).ohms == 2200
    five = one(spark, calc.colour_code(F.array(*map(F.lit, ("Brown", "Black", "Black", "Red", "Brown")))))
    assert (five.ohms, five.tolerance) == (10000, 1.0)
    assert math.isclose(n(calc.divider(F.col("v"), F.col("a"), F.col("b")), v=10.0, a=1.0, b=4.0).v_out, 8)
    assert math.isclose(one(spark, calc.wire(F.col("x")), x="12").mm, 2.0525, rel_tol=1e-3) and math.isclose(one(spark, calc.wire(F.col("x")), x="0000").mm, 11.684, rel_tol=1e-3)
    assert math.isclose(n(calc.reactance(F.col("x"), F.col("y"), F.col("z")), x=50.0, y=10.0, z=100.0).resonance, 159.155, rel_tol=1e-3)
    assert math.isclose(n(calc.mw_to_dbm(calc.dbm_to_mw(F.col("x"))), x=13.0), 13)
    assert calc.E96[:3] == [100, 102, 105] and calc.E96[95] == 976
    m = n(calc.mileage(F.col("a"), F.col("b"), F.col("f"), F.col("p")), a=100.0, b=500.0, f=20.0, p=2.0)
    assert (m.distance, m.economy, m.per_100, m.cost, m.cost_per_distance) == (400, 20, 5, 40, 0.1)
    assert n(calc.significant(F.col("x"), 3), x=0.0012345) == 0.00123


def test_collated_orders(spark):
    from dossier.operators import facets

    names = ["zebra", "éclair 10", "Eclair 9", "apple", "Ärger", "zoo", None, "", "10", "9", "file 010", "File 9"]
    df = spark.createDataFrame([(str(k), n) for k, n in enumerate(names)], "id string, name string")
    assert [r.name for r in df.orderBy(*facets.sort_key(df, "name")).collect()] == [None, "", "9", "10", "apple", "Ärger", "Eclair 9", "éclair 10", "File 9", "file 010", "zebra", "zoo"]
    mixed = ["10", "b", "9", " 1e1 ", "a", "B", "é", "f", "-3", "", None, "7 mm"]
    df = spark.createDataFrame([(m,) for m in mixed], "m string")
    assert [r.m for r in df.orderBy(facets.mixed_sort_key(F.col("m")), F.col("m").asc_nulls_first()).collect()] == ["-3", "9", " 1e1 ", "10", None, "", "7 mm", "a", "b", "B", "é", "f"]


def test_orders_of_version_groups(spark):
    from dossier.operators import facets

    rows = [("a", "LI10.10-P-000001", "2", "Öl", "1/2/2024", False, 5), ("b", "LI10.10-P-000002", "10x", "oel", None, True, None), ("c", "LI10.10-P-000003", None, "Zahn", "2023-05-01", None, 9), ("d", "LI10.10-P-000003", "1", None, "3/3/2025", True, 1)]
    docs = spark.createDataFrame([(*r[:4], "why", "54", *r[4:]) for r in rows], "id string, li string, ver string, title string, reason string, fgroup string, date string, star boolean, size long")
    g = facets.version_groups(docs)
    order = lambda by, down=False: [r.first_id for r in g.orderBy(facets.group_sort_key(by, down)).collect()]
    assert order("ver", True) == ["b", "a", "c"] and order("size") == ["b", "c", "a"] and order("date") == ["b", "a", "c"]
    assert order("star") == ["b", "c", "a"] and order("star", True) == ["a", "b", "c"] and order("title") == ["c", "b", "a"] or order("title") == ["c", "a", "b"]


def test_number_formats(spark):
    from dossier.functions import calc

    values = [0.0, 1.0, 4700.0, 1234567.0, 12345678.0, 0.00012, 0.000012, -4.7, 100.0, 0.1 + 0.2, None, float("nan"), 2.2e6, 999.9999]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.v for r in df.select(calc.format_value(F.col("x"), "V").alias("v")).collect()]
    assert got == ["0 V", "1 V", "4700 V", "1234570 V", "1.2346e7 V", "0.00012 V", "1.2000e-5 V", "-4.7 V", "100 V", "0.3 V", "—", "—", "2200000 V", "1000 V"]
    assert [r.v for r in df.where("x in (0, 4700, 2.2e6, -4.7)").select(calc.format_ohm(F.col("x")).alias("v")).collect()] == ["0 Ω", "4.7 kΩ", "-4.7 Ω", "2.2 MΩ"]
    assert spark.range(1).select(calc.format_ohm(F.lit(1.2e-9)).alias("v")).first().v == "1.2e-9 Ω"
    small = spark.createDataFrame([(4.7e-9,), (1e-13,), (1e3,), (0.5,), (2.2e-6,)], "x double")
    assert [r.v for r in small.select(calc.format_si(F.col("x"), "F").alias("v")).collect()] == ["4.7 nF", "0.1 pF", "1 kF", "500 mF", "2.2 µF"]
    from dossier.functions import text

    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 40,), (None,)], "n long")
    assert [r.v for r in sizes.select(text.format_bytes(F.col("n"), 2, 5).alias("v")).collect()] == ["0 B", "1023 B", "1.50 KB", "5.00 TB", "0 B"]
