"""Dates, arithmetic, units and electrical formulas as column functions; where a value would be undefined, null."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import s, sub

# Units of each category and their size in the category's first unit.
UNITS = {
    "length": {"m": 1, "km": 1000, "cm": 0.01, "mm": 0.001, "µm": 1e-6, "nm": 1e-9, "mi": 1609.344, "yd": 0.9144, "ft": 0.3048, "in": 0.0254, "nmi": 1852},
    "mass": {"kg": 1, "g": 0.001, "mg": 1e-6, "µg": 1e-9, "t": 1000, "lb": 0.45359237, "oz": 0.028349523125, "st": 6.35029318},
    "volume": {"L": 1, "mL": 0.001, "m³": 1000, "cm³": 0.001, "gal": 3.785411784, "qt": 0.946352946, "pt": 0.473176473, "cup": 0.2365882365, "fl oz": 0.0295735295625, "tbsp": 0.01478676478125, "tsp": 0.00492892159375, "gal (UK)": 4.54609},
    "area": {"m²": 1, "km²": 1e6, "cm²": 1e-4, "mm²": 1e-6, "ha": 1e4, "acre": 4046.8564224, "mi²": 2589988.110336, "yd²": 0.83612736, "ft²": 0.09290304, "in²": 0.00064516},
    "speed": {"m/s": 1, "km/h": 0.2777777777777778, "mph": 0.44704, "ft/s": 0.3048, "kn": 0.5144444444444445},
    "time": {"s": 1, "ms": 0.001, "min": 60, "h": 3600, "day": 86400, "week": 604800, "yr": 31557600},
    "data": {"bit": 0.125, "B": 1, "KB": 1e3, "MB": 1e6, "GB": 1e9, "TB": 1e12, "PB": 1e15, "KiB": 1024, "MiB": 1048576, "GiB": 1073741824, "TiB": 1099511627776},
    "pressure": {"Pa": 1, "kPa": 1000, "bar": 1e5, "psi": 6894.757293168, "atm": 101325, "mmHg": 133.322387415, "torr": 133.3223684210526},
    "energy": {"J": 1, "kJ": 1000, "cal": 4.184, "kcal": 4184, "Wh": 3600, "kWh": 3.6e6, "BTU": 1055.05585262, "eV": 1.602176634e-19},
    "torque": {"N·m": 1, "N·cm": 0.01, "kN·m": 1000, "dyn·cm": 1e-7, "kgf·m": 9.80665, "kgf·cm": 0.0980665, "gf·cm": 9.80665e-5, "lbf·ft": 1.3558179483314004, "lbf·in": 0.1129848290276167, "ozf·in": 0.0070615518142260},
    "angle": {"°": 1, "rad": 57.29577951308232, "grad": 0.9, "′": 0.0166666666666667, "″": 0.0002777777777778, "turn": 360},
}
TEMPERATURES = ("°C", "°F", "K")
E12 = (1, 1.2, 1.5, 1.8, 2.2, 2.7, 3.3, 3.9, 4.7, 5.6, 6.8, 8.2)
WATTS = (0.125, 0.25, 0.5, 1.0, 2.0, 5.0)
COLOURS = ("Black", "Brown", "Red", "Orange", "Yellow", "Green", "Blue", "Violet", "Grey", "White")
TOLERANCES = {"Brown": 1.0, "Red": 2.0, "Green": 0.5, "Blue": 0.25, "Violet": 0.1, "Grey": 0.05, "Gold": 5.0, "Silver": 10.0}
SMD_FACTORS = {"Z": 0.001, "Y": 0.01, "R": 0.01, "X": 0.1, "S": 0.1, "A": 1.0, "B": 10.0, "H": 10.0, "C": 100.0, "D": 1000.0, "E": 10000.0, "F": 100000.0}
#: Amperes that a wire of each gauge carries in bundles.
AMPERES = {"0000": 302.0, "000": 239.0, "00": 190.0, "0": 150.0, "1": 119.0, "2": 94.0, "4": 60.0, "6": 37.0, "8": 24.0, "10": 15.0, "12": 9.3, "14": 5.9, "16": 3.7, "18": 2.3, "20": 1.5, "22": 0.92, "24": 0.577, "26": 0.361, "28": 0.226, "30": 0.142}
#: The E96 series by its rule.
E96 = [round(100 * 10 ** (k / 96)) for k in range(96)]


def units_table(spark: SparkSession) -> DataFrame:
    """category, unit, factor, first (the category's first unit, used for unknown ones): a dimension of fixed size."""
    rows = [(c, u, float(f), u == next(iter(us))) for c, us in UNITS.items() for u, f in us.items()]
    return spark.createDataFrame(rows, "category string, unit string, factor double, first boolean")


def _look_up(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)]), key)


def convert(df: DataFrame, category: str = "category", value: str = "value", source: str = "from_unit", target: str = "to_unit") -> DataFrame:
    """Adds converted: value in the target unit. Unknown units count as the category's first; unknown categories give null."""
    factor = lambda unit: F.coalesce(_look_up({f"{c}|{u}": float(f) for c, us in UNITS.items() for u, f in us.items()}, F.concat_ws("|", category, unit)), F.lit(1.0))
    celsius = F.when(F.col(source) == "°F", (F.col(value) - 32) * 5 / 9).when(F.col(source) == "K", F.col(value) - 273.15).otherwise(F.col(value))
    degrees = F.when(F.col(target) == "°F", celsius * 9 / 5 + 32).when(F.col(target) == "K", celsius + 273.15).otherwise(celsius)
    linear = F.when(F.col(category).isin(list(UNITS)), F.col(value) * factor(source) / factor(target))
    return df.withColumn("converted", F.when(F.col(category) == "temp", degrees).otherwise(linear))


def ten_to(k: Column) -> Column:
    """The double nearest to a whole power of ten; pow misses 1e-5 and 1e-11 by their last bit."""
    return F.concat(F.lit("1e"), k.cast("string")).cast("double")


def significant(x: Column, digits: int) -> Column:
    """x rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def _plain(x: Column) -> Column:
    """A number of six significant digits without zeros at its end; as a power of ten under a millionth."""
    v = significant(x, 6)
    tiny = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", v), r"\.?0+e", "e"), "e-0*", "e-")
    whole = F.regexp_replace(F.format_string("%.12f", v), r"\.0+\z|(\.[0-9]*[1-9])0+\z", "$1")
    return F.when((v != 0) & (F.abs(v) < 1e-6), tiny).otherwise(whole)


def format_value(x: Column, unit: str = "") -> Column:
    """Six significant digits, as a power of ten under 0.0001 (before it is rounded) and from 10,000,000 on (rounded); a dash
    for what is no number."""
    v = significant(x, 6)
    power = F.regexp_replace(F.regexp_replace(F.format_string("%.4e", v), r"e\+0*", "e"), "e-0*", "e-")
    shown = F.when((v != 0) & ((F.abs(x) < 1e-4) | (F.abs(v) >= 1e7)), power).otherwise(_plain(x))
    return F.when(_finite(x), F.concat(shown, F.lit(f" {unit}" if unit else ""))).otherwise("—")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _scaled(x: Column, unit: str, steps: list[tuple[float, str]]) -> Column:
    """x in the first of the steps (least, prefix), from the largest down, that it reaches; else in the last."""
    out = None
    for least, prefix in steps:
        said = F.concat(_plain(x / least), F.lit(f" {prefix}{unit}"))
        out = F.when(F.abs(x) >= least, said) if out is None else out.when(F.abs(x) >= least, said)
    return F.when(_finite(x), out.otherwise(F.concat(_plain(x / steps[-1][0]), F.lit(f" {steps[-1][1]}{unit}")))).otherwise("—")


def format_ohm(x: Column) -> Column:
    return _scaled(x, "Ω", [(1e6, "M"), (1e3, "k"), (1.0, "")])


def format_si(x: Column, unit: str) -> Column:
    return _scaled(x, unit, [(1e9, "G"), (1e6, "M"), (1e3, "k"), (1.0, ""), (1e-3, "m"), (1e-6, "µ"), (1e-9, "n"), (1e-12, "p")])


def date_value(c: Column) -> Column:
    """A written date as YYYYMMDD: year first if it has four digits; else day first if that is over 12; 0 if unreadable."""
    n = F.transform(F.regexp_extract_all(s(c), F.lit(r"(\d+)"), F.lit(1)), lambda x: F.substring(x, 1, 8))
    at = lambda k: F.get(n, F.lit(k)).try_cast("int")
    whole = lambda y, m, d: y * 10000 + m * 100 + d
    year = F.when(F.length(F.get(n, F.lit(2))) > 2, at(2)).when(at(2) < 70, 2000 + at(2)).otherwise(1900 + at(2))
    late = F.when(at(0) > 12, whole(year, at(1), at(0))).otherwise(whole(year, at(0), at(1)))
    return F.coalesce(F.when(F.size(n) < 3, F.lit(0)).when(F.length(F.get(n, F.lit(0))) == 4, whole(at(0), at(1), at(2))).otherwise(late), F.lit(0))


def full_year(c: Column, as_of: Column) -> Column:
    """A two-digit year by the century that puts it at most one year after `as_of`."""
    y = F.regexp_extract(s(c), r"^\s*(\d{1,4})", 1).try_cast("int")
    cut = F.year(as_of) % 100 + 1
    return F.when((y >= 1900) & (y <= 2100), y).when((y >= 0) & (y < 100), F.when(y <= cut, 2000 + y).otherwise(1900 + y))


def date_difference(a: Column, b: Column) -> Column:
    """struct(sign, years, months, days, total_days, weeks, hours, avg_months) from date a to date b.

    Days are borrowed from the month before the later date.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    sign = F.when(b < a, -1).otherwise(1)
    days = F.dayofmonth(high) - F.dayofmonth(low)
    borrowed = F.when(days < 0, days + F.dayofmonth(F.last_day(F.add_months(high, -1)))).otherwise(days)
    months = F.month(high) - F.month(low) - F.when(days < 0, 1).otherwise(0)
    years = F.year(high) - F.year(low) - F.when(months < 0, 1).otherwise(0)
    total = F.datediff(high, low) * sign
    return F.struct(sign.alias("sign"), years.alias("years"), F.when(months < 0, months + 12).otherwise(months).alias("months"), borrowed.alias("days"), total.alias("total_days"), (total / 7).alias("weeks"), (total * 24).alias("hours"), (total / 30.4375).alias("avg_months"))


def percent_of(x: Column, y: Column) -> Column:
    return x / 100 * y


def what_percent(x: Column, y: Column) -> Column:
    return F.try_divide(x, y) * 100


def percent_change(a: Column, b: Column) -> Column:
    return F.try_divide(b - a, a) * 100


def discount(price: Column, off: Column, tax: Column) -> Column:
    save = price * off / 100
    return F.struct(save.alias("save"), (price - save).alias("sale"), ((price - save) * (1 + F.coalesce(tax, F.lit(0)) / 100)).alias("with_tax"))


def mileage(start: Column, end: Column, fuel: Column, price: Column) -> Column:
    """struct(distance, economy, per_100, cost, cost_per_distance); without fuel only the distance."""
    distance, some = end - start, F.when(fuel > 0, fuel)
    return F.struct(distance.alias("distance"), (distance / some).alias("economy"), (F.try_divide(some, distance) * 100).alias("per_100"), (F.when(fuel >= 0, fuel) * price).alias("cost"), F.try_divide(some * price, distance).alias("cost_per_distance"))


def parse_ohms(c: Column) -> Column:
    """"4.7k" as ohms; null if it is no such value."""
    t = F.trim(F.replace(sub(F.trim(s(c)), "(?i)Ω|ohms?"), F.lit(","), F.lit("")))
    shape = r"^([0-9]*\.?[0-9]+)\s*([kKmMgG]?)\z"
    factor = _look_up({"k": 1e3, "m": 1e6, "g": 1e9, "": 1.0}, F.lower(F.regexp_extract(t, shape, 2)))
    return F.when(t.rlike(shape), F.regexp_extract(t, shape, 1).try_cast("double") * factor)


def ohms_law(v: Column, i: Column, r: Column, p: Column) -> Column:
    """struct(v, i, r, p) from exactly two of them; null otherwise."""
    given = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in (v, i, r, p)), F.lit(0))
    volts = F.coalesce(v, i * r, F.try_divide(p, i), F.sqrt(p * r))
    amps = F.coalesce(i, F.try_divide(v, r), F.try_divide(p, v), F.sqrt(F.try_divide(p, r)))
    return F.when(given == 2, F.struct(volts.alias("v"), amps.alias("i"), F.coalesce(r, F.try_divide(volts, amps)).alias("r"), F.coalesce(p, volts * amps).alias("p")))


def series_resistance(r: Column) -> Column:
    """Aggregate."""
    return F.sum(F.when(r > 0, r))


def parallel_resistance(r: Column) -> Column:
    """Aggregate."""
    return F.try_divide(F.lit(1.0), F.sum(F.when(r > 0, 1 / r)))


def divider(v: Column, r1: Column, r2: Column) -> Column:
    i = F.try_divide(v, r1 + r2)
    return F.struct((i * r2).alias("v_out"), i.alias("i"), (i * i * r1).alias("p1"), (i * i * r2).alias("p2"))


def led_resistor(supply: Column, forward: Column, milliamps: Column) -> Column:
    """struct(r, e12, watts, rating): the resistor, the next E12 value, its power, and the rating with twice that."""
    ok = (supply > forward) & (milliamps > 0)
    amps = milliamps / 1000
    r = F.when(ok, (supply - forward) / amps)
    p = F.when(ok, (supply - forward) * amps)
    decade = F.floor(F.log10(r))
    steps = F.array(*[F.lit(v) * F.pow(F.lit(10.0), decade + k) for k in (0, 1) for v in E12])
    rating = F.array_min(F.filter(F.array(*map(F.lit, WATTS)), lambda w: w >= p * 2))
    return F.struct(r.alias("r"), F.array_min(F.filter(steps, lambda x: x >= r - 1e-9)).alias("e12"), p.alias("watts"), rating.alias("rating"))


def colour_code(bands: Column) -> Column:
    """struct(ohms, tolerance) of 4 bands, or 5 or 6 (a third digit); bands are colour names."""
    digit = {c: k for k, c in enumerate(COLOURS)}
    factor = {c: 10.0**k for k, c in enumerate(COLOURS)} | {"Gold": 0.1, "Silver": 0.01}
    n = F.size(bands)
    at = lambda k: _look_up(digit, F.get(bands, F.lit(k)))
    four = (at(0) * 10 + at(1)) * _look_up(factor, F.get(bands, F.lit(2)))
    five = (at(0) * 100 + at(1) * 10 + at(2)) * _look_up(factor, F.get(bands, F.lit(3)))
    return F.struct(F.when(n == 4, four).otherwise(five).alias("ohms"), _look_up(TOLERANCES, F.get(bands, F.when(n == 4, 3).otherwise(4))).alias("tolerance"))


def smd_code(c: Column) -> Column:
    """Ohms of a three- or four-digit, R-notation or EIA-96 code; null if it is none."""
    t = F.upper(F.trim(s(c)))
    tens = lambda a, b: t.substr(1, a).try_cast("double") * F.pow(F.lit(10.0), t.substr(b, 1).try_cast("int"))
    eia = F.get(F.array(*map(F.lit, E96)), t.substr(1, 2).try_cast("int") - 1) * _look_up(SMD_FACTORS, t.substr(3, 1))
    return F.when(t.rlike(r"^\d{2}[A-Z]\z") & ~t.rlike(r"R"), eia).when(t.rlike("R"), F.replace(t, F.lit("R"), F.lit(".")).try_cast("double")).when(t.rlike(r"^\d{3}\z"), tens(2, 3)).when(t.rlike(r"^\d{4}\z"), tens(3, 4))


def reactance(hertz: Column, microfarads: Column, millihenries: Column) -> Column:
    c, l = F.when(microfarads > 0, microfarads * 1e-6), F.when(millihenries > 0, millihenries * 1e-3)
    f = F.when(hertz > 0, hertz)
    return F.struct((1 / (2 * math.pi * f * c)).alias("xc"), (2 * math.pi * f * l).alias("xl"), (1 / (2 * math.pi * F.sqrt(l * c))).alias("resonance"))


def energy_cost(watts: Column, hours: Column, rate: Column) -> Column:
    day = watts / 1000 * hours
    return F.struct(day.alias("kwh_day"), (day * rate).alias("day"), (day * rate * 30).alias("month"), (day * rate * 365).alias("year"))


def dbm_to_mw(d: Column) -> Column:
    return F.pow(F.lit(10.0), d / 10)


def mw_to_dbm(m: Column) -> Column:
    return F.when(m > 0, 10 * F.log10(m))


def wire(gauge: Column) -> Column:
    """struct(mm, mm2, ohm_km, kcmil, amperes) of an AWG gauge ("0000" to "40"); amperes is null where no value is known."""
    n = F.when(gauge.rlike("^0+\\z"), 1 - F.length(gauge)).otherwise(gauge.try_cast("int"))
    mm = 0.127 * F.pow(F.lit(92.0), (36 - n) / 39)
    area = math.pi / 4 * mm * mm
    return F.struct(mm.alias("mm"), area.alias("mm2"), (1.724e-8 / (area * 1e-6) * 1000).alias("ohm_km"), (area * 1.97353).alias("kcmil"), _look_up(AMPERES, gauge).alias("amperes"))


def battery_hours(capacity: Column, load: Column, derate: Column) -> Column:
    return capacity / F.when(load > 0, load) * F.coalesce(derate, F.lit(100)) / 100
