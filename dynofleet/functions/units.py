"""Units: read them from channel headers, convert absolute values and differences, print them.

Nothing is converted silently: an unknown unit stays what it is, a conversion between different
quantities is an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quantity -> units, the first one is canonical.
QUANTITIES = {
    "temperature": ("°F", "°C"),
    "pressure": ("kPa", "psi", "inHg", "bar"),
    "airflow": ("g/s", "lb/min"),
    "speed": ("mph", "km/h"),
}
# One of the unit, in the canonical unit of its quantity.
FACTORS = {
    "kPa": 1.0,
    "psi": 6.894757293168361,
    "inHg": 3.386388640341,
    "bar": 100.0,
    "g/s": 1.0,
    "lb/min": 453.59237 / 60,
    "mph": 1.0,
    "km/h": 1 / 1.609344,
}
# Spellings that can be converted, then those that are only recognised; the first that fits counts.
SPELLINGS = (
    (r"\b(deg\s*)?[°]?\s*F\b|fahrenheit", "°F"),
    (r"\b(deg\s*)?[°]?\s*C\b|celsius|centigrade", "°C"),
    (r"\bkpa\b|kilopascal", "kPa"),
    (r"\bpsi(a|g)?\b", "psi"),
    (r"\bin\.?\s*hg\b|inches\s*hg", "inHg"),
    (r"\bbar\b", "bar"),
    (r"\blb\s*\/?\s*min\b|lbs?\/min|pounds?\s*per\s*min", "lb/min"),
    (r"\bg\s*\/\s*s\b|grams?\s*per\s*sec|\bgps\b", "g/s"),
    (r"\bkm\s*\/?\s*h\b|kph|km\/hr", "km/h"),
    (r"\bmph\b|miles\s*per\s*hour", "mph"),
    (r"\bhz\b|hertz", "Hz"),
    (r"\brpm\b", "RPM"),
    (r"%|percent", "%"),
    (r"\bdeg(rees)?\b|[°](?!\s*[FC])", "°"),
    (r"\bms\b|millisec", "ms"),
    (r"\b(volts?|v)\b", "V"),
    (r"\bkpa?\/s\b", "kPa/s"),
    (r"\bafr\b", "AFR"),
    (r"\blambda\b", "λ"),
    (r"\bsec(onds?)?\b|\bs\b", "s"),
)
# Stoichiometric air-fuel ratio by fuel.
STOICH = {"gasoline": 14.7, "e85": 9.765, "e50": 11.7, "methanol": 6.4}

FLAGS_ON = ("1", "true", "yes", "on", "active", "enabled")


def quantity_of(unit: Column) -> Column:
    pairs = [F.lit(x) for q, units in QUANTITIES.items() for u in units for x in (u, q)]
    return F.try_element_at(F.create_map(*pairs), unit)


def detect_unit(header: Column) -> Column:
    """The unit in the last bracket group (1 to 12 characters) of a header; null without one.

    A bracket text that no spelling fits is the unit as it stands.
    """
    text = F.trim(F.regexp_extract(header, r"[(\[]([^)\]]{1,12})[)\]]\s*$", 1))
    there = header.rlike(r"[(\[]([^)\]]{1,12})[)\]]\s*$")
    out = F.when(~F.coalesce(there, F.lit(False)), F.lit(None).cast("string"))
    for pattern, unit in SPELLINGS:
        out = out.when(text.rlike("(?i)" + pattern), unit)
    return out.otherwise(text)


def _converted(value: Column, unit: Column, to: Column, offset: float) -> Column:
    factor = lambda u: F.try_element_at(F.create_map(*(F.lit(x) for p in FACTORS.items() for x in p)), u)
    same = unit.isNull() | to.isNull() | (unit == "") | (to == "") | (unit == to)
    wrong = quantity_of(unit).isNull() | ~quantity_of(unit).eqNullSafe(quantity_of(to))
    return (
        F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None).cast("double"))
        .when(same, value)
        .when(wrong, F.raise_error(F.concat(F.lit("cannot convert "), unit, F.lit(" to "), to)).cast("double"))
        .when(unit == "°F", (value - offset) * 5 / 9)
        .when(unit == "°C", value * 9 / 5 + offset)
        .otherwise(value * factor(unit) / factor(to))
    )


def convert(value: Column, unit: Column, to: Column) -> Column:
    """An absolute value in another unit; null and non-finite values are null, blank units convert nothing."""
    return _converted(value, unit, to, 32.0)


def convert_delta(value: Column, unit: Column, to: Column) -> Column:
    """A difference in another unit: temperatures scale without their offset."""
    return _converted(value, unit, to, 0.0)


def preferred_unit(quantity: Column, preferences: dict[str, str] | None = None) -> Column:
    """The preferred unit of a quantity, else its canonical one; null for none."""
    canonical = {q: (preferences or {}).get(q, units[0]) for q, units in QUANTITIES.items()}
    return F.try_element_at(F.create_map(*(F.lit(x) for p in canonical.items() for x in p)), quantity)


def format_value(value: Column, unit: Column, places: int = 2) -> Column:
    """Fixed places, zeros at the end of a fraction trimmed, the unit behind; null: an em dash.

    Zeros are only trimmed behind a point, so 100 stays 100 at no places.
    """
    text = F.format_string(f"%.{places}f", value)
    trimmed = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, "—").when(unit.isNull() | (unit == ""), trimmed).otherwise(F.concat(trimmed, F.lit(" "), unit))


def flag_on(number: Column, text: Column) -> Column:
    """Is a flag set: a number other than 0, or one of the usual words."""
    return F.when(number.isNotNull(), number != 0).when(text.isNotNull(), F.lower(F.trim(text)).isin(*FLAGS_ON)).otherwise(False)


def to_lambda(value: Column, scale: Column, stoich: Column | float) -> Column:
    """A mixture as lambda: AFR by the fuel's stoichiometric ratio, EQ inverted (0: null), lambda as it is."""
    s = F.lit(stoich) if isinstance(stoich, float) else stoich
    return F.when(scale == "afr", value / s).when(scale == "eq", F.when(value != 0, F.lit(1.0) / value)).otherwise(value)


def detect_scale(header: Column, median: Column) -> Column:
    """struct<scale, basis, conflict>: declared unit, then name, then size of the (upper) median over 5.

    Values near one could be lambda or EQ: 'ratio-ambiguous', read as lambda.
    """
    unit = F.lower(F.trim(F.regexp_extract(header, r"\[([^\]]+)\]\s*$", 1)))
    name = F.lower(F.regexp_replace(header, r"\s*\[[^\]]*\]\s*$", ""))
    by_unit = F.when(unit.rlike("^(λ|lambda)$"), "lambda").when(unit.rlike("^(eq|equiv)"), "eq").when(unit.rlike("^afr$"), "afr")
    by_name = F.when(name.rlike(r"\blambda\b|λ"), "lambda").when(name.rlike(r"\beq\b|equiv"), "eq").when(name.rlike(r"\bafr\b"), "afr")
    by_size = F.when(median > 5, "afr").when(median.isNotNull(), "ratio-ambiguous")
    basis = F.when(by_unit.isNotNull(), "unit").when(by_name.isNotNull(), "name").when(median.isNotNull(), "magnitude").otherwise("no numeric samples")
    return F.struct(F.coalesce(by_unit, by_name, by_size).alias("scale"), basis.alias("basis"), F.coalesce(by_unit != by_name, F.lit(False)).alias("conflict"))
