"""Numbers, periods and money as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
DOLLARS = r"\$[\d,]+(?:\.\d{2})?"
HEADCOUNT = r"([\d]{1}[\d,]{1,})[^.,%]*employees"


def scale_factor(scale: Column) -> Column:
    """10 to the scale; 1 where it is no whole number."""
    exponent = F.when(scale.rlike(r"^[+-]?\d+$"), scale.try_cast("int"))
    return F.coalesce(F.pow(F.lit(10.0), exponent), F.lit(1.0))


def plain_number(content: Column) -> Column:
    """Commas stripped; 0 where it is no number. Signs outside the content and formats do not count."""
    bare = F.replace(content, F.lit(","), F.lit(""))
    return F.coalesce(F.when(bare.rlike(NUMBER), bare.try_cast("double")), F.lit(0.0))


def scaled_number(content: Column, scale: Column, sign: Column | None = None) -> Column:
    """``sign`` (an attribute holding "-") is heeded only if given."""
    out = scale_factor(scale) * plain_number(content)
    return out if sign is None else F.when(sign == "-", -out).otherwise(out)


def only_number(text: Column) -> Column:
    """The digits alone as a number; 0 for none or too many."""
    return F.coalesce(F.regexp_replace(text, r"\D", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def period_label(period: Column) -> Column:
    instant = period["instant"]
    return F.when(F.coalesce(instant, F.lit("")) != "", instant).otherwise(F.concat(F.coalesce(period["start_date"], F.lit("")), F.lit(" thru "), F.coalesce(period["end_date"], F.lit(""))))


def some(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in texts])


def as_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def latest_date(period: Column) -> Column:
    """End, instant or start; a date before all others where none can be read."""
    return F.coalesce(as_date(some(period["end_date"], period["instant"], period["start_date"])), F.lit("0001-01-01").cast("date"))


def year_before(date: Column) -> Column:
    """(365 days earlier, the day before); both empty for a bad date."""
    d = as_date(date)
    text = lambda days: F.coalesce(F.date_format(F.date_sub(d, days), "yyyy-MM-dd"), F.lit(""))
    return F.struct(text(365).alias("start_date"), text(1).alias("end_date"))


def dollar_amounts(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(DOLLARS), F.lit(0)), lambda x: F.regexp_replace(x, r"[$,]", "").try_cast("double"))
    return F.filter(found, lambda x: x.isNotNull())


def pay_ratio(text: Column) -> Column:
    """Largest and smallest amount of at least two; 0 for fewer."""
    found = dollar_amounts(text)
    enough = F.size(found) >= 2
    return F.struct(text.alias("text"), F.when(enough, F.array_max(found)).otherwise(0.0).alias("ceo"), F.when(enough, F.array_min(found)).otherwise(0.0).alias("median"))


def headcount(text: Column, robust: bool = False) -> Column:
    """The number before "employees" in a text that names December: the first match only, and no bare year. ``robust`` asks for three digits and no comma at the end."""
    found = F.regexp_extract(text, HEADCOUNT, 1)
    ok = F.contains(F.lower(text), F.lit("december")) & (found != "") & ~(F.startswith(found, F.lit("20")) & (F.length(found) == 4))
    if robust:
        ok = ok & (F.length(F.regexp_replace(found, r"\D", "")) >= 3) & ~F.endswith(found, F.lit(","))
    return F.when(ok, found)
