"""Text for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a report says about each form.
FORM_TEXTS = {
    "10-K": "Annual report providing comprehensive overview of business, financial condition, and results of operations. Required annually within 60-90 days of fiscal year end.",
    "10-Q": "Quarterly report with unaudited financial statements and updates on financial position. Filed within 40-45 days of quarter end for first three quarters.",
    "DEF 14A": "Definitive proxy statement sent to shareholders before annual meeting. Contains executive compensation details, board information, and voting matters.",
    "8-K": "Current report filed to announce major corporate events or changes within 4 business days of occurrence.",
    "S-1": "Registration statement for new securities, typically used for initial public offerings (IPOs).",
    "SC 13G": "Schedule filed by institutional investors disclosing beneficial ownership of 5% or more of a company's shares.",
    "SC 13D": "Schedule filed when acquiring beneficial ownership of 5% or more with intent to influence control of the company.",
}


#: From here on a double is a whole number, and the digits that name it are not all of its digits.
WHOLE = 2.0**53


def count_text(x: Column) -> Column:
    """All digits of a number, in groups; large whole numbers go by no double."""
    near = F.format_number(x.cast("double"), 0)
    return F.when(F.abs(x.cast("double")) < WHOLE, near).otherwise(F.coalesce(F.format_number(x.try_cast("bigint"), 0), near))


def currency(x: Column) -> Column:
    return F.concat(F.lit("$"), count_text(x))


def percent_of(a: Column, b: Column) -> Column:
    """a of b in per cent, no decimals; null for b = 0."""
    return F.replace(F.format_number(F.try_divide(a.cast("double"), b.cast("double")) * 100, 0), F.lit(","), F.lit(""))


def quotient(a: Column, b: Column) -> Column:
    """N/A for b = 0, null where either is unknown."""
    return F.when(b == 0, "N/A").otherwise(F.replace(count_text(F.try_divide(a.cast("double"), b.cast("double"))), F.lit(","), F.lit("")))


def per_employee(amount: Column, employees: Column) -> Column:
    each = F.concat(F.lit(' <span style="color: #666; font-size: 0.9em;">('), currency(amount / F.nullif(employees, F.lit(0))), F.lit("/employee)</span>"))
    return F.when(employees > 0, F.concat(currency(amount), each)).otherwise(currency(amount))


def form_text(form: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in FORM_TEXTS.items():
        out = F.when(form == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, F.concat(F.lit("SEC filing form "), form))


def trimmed(text: Column) -> Column:
    """All Unicode white space goes at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
