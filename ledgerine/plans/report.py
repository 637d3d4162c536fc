"""Report rows: the sections of a record as tall rows, empty sections left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import count_text, currency, per_employee, percent_of, quotient
from ..functions.numbers import period_label, scaled_number


def net_label(ticker: Column) -> Column:
    return F.when(F.coalesce(ticker, F.lit("")) != "", "Net Profit or Loss").otherwise("Net Revenues")


def report_rows(facts: DataFrame, sections: dict[str, Column]) -> DataFrame:
    """(id, section, ord, period, amount, per_employee): ``sections`` maps a column of facts (content, scale, period) to its label."""
    def section(c: str, label: Column) -> Column:
        items = F.coalesce(F.col(c), F.array().cast(facts.schema[c].dataType))
        return F.transform(items, lambda x, i: F.struct(label.alias("section"), i.alias("ord"), x["period"].alias("p"), x["content"].alias("c"), x["scale"].alias("s")))

    parts = F.flatten(F.array(*[section(c, label) for c, label in sections.items()]))
    rows = facts.select("id", "employees_count", F.explode(parts).alias("r"))
    amount = scaled_number(F.col("r.c"), F.col("r.s"))
    return rows.select("id", "r.section", "r.ord", period_label(F.col("r.p")).alias("period"), currency(amount).alias("amount"), per_employee(amount, F.col("employees_count")).alias("per_employee"))


def whole_report(records: DataFrame) -> DataFrame:
    """(id, section, section_ord, ord, period, amount, per_employee): records in their one schema (``service.record``), as the report reads from top to bottom.

    The name stands in the heading with the ticker, or the EIN without one. Sections of figures have a row for each period; head-count and
    tables of pay have none; the pay ratio has the median's pay with its share of the chief's in percent, the chief's, and how many times it is the median's.
    """
    empty, ticker, staff = F.lit(""), F.coalesce(F.col("ticker"), F.lit("")), F.coalesce(F.col("employees_count"), F.lit(0))
    row = lambda period, amount, each: F.struct(period.alias("period"), amount.alias("amount"), each.alias("per_employee"))

    def figures(items: Column) -> Column:
        def one(x: Column) -> Column:
            amount = scaled_number(x["content"], x["scale"])
            return row(period_label(x["context"]["period"]), currency(amount), per_employee(amount, staff))

        return F.transform(items, one)

    ratio = F.col("ceo_pay_ratio")
    parts = [
        (F.lit("Heading"), F.array(row(empty, F.concat(F.coalesce("company_name", empty), F.lit(" ("), F.when(ticker != "", ticker).otherwise(F.coalesce("ein", empty)), F.lit(")")), empty))),
        (F.lit("Number of employees"), F.when(staff != 0, F.array(row(empty, count_text(staff), empty)))),
        (F.lit("Net Assets"), F.when(F.col("net_assets").isNotNull(), figures(F.array("net_assets")))),
        (F.lit("CEO Pay Ratio"), F.when(ratio.isNotNull(), F.array(
            row(F.lit("Median employee compensation"), currency(ratio["median"]), F.concat(percent_of(ratio["median"], ratio["ceo"]), F.lit("%"))),
            row(F.lit("CEO compensation"), currency(ratio["ceo"]), F.lit("100%")),
            row(F.lit("Workers at the median salary"), F.coalesce(quotient(ratio["ceo"], ratio["median"]), F.lit("N/A")), empty),
        ))),
        (net_label(ticker), figures(F.col("net_income_loss"))),
        (F.lit("Stock Buybacks"), figures(F.col("buybacks"))),
        (F.lit("Cash and Cash Equivalents"), figures(F.col("cash"))),
        (F.lit("Worker Pay"), figures(F.col("worker_pay"))),
        (F.lit("Executive Compensation"), F.transform(F.col("exec_compensation_html"), lambda x: row(empty, x, empty))),
    ]
    key = F.when(F.coalesce("cik", empty) != "", F.col("cik")).otherwise(F.col("ein"))
    sections = F.array(*[F.struct(label.alias("section"), F.lit(i).alias("section_ord"), rows.alias("rows")) for i, (label, rows) in enumerate(parts)])
    each = records.select(key.alias("id"), F.inline(sections)).where("rows is not null")
    return each.select("id", "section", "section_ord", F.posexplode("rows").alias("ord", "r")).select("id", "section", "section_ord", "ord", "r.*")
