"""Tax returns to facts, in expressions over the parsed return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import currency, escaped
from ..functions.numbers import some, year_before
from ..sources.readers import parsed_returns


def as_fraction(value: Column, start: Column, end: Column) -> Column:
    empty = F.lit("")
    period = F.struct(F.coalesce(start, empty).alias("start_date"), empty.alias("instant"), F.coalesce(end, empty).alias("end_date"))
    return F.struct(F.coalesce(value, F.lit(0)).cast("string").alias("content"), F.lit("0").alias("scale"), period.alias("period"))


def exec_table(people: Column, escape: bool = True) -> Column:
    """A table of name, title and pay; without people an empty one. Names are escaped unless told otherwise."""
    text = (lambda x: escaped(F.coalesce(x, F.lit("")))) if escape else (lambda x: F.coalesce(x, F.lit("")))
    zero = F.lit(0).cast("long")
    pay = lambda p: currency(F.coalesce(p["ReportableCompFromOrgAmt"], zero) + F.coalesce(p["OtherCompensationAmt"], zero))
    row = lambda p: F.concat(F.lit("<tr><td>"), text(p["PersonNm"]), F.lit("</td><td>"), text(p["TitleTxt"]), F.lit("</td><td>"), pay(p), F.lit("</td></tr>"))
    body = F.coalesce(F.array_join(F.transform(people, row), ""), F.lit(""))
    return F.concat(F.lit('<table style="font-family:monospace;"><thead><tr><th>Name</th><th>Title</th><th>Compensation</th></tr></thead><tbody>'), body, F.lit("</tbody></table>"))


def facts(xml: DataFrame, xml_col: str = "xml", ein_col: str = "ein", strict: bool = False) -> DataFrame:
    """One row per readable return; ``strict`` makes an unreadable one an error. The EIN is stamped from ``ein_col``."""
    rows = parsed_returns(xml, xml_col)
    rows = rows.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(True)) if strict else rows.where("error is null")
    zero = F.lit(0).cast("long")
    head, a, b = F.col("return.ReturnHeader"), F.col("return.ReturnData.IRS990"), F.col("return.ReturnData.IRS990EZ")
    start, end, kind = head["TaxPeriodBeginDt"], head["TaxPeriodEndDt"], F.col("return_type")
    amount = lambda x: F.coalesce(x, zero)
    before = year_before(F.coalesce(start, F.lit("")))
    filer = head["Filer"]["BusinessName"]["BusinessNameLine1Txt"]
    name = F.when(kind == "990", some(filer, a["PrincipalOfcrBusinessName"]["BusinessNameLine1Txt"])).otherwise(some(filer))
    net = F.when(kind == "990", amount(a["CYTotalRevenueAmt"]) - amount(a["CYTotalExpensesAmt"])).when(kind == "990EZ", amount(b["TotalRevenueAmt"]) - amount(b["TotalExpensesAmt"]))
    assets = F.when(kind == "990", amount(a["NetAssetsOrFundBalancesEOYAmt"])).when(kind == "990EZ", amount(b["NetAssetsOrFundBalancesEOYAmt"]))
    pay = F.array(as_fraction(a["CYSalariesCompEmpBnftPaidAmt"], start, end), as_fraction(a["PYSalariesCompEmpBnftPaidAmt"], before["start_date"], before["end_date"]))
    return rows.select(
        F.col(ein_col).alias("ein"), kind.alias("return_type"), F.coalesce(name, F.lit("")).alias("company_name"),
        F.when(kind == "990", amount(a["TotalEmployeeCnt"])).otherwise(zero).alias("employees_count"),
        F.when(net.isNotNull(), F.array(as_fraction(net, start, end))).alias("net_income_loss"),
        F.when(assets.isNotNull(), as_fraction(assets, start, end)).alias("net_assets"),
        F.when(kind == "990", pay).alias("worker_pay"),
        F.when(kind == "990", F.array(exec_table(a["Form990PartVIISectionAGrp"]))).alias("exec_compensation_html"),
    )
