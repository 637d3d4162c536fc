"""Schemas of inputs and of the normalised record, as DDL."""

from collections.abc import Iterable

PERIOD = "struct<start_date:string,instant:string,end_date:string>"
MEMBERS = "array<struct<dimension:string,content:string>>"
CONTEXT = f"struct<id:string,entity:struct<identifier:struct<scheme:string,content:string>,segment:struct<explicit_members:{MEMBERS},typed_members:{MEMBERS}>>,period:{PERIOD}>"
NON_FRACTION = f"struct<unit_ref:string,decimals:string,name:string,format:string,scale:string,id:string,content:string,context_ref:string,context:{CONTEXT}>"
FILING = "struct<cik:string,accession_number:string,filing_date:string,report_date:string,form:string,file_number:string,is_xbrl:int,is_inline_xbrl:int,primary_document:string,primary_doc_description:string>"
FACTS = (
    f"cik string, ein string, ticker string, company_name string, filings array<{FILING}>, net_income_loss array<{NON_FRACTION}>, buybacks array<{NON_FRACTION}>, "
    f"cash array<{NON_FRACTION}>, worker_pay array<{NON_FRACTION}>, net_assets {NON_FRACTION}, exec_compensation_html array<string>, "
    "ceo_pay_ratio struct<text:string,ceo:double,median:double>, employees_count bigint, total_revenue bigint, total_expenses bigint"
)

TICKERS = "map<string,struct<cik_str:bigint,ticker:string,title:string>>"
RECENT = (
    "struct<accessionNumber:array<string>,filingDate:array<string>,reportDate:array<string>,form:array<string>,fileNumber:array<string>,"
    "isXBRL:array<int>,isInlineXBRL:array<int>,primaryDocument:array<string>,primaryDocDescription:array<string>>"
)
SUBMISSIONS = f"cik string, name string, tickers array<string>, exchanges array<string>, filings struct<recent:{RECENT}>"

NODES = "node_id int, subtree_end int, parent_id int, depth int, sib int, kind string, tag string, attrs map<string,string>, data string, content string, is_leaf boolean, parent_is_leaf boolean, emit string, outer_html string, lost boolean"

#: What the plans read of a return, and no more: a schema inside from_xml is not pruned by the optimiser.
RETURN_FIELDS = (
    "_returnVersion string",
    *(f"ReturnHeader.{x} string" for x in ("ReturnTypeCd", "TaxPeriodBeginDt", "TaxPeriodEndDt", "Filer.EIN", "Filer.BusinessName.BusinessNameLine1Txt", "Filer.BusinessName.BusinessNameLine2Txt")),
    *(f"IRS990.{x} bigint" for x in ("TotalEmployeeCnt", "CYTotalRevenueAmt", "CYTotalExpensesAmt", "NetAssetsOrFundBalancesEOYAmt", "CYSalariesCompEmpBnftPaidAmt", "PYSalariesCompEmpBnftPaidAmt")),
    *(f"IRS990.PrincipalOfcrBusinessName.{x} string" for x in ("BusinessNameLine1Txt", "BusinessNameLine2Txt")),
    *(f"IRS990.Form990PartVIISectionAGrp[].{x}" for x in ("PersonNm string", "TitleTxt string", "ReportableCompFromOrgAmt bigint", "OtherCompensationAmt bigint")),
    *(f"IRS990EZ.{x} bigint" for x in ("TotalRevenueAmt", "TotalExpensesAmt", "NetAssetsOrFundBalancesEOYAmt")),
    "IRS990PF.FMVAssetsEOYAmt bigint",
)


def return_schema(fields: Iterable[str] = ()) -> str:
    """DDL of a return with what the plans read and ``fields`` besides, of any form, schedule or attachment.

    A field is a dotted path of element names and a type: ``IRS990ScheduleA.PublicSupportTotal170Amt bigint``. ``[]`` behind a name: it may
    occur more than once; ``_name``: an attribute; ``_VALUE``: the text of an element with attributes. Paths begin in the header if their first name says so, else in the
    data. A field may be named twice; a path that is both a value and an element with others inside, or has two types, is an error.
    """
    root: dict[str, tuple[bool, str | dict]] = {}
    for field in (*RETURN_FIELDS, *fields):
        path, _, kind = field.strip().partition(" ")
        names = path.split(".")
        if not kind or not all(x.removesuffix("[]") for x in names):
            raise ValueError(f"no path and type: {field!r}")
        if names[0] not in ("_returnVersion", "ReturnHeader"):
            names.insert(0, "ReturnData")
        at = root
        for i, name in enumerate(names):
            many, new = name.endswith("[]"), kind.strip() if i == len(names) - 1 else {}
            own = at.setdefault(name.removesuffix("[]"), (many, new))
            if own[0] != many or type(own[1]) is not type(new) or isinstance(new, str) and own[1] != new:
                raise ValueError(f"{field!r} does not fit another field")
            at = own[1]

    def typed(node: tuple[bool, str | dict]) -> str:
        many, kind = node
        own = kind if isinstance(kind, str) else "struct<" + ",".join(f"`{k}`:{typed(v)}" for k, v in kind.items()) + ">"
        return f"array<{own}>" if many else own

    return ", ".join(f"`{k}` {typed(v)}" for k, v in root.items()) + ", _corrupt_record string"


RETURN = return_schema()
#: Return types that are fetched; 990PF is recognised when it is met but never asked for.
SUPPORTED = ("990", "990EZ")
INDEX_COLUMNS = ("RETURN_ID", "EIN", "TAXPAYER_NAME", "RETURN_TYPE", "XML_BATCH_ID", "OBJECT_ID")
