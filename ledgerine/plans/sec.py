"""Filings to facts: one pass over the nodes of each document, then one row per organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import headcount, latest_date, only_number, pay_ratio
from ..operators.extract import Wanted, extracts
from ..schemas import NON_FRACTION

CONCEPTS = {
    "buybacks": "us-gaap:StockRepurchasedDuringPeriodValue",
    "net_income_loss": "us-gaap:NetIncomeLoss",
    "cash": "us-gaap:CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
}
BUDGET = 700
FACT = ("unit_ref", "decimals", "name", "format", "scale", "id", "content", "context_ref", "context")


def metrics(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The first fact of each concept in each document, all concepts in one aggregation."""
    first = lambda name: F.min_by(F.when(F.col("name") == name, F.struct(*FACT)), F.when(F.col("name") == name, F.col("node_id")))
    return facts.where(F.col("type") == "NonFraction").where(F.col("name").isin(*CONCEPTS.values())).groupBy(*keys).agg(*[first(v).alias(k) for k, v in CONCEPTS.items()])


def newest_first(items: Column) -> Column:
    """An array of (doc_ord, fact) by latest date, ties in document order, to facts."""
    day = lambda x: F.coalesce(F.datediff(latest_date(x["fact"]["context"]["period"]), F.lit("0001-01-01")), F.lit(0))
    keyed = F.transform(items, lambda x: F.struct((-day(x)).alias("d"), x["doc_ord"].alias("o"), x["fact"].alias("fact")))
    return F.transform(F.array_sort(keyed), lambda x: x["fact"])


#: What the plan takes from a document: facts of its concepts, text behind headings on pay, leaves that may state a head-count, pay tables.
WANTED = Wanted(
    facts=frozenset(CONCEPTS.values()),
    leaf=lambda t: "employees" in t and "december" in t.lower(),
    anchor=lambda t: "ceo pay ratio" in t.lower(),
    budget=BUDGET,
    table=lambda t: "Name" in t and "$" in t and "Salary" in t,
)


def of_documents(documents: DataFrame, keys: list[str], html_col: str = "content", robust: bool = False, tasks: int | None = None) -> DataFrame:
    """A row a document, from one parse: ``keys``, the first fact of each concept, ``ratios`` (node_id, ratio), ``employees`` (node_id, employees) and ``pay_tables``.

    Ratios are those of anchors whose following text names dollars and a median; head-counts those above 0.
    """
    first = lambda name: F.get(F.filter("facts", lambda x: (x["type"] == "NonFraction") & (x["name"] == name)), F.lit(0))
    fact = lambda x: F.when(x.isNotNull(), F.struct(*[x[f].alias(f) for f in FACT]))
    fits = F.filter("anchors", lambda x: F.contains(x["text"], F.lit("$")) & F.contains(x["text"], F.lit("median")))
    ratios = F.transform(fits, lambda x: F.struct(x["node_id"].alias("node_id"), pay_ratio(x["text"]).alias("ratio")))
    staff = F.transform("leaves", lambda x: F.struct(x["node_id"].alias("node_id"), F.coalesce(only_number(headcount(x["text"], robust)), F.lit(0)).alias("employees")))
    found = extracts(documents, keys, html_col, WANTED, tasks)
    return found.select(*keys, *[fact(first(v)).alias(k) for k, v in CONCEPTS.items()], ratios.alias("ratios"), F.filter(staff, lambda x: x["employees"] > 0).alias("employees"), F.transform("tables", lambda x: x["outer_html"]).alias("pay_tables"))


def facts(documents: DataFrame, names: DataFrame, filing_fields: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """documents: cik, doc_ord, content and fields of the filing; names: cik, ticker, company_name. One row per cik of ``documents``.

    Each document is parsed once and its row carries all that was found, so an organisation's documents meet in one aggregation.
    """
    fields = filing_fields or [c for c in documents.columns if c not in ("content", "cik", "doc_ord")]
    own = documents.withColumn("_filing", F.struct("doc_ord", *fields))
    found = of_documents(own, ["cik", "doc_ord", "_filing"], tasks=tasks)
    per = found.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct("doc_ord", F.struct(*[c for c in found.columns if c not in ("cik", "doc_ord")]).alias("d")))).alias("l"))
    of = lambda c: newest_first(F.filter(F.transform("l", lambda x: F.struct(x["doc_ord"].alias("doc_ord"), x["d"][c].alias("fact"))), lambda x: x["fact"].isNotNull()))
    some_ = lambda a: F.when(F.size(a) > 0, a)
    first = lambda c, f: F.get(F.flatten(F.transform("l", lambda x: F.transform(x["d"][c], lambda y: y[f]))), F.lit(0))
    none = F.lit(None)
    return per.join(names, "cik", "left").select(
        "cik", F.lit("").alias("ein"), F.coalesce("ticker", F.lit("")).alias("ticker"), F.coalesce("company_name", F.lit("")).alias("company_name"), F.transform("l", lambda x: x["d"]["_filing"]).alias("filings"),
        *[some_(of(c)).alias(c) for c in CONCEPTS], none.cast(f"array<{NON_FRACTION}>").alias("worker_pay"), none.cast(NON_FRACTION).alias("net_assets"), some_(F.flatten(F.transform("l", lambda x: x["d"]["pay_tables"]))).alias("exec_compensation_html"),
        first("ratios", "ratio").alias("ceo_pay_ratio"), F.coalesce(first("employees", "employees"), F.lit(0).cast("long")).alias("employees_count"), F.lit(0).cast("long").alias("total_revenue"), F.lit(0).cast("long").alias("total_expenses"),
    )
