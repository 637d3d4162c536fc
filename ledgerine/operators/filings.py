"""Selecting filings and looking up identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SUPPORTED

PATTERNS = ("10-K", "10-Q", "DEF 14A")
FIELDS = {"accessionNumber": "accession_number", "filingDate": "filing_date", "reportDate": "report_date", "form": "form", "fileNumber": "file_number", "isXBRL": "is_xbrl", "isInlineXBRL": "is_inline_xbrl", "primaryDocument": "primary_document", "primaryDocDescription": "primary_doc_description"}


def filing_rows(submissions: DataFrame) -> DataFrame:
    """(cik, pos, fields): parallel arrays as rows."""
    zipped = F.arrays_zip(*[F.col(f"filings.recent.{k}").alias(k) for k in FIELDS])
    rows = submissions.select("cik", F.posexplode(zipped).alias("pos", "r"))
    return rows.select("cik", "pos", *[F.col("r").getField(k).alias(v) for k, v in FIELDS.items()])


def first_per_form(filings: DataFrame, patterns: tuple[str, ...] = PATTERNS, exact: bool = False) -> DataFrame:
    """For each cik and pattern the first filing whose form contains it (or equals it, if ``exact``), in the patterns' order: one pass, no join."""
    wanted = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("pattern")) for i, p in enumerate(patterns)])
    fits = (lambda x: F.col("form") == x["pattern"]) if exact else (lambda x: F.contains(F.col("form"), x["pattern"]))
    rows = filings.withColumn("w", F.explode(F.filter(wanted, fits)))
    best = rows.groupBy("cik", F.col("w.ord").alias("ord"), F.col("w.pattern").alias("pattern")).agg(F.min_by(F.struct(*[c for c in filings.columns if c != "cik"]), "pos").alias("f"))
    return best.select("cik", "ord", "pattern", "f.*")


def ticker_to_cik(tickers: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(tickers.select("ticker", "cik", "title"), "ticker", "left")


def cik_to_ticker(tickers: DataFrame) -> DataFrame:
    """One ticker a cik: the first in the directory."""
    return tickers.groupBy("cik").agg(F.min_by("ticker", "ord").alias("ticker"))


def first_by(rows: DataFrame, keys: list[str], order: Column, where: Column | None = None) -> DataFrame:
    """The first row of each key; an aggregation that combines before the exchange, so a hot key is no burden."""
    rows = rows if where is None else rows.where(where)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def supported(return_type: Column) -> Column:
    return return_type.isin(*SUPPORTED)


def first_return(index: DataFrame, ein: str) -> DataFrame:
    """The first supported row of an EIN, compared without case."""
    hits = index.where((F.lower("EIN") == ein.lower()) & supported(F.col("RETURN_TYPE")))
    return hits.orderBy("row_ord").limit(1)


def with_documents(filings: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Filings whose document was read; the others are left out."""
    return filings.join(documents.where("content is not null"), keys)
