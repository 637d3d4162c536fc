"""Identifiers, paths and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"


def padded_cik(cik: Column) -> Column:
    """Ten digits; a longer one stays as it is."""
    return F.when(F.length(cik) < 10, F.lpad(cik, 10, "0")).otherwise(cik)


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(F.lit(ARCHIVE), cik, F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def archive_member(batch: Column, object_id: Column) -> Column:
    return F.concat(F.upper(batch), F.lit("/"), object_id, F.lit("_public.xml"))


def archive_name(batch: Column) -> Column:
    return F.concat(F.upper(batch), F.lit(".zip"))


def facts_key(cik: Column, ein: Column) -> Column:
    """(id, source type): the CIK if there is one, else the EIN; null for neither."""
    a, b = F.nullif(cik, F.lit("")), F.nullif(ein, F.lit(""))
    return F.struct(F.coalesce(a, b).alias("id"), F.when(a.isNotNull(), "SEC").when(b.isNotNull(), "IRS").alias("source_type"))
