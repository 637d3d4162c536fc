"""Entry points: identifiers in, records or raw returns out, from landed files and the store.

A batch of any number of identifiers is one plan: records that are fresh in the store are returned as they are; the others are made from the
files and stored. Files are opened by their paths, each once, so what nobody asks for is not read. What cannot be found is a reject
that says what was missing; for a single identifier it is a LookupError.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity
from ..functions.records import shaped
from ..operators import filings, store
from ..schemas import FACTS, SUBMISSIONS
from ..session import kept
from ..sources import ranged, readers
from . import irs, sec


def record(facts: DataFrame) -> DataFrame:
    """Facts of either source in the one schema of records; a figure of a return has its period as its context. What a source has not is null."""
    figure = lambda x: F.struct(x["content"].alias("content"), x["scale"].alias("scale"), F.struct(x["period"].alias("period")).alias("context"))
    columns = []
    for field in facts.schema:
        kind, own = field.dataType, F.col(field.name)
        if isinstance(kind, T.StructType) and "period" in kind.names:
            own = F.when(own.isNotNull(), figure(own))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and "period" in kind.elementType.names:
            own = F.transform(own, figure)
        columns.append(own.alias(field.name))
    given, wanted = facts.select(*columns), T._parse_datatype_string(FACTS)
    types = {f.name: f.dataType for f in given.schema}
    return given.select(*[(shaped(F.col(f.name), types[f.name], f.dataType) if f.name in types else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def plain_cik(cik: Column) -> Column:
    bare = F.ltrim(cik, F.lit("0"))
    return F.when(bare == "", F.lit("0")).otherwise(bare)


FILED = ("accession_number", "filing_date", "report_date", "form", "file_number", "is_xbrl", "is_inline_xbrl", "primary_document", "primary_doc_description")


@dataclass
class Service:
    """``tickers``: the directory file. ``submissions``: a folder of submissions, CIK and ten digits and .json each. ``documents``: a folder that mirrors
    filing URLs, cik/accession/document. ``index``: the return index. ``archives``: a folder of the archives that hold the returns. ``kept``: the keyed tables."""

    spark: SparkSession
    tickers: str
    submissions: str
    documents: str
    index: str
    archives: str
    kept: store.Store
    opener: ranged.Opener = ranged.opened

    def _named(self, wanted: DataFrame) -> DataFrame:
        """(kind, key, source, id) for (kind, key): the id under which a record is kept, null for an unknown ticker or kind."""
        asked = wanted.select("kind", F.col("key").cast("string").alias("key")).distinct()
        first = readers.tickers(self.spark, self.tickers).groupBy(F.upper("ticker").alias("_t")).agg(F.min_by("cik", "ord").cast("string").alias("_cik"))
        met = asked.join(first, (F.col("kind") == "ticker") & (F.upper("key") == F.col("_t")), "left")
        id_ = F.when(F.col("kind") == "ticker", F.col("_cik")).when(F.col("kind") == "cik", plain_cik(F.col("key"))).when(F.col("kind") == "ein", F.col("key"))
        return met.select("kind", "key", F.when(F.col("kind") == "ein", "IRS").otherwise("SEC").alias("source"), id_.alias("id"))

    def filings_for(self, ciks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of organisations (id): (documents of the newest annual and quarterly report and proxy statement with error, names), written once."""
        file = F.concat(F.lit(f"{self.submissions}/CIK"), identity.padded_cik(F.col("id")), F.lit(".json"))
        raw = ranged.contents(ciks.select("id"), file, ["id"], self.opener)
        own = kept(raw.select("id", F.from_json(F.decode("content", "UTF-8"), SUBMISSIONS, {"mode": "FAILFAST"}).alias("s")).where("s is not null").select(F.col("id").alias("cik"), "s.name", "s.filings"))
        chosen = filings.first_per_form(filings.filing_rows(own))
        url = identity.filing_url(F.col("cik"), F.col("accession_number"), F.col("primary_document"))
        path = F.concat(F.lit(self.documents), F.lit("/"), F.regexp_extract(url, r"([^/]+/[^/]+/[^/]+)$", 1))
        docs = ranged.contents(chosen.withColumnRenamed("ord", "doc_ord"), path, ["cik", "doc_ord", *FILED], self.opener)
        first = filings.cik_to_ticker(readers.tickers(self.spark, self.tickers).withColumn("cik", F.col("cik").cast("string")))
        return kept(docs), own.select("cik", F.col("name").alias("company_name")).join(first, "cik", "left")

    def returns_for(self, eins: DataFrame) -> DataFrame:
        """(id, ein, archive, member, xml, error) of EINs (id), compared without case: the first return of a supported type in the order of the index; no row without one."""
        index = readers.return_index(self.spark, self.index).where(filings.supported(F.col("RETURN_TYPE")))
        met = index.withColumn("_e", F.lower("EIN")).join(eins.select("id", F.lower("id").alias("_e")), "_e")
        first = kept(filings.first_by(met.select("id", "EIN", "XML_BATCH_ID", "OBJECT_ID", "row_ord"), ["id"], F.col("row_ord")).drop("row_ord"))
        archive = F.concat(F.lit(f"{self.archives}/"), identity.archive_name(F.col("XML_BATCH_ID")))
        found = ranged.members(first.withColumnRenamed("EIN", "ein"), archive, identity.archive_member(F.col("XML_BATCH_ID"), F.col("OBJECT_ID")), ["id", "ein"], self.opener)
        return found.select("id", "ein", "archive", "member", F.decode("content", "UTF-8").alias("xml"), "error")

    def facts_for(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """For (kind, key), of kind ticker (any case), cik or ein: (records with kind and key, rejects (kind, key, reason)), all in one run."""
        named = kept(self._named(wanted))
        ids = named.where("id is not null").select("source", "id").distinct()
        known = self.kept.matching("facts", ids)
        fresh = None if known is None else known.join(store.stale(ids.select("id"), known, "id", F.current_timestamp()).where("not stale").select("id"), "id", "left_semi")
        if fresh is not None:
            fresh = kept(fresh)
            ids = ids.join(fresh.select("id"), "id", "left_anti")
        ids = kept(ids)
        docs, names = self.filings_for(ids.where("source = 'SEC'"))
        made = record(sec.facts(docs.where("content is not null").drop("path", "error"), names))
        returns = kept(self.returns_for(ids.where("source = 'IRS'")))
        readable = kept(irs.facts(returns.where("xml is not null").drop("ein"), ein_col="id").withColumns({"cik": F.lit(""), "ticker": F.lit("")}))
        made = kept(store.facts_rows(made.unionByName(record(readable)), now=F.current_timestamp()))
        if not made.isEmpty():
            self.kept.store("facts", made)
        records = made if fresh is None else made.unionByName(fresh.select(*made.columns))
        out = named.select("kind", "key", "id").join(records, "id")
        filed = docs.groupBy(F.col("cik").alias("id")).agg(F.first("error").alias("_error")).withColumn("_stage", F.lit("document"))
        found = returns.select("id", F.coalesce("error", F.lit("the return cannot be read")).alias("_error"), F.lit("return").alias("_stage"))
        missing = named.join(records.select("id").distinct(), "id", "left_anti").join(filed.unionByName(found), "id", "left")
        reason = (
            F.when(F.col("id").isNull(), F.concat(F.lit("no "), "kind", F.lit(" "), F.coalesce("key", F.lit(""))))
            .when(F.col("_stage") == "document", F.concat(F.lit("no document: "), F.coalesce("_error", F.lit(""))))
            .when(F.col("_stage") == "return", F.concat(F.lit("no return: "), "_error"))
            .when(F.col("source") == "SEC", F.lit("no supported filing"))
            .otherwise(F.lit("no supported return"))
        )
        return out, missing.select("kind", "key", reason.alias("reason"))

    def _one(self, kind: str, key: str) -> DataFrame:
        found, rejects = self.facts_for(self.spark.createDataFrame([(kind, key)], "kind string, key string"))
        if (row := rejects.first()) is not None:
            raise LookupError(f"{kind} {key}: {row['reason']}")
        return found.drop("kind", "key")

    def facts_for_ticker(self, ticker: str) -> DataFrame:
        """One row; the ticker is compared without case."""
        return self._one("ticker", ticker)

    def facts_for_cik(self, cik: str) -> DataFrame:
        """One row, from the newest annual and quarterly report and proxy statement."""
        return self._one("cik", cik)

    def facts_for_ein(self, ein: str) -> DataFrame:
        """One row, from the return that ``irs_return_xml`` gives."""
        return self._one("ein", ein)

    def irs_return_xml(self, ein: str) -> DataFrame:
        """(ein, xml): the first return of a supported type; compared without case."""
        found = kept(self.returns_for(self.spark.createDataFrame([(ein,)], "id string")))
        row = found.select("member", "error").first()
        if row is None or row["error"] is not None:
            raise LookupError(f"no supported return of {ein}" if row is None else f"no file {row['member']} of {ein}: {row['error']}")
        return found.select("ein", "xml")
