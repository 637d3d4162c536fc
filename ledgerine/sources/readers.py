"""Sources as DataFrames. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INDEX_COLUMNS, RETURN, SUBMISSIONS, TICKERS


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """(ord, cik, ticker, title) from a JSON map; a malformed file is an error."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", TICKERS, {"mode": "FAILFAST"})
    entries = raw.select(F.posexplode(F.map_entries(m)).alias("ord", "e"))
    return entries.select("ord", F.col("e.value.cik_str").alias("cik"), F.col("e.value.ticker").alias("ticker"), F.col("e.value.title").alias("title"))


def submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSIONS).option("multiLine", True).option("mode", "FAILFAST").json(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): filing documents as bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def return_index(spark: SparkSession, path: str) -> DataFrame:
    """The six required columns, found by header name, and ``row_ord``; a missing one is an error.

    ``row_ord`` orders rows by the name of their file, the place of the file's part that a task reads and their place in it, so the order is that
    of the files whatever sizes they have and however they are dealt to tasks.
    """
    rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    if missing := [c for c in INDEX_COLUMNS if c not in rows.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return rows.select(*INDEX_COLUMNS, place.alias("row_ord"))


def archive_members(wanted: DataFrame, archives: DataFrame) -> DataFrame:
    """(zip_path, member, content) for rows of ``wanted`` (zip_path, member): null content where there is no such member.

    For stores that only Spark reads: ``archives`` (path, content) holds whole archives, 2 GB at most, one row for each however many members
    are wanted. Where ranges can be read, ``ranged.members`` moves no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, names, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                try:
                    archive = zipfile.ZipFile(pa.BufferReader(data.as_buffer())) if data.is_valid else None
                except zipfile.BadZipFile:
                    archive = None
                for name in names:
                    try:
                        content = None if archive is None or name is None else archive.read(name)
                    except (KeyError, zipfile.BadZipFile, zlib.error):
                        content = None
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([name], pa.string()), pa.array([content], pa.binary())], ["zip_path", "member", "content"])

    names = wanted.groupBy("zip_path").agg(F.collect_list(F.struct("member")).alias("names")).select("zip_path", F.transform("names", lambda x: x["member"]).alias("names"))
    met = names.join(archives.select(F.col("path").alias("zip_path"), F.col("content").alias("archive")), "zip_path", "left").select("zip_path", "names", "archive")
    return met.mapInArrow(run, "zip_path string, member string, content binary")


def parsed_returns(xml: DataFrame, xml_col: str = "xml", schema: str = RETURN) -> DataFrame:
    """Adds ``return``, ``return_type`` and ``error``: null, "corrupt", "missing return type", "unsupported return type" or "missing body".

    ``schema``: ``return_schema`` of the fields that are wanted beyond those of the plans."""
    parsed = F.from_xml(F.col(xml_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    once = xml.select("*", F.explode(F.array(parsed)).alias("return"))  # as a plain column it would be parsed again for each field and filter
    out = once.withColumn("return_type", F.col("return.ReturnHeader.ReturnTypeCd"))
    body = F.when(F.col("return_type") == "990", F.col("return.ReturnData.IRS990").isNotNull()).when(F.col("return_type") == "990EZ", F.col("return.ReturnData.IRS990EZ").isNotNull()).when(F.col("return_type") == "990PF", F.col("return.ReturnData.IRS990PF").isNotNull())
    error = (
        F.when(F.col("return").isNull() | F.col("return._corrupt_record").isNotNull(), "corrupt")
        .when(F.coalesce("return_type", F.lit("")) == "", "missing return type")
        .when(body.isNull(), "unsupported return type")
        .when(~body, "missing body")
    )
    return out.withColumn("error", error)
