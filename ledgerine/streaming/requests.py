"""Requests as a stream: what was answered is kept, so nothing is asked for twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store
from ..session import kept
from ..sources import fetch


def open_requests(batch: DataFrame, store: Store, retry: bool = False) -> DataFrame:
    """Distinct URLs of a batch that have no answer yet; with ``retry`` those whose answer is an error too. Only the buckets of the batch are looked at."""
    urls = batch.where("url is not null").select("url").distinct()
    known = store.matching("answers", urls)
    if known is None:
        return urls
    return urls.join(known.where("error is null" if retry else "true").select("url"), "url", "left_anti")


def answer(spark: SparkSession, folder: str, store: Store, checkpoint: str, get: fetch.Get, rate: float = fetch.RATE, tasks: int = 4, files: int = 10, retry: bool = False, once: bool = True) -> StreamingQuery:
    """Requests (JSON lines with ``url``) of a folder, ``files`` files a batch, into the table ``answers`` (url, content, error, asked_at).

    A batch asks under one rate for all tasks together. Its answers are written before they are stored, and the table remembers the number of
    the batch; one that is run again, as after a restart, finds its answers there. Only answers of a batch that died before they were stored are lost.
    """

    def put(batch: DataFrame, number: int) -> None:
        urls = kept(open_requests(batch, store, retry))
        if urls.isEmpty():
            return
        found = fetch.fetched(urls, F.col("url"), get, rate, tasks=tasks).withColumn("asked_at", F.current_timestamp())
        store.store("answers", kept(found), F.col("asked_at"), (checkpoint, number))

    stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", files).json(folder)
    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
