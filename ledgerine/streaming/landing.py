"""Returns that land as files, upserted or appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import TABLES, Store


def land(spark: SparkSession, folder: str, schema: str, store: Store, table: str, checkpoint: str, order: str = "updated_at", once: bool = True) -> StreamingQuery:
    """Parquet files of ``folder`` into a table, by key where it has one, else appended. A batch that is run again changes nothing: the table remembers the last number of this checkpoint."""
    stream = spark.readStream.schema(schema).parquet(folder)

    def put(batch: DataFrame, number: int) -> None:
        if TABLES[table]:
            store.store(table, batch, F.col(order), (checkpoint, number))
        else:
            store.append(table, batch, (checkpoint, number))

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
