"""Price sheets that keep arriving: the batch upsert, once per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shelfmark import schema
from shelfmark.operators.onboarding import upsert_price_sheet


def stream_price_sheets(spark: SparkSession, sheets: DataFrame, catalogue_path: str, checkpoint: str) -> StreamingQuery:
    """Upsert each micro-batch of price-sheet rows into a catalogue kept in numbered versions.

    Version n is written from version n-1, so a batch that is replayed after a failure rewrites its own version and
    changes nothing else.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.schema(schema.CATALOGUE).parquet(f"{catalogue_path}/version={batch_id}")
        after = upsert_price_sheet(before, schema.conform(batch, schema.PRICE_SHEET)).drop("upsert")
        after.write.mode("overwrite").parquet(f"{catalogue_path}/version={batch_id + 1}")

    return sheets.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
