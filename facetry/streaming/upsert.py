"""Continuous upserts, deletes and expiry: an append-only folder of operations, merged batch by batch.

Operations are JSON files.  The checkpoint says which are merged, so a restart replays only the rest; a batch that
is replayed gives the same rows, since operations carry their own order and clock.  Lines that are no JSON are left
out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.sources import ingest
from facetry.sources.collection import Collection


def append_operations(spark: SparkSession, folder: str, ops: DataFrame) -> None:
    """Appends to the log: one file for each call, so that batches, which take files by age, keep the log's order.

    A call is one request's operations; the file appears when it is whole.  Inside it they lie in any order, as the last one by number counts:
    the task that writes it only passes them on, and its memory does not grow with them.
    """
    ops.select(*[f.name for f in ingest.OPERATION]).repartition(1).write.mode("append").json(folder)


def read_operations(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(ingest.OPERATION).option("maxFilesPerTrigger", files_per_batch).option("mode", "DROPMALFORMED").json(folder)


def merge_batches(ops: DataFrame, collection: Collection, checkpoint: str, sweep_at=None, trigger: dict | None = None):
    """Starts a query that merges each batch into the collection's next version.

    ``sweep_at`` gives the clock (epoch ms) of a batch, for removing what has expired by then.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        top = batch.agg(F.max("seq")).first()[0]
        if top is None:
            return
        collection.apply(batch, top + 1, report=False, epoch=(checkpoint, epoch))
        if sweep_at is not None:
            collection.sweep(sweep_at(epoch))

    return ops.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
