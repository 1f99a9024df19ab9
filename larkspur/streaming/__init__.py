"""Streams: the engine's data model is batch only, so this package holds one thing, appending a file stream to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from larkspur.session import Session


def append_stream(session: Session, stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to a table, checked like an INSERT, one version for each batch.

    The last batch's number is kept with the table, so a batch that is replayed after a failure is not added twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        session.catalog = session.store.load()
        session.sync()
        t = session.table(table)
        if t.get("batch", -1) < number:
            session.append(table, df.toDF(*[c["name"] for c in t["columns"]]))
            session.table(table)["batch"] = number
            session.publish()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
