"""New rows placed by a fitted landmark model as they arrive. Stateless: each micro-batch is projected on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.landmarks import LandmarkModel, project_rows


def project_stream(model: LandmarkModel, rows: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Start a query that writes id, features (coordinates) of the streamed (id, features) rows to Parquet folder ``out``.

    A batch is written to a folder of its own number and replaced when it is run again, so a restart repeats nothing.
    """

    def place(batch: DataFrame, number: int) -> None:
        project_rows(model, batch, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(place).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
