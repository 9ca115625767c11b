"""Points arriving as a stream, snapped to a static graph (stateless stream-static join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.overlay import snap


def snap_stream(points: DataFrame, nodes: DataFrame, cell: float, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is snapped and appended to ``path``; batch ids make reruns of a batch overwrite their own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        snap(batch, nodes, cell).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
