"""Keeping a graph's emissions up to date from a stream of files: an extension of batch building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources import files as f
from ..sources import sqltext


def watch_sql(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """stream: (repo_idx, source_repo, rel_path, content) of new or changed files. Each batch appends its emissions under the target folder, by batch, so that a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        graph = sqltext.extract(f.classified(batch))
        graph.nodes.write.mode("overwrite").parquet(f"{target}/nodes/batch={number}")
        graph.edges.write.mode("overwrite").parquet(f"{target}/edges/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
