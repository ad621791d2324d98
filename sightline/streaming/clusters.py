"""Clusters that grow with a stream of reports: an app's state lives in the stream's checkpoint."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.operators.iterative import ASSIGNED, ByLabel, Model, empty_state, grow, packed


def growing_clusters(reports: DataFrame, make: Callable[[], Model] = ByLabel, size: int = 50, most: int = 400) -> DataFrame:
    """app, id, cluster_id, batch_no of the reports of a stream (app, id, text, label)."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else empty_state()
        items = [row for pdf in pdfs for row in pdf[["id", "text", "label"]].to_dict("records")]
        rows = grow(items, state, make(), size, most)
        kept.update((packed(state),))
        yield pd.DataFrame([(key[0], i, f"{key[0]}__C{c}", b) for i, c, b in rows], columns=["app", "id", "cluster_id", "batch_no"])

    return reports.select("app", "id", "text", "label").groupBy("app").applyInPandasWithState(run, ASSIGNED, "state string", "append", GroupStateTimeout.NoTimeout)


def keep_clusters(reports: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """Append the clusters of what has arrived to a Parquet folder; started again, it goes on from its state."""
    rows = growing_clusters(reports, **how)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
