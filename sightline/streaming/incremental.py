"""The graph's bridge table kept up to date from a stream of triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def bridge_rows(triples: DataFrame) -> DataFrame:
    """node_id, type, report_id of both ends."""
    ends = F.array(*(F.struct(F.col(e).alias("node_id"), F.col(f"{e}_type").alias("type")) for e in ("subject", "object")))
    return triples.select(F.col("source_row_index").alias("report_id"), F.inline(ends))


def keep_bridge(triples: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Add to the table at path what each micro-batch brings and the table lacks. A batch that runs again after
    a failure adds nothing twice: its rows are told from the table's by an anti-join."""

    def add(batch: DataFrame, _: int) -> None:
        spark, new = batch.sparkSession, bridge_rows(batch).distinct()
        fs = spark._jvm.org.apache.hadoop.fs.Path(path)
        if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
            new = new.join(spark.read.parquet(path), ["node_id", "type", "report_id"], "left_anti")
        new.write.mode("append").parquet(path)

    writer = triples.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
