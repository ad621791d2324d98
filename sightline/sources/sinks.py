"""Where results go: a folder of named tables, JSON files by view, CSV, graph tables, LaTeX."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.sources.readers import LINEAGE


def sheet_name(name: str) -> str:
    """At most 31 characters, none that a workbook forbids."""
    return re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "sheet"


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/sheet={sheet_name(name)}")


def kept_by_sheet(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """The raw rows (of readers.raw_scan) whose sheet and id were kept, without the columns that the scan added but the sheet."""
    ids = kept.select("sheet", "id_norm").distinct()
    return raw.join(ids, ["sheet", "id_norm"], "left_semi").drop(*(c for c in LINEAGE if c != "sheet"))


def write_sheets(raw: DataFrame, kept: DataFrame, path: str) -> None:
    """What was kept, in a folder for each sheet."""
    kept_by_sheet(raw, kept).write.mode("overwrite").partitionBy("sheet").parquet(path)


def append_log(answered: DataFrame, task: str, path: str) -> None:
    """Adds a row for each request to a model (rows of backend.model_column): when, what was asked and answered, whether it
    failed. Rows of one call share a time; a folder for each task."""
    asked = F.to_json(F.struct(*(c for c in answered.columns if c not in ("value", "status"))))
    rows = answered.select(
        F.lit(task).alias("task"), F.current_timestamp().alias("at"), F.col("id").cast("string").alias("conversation_id"),
        asked.alias("request"), F.col("value").alias("response"), F.col("status"), (F.col("status") != "failed").alias("success"),
    )
    rows.write.mode("append").partitionBy("task").parquet(path)


def write_json(df: DataFrame, path: str, key: str | None = None) -> None:
    """JSON lines, in a folder for each value of key if one is given."""
    if key is None:
        df.write.mode("overwrite").json(path)
    else:
        df.select(F.col(key), F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Tables that a graph database can load: one row an id; edges by relation and end types."""
    nodes.dropDuplicates(["id"]).write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.dropDuplicates(["id"]).write.mode("overwrite").partitionBy("relation", "source_type", "target_type").parquet(f"{path}/edges")


def latex(df: DataFrame, caption: str, most: int = 200) -> str:
    """A small table for a paper."""
    rows = df.limit(most).collect()
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("%", r"\%")
    body = "\n".join(" & ".join(map(text, r)) + r" \\" for r in rows)
    head = " & ".join(c.replace("_", r"\_") for c in df.columns)
    return f"\\begin{{table}}\n\\caption{{{caption}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n\\toprule\n{head} \\\\\n\\midrule\n{body}\n\\bottomrule\n\\end{{tabular}}\n\\end{{table}}"
