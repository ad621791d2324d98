"""Scans of the inputs: reports, nodes, edges, triples, clusters, rankings; workbooks without a library."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from sightline.functions.ids import normal_id, parse_ids
from sightline.schema import EDGE, NODE, TRIPLE, first_present, require_columns
from sightline.sources.locate import Folder

#: Sheets that hold no reports, and the columns that may hold their text, in order of preference.
SKIPPED_SHEETS = ("QA_Summary", "Label_Guide")
TEXTS = ("primary_clue", "description", "text", "content", "desc")
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheets(path: str) -> dict[str, list[list[str | None]]]:
    """Rows of cell texts by sheet."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ET.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS):
            target = targets[s.get(_REL)].lstrip("/")
            rows = []
            for row in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iterfind("m:sheetData/m:row", _NS):
                cells: list[str | None] = []
                for c in row.iterfind("m:c", _NS):
                    letters = re.match(r"[A-Z]+", c.get("r", "") or "")
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    cells += [None] * (at - len(cells))
                    v, text = c.find("m:v", _NS), c.find("m:is", _NS)
                    if text is not None:
                        cells.append("".join(t.text or "" for t in text.iter(f"{{{_NS['m']}}}t")))
                    else:
                        cells.append(None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text)
                rows.append(cells)
            out[s.get("name")] = rows
    return out


class WorkbookSource(DataSource):
    """spark.read.format("workbook").option("sheet", name): all columns as text, a partition for each sheet."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _picked(self) -> dict[str, list]:
        found = {k: v for k, v in sheets(self.options["path"]).items() if k not in SKIPPED_SHEETS}
        return {self.options["sheet"]: found[self.options["sheet"]]} if "sheet" in self.options else found

    def schema(self) -> StructType:
        names = dict.fromkeys(str(c) for rows in self._picked().values() if rows for c in rows[0] if c)
        return StructType([StructField("sheet", StringType()), *(StructField(n, StringType()) for n in names)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WorkbookReader(self.options["path"], list(self._picked()), schema.names)


class _WorkbookReader(DataSourceReader):
    def __init__(self, path: str, picked: list[str], names: list[str]):
        self.path, self.picked, self.names = path, picked, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.picked]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = sheets(self.path)[partition.value]
        for row in rows[1:]:
            cells = dict(zip(rows[0], row))
            yield tuple(partition.value if n == "sheet" else cells.get(n) for n in self.names)


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Columns as text by the file's ending: xlsx, csv, tsv, jsonl, parquet."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "xlsx":
        spark.dataSource.register(WorkbookSource)
        reader = spark.read.format("workbook")
        return (reader.option("sheet", sheet) if sheet else reader).load(path)
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",", multiLine=True, escape='"', encoding="UTF-8")
    if kind in ("jsonl", "json"):
        return spark.read.option("primitivesAsString", True).json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


def nodes(df: DataFrame) -> DataFrame:
    return require_columns(df, NODE).withColumn("report_ids", parse_ids(F.col("source_row_index").cast("string")))


def edges(df: DataFrame) -> DataFrame:
    return require_columns(df, EDGE).withColumn("report_ids", parse_ids(F.col("source_row_index").cast("string")))


def triples(df: DataFrame) -> DataFrame:
    """Trimmed; rows with a blank subject, relation or object are dropped."""
    out = require_columns(df, TRIPLE).select(*(F.trim(F.col(c).cast("string")).alias(c) for c in TRIPLE))
    return out.where("coalesce(subject, '') <> '' AND coalesce(relation, '') <> '' AND coalesce(object, '') <> ''")


def reports(df: DataFrame, ordinal: str, app: str = "app") -> DataFrame:
    """app, id, text, issue_key: ids in normal form, rows without id or text dropped, the first of each (app, id)."""
    text = first_present(df, TEXTS)
    issue = F.trim(F.col("issue_key")) if "issue_key" in df.columns else F.lit(None).cast("string")
    out = df.select(F.col(app).alias("app"), normal_id(F.col("id").cast("string")).alias("id"), F.trim(F.col(text)).alias("text"), issue.alias("issue_key"), F.col(ordinal).alias("ord"))
    out = out.where("id IS NOT NULL AND coalesce(text, '') <> ''")
    rank = F.row_number().over(Window.partitionBy("app", "id").orderBy("ord"))
    return out.withColumn("rank", rank).where("rank = 1").drop("rank", "ord")


#: Columns that raw_scan adds.
LINEAGE = ("sheet", "id_norm", "issue_key_norm", "text_used", "text_col_used")


def raw_scan(df: DataFrame, sheet: Column) -> DataFrame:
    """Every row as it came, with where its parts came from: the sheet, ids and issue keys in normal form, the text and the
    column that gave it. A blank application is the sheet's. A column of df named like an added one is replaced."""
    if missing := [c for c in ("id", "issue_key") if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    text = first_present(df, TEXTS)
    blank = F.lit("")
    app = F.coalesce(F.nullif(F.trim(F.col("app").cast("string")), blank), F.col("_sheet")) if "app" in df.columns else F.col("_sheet")
    added = {
        "app": app, "sheet": F.col("_sheet"), "id_norm": normal_id(F.col("id").cast("string")), "issue_key_norm": F.trim(F.coalesce(F.col("issue_key").cast("string"), blank)),
        "text_used": F.trim(F.coalesce(F.col(text).cast("string"), blank)), "text_col_used": F.lit(text),
    }
    return df.withColumn("_sheet", sheet.cast("string")).withColumns(added).drop("_sheet")


def entities(df: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Distinct entities of the triples' ends, of these types."""
    both = df.select(F.col("subject").alias("entity"), F.col("subject_type").alias("type")).unionByName(df.select(F.col("object").alias("entity"), F.col("object_type").alias("type")))
    both = both.where(F.trim("entity") != "")
    return (both.where(F.col("type").isin(types)) if types else both).distinct()


def clusters(df: DataFrame) -> DataFrame:
    return require_columns(df, ("app", "id", "cluster_id", "issue_key")).withColumn("id", normal_id(F.col("id").cast("string")))


def rankings(df: DataFrame, cap: int = 200) -> DataFrame:
    """app, query_id, rank, doc_id from the widest column of joined rankings: first of each document, capped."""
    wide = sorted((c for c in df.columns if c.startswith("top_retrieved")), key=lambda c: (-int((re.findall(r"\d+", c) or ["0"])[-1]), c))
    if not wide:
        raise ValueError("no column top_retrieved*")
    out = df.select("app", F.col("query_id").cast("string").alias("query_id"), F.posexplode(F.split(F.coalesce(wide[0], F.lit("")), r"\|")).alias("pos", "doc_id"))
    out = out.where("trim(doc_id) <> ''").groupBy("app", "query_id", F.trim("doc_id").alias("doc_id")).agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("app", "query_id").orderBy("pos"))
    return out.where("doc_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= cap).drop("pos")


class GraphProvider(Protocol):
    """Where an evidence graph comes from."""

    def nodes(self) -> DataFrame: ...

    def edges(self) -> DataFrame: ...

    def defects(self) -> DataFrame | None: ...


class FileProvider:
    """Nodes, edges and, if given, defects from files by their endings."""

    def __init__(self, spark: SparkSession, nodes_path: str, edges_path: str, defects_path: str | None = None):
        self.spark, self.paths = spark, (nodes_path, edges_path, defects_path)

    def nodes(self) -> DataFrame:
        return nodes(read_table(self.spark, self.paths[0]))

    def edges(self) -> DataFrame:
        return edges(read_table(self.spark, self.paths[1]))

    def defects(self) -> DataFrame | None:
        """None where no path is given or nothing is there."""
        if not self.paths[2] or not Folder(self.spark, self.paths[2]).exists():
            return None
        return require_columns(read_table(self.spark, self.paths[2]), ("id", "description"))
