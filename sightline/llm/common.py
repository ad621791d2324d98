"""Helpers shared by the training-data operators: durable tables, text columns, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import time
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none and is a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there, so a
    lost executor costs a re-read instead of a recomputation. Removed when the session ends; the shuffle files behind it go soon after."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sightline-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _TABLES.append(path)
    atexit.register(_remove, spark, path)
    free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


_TABLES: list[str] = []
_FREED = [0.0]


def free_shuffles(spark: SparkSession, every: float = 5.0) -> None:
    """Spark removes the files of a shuffle when the driver's JVM has collected its plan, else only by chance; a collection at most every so many seconds."""
    if time.monotonic() - _FREED[0] >= every:
        spark._jvm.System.gc()
        _FREED[0] = time.monotonic()


def last_table() -> str:
    """The path of the table that was written last, for remove()."""
    return _TABLES[-1]


def remove(spark: SparkSession, path: str) -> None:
    """A table that nothing reads any more goes before its operator ends."""
    _remove(spark, path)
    _TABLES.remove(path)


def scoped(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """operator with its result written as a table of its own, and the tables behind it removed."""

    @wraps(operator)
    def run(*args, **named) -> DataFrame:
        before = len(_TABLES)
        out = durable(operator(*args, **named), operator.__name__)
        for path in _TABLES[before:-1]:
            _remove(out.sparkSession, path)
        _TABLES[before:-1] = []
        return out

    return run


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already; the files are then the cluster's to clear
        pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id and text (null: empty) alone, so that no further column of docs can clash."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), *more
    )


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: crc32 of the id as text, remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_KEPT: dict = {}
_CALLS = [0]


def keep(key: tuple, make: Callable):
    """A worker process's one large thing that later tasks of the same operator use again."""
    _CALLS[0] += 1
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Return freed memory to the system: idle workers of earlier stages count against an executor's limit too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the allocator of other C libraries may have none
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]]) -> DataFrame:
    """mapInArrow with per-task state: make() runs once a task and returns batch -> dicts of columns;
    what that function has as attribute finish runs after the last batch."""
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calls = _CALLS[0]
        work = make()
        if _CALLS[0] == calls:  # an operator without such a thing frees what others kept
            _KEPT.clear()
            give_back()

        def each() -> Iterator[dict]:
            for batch in batches:
                if batch.num_rows:
                    yield from work(batch)
                del batch
                give_back()

        found = each()
        for columns in chain(found, (columns for last in [getattr(work, "finish", tuple)] for columns in last())):
            yield pa.RecordBatch.from_arrays([_array(columns[field.name], field.type) for field in arrow], schema=arrow)
        del work, found
        give_back()

    return df.mapInArrow(run, struct)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values if isinstance(values, pa.Array) and values.type == kind else pa.array(values, kind)


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each cut holds about limit bytes of text, but one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    yield batch.slice(begin)


def row_mark(docs: DataFrame) -> Column:
    """A hash of the row's text; with doc_id it names the row, or rows that repeat it."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def keep_decided(docs: DataFrame, decided: DataFrame, sent: int = 500_000) -> DataFrame:
    """The rows of docs that stay, with their columns. decided has doc_id, mark (row_mark) and kept for each row;
    of rows that repeat both id and text one stays. Keys are broadcast up to sent, else both sides are shuffled."""
    name = f"decided_{uuid.uuid4().hex}"  # no column of docs has it
    keys = decided.groupBy("doc_id", "mark").agg(F.max("kept").alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1")
    keys = durable(keys.select(F.struct("doc_id", "mark", "stays").alias(name)), "keys")
    key = keys[name]
    same = docs["doc_id"].cast("long").eqNullSafe(key["doc_id"]) & (row_mark(docs) == key["mark"])
    told = docs.join(F.broadcast(keys) if keys.count() <= sent else keys, same, "left")
    own = [docs[f"`{c}`"] for c in docs.columns]
    out = told.where(key.isNull()).select(*own)
    if keys.where(key["stays"]).isEmpty():
        return out
    return out.unionAll(told.where(key["stays"]).dropDuplicates([name]).select(*own))
