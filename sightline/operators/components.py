"""Connected components by alternating large and small stars, and the closures built on them."""

from __future__ import annotations

import atexit
import time
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where the session names none and
    is a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """End a lineage with a table in the shared folder; it goes when the session ends, the shuffle files behind it soon."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


_FREED = [0.0]


def free_shuffles(spark, every: float = 5.0) -> None:
    """Spark removes the files of a shuffle when the driver's JVM has collected its plan, else only by chance; a collection at most every so many seconds."""
    if time.monotonic() - _FREED[0] >= every:
        spark._jvm.System.gc()
        _FREED[0] = time.monotonic()


def _remove(spark, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already; the files are then the cluster's to clear
        pass


def components(links: DataFrame, end_lineage=cut) -> DataFrame:
    """node, component (its least node) of the nodes that links (a, b) touch. Neighbours are never gathered:
    minima are aggregated and join back, and every round is cut."""
    star = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star, before = end_lineage(star), None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = end_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def all_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, component with isolated nodes as their own."""
    found = components(links)
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def two_sided(links: DataFrame, by: str = "a", end_lineage=cut) -> DataFrame:
    """node, component (its least node) of a graph whose links join an a with a b, repeated or not; no node is both. An a
    without a b (null) is alone, and the null a node of no component. by: what tells a's apart as a does, if links lie by it.

    An a tells the least of itself and its b's to all of them, and a b ties what it is told to the least of that. So links
    are shuffled twice, in order and never gathered, and rounds see only the ties between the few nodes that were told."""

    def least(column: str, *keys: str) -> tuple:
        """The least of the column, and a row's place among its distinct values (0: a repeated one)."""
        order = Window.partitionBy(*keys).orderBy(F.col(column).asc_nulls_last())
        first = F.row_number().over(order) == 1
        new = first | ~F.col(column).eqNullSafe(F.lag(column).over(order))
        return F.min(column).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.when(first, 1).when(new, 2).otherwise(0)

    low, place = least("b", by)
    told = links.select("a", "b", low.alias("low"), place.alias("place")).where("place > 0").withColumn("low", F.least("a", "low"))
    own, other = F.struct(F.col("a").alias("node"), F.col("low").alias("told")), F.struct(F.col("b").alias("node"), F.when(F.col("b").isNotNull(), F.col("low")).alias("told"))
    told = told.select(F.inline(F.when(F.col("place") == 1, F.array(own, other)).otherwise(F.array(other))))
    # a number orders the nodes, as names often begin alike
    told = told.repartition("node").withColumn("number", F.xxhash64("node"))
    low, place = least("told", "number", "node")
    ties = told.select("node", "told", low.alias("low"), place.alias("place")).where("place > 0")
    ties = end_lineage(ties.select("place", F.when(F.col("place") == 1, F.col("node")).alias("node"), "told", "low").distinct())
    found = components(ties.where("place = 2").select(F.col("told").alias("a"), F.col("low").alias("b")), end_lineage).withColumnRenamed("node", "low")
    return ties.where("place = 1").join(found, "low", "left").select("node", F.coalesce("component", "low").alias("component"))


def largest(comps: DataFrame) -> DataFrame:
    """Number of nodes, of components, size of the largest and its share."""
    sizes = comps.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_components"), F.max("n").alias("lcc_size")).withColumn(
        "lcc_ratio", F.round(F.col("lcc_size") / F.greatest("n_nodes", F.lit(1)), 6)
    )
