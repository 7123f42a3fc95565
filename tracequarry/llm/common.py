"""Pieces that several corpus operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = str.maketrans(UPPER, LOWER)

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests, a laptop) a
    temporary one is set; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tracequarry-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has a short lineage and outlives lost executors. ``release`` deletes
    the files early; else they go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tracequarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tracequarry_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``."""
    path = getattr(df, "_tracequarry_path", None)
    spark = _written.pop(path, None)
    if spark is not None:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended before the interpreter
            return


def lowered(text: Column) -> Column:
    """Null as empty; only A to Z change."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has been counted to at most ``max_rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def connected_components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (``a``, ``b``), as (``node``, ``component``).

    ``component`` is the smallest node reachable. Alternates large-star and small-star
    steps until nothing changes; each step is a grouped minimum and a join. The minima are
    written first, so that the join's sides are plain exchanges, of which Spark splits
    those of a node with very many links. Nodes without links aren't returned; nulls are
    no nodes. The result is written (``materialize``).
    """
    links = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    links = materialize(links.distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        # large star: every larger neighbour of a goes to a's smallest one
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # small star: a and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.union(least.select("a", F.col("m").alias("b")))
        after = materialize(small.distinct())
        release(links)
        release(low)
        links = after
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
            found = materialize(found.union(found.select(F.col("component").alias("node"), "component").distinct()))
            release(links)
            return found
        before = now
