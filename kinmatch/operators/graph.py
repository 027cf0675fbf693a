"""Tables of a shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster names its shared folder in spark.checkpoint.dir; only a local session without it (tests) gets one made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, with its lineage cut: a lost executor costs no more than a read.

    Zstandard keeps its buffers on the heap; Snappy's, outside, wait for a collection of garbage. Tables of hashes, which
    nothing compresses, and of numbers that a dictionary holds may go ``uncompressed``.
    """
    path = new_folder(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_stored(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``stored`` that no plan reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().analyzed().relation().location().rootPaths().head().toString())
        at.getFileSystem(conf).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Like ``stored``, in Spark's own form: larger on disk, and cheaper to write where columns are hashes or rows few."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def remove_checkpoint(df: DataFrame) -> None:
    """Deletes the files of a ``checkpoint`` that no plan reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        at = jvm.org.apache.hadoop.fs.Path(file.get())
        at.getFileSystem(conf).delete(at, True)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each round is two aggregations keyed by node, a
    hub's neighbours are never gathered into a list (only their minimum is), and the number of rounds is logarithmic.
    Minima are written before they are joined, so that both sides of a join are plain shuffles and adaptive execution can
    split a hub's. A round's table goes when the next is written.
    Nulls are dropped, self-links and repeated links do no harm, no edges give no rows.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = checkpoint(links)
    before = None
    for _ in range(rounds):
        # The links are a forest of stars once no step changes them; their number and sum tell.
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = checkpoint(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select("b", "m", "a").selectExpr("stack(2, a, m, b, m) as (a, b)").where("a <> b").distinct()
        done = [links, least, large]
        links = checkpoint(small)
        for df in done:
            remove_checkpoint(df)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
