"""Tables in the cluster's shared folder, which cut the lineage of loops, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders that this process made for itself, as Spark may name them.
_MADE: set[str] = set()
_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def set_shared_dir(spark: SparkSession) -> str | None:
    """The folder that the cluster names in spark.checkpoint.dir, if it does."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named and named.rstrip("/") not in _MADE else None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one is made only where it is unset and all runs on one machine."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(set_dir)
        _MADE.update((set_dir, "file://" + set_dir, "file:" + set_dir))
        set_dir = "file://" + set_dir
    return set_dir.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *by: str, schema: StructType | None = None) -> DataFrame:
    """Write df as a table in the shared folder, in folders by the columns given, and read it again, by its own schema or another: a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(schema or df.schema).parquet(path)
    _STORED[out] = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where its input has fewer; else as it is, and nothing moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete tables that materialize wrote, or the folder part of them, and let Spark's cleaner delete the shuffle files of what is over."""
    for df in tables:
        spark, path = df.sparkSession, _STORED[df] if part else _STORED.pop(df)
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if spark := SparkSession.getActiveSession():
        spark._jvm.System.gc()  # the cleaner acts on what the driver no longer refers to


def _state(edges: DataFrame) -> tuple:
    """A count and a checksum: equal edges have equal ones."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that links reach.

    Alternating large and small stars, all on executors.  Nodes are longs.  Null ends,
    self loops and repeated edges are ignored; no edges give no rows.  A round moves each
    neighbour to the smallest one known, so a chain of n nodes takes about log2(n) rounds; every round is written to
    the shared folder, which cuts the lineage, and deleted when the next one stands.
    More rounds than max_rounds raise an error.
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    stars = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(stars)
    for _ in range(max_rounds):
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.*").where("a <> b").distinct()
        stars, old = materialize(small, "edges"), stars
        discard(old)
        after = _state(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
