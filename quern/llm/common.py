"""What several operators share: checkpoints, whitespace and group-wise components."""

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only one that the text contracts know.
SPACE = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session has none, one is made on a single machine (master ``local``);
    on a cluster a folder of the driver's would not do, so that raises.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark can write."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(column: str = "text") -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(text: Column) -> list[Column]:
    """A text's 128-bit key (t1, t2): 64 bits would collide among 10^10 texts."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a checkpointed table of narrow rows, with a broadcast hint if it has at most ``rows``."""
    return F.broadcast(df) if df.count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores before it, that no column of ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold kept from training: crc32 of the id's text modulo 5 is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an undirected graph of edges (a, b); the
    component is its smallest node.

    Each round sends labels along the edges and then halves the label chains, so
    rounds grow with the logarithm of a component's width. Messages are minimised
    before they are exchanged. All joins read checkpointed sides, through an
    exchange on each, so that adaptive execution can split a hub's partition.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    for _ in range(max_rounds):
        sent = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("to")).agg(F.min("component").alias("heard"))
        met = saved(labels.join(sent, F.col("node") == F.col("to")).select("node", F.least("component", "heard").alias("component"), (F.col("heard") < F.col("component")).alias("moved")))
        moved = not met.filter("moved").isEmpty()
        if not moved:
            return met.select("node", "component")
        up = met.select(F.col("node").alias("parent"), F.col("component").alias("above"))
        labels = saved(met.join(up, F.col("component") == F.col("parent")).select("node", F.least("component", "above").alias("component")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
