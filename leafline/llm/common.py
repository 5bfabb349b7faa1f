"""What the operators here share: lineage cuts, table loading, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows may be broadcast; it is counted first.
BROADCAST_ROWS = 200_000
#: Files of a small staged table, narrow rows of a file, and bytes of an input with texts for which there is one.
FILES, FILE_ROWS, FILE_BYTES = 2, 250_000, 2 << 20
#: Rows and bytes of an Arrow batch, so that a Python worker's memory has a bound whatever a row's size.
BATCH_ROWS, BATCH_BYTES = 500, 1 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, read by Spark so that any store works."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get, unless the session has bounds of its own."""
    for key, ours in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", "1") == "1":  # not set
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(ours))


def released() -> None:
    """Hand a Python worker's free memory back at the end of a task; workers are used again by later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names one.

    Only a local master without that setting gets a temporary folder; elsewhere its lack is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="leafline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the shared folder is cleared with the job
        pass


def staged(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: computed once, lineage cut.

    rows: a bound on its narrow rows where one is known. A small table is then a few files, however
    many partitions it was worked out in; files cost a process each in some file systems.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(FILES, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/leafline-{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.option("compression", "zstd").parquet(path)  # no native buffers that wait for a collection, and a smaller table
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.leafline_path = path
    return out


def like(texts: DataFrame) -> int:
    """A bound for ``staged`` on tables made of texts: narrow rows that weigh as much as the texts do by the planner's estimate."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return FILE_ROWS * min(-(-size // FILE_BYTES), 1_000_000)


def dropped(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    if path := getattr(df, "leafline_path", None):
        _remove(df.sparkSession, path)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Count df, reading no further than one row past the bound."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if df is counted to be within the bound; else Spark joins by shuffle."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def _with_least(rows: DataFrame, low: DataFrame, edges: int) -> DataFrame:
    """rows(u, v) with m of low(u, m, n), where n is the number of rows of u.

    Nodes of many rows are joined by broadcast, so that no task gets a hub's rows together. At
    most BROADCAST_ROWS nodes can have more than ``many`` of them.
    """
    many = max(1000, 2 * edges // BROADCAST_ROWS)
    hubs = F.broadcast(low.where(F.col("n") > many).select("u", F.col("m").alias("hub")))
    marked = rows.join(hubs, "u", "left")
    rest = marked.where("hub is null").select("u", "v").join(low.where(F.col("n") <= many).select("u", "m"), "u")
    return marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")).union(rest.select("u", "v", "m"))


def connected_components(edges: DataFrame, src: str, dst: str, rounds: int = 60, most: int | None = None) -> DataFrame:
    """Smallest reachable id of each node that has an edge: columns node, component.

    Alternating large-star and small-star steps: each round rewrites edges towards the smallest
    neighbour, a logarithmic number of rounds in practice. Neighbourhoods are reduced by a
    min with map-side combine and joined back, hubs apart from the rest. Each round's table
    replaces the one before. Null ends and loops are ignored. most: a bound on the edges, if known.
    """
    a, b = F.col(src), F.col(dst)
    e = staged(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), most)
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    last = mark(e)
    for _ in range(rounds):
        if not last[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        large = staged(_with_least(both, low, 2 * last[0]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), last[0])
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        up = _with_least(large, low, 2 * last[0])
        small = up.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, e = e, staged(small.distinct(), 2 * last[0])
        dropped(old)
        dropped(large)
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(out.select(F.col("component").alias("node"), "component").distinct())
