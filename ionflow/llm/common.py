"""Shared plumbing: shared-folder tables, code shipping, connected components."""

from __future__ import annotations

import contextlib
import itertools
import os
import shutil
import tempfile
import uuid
import zipfile

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

_FALLBACK_DIR: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once per application, as a zip."""
    sc = spark.sparkContext
    if getattr(sc, "_ionflow_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="ionflow"), "ionflow_source.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.join("ionflow", os.path.relpath(os.path.join(folder, name), root)))
    sc.addPyFile(out)
    sc._ionflow_shipped = True


def workdir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir (a temporary one in local mode, where unset).

    All lineage cuts of the operators are tables written here, so that a lost
    executor never takes the only copy of an intermediate result with it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _FALLBACK_DIR or not os.path.isdir(_FALLBACK_DIR[0]):
            _FALLBACK_DIR[:] = [tempfile.mkdtemp(prefix="ionflow-shared-")]
            import atexit

            atexit.register(shutil.rmtree, _FALLBACK_DIR[0], True)
        base = "file://" + _FALLBACK_DIR[0]
    return f"{base.rstrip('/')}/ionflow/{name}-{uuid.uuid4().hex[:12]}"


def filesystem(base: str):
    """The file system and path of a folder URL, as pyarrow has them."""
    return pafs.FileSystem.from_uri(base if "://" in base or base.startswith("file:") else "file://" + base)


def free_name(df: DataFrame, name: str) -> str:
    """name, prefixed until df has no such column, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for the jobs run meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write df to path as Parquet and return the table read from there."""
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    for f in schema.fields:
        f.nullable = True
    return df.sparkSession.read.schema(schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop shuffle files of steps already saved."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def components(spark: SparkSession, edges: DataFrame, base: str) -> DataFrame:
    """Connected components by alternating large-star and small-star.

    edges: two bigint columns a and b, in any order, repeats and self-loops
    allowed. Returns (node, component): one row per node that has an edge to
    another node, component being the smallest node reachable. Each round is
    two aggregations (combined map-side) and two joins whose skewed side can
    be split, so that a node with millions of neighbours stays cheap.
    """
    cur = saved(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{base}/cc0",
    )
    before, last = None, f"{base}/cc0"
    for k in itertools.count(1):  # as many rounds as it takes: near the logarithm of the longest chain
        sign = cur.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if sign == before or sign[0] == 0:
            break
        before = sign
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, f"{base}/ccl{k}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = saved(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{base}/cc{k}")
        remove(spark, last, f"{base}/ccl{k}")
        last = f"{base}/cc{k}"
    low = cur.groupBy("u").agg(F.min("v").alias("m"))
    return low.select(F.col("u").alias("node"), F.col("m").alias("component")).union(
        low.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    )
