"""Shared folder, written tables, size-checked joins and connected components."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side of a join is broadcast only if its written table is known to have at most so many bytes.
BROADCAST_BYTES = 32 << 20
#: Rows of a small table that one task writes.
SMALL_ROWS = 50_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_NUMBERS = frozenset("boolean byte short integer long float double date timestamp".split())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or in local mode (tests) one made here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = getattr(context, "_quillspark_shared", None)
        if base is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
            base = context._quillspark_shared = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return base.rstrip("/")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application: they share no local folder with the driver."""
    context = spark.sparkContext
    if not getattr(context, "_quillspark_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="quillspark-")
        context.addPyFile(shutil.make_archive(os.path.join(folder, "quillspark"), "zip", os.path.dirname(package), os.path.basename(package)))
        context._quillspark_shipped = True
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillspark/{uuid.uuid4().hex}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Tables:
    """Tables written to the shared folder: they cut lineage, and a lost executor costs no earlier stage.

    As a context manager it deletes at its end all that it wrote; what outlives it is written by another one.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())

    def write(self, df: DataFrame, name: str, most: int | None = None) -> DataFrame:
        """The same rows, read back from Parquet; their number and size are known without another job (see `rows_of`, `sized`).

        `most`: how many rows there can be, if that is known: a small table is then written by few tasks.
        Shuffle files of the job go with its end, for nothing reads them again.
        """
        path = new_path(self.spark, name)
        seen = Observation()
        out = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df.schema)).alias("bytes"))
        if most is not None and most < SMALL_ROWS * 1000:
            out = out.coalesce(max(1, -(-most // SMALL_ROWS)))
        self.paths.append(path)
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            out.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._path, back._rows_written, back._bytes_written = path, seen.get["n"], seen.get["bytes"] or 0
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that no later result reads."""
        for df in frames:
            remove(self.spark, df._path)
            self.paths.remove(df._path)


def row_bytes(schema: StructType) -> Column:
    """Bytes of a row in memory: 8 for it and for each value, and the contents of strings, binaries and arrays of numbers."""
    total = F.lit(8 * (1 + len(schema))).cast("long")
    for field in schema:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            total += F.coalesce(F.octet_length(column), F.lit(0))
        elif kind == "array":
            total += 8 * F.coalesce(F.size(column), F.lit(0))
    return total


def rows_of(df: DataFrame) -> int:
    """The number of rows of a written table; a repeated task may have counted some twice, so it is never too small."""
    n = getattr(df, "_rows_written", None)
    return df.count() if n is None else n


def sized(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if its size is known and small; else joined by shuffle, where AQE splits skewed keys.

    The size is that of a written table, or for numbers alone that of so many rows.
    """
    known = getattr(df, "_bytes_written", None)
    if known is None and all(f.dataType.typeName() in _NUMBERS for f in df.schema):
        known = 8 * (1 + len(df.schema)) * (rows_of(df) if rows is None else rows)
    return F.broadcast(df) if known is not None and known <= limit else df


def components(tables: Tables, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for all nodes of the edges; root is the smallest node of the connected component.

    Every round hooks each node to its smallest neighbour below it, follows the
    pointers once, and relabels the edges. Edges inside a tree go, so the graph
    shrinks at least by half the nodes that still have edges; a star is done in
    one round. Only min aggregates run over a node's edges, so hubs are
    pre-aggregated before any shuffle.
    """
    n = getattr(edges, "_rows_written", None)
    with Tables(tables.spark) as own:
        e = own.write(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges", n)
        maps: list[DataFrame] = []
        while rows_of(e):
            n = rows_of(e)
            hook = own.write(e.groupBy("b").agg(F.min("a").alias("a")).select(F.col("b").alias("node"), F.col("a").alias("up")), "hooks", n)
            n_nodes = rows_of(hook)
            for _ in range(2):  # pointer jumping
                over = sized(hook.select(F.col("node").alias("up"), F.col("up").alias("upper")), n_nodes)
                hook = hook.join(over, "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
            hook = own.write(hook, "parents", n_nodes)
            maps.append(hook)
            left = sized(hook.select(F.col("node").alias("a"), F.col("up").alias("ra")), n_nodes)
            right = sized(hook.select(F.col("node").alias("b"), F.col("up").alias("rb")), n_nodes)
            moved = e.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
            e = own.write(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", n)
        nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
        out = nodes.withColumn("root", F.col("node"))
        for hook in maps:
            up = sized(hook.select(F.col("node").alias("root"), "up"), rows_of(hook))
            out = out.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        edge_rows = getattr(edges, "_rows_written", None)
        return tables.write(out, "components", None if edge_rows is None else 2 * edge_rows)
